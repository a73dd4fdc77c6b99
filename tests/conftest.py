import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parent.parent))
sys.path.insert(0, str(Path(__file__).resolve().parent))

from gatewarden.session import local_session  # noqa: E402


@pytest.fixture(scope="session")
def spark():
    return local_session(8, 4, **{"spark.ui.showConsoleProgress": "false"})


@pytest.fixture
def files_of(spark):
    """Workflow files from a list of texts; the n-th becomes repository n."""

    def build(texts):
        rows = [(f"org/r{i}", i, 0, f"w{i}.yml", t) for i, t in enumerate(texts)]
        return spark.createDataFrame(
            rows, "full_name string, repo_ord long, wf_ord int, path string, content string"
        )

    return build
