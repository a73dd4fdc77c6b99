"""Random documents: the scan against the line-wise SQL form of the rules."""

import random

import duckdb
import pandas as pd
import pytest

from compare import rows_of
from gatewarden import corpus
from gatewarden.operators.scan import scan
from oracle.parts import with_parts

TOPS = [t for t in corpus.TRIGGERS if t] + [corpus.TRIGGERS_AT_COLUMN_0]
BLOCKS = [p for p in corpus.PERMISSIONS if p]
EXTRA = ["  \u2003run: |", "\t", "  run: |\r", "    - ref: ${{github.event.pull_request.head.ref}}",
         "  #x", "  token: ${{secrets.GITHUB_TOKEN}}", "  uses:\u00a0x@main", "  x\u0085", "  key: value"]


@pytest.mark.parametrize("seed", [1, 2])
def test_scan_equals_sql(spark, seed):
    rng = random.Random(seed)
    rows = []
    for i in range(400):
        parts = [rng.choice(TOPS), *rng.sample(BLOCKS, rng.choice([0, 1, 1, 2])), "jobs:"]
        parts += [rng.choice(corpus.STEP_LINES + tuple(EXTRA)) for _ in range(rng.randrange(60))]
        # Some files are exact copies of others.
        text = rows[rng.randrange(i)][4] if i and rng.random() < 0.2 else rng.choice(
            ["\n", "\n", "\r\n"]).join(parts)
        rows.append((f"o/r{i // 9}", i // 9, i % 3, f"w{i % 3}.yml", text))
    names = ["full_name", "repo_ord", "wf_ord", "path", "content"]
    files = pd.DataFrame(rows, columns=names)
    con = duckdb.connect()
    con.register("given", files)
    con.execute("CREATE TABLE files AS SELECT *, row_number() OVER () AS fk FROM given")
    cursor = con.execute(with_parts("SELECT * FROM findings", given=("files",)))
    expected = rows_of([d[0] for d in cursor.description], cursor.fetchall())
    df = scan(spark.createDataFrame(
        rows, "full_name string, repo_ord long, wf_ord int, path string, content string"))
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    assert got == expected
    assert sum(got.values()) > 1000
