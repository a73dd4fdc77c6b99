"""Small helpers to write expressions as SQL text.

Long expressions are cheaper to build as text than call by call, and read the
same. Literals are escaped here and nowhere else.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

_ESCAPES = {"\\": "\\\\", "'": "\\'", "\n": "\\n", "\r": "\\r", "\t": "\\t"}


def literal(text: str | None) -> str:
    if text is None:
        return "cast(null as string)"
    return "'" + "".join(_ESCAPES.get(c, c) for c in text) + "'"


def array(values: Iterable[str | None]) -> str:
    return "array(" + ", ".join(literal(v) for v in values) + ")"


def pick(values: Iterable[str | None], number: str) -> str:
    """The value with this 0-based number."""
    return f"get({array(values)}, cast({number} as int))"


def all_of(tests: Iterable[str]) -> str:
    return " and ".join(f"({t})" for t in tests) or "true"


def any_of(tests: Iterable[str]) -> str:
    return " or ".join(f"({t})" for t in tests) or "false"


def contains_any(text: str, needles: Iterable[str]) -> str:
    distinct = sorted(set(needles))
    if "" in distinct:
        return "true"
    return any_of(f"contains({text}, {literal(n)})" for n in distinct)


def struct(**fields: str) -> str:
    return "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in fields.items()) + ")"


def keep_where(df: DataFrame, condition: str, *columns: str) -> DataFrame:
    """Rows where ``condition`` holds, with ``columns`` computed once.

    A plain filter on computed columns would be pushed below their projection
    and compute them again; a generator is not passed.
    """
    others = [c for c in df.columns if c not in columns]
    row = "named_struct('keep', true, " + ", ".join(f"'{c}', `{c}`" for c in columns) + ")"
    return (
        df.select(*others, F.expr(f"inline_outer(if({condition}, array({row}), null))"))
        .where("keep")
        .drop("keep")
    )
