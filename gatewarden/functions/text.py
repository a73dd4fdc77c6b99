"""Column helpers for text. All of them stay inside the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The code points with the Unicode White_Space property.
UNICODE_SPACE = (
    "\t\n\x0b\f\r \u0085\u00a0\u1680"
    "\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a"
    "\u2028\u2029\u202f\u205f\u3000"
)


def unicode_trim(text: Column) -> Column:
    """Strip all Unicode white space; ``trim`` alone knows only U+0020."""
    return F.btrim(text, F.lit(UNICODE_SPACE))


def split_lines(text: Column) -> Column:
    """Split on LF, keeping a trailing empty line and any CR."""
    return F.split(text, "\n", -1)


def decode_base64(text: Column) -> Column:
    """Decode padded base64 (CR and LF allowed); null when it is malformed."""
    body = F.regexp_replace(text, "[\r\n]", "")
    valid = body.rlike(r"^[A-Za-z0-9+/]*={0,2}$") & (F.length(body) % 4 == 0)
    return F.when(valid, F.try_to_binary(body, F.lit("base64")).cast("string"))


def path_elements(path: Column) -> Column:
    return F.split(path, "/", -1)


def path_extension(path: Column) -> Column:
    """From the last dot of the last path element; empty when it has none."""
    return F.regexp_extract(F.element_at(path_elements(path), -1), r"(\.[^.]*)$", 1)


def is_workflow_name(name: Column) -> Column:
    """Case-sensitive suffix test for workflow files."""
    return name.endswith(".yml") | name.endswith(".yaml")
