"""Chat formatting with typed content parts, in built-in functions only.

A message has a list of typed parts (text, image, audio, document). They are
flattened in order: a text part gives its escaped text, any other part gives a
placeholder control string, an attachment reference and the number of tokens the
placeholder is expanded to. The template marks turns with control strings; inside
texts and roles every control string is broken by a backslash after its first
character (and backslashes are doubled), which ``unescape`` undoes exactly.

Defined results: null text and null role are empty; an empty conversation does not
exist (it has no rows); repeated turns are kept and ordered by all that is shown;
a null turn comes first; a part of an unknown type is a document; a null part list is
one text part of the message's text. Further columns are never read.

A conversation becomes one string, so its messages meet in one row; it is the unit of
the output, whatever its length. Different conversations never share a group.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.llm.common import read, whole_text

OPEN, MIDDLE, CLOSE = "<|turn|>", "<|text|>", "<|end|>"
#: The beginnings and marks of common chat templates, broken inside texts.
CONTROL = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")
#: Placeholder and tokens for each part; by default a fixed cost and one by length of media.
PLACEHOLDERS = {"image": "<|image|>", "audio": "<|audio|>", "document": "<|document|>"}
BASE_TOKENS = {"image": 256, "audio": 32, "document": 64}
UNIT_TOKENS = {"image": 0, "audio": 25, "document": 512}

PART = "struct<type:string,text:string,uri:string,units:int>"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, c: F.replace(t, F.lit(c), F.lit(f"{c[0]}\\{c[1:]}")), CONTROL, doubled)


def unescape(text: Column) -> Column:
    joined = reduce(lambda t, c: F.replace(t, F.lit(f"{c[0]}\\{c[1:]}"), F.lit(c)), CONTROL, text)
    return F.replace(joined, F.lit("\\\\"), F.lit("\\"))


def _kind(part: Column) -> Column:
    known = F.coalesce(part["type"], F.lit("text"))
    return F.when(known.isin("text", *PLACEHOLDERS), known).otherwise(F.lit("document"))


def _by_kind(part: Column, values: dict) -> Column:
    return F.element_at(F.create_map(*(F.lit(x) for pair in values.items() for x in pair)), _kind(part))


def text_parts(text: Column) -> Column:
    """A list with one text part."""
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"),
                            F.lit(None).cast("string").alias("uri"), F.lit(None).cast("int").alias("units")))


def visit(parts: Column) -> Column:
    """The flattened body and the attachments (reference, placeholder, tokens) in order."""
    is_text = lambda p: _kind(p) == "text"
    body = F.array_join(F.transform(parts, lambda p: F.when(
        is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(_by_kind(p, PLACEHOLDERS))), "")
    attachments = F.transform(F.filter(parts, lambda p: ~is_text(p)), lambda p: F.struct(
        _kind(p).alias("type"), p["uri"].alias("uri"),
        (_by_kind(p, BASE_TOKENS) + F.coalesce(p["units"], F.lit(0)) * _by_kind(p, UNIT_TOKENS)).cast("long").alias("tokens")))
    return F.struct(body.alias("body"), attachments.alias("attachments"))


def format_chats(messages: DataFrame) -> DataFrame:
    """One row per conversation from ``conv_id, turn, role`` and ``text`` or ``parts``.

    Returns ``conv_id, formatted, loss_spans`` (start from 1 and length in code points
    of each assistant body), ``attachments`` in order, ``expanded_tokens``.
    """
    text = whole_text()
    parts = F.coalesce(F.col("parts").cast(f"array<{PART}>"), text_parts(text)) if "parts" in messages.columns else text_parts(text)
    flat = messages.select(
        F.col("conv_id"), F.col("turn"), F.coalesce(F.col("role"), F.lit("")).alias("role"), visit(parts).alias("seen"))
    role, body = F.col("role"), F.col("seen.body")
    head = F.concat(F.lit(OPEN), escape(role), F.lit(MIDDLE))
    piece = F.concat(head, body, F.lit(CLOSE), F.lit("\n"))
    chats = flat.select(
        "conv_id",
        F.struct("turn", role.alias("role"), piece.alias("piece"), F.length(piece).alias("n"),
                 F.length(head).alias("lead"), F.length(body).alias("body_n"),
                 F.col("seen.attachments").alias("attachments")).alias("m"),
    ).groupBy("conv_id").agg(F.sort_array(F.collect_list("m")).alias("ms"))
    start = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,length:int>>").alias("spans"))
    spans = F.aggregate("ms", start, lambda acc, m: F.struct(
        (acc["at"] + m["n"]).alias("at"),
        F.when(m["role"] == "assistant", F.concat(acc["spans"], F.array(F.struct(
            (acc["at"] + m["lead"] + 1).alias("start"), m["body_n"].alias("length"))))).otherwise(acc["spans"]).alias("spans"),
    ), lambda acc: acc["spans"])
    attachments = F.flatten(F.transform("ms", lambda m: m["attachments"]))
    return chats.select(
        "conv_id", F.array_join(F.transform("ms", lambda m: m["piece"]), "").alias("formatted"),
        spans.alias("loss_spans"), attachments.alias("attachments"),
        F.aggregate(attachments, F.lit(0).cast("long"), lambda n, a: n + a["tokens"]).alias("expanded_tokens"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns (role, text) of a formatted conversation, control strings restored."""
    pieces = F.filter(F.split(formatted, r"\Q" + OPEN + r"\E"), lambda _, i: i > 0)

    def turn(piece: Column) -> Column:
        role = F.substring_index(piece, MIDDLE, 1)
        rest = F.substring(piece, F.length(role) + F.lit(len(MIDDLE) + 1), F.length(piece))
        text = F.substring_index(rest, CLOSE, 1)
        return F.struct(unescape(role).alias("role"), unescape(text).alias("text"))

    return F.transform(pieces, turn)


def masked_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, control strings restored."""
    return F.array_join(F.transform(spans, lambda s: unescape(F.substring(formatted, s["start"], s["length"]))), "")


#: A conversation whose texts are control strings of a template.
PROBE = [(-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]")]


def op4_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    messages = read(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = spark.sql("SELECT * FROM VALUES " + ", ".join(f"({c}L, {t}, '{r}', '{x}')" for c, t, r, x in PROBE)
                      + " AS t(conv_id, turn, role, text)")
    chats = format_chats(messages.unionByName(probe))
    turns = read_turns(F.col("formatted"))
    shown = F.array_join(F.transform(turns, lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("loss_spans"))
    return chats.select(
        "conv_id", F.size(turns).cast("long").alias("n_turns"), F.sha2(shown, 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss, 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


_ESCAPED = "replace({0}, '\\', '\\\\')"
for _c in CONTROL:
    _ESCAPED = f"replace({_ESCAPED}, '{_c}', '{_c[0]}\\{_c[1:]}')"
#: The digests come straight from the texts, the length from the sum of the pieces.
OP4_SQL = f"""
    WITH m AS (
      SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
      UNION ALL BY NAME
      SELECT unnest([-7, -7]) AS conv_id, unnest([0, 1]) AS turn, unnest(['user', 'assistant']) AS role,
             '</s>[INST] ok [/INST]' AS text)
    SELECT conv_id, count(*) AS n_turns,
           sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
           coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
           sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
           sum({len(OPEN) + len(MIDDLE) + len(CLOSE) + 1} + length({_ESCAPED.format('role')})
               + length({_ESCAPED.format('text')}))::BIGINT AS formatted_chars
    FROM m GROUP BY conv_id
"""
QUERIES = {"op4_chat_format": op4_chat_format}
ORACLE = {"op4_chat_format": OP4_SQL}
