"""Conversation repair on an automaton of role and fault signatures that shares suffixes.

A row is a symbol: ``x`` if it must go (blank, or its role and text were seen before), else
its role (s, u, a, or o for others), as a capital if the text is cut off. The symbols of a conversation
are its signature. All distinct signatures are sorted from their ends, so that equal
suffixes follow each other; the automaton has one node for each suffix of any signature,
and a path of nodes is kept while its neighbours share it. A node is made
once: for each state of the grammar ``(s?(ua)+)?`` it gets the cost to go and the first edit
of the cheapest rest, the ASCII-least one (edits that differ in cost by nothing differ
in their first letter, so the least first letter gives the least audit). The audit
of a signature is read off its path.

Rows are put in ranges of (conversation, turn, role, text), so a conversation may spread
over tasks: each writes its piece of the signature, a byte a row, and the pieces are put
together. Texts are only gathered where a digest over a whole repaired conversation needs
them in order, and stream through.

Defined results: a null role or text is one space; null turns come first, a null
conversation is one of its own. Rows of equal turn are ordered by role and text; equal rows
are next to each other. A conversation without rows has no edits. Blank rows are blank whatever came before; a
duplicate is one of an earlier row of any kind. An empty table gives an empty one. Further columns are never read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.llm.common import broadcast_if_bounded, read
from gatewarden.session import cut_lineage

REROLE, DELETE, INSERT, CUT_OFF = 3, 4, 3, 3
#: States of the grammar: at the start, after s, after u, after a.
START, SYSTEM, USER, ASSISTANT = range(4)
NEVER = 1 << 60
#: Characters of a text and of a signature by which ranges are cut (rows are sorted by all of it).
RANGE_CHARS, RANGE_SYMBOLS = 64, 200
#: Rows of a conversation table for a task.
TASK_ROWS = 200_000
NOT_BLANK = r"[^\x20\x09-\x0D]"
CLOSED = r"[.!?][\x20\x09-\x0D]*\z"


# --- the automaton

def _after(state: int) -> int:
    """The state after a user or assistant row, whichever the grammar wants."""
    return ASSISTANT if state == USER else USER


def _kept(state: int, role: str) -> int | None:
    """The state after a row of this role as it is, if the grammar allows it."""
    if role == "s":
        return SYSTEM if state == START else None
    return _after(state) if role == ("a" if state == USER else "u") else None


Node = tuple[tuple[int, ...], tuple[str, ...]]


def _with_inserts(cost: list[int], edit: list[str]) -> Node:
    """An insert leads to another state of the same node; after a user row first, which the others may want."""
    for state in (USER, START, SYSTEM, ASSISTANT):
        there = INSERT + cost[_after(state)]
        if (there, "I") < (cost[state], edit[state]):
            cost[state], edit[state] = there, "I"
    return tuple(cost), tuple(edit)


#: The empty rest: nothing is left to do at the start and after an assistant row.
END = _with_inserts([0, NEVER, NEVER, 0], ["", "~", "~", ""])


def node(symbol: str, rest: Node) -> Node:
    """Costs to go and first edits of a row and the rest behind it, by state."""
    ahead, cost, edit = rest[0], [], []
    role, extra = symbol.lower(), CUT_OFF * symbol.isupper()
    for state in range(4):
        options = [(DELETE + ahead[state], "D")]
        if role != "x":
            to = _kept(state, role)
            if to is not None:
                options.append((extra + ahead[to], "K"))
            options.append((extra + REROLE + ahead[_after(state)], "R"))
        best = min(options)
        cost.append(best[0])
        edit.append(best[1])
    return _with_inserts(cost, edit)


class SuffixAutomaton:
    """Nodes for the suffixes of signatures that come sorted from their ends."""

    def __init__(self) -> None:
        self.symbols: list[str] = []  # from the end
        self.path: list[Node] = [END]
        self.made = 0

    def repair(self, backward: str) -> tuple[int, str]:
        """Cost and audit of a signature, given backward."""
        shared, most = 0, min(len(backward), len(self.symbols))
        while shared < most and backward[shared] == self.symbols[shared]:
            shared += 1
        del self.symbols[shared:], self.path[shared + 1 :]
        for symbol in backward[shared:]:
            self.path.append(node(symbol, self.path[-1]))
            self.symbols.append(symbol)
            self.made += 1
        return self.path[-1][0][START], self.audit()

    def audit(self) -> str:
        edits, state, at = [], START, len(self.symbols)
        while (edit := self.path[at][1][state]):
            edits.append(edit)
            if edit == "I":
                state = _after(state)
                continue
            at -= 1
            if edit == "K":
                state = _kept(state, self.symbols[at].lower())
            elif edit == "R":
                state = _after(state)
        return "".join(edits)


def apply_edits(rows: Iterator[tuple[str, str]], audit: str) -> Iterator[tuple[str, str, str]]:
    """The repaired ``edit, role, text`` of rows in order; rows are taken one by one."""
    state, rows = START, iter(rows)
    for edit in audit:
        if edit == "I":
            yield edit, "assistant" if state == USER else "user", ""
            state = _after(state)
            continue
        role, text = next(rows)
        if edit == "R":
            yield edit, "assistant" if state == USER else "user", text
            state = _after(state)
        elif edit == "K":
            yield edit, role, text
            state = _kept(state, role[:1])


# --- on tables

def damage(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies``: rows dropped (no copies), emptied, stripped, repeated or of another role."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    fate = F.crc32(F.concat(shown("conv_id"), F.lit(":"), shown("turn")).cast("binary")) % 20
    rows = messages.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")), shown("role").alias("role"), shown("text").alias("text"), fate.alias("fate"))
    text = F.when(F.col("fate") == 1, "").when(F.col("fate") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("fate") == 0, 0).when(F.col("fate") == 3, 2).otherwise(1)
    return rows.select(
        "conv_id", "turn", F.when(F.col("fate") == 4, "user").otherwise(F.col("role")).alias("role"),
        text.alias("text"), copies.cast("long").alias("copies"))


def undamaged(messages: DataFrame) -> DataFrame:
    """``conv_id, turn, role, text, copies`` of messages as they are."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" ")).alias(c)
    return messages.select(*(F.col(c).cast("long").alias(c) for c in ("conv_id", "turn")), shown("role"), shown("text"),
                           F.lit(1).cast("long").alias("copies"))


def with_symbols(rows: DataFrame) -> DataFrame:
    """Equal rows as one, with ``copies, symbol`` (of the first copy), written to the shared folder.

    Copies meet after they were counted where they lie, so a row that is a third of all
    is not gathered. First places of repeated texts are found by digest, without texts.
    """
    rows = cut_lineage(rows.groupBy("conv_id", "turn", "role", "text").agg(F.sum("copies").alias("copies")).withColumn(
        "digest", F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), "role", "text"), 256)))
    seen = rows.where("copies > 0").groupBy("conv_id", "digest").agg(
        F.min(F.struct("turn")).alias("first"), F.count("*").alias("turns")).where("turns > 1")
    seen = broadcast_if_bounded(seen.select(F.col("conv_id").alias("c"), F.col("digest").alias("d"), F.col("first.turn").alias("first")))
    later = F.col("d").isNotNull() & ~F.col("turn").eqNullSafe(F.col("first"))
    initial = F.substring("role", 1, 1)
    role = F.when(initial.isin("s", "u", "a"), initial).otherwise("o")
    blank = ~F.col("text").rlike(NOT_BLANK)
    symbol = F.when(blank, "b").when(later, "d").when(F.col("text").rlike(CLOSED), role).otherwise(F.upper(role))
    joined = rows.join(seen, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return cut_lineage(joined.select("conv_id", "turn", "role", "text", "copies", symbol.alias("symbol"), role.alias("initial")))


def _ranges(rows: DataFrame, keys: list[str], by: list[Column], order: list[str]) -> DataFrame:
    count = rows.count()
    return rows.repartitionByRange(max(1, -(-count // TASK_ROWS)), *keys, *by).sortWithinPartitions(*order)


ORDER = ["conv_id", "turn", "role", "text"]
PIECE = "conv_id long, task int, symbols string, initials string"


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The symbols and initials of each conversation as far as it lies in this task."""
    task, ids, symbols, initials = TaskContext.get().partitionId(), [], [], []

    def take() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays(
            [pa.array(ids, pa.int64()), pa.array([task] * len(ids), pa.int32()), pa.array(["".join(s) for s in symbols], pa.string()),
             pa.array(["".join(s) for s in initials], pa.string())], names=["conv_id", "task", "symbols", "initials"])
        for held in (ids, symbols, initials):
            held.clear()
        return out

    for batch in batches:
        for conv, copies, symbol, initial in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "copies", "symbol", "initial")), strict=True):
            if not ids or ids[-1] != conv:
                if len(ids) >= 10_000:
                    yield take()
                ids.append(conv)
                symbols.append([])
                initials.append([])
            if copies:
                again = "d" if symbol != "b" else "b"
                symbols[-1].append(symbol + again * (copies - 1))
                initials[-1].append(initial * copies)
    if ids:
        yield take()


def signatures(rows: DataFrame) -> DataFrame:
    """``conv_id, signature, blank, duplicate, truncated, illegal`` of each conversation; two kinds of must-go are one symbol."""
    ranged = _ranges(rows.select("conv_id", "turn", "role", "text", "copies", "symbol", "initial"), ["conv_id", "turn", "role"],
                     [F.substring("text", 1, RANGE_CHARS)], ORDER)
    pieces = ranged.select("conv_id", "copies", "symbol", "initial").mapInArrow(_pieces, PIECE)
    joined = lambda c: F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("task", c))), lambda p: p[c]), "")
    whole = pieces.groupBy("conv_id").agg(joined("symbols").alias("symbols"), joined("initials").alias("initials"))
    count = lambda c, pattern: F.regexp_count(F.col(c), F.lit(pattern)).cast("long")
    # a pair is legal if it is one of three; looking ahead lets pairs overlap
    return whole.select(
        "conv_id", F.translate("symbols", "bd", "xx").alias("signature"),
        count("symbols", "b").alias("blank"), count("symbols", "d").alias("duplicate"), count("symbols", "[SUAO]").alias("truncated"),
        count("initials", "(?s).(?=.)(?!(?<=s)u|(?<=u)a|(?<=a)u)").alias("illegal"))


def _repairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = SuffixAutomaton()
    for batch in batches:
        if batch.num_rows:
            costs, audits = zip(*map(automaton.repair, batch.column(0).to_pylist()), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(costs, pa.int64()), pa.array(audits, pa.string())],
                                             names=["backward", "cost", "audit"])


def audits(signatures: DataFrame) -> DataFrame:
    """``backward, cost, audit`` of each distinct signature (given from its end), each suffix worked on once a range."""
    distinct = cut_lineage(signatures.select(F.reverse("signature").alias("backward")).distinct())
    ranged = _ranges(distinct, [], [F.substring("backward", 1, RANGE_SYMBOLS)], ["backward"])
    return cut_lineage(ranged.mapInArrow(_repairs, "backward string, cost long, audit string"))


def plan(rows: DataFrame) -> DataFrame:
    """``conv_id`` with counts of faults, ``cost`` and ``audit``, from rows with symbols; written to the shared folder."""
    known = cut_lineage(signatures(rows).withColumn("backward", F.reverse("signature")))
    best = broadcast_if_bounded(audits(known), ("backward", "audit"))
    return cut_lineage(known.join(best, "backward").drop("backward", "signature"))


REPAIRED = "conv_id long, place long, edit string, role string, text string"


def _streams(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int | None, str | None, Iterator[tuple[str, str]]]]:
    """Conversations in order: id, audit, and their rows, which have to be taken one after the other."""
    flat = (row for batch in batches for row in zip(*(c.to_pylist() for c in batch.columns), strict=True))
    row = next(flat, None)

    def rows_of() -> Iterator[tuple[str, str]]:
        nonlocal row
        while row is not None and row[1] is None:
            _, _, role, text, copies = row
            for _ in range(copies):
                yield role, text
            row = next(flat, None)

    while row is not None:
        conv, audit = row[0], row[1]
        row = next(flat, None)
        rows = rows_of()
        yield conv, audit, rows
        for _ in rows:  # rows behind the last edit: none
            pass


def _with_audits(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """Rows of whole conversations in order in one task, the audit of each as its first row."""
    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast(rows.schema["turn"].dataType).alias("turn"),
                         "audit", F.lit("").alias("role"), F.lit("").alias("text"), F.lit(0).cast("long").alias("copies"))
    body = rows.where("copies > 0").select("conv_id", F.lit(1).alias("kind"), "turn", F.lit(None).cast("string").alias("audit"), "role", "text", "copies")
    ranged = _ranges(heads.unionByName(body), ["conv_id"], [], ["conv_id", "kind", "turn", "role", "text"])
    return ranged.select("conv_id", "audit", "role", "text", "copies")


def repair(rows: DataFrame, plans: DataFrame) -> DataFrame:
    """The repaired rows ``conv_id, place, edit, role, text`` (rows with symbols, and their ``plan``)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        size = 0

        def take() -> pa.RecordBatch:
            kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string())
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*held, strict=True), kinds, strict=True)],
                                              names=["conv_id", "place", "edit", "role", "text"])

        for conv, audit, messages in _streams(batches):
            for place, (edit, role, text) in enumerate(apply_edits(messages, audit)):
                held.append((conv, place, edit, role, text))
                size += len(text) + 64
                if size > 1_000_000:
                    yield take()
                    held, size = [], 0
        if held:
            yield take()

    return _with_audits(rows, plans).mapInArrow(run, REPAIRED)


def _digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """``conv_id, repaired_sha256`` of rows that come by conversation and place."""
    ids, digests, digest = [], [], None
    for batch in batches:
        for conv, place, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "place", "role", "text")), strict=True):
            if place == 0:
                if digest:
                    digests.append(digest.hexdigest())
                ids.append(conv)
                digest = hashlib.sha256()
            else:
                digest.update(b"\n")
            digest.update(f"{role}:{text}".encode())
    if digest:
        digests.append(digest.hexdigest())
    yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(digests, pa.string())], names=["conv_id", "repaired_sha256"])


def op13_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repaired_conversations(damage(read(spark, sf_dir, "conversations")))


def repaired_conversations(rows: DataFrame) -> DataFrame:
    """A row for each conversation of ``conv_id, turn, role, text, copies``: faults, cost, audit and digest."""
    rows = with_symbols(rows)
    plans = plan(rows)
    digests = repair(rows, plans).mapInArrow(_digests, "conv_id long, repaired_sha256 string")
    turn = F.when(F.col("copies") > 0, F.col("turn"))
    gaps = rows.groupBy("conv_id").agg(
        F.coalesce(F.max(turn) - F.min(turn) + 1 - F.count_distinct(turn), F.lit(0)).cast("long").alias("gaps"))
    by = lambda t, p: t.withColumnRenamed("conv_id", p)
    out = plans.join(by(gaps, "g"), F.col("conv_id").eqNullSafe(F.col("g")), "left").join(
        by(digests, "d"), F.col("conv_id").eqNullSafe(F.col("d")), "left")
    return out.select("conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit",
                      F.coalesce("repaired_sha256", F.sha2(F.lit("").cast("binary"), 256)).alias("repaired_sha256"))


QUERIES = {"op13_repair": op13_repair}


def _sql() -> str:
    """Damage, faults and the cheapest edits in DuckDB: rows from the last to the first, with whole texts for each state."""
    best = lambda *options: f"list_sort([{', '.join(options)}])[1]"

    def option(letter: str, cost: str, rest: str, line: str | None = None) -> str:
        out = f"{rest}.out" if line is None else f"list_prepend({line}, {rest}.out)"
        return f"{{'cost': {rest}.cost + {cost}, 'audit': '{letter}' || {rest}.audit, 'out': {out}}}"

    def row(state: str, keeps: list[tuple[str, str]], to: str, role: str) -> str:
        kept = [option("K", f"r.extra + CASE WHEN r.initial = '{i}' AND NOT r.gone THEN 0 ELSE {NEVER >> 8} END", f"p.{q}", "r.line") for i, q in keeps]
        again = option("R", f"{REROLE} + r.extra + CASE WHEN r.gone THEN {NEVER >> 8} ELSE 0 END", f"p.{to}", f"'{role}:' || r.text")
        return f"{best(option('D', str(DELETE), f'p.{state}'), *kept, again)} AS {state}"

    rows = ", ".join([
        row("start", [("s", "sys"), ("u", "usr")], "usr", "user"), row("sys", [("u", "usr")], "usr", "user"),
        row("usr", [("a", "ast")], "ast", "assistant"), row("ast", [("u", "usr")], "usr", "user")])
    insert = lambda state, to, role: best(state, option("I", str(INSERT), to, f"'{role}:'"))
    end = lambda cost, audit, out: f"{{'cost': {cost}::BIGINT, 'audit': '{audit}', 'out': {out}::VARCHAR[]}}"
    white = r"\x20\x09-\x0D"
    return f"""
    WITH RECURSIVE bytes AS (
      SELECT list(list_reduce(list_prepend(b, range(8)), lambda v, i: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END)
                  ORDER BY b) AS entries FROM range(256) r(b)),
    keyed AS (
      SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
             coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key FROM conversations),
    fates AS (
      SELECT keyed.*, xor(list_reduce(list_prepend(4294967295, list_transform(string_split(key, ''), lambda c: ascii(c)::BIGINT)),
                                      lambda v, c: xor(v >> 8, entries[(xor(v, c) & 255) + 1])), 4294967295) % 20 AS fate
      FROM keyed, bytes),
    damaged AS (
      SELECT conv_id, turn, CASE fate WHEN 4 THEN 'user' ELSE role END AS role,
             CASE fate WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
      FROM fates, range(2) c(copy) WHERE fate <> 0 AND (copy = 0 OR fate = 3)),
    placed AS (
      SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS k,
             count(*) OVER (PARTITION BY conv_id) AS n FROM damaged),
    known AS (
      SELECT *, left(role, 1) AS initial, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY k) > 1 AS again,
             lead(left(role, 1)) OVER (PARTITION BY conv_id ORDER BY k) AS follower FROM placed),
    judged AS (
      SELECT *, CASE WHEN NOT regexp_matches(text, '[^{white}]') THEN 'blank' WHEN again THEN 'duplicate'
                     WHEN NOT regexp_matches(text, '[.!?][{white}]*$') THEN 'truncated' ELSE '' END AS fault FROM known),
    r AS (
      SELECT conv_id, k, n, initial, text, role || ':' || text AS line, fault IN ('blank', 'duplicate') AS gone,
             CASE fault WHEN 'truncated' THEN {CUT_OFF} ELSE 0 END AS extra FROM judged),
    steps AS (
      SELECT conv_id, n + 1 AS k, {end(0, '', '[]')} AS start, {end(2 * INSERT, 'II', "['user:', 'assistant:']")} AS sys,
             {end(INSERT, 'I', "['assistant:']")} AS usr, {end(0, '', '[]')} AS ast FROM r WHERE k = n
      UNION ALL
      SELECT conv_id, k, {insert('start', 'usr', 'user')} AS start, {insert('sys', 'usr', 'user')} AS sys, usr,
             {insert('ast', 'usr', 'user')} AS ast
      FROM (SELECT conv_id, k, start, sys, {insert('usr', 'ast', 'assistant')} AS usr, ast
            FROM (SELECT r.conv_id, r.k, {rows} FROM steps p JOIN r ON r.conv_id IS NOT DISTINCT FROM p.conv_id AND r.k = p.k - 1))),
    counted AS (
      SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0)::BIGINT AS gaps,
             count(*) FILTER (fault = 'blank') AS blank, count(*) FILTER (fault = 'duplicate') AS duplicate,
             count(*) FILTER (fault = 'truncated') AS truncated,
             count(*) FILTER (follower IS NOT NULL AND initial || follower NOT IN ('su', 'ua', 'au')) AS illegal
      FROM judged GROUP BY conv_id)
    SELECT c.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate,
           coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, coalesce(start.cost, 0) AS cost,
           coalesce(start.audit, '') AS audit, sha256(coalesce(array_to_string(start.out, chr(10)), '')) AS repaired_sha256
    FROM (SELECT DISTINCT conv_id FROM conversations) c
    LEFT JOIN counted ON counted.conv_id IS NOT DISTINCT FROM c.conv_id
    LEFT JOIN steps ON steps.conv_id IS NOT DISTINCT FROM c.conv_id AND steps.k = 1
    """


ORACLE = {"op13_repair": _sql()}
