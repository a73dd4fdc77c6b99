"""Scan workflow files for findings.

Every file is one row and all rules of a file are evaluated from that row, so a
scan reads the input once and moves nothing between tasks. Rules that look at
neighbouring lines work on the array of lines; no group of lines is ever built.
Line rules run on the unnested candidate lines, where their tests are part of
the generated code of the stage.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gatewarden.functions import sql
from gatewarden.functions.header import HEADER, with_fields
from gatewarden.functions.sql import literal
from gatewarden.functions.text import UNICODE_SPACE
from gatewarden.operators import rules as R

FILE_KEYS = ("full_name", "repo_ord", "wf_ord", "path")
# Order in which findings are reported.
FINDING_ORDER = ("repo_ord", "wf_ord", "detector_ord", "emit_pos", "rule_ord")
_FINDING = {
    "rule_id": "string",
    "detector_ord": "int",
    "rule_ord": "int",
    "emit_pos": "int",
    "type": "string",
    "severity": "string",
    "line": "int",
    "details": "string",
}
_LINES = "split(content, '\\n', -1)"


def workflow_lines(files: DataFrame) -> DataFrame:
    """Long form: one row per line with its 1-based number."""
    keys = [c for c in FILE_KEYS if c in files.columns]
    # An outer generator, so that no filter repeats the work below it.
    return (
        files.selectExpr(
            *keys, f"posexplode_outer(if(length(content) > 0, {_LINES}, null)) as (pos, line)"
        )
        .where("pos is not null")
        .selectExpr(*keys, "pos + 1 as line_no", "line")
    )


# White space in ASCII, besides the blank, that can end a line.
_ASCII_ENDS = "\t\x0b\f\r"


def _opens_unusually(text: str) -> str:
    """Holds if a text without indent may begin with other white space, and for a few texts more."""
    return f"{text} < '!' or {text} > '~'"


def _trim(text: str) -> str:
    return f"btrim(trim({text}), {literal(UNICODE_SPACE)})"


def _quick_trim(text: str, bare: str) -> str:
    """``_trim`` that looks at the set only where ``trim`` may have left something; ``bare`` names what it left."""
    ends = " or ".join(f"endswith({bare}, {literal(c)})" for c in _ASCII_ENDS)
    return f"if({_opens_unusually(bare)} or {ends} or octet_length({bare}) <> length({bare}), {_trim(text)}, {bare})"


def _finding(rule: R.CatalogEntry, line: str, details: str, emit_pos: str,
             severity: str | None = None) -> str:
    return sql.struct(
        rule_id=literal(rule.rule_id),
        detector_ord=str(rule.detector_ord),
        rule_ord=str(rule.rule_ord),
        emit_pos=emit_pos,
        type=literal(rule.type),
        severity=severity or literal(rule.severity),
        line=line,
        details=details,
    )


def _file_finding(rule_id: str, emit_pos: str = "0") -> str:
    details = literal(R.FILE_DETAILS[rule_id])
    return f"array({_finding(R.ENTRY[rule_id], '0', details, emit_pos)})"


def _around(number: str, before: int, after: int) -> str:
    """Lines from ``before`` above to ``after`` below line ``number`` (1-based)."""
    first = f"greatest({number} - {before}, 1)"
    return f"slice(lines, {first}, {number} + {after} - {first} + 1)"


def _numbers_where(test: str) -> str:
    """Numbers of the lines ``x`` that pass; ``i`` is the 0-based place."""
    return f"filter(transform(lines, (x, i) -> if({test}, i + 1, null)), n -> n is not null)"


# Token lines without permissions nearby; the lines around are looked at only for those.
_TOKEN_NEEDLES = ("${{", "secrets.GITHUB_TOKEN")
_BARE_TOKEN = sql.all_of(
    [f"contains(line, {literal(n)})" for n in _TOKEN_NEEDLES]
    + [
        f"line rlike {literal(R.TOKEN_LINE)}",
        f"not contains(array_join({_around('(pos + 1)', 10, 9)}, '\n'), 'permissions:')",
    ]
)


def _checkouts() -> str:
    """Each checkout line with the first ref found from 5 above to 4 below it."""
    kind = (
        "case when not contains(x, 'github.event.pull_request.') then null "
        f"when x rlike {literal(R.SAFE_REF)} then 'safe' "
        f"when x rlike {literal(R.UNSAFE_REF)} then 'unsafe' end"
    )
    refs = (
        f"transform({_around('n', 5, 4)}, (x, i) -> "
        f"named_struct('no', greatest(n - 5, 1) + i, 'kind', {kind}))"
    )
    checkouts = _numbers_where(
        f"contains(x, 'actions/checkout@') and x rlike {literal(R.CHECKOUT_LINE)}"
    )
    return (
        f"transform({checkouts}, n -> named_struct('no', n, "
        f"'ref', get(filter({refs}, r -> r.kind is not null), 0)))"
    )


def _unsafe_refs() -> str:
    finding = _finding(R.ENTRY["R10"], "c.ref.no", "get(lines, c.ref.no - 1)", "c.no")
    return f"transform(filter(checkouts, c -> c.ref.kind = 'unsafe'), c -> {finding})"


# A checkout exists, the last one that met a ref met no safe one, commands run.
_EXECUTES = (
    "size(checkouts) > 0 and coalesce("
    "try_element_at(filter(checkouts, c -> c.ref is not null), -1).ref.kind, 'none') <> 'safe' "
    "and exists(lines, x -> contains(x, 'run:'))"
)


def _script_hits() -> str:
    """Event data in multi-line scripts.

    The file is written as a string of marks: ``S`` opens a script, ``E`` closes
    it, ``C<n>`` is a suspicious line n. Marks after an ``S`` and before the next
    ``S`` or ``E`` are hits, which needs one pass whatever the size of the file.
    """
    # Nothing looked for begins with a blank, so the lines without their indent tell it all.
    suspicious = sql.all_of(
        ["contains(y, '${{')", "contains(y, 'github.event')"]
        + [f"not contains(y, {literal(e)})" for e in R.SCRIPT_EXCLUDED]
    )

    def opening(bare: str) -> str:
        return (
            f"when startswith({bare}, '-') or startswith({bare}, '#') then 'E' "
            f"when startswith({bare}, 'run:') then if(startswith({bare}, 'run: |') or startswith({bare}, 'run:|'), 'S', 'E')"
        )

    hit = f"when {suspicious} then concat('C', i + 1) end"
    # Only lines that open with an unusual character need the full trim.
    unusual = _opens_unusually("y")
    marks = (
        "array_join(transform(transform(lines, x -> ltrim(x)), (y, i) -> case when y = '' then null "
        f"{opening('y')} when {unusual} then case {opening(_trim('y'))} {hit} {hit}), '')"
    )
    inside = f"array_join(regexp_extract_all({marks}, 'S[^SE]*', 0), '')"
    numbers = f"transform(regexp_extract_all({inside}, 'C([0-9]+)', 1), n -> cast(n as int))"
    finding = _finding(R.ENTRY["R12"], "n", "get(lines, n - 1)", "n")
    return f"transform({numbers}, n -> {finding})"


# What a file holds somewhere if such a rule finds something in it, beside what the header tells.
_FILE_NEEDLES = {
    "R06": (), "R07": (), "R08": (),
    "R09": _TOKEN_NEEDLES,
    "R10": ("actions/checkout@", "github.event.pull_request.head."),
    "R11": ("actions/checkout@", "run:"),
    "R12": ("github.event", "run:"),
}


# Event data comes after a script opens and before a line that ends it. What opens another script ends an
# attempt, as the next one begins there: one pass over a file. The set of blanks is asked only behind plain ones.
_OPENS = r"run: ?\|"
_CLOSES = rf"(?! *+(?:(?=[^!-~])[{UNICODE_SPACE}]*+)?(?:run:|[-#]))".replace("\n", "")
_SCRIPT_WITH_EVENT = (
    rf"(?d){_OPENS}(?:(?!{_OPENS})[^\n])*+(?:\n{_CLOSES}(?![^\n]*?(?:github\.event|{_OPENS}))[^\n]*+)*+"
    rf"\n{_CLOSES}[^\n]*?github\.event"
)


def _needed(line_rules: list[R.LineRule], file_rules: list[str]) -> str | None:
    """Test whether any of the rules can find something in a file at all; none if some rule has no needle."""
    needles = [r.needles for r in line_rules] + [_FILE_NEEDLES[i] for i in file_rules]
    if not all(needles):
        return None
    return sql.any_of(sql.all_of(f"contains(content, {literal(n)})" for n in some) for some in needles)


def scan(
    files: DataFrame,
    rule_ids: Iterable[str] | None = None,
    extra_rules: tuple[R.LineRule, ...] = (),
) -> DataFrame:
    """Findings of all rules, or of those in ``rule_ids``, one row each.

    ``files`` needs ``full_name, repo_ord, wf_ord, path, content``. Empty files and
    files that are no mapping at top level give no findings. Repeated files give
    repeated findings.
    """
    wanted = set(rule_ids) if rule_ids is not None else None

    def on(*ids: str) -> bool:
        return wanted is None or any(i in wanted for i in ids)

    line_rules = [r for r in R.LINE_RULES + tuple(extra_rules) if on(r.entry.rule_id)]
    privileged = (
        f"array_contains({HEADER}triggers, 'pull_request_target') "
        "and contains(content, 'actions/checkout@')"
    )
    checkouts = f"if({privileged}, {_checkouts()}, null)" if on("R10", "R11") else "null"
    fields = [f"{HEADER}{n}" for n in ("parse_ok", "permissions_form", "contents", "triggers")]
    needed = _needed(line_rules, [i for i in _FILE_NEEDLES if on(i)])
    candidates = files.selectExpr(*FILE_KEYS, "content" if needed is None else f"if({needed}, content, null) as content")
    staged = (
        with_fields(candidates.selectExpr("*", f"{_LINES} as lines"), lines="lines")
        .selectExpr(*FILE_KEYS, *fields, "content", "lines", f"{checkouts} as checkouts")
    )

    is_map = f"{HEADER}permissions_form in ('flow map', 'block map')"
    by_file = {
        "R06": (f"{is_map} and {HEADER}contents = 'write'", _file_finding("R06")),
        "R07": (f"{is_map} and {HEADER}contents = 'admin'", _file_finding("R07")),
        "R08": (f"{HEADER}permissions_form = 'absent'", _file_finding("R08")),
        "R10": ("checkouts is not null", _unsafe_refs()),
        "R11": (f"checkouts is not null and {_EXECUTES}", _file_finding("R11", "size(lines) + 1")),
        "R12": (f"content rlike {literal(_SCRIPT_WITH_EVENT)}", _script_hits()),
    }
    parts = [f"if({test}, {hits}, null)" for i, (test, hits) in by_file.items() if on(i)]
    nothing = "cast(array() as array<struct<" + ",".join(f"{k}:{t}" for k, t in _FINDING.items()) + ">>)"
    found = ", ".join([nothing] + [f"coalesce({p}, {nothing})" for p in parts])
    found = f"if({HEADER}parse_ok, concat({found}), null)"
    # The outer generators keep the optimizer from copying whole rule expressions
    # into filters below them.
    tokens = on("R09")
    if not line_rules and not tokens:
        alone = staged.selectExpr(*FILE_KEYS, f"explode_outer({found}) as finding")
        return alone.where("finding is not null").select(*FILE_KEYS, "finding.*")
    lines = (
        staged.selectExpr(*FILE_KEYS, f"if({HEADER}parse_ok, lines, null) as lines", f"{found} as found")
        .selectExpr(*FILE_KEYS, "lines", "found", "posexplode_outer(lines) as (pos, line)")
    )
    return _test_lines(lines, line_rules, tokens)


def _test_lines(lines: DataFrame, line_rules: list[R.LineRule], tokens: bool) -> DataFrame:
    """Findings of the line rules and of token lines, and those of the file with its first line."""
    first_needles = [r.needles[0] if r.needles else "" for r in line_rules] + list(_TOKEN_NEEDLES[:1]) * tokens
    trim_needles = [r.needles[0] if r.needles else "" for r in line_rules if r.trimmed]
    lower_needles = [r.needles[0] if r.needles else "" for r in line_rules if r.in_any_case]
    severities = {
        f"severity_{i}": f"if({r.matches('line', 'trimmed', 'lowered')}, {r.severity('line', 'trimmed')}, null)"
        for i, r in enumerate(line_rules)
    }
    number = "pos + 1"
    options = [
        f"if({name} is not null, "
        f"{_finding(r.entry, number, r.shown('line', 'trimmed'), number, name)}, null)"
        for name, r in zip(severities, line_rules)
    ]
    tests = [f"{s} as {n}" for n, s in severities.items()]
    if tokens:
        tests.append(f"{_BARE_TOKEN} as bare_token")
        options.append(f"if(bare_token, {_finding(R.ENTRY['R09'], number, 'line', number)}, null)")
    on_line = f"array({', '.join(options)})"
    return (
        lines.where(sql.any_of([sql.contains_any("line", first_needles), "pos = 0"]))
        .selectExpr(
            *FILE_KEYS, "lines", "found", "pos", "line",
            f"if({sql.contains_any('line', trim_needles)}, trim(line), null) as bare",
            f"if({sql.contains_any('line', lower_needles)}, lower(line), null) as lowered",
        )
        .selectExpr("* except (bare)", f"if(bare is null, null, {_quick_trim('line', 'bare')}) as trimmed")
        .selectExpr("*", *tests)
        .selectExpr(
            *FILE_KEYS,
            f"explode_outer(if(pos = 0 and size(found) > 0, concat(found, {on_line}), {on_line}))"
            " as finding",
        )
        .where("finding is not null")
        .select(*FILE_KEYS, "finding.*")
    )


def with_catalog(findings: DataFrame, extra_rules: tuple[R.LineRule, ...] = ()) -> DataFrame:
    """Add the texts of the rule; the catalogue has a fixed number of rows.

    Own rules have to be named here too. A finding of an unknown rule is an error,
    because an output without it would look complete.
    """
    texts = R.catalog_frame(findings.sparkSession, extra_rules).select(
        "rule_id", "description", "impact", "exploit", "mitigation", "refs", F.lit(True).alias("_known")
    )
    joined = findings.join(F.broadcast(texts), "rule_id", "left")
    unknown = F.raise_error(F.concat(F.lit("no texts for rule "), "rule_id"))
    description = F.when(F.col("_known"), F.col("description")).otherwise(unknown)
    return joined.withColumn("description", description).drop("_known")
