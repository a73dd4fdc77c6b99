"""Building blocks (common table expressions) of the DuckDB check queries.

The checks are written in another form than the Spark code: documents are taken
apart into one row per line, and context is found with window functions and range
joins. Patterns are in their original RE2 form.
"""

from __future__ import annotations

import re

from gatewarden import corpus
from gatewarden.functions.text import UNICODE_SPACE
from gatewarden.operators import rules
from gatewarden.operators.languages import EXTENSION_LANGUAGE


def quote(text: str | None) -> str:
    if text is None:
        return "NULL"
    parts = []
    for i, line in enumerate(text.split("\n")):
        if i:
            parts.append("chr(10)")
        if line:
            parts.append("'" + line.replace("'", "''") + "'")
    return "(" + " || ".join(parts or ["''"]) + ")"


def array(values) -> str:
    return "[" + ", ".join(quote(v) for v in values) + "]"


def pick(values, number: str) -> str:
    return f"{array(values)}[({number}) + 1]"


def repo_name(repo: str) -> str:
    return f"'org' || (({repo}) % 7) || '/repo' || ({repo})"


SPACES = "(" + " || ".join(f"chr({ord(c)})" for c in UNICODE_SPACE) + ")"


def trim(text: str) -> str:
    return f"trim({text}, {SPACES})"


def content(fid: str, body: str) -> str:
    on = (
        f"CASE WHEN {fid} % 8 = 3 AND ({fid} // 64) % 2 = 1 "
        f"THEN {quote(corpus.TRIGGERS_AT_COLUMN_0)} ELSE {pick(corpus.TRIGGERS, f'{fid} % 8')} END"
    )
    text = (
        f"concat_ws(chr(10), 'name: wf' || {fid}, {on}, "
        f"{pick(corpus.PERMISSIONS, f'({fid} // 8) % 8')}, "
        f"CASE WHEN {fid} % 31 = 13 THEN {quote('permissions: read-all' + chr(10) + 'permissions: read-all')} END, "
        f"{quote('jobs:' + chr(10) + '  build:' + chr(10) + '    steps:')}, "
        f"CASE WHEN {fid} % 29 = 11 THEN chr(9) || 'bad: tab' END, "
        f"{body}, CASE WHEN {fid} % 17 = 7 THEN '' END)"
    )
    odd, form = f"{fid} % 53 = 29", f"({fid} // 53) % 8"
    text = (
        f"concat(CASE WHEN {odd} THEN {pick(corpus.BEFORE, form)} END, {text}, "
        f"CASE WHEN {odd} THEN {pick(corpus.AFTER, form)} END)"
    )
    return (
        f"CASE WHEN {fid} % 37 = 17 THEN '' "
        f"WHEN {fid} % 41 = 19 THEN '# nothing here' "
        f"WHEN {odd} AND {form} = 3 THEN {pick(corpus.FLOW_DOCUMENTS, f'({fid} // 424) % {len(corpus.FLOW_DOCUMENTS)}')} "
        f"WHEN {fid} % 43 = 23 THEN '- item' || chr(10) || '- other' "
        f"WHEN {fid} % 11 = 3 THEN replace({text}, chr(10), chr(13) || chr(10)) "
        f"ELSE {text} END"
    )


def _step(values) -> str:
    return pick(
        values,
        "(o_custkey * 7 + o_orderkey * 5 + i * i * 2 + i * (o_custkey % 13 + 1)) % 27",
    )


_SHIFTED = []
for _s in corpus.STEP_LINES:
    _body = _s.lstrip(" ")
    _SHIFTED.append(_s[: len(_s) - len(_body)] + (chr(160) if _body else "") + _body)

_STEPS = (
    "array_to_string(list_transform(range(0, o_custkey % 45 + 4), lambda i: "
    f"CASE WHEN o_orderkey % 13 = 5 THEN {_step(_SHIFTED)} ELSE {_step(corpus.STEP_LINES)} END), chr(10))"
)
_SCRIPT = (
    "'      - name: note' || chr(10) || '        run: |' || chr(10) || '          ' || "
    "replace(text, chr(10), chr(10) || '          ') || "
    "CASE WHEN doc_id % 3 = 0 THEN chr(10) || '          echo ${{ github.event.issue.title }}' ELSE '' END"
)

_TREE_CHOICE = (
    "CASE WHEN r % 5 = 0 THEN 5 WHEN r % 5 = 1 THEN 20 "
    "WHEN r % 5 = 2 THEN p % 2 * 6 + n % 2 * 8 ELSE p % 23 END"
)

W = r"[\t\n\f\r ]"
O = r"\$\{\{" + W + "*"  # noqa: E741
P_RUN = (
    r"run:.*" + O + r"github\.event\.(issue|pull_request|comment|discussion|review|head_ref"
    r"|inputs|client_payload)\..*" + W + r"*\}\}"
)
P_RUN_HIGH = r"run:.*" + O + r"github\.event\.(inputs|client_payload)\..*" + W + r"*\}\}"
P_NO_VERSION = r"uses:" + W + r"+[^@]+$"
P_BRANCH = r"uses:" + W + r"+[^@]+@" + W + r"*(main|master|develop|dev)"
P_HASH = r"uses:" + W + r"+[^@]+@[0-9a-f]{40}"
P_PRINT = r"(?i)(echo|print|console\.log|printf|cat).*" + O + r"secrets\."
P_ENV = r"env:.*" + O + r"secrets\..*" + W + r"*\}\}"
P_TOKEN = r"token:" + W + "*" + O + r"secrets\.GITHUB_TOKEN" + W + r"*\}\}"
P_CHECKOUT = r"uses:" + W + r"+actions/checkout@"
P_SAFE = r"ref:" + W + "*" + O + r"github\.event\.pull_request\.base\.sha" + W + r"*\}\}"
P_UNSAFE = r"ref:" + W + "*" + O + r"github\.event\.pull_request\.head\."
QUOTED = "(contains(line, '\"${{') OR contains(line, '''${{'))"
_KEY = r"^(?:([^\s#,\[\]{}&*!|>'\"%@`?:-](?:[^:]|:[^ \t])*?)|\"([^\"]*)\"|'([^']*)')[ \t]*:(?:[ \t]|$)"
_KEY_SQL = _KEY.replace('\\"', '"').replace("'", "''")


def has(text: str, pattern: str) -> str:
    return f"regexp_matches({text}, '{pattern}')"


def _without_inner(text: str, levels: int = 12) -> str:
    """The text of a collection without the collections in it, the innermost first."""
    for _ in range(levels):
        text = f"regexp_replace({text}, '\\[[^][{{}}]*\\]|\\{{[^][{{}}]*\\}}', '', 'g')"
    return text


def _finding(rule_id: str, severity: str, line: str, details: str, pos: str) -> str:
    e = rules.ENTRY[rule_id]
    return (
        f"full_name, repo_ord, wf_ord, path, '{e.rule_id}' AS rule_id, {e.detector_ord} AS detector_ord, "
        f"{e.rule_ord} AS rule_ord, CAST({pos} AS INTEGER) AS emit_pos, '{e.type}' AS type, {severity} AS severity, "
        f"CAST({line} AS INTEGER) AS line, {details} AS details"
    )


def _values(rows) -> str:
    return ", ".join("(" + ", ".join(r) + ")" for r in rows)


# name -> SQL; a part may use any part that stands above it.
PARTS: dict[str, str] = {
    # One row per workflow file; fk is a key of the row (files may repeat).
    "files": f"""
        SELECT *, row_number() OVER () AS fk FROM (
          SELECT {repo_name('o_orderkey // 6')} AS full_name, o_orderkey // 6 AS repo_ord,
                 CAST(o_orderkey % 6 AS INTEGER) AS wf_ord, '.github/workflows/wf' || o_orderkey || '.yml' AS path,
                 {content('o_orderkey', _STEPS)} AS content
          FROM orders
          UNION ALL
          SELECT 'docs/' || source || '-' || (doc_id // 4), -1 - doc_id // 4, CAST(doc_id % 4 AS INTEGER),
                 '.github/workflows/doc' || doc_id || '.yaml', {content('doc_id', _SCRIPT)}
          FROM documents)""",
    "lines": """
        SELECT fk, full_name, repo_ord, wf_ord, path, unnest(parts) AS line,
               unnest(range(1, len(parts) + 1)) AS line_no
        FROM (SELECT *, string_split(content, chr(10)) AS parts FROM files WHERE content <> '')""",
    # Header work on cleaned lines of the first document of a file.
    "cleaned": r"""
        SELECT fk, line_no, text FROM (
          SELECT fk, line_no, regexp_replace(regexp_replace(regexp_replace(
                   CASE WHEN line_no = 1 THEN ltrim(line, chr(65279)) ELSE line END,
                   '\r$', ''), '(^|[ \t])#.*$', ''), '[ \t\r]+$', '') AS text
          FROM lines)
        WHERE text <> ''""",
    "framed": r"""
        SELECT *, min(CASE WHEN line_no > opening AND regexp_matches(text, '^(---|\.\.\.)([ \t]|$)') THEN line_no END)
                    OVER (PARTITION BY fk) AS ending,
               min(CASE WHEN regexp_matches(text, '^[^ #"''][^"'']*: +"[^"]*$') THEN line_no END)
                    OVER (PARTITION BY fk) AS quoted
        FROM (SELECT *, min(CASE WHEN NOT regexp_matches(text, '^(%|---([ \t]|$))') THEN line_no END)
                          OVER (PARTITION BY fk) AS opening FROM cleaned)""",
    "block": r"""
        SELECT fk, line_no, text FROM (
          SELECT *, min(CASE WHEN line_no > quoted AND contains(text, '"') THEN line_no END) OVER (PARTITION BY fk) AS unquoted
          FROM framed)
        WHERE line_no >= opening AND line_no < coalesce(ending, line_no + 1)
          AND NOT coalesce(line_no > quoted AND line_no <= unquoted, false)""",
    # A flow mapping letter by letter: quotes by parity, depth by a running sum, entries by commas at depth 1.
    "letters": r"""
        SELECT fk, k, c, quoted, sum(CASE WHEN quoted THEN 0 WHEN c IN ('{', '[') THEN 1 WHEN c IN ('}', ']') THEN -1 ELSE 0 END)
                 OVER (PARTITION BY fk ORDER BY k) AS depth
        FROM (SELECT *, sum(CASE WHEN c = '"' THEN 1 ELSE 0 END) OVER (PARTITION BY fk ORDER BY k) % 2 = 1 AS quoted
              FROM (SELECT fk, unnest(range(1, length(doc) + 1)) AS k, unnest(string_split(doc, '')) AS c
                    FROM (SELECT fk, string_agg(text, ' ' ORDER BY line_no) AS doc FROM block
                          GROUP BY fk HAVING starts_with(first(text ORDER BY line_no), '{'))))""",
    # Brackets of a depth that opens and closes have the same kind; all are closed at the end.
    "closed": r"""
        SELECT fk, bool_and(fits) AND last(depth ORDER BY k) = 0 AS ok FROM (
          SELECT *, quoted OR c NOT IN ('}', ']') OR c = translate(
                   last_value(CASE WHEN NOT quoted AND c IN ('{', '[') THEN c END IGNORE NULLS) OVER (
                     PARTITION BY fk, depth + CASE WHEN NOT quoted AND c IN ('}', ']') THEN 1 ELSE 0 END ORDER BY k), '{[', '}]') AS fits
          FROM letters) GROUP BY fk""",
    "flow": r"""
        SELECT fk, line_no, regexp_replace(trim(string_agg(c, '' ORDER BY k)), '^("[^"]*"):(\S)', '\1: \2') AS text FROM (
          SELECT *, 1 + sum(CASE WHEN c = ',' AND depth = 1 AND NOT quoted THEN 1 ELSE 0 END) OVER (PARTITION BY fk ORDER BY k) AS line_no
          FROM letters)
        WHERE NOT (depth = 1 AND NOT quoted AND c IN (',', '{')) AND NOT (depth = 0 AND c = '}')
        GROUP BY fk, line_no HAVING trim(string_agg(c, '' ORDER BY k)) <> ''""",
    "clean": """
        SELECT fk, line_no, text FROM block WHERE fk NOT IN (SELECT fk FROM flow)
        UNION ALL SELECT fk, line_no, text FROM flow""",
    "keyed": f"""
        SELECT *, last_value(key IGNORE NULLS) OVER w AS owner FROM (
          SELECT *, CASE WHEN {has('text', _KEY_SQL)} THEN
                 nullif(concat(regexp_extract(text, '{_KEY_SQL}', 1), regexp_extract(text, '{_KEY_SQL}', 2),
                        regexp_extract(text, '{_KEY_SQL}', 3)), '') END AS key
          FROM clean)
        WINDOW w AS (PARTITION BY fk ORDER BY line_no)""",
    "valid": r"""
        SELECT f.fk, coalesce(v.ok, true) AND coalesce(closed.ok, true) AS parse_ok
        FROM (SELECT fk FROM files WHERE content <> '') f LEFT JOIN closed USING (fk)
        LEFT JOIN (
          SELECT fk, bool_and(CASE
                   WHEN key IS NOT NULL THEN true
                   WHEN regexp_matches(text, '^[ ]*\t') THEN NOT regexp_matches(text, '^\t')
                   WHEN text LIKE ' %' THEN true
                   WHEN text = '-' OR regexp_matches(text, '^-[ \t]') THEN owner IS NOT NULL
                   ELSE regexp_matches(text, '^[\]}&*!]') OR regexp_matches(text, '^\?([ \t]|$)') END)
                 AND count(key) = count(DISTINCT key) AS ok
          FROM keyed GROUP BY fk) v USING (fk)""",
    "section": r"""
        SELECT fk, owner, max(rest) AS rest,
               list(text ORDER BY line_no) FILTER (key IS NULL) AS children,
               first(ind ORDER BY line_no) FILTER (key IS NULL) AS first_ind,
               first(ltrim(text) ORDER BY line_no) FILTER (key IS NULL) AS first_child
        FROM (SELECT *, CASE WHEN key IS NOT NULL THEN regexp_extract(text, '^[^:]*:[ \t]*(.*)$', 1) END AS rest,
                     length(text) - length(ltrim(text, ' ')) AS ind
              FROM keyed WHERE owner IN ('on', 'permissions'))
        GROUP BY fk, owner""",
    "formed": r"""
        SELECT *, CASE WHEN rest LIKE '[%' THEN 'flow list' WHEN rest LIKE '{%' THEN 'flow map'
                       WHEN rest <> '' THEN 'scalar' WHEN first_child IS NULL THEN 'empty'
                       WHEN first_child = '-' OR first_child LIKE '- %' THEN 'block list'
                       ELSE 'block map' END AS form
        FROM section""",
    "entries": r"""
        SELECT fk, owner, form, unnest(CASE
            WHEN form = 'scalar' THEN [rest]
            WHEN form LIKE 'flow%' THEN string_split(""" + _without_inner(
                "regexp_replace(trim(concat_ws(' ', rest, array_to_string(children, ' '))), '^[\\[{]|[\\]}]$', '', 'g')") + r""", ',')
            WHEN form LIKE 'block%' THEN list_filter(children, lambda c: length(c) - length(ltrim(c, ' ')) = first_ind)
            END) AS entry
        FROM formed""",
    "items": r"""
        SELECT * FROM (
          SELECT fk, owner, form, entry, regexp_replace(trim(
                 CASE WHEN form = 'scalar' THEN entry
                      ELSE string_split(regexp_replace(ltrim(entry), '^-[ \t]+', ''), ':')[1] END),
                 '^["'']|["'']$', '', 'g') AS item
          FROM entries)
        WHERE item <> ''""",
    "header": r"""
        SELECT v.fk, v.parse_ok, coalesce(p.form, 'absent') AS permissions_form,
               coalesce(c.contents, '') AS contents, coalesce(t.triggers, []) AS triggers
        FROM valid v
        LEFT JOIN (SELECT fk, form FROM formed WHERE owner = 'permissions') p USING (fk)
        LEFT JOIN (SELECT fk, first(regexp_extract(entry, '^ *["'']?contents["'']? *: *["'']?([A-Za-z-]+)["'']? *$', 1)) AS contents
                   FROM items WHERE owner = 'permissions' AND form LIKE '%map' AND item = 'contents' GROUP BY fk) c USING (fk)
        LEFT JOIN (SELECT fk, list(item) AS triggers FROM items WHERE owner = 'on' GROUP BY fk) t USING (fk)""",
    "good": f"""
        SELECT l.*, {trim('l.line')} AS trimmed,
               list_contains(h.triggers, 'pull_request_target') AS privileged
        FROM lines l JOIN header h USING (fk) WHERE h.parse_ok""",
    "good_files": """
        SELECT f.*, h.* EXCLUDE (fk) FROM files f JOIN header h USING (fk) WHERE h.parse_ok""",
    # Context rules.
    "near": """
        SELECT *, max(CASE WHEN contains(line, 'permissions:') THEN 1 ELSE 0 END)
                  OVER (PARTITION BY fk ORDER BY line_no ROWS BETWEEN 10 PRECEDING AND 9 FOLLOWING) AS permitted
        FROM good""",
    "refs": f"""
        SELECT fk, line_no, line, CASE WHEN {has('line', P_SAFE)} THEN 'safe' ELSE 'unsafe' END AS kind
        FROM good WHERE privileged AND ({has('line', P_SAFE)} OR {has('line', P_UNSAFE)})""",
    "checkouts": f"""
        SELECT c.fk, c.full_name, c.repo_ord, c.wf_ord, c.path, c.line_no AS co_line,
               min(r.line_no) AS ref_line, arg_min(r.kind, r.line_no) AS kind, arg_min(r.line, r.line_no) AS ref_text
        FROM good c LEFT JOIN refs r ON r.fk = c.fk AND r.line_no BETWEEN c.line_no - 5 AND c.line_no + 4
        WHERE c.privileged AND {has('c.line', P_CHECKOUT)}
        GROUP BY ALL""",
    "state": """
        SELECT *, last_value(marker IGNORE NULLS) OVER (
                    PARTITION BY fk ORDER BY line_no ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before
        FROM (SELECT *, CASE WHEN trimmed LIKE 'run: |%' OR trimmed LIKE 'run:|%' THEN 'S'
                             WHEN trimmed LIKE '-%' OR trimmed LIKE '#%' OR trimmed LIKE 'run:%' THEN 'E' END AS marker
              FROM good)""",
}

PARTS.update({
    "r01": f"""
        SELECT {_finding('R01', f"CASE WHEN {has('line', P_RUN_HIGH)} THEN 'HIGH' ELSE 'MEDIUM' END", 'line_no', 'line', 'line_no')}
        FROM good WHERE {has('line', P_RUN)} AND NOT contains(line, '${{{{ github.event.repository')
          AND NOT contains(line, '||') AND NOT contains(line, '&&') AND NOT {QUOTED}""",
    "r02": f"""
        SELECT {_finding('R02', "'MEDIUM'", 'line_no', 'trimmed', 'line_no')}
        FROM good WHERE starts_with(trimmed, 'uses:') AND NOT {has('trimmed', P_HASH)} AND {has('trimmed', P_NO_VERSION)}""",
    "r03": f"""
        SELECT {_finding('R03', "'HIGH'", 'line_no', 'trimmed', 'line_no')}
        FROM good WHERE starts_with(trimmed, 'uses:') AND NOT {has('trimmed', P_HASH)} AND {has('trimmed', P_BRANCH)}""",
    "r04": f"""
        SELECT {_finding('R04', "'HIGH'", 'line_no', 'line', 'line_no')} FROM good WHERE {has('line', P_PRINT)}""",
    "r05": f"""
        SELECT {_finding('R05', "'MEDIUM'", 'line_no', 'line', 'line_no')}
        FROM good WHERE {has('line', P_ENV)} AND NOT contains(line, 'mask: true')""",
    "r06": f"""
        SELECT {_finding('R06', "'MEDIUM'", '0', quote(rules.FILE_DETAILS['R06']), '0')}
        FROM good_files WHERE permissions_form LIKE '%map' AND contents = 'write'""",
    "r07": f"""
        SELECT {_finding('R07', "'HIGH'", '0', quote(rules.FILE_DETAILS['R07']), '0')}
        FROM good_files WHERE permissions_form LIKE '%map' AND contents = 'admin'""",
    "r08": f"""
        SELECT {_finding('R08', "'LOW'", '0', quote(rules.FILE_DETAILS['R08']), '0')}
        FROM good_files WHERE permissions_form = 'absent'""",
    "r09": f"""
        SELECT {_finding('R09', "'LOW'", 'line_no', 'line', 'line_no')}
        FROM near WHERE permitted = 0 AND {has('line', P_TOKEN)}""",
    "r10": f"""
        SELECT {_finding('R10', "'HIGH'", 'ref_line', 'ref_text', 'co_line')} FROM checkouts WHERE kind = 'unsafe'""",
    "r11": f"""
        SELECT {_finding('R11', "'HIGH'", '0', quote(rules.FILE_DETAILS['R11']), 'n_lines + 1')}
        FROM (SELECT fk, full_name, repo_ord, wf_ord, path,
                     coalesce(arg_max(kind, co_line) FILTER (kind IS NOT NULL), 'none') AS decided
              FROM checkouts GROUP BY ALL)
        JOIN (SELECT fk, count(*) AS n_lines, bool_or(contains(line, 'run:')) AS runs FROM good GROUP BY fk) USING (fk)
        WHERE decided <> 'safe' AND runs""",
    "r12": f"""
        SELECT {_finding('R12', "'MEDIUM'", 'line_no', 'line', 'line_no')}
        FROM state WHERE marker IS NULL AND trimmed <> '' AND before = 'S'
          AND contains(line, '${{{{') AND contains(line, 'github.event') AND NOT {QUOTED}
          AND NOT contains(line, 'github.event.repository') AND NOT contains(line, 'github.event.number')""",
})
PARTS["findings"] = " UNION ALL ".join(f"SELECT * FROM r{i:02d}" for i in range(1, 13))
PARTS["texts"] = (
    "SELECT * FROM (VALUES "
    + _values(
        [quote(e.rule_id), quote(e.description), quote(e.impact), quote(e.exploit), quote(e.mitigation),
         quote("; ".join(e.refs))]
        for e in rules.CATALOG
    )
    + ") AS t(rule_id, description, impact, exploit, mitigation, refs)"
)
PARTS.update({
    "manifest": f"""
        SELECT c_custkey AS line_no, CASE c_custkey % 23
            WHEN 3 THEN '' WHEN 4 THEN '   '
            WHEN 5 THEN {repo_name('c_custkey')} || ' ' || paths
            WHEN 6 THEN 'repo' || c_custkey || ': ' || paths
            WHEN 7 THEN {repo_name('c_custkey')} || '/sub: ' || paths
            WHEN 8 THEN {repo_name('c_custkey')} || ': '
            WHEN 9 THEN {repo_name('c_custkey')} || ': .github/workflows/wf' || (c_custkey * 6) || '.yml, .github/workflows/wf' || (c_custkey * 6 + 1) || '.yml'
            WHEN 10 THEN {repo_name('c_custkey - 1')} || ': ' || previous
            WHEN 11 THEN {repo_name('c_custkey')} || ': ' || paths || ': x'
            WHEN 12 THEN {repo_name('c_custkey')} || ': ' || paths || chr(13)
            ELSE {repo_name('c_custkey')} || ': ' || paths END AS value
        FROM (SELECT *,
              array_to_string(list_transform(range(0, 6), lambda i: '.github/workflows/wf' || (c_custkey * 6 + i) || '.yml'), ',') AS paths,
              array_to_string(list_transform(range(0, 6), lambda i: '.github/workflows/wf' || ((c_custkey - 1) * 6 + i) || '.yml'), ',') AS previous
              FROM customer)""",
    "repos": r"""
        SELECT line_no AS repo_ord, regexp_extract(name, '^([^/]*)/', 1) AS owner,
               regexp_extract(name, '^[^/]*/(.*)$', 1) AS name, name AS full_name, string_split(rest, ',') AS workflows
        FROM (SELECT line_no, string_split(v, ': ')[1] AS name,
                     substr(v, length(string_split(v, ': ')[1]) + 3) AS rest
              FROM (SELECT line_no, regexp_replace(value, '\r$', '') AS v FROM manifest)
              WHERE contains(v, ': '))
        WHERE contains(name, '/')""",
    "repo_paths": """
        SELECT repo_ord, full_name, CAST(unnest(range(0, len(workflows))) AS INTEGER) AS wf_ord, unnest(workflows) AS path FROM repos""",
    "listings": f"""
        SELECT {repo_name('o_custkey')} AS full_name, o_orderkey AS item_ord,
               CASE WHEN o_orderkey % 6 = 4 THEN 'dir' ELSE 'file' END AS item_type, name,
               '.github/workflows/' || name AS path
        FROM (SELECT *, CASE o_orderkey % 6 WHEN 0 THEN 'ci' || o_orderkey || '.yml' WHEN 1 THEN 'ci' || o_orderkey || '.yaml'
                    WHEN 2 THEN 'ci' || o_orderkey || '.YML' WHEN 3 THEN 'ci' || o_orderkey || '.md'
                    WHEN 4 THEN 'ci' || o_orderkey || '.yml' ELSE 'yml' END AS name FROM orders)""",
    "workflow_items": """
        SELECT * FROM listings WHERE item_type = 'file' AND (suffix(name, '.yml') OR suffix(name, '.yaml'))""",
    "meta": f"""
        SELECT CASE WHEN c_custkey % 29 = 7 THEN {repo_name('c_custkey')} || '/extra' ELSE {repo_name('c_custkey')} END AS full_name,
               {pick(corpus.META_LANGUAGES, 'c_custkey % 13')} AS language, c_custkey % 3 = 0 AS is_fork,
               make_timestamp((1600000000 + c_custkey * 3600) * 1000000) AS created_at,
               make_timestamp((1700000000 + c_custkey * 7919 % 100003) * 1000000) AS updated_at,
               make_timestamp((1710000000 + c_custkey * 104729 % 1000003) * 1000000) AS indexed_at
        FROM customer""",
    "log": f"""
        SELECT {repo_name('user_id')} AS full_name, ts AS processed_at, event_type <> 'error' AS success,
               CASE WHEN event_type <> 'view' THEN event_type END AS message
        FROM events""",
    "registry": """
        SELECT full_name, processed_at, success, message FROM (
          SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY processed_at DESC, success DESC, message DESC NULLS LAST) AS rn FROM log)
        WHERE rn = 1""",
    "tree": f"""
        SELECT {repo_name('r')} AS full_name,
               {pick(corpus.TREE_DIRECTORIES, 'l_suppkey % 9')} || replace({pick(corpus.TREE_NAMES, _TREE_CHOICE)}, '{{}}', CAST(p AS VARCHAR)) AS path
        FROM (SELECT l_orderkey // 48 AS r, l_partkey AS p, l_linenumber AS n, l_suppkey FROM lineitem)""",
    "tree_parts": r"""
        SELECT full_name, path, regexp_extract(list_last(string_split(path, '/')), '(\.[^.]*)$', 1) AS ext,
               len(list_intersect(list_slice(string_split(path, '/'), 1, len(string_split(path, '/')) - 1),
                   ['.git', 'node_modules', 'vendor', 'dist', '.github'])) > 0 AS pruned
        FROM tree""",
    "ext_language": "SELECT * FROM (VALUES "
    + _values([quote(e), quote(lang)] for e, lang in EXTENSION_LANGUAGE)
    + ") AS t(ext, language)",
    "tree_counts": """
        SELECT full_name, language, count(*) AS files FROM tree_parts JOIN ext_language USING (ext)
        WHERE NOT pruned GROUP BY full_name, language""",
    "detected": """
        SELECT full_name, coalesce(detected, '') AS detected,
               CASE WHEN detected IS NULL THEN 'javascript' WHEN n_relevant > 1 THEN relevant ELSE top END AS language
        FROM (SELECT DISTINCT full_name FROM tree) LEFT JOIN (
          SELECT full_name, string_agg(language, ', ' ORDER BY language) AS detected,
                 string_agg(language, ', ' ORDER BY language) FILTER (files >= 3) AS relevant,
                 count(*) FILTER (files >= 3) AS n_relevant,
                 first(language ORDER BY files DESC, language) AS top
          FROM tree_counts GROUP BY full_name) USING (full_name)""",
    "meta_language": """
        SELECT *, CASE WHEN l IN ('go', 'golang') THEN 'go' WHEN l = 'python' THEN 'python'
                       WHEN l IN ('java', 'kotlin') THEN 'java' WHEN l IN ('c#', 'csharp') THEN 'csharp'
                       WHEN l IN ('c', 'c++', 'cpp') THEN 'cpp' WHEN l = 'ruby' THEN 'ruby'
                       ELSE 'javascript' END AS scanner_language
        FROM (SELECT *, lower(language) AS l FROM meta)""",
})


def ecosystem(language: str) -> str:
    return (
        f"CASE WHEN lower({language}) IN ('go', 'golang') THEN 'gomod' WHEN lower({language}) = 'python' THEN 'pip' "
        f"WHEN lower({language}) IN ('java', 'kotlin') THEN 'maven' WHEN lower({language}) IN ('c#', 'csharp') THEN 'nuget' "
        f"WHEN lower({language}) = 'ruby' THEN 'bundler' WHEN lower({language}) = 'php' THEN 'composer' "
        f"WHEN lower({language}) = 'rust' THEN 'cargo' ELSE 'npm' END"
    )


def with_parts(final: str, given: tuple[str, ...] = ()) -> str:
    """Put the parts that ``final`` needs in front of it.

    Parts named in ``given`` are left out; tables of these names must exist.
    """

    def used(sql: str) -> set[str]:
        names = re.findall(r"\b(?:FROM|JOIN)\s+([a-z_0-9]+)", sql)
        return set(names) & (PARTS.keys() - set(given))

    needed: set[str] = set()
    queue = used(final)
    while queue:
        name = queue.pop()
        if name not in needed:
            needed.add(name)
            queue |= used(PARTS[name])
    ordered = [n for n in PARTS if n in needed]
    if not ordered:
        return final
    return "WITH " + ",\n".join(f"{n} AS ({PARTS[n]})" for n in ordered) + "\n" + final
