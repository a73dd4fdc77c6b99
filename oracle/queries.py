"""DuckDB SQL for the registered queries."""

from __future__ import annotations

from gatewarden.operators import render, report, sarif
from gatewarden.plans import catalog
from oracle.parts import ecosystem, quote, trim, with_parts

_COLUMNS = (
    "full_name, repo_ord, wf_ord, path, rule_id, detector_ord, rule_ord, emit_pos, type, severity, line, details"
)
_ORDER = "repo_ord, wf_ord, detector_ord, emit_pos, rule_ord"
_STAMP = "strftime({0}, '%Y-%m-%d %H:%M:%S.%f') AS {0}"
_SEVERITIES = "(VALUES ('HIGH', 0), ('MEDIUM', 1), ('LOW', 2)) AS s(severity, severity_rank)"
_COUNTED = f"""SELECT s.severity, s.severity_rank, count(f.severity) AS findings
  FROM {_SEVERITIES} LEFT JOIN (SELECT severity FROM findings) f USING (severity) GROUP BY ALL"""
_LEVEL = "CASE f.severity WHEN 'HIGH' THEN 'error' WHEN 'LOW' THEN 'note' ELSE 'warning' END"
_SCORE = "CASE severity WHEN 'HIGH' THEN '8.9' WHEN 'MEDIUM' THEN '5.5' WHEN 'LOW' THEN '3.0' ELSE '1.0' END"
_FIRST = f"""SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {_ORDER}) AS occurrence,
  count(*) OVER (PARTITION BY type) AS findings FROM findings) WHERE occurrence = 1"""
_RANKED = f"SELECT *, row_number() OVER (ORDER BY findings DESC, type) AS type_rank FROM ({_FIRST})"
_FIRST_PENDING = """SELECT full_name, min(repo_ord) AS repo_ord FROM repos
  WHERE len(string_split(full_name, '/')) = 2 AND full_name NOT IN (SELECT full_name FROM log) GROUP BY full_name"""
_TEMPLATES = "(VALUES " + ", ".join(
    f"({quote(t.tool)}, {quote(t.target_path)}, {quote(t.body)})" for t in render.TEMPLATES
) + ") AS t(tool, path, body)"
_LANGUAGE = """SELECT m.full_name, CASE WHEN coalesce(d.detected, '') <> '' THEN d.language ELSE m.scanner_language END AS language
  FROM meta_language m LEFT JOIN detected d USING (full_name)"""
_ITEMS = r"chr(10) || '        - ''' || trim(x) || ''''"

_SQL: dict[str, str] = {
    "manifest_parse": """SELECT repo_ord, owner, name, full_name, array_to_string(workflows, '|') AS workflows,
        len(workflows) AS n_workflows FROM repos""",
    "manifest_explode": "SELECT repo_ord, full_name, wf_ord, path FROM repo_paths",
    "workflow_load_base64": """SELECT full_name, repo_ord, wf_ord, path,
        decode(from_base64(to_base64(encode(content)))) AS content
        FROM files WHERE content <> '' AND repo_ord % 47 <> 5""",
    "workflow_lines": """SELECT full_name, repo_ord, wf_ord, path,
        CAST(line_no AS INTEGER) AS line_no, line FROM lines""",
    "workflow_file_filter": "SELECT full_name, item_ord, path FROM workflow_items",
    "registry_load": f"SELECT full_name, {_STAMP.format('processed_at')}, success, message FROM log",
    "tree_prune": "SELECT full_name, path FROM tree_parts WHERE NOT pruned",
    "path_extension": "SELECT full_name, path, ext FROM tree_parts",
    "workflow_header": """SELECT full_name, path, permissions_form, contents FROM good_files""",
    "workflow_triggers": "SELECT full_name, path, unnest(triggers) AS event FROM good_files",
    "workflow_parse_ok": "SELECT full_name, path, parse_ok FROM files JOIN valid USING (fk)",
    "scan_all": f"SELECT {_COLUMNS} FROM findings",
    "scan_incremental": f"SELECT {_COLUMNS} FROM findings",
    "scan_limited": f"""SELECT f.full_name, p.repo_ord, p.wf_ord, f.path, rule_id, detector_ord, rule_ord,
        emit_pos, type, severity, line, details
        FROM (SELECT * FROM repo_paths WHERE repo_ord IN
              (SELECT repo_ord FROM repos ORDER BY repo_ord LIMIT {catalog.ANALYZED})) p
        JOIN findings f ON f.full_name = p.full_name AND f.path = p.path""",
    "scan_stored": """SELECT f.full_name, p.repo_ord, p.wf_ord, f.path, rule_id, detector_ord, rule_ord,
        emit_pos, type, severity, line, details
        FROM repo_paths p JOIN findings f ON f.full_name = p.full_name AND f.path = p.path""",
    "findings_enriched": """SELECT full_name, path, rule_id, type, severity, line, description, impact, exploit,
        mitigation, refs FROM findings JOIN texts USING (rule_id)""",
    "summary_total": "SELECT count(*) AS findings FROM findings",
    "summary_severity": f"SELECT severity, findings FROM ({_COUNTED})",
    "summary_severity_bar": f"""SELECT severity, findings, repeat('█', findings * 20 // (max(findings) OVER ())) AS bar
        FROM ({_COUNTED})""",
    "summary_type": "SELECT type, count(*) AS findings FROM findings GROUP BY type",
    "findings_per_repo": """SELECT full_name, count(rule_id) AS findings
        FROM (SELECT DISTINCT full_name FROM files) LEFT JOIN (SELECT full_name, rule_id FROM findings) USING (full_name)
        GROUP BY full_name""",
    "report_occurrences": f"""SELECT type, row_number() OVER (PARTITION BY type ORDER BY {_ORDER}) AS occurrence,
        full_name, path, rule_id, line, details FROM findings""",
    "report_representative": f"SELECT type, findings, rule_id, severity, full_name, path, line FROM ({_FIRST})",
    "report_sections": f"""
        SELECT 0 AS section, 0 AS type_rank, 0 AS occurrence,
               concat('# CI workflow findings', chr(10), chr(10), '**Date**: {catalog.RUN_TIME}', chr(10), chr(10),
                      '**Findings**: ', count(*), chr(10), chr(10), '## By severity', chr(10)) AS text FROM findings
        UNION ALL SELECT 1, 0, severity_rank, concat('    ', rpad(severity, 8, ' '),
               repeat('█', findings * 20 // (max(findings) OVER ())), ' (', findings, ')') FROM ({_COUNTED})
        UNION ALL SELECT 2, type_rank, 0, concat(CASE WHEN type_rank = 1 THEN chr(10) || '## By type' || chr(10) || chr(10) ELSE '' END,
               '- **', type, '**: ', findings) FROM ({_RANKED})
        UNION ALL SELECT 3, type_rank, 0, concat(chr(10), '## ', type, ' (', findings, ')', chr(10), chr(10),
               '**Description**: ', description, chr(10), chr(10), '**Severity**: ', severity, chr(10), chr(10),
               '**Impact**: ', impact, chr(10), chr(10), '**Exploit**: ', exploit, chr(10), chr(10),
               '**Mitigation**: ', mitigation, chr(10), chr(10), '**References**: ', replace(refs, '; ', ', '), chr(10))
               FROM ({_RANKED}) JOIN texts USING (rule_id)
        UNION ALL SELECT 3, type_rank, o.occurrence, concat('### Occurrence ', o.occurrence, ' - ', o.full_name, ' ', o.path,
               ', line ', o.line, chr(10), chr(10), '    ', {trim('o.details')}, chr(10))
               FROM (SELECT *, row_number() OVER (PARTITION BY type ORDER BY {_ORDER}) AS occurrence FROM findings) o
               JOIN ({_RANKED}) r ON r.type = o.type
        UNION ALL SELECT 4, 0, 0, '{report.ADVICE}'""",
    "sarif_rules": f"""SELECT replace(type, ' ', '') AS id, type AS name, description AS short_description,
        impact AS full_description, mitigation AS help, {_SCORE} AS security_severity,
        'security,github-actions,ci-cd' AS tags FROM ({_FIRST}) JOIN texts USING (rule_id)""",
    "sarif_results": f"""SELECT full_name, replace(f.type, ' ', '') AS rule_id, {_LEVEL} AS level,
        description || ' - ' || string_split(details, chr(10))[1] AS message, path AS uri, line AS start_line,
        details AS snippet FROM findings f JOIN texts USING (rule_id)""",
    "sarif_document": f"""
        SELECT full_name, shard, count(*) AS results, CAST(to_json({{
            '$schema': '{sarif.SCHEMA_URI}', 'version': '{sarif.VERSION}',
            'runs': [{{
              'tool': {{'driver': {{'name': '{sarif.TOOL_NAME}', 'version': '{sarif.TOOL_VERSION}',
                 'rules': list({{'id': replace(type, ' ', ''), 'name': type,
                    'shortDescription': {{'text': type_description}}, 'fullDescription': {{'text': type_impact}},
                    'help': {{'text': type_mitigation}},
                    'properties': {{'security-severity': type_score, 'tags': ['security', 'github-actions', 'ci-cd']}}}}
                    ORDER BY number) FILTER (type_number = 1)}}}},
              'automationDetails': {{'id': full_name}},
              'results': list({{'ruleId': replace(type, ' ', ''), 'level': {_LEVEL.replace('f.', '')},
                 'message': {{'text': description || ' - ' || string_split(details, chr(10))[1]}},
                 'locations': [{{'physicalLocation': {{'artifactLocation': {{'uri': path}},
                    'region': {{'startLine': line, 'snippet': {{'text': details}}}}}}}}]}} ORDER BY number),
              'invocations': [{{'executionSuccessful': true, 'startTimeUtc': '{catalog.RUN_START}',
                 'endTimeUtc': '{catalog.RUN_END}'}}]}}]}}) AS VARCHAR) AS document
        FROM (SELECT *, row_number() OVER (PARTITION BY full_name, shard, type ORDER BY number) AS type_number
              FROM (SELECT *, (number - 1) // {sarif.RESULTS_PER_DOCUMENT} AS shard
                    FROM (SELECT *, row_number() OVER (PARTITION BY full_name ORDER BY {_ORDER}) AS number FROM findings))
              JOIN texts USING (rule_id)
              JOIN (SELECT type, description AS type_description, impact AS type_impact, mitigation AS type_mitigation,
                           {_SCORE} AS type_score FROM ({_FIRST}) JOIN texts USING (rule_id)) USING (type))
        GROUP BY full_name, shard""",
    "collect_repos": f"""SELECT full_name, {_STAMP.format('indexed_at')}, item_ord, path
        FROM workflow_items JOIN (
          SELECT full_name, max(indexed_at) AS indexed_at FROM meta
          WHERE full_name IN (SELECT full_name FROM workflow_items) GROUP BY full_name
          ORDER BY indexed_at DESC, full_name LIMIT {catalog.COLLECTED}) USING (full_name)""",
    "manifest_format": """SELECT full_name,
        full_name || ': ' || string_agg(path, ',' ORDER BY item_ord) AS value FROM workflow_items GROUP BY full_name""",
    "fork_listing": f"""SELECT row_number() OVER (ORDER BY updated_at DESC, full_name) AS number, full_name,
        {_STAMP.format('created_at')} FROM meta WHERE is_fork""",
    "repo_name_strict": "SELECT repo_ord, full_name FROM repos WHERE len(string_split(full_name, '/')) = 2",
    "registry_upsert": f"SELECT full_name, {_STAMP.format('processed_at')}, success, message FROM registry",
    **{name: f"SELECT full_name, {_STAMP.format('processed_at')}, success, message FROM registry"
       for name in ("registry_one_line", "registry_store")},
    "registry_export": """SELECT full_name, concat('{"', full_name, '":{"full_name":"', full_name, '","processed_at":"',
        strftime(processed_at, '%Y-%m-%dT%H:%M:%S.%f'), 'Z","success":', CASE WHEN success THEN 'true' ELSE 'false' END,
        CASE WHEN message IS NULL THEN '' ELSE concat(',"message":"', message, '"') END, '}}') AS value FROM registry""",
    "registry_pending": """SELECT repo_ord, full_name FROM repos
        WHERE full_name NOT IN (SELECT full_name FROM log)""",
    "registry_skipped": f"""SELECT repo_ord, full_name, {_STAMP.format('processed_at')}, success
        FROM repos JOIN registry USING (full_name)""",
    "registry_stats": """SELECT count(*) AS registered, count(*) FILTER (success) AS succeeded,
        count(*) FILTER (NOT success) AS failed FROM registry""",
    "rollout_batch": f"SELECT full_name, repo_ord FROM ({_FIRST_PENDING}) ORDER BY repo_ord LIMIT {catalog.ROLLED_OUT}",
    "run_counters": f"""SELECT processed, (SELECT count(*) FROM repos WHERE len(string_split(full_name, '/')) = 2
            AND repo_ord < coalesce(stop, 9223372036854775807)) - processed AS skipped,
          (SELECT count(*) FROM registry) + processed AS total
        FROM (SELECT least((SELECT count(*) FROM ({_FIRST_PENDING})), {catalog.ROLLED_OUT}) AS processed,
          (SELECT repo_ord FROM ({_FIRST_PENDING}) ORDER BY repo_ord LIMIT 1 OFFSET {catalog.ROLLED_OUT}) AS stop)""",
    "language_counts": "SELECT full_name, language, files FROM tree_counts",
    "language_detect": "SELECT full_name, detected, language FROM detected",
    "language_ecosystem": f"SELECT full_name, scanner_language, {ecosystem('language')} AS ecosystem FROM meta_language",
    "scan_config_render": f"""SELECT full_name, tool, path, CASE WHEN contains(language, ',')
        THEN replace(body, '[ ''language'' ]', array_to_string(list_transform(string_split(language, ','), lambda x: {_ITEMS}), ''))
        ELSE replace(body, '''language''', '''' || language || '''') END AS content
        FROM ({_LANGUAGE}) l JOIN {_TEMPLATES} ON true""",
}
_BATCH = f"""SELECT full_name, repo_ord, CAST(row_number() OVER (ORDER BY repo_ord) AS INTEGER) AS position,
  CAST(count(*) OVER () AS INTEGER) AS total
  FROM (SELECT * FROM ({_FIRST_PENDING}) ORDER BY repo_ord LIMIT {catalog.ROLLED_OUT})"""
_SQL["rollout_configs"] = f"""SELECT position, total, full_name, tool, path, CASE WHEN contains(language, ',')
    THEN replace(body, '[ ''language'' ]', array_to_string(list_transform(string_split(language, ','), lambda x: {_ITEMS}), ''))
    ELSE replace(body, '''language''', '''' || language || '''') END AS content
    FROM (SELECT b.full_name, position, total, CASE WHEN coalesce(d.detected, '') <> '' THEN d.language
            ELSE coalesce(m.scanner_language, 'javascript') END AS language
          FROM ({_BATCH}) b
          LEFT JOIN (SELECT full_name, min(scanner_language) AS scanner_language FROM meta_language GROUP BY full_name) m USING (full_name)
          LEFT JOIN detected d USING (full_name)) JOIN {_TEMPLATES} ON true"""
_SQL["rollout_registry"] = f"""SELECT full_name, {_STAMP.format('processed_at')}, success, message FROM registry
    UNION ALL SELECT full_name, '{catalog.RUN_TIME}.000000', true, 'processed' FROM ({_BATCH})"""
_SQL["analyze_written"] = f"""SELECT f.full_name, replace(f.type, ' ', '') AS rule_id, {_LEVEL} AS level, f.path AS uri, line AS start_line
    FROM repo_paths p JOIN findings f ON f.full_name = p.full_name AND f.path = p.path"""
_OWN = catalog.OWN_RULE.entry
_OWN_ID = _OWN.type.replace(" ", "")
_OWN_FOUND = r"SELECT full_name, path, line_no AS line, line AS details FROM good WHERE regexp_matches(line, 'run: \|[ \t\r]*$')"
_SQL["scan_own_rules"] = f"""
    SELECT 'result' AS part, full_name AS at, path AS name,
           concat_ws('|', '{_OWN_ID}', 'note', line, '{_OWN.description} - ' || details) AS text FROM ({_OWN_FOUND})
    UNION ALL SELECT 'rule', '', replace(type, ' ', ''), concat_ws('|', description, impact, mitigation, {_SCORE})
           FROM ({_FIRST}) JOIN texts USING (rule_id)
    UNION ALL SELECT 'rule', '', '{_OWN_ID}', '{_OWN.description}|{_OWN.impact}|{_OWN.mitigation}|3.0'
    UNION ALL SELECT 'section', '', type, concat_ws('|', findings, severity, description, exploit, refs)
           FROM ({_FIRST}) JOIN texts USING (rule_id)
    UNION ALL SELECT 'section', '', '{_OWN.type}', concat_ws('|', count(*), 'LOW', '{_OWN.description}', '{_OWN.exploit}', '{_OWN.refs[0]}')
           FROM ({_OWN_FOUND})"""
for _name, _id in {
    "rule_command_injection": "r01", "rule_action_unversioned": "r02", "rule_action_branch": "r03",
    "rule_secret_print": "r04", "rule_secret_env": "r05", "rule_perm_write": "r06",
    "rule_perm_admin": "r07", "rule_perm_undefined": "r08", "rule_token_context": "r09",
    "rule_prt_ref": "r10", "rule_prt_exec": "r11", "rule_script_injection": "r12",
}.items():
    _SQL[_name] = f"SELECT full_name, path, severity, line, details FROM {_id}"

ORACLE: dict[str, str] = {name: with_parts(sql) for name, sql in _SQL.items()}
