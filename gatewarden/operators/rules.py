"""The rule catalogue and the declarative form of line rules.

A line rule looks at one line at a time and is plain data: a substring that every
hit contains (``needle``), an including pattern, excluded substrings, and a
severity. Own rules can be passed to ``scan`` beside the built-in ones.

Patterns carry ``(?d)`` because only LF ends a line here and ``.`` must match CR,
and spell out the white-space class because Java's ``\\s`` also takes VT. Where a
pattern needs several parts in order it takes the first place of each part in an
atomic group, which finds the same lines and stays linear on very long ones.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from gatewarden.functions.sql import all_of, contains_any, literal, struct

HIGH, MEDIUM, LOW = "HIGH", "MEDIUM", "LOW"
SEVERITIES = (HIGH, MEDIUM, LOW)
# Exchange-format level and numeric score of each severity.
LEVEL = {HIGH: "error", MEDIUM: "warning", LOW: "note"}
SCORE = {HIGH: "8.9", MEDIUM: "5.5", LOW: "3.0"}
OTHER_LEVEL, OTHER_SCORE = "warning", "1.0"

WS = r"[\t\n\f\r ]"
_OPEN = r"\$\{\{" + WS + "*"


@dataclass(frozen=True)
class CatalogEntry:
    rule_id: str
    rule_ord: int
    detector_ord: int
    type: str
    severity: str
    description: str
    impact: str
    exploit: str
    mitigation: str
    refs: tuple[str, ...]


_HARDENING = "https://docs.github.com/actions/security-guides/security-hardening-for-github-actions"
_TOKEN = "https://docs.github.com/actions/security-guides/automatic-token-authentication"
_SECRETS = "https://docs.github.com/actions/security-guides/encrypted-secrets"
_EVENTS = "https://docs.github.com/actions/using-workflows/events-that-trigger-workflows"
_CWE78 = "https://cwe.mitre.org/data/definitions/78.html"

CATALOG: tuple[CatalogEntry, ...] = (
    CatalogEntry(
        "R01", 1, 1, "Command Injection", MEDIUM,
        "Event data is expanded inside a shell command",
        "Text chosen by an outsider becomes part of a command line on the runner.",
        "Open an issue whose title closes the command and appends another one.",
        "Pass the value through an environment variable and quote it in the shell.",
        (_HARDENING, _CWE78),
    ),
    CatalogEntry(
        "R02", 2, 2, "Unsafe Action Reference", MEDIUM,
        "Action is used without any version",
        "Whatever the action contains on the day of the run is executed.",
        "Publish a changed action; every later run picks it up.",
        "Pin the action to a full commit hash.",
        (_HARDENING,),
    ),
    CatalogEntry(
        "R03", 3, 2, "Unsafe Action Reference", HIGH,
        "Action is pinned to a moving branch",
        "New commits on the branch run with the rights of the workflow, unreviewed.",
        "Push one commit to the branch of a widely used action.",
        "Pin the action to a full commit hash.",
        (_HARDENING,),
    ),
    CatalogEntry(
        "R04", 4, 3, "Secret Exposure", HIGH,
        "Secret is passed to an output command",
        "The value can end up in a log that others are able to read.",
        "Read the log of the run and reuse the credential.",
        "Never print secrets; hand them to the one tool that needs them.",
        (_SECRETS,),
    ),
    CatalogEntry(
        "R05", 5, 3, "Secret Exposure", MEDIUM,
        "Secret is placed in an inline environment without masking",
        "Any command of the step can reveal the value, for example by dumping its environment.",
        "Trigger an error path that prints the environment.",
        "Mask the value and limit it to the step that needs it.",
        (_SECRETS,),
    ),
    CatalogEntry(
        "R06", 6, 4, "Excessive Permissions", MEDIUM,
        "Workflow may write repository contents",
        "A compromised step can change code and push commits.",
        "Use the token of the run to push a backdoor.",
        "Grant read access and raise single scopes only where needed.",
        (_TOKEN,),
    ),
    CatalogEntry(
        "R07", 7, 4, "Excessive Permissions", HIGH,
        "Workflow asks for administrator rights on contents",
        "A compromised step controls settings and branch protection.",
        "Use the token of the run to switch protections off.",
        "Remove administrator rights; do such work by hand under review.",
        (_TOKEN,),
    ),
    CatalogEntry(
        "R08", 8, 4, "Undefined Permissions", LOW,
        "Workflow does not state its permissions",
        "The repository default applies, which is often broader than the job needs.",
        "Abuse the default token from any compromised step.",
        "State minimal permissions at the top of the workflow.",
        (_TOKEN,),
    ),
    CatalogEntry(
        "R09", 9, 4, "Undefined Token Permissions", LOW,
        "Token is used without permissions stated nearby",
        "The step receives the default rights of the token.",
        "Abuse the broader token from the action that receives it.",
        "State the permissions of the job that uses the token.",
        (_TOKEN,),
    ),
    CatalogEntry(
        "R10", 10, 5, "Unsafe pull_request_target Reference", HIGH,
        "Privileged pull-request workflow checks out the head of the request",
        "Code from a fork runs beside the secrets of the base repository.",
        "Send a pull request whose build script sends the secrets away.",
        "Check out the base commit and never run code of the request.",
        (_EVENTS, _HARDENING),
    ),
    CatalogEntry(
        "R11", 11, 5, "Unsafe pull_request_target", HIGH,
        "Privileged pull-request workflow checks out code and runs commands",
        "Commands run with secrets in reach while the checked-out code may be foreign.",
        "Send a pull request that changes a file which the commands execute.",
        "Use the unprivileged trigger, or check out the base commit only.",
        (_EVENTS, _HARDENING),
    ),
    CatalogEntry(
        "R12", 12, 6, "Script Injection", MEDIUM,
        "Event data is expanded inside a multi-line script",
        "Text chosen by an outsider becomes part of the script.",
        "Send an event field that holds a line of shell code.",
        "Pass the value through an environment variable and quote it in the script.",
        (_HARDENING, _CWE78),
    ),
)

ENTRY = {e.rule_id: e for e in CATALOG}

# Wording of findings that concern a whole file.
FILE_DETAILS = {
    "R06": "permissions: contents: write",
    "R07": "permissions: contents: admin",
    "R08": "no top-level permissions",
    "R11": "pull_request_target with checkout of no safe ref and run steps",
}


@dataclass(frozen=True)
class LineRule:
    """One rule over single lines.

    Each of ``needles`` is in every hit; they are tested before the pattern, and
    the first one before anything else. Of each group in ``in_any_case`` one text is in the
    lower-cased line of every hit: they spare lines a pattern that ignores case, so
    they hold no letter that such a pattern finds beyond ASCII (i, k, s). ``pattern`` is searched in the raw line,
    or in the trimmed line when ``trimmed`` is set (which is then also what the
    finding shows). ``high_pattern`` raises the severity to HIGH.
    """

    entry: CatalogEntry
    pattern: str
    needles: tuple[str, ...] = ()
    guard_pattern: str | None = None
    starts_with: str | None = None
    excluded: tuple[str, ...] = ()
    excluded_pattern: str | None = None
    high_pattern: str | None = None
    trimmed: bool = False
    in_any_case: tuple[tuple[str, ...], ...] = ()

    def shown(self, raw: str, trimmed: str) -> str:
        return trimmed if self.trimmed else raw

    def matches(self, raw: str, trimmed: str, lowered: str) -> str:
        """SQL test over the names of the raw, the trimmed and the lower-cased line, cheap parts first."""
        text = self.shown(raw, trimmed)
        tests = [f"contains({raw}, {literal(n)})" for n in self.needles]
        tests.extend(contains_any(lowered, some) for some in self.in_any_case)
        if self.starts_with:
            tests.append(f"startswith({text}, {literal(self.starts_with)})")
        tests.extend(f"not contains({raw}, {literal(x)})" for x in self.excluded)
        if self.guard_pattern:
            tests.append(f"{text} rlike {literal(self.guard_pattern)}")
        tests.append(f"{text} rlike {literal(self.pattern)}")
        if self.excluded_pattern:
            tests.append(f"not {text} rlike {literal(self.excluded_pattern)}")
        return all_of(tests)

    def severity(self, raw: str, trimmed: str) -> str:
        plain = literal(self.entry.severity)
        if self.high_pattern is None:
            return plain
        text = self.shown(raw, trimmed)
        return f"if({text} rlike {literal(self.high_pattern)}, {literal(HIGH)}, {plain})"


def _event_in_run(fields: str) -> str:
    return (
        r"(?d)\A(?>.*?run:)(?>.*?" + _OPEN + r"github\.event\.(?:" + fields + r")\.).*\}\}"
    )


_FULL_HASH = r"(?d)uses:" + WS + r"+[^@]+@[0-9a-f]{40}"

# What the rules on single lines look for.
LINE_RULES: tuple[LineRule, ...] = (
    LineRule(
        ENTRY["R01"],
        needles=("${{", "github.event.", "run:"),
        pattern=_event_in_run(
            "issue|pull_request|comment|discussion|review|head_ref|inputs|client_payload"
        ),
        high_pattern=_event_in_run("inputs|client_payload"),
        excluded=("${{ github.event.repository", "||", "&&", '"${{', "'${{"),
    ),
    LineRule(
        ENTRY["R02"],
        needles=("uses:",),
        starts_with="uses:",
        pattern=r"(?d)uses:" + WS + r"+[^@]+$",
        excluded_pattern=_FULL_HASH,
        trimmed=True,
    ),
    LineRule(
        ENTRY["R03"],
        needles=("uses:",),
        starts_with="uses:",
        pattern=r"(?d)uses:" + WS + r"+[^@]+@" + WS + r"*(?:main|master|develop|dev)",
        excluded_pattern=_FULL_HASH,
        trimmed=True,
    ),
    LineRule(
        ENTRY["R04"],
        needles=("${{",),
        in_any_case=(("ecret",), ("echo", "pr", "ole.log", "cat")),
        guard_pattern=r"(?d)" + _OPEN + r"(?iu:secrets)\.",
        pattern=(
            r"(?diu)\A(?>.*?(?:echo|pr(?-iu:[iI])nt|console\.log|cat))(?>.*?" + _OPEN + r"secrets\.)"
        ),
    ),
    LineRule(
        ENTRY["R05"],
        needles=("${{", "secrets.", "env:"),
        pattern=r"(?d)\A(?>.*?env:)(?>.*?" + _OPEN + r"secrets\.).*\}\}",
        excluded=("mask: true",),
    ),
)

# What the rules on neighbouring lines look for.
TOKEN_LINE = r"(?d)token:" + WS + "*" + _OPEN + r"secrets\.GITHUB_TOKEN" + WS + r"*\}\}"
CHECKOUT_LINE = r"(?d)uses:" + WS + r"+actions/checkout@"
SAFE_REF = (
    r"(?d)ref:" + WS + "*" + _OPEN + r"github\.event\.pull_request\.base\.sha" + WS + r"*\}\}"
)
UNSAFE_REF = r"(?d)ref:" + WS + "*" + _OPEN + r"github\.event\.pull_request\.head\."
SCRIPT_EXCLUDED = ('"${{', "'${{", "github.event.repository", "github.event.number")


def catalog_map(extra: tuple[LineRule, ...] = ()) -> str:
    """The texts that single findings show, as a SQL map from rule to struct."""
    pairs = []
    for e in CATALOG + tuple(r.entry for r in extra):
        texts = struct(
            description=literal(e.description),
            impact=literal(e.impact),
            mitigation=literal(e.mitigation),
        )
        pairs.append(f"{literal(e.rule_id)}, {texts}")
    return f"map({', '.join(pairs)})"


def catalog_frame(spark: SparkSession, extra: tuple[LineRule, ...] = ()) -> DataFrame:
    """The catalogue as a dimension table (one row per rule, fixed size)."""
    rows = [
        (
            e.rule_id, e.rule_ord, e.detector_ord, e.type, e.severity, e.description,
            e.impact, e.exploit, e.mitigation, list(e.refs),
        )
        for e in CATALOG + tuple(r.entry for r in extra)
    ]
    return spark.createDataFrame(
        rows,
        "rule_id string, rule_ord int, detector_ord int, type string, severity string, "
        "description string, impact string, exploit string, mitigation string, "
        "refs array<string>",
    )
