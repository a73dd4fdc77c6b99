"""Top-level structure of a workflow document, without a YAML library.

Everything is computed from the one row that holds the document, the first one of the
file. Files that are certainly no mapping (stray text at column 0, a list, a tab before
content, a repeated key) are dropped; where this reader is unsure, a file counts as
valid. Flow collections are read by ``flow`` with a stack, to any depth. Limits: anchors,
aliases, tags and explicit keys are not followed, ``#`` after a blank always starts a
comment in a block (also in quotes), and nested syntax errors go unnoticed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from gatewarden.functions import flow
from gatewarden.functions.sql import literal

# A plain scalar as a key begins with none of the indicators and ends at its colon.
_PLAIN = r"(?:[^\s#,\[\]{}&*!|>'\"%@`?:-]|[?:-](?=[^\s]))(?:(?![ \t]#|:(?:[ \t\r]|$))[^\n])*+"
# Most keys are one word, which is tried first.
_KEY = r"""^([A-Za-z_][A-Za-z0-9_-]*+(?=:(?:[ \t\r]|$))|"(?:[^"\\\n]|\\.)*+"|'(?:[^'\n]|'')*+'|""" + _PLAIN + r""")[ \t]*:(?=[ \t\r]|$)"""
# Lines that are blank or comments. All others at column 0 count; a tab before content also makes one.
_BLANK = r"(?d)^(?:[ \t\r]*$|[ \t]*#)"
# What such a line may be, besides a key: closing bracket, list item, and forms this
# reader does not follow (anchor, alias, tag, explicit key), which are given the benefit.
_OTHER = r"^(?:[\]}]|-(?:[ \t\r]|$)|\?(?:[ \t\r]|$)|[&*!])"
_KEY_START = r"[\"']?{}[\"']?[ \t]*:(?![^ \t\r\n])"
# The line of a key and all lines up to the next one that may open a section. The
# repetition is possessive: it does not recurse, however long the section is.
_SECTION = r"(?dm)^" + _KEY_START + r"[^\n]*(?:\n(?![^ \t\r\n#\-\]}}])[^\n]*)*+"
# A flow collection that this reader does not take apart: one of a fourth level, or separators in quotes.
_QUOTED_SEPARATOR = r"""\"[^\"]*[,:\[\]{}][^\"]*\"|'[^']*[,:\[\]{}][^']*'"""
# The frame of a document: mark, directives, opening mark, and what follows its end.
_MARK = "\ufeff"
_DIRECTIVES = r"(?d)\A(?:[ \t\r]*(?:#[^\n]*)?\n)*%[^\n]*\n(?:[%#][^\n]*\n|[ \t\r]*\n)*"
_DIRECTIVE_FIRST = r"(?d)\A\ufeff?(?:[ \t\r]*+(?:#[^\n]*+)?\n)*+%"
_OPENING = r"(?d)\A((?:[ \t\r]*(?:#[^\n]*)?\n)*+)---(?=[ \t\r\n]|\z)"
_ENDING = r"(?ds)(?:\A|\n)(?:---|\.\.\.)(?=[ \t\r\n]|\z).*"
# A quoted value of a key at column 0 that goes on over the next lines.
_LONG_QUOTE = (
    r"""(?dm)^([^\s#][^\n"']*:[ \t]+)(?:"(?:[^"\\\n]|\\.)*+\n(?:[^"\\]|\\.)*+"|'(?:[^'\n]|'')*+\n(?:[^']|'')*+')"""
)
# Without it at column 0 there is no such value.
_QUOTE_OPENS = r":[ \t]+[\"']"
_COMMENT = r"(?dm)(^|[ \t])#.*$"
_LINE_END = r"(?dm)[ \t\r]+$"
_EMPTY_LINE = r"(?d)\n(?:---)?(?=\n|\z)"
_REST = r"^[^:]*:[ \t]*(.*)$"
FIELDS = ("parse_ok", "permissions_form", "contents", "triggers")
HEADER = "_header_"
_CONTENTS = r"""^[ ]*["']?contents["']?[ ]*:[ ]*["']?([A-Za-z-]+)["']?[ ]*$"""


def _replace(text: str, pattern: str) -> str:
    return f"regexp_replace({text}, {literal(pattern)}, '')"


def _section(content: str, key: str) -> str:
    """Text of the first section with this key without comments and empty lines."""
    text = f"regexp_extract({content}, {literal(_SECTION.format(key))}, 0)"
    for pattern in (_COMMENT, _LINE_END, _EMPTY_LINE):
        text = _replace(text, pattern)
    return text


def _outer(lines: str) -> str:
    """The lines without indent, in one text: all that marks, directives and keys can be in."""
    return f"array_join(filter({lines}, x -> not startswith(x, ' ')), '\n')"


def split_lines(text: str) -> str:
    return f"split({text}, '\n', -1)"


def _rest_and_children(lines: str) -> str:
    rest = f"regexp_extract(get({lines}, 0), {literal(_REST)}, 1)"
    children = f"slice({lines}, 2, greatest(size({lines}) - 1, 0))"
    return (
        f"if({lines} is null, null, named_struct('rest', {rest}, 'children', {children}))"
    )


def _unquote(text: str) -> str:
    return _replace(f"trim({text})", r"""^["']|["']$""")


def _item_name(item: str) -> str:
    return _unquote(f"substring_index({_replace(f'ltrim({item})', '^-[ ' + chr(9) + ']+')}, ':', 1)")


def _flow_text(section: str) -> str:
    return f"trim(concat_ws(' ', {section}.rest, array_join({section}.children, ' ')))"


def _without_inner(section: str) -> str:
    return _replace(_replace(_replace(_flow_text(section), r"^[\[{]|[\]}]$"), r"\[[^\[\]]*\]"), r"\{[^{}]*\}")


def _flow_entries(section: str) -> str:
    return f"filter(split({_without_inner(section)}, ',', -1), x -> trim(x) <> '')"


def _indent(line: str) -> str:
    return f"length(regexp_extract({line}, '^( *)', 1))"


def _first_level(section: str) -> str:
    first = _indent(f"get({section}.children, 0)")
    return f"filter({section}.children, x -> {_indent('x')} = {first})"


def _form(section: str) -> str:
    first = f"get({section}.children, 0)"
    return (
        f"case when {section} is null then 'absent' "
        f"when startswith({section}.rest, '[') then 'flow list' "
        f"when startswith({section}.rest, '{{') then 'flow map' "
        f"when {section}.rest <> '' then 'scalar' "
        f"when {first} is null then 'empty' "
        f"when ltrim({first}) rlike '^-(?: |$)' then 'block list' else 'block map' end"
    )


def _triggers(section: str, form: str) -> str:
    names = (
        f"case when {form} = 'scalar' then array({_unquote(f'{section}.rest')}) "
        f"when {form} in ('flow list', 'flow map') then "
        f"transform({_flow_entries(section)}, e -> {_item_name('e')}) "
        f"when {form} in ('block list', 'block map') then "
        f"transform({_first_level(section)}, e -> {_item_name('e')}) end"
    )
    return f"coalesce(filter({names}, n -> n <> ''), cast(array() as array<string>))"


def _contents(section: str, form: str) -> str:
    entries = (
        f"case when {form} = 'flow map' then {_flow_entries(section)} "
        f"when {form} = 'block map' then {_first_level(section)} end"
    )
    found = f"get(filter({entries}, e -> e rlike {literal(_CONTENTS)}), 0)"
    return f"coalesce(regexp_extract({found}, {literal(_CONTENTS)}, 1), '')"


def _document(content: str, outer: str) -> str:
    """The first document of a file; each step only where it is needed."""
    text = f"if(startswith({content}, {literal(_MARK)}), substr({content}, 2), {content})"
    text = f"if(contains({content}, '%') and {content} rlike {literal(_DIRECTIVE_FIRST)}, {_replace(text, _DIRECTIVES)}, {text})"
    framed = f"contains({content}, '---') or contains({content}, '\\n...')"
    bare = f"regexp_replace(regexp_replace({text}, {literal(_OPENING)}, '$1'), {literal(_ENDING)}, '')"
    marks = " or ".join(f"contains({outer}, {literal(m)})" for m in ("---", "...", "%"))
    return f"if(startswith({content}, {literal(_MARK)}) or {marks}, if({framed}, {bare}, {text}), {content})"


def _is_flow(doc: str) -> str:
    """The pattern is tried only where the first letter allows it."""
    blanks = ' ' + chr(9) + chr(13) + chr(10)
    # Most documents begin with a letter, which tells it without a look at the rest.
    possible = f"ascii({doc}) in ({', '.join(str(ord(c)) for c in blanks + '{#')})"
    return f"({possible} and left(ltrim({literal(blanks)}, {doc}), 1) in ('{{', '#') and {doc} rlike {literal(flow.START)})"


def _as_block(doc: str, is_flow: str, outer: str) -> str:
    """The document with long quoted values on one line; nothing of a flow mapping, which ``flow`` reads."""
    quoted = f"regexp_replace({doc}, {literal(_LONG_QUOTE)}, {literal('$1' + chr(34) * 2)})"
    open_quote = " or ".join(f"contains({doc}, {literal(': ' + q)})" for q in ('"', "'"))
    possible = f"{outer} rlike {literal(_QUOTE_OPENS)}"
    return f"case when {is_flow} then '' when {possible} and ({open_quote}) then {quoted} else {doc} end"


def _nested_flow(key: str, section: str, form: str) -> str:
    """What ``flow`` finds in a flow section whose commas do not tell its entries apart; else null."""
    text = _flow_text(section)
    hard = f"({_without_inner(section)} rlike '[{{}}\\\\[\\\\]]' or {text} rlike {literal(_QUOTED_SEPARATOR)})"
    return f"case when startswith({form}, 'flow') then if({hard}, {flow.read(f"concat('{{{key}: ', {text}, '}}')")}, null) end"


def with_header(files: DataFrame, content: str = "content", out: str = "header") -> DataFrame:
    """Add ``out``: struct(parse_ok, permissions_form, contents, triggers)."""
    keep = [f"`{c}`" for c in files.columns]
    fields = ", ".join(f"'{f}', {HEADER}{f}" for f in FIELDS)
    return with_fields(files, content).selectExpr(*keep, f"named_struct({fields}) as {out}")


def with_fields(files: DataFrame, content: str = "content", lines: str | None = None) -> DataFrame:
    """Add the fields of the header as columns ``_header_<field>``; what is not used is not computed.

    ``lines`` names a column that holds the lines of the content, if there is one.

    The stages are separate projections so that each shared part is computed
    once for a row; none of them moves rows between tasks. The content is read once
    for its lines without indent, and again only for sections that are there.
    """
    keep = [f"`{c}`" for c in files.columns]
    top = f"filter({split_lines('_bare')}, x -> not x rlike {literal(_BLANK)})"
    named = f"transform(_top, x -> regexp_extract(x, {literal(_KEY)}, 1))"
    # Few keys are quoted.
    keys = f"""filter(transform(_named, k -> if(contains(k, '"') or contains(k, "'"), {_unquote('k')}, trim(k))), k -> k <> '')"""
    strange = f"size(filter(_top, (x, i) -> get(_named, i) = '' and not x rlike {literal(_OTHER)})) > 0"
    sections = {"_on": "on", "_perm": "permissions"}
    found = {
        "parse_ok": ("ok", "_ok"),
        "permissions_form": ("permissions_form", "_perm_form"),
        "contents": ("contents", f"coalesce(_perm_flow.contents, {_contents('_perm', '_perm_form')})"),
        "triggers": ("triggers", f"coalesce(_on_flow.triggers, {_triggers('_on', '_on_form')})"),
    }
    return (
        files.selectExpr(*keep, f"{_outer(lines or split_lines(content))} as _outer")
        .selectExpr(*keep, "_outer", f"{_document(content, '_outer')} as _raw")
        .selectExpr(*keep, "_outer", "_raw", f"{_is_flow('_raw')} as _is_flow")
        .selectExpr(
            *keep, "_outer", f"{_as_block('_raw', '_is_flow', '_outer')} as _doc",
            f"if(_is_flow, {flow.read('_raw')}, null) as _flow",
        )
        .selectExpr(*keep, "_doc", "_flow", f"if(_doc = {content}, _outer, {_outer(split_lines('_doc'))}) as _bare")
        .selectExpr(*keep, "_doc", "_flow", f"{top} as _top")
        .selectExpr(*keep, "_doc", "_flow", "_top", f"{named} as _named")
        .selectExpr(
            *keep, "_doc", "_flow", f"{keys} as _keys",
            f"{content} <> '' and not {strange} and not "
            f"coalesce(get(_top, 0) rlike {literal('^-(?:[ \t\r]|$)')}, false) as _well_formed",
        )
        .selectExpr(
            *keep, "_flow",
            "_well_formed and size(_keys) = size(array_distinct(_keys)) as _ok",
            *[
                f"if(array_contains(_keys, '{key}'), {_section('_doc', key)}, '') as {n}_text"
                for n, key in sections.items()
            ],
        )
        .selectExpr(
            *keep, "_ok", "_flow",
            *[f"if({n}_text = '', null, split({n}_text, '\n', -1)) as {n}_lines" for n in sections],
        )
        .selectExpr(*keep, "_ok", "_flow", *[f"{_rest_and_children(f'{n}_lines')} as {n}" for n in sections])
        .selectExpr(*keep, "_ok", "_flow", *sections, *[f"{_form(n)} as {n}_form" for n in sections])
        .selectExpr(
            *keep, "_ok", "_flow", *sections, *[f"{n}_form" for n in sections],
            *[f"{_nested_flow(key, n, f'{n}_form')} as {n}_flow" for n, key in sections.items()],
        )
        .selectExpr(*keep, *[f"if(_flow is null, {block}, _flow.{f}) as {HEADER}{n}" for n, (f, block) in found.items()])
    )
