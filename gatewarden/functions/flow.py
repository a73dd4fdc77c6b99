"""Flow collections of a workflow document, read token by token with a stack.

The text is cut into tokens by one pattern and folded once with ``aggregate``. The state
is the stack of open brackets, the place inside the current entry, and what the audit
needs: the keys at top level, the names below ``on``, the form of ``permissions`` and its
``contents``. So any depth is read, and the work grows with the number of tokens.

A quoted key needs no blank behind its colon (as in JSON), a plain one does. Anchors,
aliases and tags are skipped. Certainly invalid are brackets that do not match or stay
open, quotes that stay open, and text behind the collection; whatever else is
unusual counts as valid.
"""

from __future__ import annotations

from gatewarden.functions.sql import literal

#: A document that is a flow mapping: blanks and comments, then the bracket.
START = r"\A(?:[ \t\r\n]++|#[^\n]*+\n)*+\{"
_DOUBLE = r'"(?:[^"\\]|\\.)*+"'
_SINGLE = r"'(?:[^']|'')*+'"
# A plain scalar goes on over blanks unless an indicator or a comment follows them.
_IN_PLAIN = r"(?:[^\s,\[\]{}:]|:(?=[^\s,\[\]{}]))"
_PLAIN = r"(?:[^\s,\[\]{}:\"']|:(?=[^\s,\[\]{}]))(?:\s*+(?!(?<=\s)#)" + _IN_PLAIN + ")*+"
# In order: comment, anchor or tag, quoted key, quoted, bracket or comma, plain, colon, any other.
TOKEN = (
    r"(?s)(?<!\S)#[^\n]*+|[&!][^\s,\[\]{}]*+|(?:" + _DOUBLE + "|" + _SINGLE + r")\s*+:|" + _DOUBLE + "|" + _SINGLE
    + r"|[\[\]{},]|" + _PLAIN + r"|:|[^\s]"
)
#: Tokens that are folded at a time. ``aggregate`` copies its state at every step, so the lists of what was
#: found so far stay out of the inner state.
CHUNK = 1024
_FOUND = ("keys", "names")


def _kind(token: str) -> str:
    first, last = f"left({token}, 1)", f"right({token}, 1)"
    return (
        f"case when {token} in ('{{', '[') then 'open' when {token} in ('}}', ']') then 'close' "
        f"when {token} in (',', ':') then {token} "
        f"when {token} in ('\"', '\\'') then 'bad' "
        f"when {first} in ('\"', '\\'') and {last} = ':' then 'key' else 'scalar' end"
    )


def _text(token: str) -> str:
    quoted = f"regexp_replace({token}, {literal(r'^["' + chr(39) + r']|["' + chr(39) + r']\s*:?$')}, '')"
    return f"if(left({token}, 1) in ('\"', '\\''), {quoted}, {token})"


def _with(held: str, when: str, value: str) -> str:
    return f"if({when}, array_append({held}, {value}), {held})"


def read(text: str) -> str:
    """SQL for struct(ok, permissions_form, contents, triggers) of a flow mapping."""
    tokens = f"filter(regexp_extract_all({text}, {literal(TOKEN)}, 0), t -> left(t, 1) not in ('#', '&', '!'))"
    typed = f"transform({tokens}, t -> named_struct('kind', {_kind('t')}, 'text', {_text('t')}))"
    nothing = "cast(array() as array<string>)"
    start = {
        "stack": "''", "depth": "0", "colon": "false", "last": "''", "top": "''", "sub": "''", "form": "'absent'", "contents": "''",
        "begun": "false", "bad": "false", **dict.fromkeys(_FOUND, nothing),
    }
    ends, is_key = "t.kind in (',', 'close')", "t.kind in (':', 'key')"
    name = "if(t.kind = 'key', t.text, s.last)"
    alone = f"{ends} and not s.colon and s.last <> ''"  # an entry without a colon: an item, or a key without a value
    value = f"{ends} and s.colon"
    opener = "if(t.text = '}', '{', '[')"
    fields = {
        "stack": "case t.kind when 'open' then concat(t.text, s.stack) when 'close' then substr(s.stack, 2) else s.stack end",
        "depth": "s.depth + case t.kind when 'open' then 1 when 'close' then -1 else 0 end",
        "colon": f"case when {is_key} or t.kind = 'close' then true when t.kind in ('open', ',') then false else s.colon end",
        "last": "if(t.kind = 'scalar', t.text, '')",
        "top": f"case when s.depth <> 1 then s.top when {is_key} then {name} when {ends} then '' else s.top end",
        "sub": f"case when s.depth <> 2 then s.sub when {is_key} then {name} when {ends} then '' else s.sub end",
        "keys": _with("s.keys", f"s.depth = 1 and ({is_key} or {alone})", name),
        "names": _with("s.names", f"s.top = 'on' and (s.depth = 2 and ({is_key} or {alone}) or s.depth = 1 and {value} and s.last <> '')", name),
        "form": (
            "case when s.depth <> 1 or s.top <> 'permissions' or s.form <> 'absent' then s.form "
            "when t.kind = 'open' then if(t.text = '{', 'flow map', 'flow list') "
            f"when {ends} then if(s.last = '', 'empty', 'scalar') else s.form end"
        ),
        "contents": (
            f"if(s.depth = 2 and s.top = 'permissions' and s.sub = 'contents' and s.contents = '' and left(s.stack, 1) = '{{' and {value}, "
            "s.last, s.contents)"
        ),
        "bad": (
            "s.bad or t.kind = 'bad' or s.depth = 0 and (s.begun or t.kind <> 'open') "
            f"or t.kind = 'close' and left(s.stack, 1) <> {opener}"
        ),
        "begun": "true",
    }
    struct = lambda values: "named_struct(" + ", ".join(f"'{k}', {v}" for k, v in values.items()) + ")"
    # a chunk begins with what is known by then, but with empty lists, and its lists are put behind the earlier ones
    begin = struct({k: nothing if k in _FOUND else f"a.{k}" for k in start})
    joined = struct({k: f"concat(a.{k}, b.{k})" if k in _FOUND else f"b.{k}" for k in start})
    chunk = f"aggregate(slice(ts, c * {CHUNK} + 1, {CHUNK}), {begin}, (s, t) -> {struct({k: fields[k] for k in start})}, b -> {joined})"
    result = struct({
        "ok": "not e.bad and e.depth = 0 and size(e.keys) = size(array_distinct(e.keys))", "permissions_form": "e.form",
        "contents": "if(e.contents rlike '^[A-Za-z-]+$', e.contents, '')", "triggers": "filter(e.names, n -> n <> '')"})
    folded = f"aggregate(sequence(0, size(ts) div {CHUNK}), {struct(start)}, (a, c) -> {chunk}, e -> {result})"
    return f"get(transform(array({typed}), ts -> {folded}), 0)"
