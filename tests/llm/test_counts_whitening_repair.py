"""Token counts, whitening and conversation repair beside brute force, and on edge cases."""

import hashlib
import re
import sys
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pytest
from tokenizers import Tokenizer

from gatewarden.llm import repair, token_counts, whitening
from gatewarden.llm.catalog import QUERIES

SF = "/root/testdata/sf0.001"


# --- token counts

@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(token_counts.TOKENIZER)


@pytest.fixture(scope="module")
def counter():
    return token_counts.counter(token_counts.TOKENIZER, token_counts.public_tokenizers.PATTERN)


def n_tokens(library, text):
    return len(library.encode(text or "", add_special_tokens=False).ids)


def test_op11(spark, library):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = QUERIES["op11_token_counts"](spark, SF).collect()
    assert len(got) == len(texts)
    for r in got:
        n = n_tokens(library, texts[r.doc_id])
        assert tuple(r) == (r.doc_id, len((texts[r.doc_id] or "").encode()), n, n > 512)


AWKWARD = [
    "", " ", "<|endoftext|>", "a<|endoftext|><|endoftext|> b", "<|endoftext", "it's we'll 'sx 're''d  \n\n  x  ", "a" * 5_000, "ab" * 4_000,
    " " * 3_000 + "x", "é" * 700, "日本語 İ ß ퟿ 🙂🙂", "\x1c a \x85 b\xa0 c\x0b", "x₏y \U000187f9z 12", "²³ ½x ªº", "͸ q",
    "".join(map(chr, range(32, 3_000))), "\x00\x01", unicodedata.normalize("NFD", "é à ü"),
]


@pytest.mark.parametrize("text", AWKWARD, ids=range(len(AWKWARD)))
def test_counts_equal_the_library(library, counter, text):
    assert counter.count(text) == n_tokens(library, text)


def test_counts_on_random_characters(library, counter):
    rng = np.random.default_rng(3)
    letters = list("abcXYZ'stredlvm  \n\t0123.,!?é²ßªµÀ\x0b\x1c\x85\xa0") + ["日", "İ", "é", "🙂", "<|endoftext|>", " ", "Ⅷ", "₏"]
    for _ in range(600):
        text = "".join(rng.choice(letters, size=rng.integers(0, 60)))
        assert counter.count(text) == n_tokens(library, text), text


def test_characters_new_to_the_library_are_left_to_it(library, counter):
    """Every character is split as by the library (a sample of one in nineteen here)."""
    for c in map(chr, range(5, 0x110000, 19)):
        if not "\ud800" <= c < "":
            text = f"x{c}7{c}!{c} {c}y"
            assert counter.split(text) == [text[a:b] for _, (a, b) in library.pre_tokenizer.pre_tokenize_str(text)], hex(ord(c))


def test_merges_follow_rank_then_place(counter):
    def slow(data):
        part, merges = [counter.symbols[b] for b in data], 0
        while True:
            pairs = [(counter.pairs[k], i) for i, (a, b) in enumerate(zip(part, part[1:])) if (k := a << token_counts.SYMBOL | b) in counter.pairs]
            if not pairs:
                return len(data) - merges
            rank, i = min(pairs)
            part[i : i + 2] = [counter.joined[rank]]
            merges += 1

    rng = np.random.default_rng(4)
    for _ in range(300):
        word = "".join(rng.choice(list("the andiong"), size=rng.integers(1, 30))).encode()
        assert counter.merged(word) == slow(word)


def test_counts_on_edge_rows(spark, library):
    rows = [(1, None), (2, ""), (None, "some words"), (1, "some words"), (1, "some words"), (3, "word runs " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "'x' AS n_tokens", "1 AS start", "2 AS names")
    out = token_counts.count_tokens(docs)
    assert out.columns == ["doc_id", "text", "start", "names", "n_tokens"]
    assert sorted(((r.doc_id, r.n_tokens) for r in out.collect()), key=str) == sorted(((i, n_tokens(library, t)) for i, t in rows), key=str)
    assert token_counts.count_tokens(docs.limit(0)).count() == 0


def test_other_vocabularies_are_refused():
    with pytest.raises(ValueError):
        token_counts.Counter(token_counts.public_tokenizers.path("word_bpe_49k.json"), token_counts.public_tokenizers.PATTERN)


# --- whitening

def spectra():
    rng = np.random.default_rng(0)
    q = np.linalg.qr(rng.normal(size=(30, 30)))[0]
    some = rng.normal(size=(500, 64)) * rng.uniform(0.1, 30, 64)
    low = rng.normal(size=(4, 40))
    return {
        "covariance": np.cov(some.T), "one": np.array([[3.0]]), "zero": np.zeros((5, 5)), "identity": np.eye(7) * 3, "swap": np.array([[0, 1.0], [1, 0]]),
        "repeated": np.diag([1, 1, 1, 2, 2, 5.0]), "low rank": low.T @ low, "clusters": q @ np.diag([1e6] * 3 + [1.0] * 20 + [1e-6] * 7) @ q.T,
        "graded": q @ np.diag(np.logspace(0, -15, 30)) @ q.T, "ones": np.ones((8, 8)), "near": np.diag([1, 1 + 1e-15, 1 + 3e-15, 1.0]),
        "blocks": np.kron(np.eye(4), np.array([[2, 1.0], [1, 2]])), "mixed signs": q @ np.diag(np.linspace(-3, 3, 30)) @ q.T,
    }


@pytest.mark.parametrize("name", list(spectra()))
def test_spectrum(name):
    a = spectra()[name]
    values, vectors = whitening.spectrum(a)
    size = max(np.abs(a).max(), 1e-300) * len(a)
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() <= 1e-14 * size
    assert np.abs(vectors.T @ vectors - np.eye(len(a))).max() < 1e-13 and np.abs(a @ vectors - vectors * values).max() <= 1e-13 * size


def test_polar_factor():
    a = np.random.default_rng(1).normal(size=(40, 40))
    u = whitening.polar(a)
    s, _, t = np.linalg.svd(a)
    assert np.abs(u.T @ u - np.eye(40)).max() < 1e-13 and np.abs(u - s @ t).max() < 1e-11


def expected_whitening(rows, k=4):
    x = {i: np.floor(256 * np.array(v, float)).astype(object) for i, v in enumerate(v for _, v in rows)}
    fit = np.unique(np.array([v.astype(np.int64) for v in x.values()]), axis=0)
    n, sums = len(fit), fit.sum(0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    white = {i: (v.astype(float) - sums / n) @ vectors / np.sqrt(values) for i, v in x.items()}
    deviation = {i: sum((n * int(a) - int(s)) ** 2 for a, s in zip(v, sums)) for i, v in x.items()}
    return n, values / np.trace(centred.T @ centred / n), white, deviation


def check_whitening(rows, got):
    n, explained, white, deviation = expected_whitening(rows)
    k = len(next(iter(white.values())))
    ids = [i for i, _ in rows]
    assert len(got) == k * len(rows) and len(set(ids)) == len(ids)
    found = {(r.vec_id, r.component): r for r in got}
    for c in range(k):
        sign = np.sign(sum(found[i, c + 1].whitened * white[at][c] for at, i in enumerate(ids)))
        for at, i in enumerate(ids):
            r = found[i, c + 1]
            assert (r.n, r.deviation) == (n, deviation[at]) and abs(r.whitened - sign * white[at][c]) < 1e-9
            assert abs(r.explained / explained[c] - 1) < 1e-9 and r.identity_error < 1e-9


def test_op12(spark):
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{SF}/embeddings.parquet").collect()]
    check_whitening(rows, QUERIES["op12_whitening"](spark, SF).collect())


def test_whitening_with_a_hot_vector_and_several_tasks(spark):
    rng = np.random.default_rng(6)
    rows = [(i, [1.0, -0.5, 0.25, 7.0, 0.0] if i % 3 else (rng.normal(size=5) * [9, 5, 3, 2, 1]).tolist()) for i in range(3_000)]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>").repartition(7)
    check_whitening(rows, whitening.components_of(table).collect())


def test_whitening_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(1, [1.0, 2.0]), (2, None), (3, []), (4, [nan, 1.0]), (5, [None, 1.0]), (6, [inf, 1.0]), (7, [0.5, -0.0]), (7, [0.5, -0.0]), (None, [3.0, 1.0]),
            (9, [1.0, 2.0, 3.0]), (10, [-0.001, 5.0])]
    table = spark.createDataFrame(rows, "vec_id long, vector array<double>").selectExpr("*", "1 AS x", "2 AS dim", "3 AS n", "4 AS whitened", "5 AS copies")
    got = whitening.components_of(table).collect()
    assert sorted({str(r.vec_id) for r in got}) == ["1", "10", "7", "None"] and len(got) == 10 and {r.n for r in got} == {4}
    assert all(r.identity_error < 1e-12 for r in got) and abs(sum({r.component: r.explained for r in got}.values()) - 1) < 1e-12
    assert whitening.components_of(table.limit(0)).count() == 0 and whitening.components_of(table.where("vec_id = 2")).count() == 0
    one = whitening.components_of(table.where("vec_id = 7")).collect()  # no variance at all
    assert [(r.whitened, r.deviation, r.explained, r.identity_error) for r in one] == [(0.0, 0, 0.0, 0.0)] * 4
    huge = spark.createDataFrame([(1, [1e300, 1.0]), (2, [-1e300, 2.0]), (3, [1e12, 1.0])], "vec_id long, vector array<double>")
    assert {r.vec_id: r.deviation for r in whitening.components_of(huge).collect()} == {1: None, 2: None, 3: None}


# --- conversation repair

WHITE = " \t\n\x0b\x0c\r"


def damaged(rows):
    out = {}
    for conv, turn, role, text in rows:
        show = lambda v: " " if v is None else str(v)
        role, text = show(role), show(text)
        fate = zlib.crc32(f"{show(conv)}:{show(turn)}".encode()) % 20
        held = out.setdefault(conv, [])
        if fate == 0:
            continue
        text = "" if fate == 1 else re.sub("[.!?]", "", text) if fate == 2 else text
        held += [(turn, "user" if fate == 4 else role, text)] * (1 + (fate == 3))
    return {c: sorted(rs, key=lambda r: (r[0] is not None, r[0] or 0, r[1], r[2])) for c, rs in out.items()}


def faults_of(rows):
    seen, out = set(), []
    for _, role, text in rows:
        inner = text.strip(WHITE)
        out.append("blank" if not inner else "duplicate" if (role, text) in seen else "truncated" if inner[-1] not in ".!?" else "")
        seen.add((role, text))
    return out


def cheapest(rows):
    """Cost, audit and lines of the least (cost, audit) of all edits, by search."""
    faults = faults_of(rows)
    sys.setrecursionlimit(20_000)

    @lru_cache(None)
    def best(at, want, before_pair, inserted):
        # want: initials that may come next; before_pair: nothing but at most one s so far
        options = [(0, "", ())] if at == len(rows) and want in ("su", "u0") and (want == "su" or before_pair == 0) else []

        def then(role):
            return ("a", 0) if role == "user" else ("u0", 0)

        role_wanted = "assistant" if want == "a" else "user"
        if inserted < 2:
            cost, audit, lines = best(at, *then(role_wanted), inserted + 1)
            options.append((cost + 3, "I" + audit, (f"{role_wanted}:", *lines)))
        if at < len(rows):
            _, role, text = rows[at]
            cost, audit, lines = best(at + 1, want, before_pair, 0)
            options.append((cost + 4, "D" + audit, lines))
            if faults[at] not in ("blank", "duplicate"):
                extra = 3 * (faults[at] == "truncated")
                cost, audit, lines = best(at + 1, *then(role_wanted), 0)
                options.append((cost + 3 + extra, "R" + audit, (f"{role_wanted}:{text}", *lines)))
                if role[:1] == role_wanted[0]:
                    options.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
                if role[:1] == "s" and want == "su":
                    cost, audit, lines = best(at + 1, "u1", 1, 0)
                    options.append((cost + extra, "K" + audit, (f"{role}:{text}", *lines)))
        return min(options, default=(10**9, "", ()))

    return best(0, "su", 0, 0)


def expected_repair(rows):
    out = {}
    for conv, held in damaged(rows).items():
        faults, turns = faults_of(held), [t for t, _, _ in held if t is not None]
        cost, audit, lines = cheapest(held)
        initials = [r[:1] for _, r, _ in held]
        out[conv] = (
            max(turns) - min(turns) + 1 - len(set(turns)) if turns else 0, *(faults.count(f) for f in ("blank", "duplicate", "truncated")),
            sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:])), cost, audit, hashlib.sha256("\n".join(lines).encode()).hexdigest())
    return out


def random_conversations(n, seed):
    rng, rows = np.random.default_rng(seed), []
    roles = ["user", "assistant", "system", "tool", "", None, "Users", "admin", "user", "assistant"]
    texts = ["yes.", "no", "so!", " ", "", None, "yes. \n", "é", "what?\t", " ", "long " * 50 + "."]
    for conv in range(n):
        for turn in range(int(rng.integers(1, 9))):
            turn = [turn, turn, turn, 3, None, 40][int(rng.integers(0, 6))]
            rows.append((None if conv == 0 else conv, turn, *(v[int(rng.integers(0, len(v)))] for v in (roles, texts))))
    return rows


def run_repair(spark, rows):
    table = spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").selectExpr(
        "*", "'x' AS copies", "'x' AS symbol", "'x' AS digest", "'x' AS fate", "'x' AS kind")
    out = repair.repaired_conversations(repair.damage(table.repartition(5))).collect()
    assert len({r.conv_id for r in out}) == len(out)
    return {r.conv_id: tuple(r)[1:] for r in out}


def test_op13_beside_a_search(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    got = {r.conv_id: tuple(r)[1:] for r in QUERIES["op13_repair"](spark, SF).collect()}
    assert got == expected_repair(rows)


def test_repair_of_random_conversations(spark):
    rows = random_conversations(400, 2)
    assert run_repair(spark, rows) == expected_repair(rows)


def test_repair_of_a_conversation_over_many_tasks(spark, monkeypatch):
    """One conversation holds most rows, also as repeats of one row; ranges cut through it."""
    monkeypatch.setattr(repair, "TASK_ROWS", 40)
    rng = np.random.default_rng(5)
    rows = [(7, i, str(rng.choice(["user", "assistant"])), f"text {i % 90} {'.' if i % 4 else ''}") for i in range(600)]
    rows += [(7, 700, "user", "again and again.")] * 200 + [(8, i, "user", "same.") for i in range(50)] + random_conversations(30, 4)
    assert run_repair(spark, rows) == expected_repair(rows)


def test_repair_without_damage_and_of_nothing(spark):
    schema = "conv_id long, turn long, role string, text string"
    rows = [(1, 0, "system", "be kind."), (1, 1, "user", "a."), (1, 2, "assistant", "b."), (2, 0, "assistant", "late."), (3, 5, "user", "x" * 300_000 + ".")]
    table = repair.with_symbols(repair.undamaged(spark.createDataFrame(rows, schema)))
    plans = repair.plan(table)
    assert {r.conv_id: (r.cost, r.audit) for r in plans.collect()} == {1: (0, "KKK"), 2: (3, "IK"), 3: (3, "KI")}
    lines = repair.repair(table, plans).orderBy("conv_id", "place").collect()
    assert [(r.conv_id, r.edit, r.role, len(r.text)) for r in lines] == [
        (1, "K", "system", 8), (1, "K", "user", 2), (1, "K", "assistant", 2), (2, "I", "user", 0), (2, "K", "assistant", 5),
        (3, "K", "user", 300_001), (3, "I", "assistant", 0)]
    assert run_repair(spark, []) == {}


def test_automaton_makes_each_suffix_once():
    rng = np.random.default_rng(9)
    backward = sorted({"".join(rng.choice(list("suaoxSUAO"), size=rng.integers(0, 7))) for _ in range(3_000)})
    automaton = repair.SuffixAutomaton()
    audits = {b: automaton.repair(b) for b in backward}
    assert automaton.made == len({b[:k] for b in backward for k in range(1, len(b) + 1)})
    for b in backward[::37]:
        alone = repair.SuffixAutomaton()
        assert alone.repair(b) == audits[b]


def test_long_signature():
    cost, audit = repair.SuffixAutomaton().repair("ua" * 50_000)
    assert len(audit) >= 100_000 and cost == 6
