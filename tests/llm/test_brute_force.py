"""Registered queries on the given tables beside brute-force versions and SQL."""

import base64
import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from compare import compare, connect
from gatewarden.llm import bpe, near_dedup, neighbours, suffix_dedup, token_store, toxicity
from gatewarden.llm.catalog import ORACLE, QUERIES

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def documents(spark):
    return [(r.doc_id, r.text or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]


@pytest.mark.parametrize("name", list(ORACLE))
def test_query_with_sql(spark, name):
    ok, note = compare(spark, connect(SF), SF, QUERIES[name], ORACLE[name])
    assert ok, note


def repeated(texts):
    """Removed places of each text, by looking every string up."""
    seen = Counter(t[i : i + 400] for t in texts for i in range(len(t) - 399))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - 399):
            if seen[t[i : i + 400]] > 1:
                gone[i : i + 400] = True
        out.append(gone)
    return out


def cleaned(docs, **sizes):
    return {r.doc_id: (bytes(r.kept), [(s.start, s.end) for s in r.spans]) for r in suffix_dedup.remove_repeats(docs, **sizes).collect()}


def expected(rows):
    texts = [t.encode() for _, t in rows]
    out = {}
    for (i, _), t, gone in zip(rows, texts, repeated(texts), strict=True):
        edges = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(int), [0])))).reshape(-1, 2).tolist()
        out[i] = (np.frombuffer(t, np.uint8)[~gone].tobytes(), [tuple(e) for e in edges])
    return out


def test_op1(spark, documents):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    want = expected(documents)
    assert cleaned(docs) == want
    assert cleaned(docs, chunk_bytes=20_000, range_suffixes=40) == want


def test_op1_on_overlapping_passages(spark):
    """Passages cut, shifted, edited and repeated within a text; left and right parts from different texts."""
    rng = np.random.default_rng(8)
    base = ["".join(rng.choice(list("abcdefgh "), 3_000)) for _ in range(4)]
    rows = []
    for i in range(80):
        cut = [b[a : a + int(rng.integers(100, 900))] for b in base for a in [int(rng.integers(0, 2_500))]]
        rows.append((i, "".join(rng.permutation(cut)) + "é" * int(rng.integers(0, 3))))
    rows += [(100, "Shti " * 300), (101, "x" * 399), (102, "x" * 399), (103, "y" * 401), (104, "ab" * 1_000), (105, "")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    want = expected(rows)
    assert cleaned(docs) == want
    assert cleaned(docs.repartition(5), chunk_bytes=5_000, range_suffixes=10) == want


def test_op1_with_a_third_of_equal_rows(spark):
    """Every suffix of the copies occurs once for each of them."""
    rng = np.random.default_rng(5)
    word = lambda n: "".join(rng.choice(list("klmnopqrst "), n))
    copy = word(900)
    rows = [(i, copy) for i in range(60)] + [(100 + i, word(700)) for i in range(110)]
    rows += [(300 + i, word(50 + i) + copy[i * 20 : i * 20 + 380 + 5 * i] + word(30)) for i in range(10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    want = expected(rows)
    for sizes in ({}, {"chunk_bytes": 6_000, "range_suffixes": 30}):
        assert cleaned(docs, **sizes) == want


def test_op1_rows_follow_groups_of_chunks(spark):
    """A bucket gets a row from a group, not from each chunk; a group is bounded by bytes as well."""
    rng = np.random.default_rng(6)
    texts = ["".join(rng.choice(list("abcdefgh "), n)) for n in [3_000] * 40 + [60_000, 3_000, 3_000]]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").coalesce(1)
    chunks = docs.mapInArrow(lambda batches: suffix_dedup._pack(batches, 3_000), suffix_dedup.CHUNK).cache()
    groups = [r.chunk >> suffix_dedup.GROUP_BITS for r in chunks.orderBy("chunk").collect()]
    assert groups == [0] * 16 + [1] * 16 + [2] * 9 + [3] * 2
    cores = chunks.select("chunk", "sizes", "data").mapInArrow(suffix_dedup._cores(3), suffix_dedup.CORES)
    assert sorted((r.grp, r.bucket) for r in cores.collect()) == [(g, b) for g in range(4) for b in range(3)]
    copies = docs.union(docs.selectExpr("doc_id + 100", "text")).repartition(3)
    assert all(kept == b"" for kept, _ in cleaned(copies, chunk_bytes=3_000, range_suffixes=200).values())


def test_merge_of_runs():
    rng = np.random.default_rng(2)
    for k in (0, 1, 2, 5, 8):
        runs = []
        for _ in range(k):
            strings = sorted("".join(rng.choice(list("ab"), rng.integers(0, 12))).encode() for _ in range(int(rng.integers(0, 40))))
            runs.append((strings, [suffix_dedup.common(a, b) for a, b in zip([b"", *strings], strings)]))
        out = [(runs[r][0][i], h) for r, i, h in suffix_dedup.merge(runs)]
        flat = sorted(s for strings, _ in runs for s in strings)
        assert [s for s, _ in out] == flat
        assert [h for _, h in out] == [suffix_dedup.common(a, b) for a, b in zip([b"", *flat], flat)]


def test_op2(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet").select("vec_id", "embedding").collect()
    ids, vectors = np.array([r.vec_id for r in table]), np.array([r.embedding for r in table], float)
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    got = defaultdict(dict)
    for r in QUERIES["op2_neighbours"](spark, SF).collect():
        got[r.query_id][r["rank"]] = (r.vec_id, r.score)
    hits = total = 0
    for i in np.flatnonzero(ids % 50 == 0):
        scores = unit @ unit[i]
        scores[i] = -2
        best = sorted(range(len(ids)), key=lambda j: (-scores[j], ids[j]))[:5]
        hits += len({ids[j] for j in best} & {v for v, _ in got[ids[i]].values()})
        total += 5
        assert [got[ids[i]][k][1] for k in range(1, 6)] == sorted((s for _, s in got[ids[i]].values()), reverse=True)
    assert hits >= 0.9 * total


def test_op2_graph_finds_nearest_lists():
    rng = np.random.default_rng(4)
    points = rng.normal(size=(8_000, 24)).astype(np.float32)
    points /= np.linalg.norm(points, axis=1, keepdims=True)
    centroids = neighbours.halve(points, 256)
    sizes = np.bincount(((points[:, None] - centroids[None]) ** 2).sum(2).argmin(1), minlength=256)
    assert len(centroids) == 256 and sizes.max() < 12 * sizes.mean()
    found, _ = neighbours.CentroidGraph(centroids).search(points[:300], 8)
    true = np.argsort(((points[:300, None] - centroids[None]) ** 2).sum(2), axis=1)[:, :8]
    assert np.mean([len(set(a) & set(b)) / 8 for a, b in zip(found, true)]) > 0.97


def test_op2_ties_and_hot_list(spark):
    rows = [(i, [1.0, 2.0, 3.0] if i % 3 else [float(i), 1.0, -1.0]) for i in range(9_000)]
    table = spark.createDataFrame(rows, "id long, vector array<double>")
    got = defaultdict(list)
    for r in neighbours.search(table, table.where("id % 500 = 1")).orderBy("query_id", "rank").collect():
        got[r.query_id].append(r.vec_id)
    for q, found in got.items():
        same = [i for i in range(9_000) if (i % 3 != 0) == (q % 3 != 0) and i != q]
        assert q % 3 == 0 or found == same[:5]


def test_op3(spark, documents):
    ranks = bpe.vocabulary(bpe.VOCABULARY, public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    got = {r.doc_id: tuple(r)[1:] for r in QUERIES["op3_bpe"](spark, SF).collect()}
    for i, t in documents:
        ids = library.encode_ordinary(t)
        assert got[i] == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256(t.encode()).hexdigest())


def test_op6_held_out_accuracy(spark):
    sf = "/root/testdata/sf0.01"
    rows = QUERIES["op6_toxicity"](spark, sf).where("held_out").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id").collect()
    assert all(zlib.crc32(str(r.doc_id).encode()) % 3 == 1 for r in rows)
    toxic, clean = ([r for r in rows if r.toxic == v] for v in (1, 0))
    assert sum(r.predicted for r in toxic) >= 0.6 * len(toxic)
    assert sum(r.predicted for r in clean) <= 0.03 * len(clean)


def test_op7(spark, documents):
    library = Tokenizer.from_file(token_store.TOKENIZER)
    got, start = {r.doc_id: tuple(r)[1:] for r in QUERIES["op7_token_store"](spark, SF).collect()}, 0
    for i, t in sorted(documents):
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        assert got[i] == (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)


def near_classes(rows):
    """Least id of each component of pairs that share enough, by an index of runs."""
    bags = {i: near_dedup.bag(t) for i, t in rows}
    holders, least = defaultdict(list), {i: i for i in bags}
    for i, b in bags.items():
        for run in b:
            holders[run].append(i)

    def find(x):
        while least[x] != x:
            x = least[x]
        return x

    for i, b in bags.items():
        for j in {j for run in b for j in holders[run] if j < i}:
            shared = sum((b & bags[j]).values())
            if shared >= 0.8 * sum((b | bags[j]).values()):
                a, c = find(i), find(j)
                least[max(a, c)] = min(a, c)
    return {i: find(i) for i in bags}


def test_op8(spark, documents):
    got = {r.doc_id: r.class_id for r in QUERIES["op8_near_dedup"](spark, SF).collect()}
    assert got == near_classes(documents)


def test_op8_in_families_of_edits(spark):
    """Chains and stars of edits, in which a bucket's first leader is not near to all."""
    rng = np.random.default_rng(6)
    words = [f"w{i}" for i in range(4_000)]
    rows = []
    for family in range(6):
        base = list(rng.choice(words, 90))
        text = list(base)
        for k in range(25):
            text = list(text if family % 2 else base)
            for _ in range(int(rng.integers(1, 3))):
                text[int(rng.integers(0, 90))] = str(rng.choice(words))
            rows.append((len(rows), " ".join(text)))
    rows += [(len(rows) + i, " ".join(["same words again and"] * n)) for i, n in enumerate((3, 4, 30, 31, 40))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == near_classes(rows)


def test_op8_with_a_third_in_one_family(spark):
    """A third of all rows are edits of one text, from almost none to most of it; two more families meet it half way."""
    rng = np.random.default_rng(16)
    words = [f"w{i}" for i in range(60)]  # few words, so that the same edits happen twice
    base = list(rng.choice(words, 120))
    half = base[:60] + list(rng.choice(words, 60))
    rows = []
    for k in range(360):
        text = list(base if k % 3 else half)
        for _ in range(int(rng.integers(0, 30)) if k % 4 else int(rng.integers(0, 4))):
            at = int(rng.integers(0, len(text)))
            text[at : at + int(rng.integers(0, 3))] = [str(rng.choice(words))]
        rows.append((k, " ".join(text)))
    rows += [(1_000 + i, " ".join(rng.choice(words, int(rng.integers(1, 200))))) for i in range(720)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert {r.doc_id: r.class_id for r in near_dedup.classes(docs).collect()} == near_classes(rows)


def test_signature_is_unbiased():
    rng = np.random.default_rng(5)
    agree = []
    for t in range(60):
        runs = rng.integers(0, 1 << 63, 40).astype(np.uint64)
        one, two = rng.integers(1, 7, 40), rng.integers(1, 7, 40)
        doc = np.repeat([0, 1], 40)
        signature = near_dedup.bag_min_hash(doc, np.concatenate([runs, runs]), np.concatenate([one, two]), 2)
        agree.append((signature[0] == signature[1]).mean() - np.minimum(one, two).sum() / np.maximum(one, two).sum())
    assert abs(np.mean(agree)) < 0.02


@pytest.mark.parametrize("runs", [1, 20, 40, 80, 150])
def test_bands_do_not_depend_on_the_slice(runs):
    """One text has the same bands alone, among 100 texts and in a full slice."""
    rng = np.random.default_rng(runs)
    words = [f"w{i}" for i in range(3_000)]
    some = lambda n: " ".join(rng.choice(words, n + 4))
    text, full = some(runs), []
    while sum(map(len, full)) < near_dedup.SLICE_BYTES:
        full.append(some(int(rng.integers(20, 400))))
    alone = near_dedup.sketch([text])[0]
    for others in (full[:99], full):
        assert near_dedup.sketch([text, *others])[0] == alone == near_dedup.sketch([*others, text])[-1]


def test_op9(spark):
    pages = [(r.page_id, (r.html or "").encode()) for r in spark.read.parquet(f"{SF}/pages.parquet").collect()]
    first = {}
    for i, p in sorted(pages):
        first.setdefault(p, i)
    got = {r.page_id: tuple(r)[1:] for r in QUERIES["op9_warc"](spark, SF).collect()}
    for i, p in pages:
        digest = base64.b32encode(hashlib.sha1(p).digest()).decode()
        assert got[i] == (len(p), digest, "response" if first[p] == i else "revisit", None if first[p] == i else first[p])


def test_pipeline(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    rows = {r.doc_id: r for r in docs.collect()}
    model = toxicity.fit(docs, spark.read.parquet(f"{SF}/labels.parquet"))
    left = {r.doc_id for r in model.score(docs).where("predicted = 0").collect()}
    last = {}
    for i in left:
        key = "".join(c.lower() if c.isascii() else c for c in rows[i].text or "")
        last[key] = max(i, last.get(key, -1))
    left = set(last.values())
    left = {i for i, c in near_classes([(i, rows[i].text or "") for i in left]).items() if i == c}
    out = corpus_pipeline.run(spark, SF).collect()
    ranks = bpe.vocabulary(bpe.VOCABULARY, public_tokenizers.PATTERN).ranks
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    assert {r.doc_id for r in out} <= left
    sizes = Counter()
    for i in left:
        sizes[rows[i].source] += len((rows[i].text or "").split())
    target = {s: 0.0 for s in sizes}
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(sorted(sizes))}
    rest, open_ = float(sum(sizes.values())), set(sizes)
    while open_:
        share = rest / sum(weight[s] for s in open_)
        full = {s for s in open_ if share * weight[s] > 3 * sizes[s]}
        for s in full or open_:
            target[s] = 3.0 * sizes[s] if full else share * weight[s]
        rest -= sum(target[s] for s in full)
        open_ = open_ - full if full else set()
    copies = Counter(r.doc_id for r in out)
    for i in left:
        rate = target[rows[i].source] / sizes[rows[i].source]
        assert copies[i] in (int(rate + 1e-9), int(rate + 1e-9) + 1) or copies[i] == int(rate)
    for r in out:
        assert r.ids == library.encode_ordinary(rows[r.doc_id].text or "") and r.n_tokens == len(r.ids)
