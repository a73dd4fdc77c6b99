"""Every operator on nulls, empty and long texts, repeated rows, clashing columns, empty tables."""

import hashlib
import unicodedata
import zlib

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from tokenizers import Tokenizer

import corpus_pipeline
from gatewarden.llm import bpe, chat, exact_dedup, mixing, near_dedup, neighbours, suffix_dedup, token_store, toxicity, warc

LONG = " ".join(f"word{i % 977} runs" for i in range(12_000))
ROWS = [
    (1, "Alpha beta", "s1"), (2, None, "s1"), (3, "", None), (4, LONG, "s2"), (5, "alpha BETA", "s2"),
    (6, "alpha beta", "s1"), (6, "alpha beta", "s1"), (None, "alpha beta", None), (None, None, None),
    (9, "x y z w v u t s r q p", "s3"), (10, "x y z w v u t s r q p", "é"), (11, "日本語 \u0130 ß \ud7ff 🙂🙂", "s3"), (12, LONG, "s2"),
]
CLASHES = ("row", "ids", "n", "kept", "digest", "keep_id", "rid", "node", "copies", "rate", "size", "score", "predicted", "label", "f_you", "whole")


@pytest.fixture(scope="module")
def docs(spark):
    plain = spark.createDataFrame(ROWS, "doc_id long, text string, source string")
    return plain.selectExpr("*", *(f"'clash' AS `{c}`" for c in CLASHES))


@pytest.fixture(scope="module")
def empty(docs):
    return docs.limit(0)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(1, 1), (None, 1), (3, None), (4, 0)], "doc_id long, toxic int")


def texts():
    return [(i, t or "") for i, t, _ in ROWS]


def test_exact_dedup(docs, empty):
    rows = exact_dedup.digests(docs)
    got = exact_dedup.mark(rows, exact_dedup.earlier_half(rows)).collect()
    assert len(got) == len(ROWS)
    groups = {}
    for i, t in texts():
        groups.setdefault("".join(c.lower() if c.isascii() else c for c in t), []).append(i)
    by_digest = {hashlib.sha256(t.encode()).digest(): ids for t, ids in groups.items()}
    for r in got:
        ids = by_digest[bytes(r.digest)]
        assert r.group_size == len(ids) and r.keep_id == max((i for i in ids if i is not None), default=None)
    assert sum(r.kept for r in got) == len(groups)
    left = exact_dedup.drop_repeats(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(
        max(i for i in ids if i is not None) for ids in groups.values())
    assert exact_dedup.drop_repeats(empty).count() == 0


def test_perfect_hash_is_minimal_and_checked():
    words = np.random.default_rng(3).integers(0, 1 << 63, (20_000, 4)).astype(np.uint64)
    mph = exact_dedup.PerfectHash.build(words)
    assert sorted(mph.slots(words)) == list(range(len(words)))
    others = words ^ np.uint64(1 << 60)
    held = words[np.argsort(mph.slots(words))]
    slots = mph.slots(others)
    assert not (held[slots[slots >= 0]] == others[slots >= 0]).all(axis=1).any()


def test_mixing(docs, empty):
    planned = mixing.plan_copies(docs).collect()
    assert len(planned) == len(ROWS)
    for r in planned:
        assert r.size == len((r.row.text or "").split()) and 0 <= r.copies <= 3
        assert r.target <= 3 * r.source_size + 1e-6
    mixed = mixing.mix(docs)
    assert mixed.columns == docs.columns and mixed.count() == sum(r.copies for r in planned)
    assert mixing.mix(empty).count() == 0


def test_mixing_shares_and_reruns(spark):
    rows = [(i, "w " * (1 + i % 7), f"s{i % 3}") for i in range(6_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    one, two = (sorted((r.row.doc_id, r.copies) for r in mixing.plan_copies(docs).collect()) for _ in range(2))
    assert one == two
    total = sum(1 + i % 7 for i in range(6_000))
    copies = dict(one)
    for s, weight in zip(range(3), (5, 2, 1)):
        taken = sum(copies[i] * (1 + i % 7) for i in range(6_000) if i % 3 == s)
        assert abs(taken / (total * weight / 8) - 1) < 0.05


def test_bpe(docs, empty):
    vocab = bpe.vocabulary(bpe.VOCABULARY, public_tokenizers.PATTERN)
    library = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=vocab.ranks, special_tokens={})
    got = bpe.decode(bpe.encode(docs)).collect()
    assert sorted((r.ids, bytes(r.decoded)) for r in got) == sorted((library.encode_ordinary(t), t.encode()) for _, t in texts())
    both = bpe.encode(docs, decoded=True)
    assert sorted((r.ids, bytes(r.decoded)) for r in both.collect()) == sorted((r.ids, bytes(r.decoded)) for r in got)
    assert bpe.encode(empty).count() == 0 and bpe.encode(empty, decoded=True).columns == both.columns
    awkward = ["a" * 5_000, "ab" * 3_000, " \n\t " * 50, "'s't'll '", "é" * 700, "".join(map(chr, range(32, 900)))]
    assert [np.frombuffer(x, np.int32).tolist() for x in vocab.encode(awkward)] == [library.encode_ordinary(t) for t in awkward]
    alone = [vocab.merge(w.encode()) for w in ("indivisible", "zzzzyx", "日本")]
    assert alone == [library.encode_ordinary(w) for w in ("indivisible", "zzzzyx", "日本")]


def test_pipeline_decodes_what_it_encodes(spark, docs):
    rows = corpus_pipeline.encoded(spark, docs.withColumn("lang", bpe.F.lit("en")), "").collect()
    assert sorted(r.decoded_sha256 for r in rows) == sorted(hashlib.sha256(t.encode()).hexdigest() for _, t in texts())
    assert all(r.same_text for r in rows)


def test_bpe_merges_like_the_definition():
    """A lower rank that only a merge makes possible goes first, also within one bucket."""
    ranks = {bytes([b]): 1_000 + b for b in range(256)} | {b"ab": 7, b"abc": 3, b"cab": 1}
    vocab = object.__new__(bpe.Vocabulary)
    vocab.ranks, vocab.tokens = ranks, {r: t for t, r in ranks.items()}
    top = max(vocab.tokens) + 1
    vocab.buckets, vocab.lower = [None] * top, [0] * (top // 256 + 1)
    vocab.word_of, vocab.bit_of = [r >> 8 for r in range(top)], [1 << (r & 255) for r in range(top)]
    vocab.bytes = [ranks[bytes([b])] for b in range(256)]
    vocab.pairs = [ranks.get(bytes([a, b]), -1) for a in range(256) for b in range(256)]

    def slow(data):
        parts = [bytes([b]) for b in data]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    for data in (b"abcab", b"ababab", b"cabcab", b"abcabcabab", b"aabbccab"):
        assert vocab.merge(data) == slow(data)
        assert not any(vocab.buckets) and not any(vocab.lower)


def test_token_store(docs, empty):
    library = Tokenizer.from_file(token_store.TOKENIZER)
    got = token_store.read_documents(token_store.write_shards(docs)).collect()
    want = {}
    for i, t in texts():
        ids = np.array([*library.encode(t, add_special_tokens=False).ids, 1], "<u4")
        want.setdefault(i, []).append((len(ids), zlib.crc32(ids.tobytes())))
    seen, start = {}, 0
    for r in sorted(got, key=lambda r: r.start):
        assert r.start == start
        start += r.n_tokens
        seen.setdefault(r.doc_id, []).append((r.n_tokens, r.ids_crc32))
    assert {k: sorted(v) for k, v in seen.items()} == {k: sorted(v) for k, v in want.items()}
    order = [-1 if r.doc_id is None else r.doc_id for r in sorted(got, key=lambda r: r.start)]
    assert order == sorted(order)
    assert token_store.read_documents(token_store.write_shards(empty)).count() == 0


def test_word_encoder_equals_the_library():
    library = Tokenizer.from_file(token_store.TOKENIZER)
    rng = np.random.default_rng(1)
    letters = list("abcXYZ'stredlvm  \n\t0123.,!?é²ßªµÀ\x0b\x1c\x85\xa0") + ["日本", "\u0130", "e\u0301", "🙂", "<|endoftext|>", "<|startoftext|>", "<|EndOfText|>"]
    some = ["".join(rng.choice(letters, size=rng.integers(0, 60))) for _ in range(400)] + [unicodedata.normalize("NFD", "é à ü"), "q" * 900]
    got = token_store.WordEncoder(token_store.TOKENIZER).encode(some)
    assert [np.frombuffer(x, "<u4").tolist() for x in got] == [library.encode(t, add_special_tokens=False).ids for t in some]


def test_added_tokens_are_what_the_library_makes_of_them(spark):
    rows = [(1, "a <|startoftext|>b<|endoftext|> c"), (2, "<|EndOfText|>"), (3, "<|endoftext"), (4, "plain"), (5, "x" * 70 + " y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    library, got = Tokenizer.from_file(token_store.TOKENIZER), token_store.read_documents(token_store.write_shards(docs)).collect()
    assert {49406, 49407} <= set(library.encode(rows[0][1], add_special_tokens=False).ids)
    for r in got:
        ids = np.array([*library.encode(dict(rows)[r.doc_id], add_special_tokens=False).ids, 1], "<u4")
        assert (r.n_tokens, r.ids_crc32) == (len(ids), zlib.crc32(ids.tobytes()))


@pytest.mark.parametrize("n", [0, 1, 511, 512, 513, 5_000, token_store.SEGMENT_BITS, 2 * token_store.SEGMENT_BITS + 9])
def test_wavelet_matrix(n):
    ids = np.random.default_rng(n).integers(0, 60, n).astype("<u4")
    _, ends, matrix = token_store.read_shard(token_store.write_shard([1, 2], [ids[: n // 2].tobytes(), ids[n // 2 :].tobytes()]))
    assert (matrix.decode() == ids).all() and ends.tolist() == [n // 2, n]
    for i in range(0, n, max(97, n // 50)):
        assert matrix.access(i) == ids[i]
    for token in (0, 7, 59, 1_000):
        assert matrix.occurrences(token) == np.flatnonzero(ids == token).tolist()
        assert matrix.count(token, n // 3, n) == (ids[n // 3 :] == token).sum()
    broken = bytearray(token_store.write_shard([1], [ids.tobytes()]))
    broken[-1] ^= 1
    with pytest.raises(ValueError):
        token_store.read_shard(bytes(broken))


def test_near_dedup(docs, empty):
    got = near_dedup.classes(docs).collect()
    assert len(got) == len(ROWS)
    of = {(r.doc_id, r.runs): r for r in got}
    assert of[4, len(LONG.split()) - 4].class_id == of[12, len(LONG.split()) - 4].class_id == 4
    assert {of[i, 1].class_id for i in (1, 5, 6)} == {1} and of[None, 1].class_id == 1
    assert of[2, 0].class_id == 2 and of[3, 0].class_id == 3 and of[10, 7].class_id == 9
    left = near_dedup.drop_near_copies(docs)
    assert left.columns == docs.columns
    assert sorted(r.doc_id for r in left.collect() if r.doc_id is not None) == [1, 2, 3, 4, 9, 11]
    assert near_dedup.drop_near_copies(empty).count() == 0 and near_dedup.classes(empty).count() == 0


def test_near_copies_are_dropped_by_row(spark):
    """Different texts of one id stay, near copies without ids go."""
    one, two, three = (" ".join(f"{w}{i}" for i in range(100)) for w in "abc")
    rows = [(1, one), (1, two), (1, one), (2, two + " end"), (None, three), (None, three + " end"), (None, one + " end"),
            (5, ""), (5, ""), (None, ""), (None, None)]
    left = near_dedup.drop_near_copies(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    found = sorted(((r.doc_id, (r.text or "")[:2]) for r in left), key=str)
    assert found == sorted([(1, "a0"), (1, "b0"), (None, "c0"), (5, ""), (None, ""), (None, "")], key=str)


def test_suffix_dedup(docs, empty):
    got = suffix_dedup.remove_repeats(docs).collect()
    assert len(got) == len(ROWS)
    for r in got:
        if r.doc_id in (4, 12):
            assert bytes(r.kept) == b"" and [(s.start, s.end) for s in r.spans] == [(0, len(LONG))]
        else:
            assert r.spans == [] and len(r.kept) == r.n_bytes
    assert suffix_dedup.remove_repeats(empty).count() == 0


def test_chat(spark):
    parts = [("text", "look <|image|> \\", None, None), ("image", None, "a.png", 3), (None, None, None, None), ("video", None, "b", 2), ("audio", None, None, 4)]
    rows = [
        (1, 0, "user", None, None), (1, 1, "assistant", "<|end|>\n<|turn|>x", None), (1, 1, "assistant", "<|end|>\n<|turn|>x", None),
        (1, None, None, "\\</s>\\\\[INST]", None), (2, 0, "assistant", "", None), (3, 5, "user", "seen", parts), (None, 0, "us<|er", "é🙂<", None),
    ]
    schema = f"conv_id long, turn int, role string, text string, parts array<{chat.PART}>"
    messages = spark.createDataFrame(rows, schema).selectExpr("*", "1 AS m", "2 AS ms", "3 AS formatted")
    out = {r.conv_id: r for r in chat.format_chats(messages).selectExpr("*").withColumn(
        "turns", chat.read_turns(chat.F.col("formatted"))).withColumn("loss", chat.masked_text(chat.F.col("formatted"), chat.F.col("loss_spans"))).collect()}
    assert [tuple(t) for t in out[1].turns] == [("", "\\</s>\\\\[INST]"), ("user", ""), *[("assistant", "<|end|>\n<|turn|>x")] * 2]
    assert out[1].loss == "<|end|>\n<|turn|>x" * 2 and out[2].loss == "" and [tuple(t) for t in out[None].turns] == [("us<|er", "é🙂<")]
    assert [(a.type, a.uri, a.tokens) for a in out[3].attachments] == [("image", "a.png", 256), ("document", "b", 1088), ("audio", None, 132)]
    assert out[3].expanded_tokens == 1476
    assert out[3].formatted.endswith("look <\\|image|> \\\\<|image|><|document|><|audio|><|end|>\n")
    assert chat.format_chats(messages.limit(0)).count() == 0


def test_toxicity(docs, empty, labels):
    model = toxicity.fit(docs, labels)
    scored = model.score(docs)
    assert scored.count() == len(ROWS) and scored.columns[-2:] == ["score", "predicted"]
    assert all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7) for r in scored.collect())
    left = toxicity.drop_toxic(docs, labels)
    assert left.columns == docs.columns
    assert toxicity.drop_toxic(empty, labels).count() == 0 and toxicity.fit(docs, labels.limit(0)).score(docs).count() == len(ROWS)


def test_toxicity_with_few_labels_goes_by_the_lexicon(spark):
    """Whatever the share of toxic labels: insults are rejected, clean texts stay."""
    rows = [(i, "you pathetic idiot shut up" if i % 2 else f"a quiet walk along river {i}") for i in range(30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for toxic in (0, 1):
        known = spark.createDataFrame([(i, toxic) for i in range(12)], "doc_id long, toxic int")
        assert sorted(r.doc_id for r in toxicity.drop_toxic(docs, known).collect()) == list(range(0, 30, 2))


def test_warc(spark):
    rows = [(1, "http://a/\r\nX: y", "same"), (2, None, None), (3, "http://b/é", ""), (4, "u", "same"), (None, "u", "same"), (4, "u", "same"), (7, "u", LONG)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "1 AS digest", "2 AS of", "3 AS first_id")
    got = warc.read_archives(warc.write_archives(pages)).collect()
    assert len(got) == len(rows)
    for r in got:
        same = {i for i, _, h in rows if warc.base32_sha1((h or "").encode()) == r.payload_digest}
        assert r.record_type == ("response" if r.page_id is not None and r.page_id == min(i for i in same if i is not None) else "revisit")
        assert r.refers_to == (None if r.record_type == "response" else min(i for i in same if i is not None))
    assert warc.read_archives(warc.write_archives(pages.limit(0))).count() == 0


def test_warc_record_ids_are_unique(spark, tmp_path):
    rows = [(4, "same"), (4, "same"), (4, "other"), (9, "same"), (9, "same"), (None, "same"), (None, "lone"), (None, "lone"), (7, "x"), (7, "y")] * 3
    spark.createDataFrame(rows, "page_id long, html string").selectExpr("*", "'u' AS url", "5 AS row", "6 AS first_row").repartition(3).write.parquet(str(tmp_path / "p"))
    for least in (0, 4, 1_000):
        archives = warc.write_archives(spark.read.parquet(str(tmp_path / "p")), least).collect()
        heads = [warc._fields(data.partition(b"\r\n\r\n")[0].partition(b"\r\n")[2]) for a in archives for data in warc.frames(a.content)]
        kind = {h["WARC-Record-ID"]: h for h in heads}
        assert len(kind) == len(heads) == len(rows)
        revisits = [h for h in heads if h["WARC-Type"] == "revisit"]
        assert bool(revisits) == (least < 1_000)
        for h in revisits:
            named = kind[h["WARC-Refers-To"]]
            assert named["WARC-Type"] == "response" and named["WARC-Payload-Digest"] == h["WARC-Payload-Digest"]
            assert named["X-Page-ID"] == h["X-Refers-To-Page-ID"]


def test_warc_dictionary_and_damage():
    records = [warc.record(i, f"http://x/{i}", f"<html><body>page {i} of a site</body></html>".encode() * 3, None) for i in range(500)]
    writer = warc.Writer(warc.train(records))
    for r in records:
        writer.add(r)
    n, content = writer.take()
    assert n == 500 and content[:4] == (0x184D2A5D).to_bytes(4, "little") and list(warc.frames(content)) == records
    for bad in (content[:-5], content[: len(writer.lead) - 3]):
        with pytest.raises(Exception):
            list(map(warc.parse, warc.frames(bad)))
    for bad in (records[0][:-1], records[0].replace(b"page 0", b"page 9"), records[0].replace(b"WARC-Date", b"WARC-Dote"), b"WARC/9.9\r\n\r\n"):
        with pytest.raises(ValueError):
            warc.parse(bad)


def test_neighbours(spark):
    rows = [(1, [1.0, 0.0]), (2, [0.0, 0.0]), (3, None), (4, [float("nan"), 1.0]), (5, [None, 1.0]), (6, [2.0, 0.0]), (7, [0.0, 3.0]),
            (8, [1.0, 1.0]), (8, [1.0, 1.0]), (9, [float("inf"), 0.0]), (10, [-1.0, 0.0]), (11, [1e300, 1e300])]
    table = spark.createDataFrame(rows, "id long, vector array<double>").selectExpr("*", "1 AS list", "2 AS v", "3 AS score")
    got = {}
    for r in neighbours.search(table, table).collect():
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, round(r.score, 12))
    assert set(got) == {1, 6, 7, 8, 10, 11}
    root = round(0.5**0.5, 12)
    assert [got[1][k] for k in (1, 2, 3, 4, 5)] == [(6, 1.0), (8, root), (11, root), (7, 0.0), (10, -1.0)]
    assert got[8][1] == (11, 1.0) and 8 not in {v for v, _ in got[8].values()}
    assert neighbours.search(table.limit(0), table.limit(0)).count() == 0


INSULTING = "you are a pathetic idiot and everybody here knows that you are stupid trash {}"
PLAIN = "the committee met on monday to read the report about harvests and rivers {}"


@pytest.fixture(scope="module")
def fitted(spark):
    """A model that was fitted, not the fixed lexicon."""
    rows = [(i, (INSULTING if i % 3 == 0 else PLAIN).format(f"number {i} " * (i % 7)), int(i % 3 == 0)) for i in range(240)]
    known = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(known.select("doc_id", "text"), known.select("doc_id", "toxic"))
    assert model.trees is not None
    return known, model


def test_a_fitted_toxicity_model_on_edges(spark, fitted, docs, empty):
    known, model = fitted
    rows = model.score(docs).collect()
    assert len(rows) == len(ROWS) and all(0 <= r.score <= 1 for r in rows)
    assert len({round(r.score, 9) for r in rows if not r.text}) == 1
    assert all(r.predicted == int(r.score >= 0.7) for r in rows) and not any(r.predicted for r in rows)
    assert model.score(empty).count() == 0
    long = spark.createDataFrame([(1, PLAIN.format("") * 3_000), (2, INSULTING.format("") * 3_000)], "doc_id long, text string")
    assert [r.predicted for r in model.score(long).orderBy("doc_id").collect()] == [0, 1]


def test_a_fitted_model_parts_insults_from_plain_texts(spark, fitted):
    known, _ = fitted
    fresh = [(1000 + i, (INSULTING if i % 2 else PLAIN).format(f"item {i}")) for i in range(20)] + [(2000, None), (2001, "")]
    table = known.select("doc_id", "text").unionByName(spark.createDataFrame(fresh, "doc_id long, text string"))
    left = {r.doc_id for r in toxicity.drop_toxic(table, known.select("doc_id", "toxic")).collect()}
    assert {i for i, _ in fresh if i in left} == {i for i, _ in fresh if i >= 2000 or i % 2 == 0}


def test_features_counted_by_hand(spark):
    text = "You idiot! SHUT up now, w0rd."
    row = spark.createDataFrame([(text,)], "text string").select(*toxicity.features(toxicity.F.col("text"), (), ())).first()
    assert row.f_insults == 2 / 6 and row.f_loose == row.f_strict == 0
    assert row.f_you == 1 / 6 and row.f_near_you == 1 / 6
    assert row.f_capitals == 5 / len(text) and row.f_emphasis == 1 / len(text)
    assert row.f_punctuation == 2 / len(text) and row.f_signs == 1 / 6 and row.f_digits == 1 / len(text)


def stored(spark, folder, rows, labelled):
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame(labelled, "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
    return str(folder)


def test_pipeline_on_empty_tables(spark, tmp_path):
    out = corpus_pipeline.run(spark, stored(spark, tmp_path, [], []))
    assert out.count() == 0 and {"doc_id", "lang", "source", "ids"} <= set(out.columns)


def test_pipeline_with_null_and_repeated_ids_and_no_labels(spark, tmp_path):
    plain = [PLAIN.format(" ".join(f"{w}{i}" for w in ("ash", "birch", "cedar", "elm", "fir", "hazel", "larch", "maple", "oak", "pine"))) for i in range(12)]
    near = plain[0] + " " + " ".join(f"tree{i}" for i in range(40))
    rows = [(i, t, "en", "s1") for i, t in enumerate(plain)]
    rows += [(None, near, "en", None), (None, near + " once more", None, None), (3, "a text of its own under an id that is taken", "en", "s2"), (50, None, None, "s2"), (51, "", "en", "s2")]
    rows += [(60, INSULTING.format(""), "en", "s1"), (61, plain[1].upper(), "en", "s1"), (61, plain[1].upper(), "en", "s1")]
    out = corpus_pipeline.run(spark, stored(spark, tmp_path, rows, [])).collect()
    assert all(r.same_text for r in out)
    import hashlib
    digests = {r.decoded_sha256 for r in out}
    of = lambda t: hashlib.sha256(t.encode()).hexdigest()
    assert of(INSULTING.format("")) not in digests
    # Of equal texts the largest id stays, of near copies one.
    assert of(plain[1].upper()) in digests and of(plain[1]) not in digests
    assert len({of(near), of(near + " once more")} & digests) == 1
