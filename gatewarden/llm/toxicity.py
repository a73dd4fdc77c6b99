"""Toxicity: gradient-boosted trees over dense features, with isotonic calibration.

Features of a text, all by built-in functions: densities of a fixed lexicon and of two
learned ones (words and word beginnings that are commoner in toxic training texts),
lexicon words soon after a second person, capitals, marks of emphasis, other
punctuation, and words in which letters are replaced by signs. Trees are fitted on one
part of the training sample; the other part calibrates their output.

The fit uses labelled rows whose crc32(doc_id as text) mod 3 is not 1, at most
``MOST_POSITIVE`` and ``MOST_NEGATIVE`` of them, taken in the order of a hash of the
id and weighted back to the shares of all training rows. Every text is scored whole;
label, lang, source and id are no inputs of a score.

Defined results: null text is empty; an empty text gets the score of its (all zero)
features; a null id is not held out and never used for training; repeated rows get
equal scores; with fewer than ``LEAST`` rows of a label nothing is fitted and the score
is d / (d + ``HALF_DENSITY``) of the density d of the fixed lexicon, 0 without any of
its words. Further columns are carried, and scores replace columns named ``score`` and ``predicted``.
"""

from __future__ import annotations

import re

from pyspark.ml.classification import GBTClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gatewarden.llm.common import read, whole_text
from gatewarden.session import cut_lineage

#: Bounds of the training sample, and labelled rows without which nothing is fitted.
MOST_POSITIVE, MOST_NEGATIVE, LEAST = 3_000, 9_000, 20
#: A learned entry is often in so large a share of toxic texts, and so many times commoner than in others.
LEAST_SHARE, LEAST_DENSITY, LOOSE_ODDS, STRICT_ODDS, MOST_ENTRIES = 0.02, 0.005, 4.0, 16.0, 40
STEMS = (4, 5, 6, 7)
TREES, DEPTH = 30, 4
REJECT_FROM = 0.7
#: Share of insults among the words that scores 0.5 without a fit; from about one in a hundred a text is rejected.
HALF_DENSITY = 0.004

#: Fixed lexicon: common insults.
INSULTS = (
    "idiot", "moron", "stupid", "trash", "scum", "loser", "worthless", "pathetic", "disgusting", "clown", "dumb",
    "garbage", "vermin", "filth", "fool", "imbecile", "hate you", "shut up", "arschloch", "dumm", "idioten", "abschaum",
    "imbécile", "ordure", "débile", "basura", "estúpido", "imbécil", "asqueroso",
)
SECOND_PERSON = ("you", "your", "you're", "u", "ur", "du", "dich", "dein", "ihr", "tu", "toi", "vous", "votre", "tú", "usted", "eres")
FEATURES = (
    "insults", "loose", "strict", "near_you", "you", "capitals", "emphasis", "punctuation", "signs", "digits", "length",
)


def is_held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def _any(entries: tuple[str, ...]) -> str:
    """A pattern for words that begin with one of the entries; never matches if there are none."""
    return r"(?<!\p{L})(?:" + "|".join(map(re.escape, entries)) + ")" if entries else r"(?!)"


def features(text: Column, loose: tuple[str, ...], strict: tuple[str, ...]) -> list[Column]:
    low = F.lower(text)
    tokens = F.greatest(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(1))
    chars = F.greatest(F.length(text), F.lit(1))
    rate = lambda pattern, of=low: F.regexp_count(of, F.lit(pattern)) / tokens
    share = lambda signs: (F.length(text) - F.length(F.translate(text, signs, ""))) / chars
    you = r"(?<![\p{L}'])(?:" + "|".join(map(re.escape, SECOND_PERSON)) + r")(?![\p{L}'])"
    near = you + r"(?:[^\p{L}]{1,3}\p{L}{1,20}){0,3}[^\p{L}]{1,3}(?:" + "|".join(map(re.escape, (*INSULTS, *strict))) + ")"
    values = (
        rate(_any(INSULTS)), rate(_any(loose)), rate(_any(strict)), rate(near), rate(you),
        share("ABCDEFGHIJKLMNOPQRSTUVWXYZ"), share("!?"), share(".,;:-()\"'|/"), rate(r"\p{L}[@$*#%&!0-9]{1,3}\p{L}"),
        share("0123456789"), F.log1p(tokens),
    )
    return [v.cast("double").alias(f"f_{name}") for v, name in zip(values, FEATURES, strict=True)]


def learn_entries(sample: DataFrame) -> tuple[tuple[str, ...], tuple[str, ...]]:
    """Words and word beginnings by how much commoner they are in toxic texts (loose, strict).

    A text counts for an entry if it holds it often: at least twice and in at least
    ``LEAST_DENSITY`` of its words. Single chance hits thus say nothing.
    """
    of = {int(r["label"]): r["count"] for r in sample.groupBy("label").count().collect()}
    toxic, other = of.get(1, 0), of.get(0, 0)
    words = F.filter(F.split(F.lower("text"), r"[^\p{L}]+"), lambda w: F.length(w) > 3)
    # written, as the optimizer would otherwise count the words of a text again for each of them
    split = cut_lineage(sample.select("doc_id", "label", words.alias("words"), F.size(words).alias("all")))
    per_word = split.select("doc_id", "label", "all", F.explode("words").alias("word")).groupBy(
        "doc_id", "label", "all", "word").count()
    stems = F.array_distinct(F.array("word", *(F.substring("word", 1, n) for n in STEMS)))
    often = per_word.select("doc_id", "label", "all", "count", F.explode(stems).alias("entry")).groupBy(
        "doc_id", "label", "all", "entry").agg(F.sum("count").alias("n")).where(
        (F.col("n") >= 2) & (F.col("n") >= LEAST_DENSITY * F.col("all")))
    found = (
        often.groupBy("entry").agg(F.sum("label").alias("p"), F.sum(1 - F.col("label")).alias("n"))
        .where(F.col("p") >= max(3, LEAST_SHARE * toxic))
        .withColumn("odds", (F.col("p") / toxic) / ((F.col("n") + 1) / max(other, 1)))
        .where(F.col("odds") >= LOOSE_ODDS)
    )
    best = found.orderBy((F.col("p") * F.log("odds")).desc(), F.length("entry").desc(), "entry").limit(20 * MOST_ENTRIES)
    kept: list[tuple[str, float]] = []
    for entry, odds in best.select("entry", "odds").collect():
        if not any(entry.startswith(k) or k.startswith(entry) for k, _ in kept):
            kept.append((entry, odds))
    strict = tuple(e for e, odds in kept if odds >= STRICT_ODDS)[:MOST_ENTRIES]
    return tuple(e for e, odds in kept if odds < STRICT_ODDS)[:MOST_ENTRIES], strict


class Model:
    """A fitted scorer; ``trees`` is none if there was too little to learn from."""

    def __init__(self, loose=(), strict=(), trees=None, isotonic=None) -> None:
        self.loose, self.strict, self.trees, self.isotonic = loose, strict, trees, isotonic

    def score(self, docs: DataFrame) -> DataFrame:
        """``docs`` with ``score`` and ``predicted``."""
        kept = [c for c in docs.columns if c.lower() not in ("score", "predicted")]
        row = docs.select(F.struct(*(F.col(f"`{c}`") for c in kept)).alias("row"), whole_text().alias("text"))
        row = row.select("row", *features(F.col("text"), self.loose, self.strict))
        if self.trees is None:
            scored = row.withColumn("score", F.col("f_insults") / (F.col("f_insults") + F.lit(HALF_DENSITY)))
        else:
            scored = raw_scores(self.trees, row)
            scored = self.isotonic.transform(scored).withColumn("score", F.least(F.greatest("prediction", F.lit(0.0)), F.lit(1.0)))
        return scored.select("row.*", "score", (F.col("score") >= REJECT_FROM).cast("int").alias("predicted"))


def raw_scores(trees, table: DataFrame) -> DataFrame:
    assembler = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="v")
    scored = trees.transform(assembler.transform(table))
    return scored.withColumn("raw", vector_to_array("probability")[1]).drop("v", "prediction", "probability", "rawPrediction")


def _bounded(rows: DataFrame, label: int, most: int) -> DataFrame:
    return rows.where(F.col("label") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """Fit on the labelled rows of ``docs`` that are not held out."""
    known = labels.select(F.col("doc_id"), F.col("toxic").cast("int").alias("label")).where(
        F.col("doc_id").isNotNull() & F.col("label").isin(0, 1) & ~is_held_out(F.col("doc_id"))).dropDuplicates(["doc_id"])
    totals = {r["label"]: r["count"] for r in known.groupBy("label").count().collect()}
    if min(totals.get(0, 0), totals.get(1, 0)) < LEAST:
        return Model()
    taken = _bounded(known, 1, MOST_POSITIVE).unionByName(_bounded(known, 0, MOST_NEGATIVE))
    # at most MOST_POSITIVE + MOST_NEGATIVE ids, so the broadcast is bounded
    sample = cut_lineage(docs.select("doc_id", whole_text().alias("text")).join(F.broadcast(taken), "doc_id"))
    here = {r["label"]: r["count"] for r in sample.groupBy("label").count().collect()}
    if min(here.get(0, 0), here.get(1, 0)) < LEAST:
        return Model()
    calibrating = F.pmod(F.xxhash64("doc_id", F.lit("calibrate")), F.lit(4)) == 0
    loose, strict = learn_entries(sample.where(~calibrating))
    weight = F.when(F.col("label") == 1, F.lit(totals[1] / here[1])).otherwise(F.lit(totals[0] / here[0]))
    table = cut_lineage(sample.select(
        F.col("label").cast("double").alias("label"), calibrating.alias("calibrating"), weight.alias("weight"),
        *features(F.col("text"), loose, strict)))
    assembler = VectorAssembler(inputCols=[f"f_{n}" for n in FEATURES], outputCol="v")
    gbt = GBTClassifier(featuresCol="v", labelCol="label", weightCol="weight", maxIter=TREES, maxDepth=DEPTH,
                        stepSize=0.2, minInstancesPerNode=10, seed=7, maxBins=64)
    trees = gbt.fit(assembler.transform(table.where(~F.col("calibrating"))).coalesce(4))
    raw = raw_scores(trees, table.where("calibrating"))
    isotonic = IsotonicRegression(featuresCol="raw", labelCol="label", weightCol="weight").fit(raw)
    return Model(loose, strict, trees, isotonic)


def drop_toxic(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are not rejected, in the columns of ``docs``."""
    scored = fit(docs, labels).score(docs.select(F.struct("*").alias("whole"), "text"))
    return scored.where("predicted = 0").select("whole.*")


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs, read(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return model.score(docs).select("doc_id", is_held_out(F.col("doc_id")).alias("held_out"), "score", "predicted")


QUERIES = {"op6_toxicity": op6_toxicity}
ORACLE: dict[str, str] = {}
