"""Mixing sources to target weights.

Sizes (words) are summed per source, each source's share of the whole follows its
weight, and no target is above ``MOST_REPEATS`` times its source. A document is then
emitted ``floor(rate)`` times, and once more if a hash of its id falls below the
fraction of the rate, where rate = target / size of the source.

Defined results: a null text has size 0; a null source is a source of its own, last
in order; a source without any word keeps each of its documents once (rate 1);
repeated rows are decided alike, as the decision depends on the id only; a null id
counts as an empty one. Further columns are carried and never read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from gatewarden.llm.common import broadcast_if_bounded, read, whole_text

#: Weights by the place of a source in code-point order, used again from the start.
WEIGHTS = (5, 2, 1)
#: A target is at most so many times the size of its source.
MOST_REPEATS = 3
SEED = "mix-1"
WORD = r"[^\x20\x09-\x0D]+"


def size_of(text: Column) -> Column:
    return F.regexp_count(text, F.lit(WORD)).cast("long")


def draw(doc_id: Column, seed: str) -> Column:
    """A number in [0, 1) that depends on the id and the seed only (52 bits of MD5)."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(key), 1, 13), 16, 10).cast("double") / F.lit(float(1 << 52))


def source_targets(sizes: DataFrame, weights: tuple[int, ...], most: int) -> DataFrame:
    """One row per source: ``source, source_size, target`` from ``source, size``.

    The sources that reach their cap are found in one pass: in the order of cap by
    weight, a source is capped if its cap is within its share of what the earlier
    caps left over. The window runs over one row per source, not over documents.
    """
    exact = "decimal(38,0)"
    cycle = F.array(*(F.lit(w) for w in weights))
    place = Window.orderBy(F.col("source").asc_nulls_last())
    by_ratio = Window.orderBy(F.col("cap") / F.col("weight"), "place")
    sources = (
        sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
        .withColumn("place", F.row_number().over(place))
        .withColumn("weight", F.element_at(cycle, ((F.col("place") - 1) % len(weights) + 1).cast("int")).cast("long"))
        .withColumn("cap", F.col("source_size") * most)
        .withColumn("all", F.sum("source_size").over(Window.partitionBy()))
        .withColumn("before", F.coalesce(F.sum("cap").over(by_ratio.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
        .withColumn("weight_left", F.sum("weight").over(by_ratio.rowsBetween(0, Window.unboundedFollowing)))
        .withColumn("left", F.col("all") - F.col("before"))
        .withColumn("capped", F.col("cap").cast(exact) * F.col("weight_left") <= F.col("left").cast(exact) * F.col("weight"))
    )
    # the shares per weight fall after the first source below its cap: the largest is the one that holds
    first = F.max_by(
        F.struct("left", "weight_left"),
        F.when(~F.col("capped"), F.struct(-F.col("cap") / F.col("weight"), -F.col("place"))),
    ).over(Window.partitionBy())
    share = first["left"].cast("double") * F.col("weight") / first["weight_left"]
    return sources.select(
        "source", "source_size",
        F.when(F.col("capped"), F.col("cap").cast("double")).otherwise(share).alias("target"),
    )


def plan_copies(
    docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, most: int = MOST_REPEATS, seed: str = SEED
) -> DataFrame:
    """Each row as ``row`` with ``size, source_size, target, rate, copies``."""
    sized = docs.select(F.struct("*").alias("row"), F.col("source"), size_of(whole_text()).alias("size"))
    table = source_targets(sized.select("source", "size"), weights, most).withColumnRenamed("source", "of")
    targets = broadcast_if_bounded(table, ("of",))
    rate = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(1.0))
    extra = (draw(F.col("row.doc_id"), seed) < F.col("rate") - F.floor("rate")).cast("int")
    return (
        sized.join(targets, F.col("source").eqNullSafe(F.col("of")))
        .withColumn("rate", rate)
        .withColumn("copies", (F.floor("rate") + extra).cast("int"))
        .select("row", "size", "source_size", "target", "rate", "copies")
    )


def mix(docs: DataFrame, **options) -> DataFrame:
    """The mixed documents: every row as often as planned, in the columns of ``docs``."""
    planned = plan_copies(docs, **options)
    return planned.where("copies > 0").select("row", F.explode(F.sequence(F.lit(1), F.col("copies")))).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return plan_copies(docs).select(
        F.col("row.doc_id").alias("doc_id"), "size", "source_size", "target",
        (F.col("size") * F.col("copies")).alias("taken"), "copies",
    )


#: Another form than the job: caps are found round by round with a recursive query.
MIX_SQL = """
    per AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
    weighed AS (
      SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST)) - 1) % 3 + 1] AS weight,
             3 * source_size AS cap, (sum(source_size) OVER ())::BIGINT AS total FROM per),
    ranked AS (SELECT *, row_number() OVER (ORDER BY cap / weight, source NULLS LAST) AS k FROM weighed),
    levels AS (
      SELECT a.k, a.cap, a.weight, a.total - coalesce((SELECT sum(cap) FROM ranked b WHERE b.k < a.k), 0) AS rest,
             (SELECT sum(weight) FROM ranked b WHERE b.k >= a.k) AS weights
      FROM ranked a),
    stop AS (SELECT k, rest::BIGINT::DOUBLE AS rest, weights::BIGINT::DOUBLE AS weights FROM levels
             WHERE cap::HUGEINT * weights > rest::HUGEINT * weight ORDER BY k LIMIT 1),
    targets AS (
      SELECT source, source_size,
             CASE WHEN s.k IS NULL OR r.k < s.k THEN cap::DOUBLE ELSE s.rest * r.weight / s.weights END AS target
      FROM ranked r LEFT JOIN stop s ON true),
    rated AS (
      SELECT d.*, t.source_size, t.target,
             CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 1.0::DOUBLE END AS rate
      FROM sized d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source),
    planned AS (
      SELECT *, (floor(rate) + CASE WHEN
          ('0x' || substr(md5('mix-1:' || coalesce(doc_id::VARCHAR, '')), 1, 13))::BIGINT::DOUBLE / 4503599627370496.0::DOUBLE
          < rate - floor(rate) THEN 1 ELSE 0 END)::INTEGER AS copies FROM rated)
"""
OP10_SQL = r"""
    WITH sized AS (
      SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size
      FROM documents),
""" + MIX_SQL + """
    SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM planned
"""
QUERIES = {"op10_mixing": op10_mixing}
ORACLE = {"op10_mixing": OP10_SQL}
