"""Mixing sources to target weights by capped water-filling, with seeded whole and fractional repetitions.

A source's target is min(max_epochs * its size, level * its weight), where the level spends the budget: what a source
cannot take is reshared by weight until none is above its limit. A target of, say, 1.3 times the size is one whole
repetition of every document and a fraction of 0.3: documents in the order of a seeded hash, until the fraction's words
are reached (to the nearest document).

Scale: the sources' sums are pre-aggregated; the order within a source is cut into 4096 buckets by hash, so that a source
with a third of all rows is sorted and summed up in 4096 parts, whose starts come from the buckets' sums. Texts are
shuffled once at most, and not at all where the result does not hold them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import WORD, load, materialize, others

WEIGHTS = (5, 2, 1)
BIG = "decimal(38,0)"


def word_count(text: Column) -> Column:
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def water_fill(sizes: DataFrame, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = 150, max_epochs: int = 2) -> DataFrame:
    """sizes (source, source_size) with target: each source's share of budget_percent of all sizes, exact in integers to the last division.

    Sources in code-point order, null last, have the weights in turn. The limits must leave room for the budget
    (budget_percent <= 100 * max_epochs). All sizes 0: all targets 0.
    """
    if budget_percent > 100 * max_epochs:
        raise ValueError("the budget is above what all sources may give")
    turn = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    w = F.element_at(F.array(*map(F.lit, weights)), (turn % len(weights) + 1).cast("int"))
    s = sizes.withColumn("w", w.cast(BIG)).withColumn("cap", F.col("source_size").cast(BIG) * max_epochs)
    s = s.select("source", "source_size", F.col("w").cast(BIG).alias("w"), F.col("cap").cast(BIG).alias("cap"))
    order = Window.orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    upto = order.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    everything = Window.partitionBy(F.lit(1))
    # in hundredths of words: what is left for this source and those after it, by weight
    s = s.withColumn("total", F.sum("source_size").over(everything).cast(BIG) * budget_percent)
    s = s.withColumn("left", (F.col("total") - (F.sum("cap").over(upto) - F.col("cap")) * 100).cast(BIG))
    s = s.withColumn("rest", (F.sum("w").over(everything) - F.sum("w").over(upto) + F.col("w")).cast(BIG))
    s = s.withColumn("full", (F.col("cap") * 100).cast("decimal(25,0)") * F.col("rest").cast("decimal(12,0)") <= F.col("w").cast("decimal(12,0)") * F.col("left").cast("decimal(25,0)"))
    # full sources come first; the first that is not full fixes the level
    level = Window.partitionBy("full").orderBy(F.col("cap") / F.col("w"), F.col("source").asc_nulls_last())
    first = level.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    share = (F.col("w").cast("decimal(12,0)") * F.first("left").over(first).cast("decimal(25,0)")).cast("double") / (F.first("rest").over(first) * 100).cast("double")
    return s.select("source", "source_size", F.when(F.col("full"), F.col("cap").cast("double")).otherwise(share).alias("target"))


def _mixed(docs: DataFrame, seed: int, weights: tuple[int, ...], budget_percent: int, max_epochs: int, id: str, text: str, source: str, size: str | None) -> DataFrame:
    """row (the row of docs, whole), size, source_size, target, times."""
    words = F.coalesce(F.col(size).cast("long"), F.lit(0)) if size else word_count(F.col(text))
    order = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col(id).cast("string"), F.lit(""))))
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("row"), F.col(source).alias("s"), words.alias("size"), order.alias("o"))
    rows = rows.withColumn("bucket", F.substring("o", 1, 3))
    sums = rows.groupBy(F.col("s").alias("source"), F.col("bucket").alias("b")).agg(F.sum("size").alias("words"))
    targets = water_fill(sums.groupBy("source").agg(F.sum("words").alias("source_size")), weights, budget_percent, max_epochs)
    before = F.sum("words").over(Window.partitionBy("source").orderBy("b")) - F.col("words")
    starts = sums.select("source", "b", before.alias("before")).alias("a").join(targets.alias("t"), F.expr("a.source <=> t.source"))
    starts = starts.select(F.col("a.source").alias("source"), "b", "before", "source_size", "target")
    both = rows.join(starts, F.col("s").eqNullSafe(F.col("source")) & (F.col("bucket") == F.col("b")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    place = Window.partitionBy("source", "b").orderBy("o", "size").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = both.withColumn("upto", F.col("before") + F.sum("size").over(place)).withColumn("whole", whole)
    extra = (F.col("whole") < max_epochs) & (2 * F.col("upto") - F.col("size") <= 2 * (F.col("target") - F.col("whole") * F.col("source_size")))
    return both.select("row", "size", "source_size", "target", (F.col("whole") + extra.cast("long")).alias("times"))


def mix(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = 150, max_epochs: int = 2, id: str = "doc_id", text: str = "text", source: str = "source", size: str | None = None) -> DataFrame:
    """docs with _size (words), _source_size, _target (of the source) and _times (0 to max_epochs): how often the mix repeats the row.

    size: a column that has the words of each row counted already. Null text: size 0. Null source: a source of its own, the
    last. Null ids and repeated rows are rows like others; ties in the seeded order go by size. Each source's repeated
    words differ from its target by half a document at most. The same rows give the same result, however they are dealt.
    Columns of docs of these four names are replaced. Empty table: empty result.
    """
    m = _mixed(docs, seed, weights, budget_percent, max_epochs, id, text, source, size)
    rest = others(docs, "_size", "_source_size", "_target", "_times")
    return m.select(*(F.col("row").getField(c).alias(c) for c in rest), *(F.col(c).alias(f"_{c}") for c in ("size", "source_size", "target", "times")))


def repeated(docs: DataFrame, seed: int = 0, weights: tuple[int, ...] = WEIGHTS, budget_percent: int = 150, max_epochs: int = 2, id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mix itself: each row of docs as often as mix() says, with the columns of docs as they are, whatever their names."""
    m = _mixed(docs, seed, weights, budget_percent, max_epochs, id, text, source, None).filter("times > 0")
    return m.withColumn("k", F.explode(F.sequence(F.lit(1), F.col("times")))).select(*(F.col("row").getField(c).alias(c) for c in docs.columns))


def op5_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = load(spark, sf_dir, "documents")
    # the texts are counted once
    sizes = materialize(docs.select("doc_id", "source", word_count(F.col("text")).alias("n")), "sizes")
    m = mix(sizes, size="n")
    return m.select("doc_id", F.col("_size").alias("size"), F.col("_source_size").alias("source_size"), F.col("_target").alias("target"), (F.col("_size") * F.col("_times")).alias("taken"))


MIX_SQL = r"""
rows_ AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size, md5('0:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS o FROM {docs}),
src AS (SELECT source, sum(size) AS source_size FROM rows_ GROUP BY source),
weighed AS (SELECT source, source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS INT)] AS w FROM src),
filled AS (SELECT *, 3 * sum(source_size) OVER () - 4 * (sum(source_size) OVER o - source_size) AS l, sum(w) OVER () - sum(w) OVER o + w AS r
  FROM weighed WINDOW o AS (ORDER BY source_size / w, source NULLS LAST ROWS UNBOUNDED PRECEDING)),
full_ AS (SELECT *, 4 * source_size * r <= w * l AS f FROM filled),
level AS (SELECT l AS ll, r AS rr FROM full_ WHERE NOT f ORDER BY source_size / w, source NULLS LAST LIMIT 1),
target AS (SELECT source, source_size, CASE WHEN f THEN CAST(2 * source_size AS DOUBLE) ELSE CAST(w * (SELECT 50 * ll FROM level) AS DOUBLE) / CAST((SELECT 100 * rr FROM level) AS DOUBLE) END AS target FROM full_),
placed AS (SELECT d.doc_id, d.source, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole,
  sum(size) OVER (PARTITION BY d.source ORDER BY o, size ROWS UNBOUNDED PRECEDING) AS upto
  FROM rows_ d JOIN target t ON d.source IS NOT DISTINCT FROM t.source),
mixed AS (SELECT *, CAST(whole AS BIGINT) + CASE WHEN whole < 2 AND 2 * upto - size <= 2 * (target - whole * source_size) THEN 1 ELSE 0 END AS times FROM placed)"""

QUERIES = {"op5_source_mixing": op5_source_mixing}
ORACLES = {
    "op5_source_mixing": f"WITH {MIX_SQL.format(docs='documents')} SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target, CAST(size * times AS BIGINT) AS taken FROM mixed"
}
