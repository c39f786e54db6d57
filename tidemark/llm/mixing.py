"""Mixing sources to target weights with hash-threshold histograms. DataFrame functions only.

Every document has a 60-bit hash of its id. Words are summed by source and hash bucket (4096 per level), a running sum
over the few buckets of a source finds the one where its budget runs out, and only that bucket is looked at again with
12 further bits, five times over. What lies below the resulting threshold is taken: a filter, no sort of documents. The
rest of the budget, smaller than the boundary document, goes to up to three documents beyond the threshold, each the one
that brings the source nearest to its target.

A source whose target reaches its size has every document once, and its budget buys second copies. Whole documents
only, so taken is 0, 1 or 2 times the size. Null sources form one source (last in order), null texts have size 0, null
ids are told apart by their texts; rows that repeat an id stand or fall together; an empty table gives an empty
result; further columns are ignored by ``assign`` and kept by ``mix``. One row per source (never per document) passes
through single tasks, to order the sources and to level the targets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import staged, word_count

#: Weights in the code-point order of the sources, share of all words to take, copies at most.
WEIGHTS, SHARE, MAX_COPIES = (3, 1, 2), 1.5, 2.0
#: Bits of the hash, and of each histogram.
HASH_BITS, LEVEL_BITS = 60, 12
#: Documents that may fill a source's rest.
TOP_UPS = 3


def _hash(doc_id: Column, text: Column) -> Column:
    digits = F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.md5(text), F.lit("")).cast("binary")), 1, HASH_BITS // 4)
    return F.conv(digits, 16, 10).cast("long")


def targets(sizes: DataFrame) -> DataFrame:
    """(source, source_size, target) of rows (source, size): shares by weight, levelled so that none is above its limit.

    With limits in the order of limit by weight, the level is the largest of (total - limits so far) by (weights to go).
    """
    order = Window.orderBy(F.col("source").asc_nulls_last())
    nth = F.element_at(F.array(*map(F.lit, WEIGHTS)), ((F.row_number().over(order) - 1) % len(WEIGHTS) + 1).cast("int"))
    known = sizes.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("weight", nth)
    limit = MAX_COPIES * F.col("source_size")
    tightest = Window.orderBy(limit / F.col("weight"), F.col("source").asc_nulls_last())
    before, whole = tightest.rowsBetween(Window.unboundedPreceding, -1), tightest.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    sofar = lambda c: F.coalesce(F.sum(c).over(before), F.lit(0))
    level = (SHARE * F.sum("source_size").over(whole) - sofar(limit)) / (F.sum("weight").over(whole) - sofar(F.col("weight")))
    levelled = known.withColumn("level", level).withColumn("top", F.max("level").over(whole))
    return levelled.select("source", "source_size", F.least(limit, F.col("weight") * F.col("top")).alias("target"))


def _same(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """Joined on the source, nulls alike; the plan's columns other than ``source`` must be new."""
    plan = plan.withColumnRenamed("source", "__source")
    return rows.join(plan, F.col("source").eqNullSafe(F.col("__source")), how).drop("__source")


def thresholds(sized: DataFrame) -> DataFrame:
    """One row per source: source_size, target, copies of every document, bound and extras (hashes taken once more)."""
    plan = staged(targets(sized), "targets")
    copies = F.when(F.col("target") >= F.col("source_size"), 1).otherwise(0)
    plan = plan.withColumn("copies", copies).withColumn("left", F.col("target") - F.col("copies") * F.col("source_size"))
    plan = plan.withColumn("bound", F.lit(0).cast("long")).withColumn("open", F.lit(True))
    for shift in range(HASH_BITS - LEVEL_BITS, -1, -LEVEL_BITS):
        width = LEVEL_BITS + shift
        inside = _same(sized, plan.where("open").select("source", "bound"))
        inside = inside.where(F.shiftright("h", width) == F.shiftright("bound", width))
        buckets = inside.groupBy("source", F.shiftright("h", shift).alias("bucket")).agg(F.sum("size").alias("words"))
        buckets = _same(buckets, plan.select("source", "left"))
        upto = Window.partitionBy("source").orderBy("bucket").rowsBetween(Window.unboundedPreceding, Window.currentRow)
        over = F.col("upto") > F.col("left")
        edge = buckets.withColumn("upto", F.sum("words").over(upto)).groupBy("source")
        edge = edge.agg(F.min(F.when(over, F.col("bucket"))).alias("edge"), F.coalesce(F.max(F.when(~over, F.col("upto"))), F.lit(0)).alias("below"))
        plan = _same(plan, edge, "left")
        found = F.col("open") & F.col("edge").isNotNull()
        # A source whose whole histogram fits has no edge: all its documents are taken.
        plan = plan.select(
            "source", "source_size", "target", "copies",
            (F.col("left") - F.coalesce("below", F.lit(0))).alias("left"),
            F.when(found, F.shiftleft("edge", shift)).when(F.col("open"), F.lit(1 << HASH_BITS)).otherwise(F.col("bound")).alias("bound"),
            found.alias("open"),
        )
        plan = staged(plan, "thresholds")
    plan = plan.drop("open").withColumn("extras", F.array().cast("array<long>"))
    for _ in range(TOP_UPS):
        rest = _same(sized, plan.select("source", "bound", "left", "extras"))
        rest = rest.where((F.col("h") >= F.col("bound")) & (F.col("size") > 0) & (F.col("size") < 2 * F.col("left")) & ~F.array_contains("extras", F.col("h")))
        units = rest.groupBy("source", "h", "left").agg(F.sum("size").alias("words")).where("words < 2 * left")
        best = units.groupBy("source").agg(F.min(F.struct(F.abs(F.col("left") - F.col("words")).alias("gap"), "h", "words")).alias("best"))
        plan = _same(plan, best, "left").select(
            "source", "source_size", "target", "copies", "bound",
            (F.col("left") - F.coalesce("best.words", F.lit(0))).alias("left"),
            F.when(F.col("best").isNull(), F.col("extras")).otherwise(F.concat("extras", F.array("best.h"))).alias("extras"),
        )
        plan = staged(plan, "thresholds")
    return plan


def _times(h: Column) -> Column:
    return F.col("copies") + ((h < F.col("bound")) | F.array_contains("extras", h)).cast("int")


def _sized(docs: DataFrame, doc_id: str, text: str, source: str) -> DataFrame:
    return docs.select(
        F.col(doc_id).alias("doc_id"), F.col(source).alias("source"), word_count(F.col(text)).alias("size"), _hash(F.col(doc_id), F.col(text)).alias("h")
    )


def assign(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken): the words that the mix takes of each row."""
    sized = staged(_sized(docs, doc_id, text, source), "sizes")
    planned = _same(sized, thresholds(sized.select("source", "size", "h")))
    return planned.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("h"))).alias("taken"))


def mix(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source") -> DataFrame:
    """The mixed corpus with the columns of ``docs``: rows left out, once or twice. Rows without words are as their hash says."""
    plan = thresholds(staged(_sized(docs, doc_id, text, source).drop("doc_id"), "sizes"))
    whole = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"), F.col(source).alias("source"), _hash(F.col(doc_id), F.col(text)).alias("h"))
    times = _same(whole, plan).select("row", _times(F.col("h")).alias("times")).where("times > 0")
    return times.select("row", F.explode(F.sequence(F.lit(1), F.col("times"))).alias("nth")).select("row.*")


_TOP_UP_SQL = """
u{n} AS (
  SELECT c.source, h, SUM(size)::BIGINT AS words, any_value(room) AS room FROM c JOIN {before} AS r ON c.source IS NOT DISTINCT FROM r.source
  WHERE upto > budget AND size > 0 {others} GROUP BY c.source, h HAVING SUM(size) < 2 * any_value(room)),
p{n} AS (SELECT * FROM u{n} QUALIFY row_number() OVER (PARTITION BY source ORDER BY abs(room - words), h) = 1),
r{n} AS (SELECT source, room - words AS room FROM p{n}),"""

ASSIGN_SQL = (
    """
WITH d AS (
  SELECT doc_id, source, COALESCE(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS size,
    ('0x' || substr(md5(COALESCE(CAST(doc_id AS VARCHAR), md5(text), '')), 1, 15))::BIGINT AS h
  FROM documents),
s AS (SELECT source, SUM(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rn FROM d GROUP BY source),
w AS (SELECT *, CASE rn % 3 WHEN 1 THEN 3 WHEN 2 THEN 1 ELSE 2 END AS weight FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * SUM(source_size) OVER ()
      - COALESCE(SUM(2.0::DOUBLE * source_size) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / (SUM(weight) OVER () - COALESCE(SUM(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, rn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))::DOUBLE AS level
  FROM w),
t AS (SELECT source, source_size, least(2.0::DOUBLE * source_size, weight * MAX(level) OVER ()) AS target FROM l),
b AS (SELECT *, CASE WHEN target >= source_size THEN 1 ELSE 0 END AS copies, target - CASE WHEN target >= source_size THEN source_size ELSE 0 END AS budget FROM t),
c AS (
  SELECT d.*, source_size, target, copies, budget, SUM(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS upto
  FROM d JOIN b ON d.source IS NOT DISTINCT FROM b.source),
r AS (SELECT source, any_value(budget) - COALESCE(MAX(upto) FILTER (WHERE upto <= budget), 0) AS room FROM c GROUP BY source),"""
    + "".join(
        _TOP_UP_SQL.format(
            n=n,
            before=f"r{n - 1}" if n > 1 else "r",
            others="".join(f" AND NOT EXISTS (SELECT 1 FROM p{i} WHERE p{i}.source IS NOT DISTINCT FROM c.source AND p{i}.h = c.h)" for i in range(1, n)),
        )
        for n in range(1, TOP_UPS + 1)
    )
    + f"""
x AS ({' UNION ALL '.join(f'SELECT source, h FROM p{n}' for n in range(1, TOP_UPS + 1))})"""
    + """
SELECT doc_id, size, source_size, target,
  size * (copies + CASE WHEN upto <= budget OR EXISTS (SELECT 1 FROM x WHERE x.source IS NOT DISTINCT FROM c.source AND x.h = c.h) THEN 1 ELSE 0 END) AS taken
FROM c
"""
)
