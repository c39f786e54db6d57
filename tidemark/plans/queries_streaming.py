"""Structured Streaming jobs, run to the end of the available data."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.windows import null_if_nan
from tidemark.operators.meta import META_FEATURES
from tidemark.plans import inputs as src
from tidemark.plans import oracle_meta as om
from tidemark.plans.oracle_base import W
from tidemark.plans.registry import register
from tidemark.plans.stage import write_once
from tidemark.session import scratch_dir
from tidemark.streaming import bars as sb
from tidemark.streaming import scoring as sc
from tidemark.streaming import sink

# The run's dates arrive in three deliveries, each read by a restarted query; the last repeats the first LATE_DATES dates.
LATE_DATES = 5


@register("stream_bars", "symbol hour open:6 high:6 low:6 close:6 volume:3", "SELECT * FROM hourly")
def stream_bars(spark, sf):
    out = scratch_dir(spark, "stream-bars")
    sink.run_available(sink.write_batches(sb.stream_bars(sb.read_ticks(spark, sf)), f"{out}/table", f"{out}/checkpoint"))
    return sink.latest(spark, f"{out}/table", ["symbol", "start"]).withColumn("hour", F.date_format("start", "yyyy-MM-dd HH:mm:ss"))


def _places(rows):
    """The place of every date among the rows' dates: a window over the calendar, not over the rows."""
    return rows.select("date").distinct().withColumn("_nth", F.row_number().over(Window.orderBy("date")))


def _scored(spark, sf):
    out = scratch_dir(spark, "stream-score")
    rows = src.run_rows(spark, sf).select(*sc.INPUT)
    rows = write_once(rows.join(_places(rows), "date"), "run-rows")
    last = rows.agg(F.max("_nth")).first()[0] or 0
    for part in range(3):
        now = F.floor((F.col("_nth") - 1) * 3 / max(1, last)) == part
        again = (F.col("_nth") <= LATE_DATES) if part == 2 else F.lit(False)
        rows.where(now | again).drop("_nth").write.mode("append").parquet(f"{out}/inbox")
        stream = spark.readStream.schema(rows.drop("_nth").schema).parquet(f"{out}/inbox")
        sink.run_available(sink.write_batches(sc.stream_score(stream, src.WEIGHT_MODEL), f"{out}/table", f"{out}/checkpoint"))
    scored = spark.read.parquet(f"{out}/table")
    return scored.withColumns({c: null_if_nan(F.col(c)) for c in ("signal", *META_FEATURES)})


@register("stream_score", "symbol date signal:9 w_return:9 w_vol:9 w_regime:9 w_drawdown:9", "SELECT * FROM bt")
def stream_score(spark, sf):
    return _scored(spark, sf)


@register("stream_meta", "symbol date " + " ".join(f"{c}:9" for c in META_FEATURES), "SELECT * FROM meta_live")
def stream_meta(spark, sf):
    return _scored(spark, sf)


@register("stream_state", "symbol date seen:b buffered:i late:b", f"""
SELECT symbol, date, row_number() OVER ({W}) AS seen, least(count(return_pred) OVER ({W} ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 21) AS buffered,
  CASE WHEN 3 * (dense_rank() OVER (ORDER BY date) - 1) // (SELECT count(DISTINCT date) FROM run_rows) = 2 THEN {LATE_DATES} ELSE 0 END AS late
FROM run_rows""")
def stream_state(spark, sf):
    return _scored(spark, sf)


@register("stream_fallback", "symbol n_fallback:b n_scored:b", f"""
SELECT symbol, count(*) FILTER (k = 0) AS n_fallback, count(*) FILTER (k > 0) AS n_scored FROM (
  SELECT symbol, count(w_return) OVER {om.BEFORE} AS k FROM weights_live) GROUP BY symbol""")
def stream_fallback(spark, sf):
    return _scored(spark, sf).groupBy("symbol").agg(
        F.count_if("fallback").alias("n_fallback"), F.count_if(~F.col("fallback")).alias("n_scored")
    )
