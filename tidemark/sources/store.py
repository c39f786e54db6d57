"""Versioned feature store and run-scoped sinks, on any Hadoop-compatible path."""

from __future__ import annotations

from contextlib import contextmanager

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

WEIGHT_AUDIT = T.StructType(
    [
        T.StructField("symbol", T.StringType()),
        T.StructField("date", T.DateType()),
        T.StructField("return_w", T.DoubleType()),
        T.StructField("vol_w", T.DoubleType()),
        T.StructField("regime_w", T.DoubleType()),
        T.StructField("drawdown_w", T.DoubleType()),
        T.StructField("run_id", T.StringType()),
    ]
)
#: A row as it is stored: with the append or micro-batch it came in.
SLICE = T.StructType([*WEIGHT_AUDIT.fields, T.StructField("slice", T.LongType())])
WEIGHT_COLS = {"w_return": "return_w", "w_vol": "vol_w", "w_regime": "regime_w", "w_drawdown": "drawdown_w"}


def _listing(spark: SparkSession, path: str) -> list[str]:
    """Child folder names of a path ([] when it does not exist)."""
    jvm_path = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    fs = jvm_path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    return [s.getPath().getName() for s in fs.listStatus(jvm_path)] if fs.exists(jvm_path) else []


class FeatureStore:
    """``{root}/{name}/version={n}`` parquet folders with a JSON side-car each."""

    def __init__(self, spark: SparkSession, root: str) -> None:
        self.spark, self.root = spark, root.rstrip("/")

    def versions(self, name: str) -> list[int]:
        found = [d.split("=", 1)[1] for d in _listing(self.spark, f"{self.root}/{name}") if d.startswith("version=")]
        return sorted(int(v) for v in found if v.isdigit())

    def path(self, name: str, version: int) -> str:
        return f"{self.root}/{name}/version={version}"

    def save(self, df: DataFrame, name: str, version: int = 1) -> int:
        """Write a new version; a taken number moves on to the next free one.

        ``errorifexists`` decides the race between two writers, so neither can
        overwrite the other.
        """
        taken = set(self.versions(name))
        while True:
            while version in taken:
                version += 1
            try:
                df.write.mode("errorifexists").parquet(self.path(name, version))
                break
            except AnalysisException:
                if version not in self.versions(name):
                    raise
                taken.add(version)
        self.describe(name, version).write.mode("overwrite").json(f"{self.root}/{name}_meta/version={version}")
        return version

    def describe(self, name: str, version: int) -> DataFrame:
        """Side-car row: shape, columns and date span, from the written files."""
        df = self.spark.read.parquet(self.path(name, version))
        day = F.col("date") if "date" in df.columns else F.lit(None).cast("date")  # tables of statistics have no dates
        return df.agg(
            F.count(F.lit(1)).alias("n_rows"), F.min(day).alias("index_start"), F.max(day).alias("index_end")
        ).select(
            F.lit(name).alias("name"),
            F.lit(version).alias("version"),
            F.current_timestamp().alias("date_created"),
            "n_rows",
            F.lit(len(df.columns)).alias("n_columns"),
            F.array(*[F.lit(c) for c in df.columns]).alias("columns"),
            "index_start",
            "index_end",
        )

    def resolve(self, name: str, version: int | str = "latest") -> int:
        known = self.versions(name)
        if version == "latest":
            if not known:
                raise FileNotFoundError(f"no saved version of {name!r} under {self.root}")
            return known[-1]
        if int(version) not in known:
            raise FileNotFoundError(f"{name!r} has no version {version}; available: {known}")
        return int(version)

    def load(self, name: str, version: int | str = "latest") -> DataFrame:
        return self.spark.read.parquet(self.path(name, self.resolve(name, version)))

    def metadata(self, name: str, version: int | str = "latest") -> DataFrame:
        return self.spark.read.json(f"{self.root}/{name}_meta/version={self.resolve(name, version)}")


def write_panel(df: DataFrame, path: str, mode: str = "overwrite", buckets: int | None = None) -> None:
    """One folder per symbol, or per hash bucket of symbols when there are very many.

    Rows are clustered by (symbol, year) before writing, so a symbol with a third
    of all rows is written by as many tasks as it has years.
    """
    if buckets:
        df = df.withColumn("bucket", F.pmod(F.hash("symbol"), F.lit(buckets)))
    key = "bucket" if buckets else "symbol"
    df.repartition(key, F.year("date")).sortWithinPartitions(key, "symbol", "date").write.mode(mode).partitionBy(key).parquet(path)


@contextmanager
def sorted_buckets(spark: SparkSession):
    """Plans made inside trust the order inside a bucket's one file, so that windows by symbol need no sort."""
    key = "spark.sql.legacy.bucketedTableScan.outputOrdering"
    before = spark.conf.get(key)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.set(key, before)


def write_buckets(df: DataFrame, table: str, path: str, buckets: int, sort: str = "date") -> DataFrame:
    """A catalog table of one file per bucket of symbols, sorted by (symbol, date): every later window or join by symbol reads
    it without an exchange, and, inside ``sorted_buckets``, without a sort.

    A bucket holds whole symbols, each no longer than the calendar; choose the buckets so that one fits a task.
    """
    rows = df.repartition(buckets, "symbol")
    rows.write.mode("overwrite").bucketBy(buckets, "symbol").sortBy("symbol", sort).option("path", path).format("parquet").saveAsTable(table)
    return df.sparkSession.table(table)


def write_table(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    """Predictions, meta-features and similar results, sorted inside files only."""
    keys = [c for c in ("symbol", "date") if c in df.columns]
    (df.sortWithinPartitions(*keys) if keys else df).write.mode(mode).parquet(path)


def write_json(df: DataFrame, path: str, mode: str = "overwrite") -> None:
    df.write.mode(mode).json(path)


def metric_rows(df: DataFrame, metrics: list[str], run_id: str, model: str, keys: list[str]) -> DataFrame:
    """Wide metrics to (run_id, model, keys..., metric, value)."""
    wide = df.select(*keys, *[F.col(m).cast("double").alias(m) for m in metrics])
    return wide.unpivot(keys, metrics, "metric", "value").select(
        F.lit(run_id).alias("run_id"), F.lit(model).alias("model"), *keys, "metric", "value"
    )


class WeightAudit:
    """Audit log of model weights: ``{path}/run_id=R/slice={first}-{last}`` folders, one per append or micro-batch.

    An append writes its own rows and nothing else; rows of one (symbol, date) are told apart by their slice, the latest
    counts. ``FAN`` neighbouring slices of one width are merged into one, so a run has few folders and a row is rewritten
    as often as the logarithm of the number of appends. A merged slice replaces the ones it spans as soon as its
    success mark is there: readers skip spanned slices, so the merge may be interrupted at any point. A micro-batch that is
    delivered again overwrites its own slice. One writer per run at a time, as a stream has.
    """

    FAN = 8

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _folder(self, run_id: str, first: int, last: int) -> str:
        return f"{self.path}/run_id={run_id}/slice={first}-{last}"

    def slices(self, run_id: str) -> list[tuple[int, int]]:
        """(first, last) of the slices that count, in order."""
        found = []
        for name in _listing(self.spark, f"{self.path}/run_id={run_id}"):
            first, _, last = name.removeprefix("slice=").partition("-")
            if first.isdigit() and last.isdigit() and "_SUCCESS" in _listing(self.spark, f"{self.path}/run_id={run_id}/{name}"):
                found.append((int(first), int(last)))
        out: list[tuple[int, int]] = []
        for first, last in sorted(found, key=lambda x: (x[0], -x[1])):
            if not out or last > out[-1][1]:
                out.append((first, last))
        return out

    def runs(self) -> list[str]:
        return sorted(n.removeprefix("run_id=") for n in _listing(self.spark, self.path) if n.startswith("run_id="))

    def _write(self, rows: DataFrame, run_id: str, first: int, last: int) -> None:
        rows.select(*SLICE.fieldNames()).write.mode("overwrite").parquet(self._folder(run_id, first, last))

    def append(self, weights: DataFrame, run_id: str, batch: int | None = None) -> None:
        """Adds a run's rows; a row that was there before is replaced. ``batch`` numbers a stream's micro-batches: one
        that is delivered again leaves its rows once."""
        held = self.slices(run_id)
        if batch is None:
            batch = held[-1][1] + 1 if held else 0
        if any(first <= batch <= last and first < last for first, last in held):
            return  # merged since: it was complete then
        rows = weights.withColumnsRenamed({k: v for k, v in WEIGHT_COLS.items() if k in weights.columns})
        self._write(rows.withColumns({"run_id": F.lit(run_id), "slice": F.lit(batch).cast("long")}), run_id, batch, batch)
        self._merge(run_id, before=batch)

    def _merge(self, run_id: str, before: int) -> None:
        """Merges the last ``FAN`` slices of one width that end before the newest one, for as long as there are that many."""
        while True:
            done = [x for x in self.slices(run_id) if x[1] < before]
            group = done[-self.FAN :]
            if len(group) < self.FAN or len({self._rank(x) for x in group}) > 1:
                return
            self._write(self._latest(self._read(run_id, group)), run_id, group[0][0], group[-1][1])
            for first, last in group:
                self._delete(self._folder(run_id, first, last))

    def _rank(self, span: tuple[int, int]) -> int:
        """Number of merges behind a slice, by its width."""
        rank, width = 0, span[1] - span[0] + 1
        while width >= self.FAN:
            rank, width = rank + 1, width // self.FAN
        return rank

    def _delete(self, folder: str) -> None:
        jvm_path = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(folder)
        jvm_path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).delete(jvm_path, True)

    def _read(self, run_id: str, spans: list[tuple[int, int]]) -> DataFrame:
        if not spans:
            return self.spark.createDataFrame([], SLICE)
        return self.spark.read.schema(SLICE).parquet(*[self._folder(run_id, *x) for x in spans])

    @staticmethod
    def _latest(rows: DataFrame) -> DataFrame:
        values = [c for c in SLICE.fieldNames() if c not in ("run_id", "symbol", "date")]
        last = rows.groupBy("run_id", "symbol", "date").agg(F.max_by(F.struct(*values), "slice").alias("_v"))
        return last.select("run_id", "symbol", "date", "_v.*")

    def replace(self, weights: DataFrame, run_id: str) -> None:
        """Batch write of a whole run, replacing what that run wrote before: the old slices stay until the new one is there."""
        held = self.slices(run_id)
        rows = weights.withColumnsRenamed({k: v for k, v in WEIGHT_COLS.items() if k in weights.columns})
        at = held[-1][1] + 1 if held else 0
        self._write(rows.withColumns({"run_id": F.lit(run_id), "slice": F.lit(at).cast("long")}), run_id, 0, at)
        for first, last in held:
            if (first, last) != (0, at):
                self._delete(self._folder(run_id, first, last))

    def clear(self, run_id: str) -> None:
        """Empty one run's folder and keep the log readable."""
        self.replace(self.spark.createDataFrame([], T.StructType(WEIGHT_AUDIT.fields[:-1])), run_id)

    def load(self, run_id: str | None = None) -> DataFrame:
        """The rows of one run, or of all."""
        out = None
        for run in [run_id] if run_id is not None else self.runs():
            rows = self._read(run, self.slices(run))
            out = rows if out is None else out.unionByName(rows)
        out = self.spark.createDataFrame([], SLICE) if out is None else out
        return self._latest(out).select(*WEIGHT_AUDIT.fieldNames())
