"""Stage boundaries of the registered queries: tables that one run of a query writes once and reads several times."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession

from tidemark.session import scratch_dir

_written: dict[tuple[str, str], DataFrame] = {}


def new_run() -> None:
    """Forget the stages of the query before: nothing is carried from one query to the next."""
    _written.clear()


def write_once(df: DataFrame, name: str) -> DataFrame:
    """The rows as a table in the shared scratch folder."""
    path = scratch_dir(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def stage(fn: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """An input that a query may ask for several times, written at the first."""

    @wraps(fn)
    def read(spark: SparkSession, sf_dir: str) -> DataFrame:
        key = (fn.__name__, sf_dir)
        if key not in _written:
            _written[key] = write_once(fn(spark, sf_dir), fn.__name__.replace("_", "-"))
        return _written[key]

    return read


def written(fn: Callable[[SparkSession, str], DataFrame], sf_dir: str) -> bool:
    """Whether this run has the stage already."""
    return (fn.__name__, sf_dir) in _written
