"""Reuse of earlier responses: digests of inputs, reusable and remaining work, and the store's upkeep.

store and work have kind, target_id and input_digest; a store row also has response (JSON text) and stored_at (an order).

On disk a store is a folder of Parquet files by kind and bucket (of target and digest). A batch rewrites the buckets that it has rows for, each with the
latest row of every key, and leaves the files of all others alone. A batch may be written again at any time: the store stays the same.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from leadmill.functions.canonical import json_digest  # noqa: F401: the digest of free-form JSON, beside that of typed values
from leadmill.functions.lineage import settled
from leadmill.functions.text import canonical
from leadmill.operators.gates import validate

KEY = ["kind", "target_id", "input_digest"]
_COLUMNS = [*KEY, "response", "stored_at"]
#: Buckets of a kind. A store keeps the number that it was begun with.
BUCKETS = 64


def typed_digest(value: Column, kind: T.DataType) -> Column:
    """sha256 of a typed value's JSON with sorted keys; arrays keep their order."""
    return F.sha2(canonical(value, kind), 256)


def usable_store(store: DataFrame, contract: str, prefix: str = "F-") -> DataFrame:
    """Stored rows whose response still meets its contract; a broken one is a miss, never an error."""
    return validate(contract, store, "response", prefix).where("valid").drop("valid", "errors")


def split_reusable(work: DataFrame, store: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Work with the stored response of the same kind, target and digest, and work that's left to do."""
    latest = latest_of(store)
    return work.join(latest.select(*KEY, "response"), KEY), work.join(latest.select(*KEY), KEY, "left_anti")


def latest_of(store: DataFrame) -> DataFrame:
    """Of rows with the same key the one stored last; ties go to the greatest response."""
    return store.withColumn("__n", F.row_number().over(Window.partitionBy(*KEY).orderBy(F.desc("stored_at"), F.desc("response")))).where("__n = 1").drop("__n")


def stored(store: DataFrame, fresh: DataFrame) -> DataFrame:
    """The store with fresh responses that passed all gates (`passed`); a later one of the same key takes its place."""
    return latest_of(store.select(*_COLUMNS).union(fresh.where("passed").select(*_COLUMNS)))


def read_store(spark: SparkSession, path: str) -> DataFrame | None:
    """The rows of the store in a folder, or null where there is none yet."""
    try:
        return spark.read.parquet(path).select(*_COLUMNS, "bucket")
    except AnalysisException as e:
        if e.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return None


def write_store(fresh: DataFrame, path: str, buckets: int = BUCKETS) -> None:
    """Adds fresh responses that passed all gates (`passed`) to the store in a folder; a later one of the same key takes its place.

    What is written is settled first, so a task that runs again never reads files that this batch has replaced.
    """
    new = fresh.where("passed").select(*_COLUMNS, F.pmod(F.xxhash64("target_id", "input_digest"), F.lit(buckets)).cast("int").alias("bucket"))
    old = read_store(fresh.sparkSession, path)
    if old is not None:
        touched = new.select("kind", "bucket").distinct()  # at most `buckets` rows for each kind
        new = old.join(F.broadcast(touched), ["kind", "bucket"], "left_semi").select(*new.columns).union(new)
    rows = settled(latest_of(new)).repartition("kind", "bucket")
    rows.write.partitionBy("kind", "bucket").mode("overwrite").option("partitionOverwriteMode", "dynamic").parquet(path)
