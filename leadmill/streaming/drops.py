"""SARIF files that arrive in a folder, read as a stream.

Resolving results needs only their own document, so each micro-batch goes through the batch operators unchanged. Whatever needs a
whole run (numbering leads, merging findings, budgets) is a batch job over the tables that are written here.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from leadmill.operators import leads


def sarif_stream(spark: SparkSession, folder: str, files_at_once: int = 1000) -> DataFrame:
    """run_id, doc, text of new files below `folder`/<run>/."""
    text = spark.readStream.format("text").option("wholetext", "true").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_at_once).load(folder)
    return text.select(F.element_at(F.split("_metadata.file_path", "/"), -2).alias("run_id"), F.col("_metadata.file_name").alias("doc"), F.col("value").alias("text"))


def write_leads(docs: DataFrame, manifest: DataFrame, rule_map: DataFrame, root: str, out: str, checkpoint: str) -> StreamingQuery:
    """Leads of each micro-batch, not numbered yet, as Parquet below `out`, in a folder per batch, so that a repeated batch replaces itself."""

    def one(batch: DataFrame, number: int) -> None:
        results = leads.resolved_results(batch, manifest, rule_map, root)
        leads.lead_rows(results, leads.codeflows(results, manifest, root)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return docs.writeStream.foreachBatch(one).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_leads(spark: SparkSession, out: str) -> DataFrame:
    """The leads of all documents that have arrived, numbered per run."""
    return leads.numbered(spark.read.parquet(out).drop("batch"))
