"""Helpers that several operators share."""

from __future__ import annotations

import math
import tempfile

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The separators of a word: a word is a run of other characters.
SPACE = r"[\x20\x09-\x0D]"


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def whole_text(name: str = "text") -> Column:
    """The text, empty where it is null."""
    return F.coalesce(F.col(name), F.lit(""))


def as_bytes(name: str = "text") -> Column:
    """UTF-8 bytes of the whole text, empty where it is null."""
    return F.coalesce(F.col(name).cast("binary"), F.lit(bytearray()).cast("binary"))


def reliable(df: DataFrame) -> DataFrame:
    """Checkpoint in the cluster's shared folder (spark.checkpoint.dir), so that a lost executor loses nothing.

    A folder of our own is set only where the session names none, as in local tests.
    """
    spark = df.sparkSession
    if not spark.conf.get("spark.checkpoint.dir", None) and spark.sparkContext.getCheckpointDir() is None:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="spark-"))
    return df.checkpoint()


def text_volume(docs: DataFrame, name: str = "text") -> tuple[int, int]:
    """Rows, and bytes of text: two numbers, from which partition counts follow."""
    row = docs.agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length(name)).alias("b")).first()
    return int(row["n"] or 0), int(row["b"] or 0)


def parts(amount: int, each: int, least: int = 1) -> int:
    return max(least, math.ceil(amount / each))


#: Rows of one key in a task, and rows up to which a table of hot keys is broadcast (its keys are short).
DEALT, FEW = 1 << 14, 1 << 16


def join_dealt(left: DataFrame, right: DataFrame, key: str, how: str = "inner", each: int = DEALT) -> DataFrame:
    """`left` joined with `right` by `key`, the rows of a hot key of `left` dealt to as many tasks as their count needs; `right` goes to each of these once.

    `left` is read twice. Null keys join nothing.
    """
    hot = reliable(left.groupBy(key).agg(F.count(F.lit(1)).alias("__n")).where(F.col("__n") > each).select(key, F.ceil(F.col("__n") / each).cast("int").alias("__salts")))
    hot = F.broadcast(hot) if hot.count() <= FEW else hot
    salts = F.coalesce("__salts", F.lit(1))
    dealt = left.join(hot, key, "left").withColumn("__salt", F.pmod(F.monotonically_increasing_id(), salts).cast("int")).drop("__salts")
    sent = right.join(hot, key, "left").withColumn("__salt", F.explode(F.sequence(F.lit(0), salts - 1))).drop("__salts")
    return dealt.join(sent.hint("merge"), [key, "__salt"], how).drop("__salt")
