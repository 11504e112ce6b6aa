"""The tables the operators start from, with keys that bear nulls and clashes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitsieve.functions.session import scratch_path
from traitsieve.llm.packets import NO_ID


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def keyed_texts(docs: DataFrame, partitions: int, others: tuple[str, ...] = ()) -> DataFrame:
    """``rid``, ``text`` and other columns, dealt out by ``rid``; a missing doc_id ranks after all others.

    Plans that use this more than once shuffle the texts once: Spark reuses the exchange.
    """
    rid = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    return docs.select(rid.alias("rid"), "text", *others).repartition(partitions, "rid")


def doc_id_of(rid: str = "rid") -> "F.Column":
    return F.when(F.col(rid) != NO_ID, F.col(rid)).alias("doc_id")


def written(df: DataFrame, name: str) -> DataFrame:
    """Write to the cluster's shared folder and go on from the files."""
    path = scratch_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def later_copies(docs: DataFrame) -> DataFrame:
    """``rid`` of documents all of whose rows repeat the text of a smaller doc_id."""
    rid = F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID))
    rows = docs.select(rid.alias("rid"), F.md5(F.coalesce("text", F.lit(""))).alias("digest"))
    firsts = rows.groupBy("digest").agg(F.min("rid").alias("first"), F.max("rid").alias("last"))
    firsts = firsts.where("first < last").select("digest", "first")
    return (
        rows.join(firsts, "digest", "left")
        .groupBy("rid")
        .agg(F.min(F.coalesce(F.col("rid") > F.col("first"), F.lit(False))).alias("copy"))
        .where("copy")
    )
