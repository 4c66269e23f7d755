"""The corpus pipeline over ``documents``: five stages, each on all rows that the one before kept.

toxicity drops documents predicted toxic; near_dup keeps the document of the smallest id of each group of near copies;
decontaminate drops documents with a passage of ``benchmark``; mix keeps a document as often as the mix takes it, 0 to 3
times; shard puts the rows into 24 shards of equal bytes.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarterglass.llm import decontaminate, mixing, near_dup, sharding, toxicity
from quarterglass.llm.common import settle, table

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels")).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.deduplicate(docs).select(*COLUMNS)


def drop_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return decontaminate.decontaminate(docs, table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as many times as the mix takes it; documents without words, which no target asks for, once."""
    rows = settle(docs.withColumn("__row", F.monotonically_increasing_id()), "rows")  # stored, so that a key stays with its row
    times = F.when(F.col("size") == 0, 1).otherwise(F.col("taken") / F.col("size")).cast("int").alias("__times")
    taken = rows.join(mixing.mix(rows, row_col="__row").select(F.col("row_key").alias("__row"), times), "__row")
    return taken.withColumn("__turn", F.explode(F.array_repeat(F.lit(0), F.col("__times")))).select(*COLUMNS)


def put_into_shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """(doc_id, size, text_crc32, law, shard, slot, grown_shard) of every row."""
    return sharding.shard(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_dup", drop_near_duplicates),
    ("decontaminate", drop_benchmark),
    ("mix", mix_sources),
    ("shard", put_into_shards),
]

#: The first stages are learned and hashed; SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = settle(docs, f"stage-{name}")
    return docs
