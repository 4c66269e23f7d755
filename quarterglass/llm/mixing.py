"""Mixing sources to target weights: weighted sampling without replacement by exponential keys, in DataFrame functions.

Every source gets a target in words; a document is taken whole or not at all in each pass over its source (an epoch).
Complete epochs take every document. The rest of the target is drawn by Efraimidis-Spirakis keys ``u ** (1 / quality)``,
largest first, up to the budget.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterglass.llm.common import n_words, settle, uniform

#: Characters of a word and its space in prose, about; a fixed reference point of the quality weight.
PROSE_CHARS = 6.5


def quality_weight(text: Column, size: Column) -> Column:
    """0.1 to 1: how near the characters per word are to those of prose. 0.1 without words."""
    ratio = F.length(text).cast("double") / (size.cast("double") * PROSE_CHARS)
    near = F.least(ratio, 1.0 / ratio)
    return F.when(size == 0, 0.1).otherwise(F.greatest(F.coalesce(near, F.lit(0.1)), F.lit(0.1)))


def key_cell(key: Column, cells: int) -> Column:
    """Ascending as keys fall: ``cells`` cells per doubling of ``-ln(key)``."""
    return F.floor(F.log2(F.greatest(-F.log(key), F.lit(2.0**-54))) * cells).cast("int")


def source_targets(sizes: DataFrame, shares: Sequence[int], max_epochs: int) -> DataFrame:
    """(source_key, source, source_size) plus ``target``: shares of all words by weight, none above ``max_epochs`` times
    its source, what is over reshared by weight.

    The level of that filling is closed: in ascending order of cap per weight a source is full while its cap lies at or
    under the level that the words left over give to the weight left over. One row per source.
    """
    ranked = sizes.withColumn("place", F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1)
    weight = F.element_at(F.array(*[F.lit(int(s)) for s in shares]), (F.col("place") % len(shares) + 1).cast("int"))
    capped = ranked.withColumn("weight", weight).withColumn("cap", F.col("source_size") * max_epochs)
    order = W.orderBy(F.col("cap") / F.col("weight"), "place")
    before, everything = order.rowsBetween(W.unboundedPreceding, -1), W.partitionBy()
    left = F.sum("source_size").over(everything) - F.coalesce(F.sum("cap").over(before), F.lit(0))
    weight_left = F.sum("weight").over(everything) - F.coalesce(F.sum("weight").over(before), F.lit(0))
    level = capped.withColumn("level", left.cast("double") / weight_left)
    is_open = F.when(F.col("cap") > F.col("level") * F.col("weight"), F.struct("cap", "level", "weight"))
    first_open = F.min(F.when(is_open.isNotNull(), F.struct(F.col("cap") / F.col("weight"), "place", "level")))
    filled = level.withColumn("fill", first_open.over(everything)["level"])
    target = F.least(F.col("cap").cast("double"), F.coalesce(F.col("fill") * F.col("weight"), F.col("cap").cast("double")))
    return filled.select("source_key", "source_size", target.alias("target"))


def mix(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    source_col: str = "source",
    shares: Sequence[int] = (5, 2, 1),
    max_epochs: int = 3,
    seed: int = 7,
    cells: int = 1024,
    row_col: str | None = None,
) -> DataFrame:
    """(doc_id, size, source_size, target, taken) for every row; other columns of the input are neither read nor kept, but
    for ``row_col``, a stored unique key of rows, which is the first column as ``row_key`` where it is given.

    NULL text has size 0; NULL source is a source, the last; rows that are repeated are rows of their own; equal keys
    are ordered by id, size and a hash of the text, so that rows still tied are alike and reruns agree. A source without
    words has target 0; an empty table gives no row. A source's taken words miss its
    target by half a document at most. Sorting goes by (source, key cell), not by source: a source may hold any share of
    the rows, and the prefix sum over the cells of a source carries on into its cells. There are ``cells`` cells per
    doubling of ``-ln(key)``, which is exponential for any quality: the fullest holds 1 in 4,000 rows of the source, and
    a source has at most 65,000. Targets are computed from one row per source, by one task.
    """
    size = n_words(F.col(text_col))
    key = [F.col(row_col).alias("row_key")] if row_col else []
    base = docs.select(
        *key,
        F.col(id_col).alias("doc_id"),
        F.col(source_col).cast("string").alias("source"),
        F.coalesce(F.concat(F.lit("s"), F.col(source_col).cast("string")), F.lit("n")).alias("source_key"),
        size.alias("size"),
        quality_weight(F.col(text_col), size).alias("quality"),
        F.xxhash64(F.col(text_col)).alias("text_hash"),
    )
    base = settle(base, "mix")
    sizes = base.groupBy("source_key", "source").agg(F.sum("size").alias("source_size"))
    targets = source_targets(sizes, shares, max_epochs)

    keyed = base.withColumn("key", F.pow(uniform(seed, F.col("doc_id")), F.lit(1.0) / F.col("quality")))
    keyed = keyed.withColumn("cell", key_cell(F.col("key"), cells))
    per_cell = keyed.groupBy("source_key", "cell").agg(F.sum("size").alias("cell_size"))
    ahead = W.partitionBy("source_key").orderBy("cell").rowsBetween(W.unboundedPreceding, -1)
    per_cell = per_cell.withColumn("cell_start", F.coalesce(F.sum("cell_size").over(ahead), F.lit(0)))
    placed = keyed.join(per_cell.drop("cell_size"), ["source_key", "cell"]).join(targets, "source_key")
    inside = W.partitionBy("source_key", "cell").orderBy(F.col("key").desc(), "doc_id", "size", "text_hash", *["row_key"][: len(key)]).rowsBetween(W.unboundedPreceding, -1)
    before = F.col("cell_start") + F.coalesce(F.sum("size").over(inside), F.lit(0))

    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    rest = F.col("target") - F.col("epochs") * F.col("source_size")
    drawn = F.col("before") + F.col("size") / 2 <= F.col("rest")
    passes = F.col("epochs") + F.when(drawn, 1).otherwise(0)
    return (
        placed.withColumn("before", before)
        .withColumn("epochs", F.least(epochs, F.lit(max_epochs)).cast("long"))
        .withColumn("rest", rest)
        .select(*["row_key"][: len(key)], "doc_id", "size", "source_size", "target", (F.col("size") * passes).cast("long").alias("taken"))
    )
