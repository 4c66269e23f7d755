"""Shared helpers: the table reader, word patterns, and tables written to the shared folder between passes."""

from __future__ import annotations

import re
import uuid

from pyspark import Broadcast, cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: A word is a run of anything but space and the ASCII control white space.
WORD = r"[^\x20\x09-\x0D]+"
_WORD = re.compile(WORD)
#: White space for ``str.split`` that is not white space here.
_OTHER_SPACE = re.compile(r"[\x1c-\x1f\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000]")
#: Upper-case ASCII letters to lower case, all else kept.
ASCII_LOWER = {c: c + 32 for c in range(65, 91)}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def words_of(text: str) -> list[str]:
    """Words of a whole text in order; the plain split serves where both definitions of white space agree."""
    return _WORD.findall(text) if _OTHER_SPACE.search(text) else text.split()


def n_words(text: Column) -> Column:
    """Number of words; NULL text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def uniform(seed: int, *columns: Column) -> Column:
    """A number in (0, 1) that depends on the columns and the seed alone, so a rerun draws the same."""
    parts = [F.coalesce(c.cast("string"), F.lit("null")) for c in columns]
    digest = F.substring(F.md5(F.concat_ws(":", *parts, F.lit(str(seed))).cast("binary")), 1, 13)
    return (F.conv(digest, 16, 10).cast("double") + F.lit(0.5)) / F.lit(float(2**52))


def shared_folder(spark: SparkSession, name: str) -> str:
    """A new path in ``spark.checkpoint.dir``, the folder that driver and executors share; it has to be set."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def settle(df: DataFrame, name: str) -> DataFrame:
    """The frame written to the shared folder and read back: later passes read rows, not the plan, and a lost executor
    loses none of them."""
    spark = df.sparkSession
    path = shared_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def share(spark: SparkSession, thing: object) -> Broadcast:
    """A broadcast of an object with its class pickled by value; tasks get it back by ``pickle.loads(shared.value)``."""
    pickled = cloudpickle.dumps(thing)
    del thing  # an object made for this call is not held beside its bytes
    return spark.sparkContext.broadcast(pickled)


def rows_where(docs: DataFrame, text_col: str, verdicts, together: int = 1) -> DataFrame:
    """Rows of ``docs``, all columns kept, by a verdict on each row's own text; ``verdicts()`` gives a task's function from
    ``together`` texts at most to theirs."""
    at = [c.lower() for c in docs.columns].index(text_col.lower())

    def run(batches):
        import pyarrow as pa

        keep = verdicts()
        for batch in batches:
            parts = [batch.column(at).slice(first, together) for first in range(0, len(batch), together)]
            yield batch.filter(pa.array([kept for part in parts for kept in keep([text.as_py() for text in part])], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def keep_rows(docs: DataFrame, id_col: str, ids: DataFrame, inside: bool) -> DataFrame:
    """Rows of ``docs``, all columns kept, whose id is among the one column of ``ids`` (a NULL among NULLs), or is not.

    The other side's column takes a name that the documents don't have.
    """
    name, taken = "id", {c.lower() for c in docs.columns}
    while name in taken:
        name += "_"
    other = ids.toDF(name).distinct()
    return docs.join(other, docs[id_col].eqNullSafe(other[name]), "left_semi" if inside else "left_anti")
