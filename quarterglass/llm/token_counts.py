"""Token counts without ids: pieces are counted once per distinct pre-token and joined to per-document frequencies.

The most frequent pre-tokens of the corpus, a table of bounded size, go to every task; all others are joined by a
shuffle on the pre-token, so neither side of that join has a hot key and nothing that grows with the corpus is broadcast.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterglass.llm.chunks import Memo, Pieces, chunks_of, kept
from quarterglass.llm.common import settle


def _frequencies(path: str, most: int = 400_000):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = kept(f"pieces of {path}", lambda: Pieces(path)).split
        chunks: Counter = Counter()

        def flush() -> pa.RecordBatch:
            found: Counter = Counter()
            for chunk, n in chunks.items():
                for piece in cut(chunk):
                    found[piece] += n
            chunks.clear()
            return pa.RecordBatch.from_arrays([pa.array(list(found), pa.string()), pa.array(list(found.values()), pa.int64())], ["piece", "n"])

        for batch in batches:
            for text in batch.column(0):
                chunks.update(chunks_of(text.as_py() or ""))
                if len(chunks) >= most:
                    yield flush()
        if chunks:
            yield flush()

    return run


def _pieces(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = kept(f"pieces of {path}", lambda: Pieces(path)).ids
        for batch in batches:
            counts = pa.array([len(ids(p)) for p in batch.column("piece").to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column("piece"), batch.column("n"), counts], ["piece", "n", "n_pieces"])

    return run


def _documents(path: str, head):
    """Per document one row with the tokens of its frequent pre-tokens (piece NULL) and one per other pre-token; ``row``
    numbers the input's rows, whatever their ids."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cut = kept(f"pieces of {path}", lambda: Pieces(path)).split
        known = dict(zip(head.value[0].to_pylist(), head.value[1].to_pylist(), strict=True))

        others: list[tuple[int, list[str]]] = []

        def worth(chunk: str) -> int:
            """Its tokens; below 0 the place in ``others`` of a chunk with a pre-token that is not known."""
            if chunk in known:  # a pre-token is not cut any further
                return known[chunk]
            parts = cut(chunk)
            rest = [p for p in parts if p not in known]
            if rest:
                others.append((sum(known.get(p, 0) for p in parts), rest))
                return -len(others)
            return sum(known[p] for p in parts)

        memo, row = Memo(worth), TaskContext.get().partitionId() << 40
        for batch in batches:
            rows: tuple[list, ...] = ([], [], [], [], [])
            for doc_id, n_bytes, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                row, total, rest = row + 1, 0, {}
                chunks = chunks_of(text.as_py() or "")
                for at in range(0, len(chunks), 100_000):
                    part = chunks[at : at + 100_000]
                    if len(memo) + len(part) > memo.most:  # places have to stay valid until they are looked up
                        memo.clear()
                        others.clear()
                    worths = np.fromiter(map(memo.__getitem__, part), np.int64, len(part))
                    total += int(worths[worths >= 0].sum())
                    for place in worths[worths < 0].tolist():
                        tokens, parts = others[-place - 1]
                        total += tokens
                        for p in parts:
                            rest[p] = rest.get(p, 0) + 1
                rows[0].extend([row] * (1 + len(rest)))
                rows[1].extend([doc_id.as_py(), *[None] * len(rest)])
                rows[2].extend([n_bytes.as_py(), *[None] * len(rest)])
                rows[3].extend([None, *rest])
                rows[4].extend([total, *rest.values()])
                if len(rows[0]) >= 50_000:
                    yield _rows(rows)
                    rows = ([], [], [], [], [])
            if rows[0]:
                yield _rows(rows)

    return run


_ROWS = "row long, doc_id long, n_bytes long, piece string, n long"


def _rows(rows: tuple[list, ...]) -> pa.RecordBatch:
    types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.int64())
    names = [c.split()[0] for c in _ROWS.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(r, t) for r, t in zip(rows, types, strict=True)], names)


def _least_frequency(pieces: DataFrame, head_size: int) -> int:
    """The smallest frequency whose pre-tokens of it or a greater one number ``head_size`` at most, to within a sixteenth of
    a doubling: a histogram of at most 1,024 rows tells it, so that no task gathers or orders pre-tokens."""
    step = F.floor(F.log2("n") * 16).cast("int")
    cells = pieces.groupBy(step.alias("step")).agg(F.count("*").alias("pieces"), F.min("n").alias("least")).orderBy(F.col("step").desc()).collect()
    taken, least = 0, 2**62
    for cell in cells:
        taken += cell["pieces"]
        if taken > head_size:
            break
        least = cell["least"]
    return least


def count_tokens(
    docs: DataFrame,
    tokenizer_path: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    limit: int = 512,
    head_size: int = 200_000,
) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) per row, equal to what the tokenizers library gives for the whole text by the
    file ``tokenizer_path``, which has to be readable on the executors; for tokenizers without a normalizer.

    NULL or empty text has no bytes and no tokens. Ids are carried along only: repeated and NULL ids give a row each.
    An empty table gives no row. ``head_size`` bounds the broadcast table of frequent
    pre-tokens; it changes the plan only, never a count.
    """
    spark = docs.sparkSession
    n_bytes = F.coalesce(F.octet_length(text_col), F.lit(0)).cast("long")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), n_bytes.alias("n_bytes"), F.col(text_col).alias("text"))
    found = texts.select("text").mapInArrow(_frequencies(tokenizer_path), "piece string, n long")
    distinct = found.groupBy("piece").agg(F.sum("n").alias("n"))
    pieces = settle(distinct.mapInArrow(_pieces(tokenizer_path), "piece string, n long, n_pieces int"), "pieces")

    head = pieces.filter(F.col("n") >= _least_frequency(pieces, head_size)).select("piece", "n_pieces").toArrow()  # head_size rows at most
    shared = spark.sparkContext.broadcast((head.column(0).combine_chunks(), head.column(1).combine_chunks()))

    rows = settle(texts.mapInArrow(_documents(tokenizer_path, shared), _ROWS), "frequencies")
    joined = rows.filter("piece IS NOT NULL").join(pieces.select("piece", "n_pieces"), "piece")
    joined = joined.groupBy("row").agg(F.sum(F.col("n") * F.col("n_pieces")).alias("joined"))
    direct = rows.filter("piece IS NULL").select("row", "doc_id", "n_bytes", "n")
    n_tokens = F.col("n") + F.coalesce("joined", F.lit(0))
    return direct.join(joined, "row", "left").select("doc_id", "n_bytes", n_tokens.alias("n_tokens"), (n_tokens > limit).alias("over_limit"))
