"""Token ids in bit-packed files: each id takes the fewest bits that hold the vocabulary, read back by block.

File layout, numbers little-endian: ``QBP1``, width (u32), ids per block (u32); the blocks, ids packed from the lowest
bit on, each block from a whole byte; then the index: block offsets (u64, one more than blocks), document ids (i64),
ids before each document (u64, one more than documents), and a mask of NULL document ids (u8); last the index's offset,
the numbers of blocks and documents (u64 each) and ``QBP1``. A block's place follows from the index, so any document is
read by the blocks that it touches.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quarterglass.llm.chunks import Memo, Pieces, chunks_of, kept, packed
from quarterglass.llm.common import settle, shared_folder

MAGIC = b"QBP1"
BLOCK_IDS = 1 << 16


def width_of(vocabulary: int) -> int:
    """Bits that hold every id below ``vocabulary``."""
    return max(1, (vocabulary - 1).bit_length())


def pack(ids: np.ndarray, width: int) -> bytes:
    """Ids in ``width`` bits each, lowest bit first; whole little-endian words are that layout already."""
    if width in (8, 16, 32):
        return ids.astype(f"<u{width // 8}").tobytes()
    bits = np.unpackbits(ids.astype("<u4").view(np.uint8), bitorder="little").reshape(-1, 32)[:, :width]
    return np.packbits(bits.ravel(), bitorder="little").tobytes()


def unpack(data: bytes, n: int, width: int) -> np.ndarray:
    """The first ``n`` ids of a block, as little-endian unsigned 32-bit integers."""
    if width in (8, 16, 32):
        return np.frombuffer(data, f"<u{width // 8}", n).astype("<u4")
    bits = np.unpackbits(np.frombuffer(data, np.uint8), count=n * width, bitorder="little").reshape(n, width)
    full = np.zeros((n, 32), np.uint8)
    full[:, :width] = bits
    return np.packbits(full.ravel(), bitorder="little").view("<u4")


class Writer:
    """Streams documents into one file; at most one block of ids is held."""

    def __init__(self, out, width: int, block_ids: int = BLOCK_IDS):
        self.out, self.width, self.block_ids = out, width, block_ids
        self.held: list[np.ndarray] = []
        self.n_held, self.at = 0, 12
        self.offsets, self.docs, self.starts = [12], [], [0]
        out.write(MAGIC + struct.pack("<II", width, block_ids))

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.starts.append(self.starts[-1] + len(ids))
        self.held.append(ids)
        self.n_held += len(ids)
        if self.n_held >= self.block_ids:
            whole = np.concatenate(self.held)
            full = len(whole) // self.block_ids * self.block_ids
            for at in range(0, full, self.block_ids):
                self._block(whole[at : at + self.block_ids])
            self.held, self.n_held = [whole[full:].copy()], len(whole) - full

    def _block(self, ids: np.ndarray) -> None:
        data = pack(ids, self.width)
        self.out.write(data)
        self.at += len(data)
        self.offsets.append(self.at)

    def close(self) -> None:
        if self.n_held:
            self._block(np.concatenate(self.held))
        null = np.array([d is None for d in self.docs], np.uint8)
        docs = np.array([d or 0 for d in self.docs], "<i8")
        self.out.write(np.array(self.offsets, "<u8").tobytes() + docs.tobytes() + np.array(self.starts, "<u8").tobytes() + null.tobytes())
        self.out.write(struct.pack("<QQQ", self.at, len(self.offsets) - 1, len(self.docs)) + MAGIC)


class Reader:
    """One file by its index; ``ids`` gives any run of ids, ``documents`` streams all of them block by block."""

    def __init__(self, uri: str):
        files, path = pafs.FileSystem.from_uri(uri)
        self.file = files.open_input_file(path)
        size = self.file.size()
        index, blocks, docs, magic = struct.unpack("<QQQ4s", self.file.read_at(28, size - 28))
        head, self.width, self.block_ids = struct.unpack("<4sII", self.file.read_at(12, 0))
        if magic != MAGIC or head != MAGIC:
            raise ValueError(f"{uri} is no bit-packed token file")
        data, cut = self.file.read_at(size - 28 - index, index), np.cumsum([0, 8 * (blocks + 1), 8 * docs, 8 * (docs + 1), docs])
        self.offsets, self.docs, self.starts = (np.frombuffer(data[a:b], t) for a, b, t in zip(cut[:3], cut[1:4], ("<u8", "<i8", "<u8"), strict=True))
        self.null = np.frombuffer(data[cut[3] : cut[4]], np.uint8)

    def block(self, k: int) -> np.ndarray:
        n = min(self.block_ids, int(self.starts[-1]) - k * self.block_ids)
        at = int(self.offsets[k])
        return unpack(self.file.read_at(int(self.offsets[k + 1]) - at, at), n, self.width)

    def ids(self, start: int, stop: int) -> np.ndarray:
        if stop <= start:
            return np.zeros(0, "<u4")
        first = start // self.block_ids
        parts = [self.block(k) for k in range(first, (stop - 1) // self.block_ids + 1)]
        return np.concatenate(parts)[start - first * self.block_ids : stop - first * self.block_ids]

    def documents(self) -> Iterator[tuple[int | None, int, int, int]]:
        """(document id, ids before it, its ids, CRC-32 of them), holding one block at a time."""
        held, block = -1, None
        for d in range(len(self.docs)):
            start, stop = int(self.starts[d]), int(self.starts[d + 1])
            crc, at = 0, start
            while at < stop:
                k = at // self.block_ids
                if k != held:
                    held, block = k, self.block(k)
                upto = min(stop, (k + 1) * self.block_ids)
                crc = zlib.crc32(block[at - k * self.block_ids : upto - k * self.block_ids].tobytes(), crc)
                at = upto
            yield None if self.null[d] else int(self.docs[d]), start, stop - start, crc


_FILES = "file string, place int, n_docs long, n_ids long"
_DOCS = "place int, doc_id long, start long, n_tokens long, ids_crc32 long"


def _arrow(kind: str) -> pa.DataType:
    return {"string": pa.string(), "int": pa.int32(), "long": pa.int64()}[kind]


def _batch(columns: list[list], schema: str) -> pa.RecordBatch:
    fields = [f.split() for f in schema.split(", ")]
    return pa.RecordBatch.from_arrays([pa.array(c, _arrow(k)) for c, (_, k) in zip(columns, fields, strict=True)], [n for n, _ in fields])


def _write(folder: str, tokenizer_path: str, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pieces = kept(f"pieces of {tokenizer_path}", lambda: Pieces(tokenizer_path))
        known = kept(f"ids of {tokenizer_path}", lambda: Memo(lambda piece: packed(pieces.ids(piece)), 800_000))
        memo = Memo(lambda chunk: pieces.encode(chunk, known))
        end = np.array([end_id], "<u4").tobytes()
        place = TaskContext.get().partitionId()
        # A task that runs again writes a file of its own; only the names that a finished task gives are ever read.
        uri = f"{folder}/tokens-{place:06d}-{uuid.uuid4().hex}.qbp"
        files, path = pafs.FileSystem.from_uri(uri)
        files.create_dir(path.rpartition("/")[0], recursive=True)
        with files.open_output_stream(path) as out:
            writer = Writer(out, width_of(max(pieces.tokenizer.get_vocab_size(), end_id + 1)))
            for batch in batches:
                for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                    data = b"".join([memo[c] for c in chunks_of(text.as_py() or "")]) + end
                    writer.add(doc_id, np.frombuffer(data, "<u4"))
            writer.close()
        yield _batch([[uri], [place], [len(writer.docs)], [writer.starts[-1]]], _FILES)

    return run


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for uri, place in zip(batch.column("file").to_pylist(), batch.column("place").to_pylist(), strict=True):
            rows: list[tuple] = []
            for found in Reader(uri).documents():
                rows.append((place, *found))
                if len(rows) == 10_000:
                    yield _batch([list(c) for c in zip(*rows, strict=True)], _DOCS)
                    rows = []
            if rows:
                yield _batch([list(c) for c in zip(*rows, strict=True)], _DOCS)


def write_tokens(
    docs: DataFrame, tokenizer_path: str, end_id: int = 2, id_col: str = "doc_id", text_col: str = "text", folder: str | None = None, files: int | None = None
) -> DataFrame:
    """(file, place, n_docs, n_ids): the files written, in ascending order of ids by ``place``.

    Every whole text is encoded without special tokens and closed by ``end_id``; NULL and empty texts give that id alone.
    NULL ids come first, rows of one id are ordered by text. An empty table gives files without documents or none.
    """
    spark = docs.sparkSession
    folder = folder or shared_folder(spark, "tokens")
    n = files or int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    ordered = texts.repartitionByRange(n, "doc_id").sortWithinPartitions("doc_id", "text")
    return settle(ordered.mapInArrow(_write(folder, tokenizer_path, end_id), _FILES), "token-files")


def read_tokens(written: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document in the files; ``start`` counts the ids of all before it.

    The list of files has a row per task of the writer, so its running sum is one small window.
    """
    ahead = W.orderBy("place").rowsBetween(W.unboundedPreceding, -1)
    starts = written.select("place", F.coalesce(F.sum("n_ids").over(ahead), F.lit(0)).alias("ids_before"))
    n = int(written.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    found = written.select("file", "place").repartition(n, "place").mapInArrow(_read, _DOCS)
    # a row per file: of the two sides Spark would else send the documents, whose number it can't know, to every task
    return found.join(F.broadcast(starts), "place").select("doc_id", (F.col("start") + F.col("ids_before")).alias("start"), "n_tokens", "ids_crc32")
