"""Benchmark decontamination: fingerprints of item-sized windows, a multi-index Hamming search, and an exact check.

Every window of an item's length that shares a shingle with the benchmark gets a 64-bit SimHash of its idf-weighted word
shingles. The index cuts fingerprints into ``radius + 1`` blocks: two fingerprints within the radius agree in a block at
least, so looking up the blocks finds every item within the radius. What it finds is confirmed by the exact weighted
Jaccard similarity of the shingles. A window without any shingle of the benchmark has similarity 0 and is not looked up.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterglass.llm.chunks import Memo
from quarterglass.llm.common import rows_where, share

_TERM = re.compile(r"\w+")
BITS = 64


def terms_of(text: str | None) -> list[str]:
    return _TERM.findall((text or "").lower())


def hashed(words: list[str], memo: dict[str, int]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def word_hashes() -> Memo:
    import xxhash

    return Memo(lambda w: xxhash.xxh64_intdigest(w.encode("utf-8", "surrogatepass")))


def shingles(hashes: np.ndarray, k: int) -> np.ndarray:
    """64-bit hashes of all runs of ``k`` words, in order."""
    if len(hashes) < k:
        return np.zeros(0, np.uint64)
    out = np.zeros(len(hashes) - k + 1, np.uint64)
    for i in range(k):
        out = (out + hashes[i : len(hashes) - k + 1 + i]) * np.uint64(0x9E3779B97F4A7C15)
        out ^= out >> np.uint64(29)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out ^ (out >> np.uint64(32))


def _signs(hashes: np.ndarray) -> np.ndarray:
    """One row of +1 and -1 per shingle."""
    return np.unpackbits(hashes.astype("<u8").view(np.uint8), bitorder="little").reshape(-1, BITS).astype(np.float64) * 2 - 1


def _fingerprints(sums: np.ndarray) -> np.ndarray:
    return np.packbits(sums > 0, axis=1, bitorder="little").view("<u8").ravel()


class Items:
    """The benchmark's index: by (shingle words, item words) the fingerprints' blocks, by shingle its weight.

    ``whole`` is given where the items are a block of a larger benchmark: the number of all its items, and by shingle words
    the sorted shingles of several items and how many have them. Of one item is any other, which weighs as unknown ones do.
    """

    def __init__(self, items: list[tuple[int, str | None]], words: int, radius: int, whole: tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]] | None = None):
        memo = word_hashes()
        self.radius, self.words = radius, words
        by_size: dict[tuple[int, int], list[tuple[int, np.ndarray]]] = defaultdict(list)
        for item, text in items:
            h = hashed(terms_of(text), memo)
            if len(h):
                k = min(words, len(h))
                by_size[k, len(h)].append((item, shingles(h, k)))
        self.weight: dict[int, dict[int, float]] = {}
        self.known: dict[int, np.ndarray] = {}
        n = max(1, whole[0] if whole else sum(map(len, by_size.values())))
        self.rare = 1.0 + float(np.log(n))
        self.common: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for k in {k for k, _ in by_size}:
            df = Counter(int(s) for (kk, _), group in by_size.items() if kk == k for _, sh in group for s in set(sh.tolist()))
            self.known[k] = np.array(sorted(df), np.uint64)
            if whole:
                several, often = whole[1].get(k, (np.zeros(0, np.uint64), np.zeros(0, np.int64)))
            else:
                several = np.array(sorted(s for s, c in df.items() if c > 1), np.uint64)
                often = np.array([df[s] for s in several.tolist()], np.int64)
            self.common[k] = several, 1.0 + np.log(n / often)
            self.weight[k] = dict(zip(self.known[k].tolist(), self.weights(k, self.known[k]).tolist(), strict=True))
        edges = [BITS * i // (radius + 1) for i in range(radius + 2)]
        self.blocks = [(np.uint64(a), np.uint64((1 << (b - a)) - 1)) for a, b in zip(edges, edges[1:], strict=False)]
        self.groups = {}
        for (k, size), group in sorted(by_size.items()):
            prints = np.concatenate([_fingerprints((_signs(sh) * self.weights(k, sh)[:, None]).sum(0, keepdims=True)) for _, sh in group])
            tables = []
            for shift, mask in self.blocks:
                table = np.zeros((int(mask) + 1, len(group)), bool)
                table[(prints >> shift) & mask, np.arange(len(group))] = True
                tables.append(table)
            self.groups[k, size] = ([i for i, _ in group], [self._bag(k, sh) for _, sh in group], prints, tables)
        self.sizes: dict[int, dict[int, set[int]]] = {k: defaultdict(set) for k in self.known}
        for (k, size), group in by_size.items():
            for _, sh in group:
                for s in sh.tolist():
                    self.sizes[k][s].add(size)

    def weights(self, k: int, hashes: np.ndarray) -> np.ndarray:
        several, weight = self.common[k]
        out = np.full(len(hashes), self.rare)
        if len(several):
            at = np.minimum(np.searchsorted(several, hashes), len(several) - 1)
            found = several[at] == hashes
            out[found] = weight[at[found]]
        return out

    def _bag(self, k: int, hashes: np.ndarray) -> dict[int, float]:
        own, counts = np.unique(hashes, return_counts=True)
        return dict(zip(own.tolist(), (counts * self.weights(k, own)).tolist(), strict=True))

    def find(self, words: np.ndarray, threshold: float) -> dict[int, tuple[float, int, int]]:
        """item -> (similarity, first word, words) of its best window in a document, the earliest of equal ones."""
        best: dict[int, tuple[float, int, int]] = {}
        for k, known in self.known.items():
            sh = shingles(words, k)
            if not len(sh):
                continue
            at = np.searchsorted(known, sh)
            anchors = np.flatnonzero(known[np.minimum(at, len(known) - 1)] == sh)
            near: dict[int, list[int]] = defaultdict(list)
            for a in anchors.tolist():
                for size in self.sizes[k][int(sh[a])]:
                    near[size].append(a)
            for size, places in near.items():
                span = min(size - k + 1, len(sh))  # shingles of a window; a shorter document is one window
                last = len(sh) - span
                starts = sorted({s for a in places for s in range(max(0, a - span + 1), min(a, last) + 1)})
                self._windows(k, size, span, sh, np.array(starts, np.int64), threshold, best)
        return best

    def _windows(self, k: int, size: int, span: int, sh: np.ndarray, starts: np.ndarray, threshold: float, best: dict) -> None:
        items, bags, prints, tables = self.groups[k, size]
        for run in np.split(starts, np.flatnonzero(np.diff(starts) > span) + 1):  # windows that overlap share the sums
            for part in np.array_split(run, len(run) // 4096 + 1):
                if not len(part):
                    continue
                low, high = int(part[0]), int(part[-1]) + span
                own = sh[low:high]
                sums = np.zeros((len(own) + 1, BITS))
                np.cumsum(_signs(own) * self.weights(k, own)[:, None], axis=0, out=sums[1:])
                found = _fingerprints(np.round(sums[part - low + span] - sums[part - low], 9))
                hit = np.zeros((len(part), len(items)), bool)
                for (shift, mask), table in zip(self.blocks, tables, strict=True):
                    hit |= table[(found >> shift) & mask]
                for w, i in zip(*np.nonzero(hit), strict=True):
                    if (int(found[w]) ^ int(prints[i])).bit_count() <= self.radius:
                        start = int(part[w])
                        score = _similarity(self._bag(k, sh[start : start + span]), bags[i])
                        if score >= threshold and (items[i] not in best or score > best[items[i]][0]):
                            best[items[i]] = (score, start, span + k - 1)


def _similarity(a: dict[int, float], b: dict[int, float]) -> float:
    both = sum(min(w, b[s]) for s, w in a.items() if s in b)
    return both / (sum(a.values()) + sum(b.values()) - both)


_OUT = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("similarity", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())])


def _search(index, threshold: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, memo = pickle.loads(index.value), word_hashes()
        for batch in batches:
            rows = []
            for doc, text in zip(batch.column(0), batch.column(1), strict=True):
                found = items.find(hashed(terms_of(text.as_py()), memo), threshold)
                rows += [(doc.as_py(), item, *match) for item, match in sorted(found.items())]
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), _OUT, strict=True)], schema=_OUT)

    return run


def _item_shingles(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = word_hashes()
        for batch in batches:
            for text in batch.column(0):
                h = hashed(terms_of(text.as_py()), memo)
                if len(h):
                    k = min(words, len(h))
                    own = np.append(np.unique(shingles(h, k)), np.uint64(0)).view(np.int64)
                    sizes = np.append(np.full(len(own) - 1, k), 0)  # the last row counts the item
                    yield pa.RecordBatch.from_arrays([pa.array(sizes, pa.int32()), pa.array(own)], ["k", "s"])

    return run


def _whole(items: DataFrame, words: int) -> tuple[int, dict[int, tuple[np.ndarray, np.ndarray]]]:
    """Items with words, and by shingle words the sorted shingles of several items with their numbers of items."""
    rows = items.select("text").mapInArrow(_item_shingles(words), "k int, s long").groupBy("k", "s").agg(F.count("*").alias("often"))
    found = rows.filter("often > 1 OR k = 0").toArrow()
    k, s, often = (found.column(c).to_numpy() for c in ("k", "s", "often"))
    s = s.view(np.uint64)
    out = {}
    for size in sorted(set(k.tolist()) - {0}):
        at = np.flatnonzero(k == size)
        at = at[np.argsort(s[at])]
        out[size] = s[at], often[at]
    return int(often[k == 0].sum()), out


def _indexes(items: DataFrame, words: int, radius: int, block_items: int) -> Iterator:
    """The shared index of each block of the benchmark; an item's repeated rows are in one block."""
    blocks = max(1, -(-items.count() // block_items))
    whole = _whole(items, words) if blocks > 1 else None
    place = F.when(F.col("item_id").isNull(), F.xxhash64("text")).otherwise(F.xxhash64("item_id"))
    for b in range(blocks):
        block = items.filter(F.pmod(place, F.lit(blocks)) == b) if blocks > 1 else items
        yield share(items.sparkSession, Items([(r.item_id, r.text) for r in block.collect()], words, radius, whole))


def matches(
    docs: DataFrame,
    benchmark: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    threshold: float = 0.8,
    radius: int = 20,
    block_items: int = 20_000,
) -> DataFrame:
    """(doc_id, item_id, similarity, first_word, n_words): each document's best window for each item at or above the threshold.

    Words are runs of letters and digits in lower case. A document shorter than an item is compared as a whole. Items shorter than ``words`` are one shingle; items and documents
    without words match nothing, NULL texts are such. Items of NULL id are left out, having no name to report; repeated
    rows of documents are rows of their own, of repeated items the best window counts. Empty tables give no row. The
    benchmark is indexed in blocks of ``block_items`` items; each block is searched over all whole texts. Weights are those
    of the whole benchmark: beside a block of items, its shingles of several items are sent to tasks, 16 bytes each.
    """
    items = benchmark.select(F.col("item_id").cast("long"), "text").filter("item_id IS NOT NULL")
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    parts = []
    for index in _indexes(items, words, radius, block_items):
        found = texts.mapInArrow(_search(index, threshold), "doc_id long, item_id long, similarity double, first_word long, n_words long")
        parts.append(found)
    out = parts[0]
    for more in parts[1:]:
        out = out.unionByName(more)
    return out


def decontaminate(
    docs: DataFrame, benchmark: DataFrame, text_col: str = "text", words: int = 5, threshold: float = 0.8, radius: int = 20, block_items: int = 20_000
) -> DataFrame:
    """The documents, all columns kept, without the rows whose own text holds an item of the benchmark, also one of NULL id."""

    def verdicts(index):
        def task():
            items, memo = pickle.loads(index.value), word_hashes()
            return lambda texts: [not items.find(hashed(terms_of(text), memo), threshold) for text in texts]

        return task

    for index in _indexes(benchmark.select(F.col("item_id").cast("long"), "text"), words, radius, block_items):
        docs = rows_where(docs, text_col, verdicts(index))
    return docs
