"""MinHash near-duplicates: one-permutation hashing with optimal densification, banded buckets, star-shaped candidates.

Documents of one shingle set are one class, represented by its smallest id. Each class has a signature of one hash of
every shingle, dealt over bins; an empty bin takes the value of the first filled bin in an order of its own. A bucket
is a band of equal bins. A bucket of m classes gives m - 1 candidates, from its hub to the others, and the hub is the
class that meets most others over all its buckets, so that in a group of edited copies it is the text that they came
from. Every candidate is confirmed on the full shingle sets. What a star misses are links between members of which one
is not linked to the hub: the classes of buckets that then hold several components are joined exactly, by the rarest
shingles of each, across components only.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterglass.llm.chunks import Memo
from quarterglass.llm.common import keep_rows, settle
from quarterglass.llm.decontaminate import hashed, shingles


def byte_hashes() -> Memo:
    import xxhash

    return Memo(xxhash.xxh64_intdigest)


def shingle_set(text: bytes, memo: dict[bytes, int], words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the runs of ``words`` words, A-Z in lower case; all words are one run where there are
    fewer. ``bytes.split`` cuts at space and the ASCII control white space, and at nothing else."""
    h = hashed(text.lower().split(), memo)
    return np.unique(shingles(h, min(words, len(h)))) if len(h) else np.zeros(0, np.uint64)


def probe_orders(bins: int, seed: int) -> np.ndarray:
    """For every bin an order of all bins of its own, in which an empty one looks for a filled one."""
    rng = np.random.default_rng(seed)
    return np.stack([rng.permutation(bins) for _ in range(bins)])


def signature(own: np.ndarray, bins: int, orders: np.ndarray) -> np.ndarray:
    """Smallest hash of each bin; empty bins densified. ``own`` has a shingle at least."""
    h = own * np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h = np.sort(h ^ (h >> np.uint64(32)))[::-1]
    out, filled = np.zeros(bins, np.uint64), np.zeros(bins, bool)
    places = (h % np.uint64(bins)).astype(np.int64)
    out[places] = h  # from the largest on, so the smallest of a bin is the one that stays
    filled[places] = True
    empty = np.flatnonzero(~filled)
    if len(empty):
        first = filled[orders[empty]].argmax(axis=1)
        out[empty] = out[orders[empty, first]]
    return out


def band_keys(sig: np.ndarray, bands: int) -> np.ndarray:
    """One 64-bit bucket key per band; the band's number is part of it."""
    rows = sig.reshape(bands, -1)
    out = np.arange(1, bands + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    for i in range(rows.shape[1]):
        out = (out ^ rows[:, i]) * np.uint64(0xBF58476D1CE4E5B9)
        out ^= out >> np.uint64(31)
    return out


def _lists(values: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(v) for v in values])]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate([*values, np.zeros(0, np.uint64)]).astype(np.uint64).view(np.int64)))


_SIGNATURES = "doc long, n long, d1 long, d2 long, keys array<long>"


def _signatures(words: int, bands: int, rows: int, least: int, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        memo, orders = byte_hashes(), probe_orders(bands * rows, seed)
        none = np.zeros(0, np.uint64)
        for batch in batches:
            sizes, digests, keys = [], [], []
            for text in batch.column(1).cast(pa.binary()):
                own = shingle_set(text.as_py() or b"", memo, words)
                sizes.append(len(own))
                digests.append(xxhash.xxh3_128_digest(own.tobytes()))
                keys.append(band_keys(signature(own, bands * rows, orders), bands) if len(own) >= least else none)
            both = np.frombuffer(b"".join(digests), "<i8").reshape(-1, 2)
            columns = [batch.column(0), pa.array(sizes, pa.int64()), pa.array(both[:, 0].copy()), pa.array(both[:, 1].copy()), _lists(keys)]
            yield pa.RecordBatch.from_arrays(columns, ["doc", "n", "d1", "d2", "keys"])

    return run


def _sets(words: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = byte_hashes()
        for batch in batches:
            texts = batch.column(1).cast(pa.binary())
            for at in range(0, batch.num_rows, 500):
                part = [shingle_set(t.as_py() or b"", memo, words) for t in texts.slice(at, 500)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, 500), _lists(part)], ["doc", "own"])

    return run


def components(links: DataFrame) -> DataFrame:
    """(node, component) of every node of ``links`` (a, b): the smallest node that it reaches.

    Labels pass along links and jump to their label's label; a round is written before the next reads it.
    """
    edges = settle(links.select("a", "b").union(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = settle(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = edges.join(labels, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        jump = labels.select(F.col("node").alias("at"), F.col("label").alias("far"))
        moved = labels.join(near, F.col("node") == F.col("a")).withColumn("step", F.least("label", "near"))
        moved = moved.join(jump, F.col("step") == F.col("at")).select("node", F.least("step", "far").alias("new"), (F.least("step", "far") < F.col("label")).alias("changed"))
        moved = settle(moved, "labels")
        labels = moved.select("node", F.col("new").alias("label"))
        if not moved.filter("changed").limit(1).count():
            return labels.withColumnRenamed("label", "component")


def near_duplicates(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    words: int = 5,
    percent: int = 85,
    bands: int = 30,
    rows: int = 6,
    seed: int = 5,
) -> DataFrame:
    """(doc_id, n_shingles, component_id, kept) per row; links have 100 * intersection >= ``percent`` * union.

    NULL, empty and blank texts have no shingles and are linked with nothing. An id names a document: rows of one id are
    one node, so a repeated row gives the same result twice. NULL ids have no place in the order: such a row takes the
    component of its copies that have an id, else NULL. An empty table gives no row. A pair at the threshold shares no bucket
    with probability (1 - 0.85 ** rows) ** bands, 7e-7 by default. Sets too small for two unequal ones to be linked take
    no part in the search.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc"), F.col(text_col).alias("text"))
    least = next(n for n in range(1, 102) if 100 * n >= percent * (n + 1))  # n of n + 1 shingles may be a link
    sigs = settle(texts.mapInArrow(_signatures(words, bands, rows, least, seed), _SIGNATURES), "signatures")
    # Stored, so that the join with it below has a shuffle on either side and a class of any size is split.
    classes = settle(sigs.filter("n > 0").groupBy("d1", "d2").agg(F.min("doc").alias("rep")), "classes")

    reps = classes.select(F.col("rep").alias("doc")).filter("doc IS NOT NULL")
    banded = sigs.filter(F.size("keys") > 0).join(reps, "doc", "left_semi").select("doc", "n", F.explode("keys").alias("key"))
    crowded = banded.groupBy("key").agg(F.count("*").alias("m")).filter("m > 1")
    shared = settle(banded.join(crowded, "key"), "buckets")
    met = shared.groupBy("doc").agg(F.sum("m").alias("met"))
    shared = settle(shared.join(met, "doc").select("key", "doc", "n", F.struct("met", (-F.col("doc")).alias("id")).alias("place")), "places")

    asked = shared.select("doc").distinct().hint("merge")  # one plan at every size
    sets = settle(texts.join(asked, "doc", "left_semi").dropDuplicates(["doc"]).mapInArrow(_sets(words), "doc long, own array<long>"), "sets")

    hubs = shared.groupBy("key").agg(F.max(F.struct("place", "n")).alias("hub"))
    hubs = hubs.select("key", (-F.col("hub.place.id")).alias("hub"), F.col("hub.n").alias("hub_n"))
    candidates = settle(_stars(shared.select("key", "doc", "n"), hubs, percent), "candidates")
    links = settle(_confirmed(candidates, sets, percent), "links")
    labels = components(links)

    known = shared.select("key", "doc", "n").join(labels, F.col("doc") == F.col("node"), "left")
    known = settle(known.select("key", "doc", "n", F.coalesce("component", "doc").alias("component")), "known")
    mixed = known.groupBy("key").agg(F.min("component").alias("low"), F.max("component").alias("high")).filter("low < high").select("key")
    apart = settle(known.join(mixed, "key", "left_semi").select("doc", "n", "component").distinct(), "apart")
    more = _between_components(apart, sets, percent).join(candidates, ["a", "b"], "left_anti")
    more = settle(_confirmed(more, sets, percent), "links")
    if more.limit(1).count():
        labels = components(links.unionByName(more))

    named = sigs.select("doc", "n", "d1", "d2").join(classes.withColumnRenamed("rep", "class"), ["d1", "d2"], "left")
    named = named.join(labels, F.col("class") == F.col("node"), "left")
    component = F.coalesce("component", "class", "doc")
    return named.select(
        F.col("doc").alias("doc_id"), F.col("n").alias("n_shingles"), component.alias("component_id"), F.col("doc").eqNullSafe(component).alias("kept")
    )


def _stars(shared: DataFrame, hubs: DataFrame, percent: int) -> DataFrame:
    """Distinct pairs (a, b) of each bucket's hub and its other members, of sizes that a link allows."""
    pairs = shared.join(hubs, "key").filter("doc != hub")
    pairs = pairs.filter(100 * F.least("n", "hub_n") >= percent * F.greatest("n", "hub_n"))
    return pairs.select(F.least("doc", "hub").alias("a"), F.greatest("doc", "hub").alias("b")).distinct()


def _between_components(apart: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Every pair (a, b) of ``apart`` (doc, n, component) that may be a link between two components.

    Shingles of one component alone are in no such link. With those first and the others from the rarest on, two sets
    that are similar enough share one of the first n - ceil(percent * n / 100) + 1 of either; a passage that many
    documents share is at the end of that order. A set has no such link if too few of its shingles are of several
    components. Per shingle the members of the largest component are met by the others only.
    """
    rows = sets.join(apart, "doc").select("doc", "n", "component", F.explode("own").alias("s"))
    often = rows.groupBy("s").agg(F.count("*").alias("often"), F.min("component").alias("low"), F.max("component").alias("high"))
    often = often.filter("low < high").select("s", "often")
    ordered = rows.join(often, "s").groupBy("doc", "n", "component").agg(F.sort_array(F.collect_list(F.struct("often", "s"))).alias("own"))
    ordered = ordered.withColumn("k", F.size("own"))
    least = F.ceil(percent * F.col("n") / 100)
    ordered = ordered.withColumn("length", (F.col("k") - least + 1).cast("int")).filter("length > 0")
    first = ordered.select("doc", "n", "k", "component", F.posexplode(F.slice("own", F.lit(1), F.col("length"))).alias("at", "f"))
    # At the first shingle that two sets have in common, no more than what follows it can be common too.
    first = settle(first.select("doc", "n", (F.col("k") - F.col("at")).alias("k"), "component", F.col("f.s").alias("s")), "prefixes")

    sizes = first.groupBy("s", "component").agg(F.count("*").alias("m"))
    largest = sizes.groupBy("s").agg(F.max(F.struct("m", "component")).alias("top"), F.count("*").alias("parts")).filter("parts > 1")
    largest = settle(largest.select("s", F.col("top.component").alias("top")), "largest")
    met = first.join(largest, "s")
    others = met.filter("component != top").select("s", *[F.col(c).alias(f"o_{c}") for c in ("doc", "n", "k", "component")])
    most = F.least("k", "o_k")  # of the intersection
    pairs = others.join(
        met.select("s", "doc", "n", "k", "component"),
        (others["s"] == met["s"]) & (F.col("component") != F.col("o_component")) & (100 * most >= percent * (F.col("n") + F.col("o_n") - most)),
    )
    return pairs.select(F.least("doc", "o_doc").alias("a"), F.greatest("doc", "o_doc").alias("b")).distinct()


def _confirmed(pairs: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """The pairs whose full sets are similar enough."""
    left = sets.select(F.col("doc").alias("a"), F.col("own").alias("own_a"))
    right = sets.select(F.col("doc").alias("b"), F.col("own").alias("own_b"))
    both = pairs.join(left, "a").join(right, "b")
    common = F.size(F.array_intersect("own_a", "own_b"))
    return both.withColumn("common", common).filter(100 * F.col("common") >= percent * (F.size("own_a") + F.size("own_b") - F.col("common"))).select("a", "b")


def deduplicate(docs: DataFrame, percent: int = 80, bands: int = 36, rows: int = 5, **options) -> DataFrame:
    """The documents, all columns kept, with one of each component: that of the smallest id. Rows of NULL id stay only if no
    copy of theirs has an id. A pair at 0.8 shares no bucket with probability (1 - 0.8 ** 5) ** 36, 6e-7."""
    kept = near_duplicates(docs, percent=percent, bands=bands, rows=rows, **options).filter("kept").select("doc_id")
    return keep_rows(docs, options.get("id_col", "doc_id"), kept, inside=True)
