"""Divergence of the word use of sources, by Gustavson's row accumulation over a term-major index.

For every language the index has one row per kept term with the counts of all its sources. The divergence of two sources
sums f(p, q) over all kept terms, where a source gives a term p, also terms that it does not have. A row of the product, one
source against all others, is accumulated densely: the source's terms are walked through the index, and each posting behind
its own is scattered into the accumulator's cell of that peer, so that no pair of postings is ever a row of a table.

What is scattered corrects a baseline that takes every term as missing on one side. With p0 and q0 for what a missing term
is given, the sum over all V terms is

    V f(p0, q0) + sum over terms of a (f(p, q0) - f(p0, q0)) + sum over terms of b (f(p0, q) - f(p0, q0))
    + sum over shared terms (f(p, q) - f(p, q0) - f(p0, q) + f(p0, q0))

The first line needs only how often each p occurs in a source. The second comes from slices of the index, dealt out by term.
All of it is in integers, so slices add up to the same whatever their number. f is symmetric, so each pair is summed once.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterglass.llm.common import settle

#: Bytes of a term in lower case, all others a space: a run of anything but ASCII characters that are not letters.
FOLD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 else 32 for b in range(256))
#: What p is counted in.
UNIT = 1_000_000_000


def divergence(p, q):
    """floor((p - q)^2 / (p + q)) of arrays of integers."""
    return (p - q) * (p - q) // (p + q)


def term_counts(docs: DataFrame, most_terms: int = 300_000) -> DataFrame:
    """(lang, source, term, n, df) partial counts of each task: occurrences and documents. A task's tables are handed on
    whenever they hold ``most_terms`` terms, so its memory is bounded."""
    schema = "lang string, source string, term string, n long, df long"
    names = ["lang", "source", "term", "n", "df"]

    def rows(tables: dict[tuple[str, str], tuple[Counter, Counter]]) -> Iterator[pa.RecordBatch]:
        for (lang, source), (n, df) in tables.items():
            terms, m = list(n), len(n)
            for at in range(0, m, 50_000):
                some = terms[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([lang] * len(some), pa.string()), pa.array([source] * len(some), pa.string()),
                        pa.array(some, pa.binary()).cast(pa.string()), pa.array([n[t] for t in some], pa.int64()),
                        pa.array([df[t] for t in some], pa.int64()),
                    ],
                    names,
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tables, held = {}, 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for lang, source, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts, strict=True):
                if (lang, source) not in tables:
                    tables[lang, source] = (Counter(), Counter())
                n, df = tables[lang, source]
                terms = text.as_py().translate(FOLD).split()
                before = len(n)
                n.update(terms)
                df.update(set(terms))
                held += len(n) - before
                if held >= most_terms:
                    yield from rows(tables)
                    tables, held = {}, 0
        yield from rows(tables)

    read = [F.coalesce(F.col(c), F.lit("")).alias(c) for c in ("lang", "source", "text")]
    return docs.select(*read).mapInArrow(run, schema)


def term_index(docs: DataFrame, min_df: int = 10) -> DataFrame:
    """(lang, term, df, postings of (source, n)) of the terms in at least ``min_df`` documents of their language.

    One shuffle by language and term serves the sums of both levels; a term's postings are as many as its language has sources.
    """
    counts = term_counts(docs).repartition("lang", "term")
    groups = counts.groupBy("lang", "term", "source").agg(F.sum("n").alias("n"), F.sum("df").alias("df"))
    terms = groups.groupBy("lang", "term").agg(F.sum("df").alias("df"), F.collect_list(F.struct("source", "n")).alias("postings"))
    return terms.filter(F.col("df") >= min_df)


def share(n: Column, total: Column, terms: Column) -> Column:
    """p = 1 + floor(10^9 (n + 2) / (N + 2 V)), in 38 digits on the way."""
    wide = (n + 2).cast("decimal(28,0)") * F.lit(UNIT).cast("decimal(10,0)")
    return F.lit(1).cast("long") + F.call_function("div", wide, (total + 2 * terms).cast("decimal(28,0)"))


def group_totals(docs: DataFrame, index: DataFrame) -> DataFrame:
    """(lang, source, V, postings and sources of the language, N, N of the language, p0) of every occurring group.

    V and N are 0 where nothing is kept; p0 is then NULL.
    """
    null = lambda c: F.coalesce(F.col(c), F.lit("")).alias(c)
    groups = docs.select(null("lang"), null("source")).distinct()
    kept = index.groupBy("lang").agg(F.count("*").alias("terms"), F.sum(F.size("postings")).alias("postings"))
    kept = kept.join(groups.groupBy("lang").agg(F.count("*").alias("sources")), "lang")
    sums = index.select("lang", F.explode("postings").alias("at")).groupBy("lang", F.col("at.source").alias("source")).agg(F.sum("at.n").alias("total"))
    langs = sums.groupBy("lang").agg(F.sum("total").alias("lang_total"))
    out = groups.join(sums, ["lang", "source"], "left").join(kept.join(langs, "lang"), "lang", "left")
    out = out.fillna(0, ["terms", "postings", "total", "lang_total", "sources"])
    p0 = F.when(F.col("terms") > 0, share(F.lit(0).cast("long"), F.col("total"), F.col("terms")))
    return out.withColumn("p0", p0)


def postings_with_shares(index: DataFrame, groups: DataFrame) -> DataFrame:
    """One row per posting: (lang, term, source, n, p, p0, q of the language, its postings and sources)."""
    flat = index.select("lang", "term", F.expr("aggregate(postings, 0L, (sum, x) -> sum + x.n)").alias("lang_n"), F.explode("postings").alias("at"))
    flat = flat.select("lang", "term", "lang_n", "at.source", "at.n")
    told = flat.join(groups, ["lang", "source"])
    return told.select(
        "lang", "term", "source", "n", "p0", "postings", "sources", share(F.col("n"), F.col("total"), F.col("terms")).alias("p"),
        share(F.col("lang_n"), F.col("lang_total"), F.col("terms")).alias("q"),
    )


def scatter(term: np.ndarray, source: np.ndarray, p: np.ndarray, p0: np.ndarray, sources: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(source, peers behind it, corrections) of one slice, whose rows are sorted by term and source.

    Row by row: the source's postings are looked up, the postings behind each in its term's run are scattered into the dense
    accumulator of the peers.
    """
    ends = np.searchsorted(term, term, side="right")
    order = np.argsort(source, kind="stable")
    starts = np.searchsorted(source[order], np.arange(sources + 1))
    for a in range(sources):
        own = order[starts[a] : starts[a + 1]]
        lengths = ends[own] - own - 1
        total = int(lengths.sum())
        if not total:
            continue
        first = np.repeat(own + 1 - (np.cumsum(lengths) - lengths), lengths)
        peers, mine = first + np.arange(total), np.repeat(own, lengths)
        a_p, a_0, b_p, b_0 = p[mine], p0[mine], p[peers], p0[peers]
        accumulator = np.zeros(sources, np.int64)
        np.add.at(accumulator, source[peers], divergence(a_p, b_p) - divergence(a_p, b_0) - divergence(a_0, b_p) + divergence(a_0, b_0))
        touched = np.unique(source[peers])
        yield a, touched, accumulator[touched]


def shared_corrections(postings: DataFrame, slice_postings: int) -> DataFrame:
    """(lang, one, two, value) of the terms that two sources share, a row per pair and slice of the index at most. A slice
    has as many postings as there are pairs, ``slice_postings`` at least and 40 times that at most."""
    pairs = F.col("sources") * F.col("sources")
    slices = F.ceil(F.col("postings") / F.greatest(F.least(pairs, F.lit(40 * slice_postings)), F.lit(slice_postings)))
    dealt = postings.select("lang", "term", "source", "p", "p0", F.pmod(F.xxhash64("term"), slices).alias("slice"))

    def run(key: tuple, table: pa.Table) -> pa.Table:
        names = sorted(table["source"].unique().to_pylist())
        codes = {name: i for i, name in enumerate(names)}
        coded = table["source"].combine_chunks().dictionary_encode()
        source = np.array([codes[name] for name in coded.dictionary.to_pylist()])[coded.indices.to_numpy()]
        term = table["term"].combine_chunks().dictionary_encode().indices.to_numpy()
        order = np.lexsort((source, term))
        p, p0 = (table[c].to_numpy()[order] for c in ("p", "p0"))
        one, two, value = [], [], []
        for a, peers, sums in scatter(term[order], source[order], p, p0, len(names)):
            one += [names[a]] * len(peers)
            two += [names[b] for b in peers]
            value.append(sums)
        lang = pa.array([key[0].as_py()] * len(one), pa.string())
        sums = np.concatenate(value) if value else np.zeros(0, np.int64)
        return pa.table([lang, pa.array(one, pa.string()), pa.array(two, pa.string()), pa.array(sums)], ["lang", "one", "two", "value"])

    return dealt.groupBy("lang", "slice").applyInArrow(run, "lang string, one string, two string, value long")


def baselines(postings: DataFrame, groups: DataFrame) -> DataFrame:
    """(lang, one, two, value): what a pair's sum is where no term is shared, in two rows, one from the terms of each source.

    Each source's row has how often each p occurs in it, and is accumulated over all peers of the language at once.
    """
    levels = postings.groupBy("lang", "source", "p").count()
    levels = levels.groupBy("lang", "source").agg(F.collect_list(F.struct("p", "count")).alias("levels"))
    peers = groups.groupBy("lang").agg(F.collect_list(F.struct("source", "p0")).alias("peers"))
    rows = groups.select("lang", "source", "terms", "p0").join(levels, ["lang", "source"], "left").join(peers, "lang")
    told = rows.select(
        "lang", "source", "terms", "p0", "levels.p", F.col("levels.count").alias("times"), F.col("peers.source").alias("peers"),
        F.col("peers.p0").alias("peers_p0"),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                peers = row["peers"]
                sums = np.zeros(len(peers), np.int64)
                if row["terms"]:
                    q0 = np.array(row["peers_p0"], np.int64)
                    none = divergence(np.int64(row["p0"]), q0)
                    for p, times in zip(row["p"] or [], row["times"] or [], strict=True):
                        sums += times * (divergence(np.int64(p), q0) - none)
                    sums += np.where(np.array([row["source"] < peer for peer in peers], bool), row["terms"] * none, 0)
                others = [(min(row["source"], peer), max(row["source"], peer), int(v)) for peer, v in zip(peers, sums, strict=True) if peer != row["source"]]
                yield pa.RecordBatch.from_pylist([{"lang": row["lang"], "one": a, "two": b, "value": v} for a, b, v in others], schema=schema)

    schema = pa.schema([("lang", pa.string()), ("one", pa.string()), ("two", pa.string()), ("value", pa.int64())])
    return told.mapInArrow(run, "lang string, one string, two string, value long")


def pair_divergences(postings: DataFrame, groups: DataFrame, slice_postings: int) -> DataFrame:
    """(lang, source, item, value) of every ordered pair of two sources of a language."""
    parts = baselines(postings, groups).unionByName(shared_corrections(postings, slice_postings))
    summed = parts.groupBy("lang", "one", "two").agg(F.sum("value").alias("value"))
    both = F.explode(F.array(F.struct(F.col("one").alias("source"), F.col("two").alias("item")), F.struct(F.col("two").alias("source"), F.col("one").alias("item"))))
    return summed.select("lang", "value", both.alias("ends")).select("lang", "ends.source", "ends.item", "value")


def term_divergences(postings: DataFrame) -> DataFrame:
    """(lang, source, item, value) of every term that a source uses more than its language does."""
    over = postings.filter((F.col("n") > 0) & (F.col("p") > F.col("q")))
    p, q = F.col("p"), F.col("q")
    return over.select("lang", "source", F.col("term").alias("item"), F.call_function("div", (p - q) * (p - q), p + q).alias("value"))


def audit_sources(docs: DataFrame, min_df: int = 10, top_terms: int = 10, slice_postings: int = 50_000) -> DataFrame:
    """(lang, source, part, item, value, rank): how far the word use of each source is from each other source of its language
    (part ``pair``), and the terms by which it most exceeds its language (part ``term``, ranks to ``top_terms``).

    NULL text, lang and source count as ''. A term is a run of ASCII letters, lower-cased, and characters beyond ASCII; kept
    are those in at least ``min_df`` documents (rows) of the language. Sources without a kept term, or in a language without
    one, have pairs too; a language's only source has none. Equal values rank by the UTF-8 of the item. No rows for an empty
    table; repeated rows are documents of their own; other columns don't matter. The index is cut into slices of
    ``slice_postings`` postings, more where a language has so many sources that their pairs outnumber these.
    """
    index = settle(term_index(docs, min_df), "term-index")
    groups = settle(group_totals(docs, index), "source-totals")
    postings = settle(postings_with_shares(index, groups), "postings")
    order = [F.desc("value"), F.col("item")]
    rank = F.row_number().over(Window.partitionBy("lang", "source").orderBy(*order)).alias("rank")
    pairs = pair_divergences(postings, groups, slice_postings).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank)
    terms = term_divergences(postings).select("lang", "source", F.lit("term").alias("part"), "item", "value", rank)
    return pairs.unionByName(terms.filter(F.col("rank") <= top_terms))
