"""Mixing and sharding against plain computations, SQL beside the queries, and the pipeline."""

import math
import re
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from quarterglass.llm import mixing, sharding
from quarterglass.llm.oracle import ORACLE
from quarterglass.llm.queries import REGISTRY
from tests.compare import connect, difference


@pytest.mark.parametrize("name", sorted(ORACLE))
def test_query_equals_sql(name, spark, sf_dir):
    assert difference(REGISTRY[name], ORACLE[name], spark, connect(sf_dir), sf_dir, 1e-9) is None


def test_every_operator_has_its_query():
    assert {n.split("_")[0] for n in REGISTRY} == {f"op{k}" for k in range(1, 14)}


def water_fill(sizes, weights, caps):
    """Targets by filling source after source, in many small rounds of shares."""
    target, total = dict.fromkeys(sizes, 0.0), float(sum(sizes.values()))
    open_now = set(sizes)
    left = total
    while left > 1e-9 and open_now:
        share = left / sum(weights[s] for s in open_now)
        step = min(share, min((caps[s] - target[s]) / weights[s] for s in open_now))
        for s in open_now:
            target[s] += step * weights[s]
        left -= step * sum(weights[s] for s in open_now)
        open_now = {s for s in open_now if target[s] < caps[s] - 1e-9}
    return target


def test_mix(spark, odd, documents, nothing):
    for docs in (odd, documents):
        rows = [(r.doc_id, r.source, len(re.findall(r"[^\x20\x09-\x0D]+", r.text or ""))) for r in docs.select("doc_id", "source", "text").collect()]
        sizes = Counter()
        for _, s, n in rows:
            sizes[s] += n
        order = sorted(sizes, key=lambda s: (s is None, (s or "").encode()))
        target = water_fill(sizes, {s: (5, 2, 1)[k % 3] for k, s in enumerate(order)}, {s: 3 * n for s, n in sizes.items()})
        found = mixing.mix(docs).collect()
        assert sorted(map(tuple, found), key=str) == sorted(map(tuple, mixing.mix(docs.repartition(5)).collect()), key=str)
        assert Counter((r.doc_id, r.size, r.source_size) for r in found) == Counter((i, n, sizes[s]) for i, s, n in rows)
        source, taken, largest = {}, defaultdict(int), defaultdict(int)
        for i, s, n in rows:
            source[i, n, sizes[s]] = s
        for r in found:
            s = source[r.doc_id, r.size, r.source_size]
            assert math.isclose(r.target, target[s], abs_tol=1e-6) and 0 <= r.taken <= 3 * r.size and (not r.size or r.taken % r.size == 0)
            taken[s] += r.taken
            largest[s] = max(largest[s], r.size)
        assert all(abs(taken[s] - target[s]) <= largest[s] / 2 + 1e-6 for s in taken)
    assert not mixing.mix(nothing).collect()


def test_heavier_documents_are_drawn_more_often(spark):
    docs = spark.range(4000).selectExpr("id AS doc_id", "CASE WHEN id % 2 = 0 THEN 'aaaaaa bbbbbb cccccc dddddd' ELSE 'a b c d' END AS text", "'s' || cast(id % 3 = 0 AS string) AS source")
    rows = mixing.mix(docs).collect()
    partial = [r for r in rows if r.source_size > r.target]
    share = [sum(r.taken for r in partial if r.doc_id % 2 == k) for k in (0, 1)]
    assert share[0] > 1.2 * share[1] > 0


def test_no_cell_is_full_where_qualities_are_low(spark):
    """20,000 one-word texts of the least quality, and rows of one id that tie in key: reruns agree, cells stay small."""
    docs = spark.range(20_000).selectExpr("id AS doc_id", "repeat('x', 500) AS text", "'s' || cast(id % 2 AS string) AS source")
    tied = spark.createDataFrame([(None, t, "s1") for t in ("aa bb", "bb aa", "aa bb cc", "dd", "")] * 3, "doc_id long, text string, source string")
    docs = docs.union(tied)
    runs = [Counter(map(tuple, mixing.mix(d).collect())) for d in (docs.repartition(3), docs.repartition(7), docs.orderBy("text"))]
    assert runs[0] == runs[1] == runs[2] and sum(runs[0].values()) == 20_015
    key = F.pow(mixing.uniform(7, F.col("doc_id")), F.lit(1.0) / mixing.quality_weight(F.col("text"), mixing.n_words(F.col("text"))))
    largest = docs.filter("doc_id IS NOT NULL").groupBy("source", mixing.key_cell(key, 1024)).count().agg(F.max("count")).first()[0]
    assert largest <= 30


def check_shards(docs, shards):
    texts = Counter((r.doc_id, r.text) for r in docs.select("doc_id", "text").collect())
    found = sharding.shard(docs, shards).collect()
    assert Counter((r.doc_id, r.size, r.text_crc32) for r in found) == Counter(
        {k: n for k, n in Counter((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for (i, t), n in texts.items() for _ in range(n)).items()}
    )
    by_shard = defaultdict(list)
    for r in found:
        by_shard[r.shard].append(r)
        assert r.law == "bytes" and r.grown_shard is None and 0 <= r.shard < shards
    for rows in by_shard.values():
        assert sorted(r.slot for r in rows) == list(range(len(rows)))
    return found, {s: sum(r.size for r in rows) for s, rows in by_shard.items()}


def test_shards(spark, odd, documents, nothing):
    found, sizes = check_shards(documents, 24)
    mean, largest = sum(sizes.values()) / 24, max(r.size for r in found)
    assert all(abs(sizes.get(s, 0) - mean) <= max(mean / 16, largest) + 1 for s in range(24))
    check_shards(odd, 24)
    assert not sharding.shard(nothing).collect()


def test_a_text_that_is_a_third_of_all_rows_is_subdivided(spark):
    docs = spark.range(6000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('hot ', 20) ELSE repeat(cast(id DIV 2 AS string), 10) END AS text")
    found, sizes = check_shards(docs, 24)
    assert max(sizes.values()) < 1.1 * min(sizes.values())
    where = defaultdict(set)
    for r in found:
        where[r.text_crc32].add(r.shard)
    assert sum(len(s) > 1 for s in where.values()) == 1


def plain_shards(docs, shards):
    """(doc_id, CRC, shard, slot) by one sort on (hash of the text, id) and running sums of bytes, in plain Python."""
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("t"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("key")).collect()
    rows = sorted((r.key, -(2**63) if r.doc_id is None else r.doc_id, r.doc_id, len(r.t.encode()) + 8, zlib.crc32(r.t.encode())) for r in rows)
    total, largest, groups, at = sum(r[3] for r in rows), max(r[3] for r in rows), defaultdict(list), 0
    for r in rows:
        groups[r[0]].append((at, r[3]))
        at += r[3]
    place, slots, out = defaultdict(int), Counter(), []
    for key, _, doc_id, size, crc in rows:
        mine = groups[key]
        bytes_ = sum(n for _, n in mine)
        if bytes_ <= max(total / shards / 16, largest):
            middle = mine[0][0] + bytes_ / 2
        else:
            middle = mine[place[key]][0] + size / 2
        place[key] += 1
        own = min(int(middle * shards // total), shards - 1)
        out.append((doc_id, crc, own, slots[own]))
        slots[own] += 1
    return out


def test_shards_equal_one_sort(spark, odd, documents):
    hot = spark.range(3000).selectExpr("id AS doc_id", "CASE WHEN id % 3 = 0 THEN repeat('hot ', 20) ELSE repeat(cast(id DIV 2 AS string), 10) END AS text")
    for docs, shards in ((documents, 24), (odd, 24), (hot, 24), (hot.limit(5), 24), (documents, 3)):
        found = sharding.shard(docs, shards).collect()
        assert Counter((r.doc_id, r.text_crc32, r.shard, r.slot) for r in found) == Counter(plain_shards(docs, shards))


def test_mix_takes_each_row_by_its_own_count(spark, sf_dir):
    rows = [(k, f"text of {k} " + "w " * (k % 7), "en", "s1", 9) for k in range(20)] + [(3, "text of 3 " + "w " * 3, "en", "s1", 9)] * 5
    rows += [(None, f"no id {k} " + "v " * (k % 5), "en", "s1", 9) for k in range(12)] + [(None, None, "en", "s1", 9), (None, "", "en", "s2", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    out = corpus_pipeline.mix_sources(spark, docs, sf_dir)
    assert tuple(out.columns) == corpus_pipeline.COLUMNS
    # The one source with words is its own target, so that each row is taken once.
    assert Counter(map(tuple, out.collect())) == Counter(rows)


def test_pipeline(spark, sf_dir, documents):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dup", "decontaminate", "mix", "shard"]
    counts = []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, sf_dir).cache()
        counts.append(out.count())
        if name != "shard":
            assert tuple(out.columns) == corpus_pipeline.COLUMNS
            docs = out
    assert 0.5 * documents.count() < counts[2] <= counts[1] <= counts[0] < documents.count() and counts[3] == counts[4]
    left = {r.doc_id for r in docs.select("doc_id").collect()}
    whole = corpus_pipeline.run(spark, sf_dir).collect()
    assert {r.doc_id for r in whole} == left and len(whole) == counts[4]
