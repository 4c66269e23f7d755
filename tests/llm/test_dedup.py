"""Near-duplicates and decontamination against comparisons of all pairs."""

import re

import numpy as np
import pytest

from quarterglass.llm import decontaminate as D
from quarterglass.llm import near_dup as N

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = {c: c + 32 for c in range(65, 91)}


def sets(rows):
    out = {}
    for i, text in rows:
        w = SPLIT.findall((text or "").translate(LOWER))
        out[i] = {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()
    return out


def brute_components(rows, percent=85):
    own = sets(rows)
    ids = sorted(own)
    label = {i: i for i in ids}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    for k, a in enumerate(ids):
        for b in ids[k + 1 :]:
            common = len(own[a] & own[b])
            if common and 100 * common >= percent * (len(own[a]) + len(own[b]) - common):
                low, high = sorted((root(a), root(b)))
                label[high] = low
    return {i: (len(own[i]), root(i), root(i) == i) for i in ids}


def edited(spark):
    """A text of the highest id and its copies with edits of their own, which are links of that text but not of each other;
    a chain of texts that lose words at the end; and texts that share a passage only."""
    rng = np.random.default_rng(4)
    base = [f"b{i}" for i in range(205)]
    rows = []
    for k in range(30):
        copy = list(base)
        for at in rng.choice(40, 3, replace=False) * 5 + 2:
            copy[at] = f"e{k}-{at}"
        rows.append((k, " ".join(copy)))
    rows.append((900, " ".join(base)))
    rows += [(100 + k, " ".join(f"c{i}" for i in range(300 - 20 * k))) for k in range(8)]
    rows += [(200 + k, " ".join([*(f"p{i}" for i in range(60)), *(f"q{k}-{i}" for i in range(40))])) for k in range(20)]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


def test_components_equal_all_pairs(spark, documents):
    rows, docs = edited(spark)
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(docs).collect()}
    assert found == brute_components(rows)
    some = [(r.doc_id, r.text) for r in documents.select("doc_id", "text").collect()]
    found = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in N.near_duplicates(documents).collect()}
    assert found == brute_components(some)


def test_deduplicate_links_from_four_fifths_on(spark):
    base = [f"b{i}" for i in range(200)]
    four, five = list(base), list(base)
    for at in (30, 70, 110, 150):
        four[at] = five[at] = f"e{at}"
    five[180] = "e180"  # 176 and 171 of 196 shingles in common with the base: 0.815 and 0.774
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(four))], "doc_id long, text string")
    assert [r.doc_id for r in N.deduplicate(docs).collect()] == [1] and N.deduplicate(docs, percent=85, bands=30, rows=6).count() == 2
    docs = spark.createDataFrame([(1, " ".join(base)), (2, " ".join(five))], "doc_id long, text string")
    assert sorted(r.doc_id for r in N.deduplicate(docs).collect()) == [1, 2]


def test_odd_documents(odd, nothing):
    got = sorted(((r.doc_id or -1, r.component_id or -1, r.n_shingles, r.kept) for r in N.near_duplicates(odd).collect()))
    by_id = {g[0]: g[1:] for g in got if g[0] != -1}
    assert by_id[2] == (1, 116, False) and by_id[3][0] == 1 and by_id[4] == (4, 116, True) and by_id[9] == (8, 1, False)
    assert by_id[5] == (5, 0, True) and by_id[6] == (6, 0, True) and by_id[7] == (7, 0, True)
    assert len(got) == 17 and [g for g in got if g[0] == -1] == [(-1, -1, 2, True), (-1, 1, 116, False)]
    assert not N.near_duplicates(nothing).collect()
    kept = N.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect() if r.doc_id) == [1, 4, 4, 5, 6, 7, 8, 10, 11, 12, 13, 14]


def test_densified_signatures_estimate_similarity():
    rng, bins = np.random.default_rng(2), 128
    orders = N.probe_orders(bins, 1)
    for size in (10, 60, 1000):
        agree = []
        for _ in range(200):
            both = rng.integers(0, 2**63, size + 2 * size // 8, dtype=np.int64).astype(np.uint64)
            a, b = np.unique(both[: size + size // 8]), np.unique(np.concatenate([both[:size], both[size + size // 8 :]]))
            agree.append((N.signature(a, bins, orders) == N.signature(b, bins, orders)).mean())
        truth = size / (size + 2 * (size // 8))
        assert abs(np.mean(agree) - truth) < 0.03


def benchmark(spark):
    items = [
        (0, " ".join(f"i{k}" for k in range(40))), (1, "Short one, here."), (2, None), (3, ""), (None, "no name at all to report"),
        (4, " ".join(f"m{k % 9}" for k in range(30))), (4, " ".join(f"m{k % 9}" for k in range(30))),
    ]
    return items, spark.createDataFrame(items, "item_id long, text string")


def brute_matches(docs, items, threshold=0.8):
    from collections import Counter

    index = D.Items([(i, t) for i, t in items if i is not None], 5, 20)
    memo, best = D.word_hashes(), {}
    for doc, text in docs:
        words = D.hashed(D.terms_of(text), memo)
        for item, own in items:
            target = D.hashed(D.terms_of(own), memo)
            if item is None or not len(target):
                continue
            k = min(5, len(target))
            bag = Counter(D.shingles(target, k).tolist())
            weight = lambda s: index.weight[k].get(s, index.rare)  # noqa: B023, E731
            for at in range(max(len(words) - len(target), 0) + 1):  # a shorter document is one window
                mine = Counter(D.shingles(words[at : at + len(target)], k).tolist())
                both = sum(weight(s) * min(mine[s], bag[s]) for s in mine)
                score = sum(weight(s) * max(mine[s], bag[s]) for s in mine | bag)
                if both / score >= threshold and both / score > best.get((doc, item), (0, 0))[0] + 1e-12:
                    best[doc, item] = (both / score, at)
    return {(d, i): (round(s, 9), at) for (d, i), (s, at) in best.items()}


def test_matches_equal_all_windows(spark, odd, nothing):
    items, bench = benchmark(spark)
    passage = [f"i{k}" for k in range(40)]
    texts = [
        (1, "before " * 9 + " ".join(passage) + " after" * 5), (2, " ".join(passage[:38])), (3, "x " + " ".join([*passage[:20], "new", *passage[21:]])),
        (4, "I0, i1; I2. " + " ".join(passage[3:])), (5, "it is short ONE here again"), (6, " ".join(f"m{k % 9}" for k in range(90))), (7, None), (8, ""),
        (9, "q " * 200 + " ".join([*passage[2:], "r", "s"]) + " t" * 50), (10, " ".join(passage + passage)), (11, " ".join(reversed(passage))),
    ]
    docs = spark.createDataFrame(texts, "doc_id long, text string")
    found = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in D.matches(docs, bench).collect()}
    assert found == brute_matches(texts, items) and {d for d, _ in found} >= {1, 2, 4, 5, 6, 9, 10} and not {7, 8, 11} & {d for d, _ in found}
    blocks = {(r.doc_id, r.item_id): (round(r.similarity, 9), r.first_word) for r in D.matches(docs, bench, block_items=2, radius=40).collect()}
    assert set(blocks) == set(found)
    assert not D.matches(nothing, bench).collect() and not D.matches(docs, bench.limit(0)).collect()
    clean = D.decontaminate(docs, bench)
    assert sorted(r.doc_id for r in clean.collect()) == sorted({t[0] for t in texts} - {d for d, _ in found})
    assert D.decontaminate(odd, bench).count() == 17 and D.decontaminate(odd, bench).columns == odd.columns


def test_rows_without_id_get_their_own_verdict(spark):
    items, bench = benchmark(spark)
    rows = [(None, "q " + items[0][1]), (7, "a clean text"), (7, items[0][1]), (8, "here is no name at all to report of"), (None, "clean"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for n in (20_000, 2):
        assert sorted(map(str, (r.text for r in D.decontaminate(docs, bench, block_items=n).collect()))) == ["None", "a clean text", "clean"]


def test_similarities_do_not_depend_on_blocks(spark):
    shared = [f"s{i}" for i in range(12)]
    items = [(k, " ".join([*shared, *(f"t{k % 3}x{i}" for i in range(8)), *(f"o{k}x{i}" for i in range(20))])) for k in range(12)]
    texts = [(k, " ".join([*t.split()[: 38 - k % 4], *shared[: 2 + k % 4]])) for k, t in items]  # ends in shingles of other items
    texts += [(100 + k, " ".join([*(f"t{(k + 1) % 3}x{i}" for i in range(7)), *t.split()[7:]])) for k, t in items]
    bench, docs = spark.createDataFrame(items, "item_id long, text string"), spark.createDataFrame(texts, "doc_id long, text string")
    one, many = ({(r.doc_id, r.item_id): r[2:] for r in D.matches(docs, bench, threshold=0.3, radius=40, block_items=n).collect()} for n in (100, 2))
    assert one.keys() == many.keys() and len(one) >= len(texts)
    assert all(abs(one[k][0] - many[k][0]) < 1e-12 and one[k][1:] == many[k][1:] for k in one)


def test_documents_shorter_than_an_item_are_one_window(spark):
    items, bench = benchmark(spark)
    passage = [f"i{k}" for k in range(40)]
    docs = spark.createDataFrame([(n, " ".join(passage[40 - n :])) for n in range(1, 40)], "doc_id long, text string")
    found = {r.doc_id: (round(r.similarity, 9), r.first_word, r.n_words) for r in D.matches(docs, bench).filter("item_id = 0").collect()}
    # All 36 shingles of the item are in no other one, so that they weigh the same.
    assert found == {n: (round((n - 4) / 36, 9), 0, n) for n in range(33, 40)}
    assert sorted(r.doc_id for r in D.decontaminate(docs, bench).collect()) == list(range(1, 33))


def test_blocks_find_all_within_the_radius():
    rng = np.random.default_rng(0)
    index = D.Items([(i, " ".join(f"k{i}x{j}" for j in range(20))) for i in range(50)], 5, 6)
    ids, _, prints, tables = index.groups[5, 20]
    for _ in range(300):
        i, flips = int(rng.integers(50)), rng.choice(64, int(rng.integers(0, 7)), replace=False)
        probe = np.array([int(prints[i]) ^ sum(1 << int(f) for f in flips)], np.uint64)
        assert any(table[(probe >> shift) & mask][0, i] for (shift, mask), table in zip(index.blocks, tables, strict=True))


@pytest.mark.parametrize("links", [[(1, 2), (2, 3), (5, 4), (9, 3)], [(k, k + 1) for k in range(40)], [(0, k) for k in range(1, 30)]])
def test_components_of_links(spark, links):
    label = {x: x for pair in links for x in pair}
    for _ in label:
        for a, b in links:
            label[a] = label[b] = min(label[a], label[b])
    got = {r.node: r.component for r in N.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == label
