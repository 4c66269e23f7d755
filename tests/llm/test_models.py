"""Toxicity and quality: exact search, base rules by hand, and accuracy on rows that were held out."""

import pickle
import re
import tracemalloc
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark import cloudpickle

from quarterglass.llm import quality as Q
from quarterglass.llm import toxicity as X
from quarterglass.llm.labelled import labelled_sample, platt


def examples():
    rng = np.random.default_rng(5)
    rows = []
    for i in range(400):
        words = [f"w{int(w)}" for w in rng.integers(0, 300, 60)]
        if i % 4 == 0:
            for at in rng.integers(0, 60, 3):
                words[int(at)] = ["vile", "grim", "foulmouth", "foulest"][int(rng.integers(4))]
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    return rows, X.Examples(rows, {0: 300, 1: 100}, k=7, block=16)


def test_nearest_are_those_of_a_full_scan():
    rows, index = examples()
    count = index.counter()
    vectors = {i: index.vector(*count(text)) for i, text, _ in rows}
    dense = np.zeros((len(index.ids), len(index.idf)))
    for place, i in enumerate(index.ids.tolist()):
        dense[place, vectors[i][0]] = vectors[i][1]
    for _, text, _ in rows[:120]:
        terms, weights = index.vector(*count(text))
        if not len(terms):
            continue
        probe = np.zeros(dense.shape[1])
        probe[terms] = weights
        cosine = np.round(dense @ probe, 12)
        expected = np.lexsort((np.arange(len(cosine)), -cosine))[:7]
        places, found = index.nearest(terms, weights)
        assert np.allclose(found, cosine[expected], atol=1e-9) and np.allclose(cosine[places], cosine[expected], atol=1e-9)


def test_matrix_and_lists_find_the_same():
    """Whichever terms are in the matrix and whichever texts are searched together, also with an example left out."""
    rows, plain = examples()
    texts = [text for _, text, _ in rows[:100]] + ["", "unseen", "w1", "vile vile w2"]
    counted = [plain.counter()(text) for text in texts]
    vectors = [plain.vector(*c) for c in counted if len(c[0])][: X.TOGETHER]
    skip = np.arange(len(vectors))
    alone, apart = [plain.nearest(*v) for v in vectors], plain.nearest_of(vectors, skip)
    assert all(place not in own.tolist() for place, (own, _) in zip(skip.tolist(), apart, strict=True))
    for columns in (0, 40):
        index = X.Examples(rows, {0: 300, 1: 100}, k=7, block=16, columns=columns)
        assert len(index.matrix) == columns and len(index.docs)
        for found, expected in ((index.nearest_of(vectors), alone), (index.nearest_of(vectors, skip), apart)):
            for (places, cosines), (own, exact) in zip(found, expected, strict=True):
                assert np.allclose(cosines, exact, atol=1e-11) and len(places) == len(own)
        scores = index.score(counted)
        assert np.allclose([s for s, _ in scores], [plain.score([c])[0][0] for c in counted], atol=1e-9) and scores[100] == (plain.blank, [])


def test_cosines_are_those_of_whole_texts():
    """TF-IDF cosine by hand over all words of both texts and the beginnings that tell labels apart."""
    rows, index = examples()
    beginnings = {t for t in index.terms if t.startswith("^")}
    assert {w for _, text, _ in rows for w in text.split()} == index.terms.keys() - beginnings

    def by_hand(text):
        tf = Counter(t for w in text.split() for t in (w, *("^" + w[:n] for n in X.BEGINNINGS if len(w) > n)) if not t.startswith("^") or t in beginnings)
        return {t: (1 + np.log(n)) * (index.idf[index.terms[t]] if t in index.terms else X.OTHER * (1 + np.log(len(rows)))) for t, n in tf.items()}

    def cosine(a, b):
        return sum(w * b.get(t, 0.0) for t, w in a.items()) / np.sqrt(sum(w * w for w in a.values()) * sum(w * w for w in b.values()))

    text_of = {i: text for i, text, _ in rows}
    for text in ("w1 w2 w2 vile", "w7 new newer w9 w9 w9 foulsome", rows[3][1], rows[4][1] + " unseen unseen"):
        places, found = index.nearest(*index.vector(*index.counter()(text)))
        assert len(places) == 7 and np.allclose(found, [cosine(by_hand(text), by_hand(text_of[i])) for i in index.ids[places].tolist()], atol=1e-9)


def test_a_copy_of_an_example_is_found_whatever_its_words():
    rows, _ = examples()
    rows = [*rows, (1000, "rarely seen words of one toxic row alone", 1)]
    index = X.Examples(rows, {0: 300, 1: 101}, k=7, block=16)
    assert index.of_text(rows[-1][1])[1][0] == 1000 and index.of_text(rows[-1][1])[0] > index.of_text("w1 w2 w3 w4")[0]


def test_document_frequencies_are_those_of_all_documents(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    index = pickle.loads(X._trained(documents, labels, "toxic", 40, 5, "doc_id", "text").value)
    texts = [{t for w in re.findall(r"\w+", (r.text or "").lower()) for t in X.word_terms(w)} for r in documents.select("text").collect()]
    often = Counter(t for text in texts for t in text)
    plain = 1 + np.log([len(texts) / often[t] for t in index.terms])
    share = index.idf / plain
    assert np.all(np.isclose(share, 1.0) | np.isclose(share, X.OTHER))


def test_word_beginnings_count():
    _, index = examples()
    assert index.of_text("w1 w2 w3 foulsome w5 vile grim")[0] > 0.5 > index.of_text("w1 w2 w3 w4")[0]
    assert index.of_text("") == (index.blank, [])


def test_index_takes_few_bytes_in_the_driver():
    """Bytes for each word of an example: while the documents are counted, at the peak of the build, and as sent to tasks."""
    rng = np.random.default_rng(7)
    words = [(rng.random(400) ** 4 * 20000).astype(int).tolist() for _ in range(400)]
    rows = [(i, " ".join(f"{w * 2654435761 % 2**32:08x}" for w in own), i % 2) for i, own in enumerate(words)]
    n, held = sum(len(set(own)) for own in words), []

    def frequencies(terms):
        held.append(tracemalloc.get_traced_memory()[0])
        return len(rows), np.full(len(terms), 3.0)

    tracemalloc.start()
    try:
        before = tracemalloc.get_traced_memory()[0]
        index = X.Examples(rows, {0: 200, 1: 200}, frequencies=frequencies)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    sent = cloudpickle.dumps(index)
    assert held[0] - before < 60 * n and peak - before < 150 * n and len(sent) < 25 * n
    again = pickle.loads(sent)
    assert vars(again).keys() == vars(index).keys() and all(np.array_equal(getattr(again, k), v) for k, v in vars(index).items() if isinstance(v, np.ndarray))
    assert [again.of_text(text) for _, text, _ in rows[:20]] == [index.of_text(text) for _, text, _ in rows[:20]]


def by_id(rows):
    return {r.doc_id: r for r in rows}


def test_toxicity_on_held_out_rows(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    found = X.score_toxicity(documents, labels).collect()
    assert len(found) == documents.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in found)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) for r in found)
    truth = {r.doc_id: r.toxic for r in labels.collect()}
    held = [(r.predicted, truth[r.doc_id]) for r in found if r.held_out and r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.85
    flipped = labels.selectExpr("doc_id", "quality", "CASE WHEN crc32(cast(cast(doc_id AS string) AS binary)) % 5 = 0 THEN 1 - toxic ELSE toxic END AS toxic")
    again = by_id(X.score_toxicity(documents, flipped).collect())
    assert all(again[r.doc_id].score == r.score for r in found)


def test_odd_rows_and_labels(spark, odd, nothing):
    labels = spark.createDataFrame([(1, 1, 0), (2, 0, 1), (None, 1, 1), (99, 0, 1), (4, None, None), (4, 1, 7)], "doc_id long, quality int, toxic int")
    for table in (labels, labels.limit(0)):
        assert len(X.score_toxicity(odd, table).collect()) == len(Q.score_quality(odd, table).collect()) == 17
    assert not X.score_toxicity(nothing, labels).collect() and not Q.score_quality(nothing, labels).collect()
    assert X.without_toxic(odd, labels.limit(0)).count() == 17 and X.without_toxic(odd, labels).columns == odd.columns


def test_toxic_rows_go_by_their_own_text(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    docs = documents.select("doc_id", "text")
    toxic = {r.doc_id for r in X.score_toxicity(docs, labels).filter("predicted = 1").collect()}
    bad, good = (docs.filter(docs.doc_id.isin(list(toxic)) == flag).orderBy("doc_id").first().text for flag in (True, False))
    more = spark.createDataFrame([(None, bad), (None, good), (10**9, bad), (10**9, good)], "doc_id long, text string")
    kept = [tuple(r) for r in X.without_toxic(docs.union(more), labels).collect()]
    assert [r for r in kept if r[0] in (None, 10**9)].count((None, good)) == 1 and (10**9, good) in kept
    assert (None, bad) not in kept and (10**9, bad) not in kept and len(kept) == docs.count() - len(toxic) + 2


def test_sample_is_bounded_and_held_out(spark, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    rows, totals = labelled_sample(documents, labels, "quality", 10)
    assert Counter(label for _, _, label in rows)[0] <= 10 and Counter(label for _, _, label in rows)[1] == 10
    assert all(zlib.crc32(str(i).encode()) % 5 for i, _, _ in rows) and totals[1] > 10


def test_platt_keeps_order():
    z = np.linspace(-3, 3, 200)
    y = (np.random.default_rng(1).random(200) < 1 / (1 + np.exp(-2 * z + 1))).astype(float)
    a, b = platt(z, y, np.ones(200))
    assert 1 < a < 3.5 and -2.5 < b < 0 and platt(z, np.ones(200), np.ones(200)) == (1.0, 0.0)


def base_by_hand(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    windows = list(zip(words, words[1:], words[2:]))
    often = Counter(windows)
    places = {k + i for k, w in enumerate(windows) if often[w] > 1 for i in range(3)}
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(places)


def test_base_counts_by_hand(spark, odd, documents, sf_dir):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    for docs in (odd, documents):
        texts = sorted((r.doc_id or -1, *base_by_hand(r.text or "")) for r in docs.select("doc_id", "text").collect())
        found = Q.score_quality(docs, labels).collect()
        assert sorted((r.doc_id or -1, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) for r in found) == texts
        for r in found:
            assert r.base_failed == (r.n_words < 50 or 100 * r.n_repeat_words > 50 * r.n_words)
            assert r.kept == (not r.base_failed and r.probability >= 0.5)


@pytest.mark.parametrize("text", ["a b c a b c", "a a a a a", "x\r\nx\r\n\n \n", "", "one", "a b c d a b c e b c d"])
def test_repeats(text):
    data = text.encode()
    memo = Q.byte_hashes()
    assert Q.base_counts(data, data.split(), Q._hashed(data.split(), memo)) == base_by_hand(text)


def test_quality_on_held_out_rows(spark, sf_dir, documents):
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    truth = {r.doc_id: r.quality for r in labels.collect() if zlib.crc32(str(r.doc_id).encode()) % 5 == 0}
    held = [(r.probability >= 0.5, truth[r.doc_id] == 1) for r in Q.score_quality(documents, labels).collect() if r.doc_id in truth]
    assert sum(p == t for p, t in held) / len(held) > 0.85
