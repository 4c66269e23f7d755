"""Operators 11 to 13 against brute force, on odd rows and on the given tables."""

import itertools
import math
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quarterglass.llm import divergence as D
from quarterglass.llm import language as L
from quarterglass.llm import whitening as W
from quarterglass.llm.queries import REGISTRY

# -- op13 ---------------------------------------------------------------------


def plain_whitening(vectors, most):
    x = np.floor(64 * np.array(vectors, float)) + 1_000_000
    w = x - x.mean(axis=0)
    values, turn = np.linalg.eigh(w.T @ w / len(w))
    values, turn = values[::-1], turn[:, ::-1]
    k = min(most, int((values > 1e-9 * values[0]).sum()))
    whole = [[int(v) for v in row] for row in x]
    sums = [sum(c) for c in zip(*whole, strict=True)]
    far = [sum((len(x) * a - s) ** 2 for a, s in zip(row, sums, strict=True)) for row in whole]
    return w @ turn[:, :k] / np.sqrt(values[:k]), values[:k] / values.sum(), far


def test_whitening_equals_a_dense_decomposition(spark, sf_dir):
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").orderBy("vec_id").collect()
    expected, explained, far = plain_whitening([r.embedding for r in rows], 32)
    found = REGISTRY["op13_whitening"](spark, sf_dir).orderBy("vec_id", "component").toPandas()
    assert len(found) == len(rows) * 32 and found["n"].eq(len(rows)).all() and found["identity_error"].nunique() == 1
    assert found["identity_error"].iloc[0] < 1e-9
    turned = found["whitened"].to_numpy().reshape(len(rows), 32)
    assert np.allclose(np.abs(turned), np.abs(expected), atol=1e-7) and np.allclose(turned.T @ turned / len(rows), np.eye(32), atol=1e-9)
    assert np.allclose(found["explained"].to_numpy()[:32], explained, rtol=1e-9)
    assert found["deviation"].to_numpy()[::32].tolist() == far


def test_whitening_of_odd_rows(spark):
    nan, inf = float("nan"), float("inf")
    whole = [(1, [0.5, 1.0, -2.0]), (1, [0.5, 1.0, -2.0]), (None, [3.0, 1.0, 1.0]), (4, [1.0, 1.0, 7.25]), (5, [9.0, 1.0, 0.0])]
    odd = [(6, None), (7, [1.0, None, 2.0]), (8, [1.0, nan, 2.0]), (9, [1.0, 2.0, inf]), (10, []), (11, [1.0]), (12, [1.0, 2.0, 3.0, 4.0])]
    schema = "vec_id long, embedding array<float>, n long, component int, whitened double"
    table = spark.createDataFrame([(i, v, 1, 2, 0.5) for i, v in whole + odd], schema).repartition(3)
    found = W.whiten(table).orderBy("vec_id", "component").collect()
    expected, explained, far = plain_whitening([v for _, v in whole], 32)
    assert expected.shape == (5, 2)  # the second entry never varies
    assert sorted((str(r.vec_id), r.component, r.deviation) for r in found) == sorted((str(i), c, f) for (i, _), f in zip(whole, far, strict=True) for c in (1, 2))
    assert all(r.n == 5 and abs(r.explained - explained[r.component - 1]) < 1e-12 and r.identity_error < 1e-12 for r in found)
    assert not W.whiten(table.limit(0)).collect() and W.whiten(table.limit(0)).columns == W.whiten(table).columns
    assert not W.whiten(table.filter("vec_id = 1")).collect() and not W.whiten(table.filter("vec_id in (6, 7, 8)")).collect()
    huge = spark.createDataFrame([(1, [1e30, 0.0]), (2, [0.0, 1.0]), (3, [-1e30, 2.0])], "vec_id long, embedding array<double>")
    assert {r.deviation for r in W.whiten(huge).collect() if r.vec_id != 2} == {None}


@pytest.mark.parametrize(
    "values", [[7.0] * 6, [3, 3, 3, 2, 2, 1, 0, 0], list(2.0 ** -np.arange(40)), [5.0] + [1e-20] * 5, [1 + 1e-13, 1, 1 - 1e-13, 0.5], list(range(70, 0, -1))]
)
def test_eigenpairs_of_equal_close_and_missing_values(values):
    d = len(values)
    q, _ = np.linalg.qr(np.random.default_rng(d).standard_normal((d, d)))
    v = (q * np.array(values, float)) @ q.T
    v = (v + v.T) / 2
    found = W.leading_components(v, 32)
    k, top = len(found.values), values[0]
    assert np.allclose(found.values, values[:k], atol=1e-12 * top) and (k == 32 or all(x < 1e-11 * top for x in values[k:]))
    assert np.abs(found.vectors.T @ found.vectors - np.eye(k)).max() < 1e-12
    assert np.abs(v @ found.vectors - found.vectors * found.values).max() < 1e-12 * top
    assert all(above == (np.array(values) > shift).sum() == W.inertia_above(v, shift) for shift, above in found.counts)
    with pytest.raises(ArithmeticError):
        W.certify(np.diag([3.0, 2.0, 1.0]), np.array([3.0, 1.0]), 0.0)


def test_inertia_needs_no_pivot_on_the_diagonal():
    rng = np.random.default_rng(5)
    for d in range(1, 12):
        a = rng.integers(-3, 4, (d, d)).astype(float)
        a = a + a.T
        np.fill_diagonal(a, 0.0)
        for shift in (-2.5, 0.3, 1.7):
            assert W.inertia_above(a, shift) == (np.linalg.eigvalsh(a) > shift).sum()


# -- op12 ---------------------------------------------------------------------


def plain_divergences(rows, min_df, top):
    """Every pair over every kept term, from the definition."""
    docs = [tuple(x or "" for x in r) for r in rows]
    find = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    fold = {c: c + 32 for c in range(65, 91)}
    df, counts = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        terms = find.findall(text.translate(fold))
        df[lang].update(set(terms))
        counts[lang, source].update(terms)
    f = lambda p, q: (p - q) ** 2 // (p + q)
    out = set()
    for lang in {d[1] for d in docs}:
        kept = [t for t, n in df[lang].items() if n >= min_df]
        groups = {s: c for (own, s), c in counts.items() if own == lang}

        def given(count, kept=kept):
            total = sum(count[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (count[t] + 2) // (total + 2 * len(kept)) for t in kept}

        shares = {s: given(c) for s, c in groups.items()}
        whole = given(sum(groups.values(), Counter()))
        for s, p in shares.items():
            pairs = [(sum(f(p[t], q[t]) for t in kept), o) for o, q in shares.items() if o != s]
            terms = [(f(p[t], whole[t]), t) for t in kept if groups[s][t] and p[t] > whole[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, top)):
                ranked = sorted(found, key=lambda x: (-x[0], x[1].encode()))[:most]
                out |= {(lang, s, part, item, value, rank) for rank, (value, item) in enumerate(ranked, 1)}
    return out


def source_rows():
    rng = np.random.default_rng(12)
    rows = []
    for k in range(150):
        words = [f"{'abcdefghij'[int(i)]}é" if i % 3 else f"T{'qrstuvwxyz'[int(i)]}" for i in rng.zipf(1.6, 40) % 10]
        rows.append((" ".join(words) + f" u{k},\x00日本{k % 3}-ΣÉ it's", ["en", "de", None, "EN"][k % 7 % 4], None if k % 11 == 0 else f"s{k % 5 * (k % 3)}"))
    rows += [("", "en", "empty"), (None, "en", None), ("  \n", "xx", "a"), ("once", "xx", "b"), ("w " * 3000, "en", "s0"), rows[0], rows[0]]
    return rows


@pytest.mark.parametrize(("min_df", "slice_postings"), [(10, 2_000_000), (2, 5), (10_000, 10)])
def test_divergences_equal_the_definition(spark, min_df, slice_postings):
    rows = source_rows()
    docs = spark.createDataFrame(rows, "text string, lang string, source string").withColumns({"term": F.lit(1), "p": F.lit(2), "value": F.lit(3)}).repartition(4)
    found = [tuple(r) for r in D.audit_sources(docs, min_df, 10, slice_postings).collect()]
    assert len(found) == len(set(found)) and set(found) == plain_divergences(rows, min_df, 10)


def test_divergences_of_odd_and_no_rows(spark, odd, nothing):
    assert not D.audit_sources(nothing).collect()
    rows = [(r.text, r.lang, r.source) for r in odd.collect()]
    assert {tuple(r) for r in D.audit_sources(odd, 2).collect()} == plain_divergences(rows, 2, 10)


def test_tables_of_a_task_may_be_handed_on_early(spark):
    docs = spark.createDataFrame(source_rows(), "text string, lang string, source string")
    total = lambda most: sorted(map(tuple, D.term_counts(docs, most).groupBy("lang", "source", "term").agg(F.sum("n"), F.sum("df")).collect()))
    assert total(3) == total(300_000)


def test_scatter_emits_no_posting_pairs():
    """One hot term in 200 sources has 19,900 pairs and as many cells; terms shared by the same sources add to those cells."""
    terms, sources = np.repeat(np.arange(30), 200), np.tile(np.arange(200), 30)
    p, p0 = np.full(6000, 1000), np.full(6000, 10)
    cells = [(a, b) for a, peers, _ in D.scatter(terms, sources, p, p0, 200) for b in peers]
    assert cells == list(itertools.combinations(range(200), 2))


# -- op11 ---------------------------------------------------------------------


def plain_model(texts, order):
    """log P(sign | the order - 1 before it) by interpolated Kneser-Ney, from the definition, nothing left out."""
    words = L.Words()
    levels = {order: Counter()}
    for text in texts:
        for w in words.of(text):
            signs = L.START * (order - 1) + w + L.END
            levels[order].update(signs[i : i + order] for i in range(len(w) + 1))
    for k in range(order - 1, 0, -1):
        levels[k] = Counter(g[1:] for g in levels[k + 1])
    cut = {}
    for k, grams in levels.items():
        times = Counter(grams.values())
        cut[k] = min(max(times[1] / (times[1] + 2 * times[2]), 0.1), 0.95) if times[1] + times[2] else 0.5

    def p(gram, signs):
        if not gram:
            return 1 / signs
        k, grams = len(gram), levels[len(gram)]
        own = {g: n for g, n in grams.items() if g[:-1] == gram[:-1]}
        if not own:
            return p(gram[1:], signs)
        total = sum(own.values())
        return max(own.get(gram, 0) - cut[k], 0) / total + cut[k] * len(own) / total * p(gram[1:], signs)

    return p, set(levels[1])


TEXTS = {
    "xa": ["Banana bandana, an ant and a panda.", "Sand stands in a band 12 times."],
    "yé": ["Été bébé décédé élève évêque", "ÉTÉ été Ñandú straße", "日本語 と 日本"],
}


def test_models_equal_kneser_and_ney(spark):
    rows = [(lang, t) for lang, texts in TEXTS.items() for t in texts]
    docs = spark.createDataFrame(rows, "lang string, text string").repartition(3)
    levels = L.all_orders(L.gram_counts(docs, 3, 4), 3)
    models = L.models_of(levels, 10_000, 3)
    plain = {lang: plain_model(texts, 3) for lang, texts in TEXTS.items()}
    signs = len(set().union(*(s for _, s in plain.values()))) + 1
    assert models.languages == ["xa", "yé"] and models.signs == signs
    grams = ["\x02\x02b", "\x02ba", "ban", "nd\x03", "ndq", "zzz", "é\x03é", "日本\x03", "日本語", "\x02\x02日", "été"]
    found = models.log_shares(np.stack([L.code_points(g) for g in grams]))
    for g, logs in zip(grams, found, strict=True):
        for lang, value in zip(models.languages, logs, strict=True):
            assert math.isclose(value, -math.log(plain[lang][0](g, signs)), rel_tol=1e-5), (g, lang)
    alphabet = sorted(set().union(*(s for _, s in plain.values())))
    sizes = []
    for models in (models, L.models_of(levels, 60, 3)):  # also where only some n-grams find a place
        sizes.append(sum(len(grams.keys) for tables in models.tables for grams, _ in tables))
        for context in ("\x02\x02", "an", "qq", "é\x03"):
            total = np.exp(-models.log_shares(np.stack([L.code_points(context + s) for s in alphabet]))).sum(axis=0)
            assert np.all(total <= 1 + 1e-5) and np.all(total >= 0.8)
    assert sizes[0] == levels.count() and 0 < sizes[1] <= 60


def test_entropy_of_a_text_is_that_of_its_words(spark):
    docs = spark.createDataFrame([(lang, t) for lang, texts in TEXTS.items() for t in texts], "lang string, text string")
    models = L.models_of(L.all_orders(L.gram_counts(docs, 3), 3), 10_000, 3)
    texts = ["Banana, an été!", "", None, "12 ²", "x" * 3000, "an", "an an", "Banana, an été!"]
    for most in (2, 400_000):
        signs, found = L.Scorer(models, most).entropies(texts)
        assert signs.tolist() == [14, 0, 0, 0, 3001, 3, 6, 14] and np.allclose(found[5], found[6]) and np.allclose(found[0], found[7])
        own = [g for w in ("banana", "an", "été") for g in [("\x02\x02" + w + "\x03")[i : i + 3] for i in range(len(w) + 1)]]
        assert np.allclose(found[0], models.log_shares(np.stack([L.code_points(g) for g in own])).mean(axis=0), rtol=1e-5)


def test_languages_of_held_out_documents(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    truth = {r.doc_id: r.lang for r in docs.collect()}
    found = REGISTRY["op11_language"](spark, sf_dir).collect()
    assert sorted(r.doc_id for r in found) == sorted(truth)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in found)
    apart = [r for r in found if r.held_out]
    assert len(apart) > 20 and np.mean([r.lang_pred == truth[r.doc_id] for r in apart]) > 0.97
    assert np.mean([r.rejected for r in apart]) < 0.1
    blind = docs.withColumns({"lang": F.when(~L.held_out(F.col("doc_id")), F.col("lang")).otherwise("zz"), "source": F.lit("s")})
    again = {r.doc_id: r.lang_pred for r in L.identify(blind, L.train(blind)).collect()}
    assert again == {r.doc_id: r.lang_pred for r in found}


def test_more_n_grams_than_places_change_nothing(spark, sf_dir):
    """Models that stay tables use every n-gram, as the arrays do."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    arrays, tables = L.train(docs, order=3), L.train(docs, order=3, places=50)
    assert isinstance(arrays, L.Models) and isinstance(tables, L.Stored)
    assert tables.grams.selectExpr("sum(size(filter(shares, x -> x > 0)))").first()[0] == sum(len(g.keys) for t in arrays.tables for g, _ in t)
    assert {r.lang_pred: r for r in L.identify(docs, arrays).collect()}.keys() - {"und"}
    expected = {r.doc_id: r for r in L.identify(docs, arrays).collect()}
    found = L.identify(docs, tables).collect()
    assert len(found) == len(expected)
    for r in found:
        own = expected[r.doc_id]
        assert (r.lang_pred, r.held_out, r.n_signs) == (own.lang_pred, own.held_out, own.n_signs)
        assert math.isclose(r.score, own.score, abs_tol=1e-4) and math.isclose(r.entropy or 0, own.entropy or 0, rel_tol=1e-4)
    few = L.text_sums(docs.selectExpr("doc_id", "false AS held_out", "text"), tables, head=20)
    assert all(math.isclose(min(r.sums) / max(1, r.n_signs), expected[r.doc_id].entropy or 0, rel_tol=1e-4) for r in few.collect())


def test_rejection_of_an_unknown_language(spark):
    rng = np.random.default_rng(2)
    make = lambda parts: " ".join("".join(rng.choice(parts, 3)) for _ in range(60))
    rows = [(k, make(["ba", "na", "to", "re"]), "p") if k % 2 else (k, make(["xi", "quo", "zet", "wu"]), "q") for k in range(1500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    models = L.train(docs, calibration_rows=500)
    probe = spark.createDataFrame([(1, make(["ba", "na", "to", "re"])), (2, make(["xi", "quo", "zet", "wu"])), (3, make(["ky", "lg", "hm", "vd"]))], "doc_id long, text string")
    assert [(r.lang_pred, r.rejected) for r in L.identify(probe, models).orderBy("doc_id").collect()][:2] == [("p", False), ("q", False)]
    assert L.identify(probe, models).filter("doc_id = 3").first().rejected


def test_languages_of_odd_and_no_rows(spark, odd, nothing):
    assert not L.identify(nothing, L.train(nothing)).collect()
    without = L.identify(odd, L.train(nothing)).collect()
    assert len(without) == 17 and {(r.lang_pred, r.score) for r in without} == {("und", 0.0)}
    found = L.identify(odd, L.train(odd)).collect()
    assert len(found) == 17 and all(r.held_out for r in found if r.doc_id is None)
    by_id = {r.doc_id: r for r in found}
    assert {by_id[k].lang_pred for k in (5, 6, 7)} == {"und"} and by_id[14].lang_pred == "en" and by_id[12].n_signs > 90_000
    unlabelled = odd.withColumn("lang", F.lit(None).cast("string"))
    assert {r.lang_pred for r in L.identify(unlabelled, L.train(unlabelled)).collect()} == {"und"}
