"""Language of a text by interpolated Kneser-Ney character models, one per language.

A word is a letter and the letters and marks behind it, in lower case; it is written with a sign for its start ``order - 1``
times before it and one for its end behind it, and the model gives each of its characters and the end a probability after the
``order - 1`` signs before. Spark counts the n-grams of highest order in all documents that may be learned from; the counts
of lower orders are how many different signs stand before an n-gram, as Kneser and Ney have it, so they come from the distinct
n-grams of the next order. A model is sorted arrays of 64-bit hashes: of n-grams with their discounted share, and of contexts
with the weight of the next lower order. Where all n-grams are more than the arrays' bounded size, the models stay tables:
each distinct word of the texts is cut into n-grams, these are joined with the tables order by order, and texts get the sums of
their words, frequent ones in the task and all others by a join. No n-gram is left out either way.

A text goes to the language of the lowest cross-entropy per sign. Its score is the probability that this is right, by a
logistic fit on the lead over the second language in documents that the models have not seen, and a text whose cross-entropy
is beyond what such documents of that language have, at its length, is marked as rejected.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarterglass.llm.common import settle, share, uniform
from quarterglass.llm.labelled import held_out, platt, sigmoid
from quarterglass.llm.token_counts import _least_frequency as least_frequency

START, END = "\x02", "\x03"
#: Language of a text without a letter.
NONE = "und"
#: Letters of Latin-1, which has no marks; the numerals among Python's word characters are none.
_LATIN = re.compile(r"[^\W\d_\xb2\xb3\xb9\xbc-\xbe]+")
_MIX = (np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB))


class Words:
    """Finds the words of a text."""

    def __init__(self):
        import regex

        self.other = regex.compile(r"\p{L}[\p{L}\p{M}]*")

    def of(self, text: str | None) -> list[str]:
        if not text:
            return []
        text = text.lower()
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return self.other.findall(text)
        return _LATIN.findall(text)


# -- counts by Spark ----------------------------------------------------------


def gram_counts(texts: DataFrame, order: int, most_words: int = 300_000) -> DataFrame:
    """(lang, gram, n): n-grams of ``order`` signs over all (lang, text) rows. Tasks count words and cut each distinct one once;
    their tables are handed on at ``most_words`` words."""
    schema = "lang string, gram string, n long"

    def grams(tables: dict[str, Counter]) -> Iterator[pa.RecordBatch]:
        for lang, words in tables.items():
            found = Counter()
            for word, n in words.items():
                signs = START * (order - 1) + word + END
                for at in range(len(word) + 1):
                    found[signs[at : at + order]] += n
            keys = list(found)
            for at in range(0, len(keys), 50_000):
                some = keys[at : at + 50_000]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([lang] * len(some), pa.string()), pa.array(some, pa.string()), pa.array([found[k] for k in some], pa.int64())],
                    ["lang", "gram", "n"],
                )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, tables, held = Words(), {}, 0
        for batch in batches:
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                table = tables.setdefault(lang, Counter())
                before = len(table)
                table.update(words.of(text.as_py()))
                held += len(table) - before
                if held >= most_words:
                    yield from grams(tables)
                    tables, held = {}, 0
        yield from grams(tables)

    return texts.mapInArrow(run, schema).groupBy("lang", "gram").agg(F.sum("n").alias("n"))


def all_orders(highest: DataFrame, order: int) -> DataFrame:
    """(lang, size, gram, n) of every order: counts of the highest, numbers of different signs before the lower ones."""
    level, out = highest, highest.select("lang", F.lit(order).alias("size"), "gram", "n")
    for size in range(order - 1, 0, -1):
        level = level.select("lang", F.substring("gram", 2, size).alias("gram")).groupBy("lang", "gram").agg(F.count("*").alias("n"))
        out = out.unionByName(level.select("lang", F.lit(size).alias("size"), "gram", "n"))
    return out


def discounts(levels: DataFrame, per_table: Column | None) -> DataFrame:
    """(lang, size, discount, least): n1 / (n1 + 2 n2), and the smallest count whose n-grams all find a place in ``per_table``,
    if that is given."""
    by_count = levels.groupBy("lang", "size", "n").agg(F.count("*").alias("grams"))
    down = Window.partitionBy("lang", "size").orderBy(F.desc("n"))  # a row per different count: about the root of the n-grams
    by_count = by_count.withColumn("upto", F.sum("grams").over(down))
    once, twice = (F.sum(F.when(F.col("n") == k, F.col("grams")).otherwise(0)) for k in (1, 2))
    fitting = F.min(F.when(F.col("upto") <= per_table, F.col("n")) if per_table is not None else F.col("n"))
    found = by_count.groupBy("lang", "size").agg(once.alias("once"), twice.alias("twice"), fitting.alias("least"), F.max("n").alias("most"))
    discount = F.greatest(F.least(F.expr("try_divide(once, once + 2 * twice)"), F.lit(0.95)), F.lit(0.1))
    return found.select("lang", "size", F.coalesce(discount, F.lit(0.5)).alias("discount"), F.coalesce("least", F.col("most") + 1).alias("least"))


def shares(levels: DataFrame, places: int | None, order: int) -> DataFrame:
    """(lang, size, gram, share): (n - discount) / occurrences of the context. All n-grams, unless they are more than
    ``places``: then the rarest are left out, but counted among the occurrences."""
    per_table = None
    if places is not None and levels.count() > places:
        per_table = F.floor(F.lit(places) / F.lit(order * max(1, levels.select("lang").distinct().count())))
    limits = discounts(levels, per_table)
    context = F.expr("substring(gram, 1, size - 1)")
    told = levels.withColumn("context", context)
    totals = told.groupBy("lang", "size", "context").agg(F.sum("n").alias("total"))
    kept = told.join(limits, ["lang", "size"]).filter(F.col("n") >= F.col("least"))
    kept = kept.join(totals, ["lang", "size", "context"])
    return kept.select("lang", "size", "gram", ((F.col("n") - F.col("discount")) / F.col("total")).alias("share"))


# -- models -------------------------------------------------------------------


def hashes(signs: np.ndarray) -> np.ndarray:
    """64-bit hashes of rows of code points."""
    out = np.full(len(signs), len(signs[0]) if len(signs) else 0, np.uint64)
    for column in signs.T:
        out = (out ^ column.astype(np.uint64)) * _MIX[0]
        out = (out ^ (out >> np.uint64(30))) * _MIX[1]
        out = (out ^ (out >> np.uint64(27))) * _MIX[2]
        out ^= out >> np.uint64(31)
    return out


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


class Table(NamedTuple):
    """Sorted hashes and their values."""

    keys: np.ndarray
    values: np.ndarray

    @staticmethod
    def of(keys: np.ndarray, values: np.ndarray) -> Table:
        order = np.argsort(keys, kind="stable")
        return Table(keys[order], values[order].astype(np.float32))

    def get(self, keys: np.ndarray, default: float) -> np.ndarray:
        if not len(self.keys):
            return np.full(len(keys), default, np.float32)
        at = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        return np.where(self.keys[at] == keys, self.values[at], np.float32(default))


class Models(NamedTuple):
    """One (n-grams, contexts) pair of tables per language and order; ``signs`` is the number of different signs, one more for
    all that were never seen. ``calibration`` is (a, b) of the score and, per language, (mean, spread, limit) of entropies."""

    languages: list[str]
    order: int
    signs: int
    tables: list[list[tuple[Table, Table]]]
    calibration: tuple[float, float, list[tuple[float, float, float]]]

    def log_shares(self, signs: np.ndarray) -> np.ndarray:
        """Minus the log probability, by language, of the last sign of each row after those before it."""
        distinct = hashes(signs)
        _, first, back = np.unique(distinct, return_index=True, return_inverse=True)
        rows, n = signs[first], self.order
        keys = [(hashes(rows[:, n - k :]), hashes(rows[:, n - k : n - 1])) for k in range(1, n + 1)]
        out = np.empty((len(rows), len(self.languages)), np.float32)
        for i, tables in enumerate(self.tables):
            p = np.full(len(rows), 1.0 / self.signs)
            for (grams, contexts), (own, before) in zip(tables, keys, strict=True):
                p = grams.get(own, 0.0) + contexts.get(before, 1.0) * p
            out[:, i] = -np.log(p)
        return out[back.ravel()]


def models_of(levels: DataFrame, places: int, order: int) -> Models:
    """Models from the shares, all of them or ``places`` at most; the rest of a context's shares is the weight of the lower
    order. ``train`` calls it only where all have a place."""
    found = shares(levels, places, order).toArrow()
    signs = levels.filter(F.col("size") == 1).select("gram").distinct().count()
    lang, size, gram, value = (found[c] for c in ("lang", "size", "gram", "share"))
    languages = sorted(set(lang.to_pylist()))
    code, size, value = np.array([languages.index(x) for x in lang.to_pylist()], int), size.to_numpy(), value.to_numpy()
    gram, tables = np.array(gram.to_pylist(), object), []
    for i in range(len(languages)):
        row = []
        for k in range(1, order + 1):
            at = np.flatnonzero((code == i) & (size == k))
            points = code_points("".join(gram[at])).reshape(len(at), k)
            contexts, back = np.unique(hashes(points[:, : k - 1]), return_inverse=True)
            rest = 1.0 - np.bincount(back.ravel(), value[at], len(contexts))
            row.append((Table.of(hashes(points), value[at]), Table.of(contexts, np.maximum(rest, 1e-9))))
        tables.append(row)
    return Models(languages, order, signs + 1, tables, (1.0, 0.0, [(0.0, 1.0, np.inf)] * len(languages)))


class Scorer:
    """Entropies of texts; words are remembered up to a bound, and new ones of several texts are looked up together."""

    def __init__(self, models: Models, most: int = 400_000):
        self.models, self.words, self.most = models, Words(), most
        self.clear()

    def clear(self) -> None:
        self.known: dict[str, int] = {}
        self.values = np.zeros((0, len(self.models.languages)), np.float32)

    def learn(self, new: list[str]) -> None:
        """Sums of all signs of each new word, in pieces of bounded size."""
        n, at, parts = self.models.order, 0, []
        while at < len(new):
            end, length = at, 0
            while end < len(new) and (end == at or length < 500_000):
                length += len(new[end]) + 1
                end += 1
            some = new[at:end]
            sizes = np.array([len(w) + 1 for w in some])
            points = code_points("".join(START * (n - 1) + w + END for w in some))
            starts = np.repeat(np.cumsum(sizes + n - 1) - sizes - n + 1, sizes) + np.arange(sizes.sum()) - np.repeat(np.cumsum(sizes) - sizes, sizes)
            heads, own = np.cumsum(sizes) - sizes, np.zeros((len(some), len(self.models.languages)))
            for part in range(0, len(starts), 1_000_000):  # one word may be very long
                piece = starts[part : part + 1_000_000]
                logs = self.models.log_shares(points[piece[:, None] + np.arange(n)])
                word = np.searchsorted(heads, np.arange(part, part + len(piece)), side="right") - 1
                for i in range(own.shape[1]):
                    own[:, i] += np.bincount(word, logs[:, i], len(some))
            parts.append(own.astype(np.float32))
            at = end
        self.values = np.concatenate([self.values, *parts])

    def entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(signs, cross-entropy per sign by language) of each text; 0 signs without a letter."""
        signs, out = np.zeros(len(texts), np.int64), np.zeros((len(texts), len(self.models.languages)))
        at = 0
        while at < len(texts):
            if len(self.known) > self.most:
                self.clear()
            ids, ends, length, first = [], [], 0, at
            new, known = [], self.known
            while at < len(texts) and length < 2_000_000:  # characters of the texts that are looked up together
                words = self.words.of(texts[at])
                for w in words:
                    if w not in known:
                        known[w] = len(known)
                        new.append(w)
                ids += [known[w] for w in words]
                ends.append(len(ids))
                signs[at] = sum(map(len, words)) + len(words)
                length += len(texts[at] or "")
                at += 1
            self.learn(new)
            bounds = np.array([0, *ends])
            ids = np.array(ids, np.int64)
            for i in range(out.shape[1]):
                sums = np.concatenate([[0.0], np.cumsum(self.values[ids, i], dtype=float)])
                out[first:at, i] = (sums[bounds[1:]] - sums[bounds[:-1]]) / np.maximum(signs[first:at], 1)
        return signs, out

    def verdicts(self, texts: list[str | None]) -> dict[str, list]:
        """Language, score, cross-entropy, signs and rejection of each text."""
        return judged(self.models, *self.entropies(texts))


def judged(models: Models, signs: np.ndarray, entropies: np.ndarray) -> dict[str, list]:
    """Language, score, cross-entropy, signs and rejection by the cross-entropies of each text."""
    a, b, limits = models.calibration
    out = {"lang_pred": [], "score": [], "entropy": [], "n_signs": [], "rejected": []}
    for n, own in zip(signs.tolist(), entropies, strict=True):
        if not n or not models.languages:
            values = (NONE, 0.0, None, n, True)
        else:
            best = int(own.argmin())  # the first of equal ones
            mean, spread, limit = limits[best]
            values = (models.languages[best], float(sigmoid(np.array(a * lead(own, n, models.signs) + b))), float(own[best]), n,
                      bool((own[best] - mean) * n**0.5 / spread > limit))
        for name, value in zip(out, values, strict=True):
            out[name].append(value)
    return out


def lead(entropies: np.ndarray, n: int, signs: int) -> float:
    """How far the best language leads over the second, or over signs drawn evenly where there is no other."""
    best, second = np.sort([*entropies, np.log(signs)])[:2] if len(entropies) == 1 else np.sort(entropies)[:2]
    return float(np.log1p(max(0.0, second - best) * n))


def calibrated(models: Models, languages: list[str], signs: np.ndarray, entropies: np.ndarray, tail: float) -> Models:
    """Score and limits from texts of known languages that the models have not seen."""
    own = [(models.languages.index(lang), n, h) for lang, n, h in zip(languages, signs.tolist(), entropies, strict=True) if n and lang in models.languages]
    if not own:
        return models
    z = np.array([lead(h, n, models.signs) for _, n, h in own])
    right = np.array([int(h.argmin()) == i for i, _, h in own], int)
    # two made-up rows, right and wrong by an even chance at no lead, keep a fit without errors from certainty
    a, b = platt(np.r_[z, 0.0, 0.0], np.r_[right, 0, 1], np.ones(len(z) + 2))
    limits = []
    for i in range(len(models.languages)):
        mine = [(n, h[i]) for k, n, h in own if k == i]
        if len(mine) < 20:
            limits.append((0.0, 1.0, np.inf))  # too few to know: nothing is rejected
            continue
        n, h = np.array([m[0] for m in mine], float), np.array([m[1] for m in mine])
        mean = float((n * h).sum() / n.sum())
        t = (h - mean) * np.sqrt(n)
        spread = float(np.sqrt((t * t).mean())) or 1.0
        limits.append((mean, spread, float(np.quantile(t / spread, 1 - tail)) + 1.0))
    return models._replace(calibration=(a, b, limits))


# -- models that stay tables --------------------------------------------------


class Stored(NamedTuple):
    """Models of more n-grams than the arrays hold: ``grams`` (size, gram, shares) and ``contexts`` (size, context, weights)
    have an entry per language; ``judge`` has all but the tables."""

    judge: Models
    grams: DataFrame
    contexts: DataFrame


def stored_of(levels: DataFrame, order: int) -> Stored:
    languages = sorted(r.lang for r in levels.select("lang").distinct().collect())
    signs = levels.filter(F.col("size") == 1).select("gram").distinct().count()

    def by_language(value: str, absent: float) -> Column:
        return F.array(*[F.coalesce(F.sum(F.when(F.col("lang") == lang, F.col(value))), F.lit(absent)) for lang in languages])

    found = settle(shares(levels, None, order), "shares")
    weights = found.groupBy("lang", "size", F.expr("substring(gram, 1, size - 1)").alias("context"))
    weights = weights.agg(F.greatest(1 - F.sum("share"), F.lit(1e-9)).alias("weight"))
    grams = settle(found.groupBy("size", "gram").agg(by_language("share", 0.0).alias("shares")), "grams-by-language")
    contexts = settle(weights.groupBy("size", "context").agg(by_language("weight", 1.0).alias("weights")), "contexts-by-language")
    return Stored(Models(languages, order, signs + 1, [], (1.0, 0.0, [(0.0, 1.0, np.inf)] * len(languages))), grams, contexts)


def word_sums(words: DataFrame, models: Stored) -> DataFrame:
    """(word, sums): by language minus the log probability of all signs of each of the distinct ``words``."""
    order, count = models.judge.order, len(models.judge.languages)
    signs = F.concat(F.lit(START * (order - 1)), F.col("word"), F.lit(END))
    windows = words.select("word", signs.alias("signs")).select("word", F.explode(F.expr(f"transform(sequence(1, length(word) + 1), i -> substring(signs, i, {order}))")).alias("gram"))
    distinct = settle(windows.select("gram").distinct(), "windows")
    lower = None
    for size in range(1, order + 1):
        own = distinct.select(F.substring("gram", order - size + 1, size).alias("gram")).distinct()
        own = own.join(models.grams.filter(F.col("size") == size).select("gram", "shares"), "gram", "left").withColumn("context", F.substring("gram", 1, size - 1))
        own = own.join(models.contexts.filter(F.col("size") == size).select("context", "weights"), "context", "left")
        if lower is None:
            own = own.withColumn("rest", F.array_repeat(F.lit(1.0 / models.judge.signs), count))
        else:
            own = own.withColumn("suffix", F.substring("gram", 2, size - 1)).join(lower.select(F.col("gram").alias("suffix"), F.col("p").alias("rest")), "suffix")
        rest = F.when(F.col("weights").isNull(), F.col("rest")).otherwise(F.zip_with("weights", "rest", lambda w, q: w * q))
        lower = own.select("gram", F.when(F.col("shares").isNull(), rest).otherwise(F.zip_with("shares", rest, lambda s, q: s + q)).alias("p"))
    sums = F.array(*[F.sum(-F.ln(F.col("p")[i])) for i in range(count)])
    return windows.join(lower, "gram").groupBy("word").agg(sums.alias("sums"))


def _word_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def some() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(table), pa.string()), pa.array(list(table.values()), pa.int64())], ["word", "n"])

    words, table = Words(), Counter()
    for batch in batches:
        for text in batch.column(0):
            table.update(words.of(text.as_py()))
            if len(table) >= 200_000:
                yield some()
                table = Counter()
    yield some()


_PARTS = "row long, doc_id long, held_out boolean, n_signs long, sums array<double>, word string, n long"


def _text_parts(shared, count: int):
    """Per text a row with the sums of its frequent words, and a row for each other word."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, values = pickle.loads(shared.value)
        places, words, row = {w: i for i, w in enumerate(known)}, Words(), TaskContext.get().partitionId() << 40
        types = (pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.list_(pa.float64()), pa.string(), pa.int64())
        names = [part.split()[0] for part in _PARTS.split(", ")]
        out = []
        for batch in batches:
            for doc_id, held, text in zip(*(batch.column(i) for i in range(3)), strict=True):
                row += 1
                bag = Counter(words.of(text.as_py()))
                at = np.fromiter((places.get(w, -1) for w in bag), np.int64, len(bag))
                n = np.fromiter(bag.values(), float, len(bag))
                sums = n[at >= 0] @ values[at[at >= 0]] if (at >= 0).any() else np.zeros(count)
                out.append((row, doc_id.as_py(), held.as_py(), sum((len(w) + 1) * k for w, k in bag.items()), sums.tolist(), None, None))
                out += [(row, None, None, None, None, w, k) for (w, k), i in zip(bag.items(), at.tolist(), strict=True) if i < 0]
                if len(out) >= 20_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)
                    out = []
        if out:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names)

    return run


def text_sums(texts: DataFrame, models: Stored, head: int = 200_000) -> DataFrame:
    """(doc_id, held_out, n_signs, sums) of (doc_id, held_out, text) rows. About ``head`` most frequent words go to tasks, the
    sums of all others are joined; that changes the plan only."""
    count = len(models.judge.languages)
    words = settle(texts.select("text").mapInArrow(_word_counts, "word string, n long").groupBy("word").agg(F.sum("n").alias("n")), "words")
    sums = settle(word_sums(words.select("word"), models).join(words, "word"), "word-sums")
    often = sums.filter(F.col("n") >= least_frequency(sums, head)).select("word", "sums").toArrow()  # ``head`` rows at most
    values = np.array(often.column("sums").to_pylist(), float).reshape(-1, count)
    shared = share(texts.sparkSession, (often.column("word").to_pylist(), values))
    parts = settle(texts.mapInArrow(_text_parts(shared, count), _PARTS), "text-parts")
    others = parts.filter("word IS NOT NULL").select("row", "word", F.col("n").alias("times")).join(sums.select("word", F.col("sums").alias("own")), "word")
    more = others.groupBy("row").agg(F.array(*[F.sum(F.col("times") * F.col("own")[i]) for i in range(count)]).alias("more"))
    both = F.when(F.col("more").isNull(), F.col("sums")).otherwise(F.zip_with("sums", "more", lambda x, y: x + y))
    return parts.filter("word IS NULL").join(more, "row", "left").select("doc_id", "held_out", "n_signs", both.alias("sums"))


def train(
    docs: DataFrame, order: int = 5, places: int = 1_000_000, calibration_rows: int = 3_000, tail: float = 0.001, id_col: str = "doc_id",
    text_col: str = "text", lang_col: str = "lang",
) -> Models | Stored:
    """Models of the languages in ``docs``, from rows with a language that are not held out.

    Every twentieth of these, by a hash of the text, is kept from the counts; at most ``calibration_rows`` of them fit the score.
    All other rows are counted. With more than ``places`` n-grams the models stay tables.
    """
    read = docs.select(F.col(id_col).alias("id"), F.col(lang_col).cast("string").alias("lang"), F.col(text_col).alias("text"))
    read = read.filter(F.col("lang").isNotNull() & ~held_out(F.col("id")))
    apart = F.pmod(F.xxhash64("text", F.lit(11)), F.lit(20)) == 0
    levels = settle(all_orders(settle(gram_counts(read.filter(~apart).select("lang", "text"), order), "grams"), order), "gram-orders")
    drawn = read.filter(apart).orderBy(uniform(11, F.col("id")), "id", F.xxhash64("text")).limit(calibration_rows).collect()
    languages, texts = [r.lang for r in drawn], [r.text for r in drawn]
    if levels.count() <= places:
        models = models_of(levels, places, order)
        return calibrated(models, languages, *Scorer(models).entropies(texts), tail) if models.languages else models
    models = stored_of(levels, order)
    rows = docs.sparkSession.createDataFrame([(i, False, t) for i, t in enumerate(texts)], "doc_id long, held_out boolean, text string")
    found = text_sums(rows, models).orderBy("doc_id").collect()
    signs = np.array([r.n_signs for r in found], np.int64)
    entropies = np.array([r.sums for r in found], float).reshape(len(found), -1) / np.maximum(signs, 1)[:, None]
    return models._replace(judge=calibrated(models.judge, languages, signs, entropies, tail))


def identify(docs: DataFrame, models: Models | Stored, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, held_out, lang_pred, score, entropy, n_signs, rejected) of every row.

    NULL, empty and letterless texts are ``und`` with score 0 and rejected; so is every text where no language could be
    learned. Of equally close languages the first by code point is taken. Rows without an id are held out, repeated rows
    are judged each, other columns don't matter, and an empty table gives no rows.
    """
    schema = "doc_id long, held_out boolean, lang_pred string, score double, entropy double, n_signs long, rejected boolean"

    def rows(some: pa.RecordBatch, found: dict[str, list]) -> pa.RecordBatch:
        types = (pa.string(), pa.float64(), pa.float64(), pa.int64(), pa.bool_())
        arrays = [pa.array(values, kind) for values, kind in zip(found.values(), types, strict=True)]
        return pa.RecordBatch.from_arrays([some.column(0), some.column(1), *arrays], ["doc_id", "held_out", *found])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = Scorer(pickle.loads(shared.value))
        for batch in batches:
            for at in range(0, len(batch), 1_000):
                some = batch.slice(at, 1_000)
                yield rows(some, scorer.verdicts(some.column(2).to_pylist()))

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        judge = pickle.loads(shared.value)
        for batch in batches:
            signs = batch.column(2).to_numpy()
            sums = np.array(batch.column(3).to_pylist(), float).reshape(len(batch), len(judge.languages))
            yield rows(batch, judged(judge, signs, sums / np.maximum(signs, 1)[:, None]))

    own = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).cast("string").alias("text"))
    if isinstance(models, Stored):
        shared = share(docs.sparkSession, models.judge)
        return text_sums(own, models).mapInArrow(judge, schema)
    shared = share(docs.sparkSession, models)
    return own.mapInArrow(run, schema)
