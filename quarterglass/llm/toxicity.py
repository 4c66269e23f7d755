"""Toxicity by the nearest labelled examples: exact TF-IDF cosine over block-max inverted lists, and distance-weighted votes.

The examples are a bounded sample of the labelled rows. Terms are all words of the examples, and those beginnings of words
whose document frequency differs between the labels beyond chance; document frequencies are those of all documents. Words
that differ so weigh in full, all others by ``OTHER``: none is left out, and words that no example has are in the length of
a text's vector. The terms of most examples, whose lists would be the longest, are columns of a matrix that several texts are
multiplied with at once; all others have inverted lists. Their postings are in blocks of examples with the largest weight of
each block; blocks are visited by the bound that follows from these and the matrix until none can hold a nearer example, so
what is found are the exact nearest ones.
"""

from __future__ import annotations

import pickle
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterglass.llm.chunks import Memo
from quarterglass.llm.common import rows_where, share
from quarterglass.llm.labelled import class_weights, held_out, labelled_sample, logit, platt, sigmoid

_TERM = re.compile(r"\w+")
#: Weight of words that occur alike under both labels.
OTHER = 0.1
#: Lengths of the word beginnings that are terms beside the words.
BEGINNINGS = (4, 5, 6)
#: Texts that are searched together, the number of their terms from which fewer are, and those whose lists are read together.
TOGETHER, MOST_TERMS, FEW = 64, 50_000, 8


def word_terms(word: str) -> list[str]:
    return [word, *("^" + word[:n] for n in BEGINNINGS if len(word) > n)]


def _g2(a: np.ndarray, b: np.ndarray, n1: int, n0: int) -> np.ndarray:
    """Log-likelihood ratio of terms in ``a`` of n1 and ``b`` of n0 documents."""
    both, out = (a + b) / (n1 + n0), np.zeros(len(a))
    for x, n in ((a, n1), (b, n0)):
        for seen, expected in ((x, n * both), (n - x, n * (1 - both))):
            out += 2 * seen * np.log(np.maximum(seen, 1e-300) / np.maximum(expected, 1e-300))
    return out


def _vocabulary(texts: list[str], y: np.ndarray, by_chance: float) -> tuple[list[str], set[str], np.ndarray]:
    """(terms in order, those that differ between the labels, the document frequency of each term among the texts).

    Texts are held as numbers of their words, and beginnings are counted one length after the other: as tables of words,
    texts and beginnings would be several hundred MB in the driver.
    """
    number: dict[str, int] = {}
    bags = []
    for text in texts:
        bag = set(_TERM.findall(text.lower()))
        bags.append(np.fromiter((number.setdefault(word, len(number)) for word in bag), np.int32, len(bag)))

    def seen(of: np.ndarray | None, size: int) -> np.ndarray:
        """Documents of label 0 and of label 1 with each word, or with each number that ``of`` gives for words; -1: none."""
        n = np.zeros((2, size), np.int64)
        for bag, label in zip(bags, y.tolist(), strict=True):
            own = bag if of is None else np.unique(of[bag])
            n[label, own[own >= 0]] += 1
        return n

    words = seen(None, len(number))
    strings, counts = [np.array(list(number), object)], [words]
    for length in BEGINNINGS:
        begun: dict[str, int] = {}
        of = np.fromiter((begun.setdefault("^" + word[:length], len(begun)) if len(word) > length else -1 for word in number), np.int32, len(number))
        n = seen(of, len(begun))
        often = n.sum(axis=0) >= 3
        strings.append(np.array(list(begun), object)[often])
        counts.append(n[:, often])
    n1, n0 = int(y.sum()), int(len(y) - y.sum())
    strings, counts = np.concatenate(strings), np.concatenate(counts, axis=1)
    common = np.flatnonzero(counts.sum(axis=0) >= 3) if n1 and n0 else np.zeros(0, int)
    gain = _g2(counts[1, common].astype(float), counts[0, common].astype(float), n1, n0)
    telling = common[gain >= 2 * np.log(max(1.0, len(common) / by_chance))]  # about ``by_chance`` terms pass that differ by chance
    often = dict(zip(strings[telling].tolist(), counts[:, telling].sum(axis=0).tolist(), strict=True))
    terms = sorted(number.keys() | often.keys())
    total = words.sum(axis=0)
    return terms, set(often), np.array([total[number[t]] if t in number else often[t] for t in terms], float)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """The numbers of all ranges, one range after the other."""
    return np.repeat(starts - (np.cumsum(sizes) - sizes), sizes) + np.arange(int(sizes.sum()))


def term_counter(terms: dict[str, int]):
    """text -> (terms, their counts, counts of the words that are none); a word is looked up once."""
    beginnings = {t for t in terms if t.startswith("^")}

    def look_up(word: str) -> int:
        """The word's term, -1 for none; below that, -2 less, with beginnings that are terms."""
        term = terms.get(word, -1)
        return -3 - term if any("^" + word[:n] in beginnings for n in BEGINNINGS if len(word) > n) else term

    memo = Memo(look_up, 500_000)

    def count(text: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        bag = Counter(_TERM.findall(text.lower()))
        found = np.fromiter(map(memo.__getitem__, bag), np.int64, len(bag))
        n = np.fromiter(bag.values(), float, len(bag))
        begun = np.flatnonzero(found < -1)
        if len(begun):
            words, more = list(bag), Counter()
            for at in begun.tolist():
                for t in word_terms(words[at])[1:]:
                    if t in beginnings:
                        more[terms[t]] += n[at]
            found[begun] = -3 - found[begun]
            found = np.append(found, np.fromiter(more, np.int64, len(more)))
            n = np.append(n, np.fromiter(more.values(), float, len(more)))
        known = found >= 0
        return found[known], n[known], n[~known]

    return count


class Examples:
    """The index of labelled examples; ``score`` gives the calibrated probability and the nearest examples' ids.

    ``frequencies`` gives (documents, document frequency of each term) of the corpus for the index's terms; without it the
    examples are the corpus.
    """

    def __init__(self, rows: list[tuple[int, str, int]], totals: dict[int, int], k: int = 15, block: int = 64, by_chance: float = 1.0, frequencies=None, columns: int = 512):
        self.k, self.block = k, block
        y = np.array([label for _, _, label in rows], int)
        terms, telling, often = _vocabulary([text for _, text, _ in rows], y, by_chance)
        self.terms = {t: i for i, t in enumerate(terms)}
        n, often = frequencies(self.terms) if frequencies else (len(rows), often)
        self.rare = OTHER * (1.0 + np.log(max(1, n)))  # of words that no example has
        share = np.array([1.0 if t in telling else OTHER for t in terms])
        self.idf = share * (1.0 + np.log(np.maximum(1.0, n / np.maximum(1.0, often))))

        count = self.counter()
        weight = class_weights(y, totals)
        vectors = []
        for _, text, _ in rows:
            own, weights = self.vector(*count(text))
            vectors.append((own.astype(np.int32), weights))
        del count  # its words
        blank = np.array([not len(v[0]) for v in vectors], bool)
        toxic, total = float((weight * y)[blank].sum()), float(weight[blank].sum())
        whole = float((weight * y).sum() / weight.sum()) if len(y) else 0.0
        self.blank = (toxic + whole) / (total + 1.0)  # among examples without words
        self.prior = whole

        order = sorted(np.flatnonzero(~blank).tolist(), key=lambda d: (int(vectors[d][0][np.argmax(vectors[d][1])]), d))
        self.ids = np.array([rows[d][0] for d in order], np.int64)
        self.label, self.weight = y[order] if order else np.zeros(0, int), weight[order] if order else np.zeros(0)
        vectors = [vectors[d] for d in order]
        self._index(vectors, len(terms), columns)

        self.a, self.b = 1.0, 0.0
        found = []
        for at in range(0, len(order), TOGETHER):
            some = vectors[at : at + TOGETHER]
            found += self.nearest_of(some, np.arange(at, at + len(some)))
        raw = np.array([self.vote(*own) for own in found])
        if len(raw):
            self.a, self.b = platt(logit(raw), self.label.astype(float), self.weight)

    def _index(self, vectors: list[tuple[np.ndarray, np.ndarray]], n_terms: int, columns: int) -> None:
        """The matrix and the lists; numbers of 32 bits, since the index is in the driver, in the broadcast and in each task."""
        of = np.concatenate([terms for terms, _ in vectors]) if vectors else np.zeros(0, np.int32)
        places = np.repeat(np.arange(len(vectors), dtype=np.int32), [len(terms) for terms, _ in vectors])
        by_term = np.argsort(of, kind="stable")  # and by place, as they come
        of, docs = of[by_term], places[by_term]
        values = np.concatenate([weights for _, weights in vectors])[by_term] if vectors else np.zeros(0)
        del places, by_term
        self.blocks = -(-len(vectors) // self.block)
        common = np.argsort(-np.bincount(of, minlength=n_terms), kind="stable")[:columns]
        self.column = np.full(n_terms, -1, np.int32)  # of the matrix; -1: the term has a list
        self.column[common] = np.arange(len(common))
        inside = self.column[of] >= 0
        self.matrix = np.zeros((len(common), self.blocks * self.block))
        self.matrix[self.column[of[inside]], docs[inside]] = values[inside]
        of, self.docs, self.values = of[~inside], docs[~inside], values[~inside]
        self._enter(np.searchsorted(of, np.arange(n_terms + 1, dtype=np.int32)))

    def _enter(self, starts: np.ndarray) -> None:
        """A term's postings in one block of examples are one entry: its block, its largest weight, its first posting. The
        lists begin at ``starts``."""
        of = np.repeat(np.arange(len(starts) - 1), np.diff(starts))
        entry = np.flatnonzero(np.diff(of * max(1, self.blocks) + self.docs // self.block, prepend=-1))
        self.entry_block = self.docs[entry] // np.int32(self.block)
        self.entry_most = np.maximum.reduceat(self.values, entry) if len(entry) else np.zeros(0)
        self.entry_at = np.append(entry, len(of)).astype(np.int32)
        self.first_entry = np.searchsorted(of[entry], np.arange(len(starts))).astype(np.int32)

    def __getstate__(self) -> dict:
        """What the entries follow from, and the weights of the matrix, most of which is 0: the bytes stay in each worker."""
        at = np.flatnonzero(self.matrix).astype(np.int32)
        state = {k: v for k, v in vars(self).items() if k not in ("entry_block", "entry_most", "entry_at", "first_entry", "matrix")}
        return state | {"sparse": (self.matrix.shape, at, self.matrix.ravel()[at]), "starts": self.entry_at[self.first_entry]}

    def __setstate__(self, state: dict) -> None:
        shape, at, weights = state.pop("sparse")
        starts = state.pop("starts")
        vars(self).update(state)
        self.matrix = np.zeros(shape)
        self.matrix.ravel()[at] = weights
        self._enter(starts)

    def vector(self, terms: np.ndarray, counts: np.ndarray, unknown: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(terms, weights) of (1 + ln tf) * idf, in a vector whose length is 1 with the words that no example has, of the
        counts ``unknown``."""
        w = (1.0 + np.log(counts)) * self.idf[terms]
        other = (1.0 + np.log(unknown)) * self.rare
        return terms, w / np.sqrt(max(1e-300, w @ w + other @ other))

    def nearest(self, terms: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, cosines) of the k nearest examples with a term in common, ties by place; exact."""
        return self.nearest_of([(terms, weights)])[0]

    def nearest_of(self, vectors: list[tuple[np.ndarray, np.ndarray]], skip: np.ndarray | None = None) -> list[tuple[np.ndarray, np.ndarray]]:
        """``nearest`` of each vector, of TOGETHER at most, without the example at its place in ``skip``.

        The lists are read in the blocks of the highest bounds first, then in all others whose bound reaches the k-th best.
        """
        row = np.repeat(np.arange(len(vectors)), [len(terms) for terms, _ in vectors])
        terms, weights = (np.concatenate(parts) for parts in zip(*vectors, strict=True))
        column = self.column[terms]
        inside, listed = column >= 0, column < 0
        probe = np.zeros((TOGETHER, len(self.matrix)))  # of one shape, so that a text's sums don't depend on its neighbours
        probe[row[inside], column[inside]] = weights[inside]
        scores = (probe @ self.matrix)[: len(vectors)]
        row, terms, weights, out = row[listed], terms[listed], weights[listed], []
        for at in range(0, len(vectors), FEW):  # arrays of lists stay small
            a, b = np.searchsorted(row, (at, at + FEW)).tolist()
            out += self._by_lists(scores[at : at + FEW], row[a:b] - at, terms[a:b], weights[a:b], None if skip is None else skip[at : at + FEW])
        return out

    def _by_lists(self, scores: np.ndarray, row: np.ndarray, terms: np.ndarray, weights: np.ndarray, skip: np.ndarray | None) -> list:
        """``nearest_of`` of rows whose products with the matrix are in ``scores`` and whose other terms are given by row."""
        n, width = scores.shape
        scores = scores.ravel()
        first, sizes = self.first_entry[terms], self.first_entry[terms + 1] - self.first_entry[terms]
        entries, each = _ranges(first, sizes), np.repeat(weights, sizes)
        cell = np.repeat(row * self.blocks, sizes) + self.entry_block[entries]
        bound = scores.reshape(-1, self.block).max(axis=1) + np.bincount(cell, each * self.entry_most[entries], n * self.blocks)
        ahead = min(4, self.blocks)
        lead = np.argpartition(-bound.reshape(n, self.blocks), ahead - 1, axis=1)[:, :ahead] + np.arange(n)[:, None] * self.blocks
        read = np.zeros(len(bound), bool)
        read[lead.ravel()] = True

        def read_lists(cells: np.ndarray) -> None:
            at = np.flatnonzero(cells[cell])
            first, base = self.entry_at[entries[at]], cell[at] // self.blocks * width
            sizes = self.entry_at[entries[at] + 1] - first
            postings = _ranges(first, sizes)
            places = np.repeat(base, sizes) + self.docs[postings]
            scores[:] += np.bincount(places, np.repeat(each[at], sizes) * self.values[postings], len(scores))
            if skip is not None:
                scores[np.arange(n) * width + skip] = 0.0

        read_lists(read)
        best = scores.reshape(-1, self.block)[lead].reshape(n, -1)
        least = np.partition(best, -self.k, axis=1)[:, -self.k] if best.shape[1] >= self.k else np.zeros(n)
        more = (bound.reshape(n, -1) >= least[:, None] - 1e-9).ravel() & (bound > 0) & ~read
        if more.any():
            read_lists(more)
        hit = np.flatnonzero(scores.reshape(n, width) >= np.maximum(1e-12, least - 1e-11)[:, None])
        row, place, cosine = hit // width, hit % width, np.round(scores[hit], 12)
        order = np.lexsort((place, -cosine, row))
        ends = np.searchsorted(row, np.arange(n + 1)).tolist()
        return [(place[own], cosine[own]) for own in (order[a : min(a + self.k, b)] for a, b in zip(ends[:-1], ends[1:], strict=True))]

    def vote(self, places: np.ndarray, cosines: np.ndarray) -> float:
        """Share of toxic votes; an example's vote counts by its nearness and by the rows that it stands for, beside one vote
        of the whole."""
        w = self.weight[places] * cosines / (1.05 - np.minimum(cosines, 1.0))
        return float(((w * self.label[places]).sum() + 0.1 * self.prior) / (w.sum() + 0.1))

    def score(self, texts: list[tuple[np.ndarray, np.ndarray, np.ndarray]], evidence: int = 5) -> list[tuple[float, list[int]]]:
        """(score, ids of the nearest examples) of texts as ``counter`` gives them."""
        out = [(self.blank, [])] * len(texts)
        known = [i for i, (terms, _, _) in enumerate(texts) if len(terms)] if len(self.ids) else []
        sizes = np.cumsum([len(texts[i][0]) for i in known])
        at = 0
        while at < len(known):
            room = int(np.searchsorted(sizes, MOST_TERMS + (sizes[at - 1] if at else 0), side="right")) - at
            some = known[at : at + min(TOGETHER, max(1, room))]
            at += len(some)
            for i, (places, cosines) in zip(some, self.nearest_of([self.vector(*texts[i]) for i in some]), strict=True):
                raw = self.vote(places, cosines)
                out[i] = (float(sigmoid(self.a * logit(np.array(raw)) + self.b)), self.ids[places[:evidence]].tolist())
        return out

    def counter(self):
        """text -> (terms of the index, their counts, counts of the words that no example has)."""
        return term_counter(self.terms)

    def of_text(self, text: str) -> tuple[float, list[int]]:
        return self.score([self.counter()(text)])[0]


def _document_frequencies(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = pickle.loads(shared.value)
        count, often, n = term_counter(terms), np.zeros(len(terms), np.int64), 0
        for batch in batches:
            for text in batch.column(0):
                often[count(text.as_py() or "")[0]] += 1
                n += 1
        seen = np.flatnonzero(often)
        columns = [pa.array(np.append(seen, -1), pa.int32()), pa.array(np.append(often[seen], n), pa.int64())]  # -1: documents
        yield pa.RecordBatch.from_arrays(columns, ["term", "n"])

    return run


def _trained(docs: DataFrame, labels: DataFrame, label: str, per_class: int, k: int, id_col: str, text_col: str):
    """The shared index: examples from the bounded sample, document frequencies of their terms over all documents."""
    rows, totals = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    spark = docs.sparkSession

    def frequencies(terms: dict[str, int]) -> tuple[int, np.ndarray]:
        counted = docs.select(text_col).mapInArrow(_document_frequencies(share(spark, terms)), "term int, n long")
        found = counted.groupBy("term").agg(F.sum("n").alias("n")).toArrow()  # a row per term of the examples at most
        term, n = found.column("term").to_numpy(), found.column("n").to_numpy()
        often = np.zeros(len(terms))
        often[term[term >= 0]] = n[term >= 0]
        return int(n[term < 0].sum()), often

    return share(spark, Examples(rows, totals, k, frequencies=frequencies))


_OUT = "doc_id long, held_out boolean, score double, predicted int, evidence array<long>"


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        examples = pickle.loads(shared.value)
        count = examples.counter()
        for batch in batches:
            found = []
            for at in range(0, len(batch), TOGETHER):
                found += examples.score([count(text.as_py() or "") for text in batch.column("text").slice(at, TOGETHER)])
            scores, evidence = [score for score, _ in found], [nearest for _, nearest in found]
            columns = [batch.column("doc_id"), batch.column("held_out"), pa.array(scores, pa.float64()), pa.array([int(s >= 0.5) for s in scores], pa.int32()), pa.array(evidence, pa.list_(pa.int64()))]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "held_out", "score", "predicted", "evidence"])

    return run


def score_toxicity(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000, k: int = 15, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, held_out, score, predicted, evidence) per row; evidence: ids of the five nearest examples.

    Fitted on at most ``per_class`` labelled rows of each label, none of them held out. NULL and empty texts, and texts
    without a term of the index, get the share of toxic ones among labelled rows without words. Without labelled rows every score is 0.
    Repeated and NULL ids give a row each; an empty table gives no row.
    """
    shared = _trained(docs, labels, label, per_class, k, id_col, text_col)
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), held_out(F.col(id_col)).alias("held_out"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_score(shared), _OUT)


def without_toxic(
    docs: DataFrame, labels: DataFrame, label: str = "toxic", per_class: int = 2000, k: int = 15, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """The documents, all columns kept, without the rows whose own text is predicted toxic.

    Rows of NULL or repeated id are judged as any other; NULL and empty texts stay unless most labelled rows without words
    are toxic. Without labelled rows all stay; an empty table gives no row.
    """
    shared = _trained(docs, labels, label, per_class, k, id_col, text_col)

    def verdicts():
        examples = pickle.loads(shared.value)
        count = examples.counter()
        return lambda texts: [score < 0.5 for score, _ in examples.score([count(text or "") for text in texts])]

    return rows_where(docs, text_col, verdicts, TOGETHER)
