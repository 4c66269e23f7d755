"""Quality rules: fixed base rules and a logistic regression on hashed word and character n-grams.

The regression is fitted on a bounded sample of the labelled rows, its probability calibrated on a part of the sample
that it was not fitted on. Texts are scored whole, in Arrow batches; a text's score is linear in the shares of its
n-grams, so it is the mean weight of its words, word pairs and character triples.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarterglass.llm.chunks import Memo
from quarterglass.llm.common import share
from quarterglass.llm.labelled import class_weights, labelled_sample, platt, sigmoid
from quarterglass.llm.near_dup import byte_hashes

#: Hash slots of each kind of n-gram, and the scale of their shares in the regression.
SLOTS, SCALE = 1 << 16, 20.0
_MIX = np.uint64(0x9E3779B97F4A7C15)


def ngrams(text: bytes, hashes: np.ndarray) -> list[np.ndarray]:
    """Hash slots of the words, pairs of words and triples of code points of a text, one array per kind."""
    shift = np.uint64(48)  # SLOTS slots
    words = (hashes * _MIX) >> shift
    pairs = ((hashes[:-1] * _MIX + hashes[1:]) * _MIX) >> shift
    c = np.frombuffer(text.decode("utf-8", "replace").encode("utf-32-le"), "<u4").astype(np.uint64)
    triples = (((c[:-2] << np.uint64(42)) ^ (c[1:-1] << np.uint64(21)) ^ c[2:]) * _MIX) >> shift if len(c) > 2 else np.zeros(0, np.uint64)
    return [words.astype(np.int64), pairs.astype(np.int64) + SLOTS, triples.astype(np.int64) + 2 * SLOTS]


class Regression:
    """Weights by slot; ``probability`` of label 1 for the n-grams of one text."""

    def __init__(self, rows: list[tuple[int, str, int]], totals: dict[int, int], steps: int = 150, rate: float = 0.5, ridge: float = 1e-6):
        self.weights, self.bias = np.zeros(3 * SLOTS), 0.0
        self.a, self.b = 1.0, 0.0
        y = np.array([label for _, _, label in rows], float)
        n1 = sum(totals.values()) and totals.get(1, 0) / sum(totals.values())
        if len(set(y.tolist())) < 2:
            self.bias = 30.0 if n1 else -30.0 if totals.get(0) else 0.0
            return
        memo = byte_hashes()
        slots, shares, sizes = [], [], []
        for _, text, _ in rows:
            data = text.encode("utf-8", "replace")
            found = [np.unique(g, return_counts=True) for g in ngrams(data, _hashed(data.split(), memo))]
            slots.append(np.concatenate([s for s, _ in found]))
            shares.append(np.concatenate([SCALE * c / max(1, c.sum()) for _, c in found]))
            sizes.append(len(slots[-1]))
        fit = np.arange(len(rows)) % 4 != 0  # the rest calibrates
        w = class_weights(y.astype(int), totals)
        doc = np.repeat(np.arange(len(rows)), sizes)
        slot, value = np.concatenate(slots), np.concatenate(shares)
        used = fit[doc]
        slot_f, value_f, doc_f = slot[used], value[used], doc[used]
        seen, own = np.unique(slot_f, return_inverse=True)
        theta, squares, bias, bias_sq = np.zeros(len(seen)), np.full(len(seen), 1e-8), 0.0, 1e-8
        share_w = np.where(fit, w, 0.0) / w[fit].sum()
        for _ in range(steps):
            z = np.bincount(doc_f, theta[own] * value_f, len(rows)) + bias
            residual = share_w * (sigmoid(z) - y)
            grad = np.bincount(own, residual[doc_f] * value_f, len(seen)) + ridge * theta
            squares += grad * grad
            theta -= rate * grad / np.sqrt(squares)
            bias_sq += residual.sum() ** 2
            bias -= rate * residual.sum() / np.sqrt(bias_sq)
        self.weights[seen], self.bias = theta, float(bias)
        z = np.bincount(doc, self.weights[slot] * value, len(rows)) + self.bias
        self.a, self.b = platt(z[~fit], y[~fit], w[~fit])
        self.weights = self.weights.astype(np.float32)

    def probability(self, kinds: list[np.ndarray]) -> float:
        z = self.bias + sum(SCALE * float(self.weights[k].mean(dtype=np.float64)) for k in kinds if len(k))
        return float(sigmoid(np.array(self.a * z + self.b)))


def _hashed(words: list[bytes], memo: dict[bytes, int]) -> np.ndarray:
    return np.fromiter(map(memo.__getitem__, words), np.uint64, len(words))


def repeated_words(hashes: np.ndarray) -> int:
    """Words that stand in a window of three that the text has twice or more, its first place included."""
    if len(hashes) < 4:
        return 0
    window = (hashes[:-2] * _MIX + hashes[1:-1]) * _MIX + hashes[2:]
    order = np.argsort(window, kind="stable")
    same = window[order[1:]] == window[order[:-1]]
    twice = np.zeros(len(window), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    covered = np.zeros(len(hashes), bool)
    for i in range(3):
        covered[i : i + len(window)] |= twice
    return int(covered.sum())


def base_counts(text: bytes, words: list[bytes], hashes: np.ndarray) -> tuple[int, int, int, int, int]:
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words) of a whole text."""
    joined = b"".join(words)
    lines = [line for line in text.split(b"\n") if line.strip(b" \t\r\v\f")] if b"\n" in text else []
    n_symbols = len(text) - len(text.translate(None, b"#*$%&|<>"))
    return len(words), len(joined.decode("utf-8", "replace")), n_symbols, len(lines) - len(set(lines)), repeated_words(hashes)


_OUT = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, probability double, kept boolean"


def _score(shared, least: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, memo = pickle.loads(shared.value), byte_hashes()
        for batch in batches:
            rows = []
            for text in batch.column(1).cast(pa.binary()):
                data = text.as_py() or b""
                words = data.split()
                hashes = _hashed(words, memo)
                counts = base_counts(data, words, hashes)
                failed = counts[0] < 50 or 100 * counts[4] > 50 * counts[0]
                p = model.probability(ngrams(data, hashes))
                rows.append((*counts, failed, p, not failed and p >= least))
            columns = [pa.array(c) for c in zip(*rows, strict=True)] if rows else []
            if rows:
                yield pa.RecordBatch.from_arrays([batch.column(0), *columns], [f.split()[0] for f in _OUT.split(", ")])

    return run


def score_quality(
    docs: DataFrame, labels: DataFrame, label: str = "quality", per_class: int = 2000, least: float = 0.5, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """(doc_id, five base counts, base_failed, probability, kept) per row.

    ``kept`` is false where the base rules fail (fewer than 50 words, or over half of them in repeated windows), else
    whether the calibrated probability of label 1 is ``least`` or more. NULL and empty texts have no words and fail.
    Fitted on at most ``per_class`` labelled rows of each label; with one label only, its verdict is that label, without
    any it is probability 0.5. Repeated and NULL ids give a row each; an empty table gives no row.
    """
    rows, totals = labelled_sample(docs, labels, label, per_class, id_col, text_col)
    shared = share(docs.sparkSession, Regression(rows, totals))
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return texts.mapInArrow(_score(shared, least), _OUT)
