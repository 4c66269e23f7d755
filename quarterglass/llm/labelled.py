"""Bounded labelled samples to fit models on, and the calibration that both models use."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarterglass.llm.common import uniform


def held_out(doc_id: Column) -> Column:
    """Rows that no model learns labels from: CRC-32 of the id as text, divisible by 5. A NULL id is held out."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(True))


def labelled_sample(
    docs: DataFrame, labels: DataFrame, label: str, per_class: int, id_col: str = "doc_id", text_col: str = "text", seed: int = 3
) -> tuple[list[tuple[int, str, int]], dict[int, int]]:
    """([(id, text, label)], rows per class): at most ``per_class`` documents of label 0 and of label 1, drawn by a hash
    of the id among the labelled ones that are not held out, and how many of each there are.

    Other labels, NULL ids and labels without a document are left out; of several labels of one id the largest counts.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("label").isin(0, 1) & ~held_out(F.col("id"))).groupBy("id").agg(F.max("label").alias("label"))
    totals = {r["label"]: r["n"] for r in known.groupBy("label").agg(F.count("*").alias("n")).collect()}
    order = uniform(seed, F.col("id"))
    drawn = [known.filter(F.col("label") == c).orderBy(order, "id").limit(per_class) for c in (0, 1)]
    ids = F.broadcast(drawn[0].union(drawn[1]))  # 2 * per_class ids at most
    texts = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).alias("text"))
    rows = texts.join(ids, "id").dropDuplicates(["id"]).orderBy("id").collect()
    return [(r.id, r.text or "", r.label) for r in rows], totals


def class_weights(labels: np.ndarray, totals: dict[int, int]) -> np.ndarray:
    """Weights by which a sample stands for all labelled rows, of mean 1."""
    n = np.array([max(1, int((labels == c).sum())) for c in (0, 1)], float)
    per = np.array([totals.get(c, 0) for c in (0, 1)], float) / n
    w = per[labels]
    return w / w.mean() if len(w) and w.mean() > 0 else np.ones(len(labels))


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(z, -35, 35)))


def logit(p: np.ndarray) -> np.ndarray:
    p = np.clip(p, 1e-3, 1 - 1e-3)
    return np.log(p / (1 - p))


def platt(z: np.ndarray, y: np.ndarray, w: np.ndarray, ridge: float = 1e-2, steps: int = 50) -> tuple[float, float]:
    """(a, b) of the calibrated probability sigmoid(a * z + b); (1, 0) where one class is missing."""
    if len(set(y.tolist())) < 2:
        return 1.0, 0.0
    x = np.stack([z, np.ones_like(z)], 1)
    theta = np.array([1.0, 0.0])
    for _ in range(steps):
        p = sigmoid(x @ theta)
        grad = x.T @ (w * (p - y)) + ridge * (theta - [1.0, 0.0])
        hess = (x * (w * p * (1 - p))[:, None]).T @ x + ridge * np.eye(2)
        step = np.linalg.solve(hess, grad)
        theta = theta - step / max(1.0, float(np.abs(step).max()))
        if np.abs(step).max() < 1e-9:
            break
    return (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)
