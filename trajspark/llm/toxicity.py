"""Toxicity: FTRL-proximal logistic regression over hashed word n-grams and skip-grams.

Per-coordinate learning rates and L1 sparsity leave a few thousand weights, which
are broadcast (at most ``DIMS`` of them, whatever the corpus). Learning uses a
bounded sample of labelled rows (``SAMPLE``); scoring reads every whole text.

Nulls, empty texts: no features, the score is the bias alone. Rows with a null
label are not learnt from. Repeated rows are scored each. An empty training table
gives the score 0.5 of an untrained model. Other columns of the input are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm import frames, text

DIMS = 1 << 20
#: Labelled rows that the classifier is fitted on, at most (about).
SAMPLE = 12_000
#: Word tuples: single words, neighbours, and pairs that skip one or two words.
TUPLES = ((), (1,), (2,), (3,))
ALPHA, BETA, L1, L2, EPOCHS = 1.0, 1.0, 8.0, 0.1, 4
THRESHOLD = 0.3


def features(texts: pa.Array):
    """For each chunk: its first text, number of texts, and distinct (text, index) pairs, sorted."""
    for a, b, w in text.words(texts):
        got = [w.grams(*steps) for steps in TUPLES]
        doc = np.concatenate([d for d, _ in got]).astype(np.uint64)
        index = np.concatenate([h & np.uint64(DIMS - 1) for _, h in got])
        yield a, b - a, doc, index


def fit_rows(table: pa.Table) -> pa.Table:
    """FTRL-proximal over (text, label); rows (index, weight), the bias at index -1."""
    texts = table.column("text").combine_chunks()
    y = np.asarray(table.column("label").to_numpy(), float)
    docs: list[np.ndarray] = [np.zeros(0, np.int64)] * len(y)
    order = np.zeros(len(y), np.uint64)
    for a, n, doc, index in features(texts):
        pair = np.unique((doc << np.uint64(20)) | index)
        cut = np.searchsorted(pair >> np.uint64(20), np.arange(n + 1).astype(np.uint64))
        index = (pair & np.uint64(DIMS - 1)).astype(np.int64)
        for k in range(n):
            docs[a + k] = index[cut[k] : cut[k + 1]]
            order[a + k] = text.mix(np.array([docs[a + k].sum() + 1], np.uint64))[0]
    z, g2, bias, bias_g2 = np.zeros(DIMS), np.zeros(DIMS), 0.0, 0.0
    for _ in range(EPOCHS):
        for i in np.lexsort([y, order]):
            x = docs[i]
            zi, gi = z[x], g2[x]
            rate = (BETA + np.sqrt(gi)) / ALPHA
            w = np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / (rate + L2))
            p = 1 / (1 + np.exp(-np.clip(bias + w.sum(), -35, 35)))
            g = p - y[i]
            sigma = (np.sqrt(gi + g * g) - np.sqrt(gi)) / ALPHA
            z[x] = zi + g - sigma * w
            g2[x] = gi + g * g
            bias_g2 += g * g
            bias -= ALPHA * g / (BETA + np.sqrt(bias_g2))
    w = np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(g2)) / ALPHA + L2))
    index = np.flatnonzero(w)
    return pa.table({"index": np.append(index, -1).astype(np.int64), "weight": np.append(w[index], bias)})


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> tuple[np.ndarray, np.ndarray, float]:
    """Weights of a model learnt from ``docs`` (doc_id, text) and ``labels`` (doc_id, label): indices, weights, bias."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = frames.bounded(known, F.col("doc_id"), sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("double").alias("label"))
    got = frames.trained(rows, "index long, weight double", fit_rows)
    bias = next((r["weight"] for r in got if r["index"] < 0), 0.0)
    kept = sorted((r["index"], r["weight"]) for r in got if r["index"] >= 0)
    return np.array([i for i, _ in kept], np.int64), np.array([w for _, w in kept], float), bias


def score_texts(texts: pa.Array, index: np.ndarray, weight: np.ndarray, bias: float) -> np.ndarray:
    dense = np.zeros(DIMS)
    dense[index] = weight
    total = np.full(len(texts), bias)
    for a, n, doc, at in features(texts):
        hit = dense[at.astype(np.int64)] != 0
        pair = np.unique((doc[hit] << np.uint64(20)) | at[hit])
        total[a : a + n] += np.bincount((pair >> np.uint64(20)).astype(np.int64), dense[(pair & np.uint64(DIMS - 1)).astype(np.int64)], n)
    return 1 / (1 + np.exp(-np.clip(total, -35, 35)))


def score(docs: DataFrame, model: tuple[np.ndarray, np.ndarray, float], name: str = "toxicity") -> DataFrame:
    """``docs`` with a column ``name``, the probability that the text is toxic."""
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return frames.appended(docs, [T.StructField(frames.fresh(docs, name), T.DoubleType())], lambda b: [pa.array(score_texts(b.column("text"), *shared.value))])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("toxic").alias("label"))
    model = fit(docs, labels.where(frames.remainder("doc_id", 4) != 2))
    return (
        score(docs, model, "score")
        .select("doc_id", (frames.remainder("doc_id", 4) == 2).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    )
