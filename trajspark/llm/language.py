"""Language ID: sparse multinomial logistic regression on TF-IDF character n-grams.

Hashed 1- to 3-grams of lower-cased code points, sublinear TF, IDF over all training
rows, unit length; follow-the-regularised-leader with an elastic-net penalty, then a
temperature fitted on a part of the sample that the weights were not trained on.
The model is ``DIMS`` x languages numbers, at most ``LANGUAGES`` of them, whatever the corpus.

A text that is null or has no letter is ``und`` with score 0. Rows with a null
language are not learnt from; without any training row all texts are ``und``.
Repeated rows count as often as they occur. Other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm import frames, text

BITS = 15
DIMS = 1 << BITS
#: Languages that are learnt, at most: the most frequent ones, the first by name where equally frequent.
LANGUAGES = 256
#: Labelled rows that the weights are fitted on, at most (about); the IDF counts all rows.
SAMPLE = 8_000
ALPHA, BETA, L1, L2, EPOCHS = 0.5, 1.0, 0.02, 0.01, 2


def counts(texts: pa.Array):
    """For each text in turn its distinct hashed n-grams and how often each occurs."""
    lowered = pc.utf8_lower(pc.fill_null(texts.cast(pa.large_string()), ""))
    for a, b in text.chunks(lowered):
        rows = lowered.slice(a, b - a).to_pylist()
        size = np.array([len(r) for r in rows], np.int64)
        c = text.code_points("".join(rows)).astype(np.uint32)
        # one key for text and n-gram: a sort brings equal ones together, however short the texts
        doc = np.repeat(np.arange(len(rows), dtype=np.uint32) << np.uint32(BITS), size) if len(rows) < 1 << (32 - BITS) else np.repeat(np.arange(len(rows), dtype=np.uint64) << np.uint64(BITS), size)
        gram = (c + np.uint32(1)) * np.uint32(0x9E3779B1)
        keys = [doc + (gram >> np.uint32(32 - BITS))]
        for k in (1, 2):
            if len(c) > k:
                gram = (gram[:-1] ^ (gram[:-1] >> np.uint32(15))) * np.uint32(0x85EBCA77) + c[k:] * np.uint32(0xC2B2AE3D)
                within = doc[:-k] == doc[k:]
                keys.append((doc[:-k] + (gram >> np.uint32(32 - BITS)))[within])
        key = np.sort(np.concatenate(keys))
        first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)
        n = np.diff(np.append(first, len(key)))
        key = key[first]
        index = (key & key.dtype.type(DIMS - 1)).astype(np.int64)
        at = np.searchsorted(key >> key.dtype.type(BITS), np.arange(len(rows) + 1).astype(key.dtype))
        for x, y in zip(at[:-1], at[1:]):
            yield index[x:y], n[x:y]


def vector(index: np.ndarray, n: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(n)) * idf[index]
    return v / max(np.sqrt(v @ v), 1e-12)


def softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def fit_rows(table: pa.Table, idf: np.ndarray, classes: list[str]) -> pa.Table:
    """FTRL over (text, lang); rows (index, weights), the temperature at index -1."""
    number = {c: k for k, c in enumerate(classes)}
    y = np.array([number[c] for c in table.column("lang").to_pylist()])
    xs = [(i, vector(i, n, idf)) for i, n in counts(table.column("text").combine_chunks())]
    # an order that depends on the rows alone
    tag = np.array([text.mix(np.array([int(i.sum()) * 31 + len(i)], np.uint64))[0] for i, _ in xs], np.uint64)
    order = np.lexsort([y, tag])
    held = order[::10] if len(order) >= 50 else order[:0]
    learn = np.setdiff1d(order, held, assume_unique=True)
    learn = learn[np.lexsort([y[learn], tag[learn]])]
    z, g2 = np.zeros((DIMS, len(classes))), np.zeros((DIMS, len(classes)))
    eye = np.eye(len(classes))

    def weights(zi, gi):
        return np.where(np.abs(zi) <= L1, 0.0, (np.sign(zi) * L1 - zi) / ((BETA + np.sqrt(gi)) / ALPHA + L2))

    for _ in range(EPOCHS):
        for k in learn:
            i, v = xs[k]
            zi, gi = z[i], g2[i]
            w = weights(zi, gi)
            g = v[:, None] * (softmax(v @ w) - eye[y[k]])
            more = gi + g * g
            z[i] = zi + g - (np.sqrt(more) - np.sqrt(gi)) / ALPHA * w
            g2[i] = more
    w = weights(z, g2)
    temperature = 1.0
    if len(held):
        logits = np.array([xs[k][1] @ w[xs[k][0]] for k in held])
        grid = np.exp(np.linspace(np.log(0.05), np.log(20), 121))
        loss = [-np.log(np.maximum(softmax(logits / t)[np.arange(len(held)), y[held]], 1e-12)).mean() for t in grid]
        temperature = float(grid[int(np.argmin(loss))])
    used = np.flatnonzero(np.any(w != 0, axis=1))
    rows = [*w[used].tolist(), [temperature] * len(classes)]
    return pa.table({"index": np.append(used, -1).astype(np.int64), "weights": pa.array(rows, pa.list_(pa.float64()))})


def document_frequency(docs: DataFrame) -> tuple[np.ndarray, int]:
    """In how many of all rows of ``docs`` each hashed n-gram occurs, and the number of rows."""

    def run(batches):
        n, rows = np.zeros(DIMS, np.int64), 0
        for b in batches:
            for index, _ in counts(b.column("text")):
                n[index] += 1
                rows += 1
        used = np.flatnonzero(n)
        yield pa.RecordBatch.from_pydict({"index": np.append(used, -1).astype(np.int64), "n": np.append(n[used], rows).astype(np.int64)})

    got = docs.select("text").mapInArrow(run, "index long, n long").groupBy("index").agg(F.sum("n").alias("n")).collect()
    df, rows = np.zeros(DIMS), 0
    for r in got:
        if r["index"] < 0:
            rows = r["n"]
        else:
            df[r["index"]] = r["n"]
    return df, rows


class Model:
    def __init__(self, classes: list[str], idf: np.ndarray, weight: np.ndarray, temperature: float):
        self.classes, self.idf, self.weight, self.temperature = classes, idf, weight, temperature


def fit(docs: DataFrame, sample: int = SAMPLE) -> Model:
    """Learn from ``docs`` (text, lang, and doc_id to sample by)."""
    known = docs.where("lang is not null and text is not null")
    classes = sorted(r[0] for r in known.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(LANGUAGES).collect())
    df, rows = document_frequency(known)
    idf = np.log((1 + rows) / (1 + df)) + 1
    w, temperature = np.zeros((DIMS, max(1, len(classes)))), 1.0
    if classes:
        learnable = known.where(F.col("lang").isin(classes))
        chosen = frames.bounded(learnable.select("doc_id", "text", "lang"), F.col("doc_id"), sample).select("text", "lang")
        for r in frames.trained(chosen, "index long, weights array<double>", lambda t: fit_rows(t, idf, classes)):
            if r["index"] < 0:
                temperature = r["weights"][0]
            else:
                w[r["index"]] = r["weights"]
    return Model(classes, idf, w, temperature)


def predict(docs: DataFrame, model: Model, names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """``docs`` with the likeliest language of each whole text and its calibrated probability."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        m, texts = shared.value, batch.column("text")
        letters = pc.fill_null(pc.match_substring_regex(texts, r"\p{L}"), False).to_pylist()
        lang, score = ["und"] * len(texts), [0.0] * len(texts)
        for k, (index, n) in enumerate(counts(texts)):
            if letters[k] and m.classes:
                p = softmax(vector(index, n, m.idf) @ m.weight[index] / m.temperature)
                best = int(np.argmax(p))
                lang[k], score[k] = m.classes[best], float(p[best])
        return [pa.array(lang, pa.string()), pa.array(score, pa.float64())]

    fields = [T.StructField(frames.fresh(docs, n), k) for n, k in zip(names, (T.StringType(), T.DoubleType()))]
    return frames.appended(docs, fields, run)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = fit(docs.where(frames.remainder("doc_id", 5) != 0).select("doc_id", "text", "lang"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", (frames.remainder("doc_id", 5) == 0).alias("held_out"), "lang_pred", "score")
