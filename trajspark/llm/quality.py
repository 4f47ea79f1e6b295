"""Quality classifier: a sparse rule ensemble over text statistics.

Small regression trees are boosted on a bounded labelled sample; every path to a node
becomes a conjunctive rule; a lasso logistic regression keeps few rules, and these
are compiled into one Spark column expression over the statistics, so the classifier
runs inside generated code. The statistics come from whole texts, batch by batch.

Null and empty texts have all statistics 0 and get a score like any other. Rows with
a null label are not learnt from; without any training row the score is 0.5.
Repeated rows are scored each; other columns pass through.
"""

from __future__ import annotations

import json

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from trajspark.llm import frames, text

#: Labelled rows that the rules are fitted on, at most (about).
SAMPLE = 10_000
TREES, DEPTH, BINS, LEAF, RATE, LASSO, STEPS = 12, 3, 24, 20, 0.4, 2e-3, 400
THRESHOLD = 0.3
STATS = (
    "n_chars", "n_words", "mean_word", "distinct_words", "top_word", "repeated_next", "distinct_grams", "upper", "digit",
    "symbol", "loud", "pipe", "stop", "comma", "newline", "distinct_lines", "mean_line",
)

_CLASS = {"upper": range(65, 91), "digit": range(48, 58), "symbol": b"#$%&*@^~<>{}[]\\/=+_", "loud": b"!?", "pipe": b"|", "stop": b".", "comma": b",;:", "newline": b"\n", "lower": range(97, 123)}
_LOOKUP = {k: np.isin(np.arange(256), list(v)) for k, v in _CLASS.items()}


def _per_text(at: np.ndarray, values: np.ndarray) -> np.ndarray:
    total = np.zeros(len(values) + 1, np.int64)
    np.cumsum(values, out=total[1:])
    return total[at[1:]] - total[at[:-1]]


def _distinct(doc: np.ndarray, h: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct hashes of each text and the largest count of one."""
    order = np.lexsort([h, doc])
    d, v = doc[order], h[order]
    first = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (v[1:] != v[:-1])])) if len(d) else np.zeros(0, np.int64)
    top = np.zeros(n)
    np.maximum.at(top, d[first], np.diff(np.append(first, len(d))))
    return np.bincount(d[first], minlength=n), top


def statistics(texts: pa.Array) -> np.ndarray:
    """One row of STATS for each text."""
    out = np.zeros((len(texts), len(STATS)))
    for a, b in text.chunks(texts):
        raw, at = text.flat(texts.slice(a, b - a))
        w, n = text.Words(raw, at), b - a
        size = np.maximum(np.diff(at), 1)
        words = np.diff(w.at)
        few = np.maximum(words, 1)
        distinct, top = _distinct(w.doc, w.hash, n)
        gram_doc, gram = w.grams(1, 2)
        grams, _ = _distinct(gram_doc, gram, n)
        same = w.doc[:-1] == w.doc[1:]
        again = np.bincount(w.doc[:-1][same & (w.hash[:-1] == w.hash[1:])], minlength=n)
        count = {k: _per_text(at, lookup[raw]) for k, lookup in _LOOKUP.items()}
        letters = np.maximum(count["upper"] + count["lower"], 1)
        lines = text_lines(raw, at)
        line_kinds, _ = _distinct(*lines, n)
        n_lines = np.maximum(np.bincount(lines[0], minlength=n), 1)
        length = np.bincount(w.doc, w.end - w.start, n)
        out[a:b] = np.stack([
            _per_text(at, (raw & 0xC0) != 0x80), words, length / few, distinct / few, top / few, again / few, grams / np.maximum(np.bincount(gram_doc, minlength=n), 1),
            count["upper"] / letters, count["digit"] / size, count["symbol"] / size, count["loud"] / size, count["pipe"] / size, count["stop"] / few, count["comma"] / few,
            count["newline"] / few, line_kinds / n_lines, words / n_lines,
        ], 1)
    return out


def text_lines(raw: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(text, hash) of each non-empty line."""
    cut = np.flatnonzero(raw == 10)
    edge = np.unique(np.concatenate([at, cut, cut + 1]))
    start, end = edge[:-1], edge[1:]
    keep = raw[start] != 10 if len(start) else np.zeros(0, bool)
    start, end = start[keep], end[keep]
    power, back = text._powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[: len(raw)], out=sums[1:])
    h = text.mix((sums[end] - sums[start]) * back[start] + (end - start).astype(np.uint64))
    return np.searchsorted(at, start, "right") - 1, h


# Rules -------------------------------------------------------------------------------


def _split(binned: np.ndarray, rest: np.ndarray, rows: np.ndarray, bins: list[int]) -> tuple[float, int, int]:
    """The split (gain, feature, bin) of ``rows`` that lowers the squared error of ``rest`` most."""
    best, total, n = (0.0, -1, -1), rest[rows].sum(), len(rows)
    for f, size in enumerate(bins):
        count = np.cumsum(np.bincount(binned[rows, f], minlength=size))[:-1]
        part = np.cumsum(np.bincount(binned[rows, f], rest[rows], size))[:-1]
        ok = (count >= LEAF) & (n - count >= LEAF)
        if ok.any():
            gain = np.where(ok, part**2 / np.maximum(count, 1) + (total - part) ** 2 / np.maximum(n - count, 1) - total**2 / n, 0)
            k = int(np.argmax(gain))
            if gain[k] > best[0] + 1e-9:
                best = float(gain[k]), f, k
    return best


def tree_paths(x: np.ndarray, y: np.ndarray) -> list[tuple[tuple[int, bool, float], ...]]:
    """Boosted trees; each path from the root is a tuple of (statistic, above?, threshold)."""
    edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) for f in range(x.shape[1])]
    binned = np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(edges)], 1)
    bins = [len(e) + 1 for e in edges]
    margin, rules = np.full(len(y), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))), {}
    for _ in range(TREES):
        p = 1 / (1 + np.exp(-margin))
        rest, todo = y - p, [((), np.arange(len(y)))]
        while todo:
            path, rows = todo.pop()
            if path:
                rules[path] = None
            gain, f, k = _split(binned, rest, rows, bins) if len(path) < DEPTH and len(rows) >= 2 * LEAF else (0.0, -1, -1)
            if f < 0:
                margin[rows] += RATE * rest[rows].sum() / max((p[rows] * (1 - p[rows])).sum(), 1e-3)
                continue
            left = binned[rows, f] <= k
            cut = float(edges[f][k])
            todo += [((*path, (f, True, cut)), rows[~left]), ((*path, (f, False, cut)), rows[left])]
    return list(rules)


def holds(rule, x: np.ndarray) -> np.ndarray:
    ok = np.ones(len(x), bool)
    for f, above, cut in rule:
        ok &= (x[:, f] > cut) == above
    return ok


def fit_rows(x: np.ndarray, y: np.ndarray) -> dict:
    """Lasso logistic regression over the rules, by accelerated proximal gradient."""
    order = np.lexsort([*x.T, y])
    x, y = x[order], y[order]
    if not len(y) or y.min() == y.max():
        p = (y.sum() + 0.5) / (len(y) + 1)
        return {"bias": float(np.log(p / (1 - p))), "rules": []}
    rules = tree_paths(x, y)
    r = np.stack([holds(rule, x) for rule in rules], 1).astype(float) if rules else np.zeros((len(y), 0))
    mean, scale = r.mean(0), np.maximum(r.std(0), 1e-6)
    r = (r - mean) / scale
    step = 4 * len(y) / max(1e-9, np.linalg.norm(r, 2) ** 2 + len(y))
    w = v = np.zeros(r.shape[1])
    bias = bias_v = float(np.log(y.mean() / (1 - y.mean())))
    t = 1.0
    for _ in range(STEPS):
        g = 1 / (1 + np.exp(-(r @ v + bias_v))) - y
        new = v - step * (r.T @ g) / len(y)
        new = np.sign(new) * np.maximum(np.abs(new) - step * LASSO, 0)
        new_bias = bias_v - step * g.mean()
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        v, bias_v = new + (t - 1) / t_new * (new - w), new_bias + (t - 1) / t_new * (new_bias - bias)
        w, bias, t = new, new_bias, t_new
    kept = np.flatnonzero(w)
    return {"bias": float(bias - (w * mean / scale).sum()), "rules": [[float(w[k] / scale[k]), rules[k]] for k in kept]}


def compiled(model: dict, stats: str) -> Column:
    """The probability of good quality as a column over the struct ``stats``."""
    total = F.lit(model["bias"])
    for weight, rule in model["rules"]:
        conds = [(F.col(f"`{stats}`.{STATS[f]}") > cut) if above else (F.col(f"`{stats}`.{STATS[f]}") <= cut) for f, above, cut in rule]
        both = conds[0]
        for c in conds[1:]:
            both = both & c
        total = total + F.when(both, F.lit(weight)).otherwise(F.lit(0.0))
    return 1 / (1 + F.exp(-total))


def with_statistics(docs: DataFrame, name: str, column: str = "text") -> DataFrame:
    """``docs`` with the struct ``name`` of the statistics of each whole text."""
    kind = T.StructType([T.StructField(s, T.DoubleType()) for s in STATS])

    def run(batch: pa.RecordBatch) -> list[pa.Array]:
        s = statistics(batch.column(column))
        return [pa.StructArray.from_arrays([pa.array(s[:, k]) for k in range(len(STATS))], list(STATS))]

    return frames.appended(docs, [T.StructField(name, kind)], run, column)


def fit(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> dict:
    """Rules learnt from ``docs`` (doc_id, text) and ``labels`` (doc_id, label)."""
    known = labels.where("doc_id is not null and label is not null").groupBy("doc_id").agg(F.max("label").alias("label"))
    chosen = frames.bounded(known, F.col("doc_id"), sample)
    rows = docs.select("doc_id", "text").join(F.broadcast(chosen), "doc_id").select("text", F.col("label").cast("double").alias("label"))
    stats = with_statistics(rows, "stats").select("label", *(F.col("stats")[s].alias(s) for s in STATS))

    def train(t: pa.Table) -> pa.Table:
        x = np.stack([t.column(s).to_numpy() for s in STATS], 1)
        return pa.table({"model": [json.dumps(fit_rows(x, t.column("label").to_numpy()))]})

    got = frames.trained(stats, "model string", train)
    return json.loads(got[0]["model"]) if got else {"bias": 0.0, "rules": []}


def score(docs: DataFrame, model: dict, name: str = "quality", keep: list[str] | None = None) -> DataFrame:
    """``docs`` (the columns ``keep``) with a column ``name``, the probability of good quality."""
    keep = docs.columns if keep is None else keep
    stats = frames.fresh(docs, "_statistics")
    out = with_statistics(docs, stats)
    return out.select(*(F.col(f"`{c}`") for c in keep), compiled(model, stats).alias(frames.fresh(docs, name)))


def good(docs: DataFrame, model: dict, threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs``, all columns, that the classifier doesn't reject."""
    name = frames.fresh(docs, "_quality")
    return score(docs, model, name).where(F.col(name) >= threshold).drop(name)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = fit(docs, labels.where(frames.remainder("doc_id", 5) != 0))
    return (
        score(docs, model, "score", ["doc_id"])
        .select("doc_id", (frames.remainder("doc_id", 5) == 0).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
    )
