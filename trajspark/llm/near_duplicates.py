"""MinHash near-dedup: ProbMinHash signatures, banding, exact verification, classes.

Signature: the shingles of a text arrive in Poisson processes whose rate is their
weight; each arrival falls into one of the registers and the first one there wins. A
text stops when no later arrival can win any register, so its cost is about shingles
plus registers, not their product. Two signatures agree in a register with the
probability Jaccard similarity of the weighted sets. Shingles weigh as often as they
occur (``weighting="count"``) or 1 each (``"set"``), where it is the plain Jaccard
similarity. Verification computes the same similarity exactly, so it decides.

Equal weighted sets collapse to one node by a 128-bit hash before anything is paired,
so thousands of copies cost one row each. Nodes that share a band are candidates: in a
bucket of up to ``ALL_PAIRS`` nodes every pair, in a larger one each node with the
``HUBS`` members that share most buckets (of a text and its edited copies the text
itself). Every candidate is verified on whole sets, similarity ``THRESHOLD`` or more.
Classes are the connected components of the links, found by hooking and pointer
jumping over written tables. Where a larger bucket still holds several components, all
its pairs across them are compared, block by block; pairs within one component cannot
change it. So the classes are those of all pairs that share a band; with 20 bands of 4 a
pair at 0.8 shares none with probability 3e-5. Blocks bound a task, not the sum: members
of one bucket that are not near copies of each other cost the square of their number.

Joins on a bucket, a hub or a component's label are salted (``SALTS``, ``FAN``), so a
bucket or class that holds a third of all texts is spread over tasks. Rows of equal
texts are looked up by their key, a join of narrow rows that Spark splits if skewed.

Null, empty and blank texts are classes of their own; other texts without words are
classed by equal text. Texts of one to four words make one shingle of them all. Rows
that share a doc_id are one document. Ids are integers, or else taken as strings. Rows
without id take part under a number made from their set, which names a class only if
all its rows lack ids. Other columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trajspark.llm import frames, text

WORDS, THRESHOLD = 5, 0.8
BANDS, ROWS = 20, 4
ALL_PAIRS, HUBS = 12, 4
#: Parts that the rows of one bucket or label are dealt into, and pairs of one node that meet its set in one task.
SALTS, FAN = 16, 512
#: Members of a block and their shingles, about, and the shingles that are counted at once.
BLOCK, BLOCK_SHINGLES, STRIPE = 256, 500_000, 4096
#: Candidate ids (8 bytes) that may be broadcast to pick their texts in the scan; beyond it the texts that pass a
#: Bloom filter of 2 ** BLOOM bits (16 MB, however many ids) are joined by a shuffle.
BROADCAST_IDS, BLOOM = 1_000_000, 27


# Weighted sets -----------------------------------------------------------------------


def shingle_sets(texts: pa.Array, k: int = WORDS, weighting: str = "count") -> Iterator[tuple[int, int, np.ndarray, np.ndarray, np.ndarray]]:
    """For each chunk: first text, number of texts, and per distinct shingle its text, hash and weight, sorted."""
    for a, b, w in text.words(texts):
        doc, h = w.shingles(k)
        order = np.lexsort([h, doc])
        doc, h = doc[order], h[order]
        first = np.flatnonzero(np.concatenate([[True], (doc[1:] != doc[:-1]) | (h[1:] != h[:-1])])) if len(h) else np.zeros(0, np.int64)
        count = np.diff(np.append(first, len(h))) if weighting == "count" else np.ones(len(first), np.int64)
        yield a, b - a, doc[first], h[first], count


def _packed(h: np.ndarray, weight: np.ndarray, cut: np.ndarray) -> tuple[pa.Array, pa.Array]:
    """The hashes and the weights of each set as bytes; no weights where all are 1."""
    slices = list(zip(cut[:-1], cut[1:]))
    times = weight.astype(np.uint32)
    return pa.array([h[x:y].tobytes() for x, y in slices], pa.binary()), pa.array([times[x:y].tobytes() if (times[x:y] > 1).any() else b"" for x, y in slices], pa.binary())


def unpacked(hashes: pa.Scalar, times: pa.Scalar) -> tuple[np.ndarray, np.ndarray | None]:
    """Sorted hashes of a set and their weights (None: all 1)."""
    h, w = np.frombuffer(hashes.as_buffer(), np.uint64), np.frombuffer(times.as_buffer(), np.uint32)
    return h, w.astype(float) if len(w) else None


def likeness(x: tuple[np.ndarray, np.ndarray | None], y: tuple[np.ndarray, np.ndarray | None]) -> float:
    """Probability Jaccard similarity: over common shingles i the sum of 1 / sum_j max(x_j / x_i, y_j / y_i)."""
    (hx, wx), (hy, wy) = x, y
    if wx is None and wy is None:
        both = np.sort(np.concatenate([hx, hy]), kind="stable")
        common = int((both[1:] == both[:-1]).sum())
        return common / max(1, len(hx) + len(hy) - common)
    _, i, j = np.intersect1d(hx, hy, assume_unique=True, return_indices=True)
    if not len(i):
        return 0.0
    wx, wy = np.ones(len(hx)) if wx is None else wx, np.ones(len(hy)) if wy is None else wy
    cx, cy = wx[i], wy[j]
    ratio = cx / cy
    order = np.argsort(ratio, kind="stable")
    cx, cy, ratio = cx[order], cy[order], ratio[order]
    only_x, only_y = wx.sum() - cx.sum(), wy.sum() - cy.sum()
    # at ratio r the larger of x_j and r y_j is x_j where x_j / y_j >= r
    below = np.searchsorted(ratio, ratio, "left")
    sum_x, sum_y = np.concatenate([[0.0], np.cumsum(cx)]), np.concatenate([[0.0], np.cumsum(cy)])
    return float((cx / (only_x + ratio * only_y + (sum_x[-1] - sum_x[below]) + ratio * sum_y[below])).sum())


def prob_minhash(doc: np.ndarray, h: np.ndarray, weight: np.ndarray, n: int, m: int) -> np.ndarray:
    """The winning shingle of each of m registers of n texts (0 in texts without any)."""
    best, who = np.full(n * m, np.inf), np.zeros(n * m, np.uint64)
    at, step = np.zeros(len(h)), 0
    base = doc.astype(np.int64) * m
    while len(h):
        step += 1
        r = text.mix(h * np.uint64(0x9E3779B97F4A7C15) + np.uint64(step))
        at = at - np.log(((r >> np.uint64(11)).astype(float) + 0.5) * 2.0**-53) / weight
        slot = base + (text.mix(r + np.uint64(0xC2B2AE3D27D4EB4F)) % np.uint64(m)).astype(np.int64)
        np.minimum.at(best, slot, at)
        won = best[slot] == at
        who[slot[won]] = h[won]
        live = at < best.reshape(n, m).max(1)[doc]
        doc, h, weight, at, base = doc[live], h[live], weight[live], at[live], base[live]
    return who.reshape(n, m)


def _set_keys(h: np.ndarray, weight: np.ndarray, cut: np.ndarray) -> list[np.ndarray]:
    """Two hashes of each weighted set."""
    keys = []
    for seed in (0x2545F4914F6CDD1D, 0xD1342543DE82EF95):
        total = np.zeros(len(h) + 1, np.uint64)
        np.cumsum(text.mix(h + np.uint64(seed) + weight.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), out=total[1:])
        keys.append(text.mix(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(np.uint64)))
    return keys


def _id(docs: DataFrame) -> Column:
    kind = docs.schema["doc_id"].dataType
    return F.col("doc_id").cast("long" if isinstance(kind, T.IntegralType) else "string")


def signatures(docs: DataFrame, k: int = WORDS, bands: int = BANDS, rows: int = ROWS, weighting: str = "count") -> DataFrame:
    """(doc_id, k1, k2, n, total, b0..., set, times) of each row.

    k1 and k2 hash the weighted set, n is its size and total its weight, b0... are the band
    hashes; rows without id bring their set along. n is 0 for a text without words, and
    total too if it is blank.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids, texts = batch.column(0), batch.column(1)
            for a, n, doc, h, weight in shingle_sets(texts, k, weighting):
                who = prob_minhash(doc, h, weight.astype(float), n, bands * rows)
                size = np.bincount(doc, minlength=n)
                cut = np.concatenate([[0], np.cumsum(size)])
                keys, total = _set_keys(h, weight, cut), np.bincount(doc, weight, n).astype(np.int64)
                for i in np.flatnonzero(size == 0):
                    value = texts[a + int(i)].as_py()
                    if value and not value.isspace():
                        total[i] = 1
                        for key, half in zip(keys, np.frombuffer(hashlib.blake2b(value.encode("utf-8", "surrogatepass"), digest_size=16).digest(), np.uint64)):
                            key[i] = half
                out = []
                for j in range(bands):
                    v = np.full(n, j + 1, np.uint64)
                    for i in range(rows):
                        v = text.mix(v * np.uint64(0x9E3779B97F4A7C15) + who[:, j * rows + i])
                    out.append(v)
                named = ids.slice(a, n)
                sets, times = _packed(h, weight, cut) if named.null_count else (pa.nulls(n, pa.binary()),) * 2
                keep = named.is_null()
                columns = [pa.array(c.view(np.int64)) for c in (*keys, size.astype(np.int64), total, *out)]
                columns += [pc.if_else(keep, c, pa.scalar(None, pa.binary())) for c in (sets, times)]
                yield pa.RecordBatch.from_arrays([named, *columns], names=["doc_id", "k1", "k2", "n", "total", *(f"b{j}" for j in range(bands)), "set", "times"])

    rows_in = docs.select(_id(docs).alias("doc_id"), "text")
    schema = f"doc_id {rows_in.schema['doc_id'].dataType.simpleString()}, k1 long, k2 long, n long, total long, " + "".join(f"b{j} long, " for j in range(bands)) + "set binary, times binary"
    return frames.lean(rows_in).mapInArrow(run, schema)


def maybe_in(ids: DataFrame) -> Callable[[Column], Column]:
    """A condition that every id of ``ids`` (one column) meets and few others do: a Bloom filter of fixed size.

    By computation 28 % of other ids pass at 50 million ids, 60 % at 100 million: an exact join must follow.
    """

    def places(c: Column) -> list[Column]:
        return [F.shiftrightunsigned(F.xxhash64(c, F.lit(seed)), 64 - BLOOM) for seed in (1, 2)]

    at = ids.select(F.explode(F.array(*places(F.col(ids.columns[0])))).alias("at"))
    filled = at.groupBy(F.shiftright("at", 6).alias("word")).agg(F.expr("bit_or(shiftleft(1L, cast(at & 63 as int)))").alias("bits")).toArrow()
    words = np.zeros(1 << (BLOOM - 6), np.int64)
    words[filled.column("word").to_numpy()] = filled.column("bits").to_numpy()
    held = ids.sparkSession.sparkContext.broadcast(words)

    @F.pandas_udf("boolean")
    def known(x: pd.Series, y: pd.Series) -> pd.Series:
        bits = [held.value[p >> 6] >> (p & 63) & 1 for p in (x.to_numpy(), y.to_numpy())]
        return pd.Series((bits[0] & bits[1]).astype(bool))

    return lambda c: known(*places(c))


def sets_of(docs: DataFrame, nodes: DataFrame, k: int, weighting: str) -> DataFrame:
    """(node, set, times) of the documents whose id is in ``nodes``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, n, doc, h, weight in shingle_sets(batch.column(1), k, weighting):
                sets, times = _packed(h, weight, np.searchsorted(doc, np.arange(n + 1)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, n), sets, times], names=["node", "set", "times"])

    rows = docs.select(_id(docs).alias("node"), "text")
    if nodes.count() <= BROADCAST_IDS:
        rows = rows.join(F.broadcast(nodes), "node", "left_semi")
    else:
        rows = frames.lean(rows).where(maybe_in(nodes)(F.col("node"))).join(nodes.hint("merge"), "node", "left_semi")
    kind = rows.schema["node"].dataType.simpleString()
    return frames.lean(rows).mapInArrow(run, f"node {kind}, set binary, times binary").where(F.octet_length("set") > 0)


# Candidates and links ----------------------------------------------------------------


def spread(left: DataFrame, right: DataFrame, key: str, by: str, how: str = "inner") -> DataFrame:
    """``left`` joined to ``right``, which has a row per ``key``: the rows of one key are dealt over tasks by ``by``."""
    salt = F.pmod(F.xxhash64(by), F.lit(SALTS))
    # a size that Spark knows before the copies are made would let it broadcast many times as much
    copies = right.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long")))).hint("merge")
    return left.withColumn("salt", salt).join(copies, [key, "salt"], how).drop("salt")


def _possible(a: str, b: str, threshold: float) -> Column:
    """Whether sizes leave two sets a chance; they say nothing of sets with weights."""
    na, nb = F.col(f"{a}.n"), F.col(f"{b}.n")
    plain = (F.col(f"{a}.total") == na) & (F.col(f"{b}.total") == nb)
    return ~plain | (F.least(na, nb) >= threshold * F.greatest(na, nb))


def candidates(members: DataFrame, threshold: float) -> DataFrame:
    """Distinct pairs (a, b) of nodes from ``members`` (node, v, size, score, n, total) of buckets v."""
    one = F.struct("node", "n", "total")
    few, many = members.where(F.col("size") <= ALL_PAIRS), members.where(F.col("size") > ALL_PAIRS)
    pairs = few.select("v", one.alias("x")).join(few.select("v", one.alias("y")), "v").where("x.node < y.node")
    # the best of each part of a bucket, then the best of these
    parted = many.select("v", "score", one.alias("x"), F.pmod(F.xxhash64("node"), F.lit(SALTS)).alias("salt"))
    best = parted
    for keys in (["v", "salt"], ["v"]):
        w = Window.partitionBy(*keys).orderBy(F.desc("score"), "x.node")
        best = best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= HUBS).drop("place")
    hubs = best.groupBy("v").agg(F.collect_list("x").alias("hubs"))
    stars = spread(many.select("v", "node", one.alias("x")), hubs, "v", "node").select("x", F.explode("hubs").alias("y")).where("x.node <> y.node")
    both = pairs.select("x", "y").unionByName(stars).where(_possible("x", "y", threshold))
    return both.select(F.least("x.node", "y.node").alias("a"), F.greatest("x.node", "y.node").alias("b")).distinct()


def _fanned(pairs: DataFrame, sets: DataFrame, load: DataFrame, side: str, other: str) -> DataFrame:
    """``pairs`` with the set of one side; a node with many pairs, by ``load`` (node, copies), meets them in several tasks."""
    load = load.withColumnRenamed("node", side)
    copies = F.coalesce("copies", F.lit(1).cast("long"))
    dealt = pairs.join(load, side, "left").withColumn("salt", F.pmod(F.xxhash64(other), copies)).drop("copies")
    own = sets.select(F.col("node").alias(side), F.struct("set", "times").alias(f"set_{side}")).join(load, side, "left")
    return dealt.join(own.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), copies - 1))).drop("copies"), [side, "salt"]).drop("salt")


def verified(pairs: DataFrame, sets: DataFrame, threshold: float) -> DataFrame:
    """The ``pairs`` whose weighted sets have at least the similarity ``threshold``."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x, y = ((c.field("set"), c.field("times")) for c in (batch.column(2), batch.column(3)))
            keep = [likeness(unpacked(x[0][i], x[1][i]), unpacked(y[0][i], y[1][i])) >= threshold - 1e-12 for i in range(batch.num_rows)]
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], names=["a", "b"])

    load = pairs.select(F.explode(F.array("a", "b")).alias("node")).groupBy("node").agg(F.ceil(F.count("*") / FAN).alias("copies")).where("copies > 1")
    load = frames.written(load, "load")
    load = F.broadcast(load) if load.count() <= BROADCAST_IDS else load
    both = _fanned(_fanned(pairs, sets, load, "a", "b"), sets, load, "b", "a").select("a", "b", "set_a", "set_b")
    kind = pairs.schema["a"].dataType.simpleString()
    return frames.lean(both).mapInArrow(run, f"a {kind}, b {kind}").distinct()


def components(links: DataFrame) -> DataFrame:
    """(node, label): the smallest node of the connected component, for every node of ``links`` (a, b)."""
    edges = frames.written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))), "edges")
    labels = frames.written(edges.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("label")), "labels")
    while True:
        near = spread(edges, labels.withColumnRenamed("node", "b"), "b", "a").groupBy("a").agg(F.min("label").alias("m"))
        seen = labels.join(near.withColumnRenamed("a", "node"), "node")
        hooked = seen.select("node", F.least("label", "m").alias("label"), F.col("label").alias("was"))
        hooked = hooked.unionByName(seen.select(F.col("label").alias("node"), F.col("m").alias("label")), allowMissingColumns=True)
        hooked = hooked.groupBy("node").agg(F.min("label").alias("label"), F.max("was").alias("was"))
        up = hooked.select(F.col("node").alias("label"), F.col("label").alias("up"))
        jumped = frames.written(hooked.join(up, "label", "left").select("node", F.least("label", F.coalesce("up", "label")).alias("label"), "was"), "labels")
        frames.discard(labels)
        labels = jumped
        if labels.where("label <> was").isEmpty():
            frames.discard(edges)
            return labels.drop("was")


# Large buckets -----------------------------------------------------------------------


def overlaps(xs: list[tuple[np.ndarray, np.ndarray | None]], ys: list[tuple[np.ndarray, np.ndarray | None]]) -> tuple[np.ndarray, np.ndarray]:
    """The weight that each set of ``xs`` has in common with each of ``ys``: by its own weights, by the other's."""
    hx, hy = (np.concatenate([h for h, _ in sets]) for sets in (xs, ys))
    both = np.intersect1d(hx, hy)
    out = np.zeros((2, len(xs), len(ys)))
    plain = all(w is None for sets in (xs, ys) for _, w in sets)
    sides = []
    for sets, h in ((xs, hx), (ys, hy)):
        place = np.minimum(np.searchsorted(both, h), max(0, len(both) - 1))
        known = both[place] == h if len(both) else np.zeros(len(h), bool)
        row = np.repeat(np.arange(len(sets)), [len(s) for s, _ in sets])[known]
        weight = np.concatenate([np.ones(len(s)) if w is None else w for s, w in sets])[known]
        order = np.argsort(place[known], kind="stable")
        sides.append((len(sets), row[order], place[known][order], weight[order]))
    for a in range(0, len(both), STRIPE):
        there, heavy = [], []
        for n, row, place, weight in sides:
            i, j = np.searchsorted(place, [a, a + STRIPE])
            for fill, into in ((1, there), (weight[i:j], heavy)):
                into.append(np.zeros((n, min(STRIPE, len(both) - a)), np.float32))
                into[-1][row[i:j], place[i:j] - a] = fill
        out[0] += heavy[0] @ there[1].T
        if not plain:
            out[1] += there[0] @ heavy[1].T
    return out[0], out[0] if plain else out[1]


def _joined(a: np.ndarray, b: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each component of n numbers under the links a - b."""
    root, was = np.arange(n), None
    while was is None or (root != was).any():
        was, low = root.copy(), np.minimum(root[a], root[b])
        np.minimum.at(root, a, low)
        np.minimum.at(root, b, low)
        root = root[root]
    return root


def across(members: DataFrame, labels: DataFrame, nodes: DataFrame, sets: DataFrame, threshold: float, bands: int) -> DataFrame:
    """Pairs (a, b) of labels to join: all pairs in large buckets whose labels differ are compared.

    A bucket's most frequent label is its main one. Blocks of the other members meet each
    other and the blocks of the main label; a pair is compared in its first common band.
    """
    kind = labels.schema["label"].dataType.simpleString()
    out_type = pa.string() if kind == "string" else pa.int64()

    def run(rows: pa.Table) -> pa.Table:
        column = lambda name: rows.column(name).to_numpy()
        names, label = np.unique(column("label"), return_inverse=True)
        n, total, own, p, q = column("n"), column("total"), column("block"), column("p")[0], column("q")[0]
        held = rows.column("bands").combine_chunks().flatten().to_numpy().reshape(-1, bands)
        place = int(np.flatnonzero(held[0] == column("v")[0])[0])
        x, y = np.flatnonzero(own == p), np.flatnonzero(own == q)
        plain = (total == n)[x][:, None] & (total == n)[y]
        open_ = (label[x][:, None] != label[y]) & (~plain | (np.minimum(n[x][:, None], n[y]) >= threshold * np.maximum(n[x][:, None], n[y])))
        if p == q:
            open_ = np.triu(open_)
        for i in range(place):
            open_ &= held[x, i][:, None] != held[y, i]
        keep_x, keep_y = open_.any(1), open_.any(0)
        x, y, open_, plain = x[keep_x], y[keep_y], open_[keep_x][:, keep_y], plain[keep_x][:, keep_y]
        root = np.arange(len(names))
        if len(x):
            packed, times = rows.column("set").combine_chunks(), rows.column("times").combine_chunks()
            sides = [[unpacked(packed[int(i)], times[int(i)]) for i in side] for side in (x, y)]
            by_x, by_y = overlaps(*sides)
            # plain sets are decided here; the share of the weight in common bounds the others
            sure = open_ & plain & (by_x >= (threshold - 1e-12) * (n[x][:, None] + n[y] - by_x))
            i, j = np.nonzero(sure)
            root = _joined(label[x[i]], label[y[j]], len(names))
            maybe = open_ & ~plain & (by_x >= (threshold - 1e-6) * total[x][:, None]) & (by_y >= (threshold - 1e-6) * total[y])
            for i, j in zip(*np.nonzero(maybe)):
                a, b = sorted((root[label[x[i]]], root[label[y[j]]]))
                if a != b and likeness(sides[0][i], sides[1][j]) >= threshold - 1e-12:
                    root[root == b] = a
        moved = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": pa.array(names[root[moved]], out_type), "b": pa.array(names[moved], out_type)})

    many = members.where(F.col("size") > ALL_PAIRS).select("node", "v", "n", "total").join(labels, "node", "left")
    many = frames.written(many.select("node", "v", "n", F.coalesce("label", "node").alias("label")), "many")
    by_label = many.groupBy("v", "label").agg(F.count("*").alias("c"), F.sum("n").alias("s")).groupBy("v")
    mixed = by_label.agg(F.max(F.struct("c", "label", "s")).alias("main"), F.sum("c").alias("c"), F.sum("s").alias("s"), F.count("*").alias("labels")).where("labels > 1")
    blocks = lambda c, s: F.ceil(F.greatest(c / BLOCK, s / BLOCK_SHINGLES))
    main = F.col("main")
    mixed = mixed.select("v", main["label"].alias("main"), blocks(F.col("c") - main["c"], F.col("s") - main["s"]).alias("others"), blocks(main["c"], main["s"]).alias("mains"))
    is_main, at = F.col("label") == F.col("main"), F.xxhash64("node")
    dealt = spread(many, mixed, "v", "node").withColumn("block", F.when(is_main, F.col("others") + F.pmod(at, F.col("mains"))).otherwise(F.pmod(at, F.col("others"))))
    meets = F.sequence(F.lit(0).cast("long"), F.when(is_main, F.col("others")).otherwise(F.col("others") + F.col("mains")) - 1)
    dealt = dealt.select("node", "v", "label", "block", F.explode(meets).alias("meets"))
    dealt = dealt.select("node", "v", "label", "block", F.least("block", "meets").alias("p"), F.greatest("block", "meets").alias("q"))
    of = nodes.select("node", "n", "total", F.array(*(F.col(f"b{j}") for j in range(bands))).alias("bands")).join(sets, "node")
    dealt = dealt.join(of, "node").where(F.array_contains("bands", F.col("v")))
    out = frames.written(frames.lean(dealt).groupBy("v", "p", "q").applyInArrow(run, f"a {kind}, b {kind}").distinct(), "joins")
    frames.discard(many)
    return out


# Classes -----------------------------------------------------------------------------


def linked(docs: DataFrame, nodes: DataFrame, unnamed: DataFrame, threshold: float, k: int, bands: int, weighting: str) -> DataFrame:
    """(node, label) of the components of verified links between ``nodes`` (node, n, total, b0...).

    ``unnamed`` (node, set, times) brings the sets of nodes that no id names.
    """
    flat = nodes.select("node", F.explode(F.array(*(F.col(f"b{j}") for j in range(bands)))).alias("v"))
    sizes = flat.groupBy("v").agg(F.count("*").alias("size")).where("size > 1")
    members = frames.written(spread(flat, sizes, "v", "node").select("node", "v", "size"), "members")
    score = members.groupBy("node").agg(F.sum("size").alias("score")).join(nodes.select("node", "n", "total"), "node")
    scored = frames.written(members.join(score, "node"), "scored")
    wanted = frames.written(members.select("node").distinct(), "candidates")
    sets = sets_of(docs, wanted, k, weighting).unionByName(unnamed.join(wanted, "node", "left_semi"))
    # rows that share an id may differ in text: the node's is one of them
    sets = frames.written(sets, "sets")
    pairs = frames.written(candidates(scored, threshold), "pairs")
    found = frames.written(verified(pairs, sets, threshold), "links")
    labels = components(found)
    more = across(scored, labels, nodes, sets, threshold, bands)
    frames.discard(members, scored, wanted, sets, pairs, found)
    if more.isEmpty():
        return labels
    joined = components(more)
    moved = labels.join(joined.select(F.col("node").alias("label"), F.col("label").alias("to")), "label", "left").select("node", F.coalesce("to", "label").alias("label"))
    return moved.unionByName(joined.join(labels, "node", "left_anti"))


def classes(docs: DataFrame, threshold: float = THRESHOLD, k: int = WORDS, bands: int = BANDS, rows: int = ROWS, weighting: str = "count") -> DataFrame:
    """(doc_id, class_id, is_representative) of every row of ``docs``; the class id is its smallest doc_id."""
    signed = frames.written(signatures(docs, k, bands, rows, weighting), "signatures")
    kind = signed.schema["doc_id"].dataType
    keyed = signed.where("total > 0").groupBy("k1", "k2").agg(
        F.min("doc_id").alias("id"), F.max("n").alias("n"), F.max("total").alias("total"), *(F.max(f"b{j}").alias(f"b{j}") for j in range(bands))
    )
    # sorts after all ids but the largest integers
    number = F.shiftrightunsigned("k1", 2) + F.lit(1 << 62)
    made = number if isinstance(kind, T.LongType) else F.concat(F.lit("\U0010ffff"), number)
    keyed = frames.written(keyed.withColumn("node", F.coalesce("id", made)).drop("id"), "nodes")
    unnamed = signed.where("doc_id is null and n > 0").select(made.alias("node"), "set", "times").dropDuplicates(["node"])
    labels = linked(docs, keyed.where("n > 0"), unnamed, threshold, k, bands, weighting)
    named = keyed.select("k1", "k2", "node").join(labels, "node", "left").select("k1", "k2", F.coalesce("label", "node").alias("class_id"))
    out = signed.where("total > 0").select("doc_id", "k1", "k2").join(named, ["k1", "k2"]).select("doc_id", "class_id")
    out = out.unionByName(signed.where("total = 0").select("doc_id", F.col("doc_id").alias("class_id")))
    return out.withColumn("is_representative", F.coalesce(F.col("doc_id") == F.col("class_id"), F.lit(False)))


def one_of_each(docs: DataFrame, **options) -> DataFrame:
    """The rows of ``docs``, all columns, but one document of each class: that with the smallest doc_id.

    Of rows that share a doc_id one stays. Rows without id stay. Texts are not moved: the ids
    that go are picked in the scan while there are at most ``BROADCAST_IDS``; beyond it only the
    texts that ``maybe_in`` lets through are shuffled.
    """
    found = frames.written(classes(docs, **options), "classes").where("doc_id is not null")
    rows = found.groupBy("doc_id").agg(F.count("*").alias("rows"), F.min("class_id").alias("class"))
    name, goes = frames.fresh(docs, "_id"), frames.fresh(docs, "_goes")
    odd = rows.select(F.col("doc_id").alias(name), (F.col("class") != F.col("doc_id")).alias(goes), "rows").where(F.col(goes) | (F.col("rows") > 1)).drop("rows")
    odd = frames.written(odd, "odd")
    if odd.count() <= BROADCAST_IDS:
        marked = docs.join(F.broadcast(odd), _id(docs) == odd[name], "left")
        out = marked.where(F.col(name).isNull()).drop(name, goes)
    else:
        maybe = maybe_in(odd.select(name))(_id(docs))
        marked = docs.where(maybe).join(odd.hint("merge"), _id(docs) == odd[name], "left")
        out = frames.lean(docs).where(~maybe).unionByName(marked.where(F.col(name).isNull()).drop(name, goes))
    if odd.where(~F.col(goes)).isEmpty():
        return out
    return out.unionByName(marked.where(~F.col(goes)).dropDuplicates([name]).drop(name, goes))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classes(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
