"""Benchmark decontamination: size-partitioned MinHash containment search.

An item is contained in a document if at least ``THRESHOLD`` of its distinct five-word
shingles occur there. Items fall into partitions by the power of two of their number
of shingles; each keeps as its sketch the shingles of smallest hash, as many as the
partition's largest item may miss, and one. By the pigeonhole principle a document
that contains an item has one of these at least, so the search loses nothing, however
long the document. Hits are verified by exact containment of the shingles as text.

The size partitions decide how many minima an item keeps; documents keep all their
shingles, as a document's own minima say nothing of a short item inside it. So recall is
exact rather than estimated. Documents' shingles are probed in the scan and never shuffled
while the sketches are within ``BROADCAST_ROWS``, which is checked; beyond it Spark joins
them by hash. Verification reads again the documents that were hit, and no others are
shuffled; items are broadcast within a checked size, beyond it joined with salt.

Null and wordless texts have no shingles: such items are in no document, such
documents contain none. Texts of one to four words make a single shingle of all their
words, which equals only another such text. Rows that share a doc_id (null is one
more) count as one document, with its best containment; likewise items. The columns
of the inputs beside id and text are ignored. Empty tables give an empty result.
"""

from __future__ import annotations


from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import frames, native

WORDS, THRESHOLD = 5, 0.8
#: Sketch rows (hash and item number, 16 bytes) that may be broadcast.
BROADCAST_ROWS = 2_000_000
#: Shingles of all items, as text (about 50 bytes each), that may be broadcast; beyond it they are dealt over this many salts.
BROADCAST_SHINGLES, SALTS = 500_000, 16


def missable(n, threshold: float):
    """How many of n shingles may be missing."""
    return F.floor(n * F.lit(1 - threshold) + F.lit(1e-9))


def _hashes(w, k):
    return F.coalesce(native.tuples(w, k, lambda *x: F.xxhash64(*x)), F.array().cast("array<bigint>"))


def _shingles(w, k):
    return F.coalesce(native.tuples(w, k, lambda *x: F.concat_ws(" ", *x)), F.array().cast("array<string>"))


def contained(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """(doc_id, item_id, containment) of every document and item it contains."""
    spark = docs.sparkSession
    item = items.select("item_id", native.words(F.col("text")).alias("w")).select("item_id", F.array_distinct(_shingles(F.col("w"), k)).alias("want"), F.array_distinct(_hashes(F.col("w"), k)).alias("h"))
    item = frames.written(item.where(F.size("want") > 0).withColumn("item", F.monotonically_increasing_id()), "items")
    top = F.pow(F.lit(2.0), F.floor(F.log2(F.size("h"))) + 1) - 1
    sketch = item.select("item", F.explode(F.slice(F.array_sort("h"), F.lit(1), (missable(top, threshold) + 1).cast("int"))).alias("h"))
    small = sketch.count() <= BROADCAST_ROWS
    mark = F.broadcast if small else (lambda d: d)
    # one of these is a row: equal ids and texts are one document
    keyed = docs.select("doc_id", "text", F.xxhash64("text").alias("tk"))
    probes = keyed.select("doc_id", "tk", native.words(F.col("text")).alias("w")).select("doc_id", "tk", F.explode(_hashes(F.col("w"), k)).alias("h"))
    hits = frames.written(probes.join(mark(sketch), "h").select("doc_id", "tk", "item").distinct(), "hits")
    # a document is moved once, with the list of the items it may contain; the items of one document are bounded by those of the benchmark
    found = hits.groupBy(F.col("doc_id").alias("id"), F.col("tk").alias("key")).agg(F.collect_list("item").alias("of"))
    texts = keyed.join(found, (F.col("doc_id").eqNullSafe(F.col("id"))) & (F.col("tk") == F.col("key"))).select("doc_id", "of", native.words(F.col("text")).alias("w"))
    has = texts.select("doc_id", F.explode("of").alias("item"), _shingles(F.col("w"), k).alias("has"))
    wanted = item.select("item", "item_id", "want")
    if (wanted.agg(F.sum(F.size("want"))).head()[0] or 0) <= BROADCAST_SHINGLES:
        both = has.join(F.broadcast(wanted), "item")
    else:  # very many documents may quote one item
        copies = wanted.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
        both = has.withColumn("salt", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS))).join(copies, ["item", "salt"])
    share = both.select("doc_id", "item_id", (F.size(F.array_intersect("want", "has")) / F.size("want")).alias("containment"))
    return share.where(F.col("containment") >= threshold - 1e-12).groupBy("doc_id", "item_id").agg(F.max("containment").alias("containment"))


def clean(docs: DataFrame, items: DataFrame, threshold: float = THRESHOLD, k: int = WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, whose document contains no item."""
    bad = contained(docs, items, threshold, k).select(F.col("doc_id").alias(name := frames.fresh(docs, "_bad"))).distinct()
    return docs.join(bad, docs["doc_id"].eqNullSafe(bad[name]), "left_anti")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contained(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
WITH d AS (SELECT doc_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM documents),
b AS (SELECT item_id, trim(regexp_replace(lower(coalesce(text, '')), '[^\p{L}\p{N}]+', ' ', 'g')) AS t FROM benchmark),
dw AS (SELECT doc_id, string_split(t, ' ') AS w FROM d WHERE t <> ''),
bw AS (SELECT item_id, string_split(t, ' ') AS w FROM b WHERE t <> ''),
ds AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ') || repeat(' ', 5 - len(w))] END) AS s FROM dw),
bs AS (SELECT DISTINCT item_id, unnest(CASE WHEN len(w) >= 5 THEN list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' ')) ELSE [array_to_string(w, ' ') || repeat(' ', 5 - len(w))] END) AS s FROM bw),
n AS (SELECT item_id, count(*) AS n FROM bs GROUP BY item_id)
SELECT ds.doc_id, n.item_id, count(*)::DOUBLE / n.n AS containment
FROM ds JOIN bs USING (s) JOIN n ON n.item_id = bs.item_id GROUP BY ds.doc_id, n.item_id, n.n HAVING count(*)::DOUBLE / n.n >= 0.8 - 1e-12
"""
