"""Document fingerprints: Order MinHash over occurrence-numbered word k-mers.

Every k-mer of words is numbered by its occurrence in the text and hashed; the hash
space is cut into ``SKETCHES`` bins, and for each the ``TAKE`` smallest elements from its
beginning on are selected (where the bin has fewer, the next bins lend theirs, round the
end), put back into text order, and hashed as a tuple. So a sketch agrees where the same
k-mers stand in the same order, which follows edit distance rather than the mere set. The
likeness of two texts is the TAKE-th root of the share of agreeing sketches: it
estimates the share of common elements in common order.

All of it is array expressions in the scan: one sort by hash groups occurrences, a
second selects, both linear in memory. Nothing is exploded. The next document in
descending id order is found without a global sort: rows are dealt into ranges of id
(``ranges``), as many as the bytes of the texts need, and each range gets a copy of the
next one's first row. Only that exchange moves texts, once.

Null texts count as empty. Wordless texts have an empty fingerprint; two such are
alike (1), against others 0. Texts of fewer than k words make one k-mer. Ids are integers,
or else taken and ordered as strings. Rows of one id follow each other by the hash of
their text; null ids come last; a range of many rows of one id, or of none, is divided by
that hash. A table of one row is its own next. Other columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from trajspark.llm import frames, native
from trajspark.operators import ranges

K, TAKE, SKETCHES = 2, 2, 64
#: Text bytes of a range, about.
RANGE_BYTES = 64 << 20
#: An element is 33 bits of hash over 31 of its place in the text, which no text exceeds.
_PLACE_BITS = 31
_PLACE = (1 << _PLACE_BITS) - 1
_BITS = SKETCHES.bit_length() - 1


def _bin(x: Column) -> Column:
    """Bins in the order of signed numbers, which sorts keep."""
    return F.shiftright(x, 64 - _BITS) + SKETCHES // 2


def with_sketches(df: DataFrame, text: str, out: str) -> DataFrame:
    """``df`` with the array ``out`` of the sketches of ``text``: tuple hashes whose low bits are the bin."""
    made = [frames.fresh(df, f"_{s}") for s in ("w", "s", "first", "e", "k", "b", "d")]
    w, s, first, e, k, b, d = (F.col(c) for c in made)
    keep = df.columns

    def step(d: DataFrame, name: str, c: Column, drop: str | None = None) -> DataFrame:
        return d.withColumn(name, c) if drop is None else d.withColumn(name, c).drop(drop)

    df = step(df, made[0], native.words(F.col(text)))
    kmers = F.coalesce(native.tuples(w, K, lambda *x: F.xxhash64(*x)), F.array().cast("array<bigint>"))
    packed = F.transform(kmers, lambda h, i: h.bitwiseAND(F.lit(~_PLACE)).bitwiseOR(F.least(i, F.lit(_PLACE)).cast("long")))
    df = step(df, made[1], F.sort_array(packed), made[0])
    n = F.size(s)
    hash_at = lambda i: F.shiftright(F.get(s, i), _PLACE_BITS)
    new = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (hash_at(i) != hash_at(i - 1)))
    df = step(df, made[2], F.when(n > 0, new).otherwise(F.array().cast("array<int>")))
    number = lambda at, o: F.xxhash64(hash_at(at), o).bitwiseAND(F.lit(~_PLACE)).bitwiseOR(F.get(s, at + o).bitwiseAND(F.lit(_PLACE)))
    runs = F.transform(first, lambda at, j: F.transform(F.sequence(F.lit(0), F.coalesce(F.get(first, j + 1), n) - at - 1), lambda o: number(at, o)))
    df = step(df, made[3], F.sort_array(F.flatten(runs))).drop(made[1], made[2])
    df = step(df, made[4], F.filter(e, lambda x, i: (i < TAKE) | (_bin(F.get(e, i - TAKE)) != _bin(x))), made[3])
    m = F.size(k)
    starts = F.filter(F.transform(k, lambda x, i: F.when((i == 0) | (_bin(F.get(k, i - 1)) != _bin(x)), i)), lambda i: i.isNotNull())
    df = step(df, made[5], starts)
    taken = lambda i: F.array(*(F.get(k, (i + j) % m) for j in range(TAKE)))
    ordered = lambda i: F.sort_array(F.transform(taken(i), lambda x: F.shiftleft(x.bitwiseAND(F.lit(_PLACE)), 64 - _PLACE_BITS).bitwiseOR(F.shiftrightunsigned(x, _PLACE_BITS))))
    digest = lambda i: F.xxhash64(F.transform(ordered(i), lambda x: x.bitwiseAND(F.lit((1 << 64 - _PLACE_BITS) - 1)))).bitwiseAND(F.lit(-SKETCHES))
    df = step(df, made[6], F.transform(b, digest))
    # a bin without elements has the tuple of the next one that has some
    bin_at = lambda j: _bin(F.get(k, F.get(b, j))).cast("int")
    upto = lambda j, low, high: F.transform(F.sequence(low, high), lambda v: F.get(d, j).bitwiseOR(v.cast("long")))
    most = F.flatten(F.transform(b, lambda i, j: upto(j, F.when(j == 0, 0).otherwise(bin_at(j - 1) + 1), bin_at(j))))
    last = bin_at(F.size(b) - 1)
    rest = F.when(last < SKETCHES - 1, upto(F.lit(0), last + 1, F.lit(SKETCHES - 1))).otherwise(F.array().cast("array<bigint>"))
    return df.withColumn(out, F.when(m > 0, F.concat(most, rest)).otherwise(F.array().cast("array<bigint>"))).select(*(F.col(f"`{c}`") for c in keep), out)


def fingerprint(sketches: Column) -> Column:
    return F.array_join(F.transform(sketches, lambda x: F.lower(F.hex(x))), ",")


def likeness(a: Column, b: Column) -> Column:
    none = (F.size(a) == 0) | (F.size(b) == 0)
    return F.when(none, (F.size(a) == F.size(b)).cast("double")).otherwise(F.pow(F.size(F.array_intersect(a, b)) / F.lit(float(SKETCHES)), F.lit(1.0 / TAKE)))


def with_next(docs: DataFrame) -> DataFrame:
    """(doc_id, text, sketches, next_text, next_sketches): the next document by descending id, after the last the first."""
    spark = docs.sparkSession
    kind = docs.schema["doc_id"].dataType
    base = docs.select(F.col("doc_id").cast("long" if isinstance(kind, T.IntegralType) else "string").alias("doc_id"), F.coalesce("text", F.lit("")).alias("text"))
    size = base.agg(F.count("*").alias("n"), F.sum(F.octet_length("text").cast("long")).alias("bytes")).head()
    n = max(4 * frames.parts(spark), -(-(size["bytes"] or 0) // RANGE_BYTES))
    base = ranges.even(base, "doc_id", n, size["n"]).numbered(base.withColumn("tk", F.xxhash64("text")), "doc_id", "tk", "range")
    heads = base.groupBy("range").agg(F.max(F.struct("doc_id", "tk")).alias("h")).select("range", F.col("h.doc_id").alias("hid"), F.col("h.tk").alias("htk")).collect()
    order = sorted((r["range"] for r in heads), reverse=True)
    before = {r: order[i - 1] for i, r in enumerate(order)}  # the range whose last row goes on with this one's head
    rows = [(r["range"], r["hid"], r["htk"], before[r["range"]]) for r in heads]
    chosen = spark.createDataFrame(rows, f"hrange long, hid {base.schema['doc_id'].dataType.simpleString()}, htk long, goes long")
    guests = (
        base.join(F.broadcast(chosen), (F.col("range") == F.col("hrange")) & (F.col("tk") == F.col("htk")) & F.col("doc_id").eqNullSafe(F.col("hid")))
        .groupBy("goes", "doc_id", "tk").agg(F.first("text").alias("text"))
        .select("doc_id", "text", F.col("goes").alias("range"), "tk", F.lit(1).alias("guest"))
    )
    rows = with_sketches(base.withColumn("guest", F.lit(0)).unionByName(guests), "text", "sketches")
    w = Window.partitionBy("range").orderBy("guest", F.desc_nulls_last("doc_id"), F.desc("tk"))
    return rows.withColumn("next_text", F.lead("text").over(w)).withColumn("next_sketches", F.lead("sketches").over(w)).where("guest = 0").select("doc_id", "text", "sketches", "next_text", "next_sketches")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = with_next(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    rows = rows.withColumn("n_chars", F.length("text").cast("long")).withColumn("edited", F.concat(F.substring("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substring("next_text", F.lit(1), half)))
    rows = with_sketches(rows.select("doc_id", "n_chars", "edited", "sketches", "next_sketches"), "edited", "edited_sketches")
    return rows.select(
        "doc_id", "n_chars", F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), fingerprint(F.col("sketches")).alias("fingerprint"), fingerprint(F.col("edited_sketches")).alias("edited_fingerprint"),
        likeness(F.col("sketches"), F.col("edited_sketches")).alias("near_edited"), likeness(F.col("sketches"), F.col("next_sketches")).alias("near_next"),
    )
