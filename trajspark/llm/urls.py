"""URL filters: a sort-merge range join on canonical keys with the host reversed.

A host and path are keyed by the host's labels in reverse, each followed by a dot, then
a slash and the path ("com.example./" and "/en/"). The urls that a rule covers on its own
host form the interval of all keys that begin with the rule's key, so the intervals of
rules nest. A rule covers subdomains too: a url enters the join once for each suffix of
its host. One sorted sweep over the rules keeps the stack of open ones and leaves, at
every start and end of an interval, the innermost rule from there on; a second sweep
merges these bounds with the sorted keys of the urls. Of a url's rules the longest
decides, at equal length the one on the longer host.

Keys and bounds are dealt into even ranges (``ranges``), each of which also gets the rule
that is open where it begins; a key that very many urls share is divided further. So a
task holds a range of urls and the bounds within it, and neither the number of rules on
one host nor that of all rules is limited but by the driver, which is given their list.
Only id and url are read and shuffled.

A null url, or one without ``://``, has an empty host and path, hence no rule and the
default verdict. Repeated rows are judged each; of rules that are equal but for their
verdict, the greater verdict ("block") stands. An empty rule list leaves the default.
Columns beside id and url are ignored.
"""

from __future__ import annotations

from bisect import bisect_left, bisect_right

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from trajspark.llm import frames
from trajspark.operators import ranges

#: Keys of a range, about, and rules that may be broadcast by name.
RANGE_KEYS, BROADCAST_RULES = 2_000_000, 100_000
DEFAULT = "allow"
# The rules of the query, as (verdict, host, path).
RULES = [
    ("allow", "com", "/"),
    ("block", "example.com", "/en/"),
    ("allow", "www.example.com", "/en/"),
    ("block", "net", "/es/"),
    ("block", "net", "/fr/"),
]
#: A-Z alone are lower-cased, as hosts compare.
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_and_path(url: Column) -> tuple[Column, Column]:
    at = F.locate("://", url)
    rest = F.when(at > 0, url.substr(at + F.lit(3), F.length(url)))
    rest = F.coalesce(rest, F.lit(""))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), _UPPER, _LOWER)
    path = F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)
    return host, path


def rule_key(host: str, path: str) -> bytes:
    return ("".join(f"{label}." for label in reversed(host.split("."))) + "/" + path).encode("utf-8", "surrogatepass")


def bounds(keys: list[tuple[bytes, int]]) -> list[tuple[bytes, int]]:
    """(key, the innermost open rule from this key on, or -1) at every start and end of the intervals of ``keys`` (key, rule)."""
    out: dict[bytes, int] = {}
    stack: list[tuple[bytes, int]] = []

    def close() -> None:
        key, _ = stack.pop()
        out[key[:-1] + bytes([key[-1] + 1])] = stack[-1][1] if stack else -1

    for key, rule in sorted(keys):
        while stack and not key.startswith(stack[-1][0]):
            close()
        stack.append((key, rule))
        out[key] = rule
    while stack:
        close()
    return sorted(out.items())


def _dealt(edges: list[tuple[bytes, int]], cut: ranges.Ranges) -> list[tuple[int, bytes, int]]:
    """(range, key, rule): each bound in its range, and in every range the rule that is open where it begins."""
    keys, out = [k for k, _ in edges], []
    before = lambda k: edges[i - 1][1] if (i := bisect_right(keys, k)) else -1
    for p in range(len(cut.cuts) + 1):
        out.append((cut.between(p), b"", before(cut.cuts[p - 1]) if p else -1))
        if p < len(cut.cuts):
            out += [(r, b"", before(cut.cuts[p])) for r in cut.on(p)]
    return out + [(cut.between(bisect_left(cut.cuts, k)), k, rule) for k, rule in edges]


def judge(pages: DataFrame, rules: list[tuple[str, str, str]], default: str = DEFAULT, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """(id, host, path, rule, verdict) of every row of ``pages``; ``rules`` are (verdict, host, path)."""
    spark = pages.sparkSession
    url = F.col(f"`{url_col}`")
    host, path = host_and_path(url)
    parsed = pages.select(F.col(f"`{id_col}`").alias("id"), host.alias("host"), path.alias("path"), F.monotonically_increasing_id().alias("row"))
    # a rule's number is its place among all by length, so the greatest number decides
    ranked = sorted(set(rules), key=lambda r: (len(r[1]) + len(r[2]), len(r[1]), r[1] + r[2], r[0]))
    numbers = {rule_key(h, p): k for k, (_, h, p) in enumerate(ranked)}
    names = spark.createDataFrame([(k, h + p, v) for k, (v, h, p) in enumerate(ranked)] or [(-1, "", "")], "best int, rule string, verdict string")

    labels = F.split("host", r"\.")
    suffix = lambda i: F.array_join(F.reverse(F.slice(labels, i, F.size(labels))), ".")
    keys = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.concat(suffix(i), F.lit("./"), F.col("path")).cast("binary"))
    keyed = parsed.select("id", "host", "path", "row", F.explode(keys).alias("key")).withColumn("by", F.xxhash64("row"))
    total = keyed.count()
    cut = ranges.even(keyed, "key", max(4 * frames.parts(spark), -(-total // RANGE_KEYS)), total)
    urls = cut.numbered(keyed, "key", "by", "range").drop("by").withColumn("open", F.lit(None).cast("int"))
    edges = spark.createDataFrame(_dealt(bounds(list(numbers.items())), cut), "range long, key binary, open int")
    both = urls.withColumn("is_url", F.lit(True)).unionByName(edges.withColumn("is_url", F.lit(False)), allowMissingColumns=True)
    sweep = Window.partitionBy("range").orderBy("key", "is_url").rowsBetween(Window.unboundedPreceding, 0)
    swept = both.withColumn("open", F.last("open", ignorenulls=True).over(sweep)).where("is_url")
    best = swept.groupBy("row", "id", "host", "path").agg(F.max("open").alias("best"))
    if len(ranked) <= BROADCAST_RULES:
        named = best.join(F.broadcast(names), "best", "left")
    else:  # a rule may decide a third of all urls
        salts = 4 * frames.parts(spark)
        spread = names.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(salts - 1).cast("long"))))
        named = best.withColumn("salt", F.pmod(F.xxhash64("row"), F.lit(salts))).join(spread, ["best", "salt"], "left")
    found = F.col("best") >= 0
    return named.select(F.col("id").alias(id_col), "host", "path", F.when(found, F.col("rule")).alias("rule"), F.when(found, F.col("verdict")).otherwise(default).alias("verdict"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(spark.read.parquet(f"{sf_dir}/pages.parquet"), RULES)


ORACLE = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages
), parsed AS (
  SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         regexp_extract(rest, '^[^/?#]*([^?#]*)', 1) AS path FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'com', '/'), ('block', 'example.com', '/en/'), ('allow', 'www.example.com', '/en/'), ('block', 'net', '/es/'), ('block', 'net', '/fr/')
), hit AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict, length(rhost) + length(rpath) AS n, length(rhost) AS h
  FROM parsed JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
), best AS (
  SELECT page_id, arg_max(rule, n * 10000 + h) AS rule, arg_max(verdict, n * 10000 + h) AS verdict FROM hit GROUP BY page_id
)
SELECT p.page_id, p.host, p.path, b.rule, coalesce(b.verdict, 'allow') AS verdict FROM parsed p LEFT JOIN best b USING (page_id)
"""
