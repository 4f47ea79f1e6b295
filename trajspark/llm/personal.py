"""PII: weak supervision over candidate spans, all in SQL expressions.

Candidates are the matches of the four base expressions (also those that fail their
test) and of four looser ones. Five labelers vote on each: its format test, a
gazetteer (top-level domains, card issuers, calling codes, private address blocks),
words before it, how it stands in its surroundings, and its length. Votes are 1, 0 or
-1. The counts of the vote patterns by kind, at most 8 x 3**5 rows whatever the corpus,
are aggregated in Spark; for each kind expectation-maximisation over them estimates the
labelers' reliabilities, and a logistic span classifier is fitted to the resulting
posteriors and compiled into a column expression. Base spans that pass their test
always stay; of all other candidates the classifier alone adds those at ``ACCEPT`` or
more, loose ones under their own kind and failed base matches as ``other``.

Starts are running sums over the lengths of the gaps (``split``) and matches
(``regexp_extract_all``) of one expression, made by doubling steps; a match's
surroundings are the ends of the gaps beside it. Quantifiers are possessive wherever no
retry could succeed, and a search begins at the start of a run or where the last match
ended, so cost is nearly linear in the text. Texts are read once and never shuffled;
votes are written once.

Null and empty texts have no spans. Offsets are code points, ends exclusive; spans of
different kinds may overlap. Repeated rows are searched each; other columns are ignored.
An empty table gives an empty result.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from trajspark.llm import frames

ACCEPT = 0.9
#: Priors of P(vote | class), for votes -1, 0, 1 by class (false, true), and of the format test's vote on true spans;
#: they stand for so many spans and this share of those seen.
BELIEF, FORMAT_BELIEF = np.array([[0.5, 0.35, 0.15], [0.15, 0.35, 0.5]]), np.array([0.01, 0.04, 0.95])
STRENGTH, SHARE = 4.0, 0.05
_LOCAL, _HOST = "A-Za-z0-9._%+-", "A-Za-z0-9-"
# The four base expressions and the looser ones, in possessive form.
BASE = {
    "email": rf"(?:\G|(?<![{_LOCAL}]))[{_LOCAL}]++@[{_HOST}]++(?:\.[{_HOST}]++)++",
    "ip": r"(?:\G|(?<![0-9]))[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
LOOSE = {
    "hidden_email": rf"(?<![{_LOCAL}])[{_LOCAL}]++\x20?(?:\[at\]|\(at\))\x20?[{_HOST}]++(?:\x20?(?:\.|\[dot\]|\(dot\))\x20?[{_HOST}]++)++",
    "tax_id": r"(?<![0-9-])[0-9]{3}-[0-9]{2}-[0-9]{4}(?![0-9-])",
    "account": r"(?<![A-Za-z0-9])[A-Z]{2}[0-9]{2}(?:\x20?[A-Z0-9]{4}){3,7}(?:\x20?[A-Z0-9]{1,3})?(?![A-Za-z0-9])",
    "local_phone": r"(?<![0-9+).-])(?:\([0-9]{3}\)\x20?|[0-9]{3}[.\x20-])[0-9]{3}[.-][0-9]{4}(?![0-9-])",
}
#: What a text must contain for an expression to be tried.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+", "hidden_email": "at", "tax_id": "-", "account": None, "local_phone": None}
KINDS = [*BASE, *LOOSE]
TLDS = ("com", "org", "net", "edu", "gov", "io", "de", "fr", "es", "uk", "it", "eu", "info", "co")
WORDS_FOR = r"(?i)(?:phone|tel|call|mobile|fax|mail|contact|card|visa|account|iban|ssn|social security|address|login)\W*\w*\W*$"
WORDS_AGAINST = r"(?i)(?:version|isbn|issn|doi|page|order|ticket|example|item)\W*\w*\W*$"
LABELERS = ("format", "gazetteer", "context", "surroundings", "size")


def luhn(digits: Column) -> Column:
    n = F.length(digits)
    one = lambda i: F.substring(digits, n - i, F.lit(1)).cast("int")
    add = lambda i: F.when(i % 2 == 0, one(i)).otherwise(one(i) * 2 - F.when(one(i) > 4, 9).otherwise(0))
    return F.aggregate(F.sequence(F.lit(0), n - 1), F.lit(0), lambda acc, i: acc + add(i)) % 10 == 0


def _digits(c: Column) -> Column:
    return F.regexp_replace(c, "[^0-9]", "")


def passes(kind: str, m: Column) -> Column:
    """Whether a match of a kind passes its own test."""
    d = _digits(m)
    if kind == "ip":
        part = r"0*(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])"
        return F.rlike(m, F.lit(rf"^{part}(?:\.{part}){{3}}$"))
    if kind == "card":
        return F.when(F.length(d).between(14, 19), luhn(d)).otherwise(F.lit(False))
    if kind == "phone":
        return F.length(d).between(10, 15)
    if kind == "account":
        return _iban(m)
    if kind == "tax_id":
        return ~F.rlike(m, F.lit("^(?:000|666|9)|-00-|-0000$"))
    return F.lit(True)


def _iban(m: Column) -> Column:
    """Whether the check digits of an account number are right."""
    plain = F.replace(m, F.lit(" "), F.lit(""))
    turned = F.concat(F.substring(plain, F.lit(5), F.length(plain)), F.substring(plain, F.lit(1), F.lit(4)))
    code = lambda c: F.ascii(c)
    step = lambda acc, c: F.when(code(c) < 58, acc * 10 + code(c) - 48).otherwise(acc * 100 + code(c) - 55) % 97
    return F.aggregate(F.split(turned, ""), F.lit(0), step) == 1


def _gazetteer(kind: str, m: Column) -> Column:
    vote = lambda c: F.when(c, 1).otherwise(-1)
    if kind in ("email", "hidden_email"):
        return vote(F.lower(F.regexp_extract(m, r"([A-Za-z0-9-]+)$", 1)).isin(*TLDS))
    if kind == "ip":
        return F.when(F.rlike(m, F.lit(r"^(?:0|127|255)\.")), -1).when(F.rlike(m, F.lit(r"^(?:10|192\.168)\.")), 0).otherwise(1)
    if kind == "card":
        return vote(F.rlike(m, F.lit("^(?:3[0-9]|4|5[1-5]|2[2-7]|6)")))
    if kind == "phone":
        return vote(F.rlike(m, F.lit(r"^\+[1-9]")))
    if kind == "local_phone":
        return vote(F.rlike(m, F.lit(r"^\(?[2-9][0-8][0-9]\)?[.\x20-]*[2-9]")))
    return F.lit(0)


def _expected(kind: str, m: Column) -> Column:
    low, high = {"email": (6, 80), "ip": (7, 15), "card": (14, 23), "phone": (11, 22), "hidden_email": (8, 90), "tax_id": (11, 11), "account": (15, 42), "local_phone": (12, 14)}[kind]
    return F.when(F.length(m).between(low, high), 1).otherwise(-1)


def running(values: Column, both=lambda x, y: x + y) -> Column:
    """Running sums (or another associative operation) of an array of integers, in log2(size) linear steps."""
    n = F.size(values)
    back = lambda k: F.call_function("shiftleft", F.lit(1), k)
    step = lambda acc, k: F.transform(acc, lambda x, i: F.when(i >= back(k), both(x, F.get(acc, i - back(k)))).otherwise(x))
    return F.when(n < 2, values).otherwise(F.aggregate(F.sequence(F.lit(0), F.ceil(F.log2(n)).cast("int") - 1), values, step))


def candidates(docs: DataFrame) -> DataFrame:
    """(doc_id, found): all candidates of each text with their votes, by start and kind."""
    docs = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    text, none = F.col("text"), F.array().cast("array<string>")
    here = {k: F.contains(text, F.lit(NEEDS[k])) if NEEDS[k] else F.rlike(text, F.lit("[0-9]")) for k in KINDS}
    patterns = BASE | LOOSE
    # the leftmost non-overlapping matches of a kind, and the gaps around them
    docs = docs.select("doc_id", *(F.when(here[k], F.regexp_extract_all(text, F.lit(patterns[k]), F.lit(0))).otherwise(none).alias(f"m_{k}") for k in KINDS), *(F.when(here[k], F.split(text, patterns[k], -1)).otherwise(none).alias(f"g_{k}") for k in KINDS))
    sizes = lambda k: F.transform(f"m_{k}", lambda m, i: F.length(m) + F.length(F.get(F.col(f"g_{k}"), i)))
    docs = docs.select("*", *(sizes(k).alias(f"l_{k}") for k in KINDS))
    docs = docs.select("*", *(running(F.col(f"l_{k}")).alias(f"e_{k}") for k in KINDS))

    def voted(kind: str) -> Column:
        gaps, ends, last = F.col(f"g_{kind}"), F.col(f"e_{kind}"), F.size(f"m_{kind}") - 1

        def one(m: Column, i: Column) -> Column:
            before, after = F.right(F.get(gaps, i), F.lit(30)), F.left(F.get(gaps, i + 1), F.lit(1))
            # an empty gap is the edge of the text or another match
            free = lambda gap, edge, at: F.when(gap == "", edge).otherwise(~F.rlike(gap, F.lit(at)))
            apart = free(before, i == 0, r"[\p{L}\p{N}_]$") & free(after, i == last, r"^[\p{L}\p{N}_]")
            passed = passes(kind, m)
            votes = {
                "format": F.when(passed, 1).otherwise(-1),
                "gazetteer": _gazetteer(kind, m),
                "context": F.when(F.rlike(before, F.lit(WORDS_AGAINST)), -1).when(F.rlike(before, F.lit(WORDS_FOR)), 1).otherwise(0),
                "surroundings": F.when(apart, 1).otherwise(-1),
                "size": _expected(kind, m),
            }
            end = F.get(ends, i)
            return F.struct((end - F.length(m)).alias("start"), F.lit(KINDS.index(kind)).alias("kind"), end.alias("end"), (passed if kind in BASE else F.lit(False)).alias("base"), *(votes[v].cast("int").alias(v) for v in LABELERS))

        return F.transform(f"m_{kind}", one)

    return docs.select("doc_id", F.array_sort(F.concat(*(voted(k) for k in KINDS))).alias("found"))


def reliabilities(votes: np.ndarray, count: np.ndarray, rounds: int = 60) -> tuple[float, np.ndarray, np.ndarray]:
    """EM over vote patterns (rows of -1, 0, 1) and their counts.

    Returns the share of true spans, P(vote | class) as [labeler, class, vote + 1], and
    each pattern's posterior. The tables have a prior that labelers are better than chance
    (``BELIEF``), which also tells the two classes apart; that true spans pass the format
    test but for misprints (``FORMAT_BELIEF``) counts like as many spans as were seen.
    """
    seen = np.eye(3)[votes + 1]
    prior_counts = np.stack([(STRENGTH + SHARE * count.sum()) * BELIEF] * votes.shape[1])
    prior_counts[0, 1] = (STRENGTH + count.sum()) * FORMAT_BELIEF
    odds = votes.sum(1).astype(float)
    for _ in range(rounds):
        post = 1 / (1 + np.exp(-np.clip(odds, -30, 30)))
        prior = float(np.clip((post @ count + 1) / (count.sum() + 2), 0.01, 0.99))
        weight = np.stack([(1 - post) * count, post * count], 1)
        tables = np.einsum("pc,plv->lcv", weight, seen) + prior_counts
        tables /= tables.sum(2, keepdims=True)
        says = np.log(tables[:, 1] / tables[:, 0])
        # a vote of 1 never speaks against a span, nor one of -1 for it
        says[:, 2], says[:, 0] = np.maximum(says[:, 2], 0), np.minimum(says[:, 0], 0)
        odds = np.log(prior / (1 - prior)) + np.einsum("plv,lv->p", seen, says)
    return prior, tables, 1 / (1 + np.exp(-np.clip(odds, -30, 30)))


def span_classifier(votes: np.ndarray, count: np.ndarray, post: np.ndarray, steps: int = 60, ridge: float = 1e-3) -> tuple[float, np.ndarray]:
    """(bias, weights [labeler, vote + 1]) of a logistic regression on the posteriors, by Newton's method."""
    x = np.concatenate([np.ones((len(votes), 1)), (votes == -1), (votes == 1)], 1).astype(float)
    share, w = count / count.sum(), np.zeros(x.shape[1])
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        grad = x.T @ (share * (p - post)) + ridge * w
        hessian = (x * (share * np.maximum(p * (1 - p), 1e-4))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.linalg.solve(hessian, grad)
    n = votes.shape[1]
    return float(w[0]), np.stack([w[1 : n + 1], np.zeros(n), w[n + 1 :]], 1)


def learnt(found: DataFrame) -> dict[int, tuple[float, np.ndarray]]:
    """The span classifier of each kind that occurs in ``found``."""
    seen = found.select(F.explode("found").alias("c")).groupBy("c.kind", *(F.col(f"c.{v}").alias(v) for v in LABELERS)).count().collect()
    out = {}
    for kind in sorted({r["kind"] for r in seen}):
        rows = sorted((tuple(r[v] for v in LABELERS), r["count"]) for r in seen if r["kind"] == kind)
        votes, count = np.array([v for v, _ in rows]), np.array([n for _, n in rows], float)
        out[kind] = span_classifier(votes, count, reliabilities(votes, count)[2])
    return out


def classified(found: DataFrame) -> DataFrame:
    """``found`` (candidates()) with ``spans``: (kind, start, end, base), base spans and those the classifier adds."""
    models = learnt(found)
    none = (-30.0, np.zeros((len(LABELERS), 3)))
    table = lambda values: F.array(*(F.lit(float(v)) for v in values))
    bias = table([models.get(k, none)[0] for k in range(len(KINDS))])
    weights = [table([v for k in range(len(KINDS)) for v in models.get(k, none)[1][j]]) for j in range(len(LABELERS))]
    says = lambda c: sum((F.get(weights[j], c["kind"] * 3 + c[v] + 1) for j, v in enumerate(LABELERS)), F.get(bias, c["kind"]))
    margin = float(np.log(ACCEPT / (1 - ACCEPT)))
    names = F.array(*(F.lit(k) for k in KINDS))
    kept = F.filter("found", lambda c: c["base"] | (says(c) >= margin))
    kind = lambda c: F.when(c["base"] | (c["kind"] >= len(BASE)), F.get(names, c["kind"])).otherwise("other")
    kept = found.select("doc_id", kept.alias("kept"))
    # an added span that begins inside a base span of an earlier or the same start is left out
    covered = kept.select("doc_id", "kept", running(F.transform("kept", lambda c: F.when(c["base"], c["end"]).otherwise(0)), F.greatest).alias("covered"))
    kept = covered.select("doc_id", F.filter("kept", lambda c, i: c["base"] | (F.get("covered", i) <= c["start"])).alias("kept"))
    return kept.select("doc_id", F.transform("kept", lambda c: F.struct(kind(c).alias("kind"), c["start"].alias("start"), c["end"].alias("end"), c["base"].alias("base"))).alias("spans"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, spans) of every row of ``docs``."""
    return classified(frames.written(candidates(docs), "candidates"))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))
    joined = lambda c: F.array_join(F.transform(c, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["base"])
    number = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == F.lit(kind))).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(number(k) for k in BASE), F.sha2(joined(base).cast("binary"), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans"))
