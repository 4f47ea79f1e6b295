"""Very long texts, clashing columns, ties and repeated rows; urls, fingerprints and containment against plain versions."""

import base64
import hashlib
import random
import re
import time

import pytest
from pyspark.sql import functions as F

from trajspark.llm import decontamination, fingerprints, language, near_duplicates, personal, pieces, quality, secrets, toxicity, urls
from trajspark.operators import ranges

LONG = 400_000


@pytest.fixture(scope="module")
def long_docs(spark):
    words = " ".join(f"w{k % 50021}" for k in range(LONG // 7))
    rows = [(1, words), (2, words + " end"), (3, "a" * LONG), (4, "12 a " * (LONG // 5)), (5, "漢字" * (LONG // 2)), (6, "the cat and the dog are here")]
    return spark.createDataFrame([(k, t, "x", 1, "y", 2) for k, t in rows], "doc_id long, text string, lang string, score int, spans string, key int").repartition(2).cache()


def test_long_texts(spark, long_docs):
    n = {1: True, 2: True, 3: True, 4: True, 5: True, 6: True}
    empty = (toxicity.np.zeros(0, int), toxicity.np.zeros(0), 0.0)
    assert {r["doc_id"]: r["toxicity"] == 0.5 for r in toxicity.score(long_docs, empty).collect()} == n
    model = language.Model(["x"], toxicity.np.ones(language.DIMS), toxicity.np.ones((language.DIMS, 1)), 1.0)
    assert {r["doc_id"]: r["lang_pred"] == "x" for r in language.predict(long_docs, model).collect()} == n
    assert quality.score(long_docs, {"bias": 0.0, "rules": []}).count() == 6
    assert {r["doc_id"]: r["class_id"] for r in near_duplicates.classes(long_docs).collect()} == {1: 1, 2: 1, 3: 3, 4: 4, 5: 5, 6: 6}
    items = spark.createDataFrame([(0, " ".join(f"w{k}" for k in range(49990, 50010)), "z")], "item_id long, text string, doc_id string")
    assert sorted(r["doc_id"] for r in decontamination.contained(long_docs, items).collect()) == [1, 2]
    likeness = {r["doc_id"]: fingerprints.likeness for r in fingerprints.with_next(long_docs).select("doc_id").collect()}
    assert sorted(likeness) == [1, 2, 3, 4, 5, 6]
    assert personal.candidates(long_docs).where("doc_id = 4").select(F.size("found")).first()[0] == LONG // 5
    assert pieces.round_trip(long_docs.where("doc_id <> 1").select("doc_id", "text"), pieces.model_bytes()).count() == 5
    assert {r["doc_id"]: len(r["secrets"]) for r in secrets.scan(long_docs).collect()}[3] == 1


def test_hard_texts_take_linear_time():
    for t in ("eyJa" * 60_000, "eyJa." * 60_000, "-----BEGIN A " * 30_000, "token " * 40_000, "AKIA" * 60_000, "ab" * 100_000):
        began = time.time()
        secrets.spans(t)
        assert time.time() - began < 3


def test_web_tokens_equal_a_plain_search():
    head = base64.urlsafe_b64encode(b'{"alg":1}').decode().rstrip("=")
    exact = re.compile(r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
    r = random.Random(6)
    for _ in range(3000):
        t = "".join(r.choice([head, "eyJ", "eyJx", ".", ".", " ", "a", "eyJhIjoxfQ", "é"]) for _ in range(r.randint(1, 14)))
        want, at = [], 0
        while m := exact.search(t, at):
            at = m.end()
            if secrets._jwt_ok(m[0].encode()):
                want.append(("jwt", m.start(), m.end()))
        assert [s for s in secrets.spans(t) if s[0] == "jwt"] == want, t


def test_clashing_columns(spark, long_docs):
    some = long_docs.where("doc_id in (3, 6)")
    assert secrets.scan(some, "spans").columns[-1] == "spans_"
    assert decontamination.clean(some.withColumn("_bad", F.lit(1)), spark.createDataFrame([(0, "the cat and the dog")], "item_id long, text string")).select("doc_id", "_bad").collect() == [(3, 1)]
    assert personal.scan(some).columns == ["doc_id", "spans"]
    assert language.predict(some, language.Model([], toxicity.np.ones(1), toxicity.np.ones((1, 1)), 1.0)).columns[-2:] == ["lang_pred", "score_"]
    assert fingerprints.with_sketches(some.withColumn("_k", F.lit(1)).withColumn("_w", F.lit("w")), "text", "out").columns == [*some.columns, "_k", "_w", "out"]
    pages = spark.createDataFrame([(1, "http://net/es/", "h", "p", 3)], "page_id long, url string, host string, path string, key int")
    assert urls.judge(pages, urls.RULES).collect() == [(1, "net", "/es/", "net/es/", "block")]


# urls --------------------------------------------------------------------------------


def plain_verdict(url, rules):
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0].lower()
        path = re.match(r"[^/?#]*([^?#]*)", rest)[1]
    fits = [(len(h) + len(p), len(h), h + p, v) for v, h, p in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return (host, path, max(fits)[2], max(fits)[3]) if fits else (host, path, None, "allow")


@pytest.mark.parametrize("few", [100_000, 0])
def test_url_rules_equal_plain_search(spark, monkeypatch, few):
    monkeypatch.setattr(urls, "BROADCAST_RULES", few)
    monkeypatch.setattr(urls, "RANGE_KEYS", 100)
    r = random.Random(1)
    hosts = ["a.b.com", "b.com", "com", "x.com", "c.b.com", "net", "a.net", ""]
    paths = ["/", "/e", "/en/", "/en/x", "/en/x/y", "", "/é", "/\U0010ffff"]
    rules = [(r.choice(["allow", "block"]), r.choice(hosts), r.choice(paths)) for _ in range(25)] + [("block", "many.com", f"/{k}/") for k in range(400)]
    rows = [(k % 7 if k % 5 else None, r.choice(["http://", "x://", ""]) + r.choice(hosts + ["q." + h for h in hosts]) + r.choice(paths) + r.choice(["", "?q", "#f", "z"])) for k in range(400)]
    rows += [(1, None), *[(5, "http://b.com/en/")] * 300, *[(6, f"x://w.many.com/{k}/{k}") for k in range(0, 500, 7)]]
    got = urls.judge(spark.createDataFrame(rows, "page_id long, url string"), rules).collect()
    assert sorted(map(str, map(tuple, got))) == sorted(str((k, *plain_verdict(u, rules))) for k, u in rows)


def test_ranges_are_ordered_and_divide_a_hot_key(spark):
    rows = [(k,) for k in range(300)] + [(77,)] * 600 + [(None,)] * 500
    df = spark.createDataFrame(rows, "k long").withColumn("by", F.xxhash64(F.monotonically_increasing_id()))
    got = ranges.even(df, "k", 40).numbered(df, "k", "by", "r").collect()
    ordered = sorted(got, key=lambda x: (x["k"] is not None, x["k"] or 0, x["by"]))
    assert [x["r"] for x in ordered] == sorted(x["r"] for x in got)
    sizes = {r: sum(x["r"] == r for x in got) for r in {x["r"] for x in got}}
    assert max(sizes.values()) < 120 and len({x["r"] for x in got if x["k"] == 77}) > 5


# fingerprints ------------------------------------------------------------------------


def plain_sketches(t):
    """The sketches of a text by plain loops, with the library's hash of tuples of numbers replaced by Spark's."""
    words = re.sub(r"[^\w]|_", " ", (t or "").lower()).split()
    k = fingerprints.K
    return [tuple(words[i : i + k]) for i in range(len(words) - k + 1)] if len(words) >= k else [tuple(words + [""] * (k - len(words)))] if words else []


def test_sketches_equal_plain_selection(spark):
    r = random.Random(2)
    rows = [" ".join(r.choice("abcdefghijklmnop") for _ in range(n)) for n in (0, 1, 2, 3, 10, 60, 200, 500)] + [None, "x y " * 100]
    df = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = {x["doc_id"]: x["s"] for x in fingerprints.with_sketches(df, "text", "s").collect()}
    signed = lambda v: (v + (1 << 63)) % (1 << 64) - (1 << 63)
    bits = fingerprints._PLACE_BITS

    def hashes(column, kind, values):
        table = spark.createDataFrame([(k, v) for k, v in enumerate(values)], f"k int, v {kind}")
        return [x[0] for x in table.orderBy("k").select(column).collect()]

    for doc, t in enumerate(rows):
        grams = plain_sketches(t)
        if not grams:
            assert got[doc] == []
            continue
        h = [v >> bits for v in hashes(F.xxhash64(F.col("v")[0], F.col("v")[1]), "array<string>", [list(g) for g in grams])]
        seen, numbered = {}, []
        for place, v in enumerate(h):
            numbered.append((v, seen.get(v, 0), place))
            seen[v] = numbered[-1][1] + 1
        e = hashes(F.xxhash64(F.col("v.h"), F.col("v.o")), "struct<h: long, o: int>", [(v, o) for v, o, _ in numbered])
        # 33 bits of hash over the place, ordered as signed numbers
        elements = sorted(((x >> bits << bits) | place, place, (x % (1 << 64)) >> bits) for x, (_, _, place) in zip(e, numbered))
        kept, bins = [], {}
        for x, place, code in elements:
            b = (x >> (64 - fingerprints._BITS)) + fingerprints.SKETCHES // 2
            if bins.setdefault(b, 0) < fingerprints.TAKE:
                kept.append((b, place, code))
                bins[b] += 1
        tuples, order = [], [b for b, _, _ in kept]
        last_start = None
        edges = [i for i, b in enumerate(order) if i == 0 or order[i - 1] != b]
        low = 0
        for i in edges:
            chosen = sorted(kept[(i + j) % len(kept)][1:] for j in range(fingerprints.TAKE))
            tuples += [(b, [c for _, c in chosen]) for b in range(low, order[i] + 1)]
            low = order[i] + 1
            last_start = chosen if last_start is None else last_start
        tuples += [(b, [c for _, c in last_start]) for b in range(low, fingerprints.SKETCHES)]
        digests = hashes(F.xxhash64("v"), "array<long>", [codes for _, codes in tuples])
        assert got[doc] == [signed((d & -fingerprints.SKETCHES) | b) for d, (b, _) in zip(digests, tuples)], t
        assert len(got[doc]) == fingerprints.SKETCHES


def test_likeness_follows_order_and_edits(spark):
    r = random.Random(3)
    words = [f"w{k}" for k in range(300)]
    turned = words[150:] + words[:150]
    mixed = words[:]
    r.shuffle(mixed)
    edits = [w if r.random() > 0.05 else "new" for w in words]
    rows = [" ".join(w) for w in (words, words, edits, turned, mixed, ["other"] * 300)]
    df = spark.createDataFrame([(rows[0], t) for t in rows], "a string, b string")
    out = fingerprints.with_sketches(fingerprints.with_sketches(df, "a", "x"), "b", "y")
    got = [x[0] for x in out.select(fingerprints.likeness(F.col("x"), F.col("y"))).collect()]
    assert got[0] == got[1] == 1.0
    assert got[2] > 0.75 and got[2] > got[3] > got[4] and got[5] == 0.0


def test_next_document_with_ties_and_other_ids(spark, monkeypatch):
    monkeypatch.setattr(fingerprints, "RANGE_BYTES", 40)
    r = random.Random(9)
    rows = [(r.choice([None, 1, 2, 3, 7, *range(10, 40)]), f"text {k % 50} of many") for k in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    for d in (df, df.withColumn("doc_id", F.lpad(F.col("doc_id").cast("string"), 4, "0"))):
        hashed = [(x[0], x[1], x[2]) for x in d.select("doc_id", F.xxhash64("text"), "text").collect()]
        ordered = sorted(hashed, key=lambda x: (x[0] is not None, x[0] if x[0] is not None else 0, x[1]) if x[0] is None or isinstance(x[0], int) else (True, x[0], x[1]), reverse=True)
        want = sorted(((a[0], a[2], b[2]) for a, b in zip(ordered, ordered[1:] + ordered[:1])), key=str)
        assert sorted(((x["doc_id"], x["text"], x["next_text"]) for x in fingerprints.with_next(d).collect()), key=str) == want


def test_edited_text_of_the_last_document(spark, tmp_path):
    rows = [(5, "abcdef"), (3, "xyzuvw"), (1, "é😀mn")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["doc_id"]: r["edited_sha256"] for r in fingerprints.query(spark, str(tmp_path)).collect()}
    assert got == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in ((5, "abcxyz"), (3, "xyzé😀m"), (1, "é😀ab"))}


# containment -------------------------------------------------------------------------


@pytest.mark.parametrize("small", [True, False])
def test_containment_equals_plain_search(spark, monkeypatch, small):
    if not small:
        monkeypatch.setattr(decontamination, "BROADCAST_ROWS", 0)
        monkeypatch.setattr(decontamination, "BROADCAST_SHINGLES", 0)
    r = random.Random(11)
    some = "alpha beta gamma delta eps zeta eta theta".split()
    items = [(k % 30 if k < 32 else None, " ".join(r.choice(some) for _ in range(r.randint(0, 25)))) for k in range(34)]
    docs = []
    for k in range(60):
        w = [r.choice(some) for _ in range(r.randint(0, 200))]
        if k % 2:
            it = r.choice(items)[1].split()
            if it and r.random() < 0.5:
                it[r.randrange(len(it))] = "changed"
            w[len(w) // 2 : len(w) // 2] = it
        docs.append((k if k % 11 else None, " ".join(w)))
    docs += [(3, docs[1][1]), (3, docs[1][1]), (4, None)]

    def shingles(t):
        w = (t or "").split()
        return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()

    want = {}
    for d, t in docs:
        for i, u in items:
            a, b = shingles(t), shingles(u)
            if b and len(a & b) / len(b) >= 0.8 - 1e-12:
                want[d, i] = max(want.get((d, i), 0), len(a & b) / len(b))
    got = decontamination.contained(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")).collect()
    assert {(x["doc_id"], x["item_id"]): x["containment"] for x in got} == pytest.approx(want) and len(got) == len(want) > 5
