"""The learnt operators against plain loops, and their accuracy on rows that were not learnt from."""

import math
import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from trajspark.llm import frames, language, personal, quality, text, toxicity

SMALL = "/root/testdata/sf0.01"


def one_hash(words):
    """The hash of one word tuple, by the vectorised code on a text of these words alone."""
    w = next(text.words(pa.array([" ".join(words)])))[2]
    return w.hash


def toxic_rows(n=160, seed=2):
    r = random.Random(seed)
    calm, rude = "the river runs past old stone house and garden".split(), ["idiot", "scum", "vermin"]
    rows = []
    for k in range(n):
        words = [r.choice(calm) for _ in range(r.randint(0, 25))]
        if k % 3 == 0:
            words[r.randrange(len(words) + 1) : 0] = [r.choice(rude), r.choice(rude)]
        rows.append((" ".join(words), float(k % 3 == 0)))
    return rows


def plain_features(t):
    """Distinct hashed words, neighbours, and pairs that skip one or two words."""
    words = re.findall(r"[^\W_]+", (t or "").lower())
    hashes = [one_hash([w])[0] for w in words]
    out = set()
    for steps in toxicity.TUPLES:
        for i in range(len(words) - (steps[-1] if steps else 0)):
            h = np.array([hashes[i]], np.uint64)
            for k, s in enumerate(steps, 1):
                h = text.mix(h * np.uint64(0xC2B2AE3D27D4EB4F + 2 * s) + np.array([hashes[i + s]], np.uint64) + np.uint64(k))
            out.add(int(h[0]) & (toxicity.DIMS - 1))
    return out


def test_toxicity_equals_plain_ftrl():
    rows = toxic_rows() + [("", 0.0), (None, 1.0)]
    model = toxicity.fit_rows(pa.table({"text": pa.array([t for t, _ in rows]), "label": [y for _, y in rows]})).to_pydict()
    x = [sorted(plain_features(t)) for t, _ in rows]
    tag = [int(text.mix(np.array([sum(f) + 1], np.uint64))[0]) for f in x]
    z, n, bias, bias_n = Counter(), Counter(), 0.0, 0.0

    def weight(k):
        if abs(z[k]) <= toxicity.L1:
            return 0.0
        return (math.copysign(toxicity.L1, z[k]) - z[k]) / ((toxicity.BETA + math.sqrt(n[k])) / toxicity.ALPHA + toxicity.L2)

    for _ in range(toxicity.EPOCHS):
        for i in sorted(range(len(rows)), key=lambda i: (tag[i], rows[i][1])):
            w = {k: weight(k) for k in x[i]}
            g = 1 / (1 + math.exp(-(bias + sum(w.values())))) - rows[i][1]
            for k in x[i]:
                z[k] += g - (math.sqrt(n[k] + g * g) - math.sqrt(n[k])) / toxicity.ALPHA * w[k]
                n[k] += g * g
            bias_n += g * g
            bias -= toxicity.ALPHA * g / (toxicity.BETA + math.sqrt(bias_n))
    want = {k: weight(k) for k in z if weight(k)}
    got = dict(zip(model["index"], model["weight"]))
    assert got.pop(-1) == pytest.approx(bias)
    assert got == pytest.approx(want) and len(want) > 5
    index = np.array(sorted(got), np.int64)
    scored = toxicity.score_texts(pa.array([t for t, _ in rows]), index, np.array([got[k] for k in sorted(got)]), bias)
    assert scored == pytest.approx([1 / (1 + math.exp(-(bias + sum(want.get(k, 0) for k in f)))) for f in x])


def plain_grams(t):
    out = Counter()
    for i in range(len(t)):
        for n in (1, 2, 3):
            if i + n <= len(t):
                c = np.array([ord(x) for x in t[i : i + n]], np.uint32)
                h = (c[:1] + np.uint32(1)) * np.uint32(0x9E3779B1)
                for x in c[1:]:
                    h = (h ^ (h >> np.uint32(15))) * np.uint32(0x85EBCA77) + x * np.uint32(0xC2B2AE3D)
                out[int(h[0] >> np.uint32(32 - language.BITS))] += 1
    return out


def test_language_equals_plain_ftrl(monkeypatch):
    monkeypatch.setattr(language, "EPOCHS", 1)
    r = random.Random(3)
    some = {"en": "the river and a house of stone".split(), "de": "der fluss und ein haus aus stein".split(), "fr": "la maison près du fleuve été".split()}
    rows = [(" ".join(r.choice(some[c]) for _ in range(r.randint(1, 6))), c) for c in some for _ in range(12)]
    classes, idf = sorted(some), np.ones(language.DIMS) * 1.5
    got = language.fit_rows(pa.table({"text": [t for t, _ in rows], "lang": [c for _, c in rows]}), idf, classes).to_pydict()
    xs = []
    for (index, n), (t, _) in zip(language.counts(pa.array([t for t, _ in rows])), rows):
        assert dict(zip(index.tolist(), n.tolist())) == plain_grams(t)
        v = {k: (1 + math.log(c)) * 1.5 for k, c in plain_grams(t).items()}
        xs.append({k: x / math.sqrt(sum(y * y for y in v.values())) for k, x in v.items()})
    tag = [int(text.mix(np.array([sum(x) * 31 + len(x)], np.uint64))[0]) for x in xs]
    y = [classes.index(c) for _, c in rows]
    z, g2 = Counter(), Counter()

    def weight(k, c):
        a = z[k, c]
        return 0.0 if abs(a) <= language.L1 else (math.copysign(language.L1, a) - a) / ((language.BETA + math.sqrt(g2[k, c])) / language.ALPHA + language.L2)

    for i in sorted(range(len(rows)), key=lambda i: (tag[i], y[i])):
        w = {(k, c): weight(k, c) for k in xs[i] for c in range(3)}
        logits = [sum(v * w[k, c] for k, v in xs[i].items()) for c in range(3)]
        total = sum(math.exp(a) for a in logits)
        for c in range(3):
            miss = math.exp(logits[c]) / total - (c == y[i])
            for k, v in xs[i].items():
                g = v * miss
                z[k, c] += g - (math.sqrt(g2[k, c] + g * g) - math.sqrt(g2[k, c])) / language.ALPHA * w[k, c]
                g2[k, c] += g * g
    for k, row in zip(got["index"], got["weights"]):
        assert row == pytest.approx([1.0] * 3 if k < 0 else [weight(k, c) for c in range(3)], abs=1e-9)
    assert len(got["index"]) > 20


def test_quality_rules_equal_plain_evaluation(spark):
    r = random.Random(4)
    good = [" ".join(r.choice("river stone house garden letter".split()) for _ in range(40)) + "." for _ in range(120)]
    bad = ["buy $$$ now !!! " * r.randint(2, 20) for _ in range(120)]
    rows = [(k, t, 1 if k < 120 else 0) for k, t in enumerate(good + bad)] + [(900, "", 0), (901, None, 0)]
    x, y = quality.statistics(pa.array([t for _, t, _ in rows])), np.array([float(v) for _, _, v in rows])
    model = quality.fit_rows(x, y)
    assert model["rules"]

    def plain(values):
        total = model["bias"]
        for weight, rule in model["rules"]:
            if all((values[f] > cut) if above else (values[f] <= cut) for f, above, cut in rule):
                total += weight
        return 1 / (1 + math.exp(-total))

    got = {r["doc_id"]: r["quality"] for r in quality.score(spark.createDataFrame([(k, t) for k, t, _ in rows], "doc_id long, text string"), model).collect()}
    assert got == pytest.approx({k: plain(values) for (k, _, _), values in zip(rows, x)})
    # the weights are a minimum of the penalised loss: no single step along a rule lowers it
    kept = [rule for _, rule in model["rules"]]
    hold = np.stack([quality.holds(rule, x) for rule in kept], 1).astype(float)
    scale = np.maximum(hold.std(0), 1e-6)
    w = np.array([v for v, _ in model["rules"]])

    def loss(w):
        m = model["bias"] + hold @ w
        return (np.logaddexp(0, m) - y * m).mean() + quality.LASSO * np.abs(w * scale).sum()

    for k in range(len(w)):
        for d in (-0.05, 0.05):
            moved = w.copy()
            moved[k] += d
            assert loss(moved) > loss(w) - 1e-4
    for (_, t, _), s in zip(rows, x):
        words = re.findall(r"[^\W_]+", t or "")
        assert (s[0], s[1]) == (len(t or ""), len(words))
        assert s[3] == pytest.approx(len(set(words)) / max(1, len(words)))


@pytest.fixture(scope="module")
def truth(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SMALL}/labels.parquet")
    return {r["doc_id"]: r for r in docs.join(labels, "doc_id", "left").collect()}


def test_held_out_accuracy(spark, truth):
    lang = [r for r in language.query(spark, SMALL).collect() if r["held_out"] and truth[r["doc_id"]]["lang"]]
    hits = sum(r["lang_pred"] == truth[r["doc_id"]]["lang"] for r in lang)
    print(f"language ID: {hits} of {len(lang)} held-out documents")
    assert hits >= 0.95 * len(lang) and len(lang) > 100
    for module, label in ((toxicity, "toxic"), (quality, "quality")):
        got = [(r["score"], truth[r["doc_id"]][label]) for r in module.query(spark, SMALL).collect() if r["held_out"] and truth[r["doc_id"]][label] is not None]
        up, down = [s for s, y in got if y == 1], [s for s, y in got if y == 0]
        auc = sum((a > b) + (a == b) / 2 for a in up for b in down) / (len(up) * len(down))
        print(f"{label}: AUC {auc:.3f} on {len(up)} + {len(down)} held-out labels")
        assert auc >= 0.85


def test_em_finds_known_reliabilities():
    r = np.random.default_rng(5)
    true = r.random(40000) < 0.3
    right = [0.97, 0.85, 0.8, 0.75, 0.7]
    votes = np.stack([np.where(r.random(len(true)) < p, true, ~true) * 2 - 1 for p in right], 1)
    patterns, back, count = np.unique(votes, axis=0, return_inverse=True, return_counts=True)
    prior, tables, post = personal.reliabilities(patterns, count.astype(float))
    assert prior == pytest.approx(0.3, abs=0.05)
    assert [t[1, 2] for t in tables] == pytest.approx(right, abs=0.06) and [t[0, 0] for t in tables] == pytest.approx(right, abs=0.06)
    assert ((post[back.ravel()] > 0.5) == true).mean() > 0.97
    bias, weights = personal.span_classifier(patterns, count.astype(float), post)
    says = 1 / (1 + np.exp(-(bias + sum(weights[j, patterns[:, j] + 1] for j in range(5)))))
    assert ((says > 0.5) == (post > 0.5))[back.ravel()].mean() > 0.98


def test_posterior_adds_spans_that_labelers_agree_on(spark):
    sure = [f"please call (212) 555-01{k % 90 + 10} today" for k in range(60)]
    weak = [f"version x{k}(099) 155-01{k % 90 + 10}y" for k in range(60)]
    found = personal.scan(spark.createDataFrame(list(enumerate(sure + weak)), "doc_id long, text string")).collect()
    kinds = {r["doc_id"]: [s["kind"] for s in r["spans"]] for r in found}
    assert all(kinds[k] == ["local_phone"] for k in range(60)) and not any(kinds[k] for k in range(60, 120))


def test_account_check_digits(spark):
    rows = [("DE89 3704 0044 0532 0130 00", True), ("GB82WEST12345698765432", True), ("DE88 3704 0044 0532 0130 00", False)]
    df = spark.createDataFrame(rows, "m string, ok boolean")
    assert [(r[0], r[1]) for r in df.select(personal.passes("account", F.col("m")), "ok").collect()] == [(ok, ok) for _, ok in rows]


def test_fit_sample_stays_within_its_bytes(spark):
    rows = spark.range(4000).select(F.concat(F.lit("x" * 1000), "id").alias("text"), F.lit(1.0).alias("label"))
    seen = frames.trained(rows, "n long, bytes long", lambda t: pa.table({"n": [t.num_rows], "bytes": [sum(len(x) for x in t.column("text").to_pylist())]}), 200_000)
    again = frames.trained(rows.orderBy(F.desc("text")), "n long, bytes long", lambda t: pa.table({"n": [t.num_rows], "bytes": [sum(len(x) for x in t.column("text").to_pylist())]}), 200_000)
    assert seen == again and 100 < seen[0]["n"] < 220
