"""The pipeline on a small folder, stage by stage against plain versions."""

import random

import pyarrow as pa
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from trajspark.llm import frames, pieces, quality, secrets

DOCS = "doc_id long, text string, _quality string, _id string, n_chars long"
ITEM = "this is the benchmark item that must not occur in any of the training documents"


def texts():
    r = random.Random(7)
    plain = [" ".join(r.choice("river stone house garden letter winter music bread paper window".split()) + str(r.randint(0, 99)) for _ in range(60)) + "." for _ in range(40)]
    noise = ["buy !!! $$$ " * r.randint(3, 30) for _ in range(20)]
    return plain + noise + [plain[3], plain[3] + " more", plain[5] + " " + ITEM, " ".join(plain[6].split()[::-1]) + ' token="abcdef0123456789"', None, "", "one two"]


def shingles(text):
    w = (text or "").lower().replace(".", " ").split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    d = str(tmp_path_factory.mktemp("p"))
    rows = [(k, t, "q", "i", None if t is None else len(t)) for k, t in enumerate(texts())]
    for name, data, schema in (("documents", rows, DOCS), ("labels", [(k, int(k < 40)) for k in range(60)], "doc_id long, quality int"), ("benchmark", [(0, ITEM), (1, None)], "item_id long, text string")):
        spark.createDataFrame(data, schema).write.parquet(f"{d}/{name}.parquet")
        spark.createDataFrame([], schema).coalesce(1).write.parquet(f"{d}/empty/{name}.parquet")
    return d


def plain_good(spark, folder, before):
    labels = spark.read.parquet(f"{folder}/labels.parquet").select("doc_id", F.col("quality").alias("label"))
    model = quality.fit(spark.read.parquet(f"{folder}/documents.parquet"), labels.where(frames.remainder("doc_id", 5) != 0))
    x = quality.statistics(pa.array([t[1] for t in before], pa.string()))
    total = model["bias"] + sum((w * quality.holds(rule, x) for w, rule in model["rules"]), 0 * x[:, 0])
    return [row for row, s in zip(before, total) if 1 / (1 + quality.np.exp(-s)) >= quality.THRESHOLD]


def plain_one_of_each(before):
    sets, label = [shingles(t[1]) for t in before], list(range(len(before)))
    for a in range(len(before)):
        for b in range(a):
            if sets[a] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and label[a] != label[b]:
                label = [min(label[a], label[b]) if v in (label[a], label[b]) else v for v in label]
    return [row for k, row in enumerate(before) if label[k] == k]


def test_stages_equal_plain_versions(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, now, results = docs.columns, docs, []
    for _, stage in corpus_pipeline.STAGES:
        now = frames.written(stage(spark, now, folder), "stage")
        results.append(now)
    rows = lambda df: sorted(map(tuple, df.collect()))
    assert all(df.columns == columns for df in results[:-1])
    want = plain_good(spark, folder, sorted(map(tuple, docs.collect())))
    assert rows(results[0]) == want and len(texts()) > len(want) > 30
    fewer = plain_one_of_each(want)
    assert rows(results[1]) == fewer and len(fewer) < len(want)
    item = shingles(ITEM)
    clean = [row for row in fewer if len(item & shingles(row[1])) < 0.8 * len(item)]
    assert rows(results[2]) == clean and len(clean) < len(fewer)
    masked = [(k, t, q, i, n if t is None else len(t)) for k, t, q, i, n in ((k, secrets.masked(t), q, i, n) for k, t, q, i, n in clean)]
    assert rows(results[3]) == masked and masked != clean
    sp = sentencepiece.SentencePieceProcessor(model_proto=pieces.model_bytes())
    coded = [(k, sp.encode(t or "")) for k, t, *_ in masked]
    want = [(k, ids, len(ids), sp.decode(ids)) for k, ids in coded]
    assert [(k, list(ids), n, t or "") for k, ids, n, t in rows(results[4])] == want
    assert rows(corpus_pipeline.run(spark, folder)) == rows(results[4])


def test_empty_tables(spark, folder):
    assert corpus_pipeline.run(spark, f"{folder}/empty").count() == 0
