"""Commands on datasets: compact files (``*.traj``) or folders of Parquet tables.

``python -m trajspark info|create-test|ingest|export|mix|query|bench|schema|validate|merge|serve``
"""

from __future__ import annotations

import argparse
import os
import sys
import time
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession

from trajspark.operators import reports, validation
from trajspark.operators.dataset import Dataset, merge_counts, merge_datasets
from trajspark.operators.mixture import Mixture, parse_source
from trajspark.plans.kql import KqlParseError
from trajspark.service import Service
from trajspark.sinks.export import export
from trajspark.sources import compact, ingest, synth


def opened(spark: SparkSession, path: str) -> Dataset:
    """The dataset at a path: a compact file, or a folder that ``Dataset.save`` wrote."""
    path = compact.absolute(path)
    if path.endswith(".traj"):
        return compact.read(spark, path)
    if not os.path.isdir(f"{path}/episodes"):
        raise FileNotFoundError(path)
    return Dataset.load(spark, path, [t for t in ("frames", "images", "catalog") if os.path.isdir(f"{path}/{t}")])


def stored(data: Dataset, path: str, quality: int | None = None) -> None:
    path = compact.absolute(path)
    if path.endswith(".traj"):
        compact.write(data, path, quality)
    else:
        data.save(path)


def _show(rows: DataFrame) -> None:
    got = rows.collect()
    cells = [rows.columns, *([("" if v is None else f"{v:.1f}" if isinstance(v, float) else str(v)) for v in r] for r in got)]
    width = [max(len(r[k]) for r in cells) for k in range(len(rows.columns))]
    for r in cells:
        print("  ".join(v.ljust(w) for v, w in zip(r, width)).rstrip())


def info(spark: SparkSession, a: argparse.Namespace) -> None:
    data = opened(spark, a.path)
    _show(reports.info(data))
    for column in ("embodiment", "language_instruction"):
        rows = reports.listed(data, column).collect()
        print(f"{column}: " + ", ".join(r["value"] or "" for r in rows) + (f", … and {rows[0]['more']} more" if rows and rows[0]["more"] else ""))
    if a.episodes:
        _show(reports.episodes_table(data))


def create_test(spark: SparkSession, a: argparse.Namespace) -> None:
    stored(synth.create_test(spark, a.n, a.frames, a.images), a.path, a.compress)


def run_ingest(spark: SparkSession, a: argparse.Namespace) -> None:
    data = ingest.ingest(spark, a.source, a.format, a.embodiment, a.task, a.fps, a.max_episodes)
    stored(data, a.output, a.compress)
    print(reports.summary(opened(spark, a.output)))


def run_export(spark: SparkSession, a: argparse.Namespace) -> None:
    output = compact.absolute(a.output)
    export(opened(spark, a.path), output if a.format == "numpy" else f"{output}.json", a.format)


def mix(spark: SparkSession, a: argparse.Namespace) -> None:
    sources = {path: (opened(spark, path), weight) for path, weight in map(parse_source, a.source)}
    mixture = Mixture.of(sources, a.seed)
    _show(mixture.report(spark))
    if a.sample:
        _show(mixture.distribution(spark, a.sample))


def query(spark: SparkSession, a: argparse.Namespace) -> None:
    rows = opened(spark, a.path).query_table(a.kql, a.limit)
    _show(rows)


def schema(spark: SparkSession, a: argparse.Namespace) -> None:
    data = opened(spark, a.path)
    _show(reports.schema(data))
    _show(reports.sets(data))
    if data.images is not None:
        _show(reports.cameras(data))
    _show(reports.byte_budget(data).where("position = 0"))


def validate(spark: SparkSession, a: argparse.Namespace) -> None:
    try:
        data = opened(spark, a.path)
    except (OSError, compact.CompactError) as e:
        print(f"FATAL: {e}")
        return
    head = None if data.catalog is None else data.catalog.head()
    totals = (None, None) if head is None else (head["num_episodes"], head["num_frames"])
    found = validation.findings(data.episodes, data.frames, data.images, None, *totals)
    _show(found.orderBy("position", "timestep") if a.verbose else validation.first(found).drop("place"))
    _show(validation.report(found, data.episodes, data.frames, data.images))


def run_merge(spark: SparkSession, a: argparse.Namespace) -> None:
    inputs = [opened(spark, p) for p in a.inputs]
    stored(merge_datasets(inputs, a.filter), a.output)
    _show(merge_counts([d.episodes for d in inputs], a.filter).orderBy("input"))


def bench(spark: SparkSession, a: argparse.Namespace) -> None:
    folder = f"{compact.absolute(a.folder)}/bench-{time.time_ns()}"
    took: dict[str, float] = {}

    def timed(name: str, run):
        began = time.time()
        out = run()
        took[name] = time.time() - began
        return out

    data = timed("write", lambda: synth.create_bench(spark, a.n, a.frames, a.images).save(folder))
    order = spark.range(min(1000, a.n)).selectExpr("id AS place", f"(id * 7 + 13) % {a.n} AS position")
    timed("sequential read", lambda: data.nested().write.format("noop").mode("overwrite").save())
    timed("random read", lambda: data.fetch_positions(order).write.format("noop").mode("overwrite").save())
    timed("metadata", lambda: data.episodes.write.format("noop").mode("overwrite").save())
    for q in synth.BENCH_QUERIES:
        hits = timed(q, lambda q=q: data.query(q).count())
        print(f"{hits} hits: {q}")
    for name, seconds in took.items():
        print(f"{name}: {seconds * 1000:.0f} ms, {a.n / seconds:.0f} episodes/s")


def serve(spark: SparkSession, a: argparse.Namespace) -> None:
    from trajspark import server

    sources = {path: (opened(spark, path), weight) for path, weight in map(parse_source, a.source)}
    backend = Mixture.of(sources, a.seed) if sources else opened(spark, a.file)
    running = server.serve(Service(spark, backend, a.seed), a.port, a.bind)
    print(f"serving on {running.server_address[0]}:{running.server_address[1]}")
    try:
        while True:
            time.sleep(3600)
    except KeyboardInterrupt:
        running.shutdown()


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser("trajspark", description=__doc__)
    commands = top.add_subparsers(required=True)

    def command(name: str, run, *arguments: tuple) -> None:
        p = commands.add_parser(name)
        p.set_defaults(run=run)
        for names, options in arguments:
            p.add_argument(*names.split(), **options)

    images, compress, path = ("--images", {"action": "store_true"}), ("--compress", {"type": int}), ("path", {})
    command("info", info, path, ("--episodes", {"action": "store_true"}))
    command("create-test", create_test, ("path", {"nargs": "?", "default": "test.traj"}), ("-n", {"type": int, "default": 10}), ("--frames", {"type": int, "default": 50}), images, compress)
    command(
        "ingest", run_ingest, ("source", {}), ("-o --output", {"default": "output.traj"}), ("-F --format", {"default": "hdf5"}), ("-e --embodiment", {"default": "unknown"}), ("-t --task", {}),
        ("--fps", {"type": float}), ("--max-episodes", {"type": int}), compress,
    )
    command("export", run_export, path, ("-o --output", {"default": "export"}), ("-F --format", {"default": "numpy"}))
    command("mix", mix, ("-s --source", {"action": "append", "required": True}), ("--seed", {"type": int, "default": 42}), ("--sample", {"type": int}))
    command("query", query, path, ("kql", {}), ("--limit", {"type": int}))
    command("bench", bench, ("-n", {"type": int, "default": 500}), ("--frames", {"type": int, "default": 50}), images, ("--folder", {"default": "."}))
    command("schema", schema, path)
    command("validate", validate, path, ("--verbose", {"action": "store_true"}))
    command("merge", run_merge, ("inputs", {"nargs": "+"}), ("-o --output", {"default": "merged.traj"}), ("-F --filter", {}))
    command("serve", serve, ("file", {"nargs": "?"}), ("-s --source", {"action": "append", "default": []}), ("-p --port", {"type": int, "default": 50051}), ("--bind", {"default": "127.0.0.1"}), ("--seed", {"type": int, "default": 42}))
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("trajspark").getOrCreate()
    try:
        a.run(spark, a)
    except (KqlParseError, ValueError, FileNotFoundError) as e:
        print(f"error: {e}", file=sys.stderr)
        return 1
    return 0
