"""Validation: what is wrong with a dataset, as rows, and the verdict."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from trajspark.functions import scalars


def findings(episodes: DataFrame, frames: DataFrame, images: DataFrame | None = None, index: DataFrame | None = None, num_episodes: int | None = None, num_frames: int | None = None) -> DataFrame:
    """(position, timestep, check, severity, message): what validation finds in metadata, frames and images.

    Frames and images belong to episodes by ``episode_id``, or else by ``position`` (and
    ``dataset``). Checks on action, state, is_terminal and image sizes run where the columns
    are there; ``index`` (position, num_frames, action_dim) and the two totals where given.
    """

    def key(rows: DataFrame) -> list[str]:
        return ["episode_id"] if "episode_id" in rows.columns else [c for c in ("dataset", "position") if c in rows.columns and c in episodes.columns]

    def found(rows: DataFrame, check: str, severity: str, *message: str | Column, timestep: Column | None = None, position: Column | None = None) -> DataFrame:
        text = F.concat(*(F.lit(m) if isinstance(m, str) else F.coalesce(m.cast("string"), F.lit("null")) for m in message))
        at = F.lit(None) if timestep is None else timestep
        return rows.select((F.col("position") if position is None else position).cast("long").alias("position"), at.cast("long").alias("timestep"), F.lit(check).alias("check"), F.lit(severity).alias("severity"), text.alias("message"))

    e = F.col
    out = [found(episodes.where(e("episode_id") != e("position")), "id_mismatch", "warning", "id is ", e("episode_id"))]
    for c, name in (("embodiment", "empty_embodiment"), ("language_instruction", "empty_task")):
        out.append(found(episodes.where(F.coalesce(e(c), F.lit("")) == ""), name, "warning", "empty ", c))
    for n, had, name in ((num_episodes, F.count("*"), "total_episodes"), (num_frames, F.coalesce(F.sum("num_frames"), F.lit(0)), "total_frames")):
        if n is not None:
            out.append(found(episodes.agg(had.alias("had")).where(e("had") != n), name, "error", f"{n} stated, found ", e("had"), position=F.lit(None)))
    if index is not None:
        by = [c for c in ("dataset", "position") if c in index.columns and c in episodes.columns]
        both = episodes.join(index.select(*by, *(e(c).alias(f"index_{c}") for c in ("num_frames", "action_dim")), F.lit(True).alias("in_index")), by, "left")
        out.append(found(both.where(e("in_index").isNull()), "missing_index", "error", "no index entry"))
        for c in ("num_frames", "action_dim"):
            out.append(found(both.where(e("in_index") & ~e(c).eqNullSafe(e(f"index_{c}"))), f"index_{c}", "error", e(c), " in metadata, in the index ", e(f"index_{c}")))

    on, has = key(frames), set(frames.columns)
    length = lambda c: F.coalesce(F.size(c), F.lit(0))
    of = {"n": F.count("*")}
    if "state" in has:
        of["first_state"] = F.min_by(length("state"), "timestep")
    if "is_terminal" in has:
        of["ends"] = F.max_by(F.coalesce("is_terminal", F.lit(False)), "timestep")
    seen = frames.groupBy(*on).agg(*(c.alias(name) for name, c in of.items()))
    whole = episodes.select(*dict.fromkeys([*on, "position", "num_frames", "action_dim"])).join(seen, on, "left")
    n = F.coalesce("n", F.lit(0))
    out.append(found(whole.where(n != e("num_frames")), "frame_count", "error", n, " frames, metadata say ", e("num_frames")))
    if "is_terminal" in has:
        out.append(found(whole.where((n > 0) & ~e("ends")), "last_not_terminal", "warning", "last frame is not terminal"))
    vectors = [c for c in ("action", "state") if c in has]
    if vectors:
        each = frames.select(*dict.fromkeys([*on, "timestep", *vectors])).join(whole.drop("n", "ends"), on)
        if "action" in has:
            out.append(found(each.where(length("action") != e("action_dim")), "action_length", "error", length("action"), " values, action_dim is ", e("action_dim"), timestep=e("timestep")))
        if "state" in has:
            out.append(found(each.where(length("state") != e("first_state")), "state_length", "error", length("state"), " values, frame 0 has ", e("first_state"), timestep=e("timestep")))
        for c in vectors:
            values = each.where(scalars.non_finite(F.col(c))).select("position", "timestep", F.posexplode(c).alias("dim", "x"))
            bad = values.where(F.isnan("x") | (F.abs("x") == float("inf")))
            out.append(found(bad, f"nonfinite_{c}", "warning", f"{c}[", e("dim"), "] is ", e("x"), timestep=e("timestep")))
    if images is not None and {"width", "height", "channels"} <= set(images.columns):
        on = key(images)
        sized = images.join(episodes.select(*dict.fromkeys([*on, "position"])), on)
        want, has_bytes = e("width").cast("long") * e("height") * e("channels"), F.coalesce(F.octet_length("data"), F.lit(0))
        out.append(found(sized.where(has_bytes != want), "image_length", "error", e("camera"), ": ", has_bytes, " bytes, not ", want, timestep=e("timestep")))
    total = out[0]
    for more in out[1:]:
        total = total.unionByName(more)
    return total


def report(found: DataFrame, episodes: DataFrame, frames: DataFrame, images: DataFrame | None = None) -> DataFrame:
    """One row: episodes, frames and images checked, errors, warnings, and the verdict."""
    counts = found.agg(F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    checked = episodes.agg(F.count("*").alias("episodes_checked")).crossJoin(frames.agg(F.count("*").alias("frames_checked")))
    checked = checked.crossJoin(images.agg(F.count("*").alias("images_checked"))) if images is not None else checked.withColumn("images_checked", F.lit(0).cast("long"))
    both = checked.crossJoin(counts)  # one row each
    warned = F.concat(F.lit("PASSED with "), F.col("warnings"), F.lit(" warnings"))
    return both.withColumn("verdict", F.when(F.col("errors") > 0, "FAILED").when(F.col("warnings") > 0, warned).otherwise("PASSED"))


def first(found: DataFrame, n: int = 10) -> DataFrame:
    """The first findings of each severity, by position and frame."""
    from pyspark.sql.window import Window

    w = Window.partitionBy("severity").orderBy("position", "timestep", "check", "message")
    return found.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n)
