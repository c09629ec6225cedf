"""Tuner trials: candidates, lineage, rungs and early stopping."""

from __future__ import annotations

import math
from collections.abc import Mapping, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from siterank.functions.numbers import hash_uniform
from siterank.operators.ordering import attach, over_rows, with_position

# Trials with at most this many epochs are folded in one row; longer ones in chunks.
FOLD_EPOCHS = 10_000

# Rows of long curves, about, that one call turns into maps.
BUCKET_ROWS = 100_000


# --- candidates ----------------------------------------------------------------------

def param_grid(df: DataFrame, choices: Mapping[str, Sequence | Column]) -> DataFrame:
    """Every combination of the choices for each row of ``df``.

    A choice is a list or an array column, such as ``F.sequence`` over a range.
    """
    for name, values in choices.items():
        values = values if isinstance(values, Column) else F.array(*(F.lit(v) for v in values))
        df = df.select("*", F.explode(values).alias(name))
    return df


def int_uniform(low: int, high: int):
    """Integers in [low, high)."""
    return lambda u: (F.floor(u * (high - low)) + low).cast("long")


def uniform(low: float, width: float):
    return lambda u: u * width + low


def log_uniform(low: float, high: float):
    a, b = math.log(low), math.log(high)
    return lambda u: F.exp(u * (b - a) + a)


def choice(*values):
    return lambda u: F.get(F.array(*(F.lit(v) for v in values)), F.floor(u * len(values)).cast("int"))


def param_sample(df: DataFrame, key: str, ranges: Mapping[str, object], seed: int = 42) -> DataFrame:
    """One random candidate per row: each parameter from its own hash of the key."""
    return df.select("*", *(fn(hash_uniform(f"{seed}:{name}", F.col(key))).alias(name)
                            for name, fn in ranges.items()))


def brackets(max_resource: int, factor: int = 3) -> list[list[tuple[int, int]]]:
    """Successive-halving schedule: per bracket, largest first, a list of (trials, resource) rungs."""
    top = 0
    while factor ** (top + 1) <= max_resource:
        top += 1
    final = 1 + top + (factor ** top < max_resource)
    ceil_div = lambda a, d: -(-a // d)
    return [[(ceil_div(final * factor ** left, b + 1), ceil_div(max_resource, factor ** left))
             for left in range(b, -1, -1)] for b in range(top, -1, -1)]


# --- trial tables --------------------------------------------------------------------

def explode_metrics(docs: DataFrame) -> DataFrame:
    """Trial documents to (model, trial_id, metric, step, value)."""
    metric = docs.select("model", "trial_id", F.explode("metrics.metrics").alias("metric", "m"))
    seen = metric.select("model", "trial_id", "metric", F.explode("m.observations").alias("o"))
    return seen.select("model", "trial_id", "metric", F.col("o.step").alias("step"),
                       F.get("o.value", F.lit(0)).alias("value"))


def lineage(trials: DataFrame) -> DataFrame:
    """Parent, root and gain over the parent; chains have at most two hops."""
    slim = trials.select("model", "trial_id", "parent_id", "score")
    up = trials.select(F.col("trial_id").alias("_p"), F.col("score").alias("parent_score"),
                       F.col("parent_id").alias("grandparent_id"))
    top = trials.select(F.col("trial_id").alias("_g"), F.lit(True).alias("_known"))
    out = slim.join(up, F.col("parent_id") == F.col("_p"), "left").join(
        top, F.col("grandparent_id") == F.col("_g"), "left")
    return out.select(
        "model", "trial_id", "parent_id", "score", "parent_score",
        (F.col("parent_score") - F.col("score")).alias("gain"),
        F.when(F.col("_known"), F.col("grandparent_id")).otherwise(F.when(F.col("_p").isNotNull(), F.col("parent_id")))
        .alias("root_id"),
        F.when(F.col("_known"), 2).when(F.col("_p").isNotNull(), 1).otherwise(0).cast("long").alias("hops"))


def rung_summary(trials: DataFrame) -> DataFrame:
    return trials.groupBy("model", "bracket", "round").agg(
        F.count(F.lit(1)).alias("trials"), F.min("score").alias("best_score"), F.avg("score").alias("mean_score"))


def marginals(trials: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """Score by value of each hyperparameter, all of them in one pass."""
    pairs = F.array(*(F.struct(F.lit(p).alias("name"), F.col(p).cast("string").alias("setting")) for p in parameters))
    return trials.select("score", F.inline(pairs)).groupBy("name", "setting").agg(
        F.count(F.lit(1)).alias("trials"), F.min("score").alias("best_score"), F.avg("score").alias("mean_score"))


def fingerprint(parameters: Sequence[str]) -> Column:
    """Hash that is equal for equal hyperparameters."""
    return F.md5(F.concat_ws("|", *(F.concat(F.lit(f"{p}="), F.coalesce(F.col(p).cast("string"), F.lit("")))
                                    for p in sorted(parameters))))


def dedupe(trials: DataFrame, parameters: Sequence[str], by: Sequence[str] = ("model",)) -> DataFrame:
    """One row per distinct hyperparameter set: its first trial and how often it was tried."""
    return trials.withColumn("fingerprint", fingerprint(parameters)).groupBy(*by, "fingerprint").agg(
        F.min("trial_id").alias("trial_id"), F.count(F.lit(1)).alias("tried"))


def best_trials(trials: DataFrame, parameters: Sequence[str]) -> DataFrame:
    """The best trial per model with its hyperparameters (an aggregate, not a sort)."""
    best = F.min(F.struct("score", "trial_id", *parameters)).alias("b")
    return trials.groupBy("model").agg(best).select("model", "b.*")


def best_epoch(steps: DataFrame) -> DataFrame:
    """Step with the lowest loss per trial; the earliest on ties."""
    return steps.groupBy("trial_id").agg(F.min(F.struct("val_loss", "step")).alias("b")).select(
        "trial_id", F.col("b.step").alias("best_step"), F.col("b.val_loss").alias("score"))


def rung_promotion(trials: DataFrame, max_resource: int = 25, factor: int = 3) -> DataFrame:
    """Add place in the rung and ``promoted``: as many of the best as the schedule's next rung takes."""
    plan = brackets(max_resource, factor)
    sizes = {(b, r): rungs[r + 1][0] for b, rungs in zip(range(len(plan) - 1, -1, -1), plan) for r in range(len(rungs) - 1)}
    group = ["model", "bracket", "round"]
    out = with_position(trials, ["score", "trial_id"], group, "_at")
    keep = F.lit(0)
    for (b, r), size in sizes.items():
        keep = F.when((F.col("bracket") == b) & (F.col("round") == r), size).otherwise(keep)
    return out.withColumn("place", F.col("_at") + 1).withColumn("promoted", F.col("_at") < keep).drop("_at")


def trial_duration(trials: DataFrame, run: str = "model") -> DataFrame:
    """Seconds until the next trial of the same run starts; null for the last one."""
    placed = with_position(trials.select(run, "trial_id", "started"), ["started", "trial_id"], [run])
    gap = over_rows(placed, [run], "seq", 0, 1, {
        "_gap": lambda w: F.lead("started").over(w) - F.col("started")})
    part = lambda unit: F.extract(F.lit(unit), F.col("_gap"))
    seconds = part("DAY") * 86400 + part("HOUR") * 3600 + part("MINUTE") * 60 + part("SECOND").cast("long")
    return gap.select(run, "trial_id", seconds.cast("long").alias("seconds"))


# --- early stopping ------------------------------------------------------------------

def early_stop(steps: DataFrame, patience: int, min_delta: float, key: str = "trial_id",
               fold_epochs: int = FOLD_EPOCHS, chunk: int | None = None) -> DataFrame:
    """(key, best_step, stop_step): where training ends for lack of progress.

    Progress is a loss below the last accepted one by more than ``min_delta``; a null or NaN loss
    is none, and before any is accepted each finite loss is progress over infinity, counted from
    step -1. ``best_step`` is null when no loss was accepted, ``stop_step`` when the curve ends
    first. ``step`` must be dense from 0.
    """
    sizes = steps.groupBy(key).agg(F.count(F.lit(1)).alias("_n"))
    longest, n_rows = (v or 0 for v in sizes.agg(F.max("_n"), F.sum("_n")).first())
    if longest <= fold_epochs:
        return _stop_by_fold(steps, patience, min_delta, key)
    sized = attach(steps, sizes, [key])
    short = sized.filter(F.col("_n") <= fold_epochs)
    # chunk maps need patience rows per chunk, so this width balances both passes
    width = max(chunk or math.isqrt(longest * patience), patience)
    return _stop_by_fold(short, patience, min_delta, key).unionByName(
        _stop_by_chunks(sized.filter(F.col("_n") > fold_epochs), patience, min_delta, key, width, n_rows))


def _stop_by_fold(steps, patience, min_delta, key) -> DataFrame:
    """Walk each short curve once; the curve is at most ``fold_epochs`` long."""
    curve = F.array_sort(F.collect_list(F.struct("step", F.col("val_loss").cast("double").alias("loss"))))
    none = F.lit(None).cast("long")
    start = F.struct(F.lit(float("inf")).alias("best"), F.lit(-1).cast("long").alias("at"), none.alias("stop"))

    def step(s, x):
        gain = F.coalesce(~F.isnan(x.loss) & (x.loss + min_delta < s.best), F.lit(False))
        late = x.step - s["at"] >= patience
        moved = F.struct(x.loss.cast("double").alias("best"), x.step.cast("long").alias("at"), none.alias("stop"))
        ended = F.struct(s.best.alias("best"), s["at"].alias("at"), x.step.cast("long").alias("stop"))
        return F.when(s.stop.isNotNull(), s).when(gain, moved).when(late, ended).otherwise(s)

    done = steps.groupBy(key).agg(curve.alias("c")).select(key, F.aggregate("c", start, step).alias("s"))
    best = F.when(F.col("s.at") >= 0, F.col("s.at"))
    return done.select(key, best.alias("best_step"), F.col("s.stop").alias("stop_step"))


def _stop_by_chunks(steps, patience, min_delta, key, width, n_rows) -> DataFrame:
    """Exact walk of long curves.

    Each accepted epoch is followed by the next one within ``patience`` epochs or by a
    stop, so a chunk is a map from its first ``patience`` epochs to an epoch of the next
    chunk or a stop. Maps are built in parallel, then chained per trial. Epochs are counted from
    one here: epoch 0 is the start, with an infinite loss.
    """
    epochs = steps.select(key, (F.col("step") + 1).alias("step"), F.col("val_loss").cast("double").alias("val_loss"), (F.col("_n") + 1).alias("_n"))
    starts = steps.where("step = 0").select(key, F.lit(0).cast("long").alias("step"), F.lit(float("inf")).alias("val_loss"), (F.col("_n") + 1).alias("_n"))
    steps = epochs.unionByName(starts)
    own = F.floor(F.col("step") / width)
    ahead = F.floor((F.col("step") - patience) / width)
    rows = steps.select(key, "step", F.col("val_loss").cast("double").alias("loss"), "_n",
                        F.explode(F.filter(F.array_distinct(F.array(own, ahead)), lambda c: c >= 0)).alias("chunk"))

    def maps(pdf: pd.DataFrame) -> pd.DataFrame:
        """Many chunks at once, one behind the other; no jump leaves its chunk's rows."""
        pdf = pdf.sort_values([key, "chunk", "step"], ignore_index=True)
        loss, step, chunks, curves = pdf["loss"].to_numpy(), pdf["step"].to_numpy(), pdf["chunk"].to_numpy(), pd.factorize(pdf[key], use_na_sentinel=False)[0]
        new = np.append(True, (chunks[1:] != chunks[:-1]) | (curves[1:] != curves[:-1]))
        which, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        here = np.arange(len(pdf))
        place, end = here - begin[which], np.append(begin[1:], len(pdf))[which]
        own = place < width
        following = np.full(len(pdf), -1)
        for d in range(patience, 0, -1):
            better = np.zeros(len(pdf), bool)
            better[:-d] = loss[d:] + min_delta < loss[:-d]
            better &= own & (here + d < end)
            following[better] = here[better] + d
        # the last epoch reached within the chunk, by doubling the length of the jumps
        inside = (following >= 0) & own[following]
        ends = np.where(inside, following, here)
        while (ends[ends] != ends).any():
            ends = ends[ends]
        leaves = following[ends] >= 0
        late = step[ends] + patience
        m = own & (place < np.where(chunks == 0, 1, patience))
        return pd.DataFrame({key: pdf[key], "entry": step, "best": np.where(leaves, -1, step[ends]), "stop": np.where(~leaves & (late < pdf["_n"].to_numpy()), late, -1),
                             "onward": np.where(leaves, step[following[ends]], -1)})[m]

    def chain(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values([key, "entry"], ignore_index=True)
        entry, onward = pdf["entry"].to_numpy(), pdf["onward"].to_numpy()
        curves = pd.factorize(pdf[key], use_na_sentinel=False)[0]
        new = np.append(True, curves[1:] != curves[:-1])
        which, begin = np.cumsum(new) - 1, np.flatnonzero(new)
        # places of (curve, epoch) among the sorted entries
        span = int(max(entry.max(), onward.max())) + 1
        ends = np.where(onward >= 0, np.searchsorted(which * span + entry, which * span + onward), np.arange(len(pdf)))
        while (ends[ends] != ends).any():
            ends = ends[ends]
        best, stop = (pd.Series(pdf[c].to_numpy()[ends[begin]] - 1).astype("Int64") for c in ("best", "stop"))
        return pd.DataFrame({key: pdf[key].to_numpy()[begin], "best_step": best.mask(best < 0), "stop_step": stop.mask(stop < 0)})

    # a call gets the chunks of a bucket of bounded size, not one chunk: a chunk may have a few rows only; null keys would turn others into floats
    kind, buckets = steps.schema[key].dataType.simpleString(), max(1, n_rows // BUCKET_ROWS)
    bucket = lambda *of: F.when(F.col(key).isNull(), -1).otherwise(F.pmod(F.xxhash64(*of), F.lit(buckets))).alias("_bucket")
    built = rows.groupBy(bucket(key, "chunk")).applyInPandas(
        maps, f"{key} {kind}, entry long, best long, stop long, onward long")
    return built.groupBy(bucket(key)).applyInPandas(chain, f"{key} {kind}, best_step long, stop_step long")
