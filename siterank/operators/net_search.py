"""Hyperband over dense nets, with a stored table of trial states.

All trials that are alive in any bracket train in the same jobs: one job a pass, since every bracket counts its passes from the start.
When a rung ends its trials' weights, moments, losses and settings are appended to the trial table, and the best of the rung go on as new
trials from their parent's row of that table. A search that was cut off goes on behind the last rung that the table has.
"""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from siterank.operators.dense_net import Net
from siterank.operators.net_training import NetRows, NetState, run_pass
from siterank.operators.tuning import brackets

TRIAL_STATE = ("model string, trial_id long, bracket long, round long, parent_id long, resource long, layers long, units long, activation string, "
               "learning_rate double, batch long, first_loss double, last_loss double, score double, started timestamp, steps long, vector array<double>")


def net_settings(trial: int, tried: set, seed: int = 42) -> dict:
    """Settings that no earlier trial had, from the ranges of the five properties' tuners."""
    for attempt in range(1000):
        rng = np.random.default_rng([seed, trial, attempt])
        settings = {"layers": int(rng.integers(1, 3)), "units": int(16 * rng.integers(1, 5)), "activation": str(rng.choice(["relu", "tanh", "elu", "selu"])),
                    "learning_rate": float(rng.choice([1e-2, 5e-3, 1e-3, 5e-4, 1e-4])), "batch": 32}
        if tuple(settings.values()) not in tried:
            break
    tried.add(tuple(settings.values()))
    return settings


def _state_row(model: str, t: dict) -> tuple:
    s, state = t["settings"], t["state"]
    return (model, t["trial_id"], t["bracket"], t["round"], t["parent_id"], t["resource"], s["layers"], s["units"], s["activation"], s["learning_rate"], s["batch"],
            t["first_loss"], t["last_loss"], t["score"], t["started"], state.steps, state.vector().tolist())


def _started_net(inputs: int, settings: dict, seed: int) -> NetState:
    net = Net.random(inputs, [settings["units"]] * settings["layers"], settings["activation"], seed)
    return NetState(net, settings["learning_rate"], settings["batch"])


def _read_rung(spark: SparkSession, path: str, bracket: int, rnd: int) -> list:
    rows = spark.read.schema(TRIAL_STATE).parquet(path).where(f"bracket = {bracket} and round = {rnd}")
    return rows.orderBy("trial_id").collect()  # as many as the schedule's rung has


def hyperband(rows: NetRows, inputs: int, path: str, model: str = "net", max_resource: int = 25, factor: int = 3,
              sampler: Callable[[int, set], dict] = net_settings, seed: int = 42, resume: bool = False) -> DataFrame:
    """Run all brackets of ``brackets(max_resource, factor)`` on training and validation rows; the trial table at ``path``.

    A row is a trial of a rung: where it came from, its settings, training loss when it started and when it ended, validation loss as ``score``, and the
    state that a later run needs. The best of a rung by (score, trial) are promoted. Trial numbers, weights and scores do not depend on
    scheduling. With ``resume`` rungs that the table already has are read, not run.
    """
    spark = rows.data.sparkSession
    plan = dict(zip(range(len(brackets(max_resource, factor)) - 1, -1, -1), brackets(max_resource, factor)))
    tried, numbers = set(), iter(range(1, 1 << 30))
    alive: dict[int, list[dict]] = {}

    def trial(b, r, parent=None, settings=None):
        number = next(numbers)
        settings = settings or sampler(number, tried)
        state = _started_net(inputs, settings, seed + number) if parent is None else parent.pop("restored")
        return {"trial_id": number, "bracket": b, "round": r, "parent_id": parent and parent["trial_id"], "resource": plan[b][r][1], "settings": settings,
                "state": state, "first_loss": None, "started": time.time()}

    def store(ended):
        from datetime import datetime, timezone
        data = [_state_row(model, t | {"started": datetime.fromtimestamp(t["started"], timezone.utc)}) for t in ended]
        spark.createDataFrame(data, TRIAL_STATE).coalesce(1).write.mode("append").parquet(path)

    def promoted(b, r):
        """The next rung's trials, from the stored states of this one."""
        stored = sorted(_read_rung(spark, path, b, r), key=lambda s: (s.score, s.trial_id))
        out = []
        for s in stored[:plan[b][r + 1][0]]:
            settings = {"layers": s.layers, "units": s.units, "activation": s.activation, "learning_rate": s.learning_rate, "batch": s.batch}
            restored = _started_net(inputs, settings, seed).at(np.array(s.vector), s.steps)
            out.append(trial(b, r + 1, {"trial_id": s.trial_id, "restored": restored}, settings))
        return out

    known = set()
    if resume:
        counts = spark.read.schema(TRIAL_STATE).parquet(path).groupBy("bracket", "round").count().collect()
        known = {(r.bracket, r.round) for r in counts if r["count"] == plan[r.bracket][r.round][0]}
    for b, rungs in plan.items():
        alive[b] = [trial(b, 0) for _ in range(rungs[0][0])]
    done = 0
    for end in sorted({resource for rungs in plan.values() for _, resource in rungs}):
        running = {b: ts for b, ts in alive.items() if ts}
        if all((b, ts[0]["round"]) in known for b, ts in running.items() if ts[0]["resource"] == end) and known:
            later = [b for b, ts in running.items() if ts[0]["resource"] > end]
            if later:  # brackets in the middle of a rung have no stored state: they catch up
                _advance(rows, {b: running[b] for b in later}, done, end, seed)
        else:
            _advance(rows, running, done, end, seed)
            ended = [t for ts in running.values() for t in ts if t["resource"] == end]
            for t, (_, loss, score) in run_pass(rows, {i: t["state"] for i, t in enumerate(ended)}, end, train=False, seed=seed).items():
                ended[t] |= {"last_loss": loss, "score": score}
            store(ended)
        done = end
        for b, ts in sorted(running.items(), reverse=True):
            if ts[0]["resource"] == end:
                r = ts[0]["round"]
                alive[b] = promoted(b, r) if r + 1 < len(plan[b]) else []
    return spark.read.schema(TRIAL_STATE).parquet(path)


def _advance(rows: NetRows, running: dict[int, list[dict]], start: int, end: int, seed: int) -> None:
    """Passes ``start`` to ``end`` of all running trials, one job each."""
    trials = [t for ts in running.values() for t in ts]
    for step in range(start, end):
        for i, (state, loss, _) in run_pass(rows, {i: t["state"] for i, t in enumerate(trials)}, step, seed=seed).items():
            trials[i]["state"] = state
            if trials[i]["first_loss"] is None:
                trials[i]["first_loss"] = loss


def best_net(table: DataFrame, inputs: int) -> Net:
    """The net of the best trial."""
    s = table.orderBy("score", "trial_id").first()
    settings = {"layers": s.layers, "units": s.units, "activation": s.activation, "learning_rate": s.learning_rate, "batch": s.batch}
    return replace(_started_net(inputs, settings, 0)).at(np.array(s.vector), s.steps).net
