"""A search over real data: from a frozen split to one model that sees the test rows once.

Windows are scored on train rows alone. A candidate is a number of windows and a longest delay: its rows are the train
rows in its best windows, from which delays and coefficients come, and it is judged on validation rows that are the same
for all. Candidates are evaluated in batches: however many a batch has, it costs one job for the lag correlations, one
for the covariances and one for the errors. Every candidate becomes a row of an append-only journal under its signature,
so a search that was cut off goes on where it stopped. The winner is frozen before the test rows are touched.
"""

from __future__ import annotations

import hashlib
import json
import math
import uuid
from collections.abc import Iterable, Sequence

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.operators import identification as ident
from kilnworks.operators import series, stats, windows
from kilnworks.sources.files import scratch_dir

#: Windows of the first six rounds; their longest delays are in first_candidates().
FIRST_WINDOWS = (5, 3, 8, 6, 10, 4)
#: What each later round adds to the windows and, in steps, to the longest delay of the candidate it starts from.
DIRECTIONS = ((2, -1), (-1, 1), (3, -2), (-2, 2), (1, -3), (-3, 3), (4, -1), (-4, 1), (2, -2), (-2, 2))
#: Bounds of both parameters where none are given.
BOUNDS = {"top_k": (2, 20), "max_lag": (1, 600)}
LONGEST = 600
ORDER = 3

JOURNAL = (
    "signature string, round int, label string, top_k int, max_lag int, status string, reason string, train_rows long, targets long, coverage double, family string, model_order int, alpha double, "
    "features array<string>, coefficients array<double>, delays map<string, int>, r2 double, rmse double, mae double, score double, feasible boolean"
)


def first_candidates(max_lag: int) -> list[dict]:
    """The six candidates that are tried whatever comes out."""
    half = max(10, max_lag // 2)
    lags = (max_lag, half, min(LONGEST, max_lag + half), max(10, round(max_lag * 0.75)), min(LONGEST, max_lag * 2), min(LONGEST, max(10, round(max_lag * 1.25))))
    return [{"round": i + 1, "label": "explore", "top_k": k, "max_lag": lag} for i, (k, lag) in enumerate(zip(FIRST_WINDOWS, lags))]


def within(candidate: dict, bounds: dict[str, tuple[int, int]], tried: Iterable[tuple[int, int]]) -> dict | None:
    """The candidate moved into its bounds and, if that was tried, to the next pair in order of windows and then delay, from the start again after the last; None when all were tried."""
    (k0, k1), (l0, l1) = bounds["top_k"], bounds["max_lag"]
    k, lag = min(max(candidate["top_k"], k0), k1), min(max(candidate["max_lag"], l0), l1)
    wide, tried = l1 - l0 + 1, set(tried)
    place = (k - k0) * wide + lag - l0
    for step in range((k1 - k0 + 1) * wide):
        i = (place + step) % ((k1 - k0 + 1) * wide)
        pair = (k0 + i // wide, l0 + i % wide)
        if pair not in tried:
            return candidate | {"top_k": pair[0], "max_lag": pair[1]}
    return None


def candidate_score(r2: float, rmse: float, coverage: float, weights: dict[str, float]) -> float:
    clip = lambda x: max(0.0, min(1.0, x))
    return round(100 * (weights["r2"] * clip((r2 + 0.2) / 1.2) + weights["rmse"] / (1 + max(rmse, 0.0)) + weights["coverage"] * clip(coverage)), 3)


class Journal:
    """A folder of Parquet files that is only ever appended to, one file for each batch; rows are found by signature."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path

    def frame(self) -> DataFrame:
        try:
            return self.spark.read.schema(JOURNAL).parquet(self.path)
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], JOURNAL)

    def find(self, signatures: Sequence[str]) -> dict[str, dict]:
        """Rows of these signatures, a batch's at most. A batch written twice by a search that was started twice has equal rows."""
        return {r["signature"]: r.asDict() for r in self.frame().filter(F.col("signature").isin(list(signatures))).collect()}

    def append(self, rows: list[dict]) -> None:
        names = [c.split()[0] for c in JOURNAL.replace("map<string, int>", "map").split(", ")]
        self.spark.createDataFrame([tuple(r.get(c) for c in names) for r in rows], JOURNAL).coalesce(1).write.mode("append").parquet(self.path)


def data_digest(df: DataFrame, columns: Sequence[str]) -> str:
    """Rows, and two sums of 64-bit hashes with different seeds, over rows in any order: 128 bits that equal data share."""
    total = lambda seed: F.sum(F.xxhash64(F.lit(seed), *columns).cast("decimal(38,0)"))
    return ":".join(str(x) for x in df.agg(F.count(F.lit(1)), total(1), total(2)).first())


class Search:
    """One search over a regular frame (order numbers its rows from 0 on) with the frozen parts of a time split."""

    def __init__(
        self, frame: DataFrame, inputs: Sequence[str], output: str, order: str = "rn", part: str = "part", window: int = 30, step: int = 15, guard: int = 9, orders: Sequence[int] = (1, 2, 3),
        alphas: Sequence[float] = (0.0, 10.0), weights: dict[str, float] | None = None, min_r2: float = 0.0, min_coverage: float = 0.05, least_pairs: int = 20, journal: str | None = None,
        scoring: dict | None = None, most_windows: int = BOUNDS["top_k"][1], candidates: Sequence[tuple[int, int]] = (), least_observations: int = 0,
    ) -> None:
        self.spark, self.inputs, self.output, self.order, self.part = frame.sparkSession, list(inputs), output, order, part
        self.guard, self.orders, self.alphas, self.least = guard, tuple(orders), tuple(alphas), least_pairs
        self.weights, self.min_r2, self.min_coverage = weights or {"r2": 0.68, "rmse": 0.17, "coverage": 0.15}, min_r2, min_coverage
        scratch = f"{scratch_dir(self.spark)}/search-{uuid.uuid4().hex}"
        columns = [order, part, *self.inputs, output]
        frame.select(*columns).write.parquet(f"{scratch}/frame")  # every job of the search starts from here
        self.frame = self.spark.read.parquet(f"{scratch}/frame")
        self.journal = Journal(self.spark, journal or f"{scratch}/journal")
        train = self.frame.filter(F.col(part) == "train")
        self.train_rows = train.count()
        self.candidates = list(candidates)
        scored = windows.score_windows(train, self.inputs, output, [*self.inputs, output], size=window, step=step, order=order, **(scoring or {}))
        best = windows.top_windows(scored.filter(F.col("output_observations") >= least_observations), most_windows)
        self.windows = [(r["start_rn"], r["end_rn"]) for r in best.collect()]  # most_windows rows at most
        policy = [self.inputs, output, window, step, guard, self.orders, self.alphas, self.weights, min_r2, min_coverage, least_pairs, scoring, most_windows, least_observations]
        seen = self.frame.filter(F.col(part).isin("train", "validation"))
        self.identity = json.dumps([data_digest(seen, columns), policy])
        self.evaluated: list[tuple[int, int]] = []

    @classmethod
    def of_policy(cls, frame: DataFrame, inputs: Sequence[str], output: str, policy: dict, **more) -> "Search":
        """A search as a policy (policy.receipt()["policy"]) sets it: windows and their scores, orders, ridge, weights, constraints and first candidates."""
        s, d, o = policy["selection"], policy["decoupling"], policy["optimization"]
        if set(d["families"]) == {"FIRX"}:
            raise ValueError("models without the output's past are judged by the last value measured, not by this search")
        scoring = {"weights": dict(s["weights"]), "scales": (s["scales"]["input_change"], s["scales"]["output_response"]), "levels": (s["strict_score"], s["usable_score"], s["snr_db"])}
        most = max(BOUNDS["top_k"][1], s["top_k"], *(c[0] for c in o["candidates"]), o["bounds"].get("top_k", (0, 0))[1])
        limits = {"min_r2": o["constraints"].get("min_r2", 0.0), "min_coverage": o["constraints"].get("min_coverage", 0.05)}
        return cls(frame, inputs, output, window=s["window"], step=s["step"], orders=d["orders"], alphas=[float(a) for a in d["ridge"]], weights=o["weights"], scoring=scoring, most_windows=most, candidates=o["candidates"], least_observations=s["min_output_observations"] if s["sparse_output"] else 0, **limits, **more)

    def signature(self, candidate: dict, kind: str = "candidate") -> str:
        return hashlib.sha256(json.dumps([kind, self.identity, candidate["top_k"], candidate["max_lag"]]).encode()).hexdigest()

    # -- one batch

    def _rows(self, batch: list[dict]) -> DataFrame:
        """Each candidate's train rows with its number and the run of consecutive rows they are in."""
        at = F.col(self.order)
        inside = lambda k: F.coalesce(*[F.when((at >= a) & (at <= b), True) for a, b in self.windows[:k]], F.lit(False))
        some = F.filter(F.array(*[F.when(inside(c["top_k"]), F.lit(i)) for i, c in enumerate(batch)]), lambda x: x.isNotNull())
        rows = self.frame.filter(F.col(self.part) == "train").withColumn("candidate", F.explode(some))
        return series.segments(rows, 1, self.order, ["candidate"])

    def _delays(self, rows: DataFrame, batch: list[dict]) -> dict[int, dict[str, int]]:
        found = stats.lag_correlations(rows, self.inputs, self.output, range(max(c["max_lag"] for c in batch) + 1), self.order, ["segment"], self.least, ["candidate"])
        most = F.element_at(F.array(*[F.lit(c["max_lag"]) for c in batch]), F.col("candidate") + 1)
        best = stats.best_lags(found.filter(F.col("lag") <= most), ["candidate"])
        out: dict[int, dict[str, int]] = {i: {} for i in range(len(batch))}
        for r in best.collect():  # a row for each candidate and input
            out[r["candidate"]][r["input"]] = int(r["delay"])
        return out

    def _features(self, delays: dict[str, int], order: int, family: str) -> list[tuple[str, str, int]]:
        return ident.lag_names(order, delays if family == "ARX" else {}, self.output)

    def _fits(self, rows: DataFrame, delays: dict[int, dict[str, int]]) -> list[dict]:
        """Every structure of every candidate, from one aggregate by candidate. The columns are the lags of the highest order, at each candidate's own delays."""
        of = {i: self._features(d, ORDER, "ARX") for i, d in delays.items()}
        keys = ["candidate", "segment"]
        columns = {}
        for j in range(len(next(iter(of.values())))):
            by_lag: dict[tuple[str, int], list[int]] = {}
            for i, features in of.items():
                by_lag.setdefault(features[j][1:], []).append(i)
            columns[f"_f{j}"] = F.coalesce(*[F.when(F.col("candidate").isin(ids), series.lagged(c, k, self.order, keys)) for (c, k), ids in by_lag.items()])
        names = [*columns, self.output]
        whole = rows.select(*keys, self.output, *[x.alias(n) for n, x in columns.items()]).dropna(subset=names)
        pairs = [(a, b) for a in range(len(names)) for b in range(a, len(names))]
        sums = whole.groupBy("candidate").agg(F.count(F.lit(1)).alias("n"), F.array(*[F.avg(c) for c in names]).alias("means"), F.array(*[F.covar_pop(names[a], names[b]) for a, b in pairs]).alias("cov"))
        out = []
        for r in sums.collect():  # a row for each candidate
            i, means, cov = r["candidate"], np.array(r["means"], float), np.zeros((len(names), len(names)))
            for (a, b), value in zip(pairs, r["cov"]):
                cov[a, b] = cov[b, a] = value
            all_names = [n for n, _, _ in of[i]]
            for order in self.orders:
                for family in ("AR", "ARX"):
                    chosen = [n for n, _, _ in self._features(delays[i], order, family)]
                    at = [*(all_names.index(n) for n in chosen), len(all_names)]
                    for alpha in self.alphas:
                        fit = ident.solve(r["n"], means[at], cov[np.ix_(at, at)], alpha)
                        if fit is not None and np.isfinite(fit).all() and ident.is_stable(fit[1 : 1 + order]):
                            out.append({"candidate": i, "family": family, "model_order": order, "alpha": float(alpha), "features": chosen, "coefficients": [float(x) for x in fit]})
        return out

    def _errors(self, fits: list[dict], lags: Iterable[tuple[str, str, int]], part: str) -> tuple[int, float, list[tuple[int, float, float]]]:
        """Targets, their sum of squares about the mean, and for each fit how many of them it predicts, its squared and its absolute errors; on one part's common targets."""
        rows = series.segments(self.frame.filter(F.col(self.part) == part), 1, self.order)
        rows = ident.common_targets(rows, self.output, self.inputs, self.guard, self.order)
        rows = ident.feature_frame(rows, sorted(set(lags)), self.order).filter("common")
        sums: list[Column] = []
        for f in fits:
            e = F.col(self.output) - ident.prediction(f["coefficients"], f["features"])
            sums += [F.count(e), F.sum(e * e), F.sum(F.abs(e))]
        row = rows.agg(F.count(F.lit(1)), F.count(F.lit(1)) * F.var_pop(self.output), *sums).first()
        return row[0], row[1] or 0.0, [tuple(row[2 + 3 * i : 5 + 3 * i]) for i in range(len(fits))]

    def evaluate(self, batch: list[dict]) -> list[dict]:
        """A row of the journal for each candidate: found there, or computed together with the others and appended."""
        signed = [c | {"signature": self.signature(c)} for c in batch]
        known = self.journal.find([c["signature"] for c in signed])
        new = [c for c in signed if c["signature"] not in known]
        if new:
            made = self._evaluate(new)
            self.evaluated += [(c["top_k"], c["max_lag"]) for c in new]
            self.journal.append(made)
            known |= {r["signature"]: r for r in made}
        return [known[c["signature"]] | {"round": c["round"], "label": c["label"]} for c in signed]

    def _evaluate(self, batch: list[dict]) -> list[dict]:
        out = [c | {"status": "infeasible", "score": -1.0, "feasible": False} for c in batch]
        if not self.windows:
            return [r | {"reason": "no_windows"} for r in out]
        rows = self._rows(batch)
        delays = self._delays(rows, batch)
        counts = {r["candidate"]: r["n"] for r in rows.groupBy("candidate").agg(F.count(F.lit(1)).alias("n")).collect()}
        able = {i: d for i, d in delays.items() if len(d) == len(self.inputs)}
        for i, r in enumerate(out):
            r |= {"train_rows": counts.get(i, 0), "coverage": counts.get(i, 0) / max(self.train_rows, 1), "delays": delays[i], "reason": None if i in able else "no_delay_evidence"}
        fits = self._fits(rows, able) if able else []
        lags = [x for d in able.values() for x in self._features(d, ORDER, "ARX")]
        targets, total, errors = self._errors(fits, lags, "validation") if fits else (0, 0.0, [])
        for i, r in enumerate(out):
            if r["reason"]:
                continue
            mine = [(f, e) for f, e in zip(fits, errors) if f["candidate"] == i]
            r["targets"] = targets
            whole = [(f, sse, sae) for f, (n, sse, sae) in mine if n == targets]
            if not mine or targets < 10 or not total or not whole:
                r["reason"] = "no_fit" if not mine else "few_targets" if targets < 10 else "undefined_metrics" if not total else "common_targets_not_predicted"
                continue
            bic = lambda x: targets * math.log(max(x[1], 1e-300) / targets) + len(x[0]["coefficients"]) * math.log(targets)
            fit, sse, sae = min(whole, key=lambda x: (round(bic(x), 9), x[0]["model_order"], x[0]["family"], x[0]["alpha"]))
            r |= {k: fit[k] for k in ("family", "model_order", "alpha", "features", "coefficients")} | measures(targets, total, sse, sae)
            r |= {"status": "completed", "score": candidate_score(r["r2"], r["rmse"], r["coverage"], self.weights)}
            r["feasible"] = r["r2"] >= self.min_r2 and r["coverage"] >= self.min_coverage
            r["reason"] = None if r["feasible"] else "constraints_not_met"
        return out

    def test(self, winner: dict) -> dict:
        """The frozen winner on the test rows, once: a second call finds the row of the first in the journal."""
        signature = self.signature(winner, "test")
        known = self.journal.find([signature])
        if not known:
            targets, total, errors = self._errors([winner], self._features(winner["delays"], ORDER, "ARX"), "test")
            n, sse, sae = errors[0]
            found = measures(targets, total, sse, sae) if targets and n == targets and total else {}
            self.journal.append([{k: winner[k] for k in ("round", "label", "top_k", "max_lag", "family", "model_order", "alpha", "features", "coefficients", "delays")} | found | {"signature": signature, "status": "tested", "targets": targets}])
            known = self.journal.find([signature])
        return known[signature]

    # -- the rounds

    def run(self, max_lag: int = 60, bounds: dict[str, tuple[int, int]] | None = None, min_rounds: int = 8, max_rounds: int = 16, patience: int = 3, least_gain: float = 0.2) -> dict:
        """rounds (rows of the journal in order), winner, test and why the search stopped.

        Six candidates are explored, two more around the best of them, then one at a time around the best so far, until
        `patience` rounds in a row gain less than least_gain while the best meets its constraints, or max_rounds.
        """
        bounds = BOUNDS | (bounds or {})
        rounds: list[dict] = []

        def tried() -> set[tuple[int, int]]:
            return {(r["top_k"], r["max_lag"]) for r in rounds}

        batch: list[dict] = []
        own = [{"round": i + 1, "label": "explore", "top_k": k, "max_lag": lag} for i, (k, lag) in enumerate(self.candidates)]
        for c in (own or first_candidates(max_lag))[:max_rounds]:
            bounded = within(c, bounds, {(x["top_k"], x["max_lag"]) for x in batch})
            if bounded is None:
                break
            batch.append(bounded)
        rounds += self.evaluate(batch)
        done = [r for r in rounds if r["status"] == "completed"]
        if not done:
            return {"rounds": rounds, "winner": None, "test": None, "stopped": "no_candidate_can_be_judged"}
        first = best = max(done, key=lambda r: r["score"])
        step, idle, stopped = max(10, max_lag // 4), 0, "all_rounds"
        number = max(7, len(rounds) + 1)
        while number <= max_rounds:
            together = [n for n in (number, number + 1) if n <= min(8, max_rounds)] or [number]  # rounds 7 and 8 start from the same candidate
            batch = []
            for n in together:
                anchor = first if n <= 8 else best
                more, ahead = DIRECTIONS[(n - 7) % len(DIRECTIONS)]
                wanted = {"round": n, "label": f"around {anchor['round']}", "top_k": anchor["top_k"] + more, "max_lag": min(LONGEST, max(10, anchor["max_lag"] + ahead * step))}
                bounded = within(wanted, bounds, tried() | {(c["top_k"], c["max_lag"]) for c in batch})
                if bounded is not None:
                    batch.append(bounded)
            if not batch:
                stopped = "nothing_left_to_try"
                break
            for r in self.evaluate(batch):
                rounds.append(r)
                gain = r["score"] - best["score"] if r["status"] == "completed" else 0.0
                best = r if gain > 0 else best
                idle = 0 if gain >= least_gain else idle + 1
            number = rounds[-1]["round"] + 1
            if rounds[-1]["round"] >= min_rounds and best["feasible"] and idle >= patience:
                stopped = "no_more_gain"
                break
        winner = max((r for r in rounds if r["status"] == "completed"), key=lambda r: r["score"])
        return {"rounds": rounds, "winner": winner, "test": self.test(winner), "stopped": stopped}


def measures(n: int, total: float, sse: float, sae: float) -> dict[str, float]:
    return {"r2": 1 - sse / total, "rmse": math.sqrt(sse / n), "mae": sae / n}


def rounds_frame(spark: SparkSession, found: dict) -> DataFrame:
    """A row for each round, 16 at most, the winner's with its measures on the test rows."""
    rows = []
    for r in found["rounds"]:
        won = r is found["winner"] or (found["winner"] is not None and r["round"] == found["winner"]["round"])
        test = found["test"] if won else {}
        digits = lambda x: None if x is None else round(float(x), 6)
        rows.append((r["round"], r["label"], r["top_k"], r["max_lag"], r["status"], r.get("reason"), r.get("train_rows"), r.get("targets"), digits(r.get("coverage")), r.get("family"), r.get("model_order"), r.get("alpha"), *(digits(r.get(k)) for k in ("r2", "rmse", "mae")), r["score"], r["feasible"], won, *(digits((test or {}).get(k)) for k in ("r2", "rmse", "mae"))))
    names = "round int, label string, top_k int, max_lag int, status string, reason string, train_rows long, targets long, coverage double, family string, model_order int, alpha double, r2 double, rmse double, mae double, score double, feasible boolean, winner boolean, test_r2 double, test_rmse double, test_mae double"
    return spark.createDataFrame(rows, names)
