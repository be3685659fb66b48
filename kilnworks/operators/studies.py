"""Decisions on the rounds of many studies at once: what each round was worth, and where its study ends."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: the gain of fit that counts whatever the score does.
LEAST_FIT = 0.003


def decide(rounds: DataFrame, study: str = "study", min_rounds: int = 8, total_rounds: int = 16, patience: int = 3, least_gain: float = 0.2, converge: bool = True) -> DataFrame:
    """rounds with decision, is_best, gain, meaningful, idle and status appended.

    Reads round (from 1), score, fit, signature, valid and boundary_hit (the delay found is the longest tried; nulls are
    false). A round whose signature an earlier round had is equivalent and never best; else one that breaks a constraint
    is infeasible, though it leads while no valid round has come; else new_best or not_improved. Valid rounds lead
    invalid ones whatever the scores; ties stay with the earlier. A gain is over the best before, and meaningful if it
    is of least_gain or the fit's of LEAST_FIT; idle counts the rounds since the last meaningful one.

    status is running until the study has converged (idle rounds of `patience` at least after min_rounds, a valid best
    that hit no boundary) or is at its limit of rounds; rounds behind that are `after`, as they would not have been
    tried. A study's rounds are few, and windows are by study; a null signature equals no other.
    """
    w = Window.partitionBy(study).orderBy("round")
    upto, before = w.rowsBetween(Window.unboundedPreceding, 0), w.rowsBetween(Window.unboundedPreceding, -1)
    yes = lambda c: F.coalesce(F.col(c), F.lit(False))
    seen = F.col("signature").isNotNull() & (F.row_number().over(Window.partitionBy(study, "signature").orderBy("round")) > 1)
    df = rounds.withColumns({"_seen": seen, "_valid": yes("valid")})
    state = F.when(~F.col("_seen"), F.struct("_valid", "score", (-F.col("round")).alias("place"), "fit", yes("boundary_hit").alias("edge")))
    df = df.withColumns({"_was": F.max(state).over(before), "_is": F.max(state).over(upto)})
    best = ~F.col("_seen") & (F.col("_is.place") == -F.col("round"))
    gain = F.col("score") - F.coalesce(F.col("_was.score"), F.lit(0.0))
    more = (F.round(gain, 9) >= least_gain) | (F.round(F.col("fit") - F.col("_was.fit"), 9) >= LEAST_FIT)
    meaningful = ~F.col("_seen") & F.coalesce(F.col("_was").isNull() | (F.col("_valid") & ~F.col("_was._valid")) | (best & more), F.lit(False))
    code = F.when(F.col("_seen"), "equivalent").when(~F.col("_valid"), "infeasible").when(best, "new_best").otherwise("not_improved")
    df = df.withColumns({"decision": code, "is_best": best, "gain": gain, "meaningful": meaningful})
    df = df.withColumn("idle", F.col("round") - F.max(F.when(F.col("meaningful"), F.col("round"))).over(upto))
    done = F.lit(converge) & (F.col("round") >= min_rounds) & (F.col("round") < total_rounds) & F.col("_is._valid") & ~F.col("_is.edge") & (F.col("idle") >= patience)
    end = F.when(done, "converged").when(F.col("round") >= total_rounds, "limit")
    df = df.withColumn("_end", end).withColumn("_ended", F.count("_end").over(before) > 0)
    return df.withColumn("status", F.when(F.col("_ended"), "after").otherwise(F.coalesce("_end", F.lit("running")))).drop("_seen", "_valid", "_was", "_is", "_end", "_ended")
