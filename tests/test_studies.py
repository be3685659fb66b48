"""Where studies end, case by case."""

from __future__ import annotations

from kilnworks.operators import studies

SCHEMA = "study long, round long, score double, fit double, signature string, valid boolean, boundary_hit boolean"


def decided(spark, rows, **more):
    """rows: (score, fit, signature, valid, boundary_hit) of one study."""
    df = spark.createDataFrame([(1, i + 1, *r) for i, r in enumerate(rows)], SCHEMA)
    return studies.decide(df, **more).orderBy("round").collect()


def flat(n, **change):
    base = dict(score=10.0, fit=0.5, valid=True, edge=False) | change
    return [(base["score"], base["fit"], f"s{i}", base["valid"], base["edge"]) for i in range(n)]


def test_converges_after_least_rounds_and_patience(spark):
    got = decided(spark, flat(12))
    assert [r["status"] for r in got] == ["running"] * 7 + ["converged"] + ["after"] * 4
    assert [r["decision"] for r in got] == ["new_best"] + ["not_improved"] * 11
    assert [r["idle"] for r in got] == list(range(12))


def test_a_late_gain_puts_the_end_off(spark):
    rows = flat(12)
    rows[6] = (10.2, 0.5, "late", True, False)
    got = decided(spark, rows)
    assert got[6]["meaningful"] and [r["status"] for r in got][8:] == ["running", "converged", "after", "after"]
    rows[6] = (10.1, 0.5, "late", True, False)  # best, but too little
    got = decided(spark, rows)
    assert got[6]["is_best"] and not got[6]["meaningful"] and got[7]["status"] == "converged"
    rows[6] = (10.1, 0.503, "late", True, False)  # the fit makes up for it
    assert decided(spark, rows)[6]["meaningful"]


def test_no_end_at_a_boundary_or_without_a_valid_round(spark):
    for rows in (flat(17, edge=True), flat(17, valid=False), flat(17, valid=None)):
        got = decided(spark, rows)
        assert [r["status"] for r in got] == ["running"] * 15 + ["limit", "after"]
    assert [r["decision"] for r in decided(spark, flat(3, valid=False))] == ["infeasible"] * 3
    assert [r["status"] for r in decided(spark, flat(17), converge=False)][-2:] == ["limit", "after"]


def test_valid_rounds_lead_and_equivalent_ones_never(spark):
    got = decided(spark, [(90.0, 0.9, "a", False, False), (5.0, 0.1, "b", True, False), (95.0, 0.9, "b", True, False), (95.0, 0.9, "c", False, False), (5.0, 0.9, "d", True, False)])
    assert [r["decision"] for r in got] == ["infeasible", "new_best", "equivalent", "infeasible", "not_improved"]
    assert [r["is_best"] for r in got] == [True, True, False, False, False]
    assert [r["meaningful"] for r in got] == [True, True, False, False, False]


def test_null_signatures_equal_no_other_and_no_rounds(spark):
    got = decided(spark, [(1.0, None, None, True, None), (2.0, None, None, True, None)])
    assert [r["decision"] for r in got] == ["new_best", "new_best"] and got[1]["meaningful"]
    assert decided(spark, []) == []
