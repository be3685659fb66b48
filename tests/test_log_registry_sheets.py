"""The feedback log, the operator registry and spreadsheets."""

from __future__ import annotations

import collections
import random
import zipfile
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from kilnworks.operators import feedback, registry
from kilnworks.plans.process import ARTIFACTS
from kilnworks.sources import xlsx

# ---- feedback

START = datetime(2024, 1, 1)


def log_of(spark, rows):
    return spark.createDataFrame([(e, r, START + timedelta(minutes=m), a, "u", None) for e, r, m, a in rows], feedback.LOG)


def events(n=200, seed=1):
    r = random.Random(seed)
    return [(f"e{i:03}", f"r{r.randint(0, 6)}", r.randint(0, 40), r.choice(["submit", "submit", "approve", "reject", "revoke", "burn", None])) for i in range(n)]


def plain_fold(rows):
    state, out = collections.defaultdict(lambda: "none"), {}
    for e, r, m, a in sorted(set(rows), key=lambda x: (x[1] or "", x[2], x[0])):
        before = state[r]
        if r is None:
            out[e] = ("none", "none", "refused", "no_record")
            continue
        after = {("none", "submit"): "pending", ("rejected", "submit"): "pending", ("pending", "approve"): "approved", ("pending", "reject"): "rejected", ("approved", "revoke"): "rejected"}.get((before, a))
        if after:
            state[r] = after
            out[e] = (before, after, "applied", None)
        elif a not in ("submit", "approve", "reject", "revoke"):
            out[e] = (before, before, "refused", "unknown_action")
        elif (a, before) in {("submit", "pending"), ("submit", "approved"), ("approve", "approved"), ("reject", "rejected")}:
            out[e] = (before, before, "unchanged", None)
        else:
            out[e] = (before, before, "refused", "unknown_record" if before == "none" else "not_approved" if a == "revoke" else "already_decided")
    return out, dict(state)


def outcomes(df):
    return {r["event_id"]: (r["before"], r["after"], r["outcome"], r["reason"]) for r in df.collect()}


def test_a_log_is_folded_by_record(spark):
    rows = events() + [("x1", None, 3, "submit"), ("x2", None, 4, "approve")]
    folded = feedback.fold_log(log_of(spark, rows + rows[:50]).repartition(5))  # some events come twice
    want, state = plain_fold(rows)
    assert outcomes(folded) == want
    got = {r["record"]: r["status"] for r in feedback.records(folded).collect()}
    assert got == {r: s for r, s in state.items() if s != "none"}
    assert feedback.fold_log(log_of(spark, [])).count() == 0


def test_a_batch_that_comes_twice_changes_nothing(spark, tmp_path):
    rows = sorted(events(), key=lambda x: x[2])
    table = feedback.FeedbackTable(spark, str(tmp_path / "log"), parts=8)
    assert table.frame().count() == 0
    first, second = rows[:120], rows[90:]  # the second holds thirty events of the first
    assert sum(table.apply(log_of(spark, first)).values()) == 120
    before = {p.name: p.stat().st_mtime_ns for d in (tmp_path / "log").iterdir() if d.is_dir() for p in d.iterdir()}
    assert table.apply(log_of(spark, first)) == {} and outcomes(table.frame()) == plain_fold(first)[0]
    assert sum(table.apply(log_of(spark, second)).values()) == 80
    assert outcomes(table.frame()) == plain_fold(rows)[0]
    alone = [("one", "r0", 99, "revoke")]
    there = {p: p.stat().st_mtime_ns for d in (tmp_path / "log").iterdir() if d.is_dir() for p in d.iterdir()}
    table.apply(log_of(spark, alone))
    kept = [p for p, at in there.items() if p.exists() and p.stat().st_mtime_ns == at]
    assert before and kept and len({p.parent for p in there if p not in kept}) == 1  # one part was replaced


def test_conflicts_of_approved_targets(spark):
    subjects = spark.createDataFrame([("a", "s", "n", "t1"), ("b", "s", "n", "t2"), ("c", "s", "m", "t1"), ("d", "s", "n", "t3")], "record string, scope string, name string, target string")
    status = spark.createDataFrame([("a", "approved"), ("b", "approved"), ("c", "approved"), ("d", "pending")], "record string, status string")
    assert [tuple(r) for r in feedback.conflicts(subjects, status).collect()] == [("s", "n", ["t1", "t2"])]


# ---- registry


def test_a_circle_is_refused_before_anything_runs(spark):
    r, ran = registry.Registry(), []

    @r.operator("one", {"b": ()}, "a")
    def one(b):
        ran.append("one")

    @r.operator("two", {"a": ()}, "b")
    def two(a):
        ran.append("two")

    with pytest.raises(registry.PlanError, match="a needs b needs a"):
        r.run(["a"], {})
    with pytest.raises(registry.PlanError, match="nothing makes c"):
        r.run(["c"], {})
    with pytest.raises(ValueError, match="made by one already"):
        r.operator("three", {}, "a")(one)
    assert not ran


def test_missing_columns_are_refused_before_anything_runs(spark):
    events = spark.range(1).select(F.col("id").alias("ts"))
    with pytest.raises(registry.PlanError, match="resample reads event_type, value of events"):
        ARTIFACTS.run(["window_scores"], {"events": events})


def test_what_several_need_is_made_once(spark):
    r, ran = registry.Registry(), collections.Counter()

    def step(name, *needs):
        def make(**frames):
            ran[name] += 1
            return spark.createDataFrame([(name, sorted(frames))], "name string, needs array<string>")

        r.operator(name, {n: () for n in needs}, name, ("name",))(make)

    for name, *needs in (("base", "given"), ("left", "base"), ("right", "base"), ("top", "left", "right"), ("unused", "base")):
        step(name, *needs)
    written = []
    found = r.run(["top", "left"], {"given": spark.range(1)}, write=lambda df, name: written.append(name) or df)
    assert ran == {"base": 1, "left": 1, "right": 1, "top": 1} and written == ["base"] and set(found) == {"top", "left"}
    order = [o.name for o in r.plan(["top"], {"given": spark.range(1)})]
    assert order.index("base") < order.index("left") < order.index("top")


# ---- spreadsheets

SHEET = '<worksheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><sheetData>{}</sheetData></worksheet>'


def workbook(path, sheets, strings=(), formats=(0, 14, 164), date1904=False):
    """A small workbook; a cell is raw XML or a number."""
    x = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    with zipfile.ZipFile(path, "w") as z:
        rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
        z.writestr("xl/workbook.xml", f'<workbook {x} xmlns:r="{rel}"><workbookPr date1904="{int(date1904)}"/><sheets>' + "".join(f'<sheet name="{n}" sheetId="{i + 1}" r:id="rId{i + 1}"/>' for i, n in enumerate(sheets)) + "</sheets></workbook>")
        z.writestr("xl/_rels/workbook.xml.rels", "<Relationships>" + "".join(f'<Relationship Id="rId{i + 1}" Target="{"/xl/" if i % 2 else ""}worksheets/s{i}.xml"/>' for i in range(len(sheets))) + "</Relationships>")
        if strings:
            z.writestr("xl/sharedStrings.xml", f"<sst {x}>" + "".join(f"<si>{s}</si>" for s in strings) + "</sst>")
        z.writestr("xl/styles.xml", f'<styleSheet {x}><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm\\-dd hh:mm"/><numFmt numFmtId="165" formatCode="0.00&quot;day&quot;"/></numFmts><cellXfs>' + "".join(f'<xf numFmtId="{f}"/>' for f in formats) + "</cellXfs></styleSheet>")
        for i, rows in enumerate(sheets.values()):
            body = "".join(f'<row r="{n}">' + "".join(cells) + "</row>" for n, cells in rows)
            z.writestr(f"xl/worksheets/s{i}.xml", SHEET.format(body))


def cell(at, value, kind="n", style=0):
    return f'<c r="{at}" t="{kind}" s="{style}"><v>{value}</v></c>'


def test_sheets_are_read(spark, tmp_path):
    strings = ("<t>time</t>", "<t>flow</t>", "<r><t>rich </t></r><r><t>text</t></r><rPh><t>no</t></rPh>", "<t> </t>")
    data = [
        (1, [cell("A1", 0, "s"), cell("B1", 1, "s"), cell("C1", 3, "s"), cell("D1", 1, "s"), '<c r="AA1" t="inlineStr"><is><t>far</t></is></c>']),
        (2, [cell("A2", 45292.5, style=2), cell("B2", 1.25), cell("AA2", 2, "s")]),
        (4, [cell("A4", 45293, style=1), cell("B4", "#DIV/0!", "e"), cell("D4", 9)]),
        (5, ['<c r="A5"/>']),
        (6, [cell("B6", 1, "b"), '<c t="str"><v>made</v></c>']),
    ]
    workbook(tmp_path / "a.xlsx", {"one": [(1, [cell("A1", 1)])], "two &amp; more": data}, strings)
    df = xlsx.read_xlsx(spark, str(tmp_path), "two & more")
    assert df.columns == ["time", "flow", "far"]
    assert sorted(map(tuple, df.collect()), key=str) == sorted([("2024-01-01 12:00:00", "1.25", "rich text"), ("2024-01-02 00:00:00", None, None), (None, "true", None)], key=str)
    cells = xlsx.read_cells(spark, str(tmp_path)).collect()
    assert {(r["sheet_number"], r["sheet"], r["row"]) for r in cells} == {(0, "one", 1), (1, "two & more", 1), (1, "two & more", 2), (1, "two & more", 4), (1, "two & more", 6)}
    assert xlsx.read_xlsx(spark, str(tmp_path / "a.xlsx"), 1, skip=3).columns == ["2024-01-02 00:00:00", "9"]


def test_dates_from_1904_and_quoted_formats(spark, tmp_path):
    workbook(tmp_path / "b.xlsx", {"s": [(1, [cell("A1", 0), cell("B1", 2)]), (2, [cell("A2", 1, style=1), cell("B2", 1, style=2)])]}, formats=(0, 22, 165), date1904=True)
    assert [tuple(r) for r in xlsx.read_xlsx(spark, str(tmp_path)).collect()] == [("1904-01-02 00:00:00", "1")]


def test_headers_must_agree(spark, tmp_path):
    for name, head in (("a", 1), ("b", 1), ("c", 2)):
        workbook(tmp_path / f"{name}.xlsx", {"s": [(1, [cell("A1", head)]), (2, [cell("A2", 7)])]})
    with pytest.raises(ValueError, match="differ"):
        xlsx.read_xlsx(spark, str(tmp_path))
    with pytest.raises(ValueError, match="no rows"):
        xlsx.read_xlsx(spark, str(tmp_path), "none")
    (tmp_path / "c.xlsx").unlink()
    assert [r[0] for r in xlsx.read_xlsx(spark, str(tmp_path)).collect()] == ["7", "7"]
