"""Character model, fuzzy matches, term counts, the router and group merges against plain Python."""

from __future__ import annotations

import collections
import math
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from kilnworks.operators import names, stats, text


def plain_core(name):
    value = name.lower()
    for pattern in (names.SYSTEMS, names.PLACES, names.CHANNELS):
        value = re.sub(pattern, " ", value)
    return "".join(t for t in re.split("[^0-9a-z一-鿿]+", value) if t and t not in names.NOISE and not t.isdigit())


def plain_features(name):
    compact, low, found = plain_core(name), name.lower().replace("_", " "), collections.Counter()
    for n in (1, 2, 3):
        found.update(f"{n}:{compact[i : i + n]}" for i in range(len(compact) - n + 1))
    said = [c for c, p in names.CONCEPTS.items() if re.search(p, low, re.ASCII)]
    for c in said:
        found[f"concept:{c}"] += 4
    numbers = [str(int(re.search(r"\d{1,2}", m.group()).group())) for m in re.finditer(names.ORDINAL, low)]
    letters = [re.search("[ab]", m.group()).group() for m in re.finditer(names.VARIANT, low)]
    for kind, marks, weight, pair, heads in (("ordinal", numbers, 6, 3, ("measure", "position", "direction")), ("variant", letters, 5, 3, ("measure", "position"))):
        for x in marks:
            found[f"{kind}:{x}"] += weight
            for c in said:
                if c.split("_")[0] in heads:
                    found[f"{kind}_pair:{c}+{x}"] += pair
    every = said + [f"ordinal_{x}" for x in numbers] + [f"variant_{x}" for x in letters]
    for a in every:
        for b in every:
            if a < b:
                found[f"concept_pair:{a}+{b}"] += 2
    return +found


NAMES = ["DCS_01_inlet_temp_3.PV", "炉温2", "top pressure a", "Flow_b", "zone-1 temperature", "ch_12", "", "raw value", "出口温度_A线", "level 7 upper", "pressure_drop", "PT_07.AV", "x", "upper_furnace_pressure_c", "温度 12 压力 3"]


def test_name_features(spark):
    df = spark.createDataFrame([(n,) for n in NAMES], "name string")
    got = collections.defaultdict(dict)
    for r in names.name_features(df).collect():
        got[r["name"]][r["term"]] = r["tf"]
    assert {n: dict(plain_features(n)) for n in NAMES if plain_features(n)} == dict(got)


def test_char_model_equals_all_prototypes(spark):
    rng = random.Random(6)
    parts = ["inlet", "outlet", "temp", "flow", "top", "pressure", "zone 1", "a", "b", "7", "炉温", "level"]
    records = [("_".join(rng.sample(parts, rng.randint(1, 4))), rng.choice("PQRSTUV")) for _ in range(120)] + [("inlet_temp", "P")] * 3 + [(None, "P"), ("x", None), ("9", "Q")]
    asked = ["_".join(rng.sample(parts, rng.randint(1, 4))) for _ in range(40)] + [None, "", "zzz", "inlet_temp"]
    models = names.fit_names(spark.createDataFrame(records, "n string, l string"), "n", "l", max_features=80)
    rows = names.match_names(spark.createDataFrame([(a,) for a in asked], "h string"), "h", *models, k=3).collect()
    got = collections.defaultdict(list)
    for r in sorted(rows, key=lambda r: r["rank"]):
        got[r["name"]].append((r["label"], r["score"]))

    data = [(n, x) for n, x in records if n is not None and x is not None]
    df = collections.Counter(t for n, _ in data for t in plain_features(n))
    kept = {t: math.log((1 + len(data)) / (1 + c)) + 1 for t, c in sorted(df.items(), key=lambda x: (-x[1], x[0].encode()))[:80]}

    def vector(name):
        f = plain_features(name)
        v = {t: (0.5 + 0.5 * c / max(f.values())) * kept[t] for t, c in f.items() if t in kept}
        size = math.sqrt(sum(x * x for x in v.values())) or 1
        return {t: x / size for t, x in v.items()}

    dot = lambda a, b: sum(x * b.get(t, 0) for t, x in a.items())
    centroids, prototypes = {}, collections.defaultdict(dict)
    for label in {x for _, x in data}:
        total = collections.Counter()
        for n in sorted(n for n, x in data if x == label):
            total.update(vector(n))
            if plain_core(n):
                prototypes[label].setdefault(plain_core(n), vector(n))
        size = math.sqrt(sum(x * x for x in total.values()))
        centroids[label] = {t: x / size for t, x in total.items()}
    for a in {a for a in asked if a is not None}:
        v = vector(a)
        scores = {x: max([dot(v, c), *(dot(v, p) for p in prototypes[x].values())]) for x, c in centroids.items()}
        want = sorted(((x, s) for x, s in scores.items() if s > 0), key=lambda y: (-round(y[1], 9), y[0]))[:3]
        assert [x for x, _ in got[a]] == [x for x, _ in want] and [s for _, s in got[a]] == pytest.approx([s for _, s in want])


# ---- fuzzy matches


def table_lcs(a, b):
    t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i, x in enumerate(a):
        for j, y in enumerate(b):
            t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
    return t[-1][-1]


def test_subsequence_equals_the_table():
    rng = random.Random(1)
    for _ in range(500):
        a, b = ("".join(rng.choice("abc_é") for _ in range(rng.randint(0, 12))) for _ in range(2))
        assert names.subsequence(a, b) == table_lcs(a, b)
        assert names.indel(a, b) == pytest.approx(200 * table_lcs(a, b) / (len(a) + len(b)) if a or b else 100)


def test_weighted_ratio():
    w = names.weighted_ratio
    assert w("", "a") == 0 and w("same", "same") == 100
    assert w("b a", "a b") == 95  # the same tokens
    assert w("flow rate", "flow") == pytest.approx(90)  # the longer holds the shorter, which is one of its tokens
    assert w("abcd", "xabcdxyzw") == pytest.approx(90)
    assert w("ab", "xxxxxxxxxxxxxxxxxxab") == pytest.approx(60)  # ten times as long
    assert w("kitten", "sitting") == pytest.approx(100 * 2 * 4 / 13)
    for a, b in (("pressure_in", "inlet_pressure"), ("a b c", "c b d"), ("x", "yxz")):
        assert w(a, b) == pytest.approx(w(b, a))
    assert names.partial("abc", "zzabczz") == 100 and names.partial("", "x") == 0


def test_fuzzy_match_looks_at_all_that_share_a_bigram(spark):
    rng = random.Random(2)
    left = ["".join(rng.choice("abcd_") for _ in range(rng.randint(0, 9))) for _ in range(60)] + [None, "q", "same", "same"]
    right = ["".join(rng.choice("abcd_") for _ in range(rng.randint(1, 9))) for _ in range(25)] + ["q", "same", None]
    rows = names.fuzzy_match(spark.createDataFrame([(x,) for x in left], "name string"), spark.createDataFrame([(x,) for x in right], "alias string")).collect()
    got = {r["name"]: (r["alias"], r["score"]) for r in rows}
    grams = lambda s: collections.Counter([s] if len(s) == 1 else [s[i : i + 2] for i in range(len(s) - 1)])

    def score(a, b):
        x, y = grams(a.replace("_", "")), grams(b.replace("_", ""))
        shared = sum(n * y[g] for g, n in x.items() if g)
        return shared and 0.58 * names.weighted_ratio(a, b) / 100 + 0.42 * shared / math.sqrt(sum(n * n for n in x.values()) * sum(n * n for n in y.values()))

    for a in {a for a in left if a is not None}:
        best = min(((-round(score(a, b), 9), b) for b in right if b is not None and score(a, b)), default=None)
        assert (a in got) == (best is not None)
        if best:
            assert got[a][0] == best[1] and got[a][1] == pytest.approx(-best[0], abs=1e-8)


# ---- terms of rows, router, groups


def test_row_counts_keep_rows_of_one_id_apart(spark):
    rows = [(1, ["a", "b", "a"]), (1, ["b"]), (2, []), (3, None), (None, ["x", None, "x"])]
    df = spark.createDataFrame(rows, "id long, t array<string>")
    got = sorted(((r["id"] or 0, r["most"], r["term"], r["tf"]) for r in text.row_counts(df, F.col("t"), ["id"]).collect()))
    assert got == [(0, 2, "x", 2), (1, 1, "b", 1), (1, 2, "a", 2), (1, 2, "b", 1)]


def test_ngrams_of_rows_that_share_an_id(spark):
    df = spark.createDataFrame([(1, "abc"), (1, "xyz"), (2, None), (3, "😀a")], "id long, t string")
    got = {(r["n"], r["gram"]): (r["times"], r["docs"]) for r in text.ngram_counts(df, F.col("t"), (2, 3)).collect()}
    assert got == {(2, "ab"): (1, 1), (2, "bc"): (1, 1), (2, "xy"): (1, 1), (2, "yz"): (1, 1), (2, "😀a"): (1, 1), (3, "abc"): (1, 1), (3, "xyz"): (1, 1)}


def test_frequent_terms_are_broadcast_and_the_others_shuffled(spark, monkeypatch):
    monkeypatch.setattr(text, "HOT_TERMS", 2)
    df = spark.createDataFrame([(i, ["the", "of", f"w{i % 7}", f"v{i}"]) for i in range(50)], "id long, t array<string>")
    counts = text.row_counts(df, F.col("t"), ["id"])
    got = {(r["id"], r["term"]): r["weight"] for r in text.tf_idf(counts, 50).collect()}
    assert len(got) == 200 and got[3, "the"] == pytest.approx(math.log(51 / 51) + 1) and got[3, "v3"] == pytest.approx(math.log(51 / 2) + 1)


def test_router_gates(spark):
    rows = [(i, "open the valve now", "act") for i in range(6)] + [(10 + i, "show me the trend", "see") for i in range(6)] + [(20 + i, "what is for lunch", "__none__") for i in range(6)]
    df = spark.createDataFrame(rows, "id long, t string, y string")
    model, labels = text.fit_router(df, "t", "y", least=2)
    asked = spark.createDataFrame([(1, "Open  the valve"), (2, "zzzz qqqq"), (3, None), (4, ""), (5, "lunch is what"), (1, "show me the trend")], "id long, t string")
    got = {(r["id"], r["label"]): r for r in text.route(asked, "id", "t", model, labels, scale=20).collect()}
    assert len(got) == 6 and got[1, "act"]["reason"] == "accepted" and got[1, "see"]["accepted"]
    assert got[5, "__none__"]["reason"] == "out_of_scope"
    blank = [r for (i, _), r in got.items() if i in (2, 3, 4)]
    assert all(r["reason"] == "out_of_scope" or (r["reason"] == "low_confidence" and r["coverage"] == 0) for r in blank)
    assert all(r["probability"] == pytest.approx(1 / 3) and r["margin"] == pytest.approx(0) for r in blank)


def test_groups_of_correlated_columns(spark):
    assert stats.correlated_groups(np.array([[1, 0.95, 0, 0], [0.95, 1, -0.9, 0], [0, -0.9, 1, 0], [0, 0, 0, 1.0]]), list("abcd")) == [["a", "b", "c"]]
    df = spark.createDataFrame([(1.0, 2.0, None, 5.0), (3.0, 8.0, 1.0, 5.0), (None, None, None, 5.0)], "a double, b double, c double, k double")
    got = [r["merged_1"] for r in stats.merge_groups(df, [["a", "b", "k"]]).orderBy(F.col("a").asc_nulls_last()).collect()]
    assert got == [pytest.approx(-1.0), pytest.approx(1.0), None]
    assert stats.merge_groups(df, []).columns == df.columns


@pytest.mark.parametrize("hot", [50_000, 1])
def test_names_with_the_same_features_are_looked_at_once(spark, monkeypatch, hot):
    """300 tags that differ in their numbers alone, and others, beside the same names asked by themselves."""
    records = spark.createDataFrame([("inlet_temp", "P"), ("te_flow", "Q"), ("top temp 1", "Q"), ("outlet_flow_a", "R"), ("te", "R")], "n string, l string")
    models = names.fit_names(records, "n", "l")
    tags, others = [f"TE_{i}" for i in range(300)], ["inlet_temp_b", "temp 1 top", "temp 2 top", "", None, "流"]
    asked = lambda x: spark.createDataFrame([(a,) for a in x], "h string")
    seen, real = [], names.name_features
    monkeypatch.setattr(names, "name_features", lambda df, name="name": seen.append(df.count()) or real(df, name))
    monkeypatch.setattr(text, "HOT_TERMS", hot)
    got = collections.defaultdict(list)
    for r in sorted(names.match_names(asked(tags + others), "h", *models, k=2).collect(), key=lambda r: r["rank"]):
        got[r["name"]].append((r["label"], r["score"], r["rank"]))
    assert seen == [6]  # the tags are one
    assert set(got) == set(tags) | set(others[:3]) and all(got[t] == got["TE_0"] for t in tags)
    for name in ["TE_7", *others[:3]]:
        alone = sorted((r["rank"], r["label"], r["score"]) for r in names.match_names(asked([name]), "h", *models, k=2).collect())
        assert [(x, n) for x, _, n in got[name]] == [(x, n) for n, x, _ in alone] and [s for _, s, _ in got[name]] == pytest.approx([s for *_, s in alone])


def test_words_are_found_in_bytes(spark):
    texts = ["", None, "ab", "cd AB'cd", "éaéKb ſx\n1a2", "中", "z", "Zz zZ-zz", "x" * 300]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "id int, t string").coalesce(1)
    for rows in (1, 3, 256):
        got = sorted((r["id"], r["term"], r["tf"], r["most"]) for r in text.word_counts(df, F.col("t"), ["id"], rows).collect())
        want = []
        for i, t in enumerate(texts):
            found = collections.Counter(re.findall("[a-z]+", re.sub("[^A-Za-z]+", " ", t or "").lower()))
            want += [(i, w, n, max(found.values())) for w, n in found.items()]
        assert got == sorted(want)


@pytest.mark.parametrize(("hot", "labelled"), [(50_000, 500_000), (3, 2)])
def test_centroid_scores_count_the_texts_once(spark, monkeypatch, hot, labelled):
    """Against plain Python, with both sides of the broadcasts; the texts are taken apart once."""
    monkeypatch.setattr(text, "HOT_TERMS", hot)
    monkeypatch.setattr(text, "LABELLED", labelled)
    rng = random.Random(3)
    docs = [(i, " ".join(rng.choice("abcdefgh") * rng.randint(1, 3) for _ in range(rng.randint(0, 9)))) for i in range(60)] + [(90, "zz zz"), (91, None), (None, "a b")]
    labels = {i: rng.choice("PQR") for i in range(0, 60, 3)}
    seen = spark.sparkContext.accumulator(0)
    real = text._letter_words
    monkeypatch.setattr(text, "_letter_words", lambda x: seen.add(len(x)) or real(x))
    df = text.with_labels(spark.createDataFrame(docs, "id long, t string"), spark.createDataFrame(list(labels.items()), "id long, label string"), "id")
    rows = text.centroid_scores(text.word_counts(df, F.col("t"), ["id", "label"]), len(docs)).collect()
    assert seen.value == len(docs)
    counts = [(i, collections.Counter((t or "").split())) for i, t in docs]
    often = collections.Counter(w for _, c in counts for w in c)
    vectors = [(i, {w: (0.5 + 0.5 * n / max(c.values())) * (math.log((1 + len(docs)) / (1 + often[w])) + 1) for w, n in c.items()}) for i, c in counts]
    size = lambda v: math.sqrt(sum(x * x for x in v.values()))
    want = {}
    for label in "PQR":
        mean = collections.Counter()
        for i, v in vectors:
            if labels.get(i) == label:
                mean.update(v)
        want |= {(i, label): sum(x * mean[w] for w, x in v.items()) / size(v) / size(mean) for i, v in vectors if i is not None and any(w in mean for w in v)}
    assert len(rows) == len(want) and {(r["id"], r["label"]): r["score"] for r in rows} == pytest.approx(want)


def test_centroids_without_labels(spark):
    df = spark.createDataFrame([(1, "a b", None)], "id long, t string, label int")
    found = text.centroid_scores(text.word_counts(df, F.col("t"), ["id", "label"]), 1)
    assert found.count() == 0 and found.columns == ["id", "label", "score"]


def plain_grams(t):
    t = re.sub("[ \t\n\x0b\f\r]+", " ", t or "").strip(" ")
    return collections.Counter(t[i : i + n] for n in (2, 3, 4) for i in range(len(t) - n + 1))


def test_grams_of_a_router(monkeypatch):
    """However texts are cut into blocks, and characters of any length; grams do not reach from a text into the next."""
    rng = random.Random(9)
    texts = [None, "", " ", "a", "\t ab\x0b\r\n c  ", "😀a😀a😀", "é   x", "漢" * 9] + ["".join(rng.choice("ab é漢😀\n") for _ in range(rng.randint(0, 40))) for _ in range(80)]
    batch = pa.RecordBatch.from_pydict({"id": list(range(len(texts))), "t": pa.array(texts, pa.string())})
    for rows, size in ((1024, 1 << 21), (5, 60), (3, 1)):
        monkeypatch.setattr(text, "BLOCK_ROWS", rows)
        monkeypatch.setattr(text, "BLOCK_BYTES", size)
        got = collections.defaultdict(collections.Counter)
        for block in text._blocks([batch.slice(0, 30), batch.slice(30)]):
            assert block.num_rows <= rows
            for n, row, code, tf, terms in text._router_grams(block.column(1)):
                for r, c, x in zip(row.tolist(), code.tolist(), tf.tolist()):
                    assert len(terms[c].as_py()) == n
                    got[block.column(0)[r].as_py()][terms[c].as_py()] += x
        assert [got[i] for i in range(len(texts))] == [plain_grams(t) for t in texts]


def test_router_scores_rows_where_they_are(spark):
    """Scores against plain Python; rows of one id stay apart, and no gram is shuffled."""
    rng = random.Random(12)
    rows = [(i % 70, "".join(rng.choice("abc É\n") for _ in range(rng.randint(0, 30))), rng.choice(["P", "Q", None])) for i in range(90)] + [(None, None, None), (1, "zzzz", None)]
    df = spark.createDataFrame(rows, "id long, t string, y string")
    model, labels = text.fit_router(df, "t", "y", vocabulary=60)
    learnt = [(plain_grams(t.lower()), y) for _, t, y in rows if y]
    often = collections.Counter(g for c, _ in learnt for g in c)
    kept = [g for g, n in sorted(often.items(), key=lambda x: (-x[1], x[0].encode())) if n >= 3][:60]
    of = {y: {g: sum(c[g] for c, z in learnt if z == y) for g in kept} for y in "PQ"}
    idf = {g: math.log((1 + len(learnt)) / (1 + often[g])) + 1 for g in kept}
    want = []
    for i, t, _ in rows:
        c = plain_grams((t or "").lower())
        x = {g: (1 + math.log(n)) * idf[g] for g, n in c.items() if g in idf}
        size = math.sqrt(sum(v * v for v in x.values())) or 1
        z = {y: math.log(sum(a == y for _, a in learnt) / len(learnt)) + 3 * sum(v * math.log((of[y][g] + 1) / (sum(of[y].values()) + len(kept))) for g, v in x.items()) / size for y in "PQ"}
        pairs = [g for g in c if len(g) == 2]
        want.append((i or -1, max(z, key=z.get), 1 / (1 + math.exp(-abs(z["P"] - z["Q"]))), sum(g in idf for g in pairs) / max(1, len(pairs))))
    found = text.route(df, "id", "t", model, labels, scale=3)
    got = [(r["id"] if r["id"] else -1, r["label"], r["probability"], r["coverage"]) for r in found.collect()]
    flat = lambda x: [v for r in sorted((i or 0, y, round(p, 6), round(c, 6)) for i, y, p, c in x) for v in r]
    assert flat(got) == flat(want)
    assert "hashpartitioning" not in found._jdf.queryExecution().executedPlan().toString()
