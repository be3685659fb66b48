"""The pipeline's stages on small tables, and the registered queries on the given ones."""

from __future__ import annotations

import collections
import os
import random

import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from kilnworks.llm import queries

SF = "/root/testdata/sf0.001"


def test_stages(spark, tmp_path):
    rng = random.Random(11)
    make = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))
    rows = [(i, make(rng.randint(20, 60)), "en", f"s{i % 12}", 0) for i in range(400)]
    rows = [(i, t + (" moron" if i % 8 == 0 else ""), lang, s, n) for i, t, lang, s, n in rows]
    rows += [(1000 + i, rows[i][1] + " more", "en", "s0", 0) for i in range(1, 8)] + [(2000, None, "en", "s1", None), (2001, "", None, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, int(i % 8 == 0)) for i in range(400)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    seen = {}
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, str(tmp_path))
        docs.write.parquet(f"{tmp_path}/{name}")
        docs = spark.read.parquet(f"{tmp_path}/{name}")
        seen[name] = docs
        if name != "packing":
            assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
    ids = lambda name: collections.Counter(r["doc_id"] for r in seen[name].select("doc_id").collect())
    clean = {i for i, *_ in rows if not (i < 400 and i % 8 == 0)}
    assert set(ids("toxicity")) == clean == set(ids("line_dedup"))
    assert set(ids("jaccard_join")) == clean - set(range(1001, 1008))
    assert set(ids("mixing")) == set(ids("jaccard_join")) == set(ids("packing"))
    assert max(ids("mixing").values()) <= 2
    packed = seen["packing"].groupBy("doc_id").agg(F.sum("length").alias("n"), F.max("doc_tokens").alias("t")).collect()
    copies = ids("mixing")
    assert all(r["n"] == r["t"] * copies[r["doc_id"]] for r in packed)


def test_stages_with_odd_rows(spark, tmp_path):
    """Null and shared ids, empty texts, repeated rows and columns of other names go through; an empty table gives no rows."""
    rng = random.Random(12)
    make = lambda n: " ".join("".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 6))) for _ in range(n))
    one, two, copied = make(30), make(30), make(40)
    rows = [(1, one), (1, two), (1, one), (None, make(20)), (None, None), (2, None), (3, ""), (4, copied), (5, copied), (6, copied + " tail"), (7, make(3000))]
    docs = spark.createDataFrame([(i, t, "en", None if i == 3 else f"s{i}", 0, "x", 1) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, epoch string, _id int")
    for each in (docs, docs.limit(0)):
        folder = f"{tmp_path}/{each.count()}"
        each.write.parquet(f"{folder}/documents.parquet")
        spark.createDataFrame([], "doc_id long, quality int, toxic int").write.parquet(f"{folder}/labels.parquet")
        kept, now = {}, each
        for name, stage in corpus_pipeline.STAGES:
            stage(spark, now, folder).write.parquet(f"{folder}/{name}")
            now = spark.read.parquet(f"{folder}/{name}")
            kept[name] = collections.Counter((r["doc_id"], r["text"]) if name != "packing" else r["doc_id"] for r in now.collect())
        if not each.isEmpty():
            assert kept["toxicity"] == kept["line_dedup"] == collections.Counter(rows)
            want = collections.Counter(r for r in rows if r[0] not in (5, 6))
            want[(1, one)] = 1
            assert kept["jaccard_join"] == want
            assert set(kept["mixing"]) == set(want) and set(kept["packing"]) == {i for i, _ in want}
        else:
            assert not any(kept.values())


@pytest.mark.skipif(not os.path.isdir(SF), reason="the tables are not here")
@pytest.mark.parametrize("name", sorted(queries.ORACLE_SQL))
def test_query(name, spark):
    duckdb = pytest.importorskip("duckdb")
    con = duckdb.connect()
    for table in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{SF}/{table}.parquet'")
    df = queries.QUERIES[name](spark, SF)
    found = con.execute(queries.ORACLE_SQL[name])
    names = [x[0] for x in found.description]
    assert collections.Counter(tuple(r[c] for c in names) for r in df.collect()) == collections.Counter(found.fetchall())
