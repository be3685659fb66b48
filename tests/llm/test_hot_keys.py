"""A payload or text that a third of all rows share, with broadcasts off and few rows counting as hot."""

from __future__ import annotations

import collections

from pyspark.sql import functions as F

from kilnworks.llm import licenses, lines, mixing, warc
from kilnworks.llm._common import LOWER_AZ


def test_hot_payload_is_dealt_into_parts(spark, monkeypatch):
    monkeypatch.setattr("kilnworks.llm._common.HOT_ROWS", 20)
    rows = [(i, f"u{i}", "hot " * 300) for i in range(100)] + [(100 + i, f"u{i}", f"page {i // 2} " * 200) for i in range(200)] + [(None, "u", "hot " * 300)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = collections.Counter(map(tuple, warc.mark_revisits(pages, broadcast_rows=0).select("page_id", "payload_digest", "record_type", "refers_to").collect()))
    want = collections.Counter(map(tuple, warc.mark_revisits(pages).select("page_id", "payload_digest", "record_type", "refers_to").collect()))
    assert got == want and sum(got.values()) == 301
    assert sum(n for (_, _, kind, to), n in got.items() if kind == "revisit" and to == 99) == 100


def test_rows_without_gating_words_are_dealt_out(spark):
    """A third of the rows are empty and a third one text without any license; all have their result, and no key is theirs together."""
    rows = [(i, "") for i in range(100)] + [(100 + i, "plain words only") for i in range(100)] + [(200 + i, "Licensed under the MIT License.") for i in range(50)] + [(None, None), (None, "mit license"), (300, "mit license " * 5000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = collections.Counter((r["doc_id"], r["n_words"], r["n_base"], r["base_labels"]) for r in licenses.scan_licenses(docs).collect())
    plain = lambda t: (t or "").translate(str.maketrans(*LOWER_AZ)).replace(".", "").split()
    want = collections.Counter()
    for i, t in rows:
        w = plain(t)
        n = sum(w[k : k + 2] == ["mit", "license"] for k in range(len(w)))
        want[i, len(w), n, "mit" if n else ""] += 1
    assert got == want
    assert docs.filter(F.col("text") == "").count() == 100


def test_hot_lines_are_cut_in_parts(spark, monkeypatch):
    monkeypatch.setattr("kilnworks.llm.lines.HOT_ROWS", 20)
    monkeypatch.setattr("kilnworks.llm._common.HOT_ROWS", 20)
    rows = [(i, f"own line of document {i}\nthe line that everybody has\nsecond line of {i % 40}, shared", f"site {i % 30}") for i in range(400)] + [(None, "the line that everybody has", "x"), (5, None, "y"), (400, "", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    look = lambda constant: collections.Counter((r["doc_id"], r["text"], tuple(r["removed_lines"])) for r in lines.dedup_lines(docs, constant_lines=constant).collect())
    got = look(0)
    assert got == look(20_000) and sum(got.values()) == 403
    assert sum(n for (_, _, gone), n in got.items() if 1 in gone) == 399  # the smallest id keeps it


def test_hot_blocks_are_mixed_in_parts(spark, monkeypatch):
    monkeypatch.setattr("kilnworks.llm._common.HOT_ROWS", 5)
    rows = [(i, f"text number {i} of a source", "hot" if i % 3 else f"s{i % 7}") for i in range(900)] + [(1000 + i, "", "hot") for i in range(300)] + [(None, "no id", None), (2000, None, "hot")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    look = lambda n: collections.Counter((r["doc_id"], r["epoch"], r["mix_block"]) for r in mixing.mix_sources(docs, broadcast_rows=n, max_blocks=64).collect())
    assert look(1) == look(100_000)
