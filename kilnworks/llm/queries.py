"""Queries of the corpus operators over the synthetic tables, and DuckDB SQL for those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import _common, ann, bpe, divergence, jaccard, licenses, lines, mixing, packing, resampling, substrings, topk, toxicity, warc
from ._common import table

TOKENIZER, BYTE_TOKENIZER = "word_bpe_49k.json", "byte_bpe_50k.json"


def tokenizer_path(name: str = TOKENIZER) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.exact_top_k(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0, k=5)


def op2_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed = mixing.mix_sources(table(spark, sf_dir, "documents").select("doc_id", "source", "text"))
    return mixed.select("doc_id", "source", "epoch", "mix_block", "mix_tokens")


def op3_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeated_spans(table(spark, sf_dir, "documents")).drop("version")


def op4_ann(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ann.nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0, k=20)


def op5_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.jaccard_components(table(spark, sf_dir, "documents"), words=3, percent=90)


def op6_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), tokenizer_path())


def op7_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = _common.scratch_path(spark, "warc")
    warc.write_warc(warc.mark_revisits(table(spark, sf_dir, "pages")), path)
    return warc.read_warc(spark, path).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op8_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    cut = lines.dedup_lines(table(spark, sf_dir, "documents"))
    return cut.select("doc_id", "text", "n_lines", "n_removed")


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents")).drop("spans")


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op11_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


def op12_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = tokenizer_path(BYTE_TOKENIZER)
    coded = bpe.encode(table(spark, sf_dir, "documents").select("doc_id", "text"), path)
    texts = bpe.decode(coded, path)
    digest = lambda c: F.sha2(c.cast("binary"), 256)
    return texts.select("doc_id", F.size("ids").cast("long").alias("n_tokens"), digest(F.array_join(F.col("ids").cast("array<string>"), ",")).alias("ids_sha256"), digest(F.col("text")).alias("decoded_sha256"))


def op13_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resampling.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in (op1_exact_topk, op2_mixing, op3_substring_dedup, op4_ann, op5_jaccard_join, op6_packing, op7_warc, op8_line_dedup, op9_licenses, op10_toxicity, op11_divergence, op12_bpe, op13_resampling)}

ORACLE_SQL: dict[str, str] = {
    "op1_exact_topk": """
        WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS q FROM embeddings),
        s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_dot_product(a.q, b.q) AS BIGINT) AS score FROM v a JOIN v b ON a.vec_id <> b.vec_id WHERE a.vec_id % 50 = 0),
        r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
        SELECT * FROM r WHERE rank <= 5""",
    "op7_warc": """
        WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest FROM pages),
        t AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS top FROM p)
        SELECT page_id, payload_bytes, payload_digest, CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN 'revisit' ELSE 'response' END AS record_type,
               CASE WHEN payload_bytes >= 1000 AND page_id <> top THEN top END AS refers_to FROM t""",
    "op8_line_dedup": """
        WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS place FROM documents),
        b AS (SELECT trim(line, ' ') AS t, min(doc_id) AS first FROM l WHERE length(trim(line, ' ')) >= 10 GROUP BY 1 HAVING count(DISTINCT source) >= 10),
        k AS (SELECT l.*, b.t IS NOT NULL AND l.doc_id <> b.first AS cut FROM l LEFT JOIN b ON trim(l.line, ' ') = b.t),
        d AS (SELECT doc_id, coalesce(string_agg(line, chr(10) ORDER BY place) FILTER (NOT cut), '') AS text, count(*) AS n_lines, count(*) FILTER (cut) AS n_removed FROM k GROUP BY doc_id)
        SELECT d.* FROM d
        UNION ALL SELECT doc_id, NULL, 0, 0 FROM documents WHERE text IS NULL""",
    "op11_divergence": """
        WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS words FROM documents),
        o AS (SELECT row, lang, source, unnest(words) AS term FROM d),
        k AS (SELECT lang, term, count(*) AS lang_count FROM o GROUP BY ALL HAVING count(DISTINCT row) >= 3),
        c AS (SELECT o.lang, o.source, o.term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY ALL),
        v AS (SELECT lang, count(*) AS v, sum(lang_count) AS n FROM k GROUP BY lang),
        g AS (SELECT DISTINCT lang, source FROM d),
        t AS (SELECT g.lang, g.source, coalesce(sum(c.n), 0) AS n FROM g LEFT JOIN c ON g.lang = c.lang AND g.source = c.source GROUP BY ALL),
        p AS (SELECT t.lang, t.source, k.term, coalesce(c.n, 0) AS n, 1 + CAST(1000000000 * (coalesce(c.n, 0) + 1) AS HUGEINT) // (t.n + v.v) AS p, 1 + CAST(1000000000 * (k.lang_count + 1) AS HUGEINT) // (v.n + v.v) AS q
              FROM t JOIN v USING (lang) JOIN k USING (lang) LEFT JOIN c ON c.lang = t.lang AND c.source = t.source AND c.term = k.term),
        s AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
        r AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
              UNION ALL SELECT lang, source, 'term', term, CAST((p - q) * (p - q) // q AS BIGINT) FROM p WHERE n > 0 AND p > q)
        SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INTEGER) AS rank FROM r) WHERE part = 'pair' OR rank <= 200""",
}
