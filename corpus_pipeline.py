"""The corpus pipeline: documents go through five operators, each stage's result written and read again.

toxicity drops toxic documents; line_dedup cuts boilerplate lines; jaccard_join keeps one document of each group of near
copies; mixing repeats documents so that sources meet their weights; packing lays the tokens into sequences.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kilnworks.llm import jaccard, lines, mixing, packing, toxicity
from kilnworks.llm._common import materialize, table
from kilnworks.llm.queries import tokenizer_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled rows outside the held-out fold, scores below 0.5.

    Null and empty texts, null ids and repeated rows stay as they are; columns other than those of documents go here
    and in the next stages.
    """
    docs = docs.select(*COLUMNS)
    return toxicity.keep_clean(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def cut_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document, without boilerplate lines that another keeps; n_chars follows the text.

    Null texts stay null with null n_chars; rows with a null id keep no line for others; a row of boilerplate alone
    stays with an empty text.
    """
    return lines.dedup_lines(docs.select(*COLUMNS)).withColumn("n_chars", F.char_length("text").cast("long")).select(*COLUMNS)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group linked by shingles of five words at a similarity of 0.8 or more: that of the smallest id.

    Rows that share an id are one document with several texts, of which none is lost; equal ones stay once. Rows with
    a null id and texts without words stay.
    """
    return jaccard.one_of_each(docs.select(*COLUMNS), words=5, percent=80).select(*COLUMNS)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document once at least, those of small sources up to twice.

    A null source is the one with the empty name; null and empty texts have no tokens and stay.
    """
    return mixing.mix_sources(docs.select(*COLUMNS)).select(*COLUMNS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of documents in sequences of 4096 tokens; null texts give the end token alone, null ids stay null."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [("toxicity", drop_toxic), ("line_dedup", cut_lines), ("jaccard_join", drop_near_copies), ("mixing", mix), ("packing", pack)]

#: No SQL can express the classifier or the tokenizer.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents."""
    docs = table(spark, sf_dir, "documents")
    for i, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = materialize(docs, f"pipeline-{name}")
    return docs
