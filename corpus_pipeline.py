"""Corpus preparation in five stages over the table ``documents``.

Each stage takes (spark, docs, sf_dir) and returns the documents that it keeps, with all their columns; the last adds
token digests. Rows without a doc_id cannot be named as copies or as contaminated, and pass those stages. Rows that
share a doc_id stay or go together. Extra columns of the documents are kept; names that begin with ``__`` are reserved.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quintil.llm import decontaminate, lines, pieces, quality, similar
from quintil.llm.queries import model_path
from quintil.llm.text import read_table
from quintil.session import settle


def _numbered(docs: DataFrame) -> tuple[DataFrame, dict[str, str]]:
    """The documents under numbered column names, which no operator's output has."""
    names = {c: f"c{i}" for i, c in enumerate(docs.columns)}
    return docs.toDF(*names.values()), names


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the ranking predicts to be good."""
    plain, names = _numbered(docs)
    labels = read_table(spark, sf_dir, "labels").select(F.col("doc_id").alias(names["doc_id"]), "quality")
    scored = quality.score(plain, labels, names["doc_id"], names["text"], list(names.values()))
    return scored.where("predicted = 1").select(*names.values()).toDF(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without later copies of repeated line runs; ``n_chars`` follows the text."""
    plain, names = _numbered(docs)
    cut = lines.remove_repeated_lines(plain, names["doc_id"], names["text"]).select(*names.values()).toDF(*docs.columns)
    return cut.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The document with the smallest id of each component of documents that share four fifths of their five-word shingles: links of SimHash, then of MinHash, all checked on the sets."""
    named = docs.where("doc_id IS NOT NULL")
    first = similar.first_of_each(named).withColumnRenamed("key", "doc_id")
    return named.join(first, "doc_id", "left_semi").select(*docs.columns).unionByName(docs.where("doc_id IS NULL"))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no benchmark item occurs."""
    hit = decontaminate.contaminated(docs, read_table(spark, sf_dir, "benchmark")).select("doc_id").distinct()
    return docs.join(hit, "doc_id", "left_anti").select(*docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token digests of the documents left."""
    return pieces.encode(docs, model_path())


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("sentencepiece tokens", tokens),
]

# Learnt scores and the vocabulary's merges have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next."""
    docs = read_table(spark, sf_dir, "documents")
    for number, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if number < len(STAGES):
            docs = settle(docs)
    return docs
