"""A corpus pipeline of five stages over the table `documents`.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its rows are written as Parquet and
read again as the next stage's docs. All stages but the last return the columns of documents.
"""

from __future__ import annotations

import uuid

import public_tokenizers
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import bpe, decontaminate, jaccard, langid, substring
from tidemark.llm.shared import column, remove, shared_dir

#: Documents of which no language is likelier than this are rejected, besides those without a letter.
LEAST_SCORE = 0.3


def _aside(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """`docs` under names that clash with no operator's results, but for the text, which keeps its name; and those names."""
    names = [c if c == "text" else f"column_{i}" for i, c in enumerate(docs.columns)]
    return docs.select(*(column(c).alias(n) for n, c in zip(names, docs.columns, strict=True))), names


def _back(docs: DataFrame, names: list[str], changed: dict[str, Column]) -> list[Column]:
    """The columns of `docs` from their names put aside, some of them changed."""
    return [changed.get(c, F.col(n)).alias(c) for n, c in zip(names, docs.columns, strict=True)]


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a recognisable language. The network learns from the documents' own labels.

    Documents whose text is null or has no letter go; an empty table stays empty. Other columns may have any name.
    """
    aside, names = _aside(docs)
    known = langid.predict(aside, langid.fit(docs), names)
    return known.where((F.col("lang_pred") != "und") & (F.col("score") >= LEAST_SCORE)).select(*_back(docs, names, {}))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id.

    Texts without words and documents without an id are in no group and stay; rows that repeat one
    doc_id stay or go together.
    """
    groups = jaccard.link_components(docs, k=5, percent=80)
    gone = groups.where("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*map(column, docs.columns))


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of 35 words or more that occur elsewhere too; other documents stay as they are.

    A document that consists of repeated passages stays with an empty text, and so does one whose text is null.
    n_chars is that of the new text. Other columns may have any name.
    """
    aside, names = _aside(docs)
    others = [n for n, c in zip(names, docs.columns, strict=True) if c not in ("text", "n_chars")]
    done = substring.remove_repeats(aside, others, window=35, leave_clean=True)
    return done.select(*_back(docs, names, {"text": F.col("kept"), "n_chars": F.length("kept").cast("long")}))


def benchmark_free(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item: 0.8 or more of its five-word shingles.

    Documents without an id or a text cannot hold one and stay.
    """
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    leaks = decontaminate.contaminated(docs, items, k=5, share=0.8).select("doc_id").distinct()
    return docs.join(leaks, "doc_id", "left_anti").select(*map(column, docs.columns))


def encoded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token count and digests of the ids and of the text decoded from them, for each remaining document."""
    return bpe.encode(docs, public_tokenizers.path("word_bpe_49k.json"), ["doc_id", "lang", "source"])


STAGES = [
    ("language_id", language_id),
    ("near_duplicates", near_duplicates),
    ("repeated_passages", repeated_passages),
    ("benchmark_free", benchmark_free),
    ("encoded", encoded),
]

#: The first stage's network cannot be written in SQL; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages in order, each written to the shared folder and read again; a stage's rows are removed when the next one's are written."""
    folder = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for number, (name, stage) in enumerate(STAGES):
        at = f"{folder}/{number}-{name}"
        stage(spark, docs, sf_dir).write.parquet(at)
        docs = spark.read.parquet(at)
        if before is not None:
            remove(spark, before)
        before = at
    return docs
