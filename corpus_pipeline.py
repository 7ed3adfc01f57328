"""A corpus pipeline: language ID, exact dedup, n-gram Jaccard join, benchmark decontamination, BPE.

Every stage works on all that the one before it kept, and what it decides takes effect,
row by row: a doc_id may be null or repeat with different texts. All but the last return
the columns of documents. run() writes each stage's rows as Parquet to the shared folder,
reads them again for the next one and removes what no stage reads any more.

Null, empty and very long texts, repeated rows, empty tables and further columns have the results
that the operators' docstrings state; no stage fails on them.
"""

from __future__ import annotations

import contextlib
from collections.abc import Callable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_round_trip
from tessera.llm.common import Scratch, text_of, unused
from tessera.llm.decontaminate import leak_searches
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.langid import UNDETERMINED, language_column, train_language_model
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.queries import VOCABULARY
from tessera.session import table

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

#: Marks of dropped rows up to this number, of about 250 bytes each, are broadcast; beyond it the join shuffles by mark.
BROADCAST_ROWS = 200_000


def marked(docs: DataFrame) -> tuple[DataFrame, str]:
    """The table with a column that tells its rows apart, the same in every scan, and that column's name.

    Rows of Parquet files are told apart by file and place in it. Any other table is written
    down with numbers first, as its rows have no order of their own.
    """
    name = unused("_row", docs)
    with contextlib.suppress(AnalysisException):  # not rows of files, or of files without places
        return docs.withColumn(name, F.struct("_metadata.file_path", "_metadata.row_index")), name
    numbered = docs.withColumn(name, F.monotonically_increasing_id())
    return Scratch(docs.sparkSession, "pipeline-rows").stage(numbered, "rows"), name


def without(docs: DataFrame, dropped: DataFrame, row: str) -> DataFrame:
    """The rows whose mark is not among the dropped ones; these are written down first, as they take long to find."""
    dropped = Scratch(docs.sparkSession, "pipeline-dropped").stage(dropped.select(row), "rows")
    if dropped.limit(BROADCAST_ROWS + 1).count() <= BROADCAST_ROWS:
        dropped = F.broadcast(dropped)
    return docs.join(dropped, row, "left_anti").drop(row)


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects the texts whose language is undetermined: null, empty, or without any letter.

    Without a labelled row to learn from, texts with a letter stay; so do those of a language labelled `und`, whose score is above 0.
    """
    model = train_language_model(docs)
    found = unused("_found", docs)
    told = docs.withColumn(found, language_column(model, docs, unlearned=None))
    rejected = (F.col(f"{found}.lang_pred") == UNDETERMINED) & (F.col(f"{found}.score") == 0)
    return told.where(~F.coalesce(rejected, F.lit(False))).drop(found)


def dedup_exact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of equal texts, the row that exact dedup keeps; of rows that are equal in all, one."""
    docs, row = marked(docs)
    return without(docs, exact_dedup(docs, digest_all=True, row=row).where("NOT kept"), row)


def dedup_near(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of the n-gram Jaccard join, the document with the smallest doc_id; one with none comes last."""
    docs, row = marked(docs)
    found = ngram_jaccard_join(docs, carry=(row,)).where("component IS NOT NULL")
    order = F.struct(F.col("doc_id").isNull().alias("none"), F.col("doc_id").alias("id"), F.col(row).alias("row"))
    found = Scratch(spark, "pipeline-near").stage(found.select("component", order.alias("place")), "found")
    first = found.groupBy("component").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    dropped = found.join(first, "component").where("place <> first").select(F.col("place.row").alias(row))
    return without(docs, dropped, row)


def decontaminate(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a verified test item of benchmark; what a shard of the items leaves is written for the next one's scan."""
    scratch = Scratch(spark, "pipeline-leaks")
    kept = None
    for shard, search in enumerate(leak_searches(table(spark, sf_dir, "benchmark"))):
        docs = docs if kept is None else scratch.stage(kept, f"shard{shard}")
        kept = docs.where(F.size(search(text_of(docs))) == 0)
    return kept


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every text: doc_id, n_tokens, ids (little-endian unsigned 32-bit integers) and digests of ids and decoded text."""
    coded = bpe_round_trip(docs, VOCABULARY)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        "ids",
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


STAGES: list[tuple[str, Stage]] = [
    ("language_id", language_id),
    ("exact_dedup", dedup_exact),
    ("ngram_jaccard", dedup_near),
    ("decontaminate", decontaminate),
    ("bpe", encode),
]

#: SQL can express neither the learned stages nor the merges; tests hold run() against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Applies the stages to documents, each to what is read back from the one before."""
    scratch = Scratch(spark, "pipeline")
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        with Scratch.temporary():
            docs = scratch.stage(stage(spark, docs, sf_dir), name)
        scratch.keep_only(name)
    return STAGES[-1][1](spark, docs, sf_dir)
