"""The queries of this subpackage: each applies its operator, with production parameters, to its whole table."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.llm.bpe import bpe_round_trip
from tessera.llm.conversation_repair import repair_conversations
from tessera.llm.conversation_trie import prefix_trie
from tessera.llm.decontaminate import find_leaks
from tessera.llm.exact_dedup import exact_dedup
from tessera.llm.langid import identify_language
from tessera.llm.ngram_join import ngram_jaccard_join
from tessera.llm.oracle import ORACLE_SQL
from tessera.llm.order_minhash import fingerprint_documents
from tessera.llm.pii import KINDS, find_personal_data
from tessera.llm.quality import classify_quality
from tessera.llm.sharding import shard_documents
from tessera.llm.toxicity import classify_toxicity
from tessera.llm.url_filters import filter_urls, host_of
from tessera.session import table

#: The public vocabulary file that op2 reads; a parameter of the operator.
VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")

__all__ = ["ORACLE_SQL", "QUERIES"]


def op1_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = exact_dedup(table(spark, sf_dir, "documents"), digest_all=True)
    return found.withColumn("text_sha256", F.lower(F.hex("digest"))).drop("digest")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    coded = bpe_round_trip(table(spark, sf_dir, "documents"), VOCABULARY)
    return coded.select(
        "doc_id",
        (F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
        F.sha2("ids", 256).alias("ids_sha256"),
        F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"),
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op4_ngram_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_jaccard_join(table(spark, sf_dir, "documents")).drop("rep", "component")


#: The tables have no fetch dates: a page counts as fetched on a day of 2024 that its number decides.
FETCHED = "date_add(DATE '2024-01-01', CAST((page_id * 37) % 366 AS INT))"


def list_changes(pages: DataFrame) -> DataFrame:
    """Dated changes of filter lists, as the tables have none: derived from the md5 of every host of the pages.

    Each host is added to a list on a day of 2024. Half of them are removed again, half of
    those are added once more, and a few are removed on the day they were added. Half of the
    hosts have an entry of the opposite action for the first step of their paths, and each domain
    above a host (its last two labels) is added to a list of its own.
    """
    hosts = pages.select(host_of(F.col("url")).alias("host")).where("host IS NOT NULL").distinct()
    digit = lambda k: F.conv(F.substring(F.md5(F.col("host").cast("binary")), k, 2), 16, 10).cast("int")
    told = hosts.select("host", *[digit(2 * k + 1).alias(f"d{k}") for k in range(6)])
    day = lambda n: F.expr(f"date_add(DATE '2024-01-01', {n})")
    name = F.concat(F.lit("list-"), (F.col("d0") % 4).cast("string"))
    action, other = (F.expr(f"CASE WHEN d1 < 128 THEN '{x}' ELSE '{y}' END") for x, y in (("block", "allow"), ("allow", "block")))
    entry = lambda where, list_name, what, pattern, change, dated: told.where(where).select(list_name.alias("list_name"), what.alias("action"), pattern.alias("pattern"), F.lit(change).alias("change"), dated.alias("dated"))
    host, domain = F.col("host"), F.substring_index("host", ".", -2)
    parts = [
        entry("true", name, action, host, "add", day("d2")),
        entry("d3 < 128", name, action, host, "remove", day("d2 + d3 % 90")),
        entry("d3 < 64", name, action, host, "add", day("d2 + d3 % 90 + 1 + d4 % 60")),
        entry("d3 >= 250", name, action, host, "remove", day("d2")),
        entry("d4 < 128", F.lit("paths"), other, F.concat(host, F.lit("/"), F.expr("substr('defresen', 1 + 2 * (d5 % 4), 2)")), "add", day("d5")),
        entry("true", F.lit("domains"), F.lit("block"), domain, "add", day("300")),
    ]
    out = parts[0]
    for part in parts[1:]:
        out = out.unionByName(part)
    return out


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages")
    return filter_urls(pages.selectExpr("page_id", "url", f"{FETCHED} AS fetched_at"), list_changes(pages.select("url")))


def op6_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_personal_data(table(spark, sf_dir, "documents"))
    packed = lambda spans: F.concat_ws(",", F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))))
    base = F.filter("spans", lambda s: s["base"])
    of_kind = lambda kind: F.filter("base", lambda s: s["kind"] == kind)
    counts = [F.size(of_kind(kind)).cast("long").alias(f"n_{kind}") for kind in KINDS]
    return found.withColumn("base", base).select(
        "doc_id",
        *counts,
        F.sha2(packed(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        packed(F.col("spans")).alias("spans"),
    )


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"), shards=24)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return identify_language(table(spark, sf_dir, "documents"))


def op9_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify_quality(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_conversation_trie(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prefix_trie(table(spark, sf_dir, "conversations"))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair_conversations(table(spark, sf_dir, "conversations"))


def op13_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fingerprint_documents(table(spark, sf_dir, "documents"))
    digest = F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256")
    return found.select("doc_id", "n_chars", digest, "fingerprint", "edited_fingerprint", "near_edited", "near_next")


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_exact_dedup": op1_exact_dedup,
    "op2_bpe": op2_bpe,
    "op3_toxicity": op3_toxicity,
    "op4_ngram_jaccard": op4_ngram_jaccard,
    "op5_url_filters": op5_url_filters,
    "op6_pii": op6_pii,
    "op7_sharding": op7_sharding,
    "op8_language_id": op8_language_id,
    "op9_decontaminate": op9_decontaminate,
    "op10_quality": op10_quality,
    "op11_conversation_trie": op11_conversation_trie,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_fingerprints": op13_fingerprints,
}
