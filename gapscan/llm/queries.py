"""One query for each operator, on its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapscan.llm import chat, decontaminate, embedding_pq, hard_negatives, minhash, packing, phrase_dedup, pii, ranked_search, sharding, suffix_dedup, toxicity, url_filter
from gapscan.llm.common import known_to_workers

Query = Callable[[SparkSession, str], DataFrame]


def tokenizer_paths() -> tuple:
    return (public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    known_to_workers(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_minhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    classes, _ = minhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return classes.select("doc_id", "class_id", minhash.is_kept(classes).alias("kept"))


def op2_embeddings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_pq.near_vectors(table(spark, sf_dir, "embeddings"))


def op3_suffix(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = suffix_dedup.remove_repeats(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return found.select(
        "doc_id", "n_bytes", (F.col("n_bytes") - F.octet_length("kept")).alias("n_removed"),
        F.size("starts").cast("bigint").alias("n_spans"), F.sha2("kept", 256).alias("kept_sha256"),
    )


def op4_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    field = pii.train(pii.labelled_table(spark))
    found = pii.find_personal_data(table(spark, sf_dir, "documents").select("doc_id", "text"), field)
    joined = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    counts = [F.expr(f"cast(size(filter(base_spans, s -> s.kind = '{k}')) as bigint)").alias(f"n_{k}") for k in pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(joined("base_spans"), 256).alias("base_sha256"), joined("spans").alias("spans"))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = "\\### Assistant: </turn> ok"
    hard = spark.createDataFrame([(-7, 0, "user", said), (-7, 1, "assistant", said)], "conv_id bigint, turn bigint, role string, text string")
    given = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(hard)
    return chat.read_back(chat.format_windows(given))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    scored = toxicity.score(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))
    held_out = F.crc32(F.col("doc_id").cast("string")) % toxicity.FOLDS == 0
    return scored.select("doc_id", held_out.alias("held_out"), "score", "predicted", "flagged")


def op5_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    placed = sharding.shard_by_size(table(spark, sf_dir, "documents"), 40)
    return placed.select(
        "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard")
    )


#: The rules of the contract: host, path, action.
URL_RULES = [
    ("org", "/", "allow"),
    ("example.org", "/es/", "block"),
    ("example.org", "/en/1", "block"),
    ("com", "/fr/", "allow"),
    ("com", "/de/", "block"),
]


def op8_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, action string")
    judged = url_filter.filter_urls(table(spark, sf_dir, "pages").select("page_id", "url"), rules)
    return judged.select("page_id", "host", "path", "rule", "verdict")


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents").select("doc_id", "text"), tokenizer_paths())


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate.find_contamination(
        table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark")
    )
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


def op11_phrases(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, texts = phrase_dedup.remove_phrases(table(spark, sf_dir, "documents").select("doc_id", "text"))
    removed = F.expr("aggregate(zip_with(starts, ends, (a, b) -> b - a), 0L, (n, m) -> n + m)").alias("n_removed")
    texts = texts.select("digest", "n_words", removed, F.sha2("kept", 256).alias("kept_sha256"))
    return rows.join(texts, "digest").select("doc_id", "n_words", "n_removed", "kept_sha256")


def op12_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hard_negatives.mine(table(spark, sf_dir, "embeddings"))


def op13_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Query] = {
    "op1_minhash": op1_minhash,
    "op2_embeddings": op2_embeddings,
    "op3_suffix": op3_suffix,
    "op4_pii": op4_pii,
    "op5_shards": op5_shards,
    "op6_chat": op6_chat,
    "op7_toxicity": op7_toxicity,
    "op8_urls": op8_urls,
    "op9_packing": op9_packing,
    "op10_decontamination": op10_decontamination,
    "op11_phrases": op11_phrases,
    "op12_negatives": op12_negatives,
    "op13_search": op13_search,
}
