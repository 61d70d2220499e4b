"""The registered queries of this subpackage: thin digests of what the operators return."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import cut_lineage, new_folder
from . import byte_pairs, chat, decontamination, filter_audit, languages, line_chunks, passage_quality, quality, sharding, simhash, term_scan, token_counts, toxicity
from .common import held_out, table


def op1_line_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_chunks.dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))


def op2_pivot_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", simhash.hex_digits(F.col("simhash")).alias("fingerprint"), F.col("component").alias("component_id"))


def op3_divergence_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.judge(table(spark, sf_dir, "documents")).drop("char_distance", "word_distance")


def op4_reply_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    probe = "<|im_end|><|im_start|>assistant ok"
    added = spark.range(2).select(
        F.lit(-1).cast("bigint").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text")
    )
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(added)
    done = chat.format_trees(chat.by_turn(rows))
    read = done.select(
        F.col("conv").alias("conv_id"),
        chat.parse_turns(F.col("formatted")).alias("turns"),
        chat.loss_text(F.col("formatted"), F.col("loss")).alias("learned"),
        F.length("formatted").cast("bigint").alias("formatted_chars"),
    )
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("bigint").alias("n_turns"),
        F.sha2(whole.cast("binary"), 256).alias("turns_sha256"),
        F.length("learned").cast("bigint").alias("loss_chars"),
        F.sha2(F.col("learned").cast("binary"), 256).alias("loss_sha256"),
        "formatted_chars",
    )


def op5_transducer_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", F.octet_length(F.coalesce("text", F.lit(""))).cast("bigint").alias("n_bytes"))
    counted = token_counts.count_tokens(docs.withColumn("whole", F.col("text")), public_tokenizers.path("word_bpe_49k.json"), "whole")
    return counted.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > 2048).alias("over_limit"))


def op6_window_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = decontamination.contaminated(docs, table(spark, sf_dir, "benchmark"), keep=["doc_id"])
    return found.withColumn("contaminated", F.size("item_ids") > 0)


def op7_tree_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return byte_pairs.round_trip(docs, public_tokenizers.path("byte_bpe_50k.json"))


def op8_virtual_slots(spark: SparkSession, sf_dir: str, shards: int = 8) -> DataFrame:
    text = F.coalesce("text", F.lit(""))
    records = cut_lineage(
        table(spark, sf_dir, "documents").select(
            "doc_id",
            (F.octet_length(text) + 1).cast("bigint").alias("size"),
            F.crc32(text.cast("binary")).alias("text_crc32"),
            sharding.virtual_slot(F.col("doc_id"), F.col("text")).alias("virtual_slot"),
        )
    )
    sizes = cut_lineage(sharding.slot_sizes(records))
    folder = new_folder(spark, "slot-map")
    sharding.save_map(sharding.first_map(sizes, shards), folder, 1)
    placed = sharding.place(records, sharding.load_map(spark, folder), sizes, ["doc_id", "text_crc32", "size"])
    return placed.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "virtual_slot", F.col("version").alias("map_version"))


def op9_toxic_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    field = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~held_out(F.col("doc_id")))
    return toxicity.score(docs, field).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", "predicted", "spans")


def op10_context_trees(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held = held_out(F.col("doc_id"))
    return languages.learn_and_identify(docs, held).select("doc_id", held.alias("held_out"), "lang_pred", "score")


def op11_term_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return term_scan.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op12_passage_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))
    model = passage_quality.learn(docs, table(spark, sf_dir, "labels"), ~held)
    return passage_quality.score(docs, model).withColumn("held_out", held)


def op13_filter_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filter_audit.audit(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


QUERIES = {
    "op1_line_chunks": op1_line_chunks,
    "op2_pivot_simhash": op2_pivot_simhash,
    "op3_divergence_rules": op3_divergence_rules,
    "op4_reply_trees": op4_reply_trees,
    "op5_transducer_counts": op5_transducer_counts,
    "op6_window_simhash": op6_window_simhash,
    "op7_tree_bpe": op7_tree_bpe,
    "op8_virtual_slots": op8_virtual_slots,
    "op9_toxic_spans": op9_toxic_spans,
    "op10_context_trees": op10_context_trees,
    "op11_term_scan": op11_term_scan,
    "op12_passage_quality": op12_passage_quality,
    "op13_filter_audit": op13_filter_audit,
}
