"""Named queries of the text operators, with production parameters over whole tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import chat, decontam, fill_middle, hosts, html_text, importance, licenses, line_dedup, mixing, near_dup, quality, repeats, tokens
from tidemark.llm.common import shared_table, table

END_ID = 2
URL_RULES = [("block", "net/"), ("allow", "example.net/en/"), ("block", "example.com/de/"), ("allow", "org/fr/")]


def tokenizer_path(name: str = "word_bpe_49k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op1_license_sentences(spark: SparkSession, sf: str) -> DataFrame:
    return licenses.scan(table(spark, sf, "documents"))


def op2_token_records(spark: SparkSession, sf: str) -> DataFrame:
    return tokens.encoded(table(spark, sf, "documents"), tokenizer_path(), END_ID)


def op3_page_text(spark: SparkSession, sf: str) -> DataFrame:
    return html_text.extract(table(spark, sf, "pages"))


def op4_chat_format(spark: SparkSession, sf: str) -> DataFrame:
    """All conversations and conversation -1, whose texts look like control strings, rendered and read back."""
    rows = table(spark, sf, "conversations").select("conv_id", "turn", "role", "text")
    trap = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                 F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = chat.canonical(chat.records_of_rows(rows.unionByName(trap)))
    back = chat.parsed(shared_table(chat.formatted(turns, "conv_id"), "chat"))
    lines = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(lines, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def op5_fuzzy_lines(spark: SparkSession, sf: str) -> DataFrame:
    return line_dedup.dedup_lines(table(spark, sf, "documents"), with_text=False)


def op6_repeated_bytes(spark: SparkSession, sf: str) -> DataFrame:
    return repeats.repeats(table(spark, sf, "documents")).select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256")


def op7_quality_rules(spark: SparkSession, sf: str) -> DataFrame:
    return quality.measure(table(spark, sf, "documents")).select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "n_lines", "n_short_lines", "n_stop_words")


def op8_setsketch_near_dup(spark: SparkSession, sf: str) -> DataFrame:
    return near_dup.near_duplicates(table(spark, sf, "documents"), k=4, percent=80)


def op9_benchmark_containment(spark: SparkSession, sf: str) -> DataFrame:
    return decontam.contained(table(spark, sf, "documents"), table(spark, sf, "benchmark"))


def op10_source_mix(spark: SparkSession, sf: str) -> DataFrame:
    return mixing.mixed(table(spark, sf, "documents")).select(
        "doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "source", "copies")


def op11_host_trust(spark: SparkSession, sf: str) -> DataFrame:
    return hosts.judged(table(spark, sf, "pages"), URL_RULES)


def op12_importance_draw(spark: SparkSession, sf: str) -> DataFrame:
    return importance.resampled(table(spark, sf, "documents"), table(spark, sf, "benchmark"), percent=10, least_words=20, seed=2024, runs=1, buckets=10_000)


def op13_fill_middle(spark: SparkSession, sf: str) -> DataFrame:
    made = fill_middle.transformed(table(spark, sf, "documents"), unit="line", seed=7, percent=100, spm_percent=50)
    return made.select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"),
                       F.sha2(fill_middle.restored(F.col("output"), F.col("form")), 256).alias("restored_sha256"))


QUERIES = {f.__name__: f for f in (
    op1_license_sentences, op2_token_records, op3_page_text, op4_chat_format, op5_fuzzy_lines, op6_repeated_bytes, op7_quality_rules, op8_setsketch_near_dup, op9_benchmark_containment, op10_source_mix,
    op11_host_trust, op12_importance_draw, op13_fill_middle)}
