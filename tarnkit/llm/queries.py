"""The registered queries of the corpus operators, and their SQL where it exists.

Each query applies its operator to the whole table named in its docstring."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tarnkit.llm.common import read_table


def op1_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in documents."""
    from tarnkit.llm.pii import find_pii

    return find_pii(read_table(spark, sf_dir, "documents"))


def op2_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark windows in documents."""
    from tarnkit.llm.decontaminate import measure_contamination

    return measure_contamination(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


def op3_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations, and one that holds the template's own marks, formatted and read back."""
    from tarnkit.llm.chat import format_digest

    marks = "\\### Assistant: </turn> ok"
    extra = spark.createDataFrame([(-7, 0, "user", marks), (-7, 1, "assistant", marks)], "conv_id long, turn long, role string, text string")
    return format_digest(read_table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(extra))


def op4_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets in documents, by the blob ledger."""
    from tarnkit.llm.secret_scan import find_secrets

    return find_secrets(read_table(spark, sf_dir, "documents"))


def secret_ledger_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over one ledger: documents, then conversations beside them, then both again
    with a newer rule; the blobs and pairs that each scanned, and the spans it found."""
    from dataclasses import replace

    from pyspark.sql import functions as F

    from tarnkit.llm.secret_scan import RULES, Ledger

    docs = read_table(spark, sf_dir, "documents").select(F.concat_ws("/", F.lit("documents"), "doc_id").alias("path"), "text")
    turns = read_table(spark, sf_dir, "conversations").select(F.concat_ws("/", F.lit("conversations"), "conv_id", "turn").alias("path"), "text")
    ledger, newer = Ledger(spark), tuple(replace(r, version=2) if r.kind == "access" else r for r in RULES)
    runs = [ledger.run(docs), ledger.run(docs.unionByName(turns)), ledger.run(docs.unionByName(turns), newer)]
    out = [r.agg(F.lit(k + 1).alias("run"), F.countDistinct("blob").alias("n_blobs"), F.count("*").alias("n_pairs"), F.coalesce(F.sum(F.size("spans")), F.lit(0)).alias("n_spans")) for k, r in enumerate(runs)]
    return out[0].unionByName(out[1]).unionByName(out[2])


def op5_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on the urls of pages."""
    from tarnkit.llm.url_filter import filter_urls

    return filter_urls(read_table(spark, sf_dir, "pages"))


def op6_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Main text of pages."""
    from tarnkit.llm.html_extract import extract_text

    return extract_text(read_table(spark, sf_dir, "pages")).select("page_id", "url", "text", "n_chars")


def op7_byte_bpe(spark: SparkSession, sf_dir: str, ranks_path: str | None = None) -> DataFrame:
    """Byte-level BPE of documents, there and back."""
    import public_tokenizers

    from tarnkit.llm.byte_bpe import encode_digest, load_ranks

    ranks = load_ranks(ranks_path or public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    return encode_digest(read_table(spark, sf_dir, "documents"), ranks, public_tokenizers.PATTERN)


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated 200-byte strings cut out of documents."""
    from tarnkit.llm.suffix_dedup import removal_digest

    return removal_digest(read_table(spark, sf_dir, "documents"))


def op9_near_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near-duplicate components of documents."""
    from tarnkit.llm.near_join import near_components

    return near_components(read_table(spark, sf_dir, "documents"))


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality features and verdicts of documents."""
    from tarnkit.llm.quality import judge_quality

    return judge_quality(read_table(spark, sf_dir, "documents")).drop("rejected_by")


def op11_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How far the sources of each language differ, in documents."""
    from tarnkit.llm.source_audit import audit_sources

    return audit_sources(read_table(spark, sf_dir, "documents"))


def op12_token_counts(spark: SparkSession, sf_dir: str, tokenizer_path: str | None = None) -> DataFrame:
    """Token counts of documents, through a cache of their own."""
    import public_tokenizers

    from tarnkit.llm.token_counts import judge_length, load_tokenizer

    return judge_length(read_table(spark, sf_dir, "documents"), load_tokenizer(tokenizer_path or public_tokenizers.path("byte_bpe_50k.json")))


def token_cache_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three runs over one cache: documents, then conversations beside them, then both with
    another tokenizer; the texts of each, the distinct ones, and those found in the cache."""
    import public_tokenizers
    from pyspark.sql import functions as F

    from tarnkit.llm.token_counts import CountCache, counted, load_tokenizer

    docs = read_table(spark, sf_dir, "documents").select("doc_id", "text")
    both = docs.unionByName(read_table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("doc_id"), "text"))
    first, other = (load_tokenizer(public_tokenizers.path(name)) for name in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
    cache, out = CountCache(spark), []
    for k, (rows, tokenizer) in enumerate(((docs, first), (both, first), (both, other))):
        counts, n_texts, n_stored = counted(rows, tokenizer, cache)
        out.append(counts.agg(F.lit(k + 1).alias("run"), F.count("n_tokens").alias("n_rows"), F.coalesce(F.sum("n_bytes"), F.lit(0)).alias("n_bytes")).withColumns({"n_texts": F.lit(n_texts).cast("long"), "n_stored": F.lit(n_stored).cast("long")}))
    return out[0].unionByName(out[1]).unionByName(out[2])


def op13_period_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Periodic runs of words in documents, with repeats planted in a tenth of them."""
    from tarnkit.llm.period_runs import plant_repeats, run_report

    return run_report(plant_repeats(read_table(spark, sf_dir, "documents")))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_pii": op1_pii,
    "op2_decontaminate": op2_decontaminate,
    "op3_chat": op3_chat,
    "op4_secrets": op4_secrets,
    "secret_ledger_runs": secret_ledger_runs,
    "op5_urls": op5_urls,
    "op6_html": op6_html,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_suffix_dedup": op8_suffix_dedup,
    "op9_near_join": op9_near_join,
    "op10_quality": op10_quality,
    "op11_source_audit": op11_source_audit,
    "op12_token_counts": op12_token_counts,
    "token_cache_runs": token_cache_runs,
    "op13_period_runs": op13_period_runs,
}
