"""Five stages from raw documents to token ids.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; the result is written as
Parquet and read again as the next stage's docs. All but the last return the columns of
documents.

Edge cases, in every stage: an empty table gives an empty result; further columns are kept
by all stages but the last, whatever their names; texts are worked on whole. Null and empty
texts have no words, so the first stage rejects them; where one reaches a later stage it
links with nothing, isn't contaminated, has no personal data and encodes to no ids. Rows
without a doc_id stay in the near-duplicate stage and are told apart by their text in
decontamination. Rows that repeat a doc_id are judged row by row by the first stage, are
one document to the second, which keeps one of them, and go together in the third."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tarnkit.llm import byte_bpe, decontaminate, near_join, pii, quality
from tarnkit.llm.common import read_table, staged


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that every quality rule keeps."""
    return quality.filter_quality(docs)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each near-duplicate component."""
    return near_join.keep_one(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark's passages."""
    return decontaminate.remove_contaminated(docs, read_table(spark, sf_dir, "benchmark"))


def pii_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with personal data replaced by its kind, and n_chars to match."""
    out = pii.redact_pii(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def token_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens and ids (unsigned 32-bit little-endian) of each document, and the digest of what they decode to."""
    import public_tokenizers

    ranks = byte_bpe.load_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
    both = byte_bpe.encode(docs, ranks, public_tokenizers.PATTERN, and_decode=True)
    return both.select("doc_id", "n_tokens", "ids", F.sha2("decoded", 256).alias("decoded_sha256"))


STAGES = [
    ("quality rules", quality_stage),
    ("near duplicates", near_duplicate_stage),
    ("decontamination", decontamination_stage),
    ("personal data", pii_stage),
    ("tokens", token_stage),
]
ORACLE_SQL = None  # trained and learned stages; tests/llm holds it against brute force


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents, each result written and read again."""
    docs = read_table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = staged(docs, f"stage-{k}")
    return docs
