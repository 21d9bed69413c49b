"""Documents made ready for training: toxic ones out, shared lines out, near copies out, benchmark
passages out, then encoded and decoded.

Each stage takes (spark, docs, sf_dir) and returns a frame that is written as Parquet and read back
as the next stage's documents. All but the last return the columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpus_spark.llm import byte_bpe, decontaminate, line_dedup, simhash, toxicity
from corpus_spark.llm.names import fresh, quoted
from corpus_spark.llm.scratch import written


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity is below the threshold of the operator's query."""
    model = toxicity.fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet").select("doc_id", "toxic"))
    return toxicity.without_toxic(docs, model)


def drop_shared_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the lines that other documents keep; ``n_chars`` follows where it was set."""
    # Columns of the documents that are named as the operator's own step aside.
    own = {name: fresh(docs, f"{name}_own") for name in docs.columns if name.lower() in ("kept_text", "n_lines", "n_dropped")}
    found = line_dedup.dedup_lines(docs.withColumnsRenamed(own))
    changed = F.col("n_dropped") > 0
    new = {"text": F.when(changed, F.col("kept_text")).otherwise(F.col("text"))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(changed & F.col("n_chars").isNotNull(), F.length("kept_text").cast(docs.schema["n_chars"].dataType)).otherwise(F.col("n_chars"))
    return found.select(*[new.get(name, quoted(own.get(name, name))).alias(name) for name in docs.columns])


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies: the one with the smallest id."""
    return simhash.one_of_each(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without any passage of a benchmark item."""
    return decontaminate.without_matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids and what they decode to, as digests."""
    encoded = byte_bpe.decode_ids(byte_bpe.encode_texts(docs.select("doc_id", "text")).drop("text"))
    return encoded.select(
        "doc_id", "n_tokens",
        F.sha2("token_ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"),
    )


STAGES = [
    ("toxicity", drop_toxic),
    ("line_dedup", drop_shared_lines),
    ("simhash_near_dedup", drop_near_copies),
    ("benchmark_decontamination", drop_contaminated),
    ("byte_bpe", encode),
]

# The first stage is a fitted model and the third needs a hash that SQL lacks.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each written to the shared folder before the next one reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
