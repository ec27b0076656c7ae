"""A training-data pipeline over ``documents``: toxic documents go, repeated lines go, one of each
group of near duplicates stays, and what is left is packed into sequences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.llm import jaccard, line_dedup, packing, toxicity
from quernel.llm.common import aside, discard, forget, stored
from quernel.llm.words import quoted


def toxicity_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that a model fitted on this stage's input and ``labels`` predicts to be toxic go."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    slim, names = aside(docs, ["doc_id", "text"])
    scored = toxicity.with_scores(slim, toxicity.fit(slim, labels))
    return scored.where("predicted = 0").select(*slim.columns).toDF(*names)


def line_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated and nearly repeated lines go; a document stays, also without lines. ``n_chars`` follows the text."""
    forget(spark)  # the scores of the stage before
    out = line_dedup.dedup_lines(docs)
    if "n_chars" in docs.columns:
        changed = F.when(F.col("lines_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
        out = out.withColumn("n_chars", changed.cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(quoted(c)) for c in docs.columns])


def near_duplicate_filter(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by n-gram Jaccard similarity the one of least doc_id stays."""
    return jaccard.one_of_each(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    import public_tokenizers

    return packing.pack_documents(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("toxicity", toxicity_filter),
    ("line_dedup", line_filter),
    ("ngram_jaccard", near_duplicate_filter),
    ("packing", pack),
]

#: The model, the joins over candidate sets and the tokenizer have no SQL form; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    written = None
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = stored(docs)
            if written is not None:
                discard(written)  # only the next stage reads a stage's table
            written = docs
    return docs
