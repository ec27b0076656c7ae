"""Extension: literal search over files as they arrive, with the batch operators.

The search keeps no state between rows, so a stream gives the same matches as a
batch over the same files.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quernel.operators.text import search_literal


def stream_search(spark: SparkSession, folder: str, query: str, case_sensitive: bool = False) -> DataFrame:
    """Matches in Parquet documents (doc_id, text, lang, source) that arrive in ``folder``."""
    schema = "doc_id long, text string, lang string, source string"
    docs = spark.readStream.schema(schema).parquet(folder)
    path = F.concat_ws("/", "source", "lang", F.concat(F.col("doc_id").cast("string"), F.lit(".txt")))
    return search_literal(docs.select(path.alias("path"), "text"), query, case_sensitive)
