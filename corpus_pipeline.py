"""A corpus cleaning pipeline over ``documents``: language ID, near-dedup, substring dedup, personal data, packing.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame that is written and reread as the next one's docs. All but
the last return the columns of documents. Rows that share a doc_id are one document and stay or go together.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vesselspark.llm import langid, packing, pii, simhash, substrings
from vesselspark.llm.common import load, unused
from vesselspark.tables import scratch, write_table

#: A document whose likeliest language has less than this share of the probability has none.
LEAST_SURE = 0.5
#: Workers live through all stages, so stages remember fewer words here than alone.
LANGUAGE_WORDS, PACKING_WORDS = 100_000, 200_000
#: Texts go to workers in batches of at most so many rows, as they may be long.
BATCH_ROWS = 2000
BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def bound_batches(spark: SparkSession) -> None:
    if not 0 < int(spark.conf.get(BATCH_CONF)) <= BATCH_ROWS:
        spark.conf.set(BATCH_CONF, str(BATCH_ROWS))


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known: those without a letter, and those without a clear language, go."""
    bound_batches(spark)
    model = langid.train(docs, public_tokenizers.path("piece_bpe_32k.model"))
    lang, sure = unused(docs.columns, "found_lang", "found_sure")
    found = langid.annotate(docs, model, names=(lang, sure), cached_words=LANGUAGE_WORDS)
    return found.where((F.col(lang) != "und") & (F.col(sure) >= LEAST_SURE)).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    bound_batches(spark)
    found = simhash.simhash_components(docs)
    (own,) = unused(docs.columns, "kept_id")
    kept = found.where(F.col("id").eqNullSafe(F.col("component_id"))).select(F.col("id").alias(own)).distinct()
    return docs.join(kept, F.col("doc_id").eqNullSafe(F.col(own)), "left_semi")


def drop_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words of passages that occur more than once go; a document without such a passage keeps its text as it is."""
    bound_batches(spark)
    names = unused(docs.columns, "n_words", "n_removed", "kept")
    found = substrings.remove_repeats(docs, names=names)
    text = F.when(F.col(names[1]) > 0, F.col(names[2])).otherwise(F.col("text"))
    return _as_documents(docs, found.withColumn("text", text))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data are replaced by their kind in brackets."""
    bound_batches(spark)
    names = unused(docs.columns, *pii.NAMES)
    found = pii.annotate(docs, pii.train(docs), names=names)
    return _as_documents(docs, found.withColumn("text", F.coalesce(names[pii.NAMES.index("redacted")], "text")))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    bound_batches(spark)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
    return packing.pack(docs, *paths, cached_words=PACKING_WORDS)


def _as_documents(docs: DataFrame, changed: DataFrame) -> DataFrame:
    """The columns of ``docs``, with n_chars, if there is one, of the new text."""
    if "n_chars" in docs.columns:
        changed = changed.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return changed.select(*docs.columns)


STAGES = [
    ("language_id", keep_known_language),
    ("near_dedup", drop_near_copies),
    ("substring_dedup", drop_repeated_passages),
    ("personal_data", redact),
    ("packing", pack),
]
#: SQL expresses none of the stages but the second; each is tested against a plain version instead.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages; a stage's tables go when the next one's result is written, but those the last result is read from."""
    docs, before = load(spark, sf_dir, "documents"), None
    for _, stage in STAGES[:-1]:
        with scratch() as tables:
            docs = write_table(stage(spark, docs, sf_dir))
            tables.remove(docs)
            if before is not None:
                tables.append(before)
            before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
