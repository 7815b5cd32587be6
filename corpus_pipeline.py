"""The corpus pipeline: five stages from documents to packed sequences.

Each stage is a function of (spark, docs, sf_dir). All but the last return the columns of documents; each works on all
that its predecessor kept, as Parquet in the session's shared folder. What learns from the given tables (labels, benchmark)
reads them from sf_dir.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkleads.llm import decontamination, ngram_join, packing, pii, quality_model
from sparkleads.llm.common import scratch, table, text_id, written
from sparkleads.llm.queries import held_out
from sparkleads.operators.latest import top_per_key

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Score below which a document goes.
KEEP_SCORE = 0.5


def keep_good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier, trained on this stage's input and the labels, doesn't reject."""
    model = quality_model.train(docs.select("doc_id", "text"), table(spark, sf_dir, "labels"), ~held_out())
    return quality_model.scored(docs.select(*COLUMNS), model, out="_score").filter(F.col("_score") >= KEEP_SCORE).select(*COLUMNS)


def keep_one_of_each_class(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each class of near copies: the one with the least id, null ids last. Repeated rows and rows with the same id
    or none are told apart by their text, its key deciding, and then by their other columns."""
    _, texts = ngram_join.text_classes(docs)
    of_class = texts.groupBy("root").agg(F.min(F.struct(F.col("first_id").isNull().alias("n"), "first_id", "text_id")).alias("x"))
    keyed = docs.select(*COLUMNS, text_id(F.col("text")).alias("_key"))
    # A null text has the key of an empty one, which comes first.
    order = [F.asc_nulls_last("doc_id"), F.col("text").isNull(), *[F.asc_nulls_last(c) for c in ("lang", "source", "n_chars")]]
    kept = top_per_key(keyed, ["_key"], order, 1).join(of_class.select(F.col("x.text_id").alias("_key")), "_key", "left_semi")
    return kept.select(*COLUMNS)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a window that is similar to a benchmark item."""
    return decontamination.decontaminated(docs.select(*COLUMNS), table(spark, sf_dir, "benchmark")).select(*COLUMNS)


def redact_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and n_chars to match."""
    return pii.redacted(docs.select(*COLUMNS), pii.personal_spans(docs), length="n_chars").select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents in sequences of at most 1024 tokens."""
    pieces = packing.packed(docs, public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.PATTERN)
    return packing.ids_crc32(pieces).select("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")


STAGES = [
    ("quality classifier", keep_good_quality),
    ("n-gram Jaccard join", keep_one_of_each_class),
    ("benchmark decontamination", drop_benchmark_leaks),
    ("PII", redact_personal_data),
    ("packing", pack_sequences),
]

#: Trained scores and a sequential assignment: SQL can't express the stages.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage's rows are written to the shared folder and read again."""
    docs, folder = table(spark, sf_dir, "documents"), scratch(spark)
    for k, (_, stage) in enumerate(STAGES[:-1]):
        docs = written(stage(spark, docs, sf_dir), folder, f"stage-{k}")
    return STAGES[-1][1](spark, docs, sf_dir)
