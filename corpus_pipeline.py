"""A pipeline over documents: toxicity, line dedup, SimHash near-dedup, benchmark decontamination, SentencePiece.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the columns of docs. run() writes
each stage's result to the session's shared folder and reads it again as the next one's input.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm import decontaminate, line_dedup, near_dedup_stage, sentencepiece_codec, toxicity
from loomgraph.llm.common import ensure_checkpoint_dir, table


def _with_text(docs: DataFrame, columns: list[str]) -> DataFrame:
    """docs with the given columns; n_chars, where it is one of them, is that of the text as it is now."""
    if "n_chars" in columns:
        docs = docs.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType))
    return docs.select(*columns)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier scores at its threshold or above go. It learns from the labels of these documents."""
    model = toxicity.fit(docs.select("doc_id", "text"), table(spark, sf_dir, "labels").select("doc_id", "toxic"))
    return toxicity.score_toxicity(docs, model).where(F.col("toxicity") < toxicity.THRESHOLD).select(*docs.columns)


def dedup_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go from all documents but one. All documents stay, those of which nothing is left as empty texts."""
    return _with_text(line_dedup.dedup_lines(docs), docs.columns)


def dedup_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id stays."""
    return near_dedup_stage.keep_one_of_each(docs).select(*docs.columns)


def decontaminate_texts(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Spans of benchmark windows are cut from the texts; documents without a word left go, if they had such spans."""
    found = decontaminate.find_contamination(docs, table(spark, sf_dir, "benchmark"))
    left = F.size("__hits") == 0
    words = F.aggregate("__hits", F.lit(0).cast("bigint"), lambda n, s: n + s["end"] - s["start"])
    kept = found.where(left | (words < F.col("__words"))).withColumn("text", F.when(left, F.col("text")).otherwise(F.col("__clean")))
    return _with_text(kept, docs.columns)


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document's pieces, and whether they decode to its text."""
    plain = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    both = sentencepiece_codec.decode(sentencepiece_codec.encode(plain))
    return both.select("doc_id", F.size("ids").cast("bigint").alias("n_tokens"), "ids", (F.col("decoded") == F.col("text")).alias("exact"))


STAGES = [
    ("toxicity", drop_toxic),
    ("line dedup", dedup_lines),
    ("SimHash near-dedup", dedup_near_copies),
    ("benchmark decontamination", decontaminate_texts),
    ("SentencePiece encoding and decoding", encode),
]

#: The first stage is a trained classifier, which SQL can not express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    ensure_checkpoint_dir(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        path = f"{folder}/{k}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
