"""The corpus pipeline: stages over `documents`, each written as Parquet and read by the next."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from pricetide.llm import decontamination, ngram_jaccard, secret_scan, sentencepiece_chunks, toxicity
from pricetide.llm.common import held_out, scratch_path, store, table, with_row_key
from pricetide.llm.queries import piece_model

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a toxicity score under 0.7; fitted on the labelled ones among them."""
    labels = table(spark, sf_dir, "labels").where(~held_out(3))
    model = toxicity.fit(docs.where(~held_out(3)), labels, corpus=docs)
    scored = toxicity.score(docs, model, result="__toxicity")
    return scored.where(F.col("__toxicity.score") < 0.7).select(*docs.columns)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the document of least id of each group of linked documents.

    Rows without an id are linked with nothing and stay. Of rows that repeat both id and text
    one stays; rows that repeat an id with different texts are documents of their own.
    """
    keyed = with_row_key(docs)
    classes = store(ngram_jaccard.jaccard_classes(keyed, doc_id="__key"))
    # The keys are stored, so that few of them go to the texts and not the texts to them.
    others = store(classes.where("component_id <> __key").select("__key").distinct())
    repeated = classes.where("__key IS NOT NULL").groupBy("__key").agg(F.count("*").alias("rows")).where("rows > 1")
    repeated = store(repeated.select("__key"))
    kept = keyed.join(others, "__key", "left_anti")
    if repeated.isEmpty():
        return kept.select(*docs.columns)
    once = kept.join(repeated, "__key", "left_anti")
    again = kept.join(repeated, "__key", "left_semi").dropDuplicates(["__key"])
    return once.select(*docs.columns).unionByName(again.select(*docs.columns))


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that the contamination rule doesn't reject."""
    marked = decontamination.mark_contamination(docs, table(spark, sf_dir, "benchmark"), result="__found")
    return marked.where(~decontamination.is_contaminated("__found")).select(*docs.columns)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their secrets replaced by a mark, and their lengths counted anew."""
    found = secret_scan.find_secrets(docs, result="__secrets")
    changed = F.size("__secrets") > 0
    text = F.when(changed, secret_scan.redact(F.col("text"), F.col("__secrets"))).otherwise(F.col("text"))
    out = found.withColumn("__text", text)
    fresh = {
        "text": F.col("__text"),
        "n_chars": F.when(changed, F.length("__text").cast("long")).otherwise(F.col("n_chars")),
    }
    return out.select(*(fresh[c].alias(c) if c in fresh else F.col(c) for c in docs.columns))


def encode_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with their SentencePiece ids, and whether decoding gave the text back.

    The new columns take the place of any that are called the same.
    """
    encoded = sentencepiece_chunks.encode_and_decode(docs, piece_model(), result="__pieces")
    fresh = {
        "ids": F.col("__pieces.ids"),
        "n_tokens": F.size("__pieces.ids").cast("long"),
        "round_trip": F.col("__pieces.decoded") == F.coalesce("text", F.lit("")),
    }
    kept = [c for c in docs.columns if c not in fresh]
    return encoded.select(*kept, *(c.alias(n) for n, c in fresh.items()))


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", drop_toxic),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", drop_contaminated),
    ("secret scans", redact_secrets),
    ("SentencePiece encoding and decoding", encode_pieces),
]

#: SQL can express neither the toxicity score nor the segmentation; tests use brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; what a stage returns is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        path = scratch_path(spark)
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
