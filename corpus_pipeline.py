"""The corpus pipeline: quality classifier, line dedup, near-dedup, mixing, packing.

Each stage takes documents and returns documents; the last returns pieces of
packed sequences. ``ORACLE_SQL`` is None: a trained classifier and a tokenizer are
beyond SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from lodestrata.llm.columns import as_row, unfolded
from lodestrata.llm.line_dedup import drop_common_lines
from lodestrata.llm.mixing import mix
from lodestrata.llm.near_dedup import near_duplicates, text_hash
from lodestrata.llm.packing import pack
from lodestrata.llm.quality import score_quality, train_quality
from lodestrata.scratch import shared_path

REJECT_BELOW = 0.3


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose quality score is at least REJECT_BELOW; trained on all labels of the folder."""
    model = train_quality(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"), skip_fold=None)
    scored = score_quality(docs.select("text", as_row(docs).alias("row")), model)
    return scored.where(F.col("score") >= REJECT_BELOW).select(*unfolded(F.col("row"), docs.columns))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without common lines; n_chars is counted anew. A document that loses every line stays, empty."""
    kept = drop_common_lines(docs.select("doc_id", "text", as_row(docs, [c for c in docs.columns if c != "text"]).alias("row")))
    text = F.when(F.col("text").isNotNull(), F.col("_kept"))
    new = {"text": text, "n_chars": F.char_length(text).cast("long")}
    return kept.select(*(new[c].alias(c) if c in new else F.col("row").getField(c).alias(c) for c in docs.columns))


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates: that of the smallest doc_id, then of the least text hash.

    Rows of one doc_id with texts that are not near-duplicates all stay, as do rows
    without words. Of rows equal in doc_id and text one stays, by a hash of all columns.
    """
    key, name = ["name", "h1", "h2"], F.coalesce(F.col("doc_id").cast("string"), F.lit("null")).alias("name")
    stays = near_duplicates(docs).where("stays").select(name, "h1", "h2").groupBy(*key).agg(F.count("*").alias("many"))
    rows = docs.select(name, *text_hash(F.col("text")), as_row(docs).alias("row"))
    nth = F.row_number().over(W.partitionBy(*key).orderBy(F.xxhash64("row")))
    left = rows.join(stays, key).withColumn("nth", nth).where("nth <= many")
    return left.select(*unfolded(F.col("row"), docs.columns))


def source_mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its source's rate says."""
    return mix(docs)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of at most 2048 ids. Copies of a document are packed as documents of their own."""
    import public_tokenizers

    return pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("minhash near-dedup", near_dedup),
    ("mixing sources to target weights", source_mixing),
    ("packing", packing),
]
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of a folder; each stage but the last is written and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for n, (_, stage) in enumerate(STAGES, 1):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES):
            docs.write.parquet(path := shared_path(spark, f"stage-{n}"))
            docs = spark.read.parquet(path)
    return docs
