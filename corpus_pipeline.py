"""Cleaning, mixing and encoding a corpus: five stages over whole ``documents``.

Each stage is a function of (spark, docs, sf_dir); its result is written as
Parquet and read again as the next stage's documents. All but the last return the
columns of ``documents``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from signalframe.llm.common import keep
from signalframe.llm.line_dedup import dedup_lines
from signalframe.llm.mixing import mix, repeat
from signalframe.llm.pieces import segmentations
from signalframe.llm.quality import cascade
from signalframe.llm.simhash import keep_one

#: The tokenizer's file; the same path on every worker.
PIECES = "/opt/tokenizers/piece_bpe_32k.model"

_EMPTY = r"^[\x20\x09-\x0D]*$"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that no rule rejects.

    A null or empty text has too few words and goes; rows that repeat share one
    verdict; an empty table stays empty.
    """
    return cascade(docs).filter("kept").select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without the chunks that an earlier document has.

    ``n_chars`` follows the text. A document of which no word is left goes; one
    that had none before stays as it is.
    """
    out = dedup_lines(docs)
    out = out.filter((F.col("n_removed") == 0) | ~F.col("text").rlike(_EMPTY))
    length = F.when(F.col("n_removed") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.withColumn("n_chars", length).select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group whose five-word shingles are at least 0.8 alike.

    The least ``doc_id`` stays (null last), then the least row hash; rows that repeat
    are one document; an empty table stays empty. Further cases: ``simhash.keep_one``.
    """
    return keep_one(docs)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it, none, once or twice.

    A null source is a source of its own, a null text has size 0; rows that repeat
    are drawn one by one; an empty table stays empty.
    """
    return repeat(docs, mix(docs))


def sampled_pieces(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Two different segmentations of every text, as ids.

    A null or empty text has one empty segmentation; a character outside the
    vocabulary becomes its bytes; an empty table gives an empty one.
    """
    return segmentations(docs, PIECES).drop("decoded")


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup),
    ("SimHash near-dedup", near_dedup),
    ("source mix", source_mix),
    ("SentencePiece encoding", sampled_pieces),
]

#: Hashes, drawn samples and segmentations have no SQL form; the tests compare each stage with a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each one's result written to the shared folder."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = keep(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
