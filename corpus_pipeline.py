"""Documents to packed training sequences, in five stages.

Every stage works on all that its predecessor kept.  ORACLE_SQL is None: SQL can express
neither the trained classifier nor the signatures, fingerprint links and packing; tests hold
the stages against brute-force versions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from verisift.llm import decontaminate, lines, packing, simhash, toxicity
from verisift.llm.common import importable
from verisift.session import settle

Stage = Callable[[SparkSession, DataFrame, str], DataFrame]

ORACLE_SQL = None

OWN = ("doc_id", "text")  # columns that operators read and give back as they are


def _carried(docs: DataFrame) -> DataFrame:
    """doc_id and text, with the other columns in a struct beside them, so that what an operator adds
    can't take the place of a column of the documents."""
    others = [F.col(f"`{c}`") for c in docs.columns if c not in OWN]
    return docs.select(*OWN, F.struct(*others or [F.lit(None).cast("boolean").alias("none")]).alias("carried_row"))


def _unpacked(rows: DataFrame, columns: list[str], **changed: Column) -> DataFrame:
    """The documents' columns again, in their order; some with a new value."""
    def kept(c: str) -> Column:
        return changed[c] if c in changed else F.col(c if c in OWN else f"carried_row.`{c}`")

    return rows.select(*[kept(c).alias(c) for c in columns])


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier doesn't call toxic.

    Null and empty texts are scored like any other; repeated rows stay or go together; all columns
    come through as they are; no documents give none."""
    judged = toxicity.classify(_carried(docs), spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return _unpacked(judged.where("predicted = 0"), docs.columns)


def drop_repeated_lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts without lines that repeat another; documents with nothing else go.

    Null and empty texts stay; rows that repeat doc_id and text keep the same lines; n_chars is
    counted anew (null text: null), all other columns come through as they are."""
    done = lines.dedup_lines(_carried(docs))
    left = done.where((F.col("n_lines") == 0) | (F.col("n_removed") < F.col("n_lines")))
    return _unpacked(left, docs.columns, text=F.col("text"), n_chars=F.char_length("text").cast("long"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity 0.8).

    The one with the smallest doc_id stays, a null one loses; texts without words are copies of
    one another; all columns come through as they are."""
    return simhash.keep_one(docs)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without passages of the benchmark, re-parameterised ones included.

    Null and empty texts stay; an empty benchmark keeps all; all columns come through as they are."""
    judged = decontaminate.decontaminate(_carried(docs), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return _unpacked(judged.where(~F.col("contaminated")), docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of the packed sequences; null text is empty, repeated rows are packed each."""
    return packing.pack(docs)


def _stage(run: Stage) -> Stage:
    def stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        importable(spark)
        return run(spark, docs, sf_dir)

    return stage


STAGES: list[tuple[str, Stage]] = [
    ("toxicity", _stage(drop_toxic)),
    ("line_dedup", _stage(drop_repeated_lines)),
    ("simhash_near_dedup", _stage(drop_near_duplicates)),
    ("decontamination", _stage(drop_contaminated)),
    ("packing", _stage(pack)),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents; each result is stored before the next stage reads it."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = settle(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
