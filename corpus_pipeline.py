"""Quality rules, near-duplicate removal, masking, mixing and encoding of a corpus, stage by stage."""

from __future__ import annotations

from collections.abc import Callable

from crossfile.llm import mixing, ngram_join, pii, quality, sentencepiece_stream
from crossfile.llm.frames import cut, ship
from crossfile.llm.queries import VOCABULARY
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the repetition rules reject go: among them null and empty texts. Each row is judged by its own whole text, so
    repeated rows share a fate, and a share equal to its limit passes; an empty table gives no rows; other columns are kept as they are."""
    ship(spark)
    return quality.keep(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents similar to 0.8 in shingles of five words, directly or through others, the one with the least id stays.

    Null ids come last. Rows are decided one by one, also where they share an id; of rows equal in all columns one stays. Null and
    empty texts are linked with nothing and stay. Texts of any length are read whole. An empty table gives no rows; other columns
    are kept as they are.
    """
    ship(spark)
    return ngram_join.keep_one(docs, n=5, percent=80)


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Personal data is masked in whole texts of any length; the lengths follow. Of spans of one start the first kind counts. Null texts stay null, empty ones empty; of overlapping spans the union is masked.
    Every row is masked by its own whole text; an empty table gives no rows; other columns are kept as they are."""
    ship(spark)
    out = pii.mask(docs, pii.fit(docs))
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)).select(docs.columns) if "n_chars" in docs.columns else out


def source_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sources are repeated up to four times towards even shares; every document is dealt at least once. A null source is one of its
    own; documents without tokens are dealt once, sources of equal shares alike; a source of one long document is repeated like any other. An empty table gives no
    rows; other columns are kept as they are."""
    return mixing.mix(docs, evenness=0.97, repetition=4.0, budget=None).select(docs.columns)


def encoding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The ids of every document dealt, repeated ones alike; of equal scores the codec takes the same pieces everywhere. Null and empty texts have no ids; long ones are encoded in a window. An
    empty table gives no rows; other columns go."""
    ship(spark)
    return sentencepiece_stream.encode(docs, sentencepiece_stream.read_pieces(VOCABULARY))


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality_rules", quality_rules),
    ("near_duplicates", near_duplicates),
    ("personal_data", personal_data),
    ("source_weights", source_weights),
    ("encoding", encoding),
]

#: The last stage's ids come from a vocabulary file and the third's spans from a trained model: SQL can't express them.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages one after another, each written to the shared folder and read again."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if i < len(STAGES) - 1:
            docs = cut(docs)
    return docs
