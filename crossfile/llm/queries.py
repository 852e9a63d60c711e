"""The registered queries of this subpackage, and (``ORACLES``) DuckDB SQL for those that SQL can express."""

from __future__ import annotations

import os
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from crossfile.llm import boosted, brown, hnsw, lexical, mixing, ngram_join, pii, quality, sentencepiece_stream, sharding, spelling, substring, toxicity
from crossfile.llm.frames import ship, table
from crossfile.llm.oracles import ORACLES as ORACLES

Query = Callable[[SparkSession, str], DataFrame]


def op1_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components of documents whose sets of three-word shingles are similar to 0.9."""
    return ngram_join.join(table(spark, sf_dir, "documents"), n=3, percent=90)


def op2_mix_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every copy that a budget of one corpus deals at an evenness of 0.95 and at most four repetitions."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "source", "text")
    out = mixing.mix(docs, evenness=0.95, repetition=4.0, budget=1.0)
    return out.select("doc_id", F.coalesce("source", F.lit("")).alias("source"), F.col("_n_tokens").alias("n_tokens"), F.round("_exponent", 6).alias("exponent"), F.round("_weight", 6).alias("weight"), F.col("_epoch").alias("epoch"), F.col("_order").alias("order_key"))


def op3_repetition(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repetition coverage and verdict of every document."""
    return quality.measure(table(spark, sf_dir, "documents"))


def op9_brown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Class bigram scores of every document."""
    return brown.score(table(spark, sf_dir, "documents"))


def op10_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids under the 32,000-piece vocabulary."""
    return sentencepiece_stream.encode(table(spark, sf_dir, "documents"), sentencepiece_stream.read_pieces(VOCABULARY))


def op4_hnsw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors of one label with a cosine of 0.93 or more."""
    return hnsw.near_duplicates(table(spark, sf_dir, "embeddings"), least=0.93)


def op5_recompression(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document without the windows that start in a smaller one."""
    return substring.deduplicate(table(spark, sf_dir, "documents"))


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxicity of every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return toxicity.classify(docs, toxicity.fit(docs, table(spark, sf_dir, "labels")))


def op7_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Personal data in every document; the classifier learns from the candidates of all of them."""
    docs = table(spark, sf_dir, "documents")
    return pii.find(docs, pii.fit(docs))


def op8_hash_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All documents in 16 shards: four regions of two racks of two shards."""
    return sharding.assign(table(spark, sf_dir, "documents"), sharding.tree(16))


def op11_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quality of every document, learnt from the labels outside the held-out fold."""
    docs = table(spark, sf_dir, "documents")
    return boosted.classify(docs, boosted.fit(docs, table(spark, sf_dir, "labels")))


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every word of seven letters or more, with its common form."""
    return spelling.variants(table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The ten best documents of every benchmark item."""
    return lexical.search(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), k=10)


#: The vocabulary file; the driver reads it and sends its pieces on.
VOCABULARY = os.environ.get("CROSSFILE_PIECES", "/opt/tokenizers/piece_bpe_32k.model")

QUERIES: dict[str, Query] = {
    "op1_ngram_join": op1_ngram_join,
    "op2_mix_sources": op2_mix_sources,
    "op3_repetition": op3_repetition,
    "op4_hnsw": op4_hnsw,
    "op5_recompression": op5_recompression,
    "op6_toxicity": op6_toxicity,
    "op7_personal_data": op7_personal_data,
    "op8_hash_tree": op8_hash_tree,
    "op9_brown": op9_brown,
    "op10_sentencepiece": op10_sentencepiece,
    "op11_boosted_quality": op11_boosted_quality,
    "op12_spelling_variants": op12_spelling_variants,
    "op13_ranked_search": op13_ranked_search,
}

def queries() -> dict[str, Query]:
    def ready(f: Query) -> Query:
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            ship(spark)
            return f(spark, sf_dir)

        return run

    return {name: ready(f) for name, f in QUERIES.items()}
