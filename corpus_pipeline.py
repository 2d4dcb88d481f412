"""A corpus pipeline: language ID, toxicity, near-duplicates, repeated passages, packing.

Each stage takes (spark, docs, sf_dir) and works on all rows that its predecessor kept. All but the last return the
columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gantrel.llm import langid, packing, passages, simhash, toxicity
from gantrel.llm.common import bound_memory, broadcast_if_small, discard, materialize, table


def language_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents whose language is known: drop texts without a letter, null and empty ones among them, and those no
    language fits. A text is judged as a whole however long, and equal texts alike. An empty table, or one without
    labelled rows, keeps nothing. Columns of any name pass through."""
    bound_memory(spark)
    model = langid.train(docs)
    fits = langid.identify(model, F.col("text")).getField("fits")
    return docs.filter(fits).select(*[F.col(f"`{c}`") for c in docs.columns])


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents that are less likely toxic than not; rows of null id, text or label teach nothing. Null and empty
    texts get the classifier's bias, equal texts equal scores, at a score of 0.5 a text goes. An empty table stays empty.
    Columns of any name pass through."""
    bound_memory(spark)
    model = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return docs.filter(toxicity.score(model, F.col("text")) < 0.5)


def near_duplicate_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep one document, the first text of the smallest id, of each class of near copies (5-word shingles, similarity
    0.8), searched by SimHash in BK-trees and by bands of min-hashes and measured on the whole sets. Different texts of one
    id are judged each for itself; of rows that repeat id and text, one stays. Rows without an id cannot be told apart and
    stay. Null and empty texts are copies of each other. An empty table stays empty. Columns of any name but ``__same``
    pass through."""
    bound_memory(spark)
    classes = materialize(simhash.similar_documents(docs, words=5, least=0.8), "classes")
    copies = materialize(classes.filter("kept = false").select("doc_id", F.col("same").alias("__same")).distinct(), "copies")
    repeated = materialize(classes.filter("kept").groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id"), "repeated")
    marked = docs.withColumn("__same", F.md5(F.coalesce("text", F.lit("")).cast("binary")))
    kept = marked.join(broadcast_if_small(copies), ["doc_id", "__same"], "left_anti")
    some = broadcast_if_small(repeated)
    once = kept.join(some, "doc_id", "left_semi").dropDuplicates(["doc_id", "__same"])
    discard(classes)
    return kept.join(some, "doc_id", "left_anti").unionByName(once).select(*[F.col(f"`{c}`") for c in docs.columns])


def passage_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cut passages of 50 words or more that repeat an earlier one; ``n_chars`` follows the text. Null, empty and short
    texts stay as they are; a text that is left without a word goes. Equal rows are cut alike, different texts of one id
    each for itself. An empty table stays empty. Columns of any name pass through."""
    bound_memory(spark)
    left = passages.remove_repeats(docs, min_words=50, similarity=0.8)
    return left.withColumn("n_chars", F.length("text").cast("long")).select(*[F.col(f"`{c}`") for c in docs.columns])


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pack what is left into sequences of 2,048 tokens. Null and empty texts are one end id, long ones are cut, equal rows
    are packed as often as they occur. An empty table gives an empty plan. Other columns are not read."""
    bound_memory(spark)
    return packing.pack_documents(docs, public_tokenizers.path("byte_bpe_50k.json")).plan


STAGES = [
    ("language_id", language_stage),
    ("toxicity", toxicity_stage),
    ("near_duplicates", near_duplicate_stage),
    ("substring_dedup", passage_stage),
    ("packing", packing_stage),
]

#: The stages fit models and search for copies, which SQL cannot express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
    return docs
