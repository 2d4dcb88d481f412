"""The registered queries of the corpus operators, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, media, packing, passages, piece_fst, simhash, token_counts, topk, toxicity, url_filter
from .common import bound_memory, crc_mod, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Register a query; it runs with the bounds on memory that ``bound_memory`` sets for its session."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        bound_memory(spark)
        return f(spark, sf_dir)

    QUERIES[f.__name__] = run
    return run


@query
def op1_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text stored in an ISO media container, and what is read back from it."""
    docs = table(spark, sf_dir, "documents").select("doc_id", F.coalesce(F.col("text"), F.lit("")).cast("binary").alias("content"))
    stored = docs.select("doc_id", F.length("content").cast("long").alias("n_bytes"), media.round_trip(F.col("content")).alias("read"))
    return stored.select("doc_id", "n_bytes", "read.*")


URL_RULES = [
    url_filter.Rule("allow", "org", "/"),
    url_filter.Rule("block", "example.org", "/es/"),
    url_filter.Rule("block", "example.org", "/en/1"),
    url_filter.Rule("allow", "com", "/fr/"),
    url_filter.Rule("block", "com", "/de/"),
]


@query
def op6_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every page's URL judged by the five rules; where none fits, allow."""
    pages = table(spark, sf_dir, "pages").select("page_id", "url")
    return url_filter.filter_urls(pages, URL_RULES).select("page_id", "host", "path", "rule", "verdict")


SQL["op6_url_filter"] = """
WITH cut AS (
  SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
    coalesce(translate(regexp_extract(rest, '^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') AS path
  FROM cut
), rules(verdict, rhost, rpath) AS (
  VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/')
), hits AS (
  SELECT page_id, rhost || rpath AS rule, verdict,
    row_number() OVER (PARTITION BY page_id ORDER BY length(rhost || rpath) DESC, verdict DESC) AS n
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath)
)
SELECT p.page_id, p.host, p.path, h.rule, coalesce(h.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN hits h ON h.page_id = p.page_id AND h.n = 1
"""


@query
def op2_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's ids packed into sequences of at most 2,048."""
    return packing.pack_documents(table(spark, sf_dir, "documents").select("doc_id", "text"), public_tokenizers.path("byte_bpe_50k.json")).plan


@query
def op4_exact_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 20 vectors of highest inner product for every vector whose id is divisible by 20."""
    finite = lambda x: ~F.isnan(x) & (F.abs(x) < float("inf"))  # noqa: E731  floor() would make a number of either
    floored = F.transform("embedding", lambda x: F.when(finite(x), F.floor(F.lit(64) * x.cast("double")).cast("double")))
    vectors = table(spark, sf_dir, "embeddings").select("vec_id", floored.alias("vector"))
    return topk.exact_topk(vectors, F.col("vec_id") % 20 == 0)


SQL["op4_exact_topk"] = """
WITH vectors AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(64 * CAST(x AS DOUBLE))) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM vectors q JOIN vectors c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), ranked AS (
  SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 20
"""


@query
def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxicity score for every whole text, learned from labels of four fifths of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    held_out = crc_mod("doc_id", 5) == 0
    model = toxicity.train(docs.filter(~held_out), table(spark, sf_dir, "labels").filter(~held_out).select("doc_id", "toxic"))
    scored = docs.select("doc_id", held_out.alias("held_out"), toxicity.score(model, F.col("text")).alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.5).cast("int"))


@query
def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The language of every whole text, learned from two thirds of the ids."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    held_out = crc_mod("doc_id", 3) == 1
    model = langid.train(docs.filter(~held_out))
    return docs.select("doc_id", held_out.alias("held_out"), langid.identify(model, F.col("text")).alias("r")).select("doc_id", "held_out", "r.lang_pred", "r.score")


@query
def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pre-tokens and unigram tokens of every whole text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", token_counts.token_counts(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("r")).select("doc_id", "r.*")


@query
def op7_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprint and near-duplicate component of every whole text."""
    found = simhash.near_duplicates(table(spark, sf_dir, "documents").select("doc_id", "text"), words=3, radius=2)
    return found.select("doc_id", simhash.hexadecimal(F.col("fp")).alias("fingerprint"), "component_id")


@query
def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text encoded to pieces and decoded again."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return docs.select("doc_id", piece_fst.encode_and_decode(F.col("text"), public_tokenizers.path("piece_bpe_32k.model")).alias("r")).select("doc_id", "r.*")


@query
def op10_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document with the passages of 50 words or more that repeat an earlier one, and what is left of its text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    joined = passages.with_spans(docs, min_words=50, similarity=0.8)
    spans = F.col("__spans")
    left = passages.without_spans(F.coalesce(F.col("text"), F.lit("")), spans)
    return joined.select(
        "doc_id",
        F.coalesce(F.size(spans), F.lit(0)).alias("n_passages"),
        F.coalesce(F.aggregate(spans, F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"]), F.lit(0)).alias("removed_words"),
        F.coalesce(F.array_join(F.transform(spans, lambda s: F.concat_ws("-", s["start"], s["end"])), ","), F.lit("")).alias("spans"),
        F.coalesce(F.col("__sources"), F.array().cast("array<bigint>")).alias("sources"),
        F.sha2(left.cast("binary"), 256).alias("kept_sha256"),
    )
