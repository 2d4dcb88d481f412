"""Projections of the stored tables onto layout entities. Each is one SQL text over integers that Spark and the checking
engine both read, so a query and its oracle start from the same rows."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

PROJECTIONS = {
    "boxes": """SELECT o_orderpriority AS template, CAST(o_custkey % 50 AS BIGINT) AS variant, CAST(o_orderkey % 8 AS BIGINT) AS role, min(o_orderkey) AS k,
        min(o_orderkey) * 37 % 960 AS x, min(o_orderkey) * 53 % 540 AS y, 40 + min(o_orderkey) * 7 % 200 AS w, 16 + min(o_orderkey) * 11 % 80 AS h
        FROM orders GROUP BY o_orderpriority, CAST(o_custkey % 50 AS BIGINT), CAST(o_orderkey % 8 AS BIGINT)""",
    "templates": "SELECT DISTINCT o_orderpriority AS template FROM orders",
    "variants": """SELECT n_nationkey AS k, CASE WHEN n_nationkey % 4 = 0 THEN '' WHEN n_nationkey % 4 = 1 THEN NULL ELSE lower(n_name) END AS ident,
        CASE WHEN n_nationkey % 5 = 0 THEN NULL WHEN n_nationkey % 5 = 1 THEN '' ELSE substr(n_name, 1, 2) || '_' || substr(n_name, 3, 2) END AS language FROM nation""",
    "obstacles": """SELECT t.template, 'o' || CAST(s_suppkey % 7 AS STRING) AS name, min(s_suppkey) * 71 % 900 AS x, min(s_suppkey) * 43 % 500 AS y, 30 + min(s_suppkey) * 13 % 90 AS w,
        20 + min(s_suppkey) * 17 % 60 AS h, min(s_suppkey) % 6 AS pad FROM supplier JOIN (SELECT o_orderpriority AS template, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i
        FROM (SELECT DISTINCT o_orderpriority FROM orders) u) t ON s_suppkey % 5 = t.i GROUP BY t.template, 'o' || CAST(s_suppkey % 7 AS STRING)""",
    "overrides": """SELECT t.template, c_custkey % 50 AS variant, c_custkey % 8 AS role, min(c_custkey) AS ck, min(c_custkey) * 29 % 900 AS x, min(c_custkey) * 31 % 500 AS y,
        CASE WHEN min(c_custkey) % 3 = 0 THEN 1 ELSE 0 END AS has_x, CASE WHEN min(c_custkey) % 4 = 0 THEN 1 ELSE 0 END AS null_y FROM customer
        JOIN (SELECT o_orderpriority AS template, row_number() OVER (ORDER BY o_orderpriority) - 1 AS i FROM (SELECT DISTINCT o_orderpriority FROM orders) u) t
        ON c_custkey % 5 = t.i WHERE c_custkey % 3 <> 1 GROUP BY t.template, c_custkey % 50, c_custkey % 8""",
    "files": """SELECT source || '/' || CAST(doc_id AS STRING) || CASE doc_id % 6 WHEN 0 THEN '.PNG' WHEN 1 THEN '.ttf' WHEN 2 THEN '.csv' WHEN 3 THEN '.svg' WHEN 4 THEN '.tar.gz' ELSE '' END AS relative,
        source, doc_id, n_chars AS bytes, text FROM documents""",
    "frames": """SELECT user_id AS image, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, 10 + CAST(event_id % 7 AS BIGINT) * 10 AS duration_ms,
        event_id % 3 AS disposal FROM events""",
    "base_rows": """SELECT conv_id AS variant, turn AS template, CASE WHEN conv_id % 7 = 0 THEN 'skipped' ELSE 'rendered' END AS status, length(text) AS metric,
        conv_id * 100000 + turn AS ord FROM (SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS n FROM conversations) u WHERE n = 1) c
        WHERE (conv_id + turn) % 5 <> 0""",
    "update_rows": """SELECT conv_id AS variant, turn AS template, CASE WHEN conv_id % 2 = 0 THEN 'skipped' ELSE 'rendered' END AS status,
        CASE WHEN conv_id % 2 = 0 THEN NULL ELSE length(text) + 1000 END AS metric, turn * 10000000000 + conv_id AS ord
        FROM (SELECT conv_id, turn, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS n FROM conversations) u WHERE n = 1) c WHERE (conv_id + turn) % 3 = 0""",
    "ladder": "SELECT doc_id, n_chars, 200 + doc_id * 7919 % 5000 AS budget, doc_id % 4 AS family, doc_id % 2 AS alpha FROM documents",
}


def projection(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The projection over the parquet files under ``sf_dir``."""
    text = PROJECTIONS[name]
    for t in sorted(set(re.findall(r"\b(region|nation|customer|supplier|part|orders|lineitem|events|documents|conversations|embeddings)\b(?=[\s)]|$)", text))):
        text = re.sub(rf"(FROM|JOIN) {t}\b", rf"\1 parquet.`{sf_dir}/{t}.parquet`", text)
    return spark.sql(text)


def with_projections(sql: str, *names: str) -> str:
    """Oracle SQL over the same projections."""
    heads = ",\n".join(f"{n} AS ({PROJECTIONS[n]})" for n in names)
    body = sql.strip()
    return f"WITH {heads}, {body[5:]}" if body[:5].upper() == "WITH " else f"WITH {heads}\n{body}"
