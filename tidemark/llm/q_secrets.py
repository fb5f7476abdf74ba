"""Query of the secret scan, and its oracle."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import secrets
from tidemark.llm.common import table
from tidemark.llm.registry import query

BASE = len(secrets.BASE)


def _oracle() -> str:
    """Spans of every rule by a plain scan of every text, without an index."""
    per_rule = []
    for order, r in enumerate(secrets.RULES):
        pattern = r.pattern.replace("'", "''")
        group, least = (2 + r.least[0], r.least[1]) if r.least else (2, 0)
        shifted = f"'(?s)(.*?)({pattern})'"
        per_rule.append(f"""
SELECT doc_id, row, {order} AS ord, '{r.name}' AS kind, u.e - length(u.m) AS s, u.e AS e FROM (
  SELECT doc_id, row, unnest(list_transform(range(1, len(g0) + 1), lambda i: {{
    'e': list_sum(list_transform(g0[1:i], lambda x: length(x))), 'm': g2[i], 'v': gv[i]}})) AS u
  FROM (SELECT doc_id, row, regexp_extract_all(t, {shifted}, 0) AS g0, regexp_extract_all(t, {shifted}, 2) AS g2,
               regexp_extract_all(t, {shifted}, {group}) AS gv FROM d))
WHERE length(u.v) >= {least}""")
    joined = " UNION ALL ".join(per_rule)
    one = "kind || ':' || s::BIGINT || ':' || e::BIGINT"
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, row_number() OVER () AS row FROM documents),
hits AS ({joined}),
per_doc AS (SELECT row,
    count(*) FILTER (ord = 0) AS n_assign, count(*) FILTER (ord = 1) AS n_access, count(*) FILTER (ord = 2) AS n_hex,
    string_agg({one}, ',' ORDER BY s, ord) FILTER (ord < {BASE}) AS base, string_agg({one}, ',' ORDER BY s, ord) AS spans
  FROM hits GROUP BY row)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN per_doc USING (row)"""


@query("op5_secret_scan", _oracle())
def op5_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = secrets.scan(table(spark, sf_dir, "documents").select("doc_id", "text"))
    base = F.filter("spans", lambda s: s["order"] < BASE)
    count = lambda name: F.size(F.filter("spans", lambda s: s["kind"] == name)).cast("long")
    return found.select(
        "doc_id", count("assign").alias("n_assign"), count("access").alias("n_access"), count("hex").alias("n_hex"),
        F.sha2(secrets.digest(base).cast("binary"), 256).alias("base_sha256"),
        secrets.digest(F.col("spans")).alias("spans"))
