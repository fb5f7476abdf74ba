"""Query of the collocation operator and its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tidemark.llm import collocations
from tidemark.llm.common import table
from tidemark.llm.registry import query

SQL = r"""
WITH d AS (SELECT coalesce(lang, 'und') AS lang,
                  translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
p AS (SELECT lang, unnest(string_split_regex(t, '[.,;:!?\x0A-\x0D]')) AS piece FROM d),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS ws FROM p),
g AS (SELECT lang, k, unnest([array_to_string(ws[i:i + k - 1], ' ') FOR i IN range(1, len(ws) - k + 2)]) AS phrase
      FROM w, (VALUES (1), (2), (3), (4)) AS s(k) WHERE len(ws) >= k),
f AS (SELECT lang, k, phrase, count(*) AS a FROM g GROUP BY ALL),
n AS (SELECT lang, sum(a) AS n FROM f WHERE k = 1 GROUP BY lang),
c AS (SELECT lang, k, phrase, a, string_split(phrase, ' ') AS ws FROM f WHERE k >= 2 AND a >= 30),
cut AS (SELECT lang, k, phrase, a, j, array_to_string(ws[1:j], ' ') AS first, array_to_string(ws[j + 1:k], ' ') AS rest
        FROM (SELECT *, unnest(range(1, k)) AS j FROM c)),
s AS (SELECT cut.lang, cut.phrase, cut.a, j, x.a AS l, y.a AS r, (2000000::HUGEINT * cut.a) // (x.a + y.a) AS score
      FROM cut JOIN f x ON x.lang = cut.lang AND x.phrase = first AND x.k = j
      JOIN f y ON y.lang = cut.lang AND y.phrase = rest AND y.k = cut.k - j),
b AS (SELECT * FROM s QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, j) = 1),
h AS (SELECT lang, array_to_string(ws[i:i + m - 1], ' ') AS phrase, max(a) AS longer
      FROM (SELECT *, unnest(range(1, k - m + 2)) AS i FROM (SELECT *, unnest(range(2, k)) AS m FROM c)) GROUP BY 1, 2),
kept AS (SELECT b.* FROM b LEFT JOIN h USING (lang, phrase) WHERE longer IS NULL OR 100::HUGEINT * longer < 80::HUGEINT * a),
t AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT t.lang, rank, phrase, a, l, r, n.n::BIGINT AS n, score::BIGINT AS score FROM t JOIN n USING (lang) WHERE rank <= 2000
"""


@query("op11_phrase_collocations", SQL)
def op11_phrase_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations.collocations(table(spark, sf_dir, "documents"))
