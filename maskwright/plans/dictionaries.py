"""A dictionary of real size over all documents: customers, parts and the words of the benchmark."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators.dictionary import literal_hits
from ..sources.tables import dealt, table
from .base import query

_LITERALS = (
    "lits AS (SELECT c_name AS value FROM customer UNION SELECT p_name FROM part UNION "
    "SELECT w FROM (SELECT unnest(regexp_extract_all(text, '[\\p{L}\\p{N}_]{4,}')) AS w FROM benchmark)), "
    "known AS (SELECT lower(value) AS run, min(value) AS value, CAST(any_value(len(regexp_extract_all(value, '[\\p{L}\\p{N}_]+'))) AS BIGINT) AS n "
    "FROM lits WHERE regexp_matches(value, '(?s)^[\\p{L}\\p{N}_](?:.*[\\p{L}\\p{N}_])?$') GROUP BY 1)"
)


def dictionary(spark, root):
    words = table(spark, root, "benchmark").select(F.explode(F.regexp_extract_all("text", F.lit(r"[\p{L}\p{N}_]{4,}"), F.lit(0))).alias("value"))
    names = table(spark, root, "customer").select(F.col("c_name").alias("value")).union(table(spark, root, "part").select("p_name"))
    distinct = names.union(words).distinct()
    return distinct.groupBy(F.lower("value").alias("k")).agg(F.min("value").alias("value")).select("value", F.lit(True).alias("boundary"))


@query(
    "dictionary_hits",
    f"WITH {_LITERALS}, p AS (SELECT doc_id, regexp_extract_all(text, '[\\p{{L}}\\p{{N}}_]+|[^\\p{{L}}\\p{{N}}_]+') AS ps FROM documents), "
    "lens AS (SELECT DISTINCT n FROM known), "
    "places AS (SELECT doc_id, ps, unnest(range(1, len(ps) + 1)) AS i FROM p), "
    "words AS (SELECT doc_id, ps, i FROM places WHERE regexp_matches(ps[i], '^[\\p{L}\\p{N}_]')), "
    "runs AS (SELECT doc_id, lower(array_to_string(ps[i:i + 2 * n - 2], '')) AS run, 1 AS times FROM words, lens WHERE i + 2 * n - 2 <= len(ps) "
    # a word that is copies of a shorter one
    "UNION ALL SELECT doc_id, left(w, size), length(w) // size FROM (SELECT doc_id, lower(ps[i]) AS w, "
    "list_filter(range(1, length(ps[i]) // 2 + 1), lambda k: length(ps[i]) % k = 0 AND repeat(left(lower(ps[i]), k), length(ps[i]) // k) = lower(ps[i]))[1] AS size "
    "FROM words) WHERE size IS NOT NULL) "
    "SELECT doc_id, value, CAST(sum(times) AS BIGINT) AS n FROM runs JOIN known USING (run) GROUP BY 1, 2",
)
def dictionary_hits(spark, root):
    """Occurrences of each literal in each document."""
    hits = literal_hits(dealt(table(spark, root, "documents").select("doc_id", "text")), ["doc_id"], "text", dictionary(spark, root))
    return hits.groupBy("doc_id", "value").agg(F.count("*").alias("n"))
