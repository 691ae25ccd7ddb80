"""Queries of full-text ranking: keywords, documents by the terms of test items, entities by name and summary."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from tidemark.operators import fulltext as T
from tidemark.plans.registry import query
from tidemark.sources import fixtures as X
from tidemark.sources.shared import shared_folder

_STOP = "['', " + ", ".join(f"'{w}'" for w in T.STOP_WORDS) + "]"


def _words(text: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({text}), '[^\\p{{L}}0-9]+'), lambda w: w <> '')"


def _keywords(text: str) -> str:
    kept = f"list_filter(regexp_split_to_array(lower({text}), '\\s+'), lambda w: NOT list_contains({_STOP}, regexp_replace(w, '[^\\p{{L}}]', '', 'g')))"
    return f"CASE WHEN len({kept}) > 0 THEN {_words(f'array_to_string({kept}, chr(32))')} ELSE {_words(text)} END"


_SCORED = """df AS (SELECT term, count(*)::DOUBLE AS df FROM tf GROUP BY term),
s AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5::DOUBLE) / (df + 0.5::DOUBLE)) * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * l / mean))) AS s FROM qt JOIN tf USING (term) JOIN df USING (term), n GROUP BY ALL),
r AS (SELECT query_id, id, round(s / (s + 1), 6) AS score FROM s), k AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INTEGER) AS rank FROM r) SELECT * FROM k WHERE rank <= 10"""


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/text-index-{uuid.uuid4().hex}"


@query("fts1_keywords", f"SELECT conv_id, turn, array_to_string({_keywords('text')}, ' ') AS keywords FROM conversations")
def _(spark, d):
    return X.table(spark, d, "conversations").select("conv_id", "turn", F.array_join(T.keywords("text"), " ").alias("keywords"))


@query("fts2_fulltext_topk", f"""WITH dk AS (SELECT doc_id AS id, {_words("text")} AS w FROM documents WHERE text IS NOT NULL), n AS (SELECT count(*) AS n, avg(len(w)) AS mean FROM dk),
qt AS (SELECT DISTINCT query_id, unnest({_keywords("text")}) AS term FROM (SELECT item_id AS query_id, text FROM benchmark)),
t AS (SELECT id, len(w) AS l, unnest(w) AS term FROM dk), tf AS (SELECT id, l, term, count(*)::DOUBLE AS tf FROM t WHERE term IN (SELECT term FROM qt) GROUP BY ALL), {_SCORED}""")
def _(spark, d):
    asked = X.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    return T.fulltext_topk(asked, X.table(spark, d, "documents").select("doc_id", "text"), 10, _folder(spark))


# Pages by their titles, which count twice, and their text.
@query("fts2_field_weights", f"""WITH dk AS (SELECT page_id AS id, {_words("coalesce(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '')")} AS a, {_words("regexp_replace(html, '<[^>]*>', ' ', 'g')")} AS b FROM pages WHERE html IS NOT NULL),
n AS (SELECT count(*) AS n, avg(len(a) + len(b)) AS mean FROM dk), qt AS (SELECT DISTINCT query_id, unnest({_keywords("text")}) AS term FROM (SELECT item_id AS query_id, text FROM benchmark)),
t AS (SELECT id, len(a) + len(b) AS l, unnest(a) AS term, 2.0::DOUBLE AS x FROM dk UNION ALL SELECT id, len(a) + len(b), unnest(b), 1.0 FROM dk), tf AS (SELECT id, l, term, sum(x) AS tf FROM t WHERE term IN (SELECT term FROM qt) GROUP BY ALL), {_SCORED}""")
def _(spark, d):
    asked = X.table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")
    title = F.coalesce(F.regexp_extract("html", r"(?is)<title[^>]*>(.*?)</title>", 1), F.lit(""))
    pages = X.table(spark, d, "pages").where("html is not null").select(F.col("page_id").alias("doc_id"), title.alias("name"), F.regexp_replace("html", "<[^>]*>", " ").alias("summary"))
    return T.fulltext_topk(asked, pages, 10, _folder(spark), {"name": 2.0, "summary": 1.0})
