"""What registers a query: its name, its function of (spark, sf_dir) and the SQL that checks it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# A page's title as SQL: its text, then with entities decoded.
TITLE_SQL = r"trim(regexp_replace(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), '[ \t\n\r]+', ' ', 'g'))"
DECODED_SQL = f"replace(replace(replace(replace(replace({TITLE_SQL}, '&amp;', '&'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', '''')"
# An address as in the table of pages without query, fragment and a slash at its end.
PLAIN_SQL = r"regexp_replace(regexp_replace(url, '[?#].*$', ''), '^(https?://[^/]+)$', '\1/')"
NORM_SQL = f"CASE WHEN length(regexp_replace({PLAIN_SQL}, '^https?://[^/]+', '')) > 1 THEN regexp_replace({PLAIN_SQL}, '/$', '') ELSE {PLAIN_SQL} END"
