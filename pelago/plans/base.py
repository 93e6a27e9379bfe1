"""Registry of queries, and the stand-in views over the given tables."""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

#: The views, as SQL that both engines run; {string} is the engine's text type.
VIEWS = {
    "listings_v": """SELECT o.o_orderkey AS listing_id, o.o_custkey AS owner_id, c.c_nationkey AS state,
       CAST(substr(o.o_orderpriority, 1, 1) AS INT) - 1 AS speed,
       CASE WHEN o.o_orderstatus = 'F' THEN 1 ELSE 2 END AS type,
       CAST(o.o_orderkey % 120 AS INT) AS age, CAST(o.o_orderkey % 7 AS INT) AS breed1, CAST(o.o_orderkey % 5 AS INT) AS breed2,
       CAST(o.o_orderkey % 3 + 1 AS INT) AS vaccinated, CAST((o.o_orderkey + 1) % 3 + 1 AS INT) AS dewormed,
       CAST(o.o_orderkey % 4 AS INT) AS photos, CAST(o.o_orderkey % 6 AS INT) AS quantity,
       CASE WHEN o.o_orderkey % 10 < 8 THEN CAST(0 AS DOUBLE) ELSE o.o_totalprice END AS fee,
       CASE WHEN o.o_orderkey % 11 = 0 THEN NULL WHEN o.o_orderkey % 11 = 1 THEN 'No Name'
            WHEN o.o_orderkey % 11 = 2 THEN '123' WHEN o.o_orderkey % 11 = 3 THEN ' -- '
            WHEN o.o_orderkey % 11 = 4 THEN '  ' ELSE c.c_name END AS name
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "forms_v": """SELECT o.o_orderkey AS request_id, o.o_orderdate AS submitted, o.o_custkey AS owner_id,
       CASE WHEN o.o_orderkey % 97 = 13 THEN 'Bird' WHEN o.o_orderstatus = 'F' THEN 'Dog' ELSE 'Cat' END AS pet_type,
       CASE WHEN o.o_orderkey % 11 = 0 THEN '' WHEN o.o_orderkey % 11 = 4 THEN '  ' WHEN o.o_orderkey % 11 = 5 THEN concat(c.c_name, ' and ', c.c_mktsegment) ELSE c.c_name END AS name,
       CASE WHEN o.o_orderkey % 211 = 1 THEN NULL WHEN o.o_orderkey % 53 = 7 THEN 300 ELSE CAST(o.o_orderkey % 120 AS INT) END AS age_months,
       CASE o.o_orderkey % 4 WHEN 0 THEN 'Male' WHEN 1 THEN 'Female' WHEN 2 THEN 'Mixed' ELSE 'Male' END AS gender,
       CAST(o.o_custkey AS INT) AS breed1, CAST(o.o_orderkey % 5 AS INT) AS breed2, CAST(o.o_orderkey % 8 AS INT) AS color1, CAST(o.o_orderkey % 3 AS INT) AS color2, CAST(o.o_orderkey % 2 AS INT) AS color3,
       CASE WHEN o.o_orderkey % 83 = 2 THEN 9 ELSE CAST(o.o_orderkey % 4 + 1 AS INT) END AS maturity_size, CAST(o.o_orderkey % 3 + 1 AS INT) AS fur_length,
       CASE o.o_orderkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Not Sure' END AS vaccinated, CASE o.o_custkey % 3 WHEN 0 THEN 'Yes' WHEN 1 THEN 'No' ELSE 'Not Sure' END AS dewormed,
       CASE o.o_orderkey % 7 WHEN 0 THEN 'Yes' WHEN 1 THEN 'Not Sure' ELSE 'No' END AS sterilized,
       CASE WHEN o.o_orderkey % 101 = 9 THEN 'Unknown' WHEN o.o_orderkey % 9 = 0 THEN 'Serious Injury' WHEN o.o_orderkey % 9 = 1 THEN 'Minor Injury' ELSE 'Healthy' END AS health,
       CASE WHEN o.o_orderkey % 89 = 5 THEN CAST(-1 AS DOUBLE) WHEN o.o_orderkey % 89 = 6 THEN NULL WHEN o.o_orderkey % 10 < 8 THEN CAST(0 AS DOUBLE) ELSE o.o_totalprice END AS fee,
       CASE WHEN o.o_orderkey % 71 = 4 THEN NULL ELSE CAST(o.o_orderkey % 6 AS INT) + CASE WHEN o.o_orderkey % 71 = 3 THEN 0 ELSE 1 END END AS quantity,
       CAST(41000 + o.o_custkey % 997 AS INT) AS state, CASE WHEN o.o_orderkey % 5 = 0 THEN 1 ELSE 0 END AS video_amt, CAST(o.o_orderkey % 4 AS INT) AS photos
FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey""",
    "proba_v": """SELECT listing_id, speed AS y, w0/(w0+w1+w2+w3+w4) AS p0, w1/(w0+w1+w2+w3+w4) AS p1,
       w2/(w0+w1+w2+w3+w4) AS p2, w3/(w0+w1+w2+w3+w4) AS p3, w4/(w0+w1+w2+w3+w4) AS p4
FROM (SELECT listing_id, speed,
        CAST(1 + (listing_id*3)%7 + CASE WHEN speed=0 THEN 4 ELSE 0 END AS DOUBLE) AS w0,
        CAST(1 + (listing_id*5)%11 + CASE WHEN speed=1 THEN 4 ELSE 0 END AS DOUBLE) AS w1,
        CAST(1 + (listing_id*7)%13 + CASE WHEN speed=2 THEN 4 ELSE 0 END AS DOUBLE) AS w2,
        CAST(1 + (listing_id*11)%17 + CASE WHEN speed=3 THEN 4 ELSE 0 END AS DOUBLE) AS w3,
        CAST(1 + (listing_id*13)%19 + CASE WHEN speed=4 THEN 4 ELSE 0 END AS DOUBLE) AS w4
      FROM listings_v) t""",
    "attrib_v": """SELECT l_orderkey AS row_id, l_linenumber % 5 AS cls,
       CASE l_linenumber % 6 WHEN 0 THEN concat('text_emb_', CAST(l_partkey % 8 AS {string}))
            WHEN 1 THEN concat('img_emb_', CAST(l_suppkey % 8 AS {string}))
            WHEN 2 THEN 'rescuer_pet_count' WHEN 3 THEN 'log_fee' WHEN 4 THEN 'doc_sentiment_score' ELSE 'Age' END AS feature,
       l_quantity AS value, round(l_discount - l_tax, 4) AS contribution
FROM lineitem""",
    "trace_v": """SELECT event_id, user_id AS session_id, ts, event_type AS node, value AS duration_ms,
       CASE WHEN event_type = 'error' THEN 'error' WHEN event_id % 20 = 0 THEN 'skipped' ELSE 'success' END AS status
FROM events""",
    "docs_v": """SELECT d.doc_id, d.text, d.lang, d.source, l.quality, l.toxic
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""",
}
_NEEDS = {"listings_v": ("orders", "customer"), "forms_v": ("orders", "customer"), "proba_v": ("listings_v",), "attrib_v": ("lineitem",), "trace_v": ("events",), "docs_v": ("documents", "labels")}


class Tables:
    """The given tables and the views over them, read when they are asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def over(self, name: str, **instead: DataFrame) -> DataFrame:
        """A view with other rows, a stream for instance, in place of some of its tables."""
        sql, used = VIEWS[name].format(string="STRING"), {}
        for need in _NEEDS[name]:
            sql = re.sub(rf"\b{need}\b(?=\s+[a-z]\b|\s*\)|\s*$)", "{" + need + "}", sql)
            used[need] = instead.get(need) or getattr(self, need)
        return self.spark.sql(sql, **used)

    def __getattr__(self, name: str) -> DataFrame:
        if name in VIEWS:
            return self.over(name)
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")


def with_views(sql: str) -> str:
    """DuckDB text with the views that it names as common table expressions."""
    wanted, text = [], sql
    for name in ("docs_v", "trace_v", "attrib_v", "proba_v", "forms_v", "listings_v"):
        if re.search(rf"\b{name}\b", text):
            text += VIEWS[name]
            wanted.insert(0, name)
    if not wanted:
        return sql
    head = ", ".join(f"{v} AS ({VIEWS[v].format(string='VARCHAR')})" for v in wanted)
    body = sql.strip()
    if body.upper().startswith("WITH "):
        return f"WITH {head}, {body[5:]}"
    return f"WITH {head} {body}"


def query(name: str, sql: str | None = None):
    """Register f(tables) under a survey id, with the SQL that must give the same rows."""

    def keep(f: Callable[[Tables], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Tables(spark, sf_dir))
        if sql is not None:
            ORACLES[name] = with_views(sql)
        return f

    return keep
