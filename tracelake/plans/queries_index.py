"""Queries over the line index, keyless concurrency, collapsed rows and groups of similar sets."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from tracelake.functions import topic_text as TT
from tracelake.operators import activity as A, topics as TP, tree as T
from tracelake.plans.binding import DAY_MS, table
from tracelake.plans.queries_sessions import _PAGE, _TAIL, _TREE, _page_events, part_nodes
from tracelake.plans.queries_text import _SENT, _sentences
from tracelake.session import shared_folder
from tracelake.sources import line_index

QUERIES: dict = {}
ORACLES: dict = {}
_COLUMNS = ("user_id", "event_id", "ord", "page_start", "truncated")
#: Offsets of a block in these queries: a log of the driver tables fills several.
_BLOCK = 4


def query(sql: str | None = None):
    def register(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLES[fn.__name__] = sql
        return fn

    return register


def _indexed(spark: SparkSession, sf: str) -> str:
    path = f"{shared_folder(spark)}/line-index-{uuid.uuid4().hex}"
    line_index.write_log(_page_events(spark, sf), path, ["user_id"], block=_BLOCK)
    return path


@query(f"WITH {_PAGE}, {_TAIL.format(where='true', n=10)}")
def page_tail_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return line_index.page(spark, _indexed(spark, sf), ["user_id"], tail=10).select(*_COLUMNS)


@query(f"WITH {_PAGE}, {_TAIL.format(where='ord < 20', n=5)}")
def page_before_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return line_index.page(spark, _indexed(spark, sf), ["user_id"], tail=5, before=20).select(*_COLUMNS)


@query(f"WITH {_PAGE} SELECT user_id, event_id, ord, CAST(25 AS BIGINT) AS page_start, false AS truncated FROM pe WHERE ord >= 25")
def page_after_indexed(spark: SparkSession, sf: str) -> DataFrame:
    return line_index.page(spark, _indexed(spark, sf), ["user_id"], after=25).select(*_COLUMNS)


@query(f"WITH {_PAGE} SELECT user_id, ord // {_BLOCK} AS block, min(ord) AS first_ord, max(ord) AS last_ord, count(*) AS n FROM pe GROUP BY 1, 2")
def line_index_rows(spark: SparkSession, sf: str) -> DataFrame:
    return line_index.read_index(spark, _indexed(spark, sf)).select("user_id", "block", "first_ord", "last_ord", "n")


@query(
    f"""WITH i AS (SELECT o_orderkey, epoch_ms(min(o_orderdate)) AS s, epoch_ms(max(l_shipdate)) AS e FROM orders JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1),
    b AS (SELECT s // {DAY_MS} AS b0, greatest(s, e - 1) // {DAY_MS} AS b1 FROM i),
    d AS (SELECT b, sum(d) AS d FROM (SELECT b0 AS b, 1 AS d FROM b UNION ALL SELECT b1 + 1, -1 FROM b) GROUP BY 1),
    r AS (SELECT b, lead(b) OVER (ORDER BY b) AS nb, CAST(sum(d) OVER (ORDER BY b) AS BIGINT) AS alive FROM d)
    SELECT b * {DAY_MS} AS bucket_start, nb * {DAY_MS} AS run_end, alive FROM r WHERE nb IS NOT NULL"""
)
def concurrency_runs(spark: SparkSession, sf: str) -> DataFrame:
    """Orders under way over all customers, as runs between changes."""
    li = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.max("l_shipdate").alias("l_shipdate"))
    ms = lambda c: F.unix_millis(F.col(c).cast("timestamp"))
    spans = table(spark, sf, "orders").join(li, F.col("o_orderkey") == F.col("l_orderkey")).select(ms("o_orderdate").alias("started_at"), ms("l_shipdate").alias("ended_at"))
    return A.concurrency_runs(spans, bucket_ms=DAY_MS)


_PICK = """picks AS (SELECT root, id, {room} AS room FROM hid QUALIFY (count(*) OVER (PARTITION BY root) <= {room}) OR ({room} > 1 AND row_number() OVER (PARTITION BY root ORDER BY cents DESC, id) < {room})),
    keep AS (SELECT DISTINCT unnest(path) AS id FROM t WHERE id IN (SELECT id FROM shown) OR id IN (SELECT id FROM picks)),
    counts AS (SELECT root, count(*) - count(*) FILTER (id IN (SELECT id FROM picks)) AS hidden FROM hid GROUP BY 1)
    SELECT t.id, t.root, coalesce(hidden, 0) AS hidden FROM t JOIN keep USING (id) LEFT JOIN counts USING (root)"""
_COLLAPSED = f"""WITH {_TREE}, open AS (SELECT DISTINCT unnest(t.path) AS id FROM t JOIN n USING (id) WHERE n.p_size > 48),
    shown AS (SELECT DISTINCT unnest(path) AS id FROM t WHERE depth = 0 OR id IN (SELECT id FROM open)),
    hid AS (SELECT t.root, t.id, n.cents FROM t JOIN n USING (id) WHERE t.id NOT IN (SELECT id FROM shown))"""


def _picked(spark: SparkSession, sf: str, room: int) -> DataFrame:
    tree = T.resolve_tree(part_nodes(spark, sf))
    return T.pick_collapsed(tree, F.col("p_size") <= 48, room, "cents", by=["root"]).select("id", "root", "hidden")


@query(f"{_COLLAPSED}, {_PICK.format(room=0)}")
def collapsed_pick_none(spark: SparkSession, sf: str) -> DataFrame:
    return _picked(spark, sf, 0)


@query(f"{_COLLAPSED}, {_PICK.format(room=1)}")
def collapsed_pick_one(spark: SparkSession, sf: str) -> DataFrame:
    return _picked(spark, sf, 1)


@query(f"{_COLLAPSED}, {_PICK.format(room=25)}")
def collapsed_pick_many(spark: SparkSession, sf: str) -> DataFrame:
    """Room for 25 more rows in each tree: the collapsed nodes that ended last, with their ancestors."""
    return _picked(spark, sf, 25)


@query(
    f"""WITH RECURSIVE {_SENT}, e AS (SELECT id_a AS a, id_b AS b FROM near UNION ALL SELECT id_b, id_a FROM near),
    r AS (SELECT a AS id, a AS low FROM e UNION SELECT e.b, r.low FROM r JOIN e ON e.a = r.id WHERE r.low < e.b),
    g AS (SELECT id, min(low) AS low FROM r GROUP BY 1), d AS (SELECT a AS id, count(*) AS links FROM e GROUP BY 1)
    SELECT sets.project, sets.id, coalesce(links, 0) AS links, coalesce(low, sets.id) AS "group" FROM sets LEFT JOIN g USING (id) LEFT JOIN d USING (id)"""
)
def jaccard_groups(spark: SparkSession, sf: str) -> DataFrame:
    """Every distinct title set with its number of links and the group that all links make."""
    s = _sentences(spark, sf).withColumn("tokens", F.array_sort(TT.title_tokens("title"))).where(F.size("tokens") > 0)
    sets = s.groupBy("project", "tokens").agg(F.min("n").alias("id"))
    return TP.jaccard_groups(sets, "id", "tokens", ["project"])
