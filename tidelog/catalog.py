"""Registered queries of the change-data engine, each with SQL that says the same another way.

The change log over ``orders`` is derived from the key k: every row is snapshot (seq 0); the status
of each fifth is updated (1); each seventh moves to k + 10,000,000 (2); each eleventh
is deleted (3); each fifty-fifth is inserted again under k (4).  The SQL states the outcome in
closed form, not by replaying the log.
"""

from __future__ import annotations

import math
import re
import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import catalog_rules
from .functions import canonical
from .functions.filters import compile_filter, parse_filter, struct_lookup
from .operators import apply, encode
from .operators.changelog import changes, image, image_type, snapshot
from .operators.route import route_mixed, route_table
from .operators.transform import apply_rule, compile_rule, project, rewrite_ops, snapshot_table
from .plans import ddl
from .plans.evolve import evolve_state, plan_change
from .plans.schema import Column, Table, describe
from .plans.selector import Route, compile_pattern
from .sources import verify
from .sources.snapshot import NewTables, Startup, backfill, captured_only, from_start, on_resume, plan_splits, split_predicate

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    def register(f: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE_SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# --- the derived change log ---------------------------------------------------------------

MOVED = 10_000_000
KEY = ("o_orderkey",)


def rotate(status: F.Column) -> F.Column:
    return F.when(status == "F", "O").when(status == "O", "P").otherwise("F")


def orders(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_orderdate")


def orders_changes(rows: DataFrame) -> DataFrame:
    """The changes, by one pass over the rows: no join, no order needed."""
    k, kind = F.col("o_orderkey"), T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    new_status = F.when(k % 5 == 0, rotate(F.col("o_orderstatus"))).otherwise(F.col("o_orderstatus"))
    moved = F.when(k % 7 == 0, k + MOVED).otherwise(k)
    first = image(rows.columns)
    second = image(rows.columns, {"o_orderstatus": new_status})
    third = image(rows.columns, {"o_orderstatus": new_status, "o_orderkey": moved})
    fourth = image(rows.columns, {"o_orderstatus": F.lit("N")})
    null = F.lit(None).cast(kind)
    one = lambda op, before, after, seq, when: F.when(when, F.struct(F.lit(op).alias("op"), before.cast(kind).alias("before"), after.cast(kind).alias("after"), F.lit(seq).alias("seq")))
    events = F.array(one("u", first, second, 1, k % 5 == 0), one("u", second, third, 2, k % 7 == 0), one("d", third, null, 3, k % 11 == 0), one("c", null, fourth, 4, k % 55 == 0))
    flat = rows.select(F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.*")
    return changes(flat, F.col("op"), F.col("before"), F.col("after"), F.col("seq"), "shop", "orders", kind, F.col("seq") * 1000 + 1_700_000_000_000)


def orders_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return snapshot(rows, "shop", "orders").unionByName(orders_changes(rows))


O = """WITH o AS (
  SELECT o_orderkey AS k, o_custkey AS c, o_orderstatus AS st, o_orderdate AS d,
         CASE WHEN o_orderkey % 5 = 0 THEN CASE o_orderstatus WHEN 'F' THEN 'O' WHEN 'O' THEN 'P' ELSE 'F' END ELSE o_orderstatus END AS ns,
         CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey + 10000000 ELSE o_orderkey END AS nk FROM orders)
"""  # noqa: E741

# --- snapshot, projection, filter ------------------------------------------------------------


@query("SELECT c_custkey, c_name, c_mktsegment FROM customer WHERE c_mktsegment = 'BUILDING'")
def snapshot_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    rule = compile_rule(r"shop\.customer", "c_custkey, `c_name`, c_mktsegment", "c_mktsegment = 'BUILDING'")
    return snapshot_table(table(spark, sf_dir, "customer"), rule)


def filtered(rows: DataFrame, text: str) -> DataFrame:
    return rows.where(compile_filter(parse_filter(text), struct_lookup(rows.schema)))


@query("SELECT c_custkey, c_acctbal FROM customer WHERE (c_acctbal >= 100.5 AND c_nationkey <> 3) OR c_custkey < 20")
def filter_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "customer"), "c_acctbal >= 100.5 AND C_NationKey != 3 OR c_custkey < 20").select("c_custkey", "c_acctbal")


@query("SELECT p_partkey, p_size FROM part WHERE p_size IN (1, 5, 9) OR p_brand IN ('Brand#11', 'Brand#23')")
def filter_in(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "part"), "p_size IN (1, 5, '9', NULL) OR p_brand IN ('Brand#11', 'Brand#23')").select("p_partkey", "p_size")


@query("SELECT p_partkey, p_type FROM part WHERE regexp_matches(p_type, '^[^\\n]*E[^\\n][^\\n]*$') AND NOT regexp_matches(p_name, '^[^\\n]*0$')")
def filter_like(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(table(spark, sf_dir, "part"), "p_type LIKE '%E_%' AND NOT p_name LIKE '%0'").select("p_partkey", "p_type")


EVENTS_SQL = "WITH e AS (SELECT event_id, CASE WHEN event_type <> 'view' THEN event_type END AS kind, value FROM events) "


def events_with_nulls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``kind``: the type, null for views."""
    return table(spark, sf_dir, "events").select("event_id", F.when(F.col("event_type") != "view", F.col("event_type")).alias("kind"), "value")


@query(EVENTS_SQL + "SELECT event_id, kind FROM e WHERE kind IS NULL OR kind = 'error'")
def filter_null(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(events_with_nulls(spark, sf_dir), "kind IS NULL OR kind = 'error' AND gone IS NULL").select("event_id", "kind")


@query(EVENTS_SQL + "SELECT event_id, kind FROM e WHERE NOT coalesce(kind = 'click', false) AND NOT coalesce(kind IN ('error', 'signup'), false)")
def filter_not(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filtered(events_with_nulls(spark, sf_dir), "NOT kind = 'click' AND NOT kind IN ('error', 'signup') AND NOT gone > 1").select("event_id", "kind")


@query("""WITH e AS (SELECT event_id, CASE WHEN event_id % 10 = 0 THEN 'n/a' WHEN event_id % 10 = 1 THEN NULL WHEN event_id % 10 = 2 THEN regexp_extract(props, '(\\d+)', 1) || '.50' ELSE regexp_extract(props, '(\\d+)', 1) END AS k FROM events)
SELECT event_id, k FROM e WHERE CASE WHEN try_cast(k AS DECIMAL(38,18)) IS NOT NULL THEN try_cast(k AS DECIMAL(38,18)) >= 40 ELSE coalesce(k >= '40', false) END""")
def filter_numeric_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    digits, i = F.regexp_extract("props", r"(\d+)", 1), F.col("event_id") % 10
    k = F.when(i == 0, "n/a").when(i == 1, F.lit(None)).when(i == 2, F.concat(digits, F.lit(".50"))).otherwise(digits)
    return filtered(table(spark, sf_dir, "events").select("event_id", k.alias("k")), "k >= 40.0")


# --- the op rewrite ----------------------------------------------------------------------------

STATUS_FILTER = "o_orderstatus <> 'P' AND o_orderkey < 10000000"


def rewritten(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewrite_ops(orders_log(spark, sf_dir), parse_filter(STATUS_FILTER))


LOG_SQL = O + """, log AS (
  SELECT 'r' AS op, NULL AS bk, NULL AS bst, k AS ak, st AS ast, 0 AS seq, k FROM o
  UNION ALL SELECT 'u', k, st, k, ns, 1, k FROM o WHERE k % 5 = 0
  UNION ALL SELECT 'u', k, ns, nk, ns, 2, k FROM o WHERE k % 7 = 0
  UNION ALL SELECT 'd', nk, ns, NULL, NULL, 3, k FROM o WHERE k % 11 = 0
  UNION ALL SELECT 'c', NULL, NULL, k, 'N', 4, k FROM o WHERE k % 55 = 0),
hit AS (SELECT *, coalesce(bst <> 'P' AND bk < 10000000, false) AS b, coalesce(ast <> 'P' AND ak < 10000000, false) AS a FROM log),
out_ AS (SELECT CASE WHEN op IN ('r', 'c') THEN CASE WHEN a THEN op END WHEN op = 'd' THEN CASE WHEN b THEN op END
                     WHEN a AND b THEN 'u' WHEN b THEN 'd' WHEN a THEN 'c' END AS op, op AS was, bk, bst, ak, ast, seq FROM hit)
"""


@query(LOG_SQL + "SELECT op, CASE WHEN op IN ('u', 'd') THEN bk END AS before_key, CASE WHEN op <> 'd' THEN ak END AS after_key, CASE WHEN op <> 'd' THEN ast END AS after_status, CAST(seq AS BIGINT) AS seq FROM out_ WHERE op IS NOT NULL")
def op_rewrite(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, sf_dir).select("op", F.col("before.o_orderkey").alias("before_key"), F.col("after.o_orderkey").alias("after_key"), F.col("after.o_orderstatus").alias("after_status"), "seq")


@query(LOG_SQL + "SELECT bk AS o_orderkey, 'd' AS op FROM out_ WHERE op = 'd' AND was = 'u'")
def fall_out_delete(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, sf_dir).where("op = 'd' and seq <= 2").select("before.o_orderkey", "op")


@query(LOG_SQL + "SELECT ak AS o_orderkey, 'c' AS op, ast AS o_orderstatus FROM out_ WHERE op = 'c' AND was = 'u'")
def fall_in_create(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rewritten(spark, sf_dir).where("op = 'c' and seq <= 2").select("after.o_orderkey", "op", "after.o_orderstatus")


@query(O + "SELECT st AS \"Status\", k AS o_orderkey, 'r' AS op FROM o UNION ALL SELECT ns, k, 'u' FROM o WHERE k % 5 = 0 UNION ALL SELECT ns, nk, 'u' FROM o WHERE k % 7 = 0 UNION ALL SELECT 'N', k, 'c' FROM o WHERE k % 55 = 0")
def projection_images(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    renamed = log.withColumns({x: F.when(F.col(x).isNotNull(), F.struct(F.col(f"{x}.o_orderstatus").alias("status"), F.col(f"{x}.o_orderkey").alias("o_orderkey"))) for x in ("before", "after")})
    return project(renamed, ("Status", "O_ORDERKEY")).where("op != 'd'").select("after.Status", F.col("after.O_ORDERKEY").alias("o_orderkey"), "op")


# --- current state --------------------------------------------------------------------------------

STATE_SQL = O + """, s AS (SELECT nk AS o_orderkey, c AS o_custkey, ns AS o_orderstatus, d AS o_orderdate FROM o WHERE k % 11 <> 0
  UNION ALL SELECT k, c, 'N', d FROM o WHERE k % 55 = 0)
"""


@query(STATE_SQL + "SELECT o_orderkey, o_custkey, o_orderstatus FROM s WHERE o_orderstatus <> 'P'")
def current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flagship: filter, projection and current state of the whole log."""
    rule = compile_rule(r"shop\.orders", "o_orderkey, o_custkey, o_orderstatus", "o_orderstatus <> 'P'")
    return apply.current_state(apply_rule(orders_log(spark, sf_dir), rule), KEY)


@query(STATE_SQL + "SELECT * FROM s")
def merge_into_base(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return apply.merge_state(rows, orders_changes(rows), KEY)


@query(O + "SELECT k AS old_key, nk AS new_key, ns AS o_orderstatus FROM o WHERE k % 7 = 0")
def key_change(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir).where("op = 'u' and seq = 2")
    both = apply.split_key_changes(log, KEY)
    old, new = both.where("deleted").select(F.col("row.o_orderkey").alias("old_key")), both.where("not deleted").select(F.col("row.o_orderkey").alias("new_key"), "row.o_orderstatus")
    return new.join(old, F.col("new_key") == F.col("old_key") + MOVED).select("old_key", "new_key", "o_orderstatus")


#: Rows of a table that one task groups and makes events of.
TASK_ROWS = 500_000


def tasks_of(rows: DataFrame, task_rows: int = TASK_ROWS) -> int:
    """Tasks of about ``task_rows`` rows each, however many rows there are and whatever ``spark.sql.shuffle.partitions`` says."""
    return max(rows.sparkSession.sparkContext.defaultParallelism, math.ceil(rows.count() / task_rows))


def lineitem_log(rows: DataFrame) -> DataFrame:
    """Snapshot, updates and deletes by one pass over the rows."""
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    first, second, null = image(rows.columns), image(rows.columns, {"l_quantity": F.col("l_quantity") + 1}), F.lit(None)
    one = lambda op, before, after, seq: F.struct(F.lit(op).alias("op"), before.cast(kind).alias("before"), after.cast(kind).alias("after"), F.lit(seq).alias("seq"))
    events = F.array(one("r", null, first, 0), F.when(F.col("l_orderkey") % 3 == 0, one("u", first, second, 1)), F.when(F.col("l_orderkey") % 4 == 0, one("d", first, null, 2)))
    flat = rows.select(F.explode(F.filter(events, lambda e: e.isNotNull())).alias("e")).select("e.*")
    return changes(flat, F.col("op"), F.col("before"), F.col("after"), F.col("seq"), "shop", "lineitem", kind)


@query("""WITH l AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, max(l_quantity) AS q FROM lineitem GROUP BY ALL)
SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, CASE WHEN l_orderkey % 3 = 0 THEN q + 1 ELSE q END AS l_quantity FROM l WHERE l_orderkey % 4 <> 0""")
def composite_key_apply(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = ("l_orderkey", "l_partkey", "l_suppkey", "l_linenumber")
    rows = table(spark, sf_dir, "lineitem").select(*keys, "l_quantity")
    tasks = tasks_of(rows)
    rows = rows.repartition(tasks, *keys).groupBy(*keys).agg(F.max("l_quantity").alias("l_quantity"))
    return apply.current_state(lineitem_log(rows), keys, tasks)  # a key has three events at most


def events_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", "event_type", "ts")
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in rows.schema])
    ms = (F.col("ts").cast("timestamp").cast("double") * 1000).cast("long")
    return changes(rows, F.lit("c"), None, image(rows.columns), F.col("event_id"), "web", "events", kind, ms)


@query("SELECT user_id, max(event_id) AS event_id, arg_max(event_type, event_id) AS event_type FROM events GROUP BY user_id")
def latest_per_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    return apply.current_state(events_log(spark, sf_dir), ("user_id",)).select("user_id", "event_id", "event_type")


@query("""WITH e AS (SELECT event_id // 1000 AS batch, user_id, event_id, event_type, row_number() OVER (PARTITION BY event_id // 1000, user_id ORDER BY event_id DESC) AS place, min(event_id) OVER (PARTITION BY event_id // 1000, user_id) AS first_seq FROM events)
SELECT batch, user_id, event_id, event_type, first_seq FROM e WHERE place = 1""")
def coalesce_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = apply.coalesce_batches(events_log(spark, sf_dir), ("user_id",), F.floor(F.col("seq") / 1000))
    return out.select("batch", "after.user_id", "after.event_id", "after.event_type", "first_seq")


@query("SELECT event_type, CAST(2 * count(*) AS BIGINT) AS n FROM events GROUP BY event_type")
def keyless_append(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    return apply.current_state(log.unionByName(log), ()).groupBy("event_type").agg(F.count("*").alias("n"))


@query(O + "SELECT k AS o_orderkey, 'delete is not supported' AS reason FROM o WHERE k % 11 = 0 UNION ALL SELECT k, 'key changed' FROM o WHERE k % 7 = 0")
def load_violations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that an append-or-replace target refuses, by the key of the snapshot row."""
    log = orders_log(spark, sf_dir)
    bad = apply.doris_violations(log, KEY, tuple(image_type(log).fieldNames()))
    key = F.col("before.o_orderkey")
    return bad.select(F.when((F.col("op") == "d") & (key >= MOVED), key - MOVED).otherwise(key).alias("o_orderkey"), "reason")


# --- routes -----------------------------------------------------------------------------------------

ROUTES = [
    Route(compile_pattern("route", r"web\.(click|view)"), "lake.activity"),
    Route(compile_pattern("route", r"web\..*"), "lake.ods_<>_copy", "<>"),
    Route(compile_pattern("route", r"web\.error"), "lake.error"),
]


def typed_events(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[tuple[str, str]]]:
    """Each event type as a table of its own."""
    rows = table(spark, sf_dir, "events").select("event_id", F.lit("web").alias("source_db"), F.when(F.col("event_type") == "signup", "x.signup").otherwise(F.col("event_type")).alias("source_table"))
    return rows, [("web", t) for t in ("click", "view", "error", "purchase", "x.signup")]


TYPED_SQL = "WITH e AS (SELECT event_id, CASE WHEN event_type = 'signup' THEN 'x.signup' ELSE event_type END AS t FROM events) "


@query(TYPED_SQL + """SELECT event_id, 'lake' AS sink_db, 'activity' AS sink_table, true AS routed FROM e WHERE t IN ('click', 'view')
UNION ALL SELECT event_id, 'lake', 'ods_' || t || '_copy', true FROM e UNION ALL SELECT event_id, 'lake', 'error', true FROM e WHERE t = 'error'""")
def route_all_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tables = typed_events(spark, sf_dir)
    return route_mixed(rows, ROUTES, tables).select("event_id", "sink_db", "sink_table", "routed")


@query(TYPED_SQL + "SELECT event_id, 'lake' AS sink_db, CASE WHEN t IN ('click', 'view') THEN 'activity' ELSE 'ods_' || t || '_copy' END AS sink_table, true AS routed FROM e")
def route_first_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tables = typed_events(spark, sf_dir)
    return route_mixed(rows, ROUTES, tables, first_only=True).select("event_id", "sink_db", "sink_table", "routed")


@query(TYPED_SQL + "SELECT event_id, CASE WHEN t = 'error' THEN 'lake' ELSE 'web' END AS sink_db, t AS sink_table, t = 'error' AS routed FROM e")
def route_no_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, tables = typed_events(spark, sf_dir)
    return route_mixed(rows, ROUTES[2:], tables).select("event_id", "sink_db", "sink_table", "routed")


@query("SELECT o_orderkey, 'dw' AS sink_db, 'orders_v_orders' AS sink_table, true AS routed FROM orders")
def route_replace_symbol(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = [Route(compile_pattern("route", r"shop\.orders"), "dw.<>_v_<>", "<>")]
    log = snapshot(orders(spark, sf_dir), "shop", "orders")
    return route_table(log, routes, "shop", "orders").select("after.o_orderkey", "sink_db", "sink_table", "routed")


# --- encoders ----------------------------------------------------------------------------------------


@query(O + """SELECT 'dw.orders' AS topic, '["' || st || '",' || k || ']' AS key, CAST(0 AS BIGINT) AS seq FROM o
UNION ALL SELECT 'dw.orders', '["' || ns || '",' || k || ']', 1 FROM o WHERE k % 5 = 0 UNION ALL SELECT 'dw.orders', '["' || ns || '",' || nk || ']', 2 FROM o WHERE k % 7 = 0
UNION ALL SELECT 'dw.orders', '["' || ns || '",' || nk || ']', 3 FROM o WHERE k % 11 = 0 UNION ALL SELECT 'dw.orders', '["N",' || k || ']', 4 FROM o WHERE k % 55 = 0""")
def topic_and_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = route_table(orders_log(spark, sf_dir), [Route(compile_pattern("route", r"shop\.orders"), "dw.orders")], "shop", "orders")
    return log.select(encode.topic("default").alias("topic"), encode.message_key(log, ("o_orderstatus", "o_orderkey")).alias("key"), "seq")


@query("SELECT o_orderkey, 'everything' AS topic FROM orders")
def topic_identity_route(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = route_table(snapshot(orders(spark, sf_dir), "shop", "orders"), [Route(compile_pattern("route", r"shop\.orders"), "shop.orders")], "shop", "orders")
    return log.select("after.o_orderkey", encode.topic("everything").alias("topic"))


@query(LOG_SQL + """SELECT was AS op, CASE WHEN was IN ('u', 'd') THEN bk END AS before_key, CASE WHEN was <> 'd' THEN ast END AS after_status, CAST(1700000009000 AS BIGINT) AS ts_ms,
CASE WHEN was <> 'r' THEN CAST(1700000000000 + seq * 1000 AS BIGINT) END AS source_ts_ms, 'shop' AS db, 'orders' AS tbl, '["after","before","op","source","ts_ms"]' AS fields FROM out_""")
def envelope_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Envelopes, parsed again."""
    log = orders_log(spark, sf_dir)
    kind = image_type(log)
    source = "struct<ts_ms:bigint,db:string,table:string>"
    parsed = encode.envelope(log, 1_700_000_009_000).select(F.from_json("value", f"before {kind.simpleString()}, after {kind.simpleString()}, source {source}, op string, ts_ms bigint").alias("e"), F.array_sort(F.json_object_keys("value")).alias("fields"))
    return parsed.select("e.op", F.col("e.before.o_orderkey").alias("before_key"), F.col("e.after.o_orderstatus").alias("after_status"), "e.ts_ms", F.col("e.source.ts_ms").alias("source_ts_ms"), "e.source.db", F.col("e.source.table").alias("tbl"), F.to_json("fields").alias("fields"))


def _framed(text: str) -> str:
    return f"unhex(lpad(printf('%x', strlen({text})), 8, '0')) || encode({text})"


ID_SQL = " || ".join(_framed(x) for x in ("'chat.turns'", "'conv_id'", "CAST(conv_id AS VARCHAR)", "'turn'", "CAST(turn AS VARCHAR)"))


@query(f"SELECT conv_id, turn, sha256({ID_SQL}) AS id, 'chat.turns' AS index FROM conversations")
def es_doc_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations")
    own = describe("chat", "turns", rows.schema, ("conv_id", "turn"))
    log = snapshot(rows, "chat", "turns")
    return log.select("after.conv_id", "after.turn", encode.document_id(own, "after", image_type(log)).alias("id"), F.lit("chat.turns").alias("index"))


@query(STATE_SQL + """, w AS (SELECT o_orderkey, 'index' AS action, o_orderstatus FROM s), g AS (
  SELECT k AS o_orderkey FROM o WHERE k % 7 = 0 AND k % 55 <> 0 UNION SELECT nk FROM o WHERE k % 11 = 0 AND (k % 7 = 0 OR k % 55 <> 0))
SELECT sha256(unhex('0000000b') || encode('shop.orders') || unhex('0000000a') || encode('o_orderkey') || unhex('0000000' || strlen(CAST(o_orderkey AS VARCHAR))) || encode(CAST(o_orderkey AS VARCHAR))) AS id, action, o_orderstatus FROM (SELECT * FROM w UNION ALL SELECT o_orderkey, 'delete', NULL FROM g)""")
def es_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = orders_log(spark, sf_dir)
    own = describe("shop", "orders", orders(spark, sf_dir).schema, KEY)
    last = encode.last_operations(encode.elastic_operations(log, own, "shop.orders"))
    return last.select("id", "action", F.get_json_object("document", "$.o_orderstatus").alias("o_orderstatus"))


@query("SELECT o_orderkey, '{\"o_orderkey\":' || o_orderkey || ',\"o_orderstatus\":\"' || o_orderstatus || '\"}' AS line FROM orders")
def json_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    log = snapshot(rows, "shop", "orders").withColumn("seq", F.col("after.o_orderkey"))
    return encode.json_lines(log, ("o_orderkey", "o_orderstatus")).select(F.col("seq").alias("o_orderkey"), F.col("value").alias("line"))


@query(LOG_SQL + """SELECT 'DELETE FROM "dw"."orders" WHERE "o_orderkey" = $1' AS sql, CAST(bk AS VARCHAR) AS args FROM log WHERE op = 'd' OR (op = 'u' AND bk <> ak)
UNION ALL SELECT 'INSERT INTO "dw"."orders" ("o_orderkey", "o_orderstatus") VALUES ($1, $2) ON CONFLICT ("o_orderkey") DO UPDATE SET "o_orderstatus" = EXCLUDED."o_orderstatus"', ak || ',' || ast FROM log WHERE op <> 'd'""")
def sql_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = project(orders_log(spark, sf_dir), ("o_orderkey", "o_orderstatus"))
    return encode.sql_statements(log, "postgresql", "dw", "orders", KEY).select("sql", F.array_join("args", ",").alias("args"))


@query(STATE_SQL + """, gone AS (SELECT k AS o_orderkey FROM o WHERE k % 7 = 0 AND k % 55 <> 0 UNION SELECT nk FROM o WHERE k % 11 = 0 AND (k % 7 = 0 OR k % 55 <> 0))
SELECT 'INSERT' AS verb, o_orderkey || ',' || o_orderstatus AS args FROM s UNION ALL SELECT 'DELETE', CAST(o_orderkey AS VARCHAR) FROM gone""")
def reduced_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a SQL sink is sent for the whole log as one batch: one statement a key."""
    log = project(orders_log(spark, sf_dir), ("o_orderkey", "o_orderstatus"))
    last = encode.write_statements(apply.last_writes(apply.split_key_changes(log, KEY), KEY), "mysql", "dw", "orders", KEY)
    return last.select(F.substring_index("sql", " ", 1).alias("verb"), F.array_join("args", ",").alias("args"))


# --- canonical scalars ----------------------------------------------------------------------------------


@query("SELECT p_partkey, CASE WHEN p_partkey % 9 = 0 THEN '0.00' ELSE (CASE WHEN p_partkey % 2 = 0 THEN '-' ELSE '' END) || (p_partkey // 10) || '.' || (p_partkey % 10) || '0' END AS amount FROM part")
def canonical_decimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    text = F.concat(F.when(k % 2 == 0, "-").otherwise("+"), F.lit("00"), F.floor(k / 10).cast("string"), F.lit("."), (k % 10).cast("string"), F.lit("000"))
    return table(spark, sf_dir, "part").select(k, canonical.decimal(F.when(k % 9 == 0, "-0.0").otherwise(text), 2).alias("amount"))


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS day, strftime(o_orderdate, '%Y-%m-%d %H:%M:%S') || '.120000' AS moment, strftime(o_orderdate - INTERVAL 8 HOUR, '%Y-%m-%d %H:%M:%S.%f') AS utc, strftime(o_orderdate, '%Y') AS year FROM orders")
def canonical_date(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = F.col("o_orderdate")
    return table(spark, sf_dir, "orders").select(
        "o_orderkey", canonical.date(F.date_format(d, "yyyy-MM-dd")).alias("day"), canonical.datetime(F.date_format(d, "yyyy-MM-dd'T'HH:mm:ss.'12'")).alias("moment"),
        canonical.timestamp_utc(F.date_format(d, "yyyy-MM-dd HH:mm:ss"), "+08:00").alias("utc"), canonical.year(F.year(d)).alias("year"),
    )


@query("""SELECT event_id, CASE WHEN event_id % 2 = 0 AND ((event_id % 839 + event_id % 60 + event_id % 59) > 0 OR event_id % 3 = 0) THEN '-' ELSE '' END || (event_id % 839) || ':' || lpad(CAST(event_id % 60 AS VARCHAR), 2, '0') || ':' || lpad(CAST(event_id % 59 AS VARCHAR), 2, '0') || '.' || CASE WHEN event_id % 3 = 0 THEN '500000' ELSE '000000' END AS t
FROM events""")
def canonical_time(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("event_id")
    part = lambda n, width: F.lpad((e % n).cast("string"), width, "0")
    text = F.concat(F.when(e % 2 == 0, "-").otherwise(""), part(839, 3), F.lit(":"), part(60, 2), F.lit(":"), part(59, 2), F.when(e % 3 == 0, ".5").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", canonical.time(text).alias("t"))


@query("""SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN '' WHEN 1 THEN 'red' WHEN 2 THEN 'green' ELSE 'blue' END AS color,
array_to_string(list_filter([CASE WHEN p_partkey % 2 = 1 THEN 'x' END, CASE WHEN (p_partkey // 2) % 2 = 1 THEN 'y' END, CASE WHEN (p_partkey // 4) % 2 = 1 THEN 'z' END], lambda v: v IS NOT NULL), ',') AS marks FROM part""")
def canonical_enum_set(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, sf_dir, "part").select(k, canonical.enum(k % 4, ("red", "green", "blue"), True).alias("color"), canonical.set_(k % 8, ("x", "y", "z"), True).alias("marks"))


# --- sources ------------------------------------------------------------------------------------------------

SPLIT_SQL = """WITH k AS (SELECT o_orderkey AS low, row_number() OVER (ORDER BY o_orderkey) - 1 AS place FROM orders), l AS (SELECT place // {step} AS split_id, low FROM k WHERE place % {step} = 0)
SELECT split_id, low, lead(low) OVER (ORDER BY low) AS high FROM l"""


@query(SPLIT_SQL.format(step=8095))
def split_plan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_splits(table(spark, sf_dir, "orders"), "o_orderkey", 8096)


@query(SPLIT_SQL.format(step=999))
def split_plan_small(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan_splits(table(spark, sf_dir, "orders"), "o_orderkey", 1000)


@query("SELECT o_orderkey, o_custkey FROM orders")
def split_read(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every split, the first and the last without an outer bound: each row once."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    parts = [rows.where(split_predicate("o_orderkey", low, high)) for low, high in ((None, 100), (100, 1000), (1000, None))]
    return parts[0].union(parts[1]).union(parts[2])


@query("SELECT event_id FROM events WHERE epoch_ms(ts) >= (SELECT epoch_ms(min(ts)) + (epoch_ms(max(ts)) - epoch_ms(min(ts))) // 2 FROM events) // 1000 * 1000")
def startup_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    log = events_log(spark, sf_dir)
    low, high = table(spark, sf_dir, "events").agg(F.min("ts").cast("timestamp").cast("double"), F.max("ts").cast("timestamp").cast("double")).first()
    low, high = int(low * 1000), int(high * 1000)
    return from_start(log, Startup("timestamp", timestamp_ms=low + (high - low) // 2)).select("after.event_id")


@query("SELECT event_id FROM (SELECT event_id, row_number() OVER (ORDER BY event_id) AS place FROM events WHERE event_id >= 50) WHERE place > 25")
def skip_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return from_start(events_log(spark, sf_dir), Startup("specific-offset", seq=50, skip_rows=25)).select("after.event_id")


@query("SELECT event_id, event_type FROM events WHERE event_type IN ('click', 'error')")
def captured_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = typed_events(spark, sf_dir)
    return captured_only(rows, [("web", "click"), ("web", "error"), ("other", "view")]).select("event_id", F.col("source_table").alias("event_type"))


@query(O + """, old AS (SELECT 'old' AS tbl, k AS o_orderkey, CASE WHEN k % 5 = 0 THEN ns ELSE st END AS o_orderstatus FROM o WHERE k % 2 = 0 AND k % 11 <> 0),
new AS (SELECT 'new', k, CASE WHEN k % 5 = 0 THEN ns ELSE st END FROM o WHERE k % 2 = 1 AND k % 11 <> 0) SELECT * FROM old UNION ALL SELECT * FROM new""")
def new_table_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two tables: one captured before, one that matches later and is snapshot under its changes."""
    plan = on_resume({"shop.old", "shop.new"}, {"shop.old"}, set(), NewTables(enabled=True))
    rows = orders(spark, sf_dir)
    log = orders_changes(rows).where("seq in (1, 3)")
    undo = lambda s: F.struct(F.when(F.col(f"{s}.o_orderkey") >= MOVED, F.col(f"{s}.o_orderkey") - MOVED).otherwise(F.col(f"{s}.o_orderkey")).alias("o_orderkey"), *(F.col(f"{s}.{c}") for c in rows.columns[1:]))
    log = log.withColumn("before", F.when(F.col("before").isNotNull(), undo("before")))
    out = []
    for name, odd in (("old", 0), ("new", 1)):
        own = rows.where(F.col("o_orderkey") % 2 == odd)
        changed = log.where(F.coalesce("before.o_orderkey", "after.o_orderkey") % 2 == odd)
        if plan[f"shop.{name}"] == "live":
            state = apply.merge_state(own, changed, KEY)
        else:
            state = apply.current_state(backfill(snapshot(own, "shop", name), changed), KEY)
        out.append(state.select(F.lit(name).alias("tbl"), "o_orderkey", "o_orderstatus"))
    return out[0].union(out[1])


@query("""SELECT count(*) AS n_rows, CAST(sum(CAST(o_orderkey AS HUGEINT)) AS VARCHAR) AS sum_key, CAST(sum(CAST(('0x' || substr(md5(o_orderstatus), 1, 8)) AS BIGINT)) AS VARCHAR) AS sum_hash FROM orders""")
def verify_checksum(spark: SparkSession, sf_dir: str) -> DataFrame:
    return verify.checksum(table(spark, sf_dir, "orders"), "o_orderkey", "o_orderstatus")


@query(O + """SELECT k AS o_orderkey, 'left_only' AS side FROM o WHERE (k % 7 = 0 OR k % 11 = 0) AND k % 55 <> 0
UNION ALL SELECT k, 'changed' FROM o WHERE k % 55 = 0 OR (k % 5 = 0 AND k % 7 <> 0 AND k % 11 <> 0) UNION ALL SELECT nk, 'right_only' FROM o WHERE k % 7 = 0 AND k % 11 <> 0""")
def verify_differences(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    return verify.differences(rows, apply.merge_state(rows, orders_changes(rows), KEY), KEY)


# --- whole runs -------------------------------------------------------------------------------------------


class FrameSource:
    """Tables and their changes as DataFrames; a run sees what ``changed`` gives at that time."""

    by_split = False

    def __init__(self, frames: dict[tuple[str, str], tuple[DataFrame, DataFrame]], keys: tuple[str, ...]):
        self.frames, self.keys = frames, keys

    def tables(self) -> list[tuple[str, str]]:
        return list(self.frames)

    def describe(self, database: str, name: str) -> Table:
        return describe(database, name, self.frames[database, name][0].schema, self.keys)

    def read(self, database: str, name: str, key: str | None = None, splits: list | None = None) -> DataFrame:
        return self.frames[database, name][0]

    def changes(self, database: str, name: str) -> DataFrame:
        return self.frames[database, name][1]

    def position(self) -> int:
        return 0

    def end(self, changed: DataFrame) -> int | None:
        return changed.agg(F.max("seq")).first()[0]


def runs(spark: SparkSession, mode: str, routes: list[dict], *sources: FrameSource) -> DataFrame:
    """The only sink table after a run over each source in turn, each going on where the one before ended."""
    from .plans.config import load_pipeline
    from .plans.job import run_batch
    from .streaming.tables import VersionedTable

    folder = scratch(spark)
    login = {"hostname": "h", "username": "u", "password": "p"}
    pipeline = load_pipeline({"source": login | {"tables": r"shop\..*", "scan.startup.mode": mode}, "sink": login | {"type": "mysql"}, "route": routes, "pipeline": {"name": "p"}, "checkpoint": {"file-path": f"{folder}/state"}})
    for source in sources:
        (sink,) = run_batch(spark, pipeline, source, f"{folder}/out")
    return VersionedTable(spark, f"{folder}/out/{sink}", KEY).read()


def log_of(rows: DataFrame, changed: DataFrame, name: str = "orders") -> FrameSource:
    return FrameSource({("shop", name): (rows, changed)}, KEY)


@query(STATE_SQL + "SELECT * FROM s")
def resume_from_acked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Snapshot and changes 1 and 2; then a second run, which reads only what came after."""
    rows = orders(spark, sf_dir)
    changed = orders_changes(rows)
    return runs(spark, "initial", [], log_of(rows, changed.where("seq <= 2")), log_of(rows.limit(0), changed.where("seq > 2").unionByName(changed.where("seq = 1"))))


@query(O + "SELECT k AS o_orderkey, c AS o_custkey, 'N' AS o_orderstatus, d AS o_orderdate FROM o WHERE k % 55 = 0")
def startup_latest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begun behind change 2: only what comes later is there."""
    rows = orders(spark, sf_dir)
    changed = orders_changes(rows)
    return runs(spark, "latest", [], log_of(rows, changed.where("seq <= 2")), log_of(rows, changed))


@query(STATE_SQL + "SELECT * FROM s")
def fan_in_current_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two source tables routed into one sink table."""
    rows = orders(spark, sf_dir)
    frames = {}
    for name, odd in (("even", 0), ("odd", 1)):
        own = rows.where(F.col("o_orderkey") % 2 == odd)
        frames["shop", name] = (own, orders_changes(own).withColumn("source_table", F.lit(name)))
    return runs(spark, "initial", [{"source-table": r"shop\..*", "sink-table": "dw.all"}], FrameSource(frames, KEY))


@query("SELECT event_id FROM events WHERE event_id % 10 = 0 OR event_id % 7 = 1")
def null_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events that no target could find again: creates and deletes by a null key."""
    log = events_log(spark, sf_dir)
    e = F.col("after.event_id")
    hidden = F.struct(F.when((e % 10 != 0) & (e % 7 != 1), F.col("after.user_id")).alias("user_id"), *(F.col(f"after.{c}") for c in ("event_id", "event_type", "ts")))
    log = log.withColumn("after", hidden).withColumns({"op": F.when(e % 7 == 1, "d").otherwise("c"), "before": F.when(e % 7 == 1, F.col("after"))})
    return apply.null_keys(log, ("user_id",)).select(F.coalesce("after.event_id", "before.event_id").alias("event_id"))


@query("SELECT true AS rejected")
def merge_null_key_rejected(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = orders(spark, sf_dir)
    log = orders_changes(rows).withColumn("after", F.when(F.col("seq") == 4, F.struct(F.lit(None).cast("bigint").alias("o_orderkey"), *(F.col(f"after.{c}") for c in rows.columns[1:]))).otherwise(F.col("after")))
    try:
        apply.merge_state(rows, log, KEY).write.format("noop").mode("overwrite").save()
    except Exception as e:
        return spark.createDataFrame([("a key is null" in str(e),)], "rejected boolean")
    return spark.createDataFrame([(False,)], "rejected boolean")


@query("SELECT p_partkey, CAST(p_partkey AS VARCHAR) AS whole, CAST(p_size AS VARCHAR) AS positive, CASE WHEN p_partkey % 3 = 0 THEN NULL ELSE to_base64(encode(p_name)) END AS bytes, '{\"a\":[' || p_size || ',\"' || p_brand || '\"]}' AS js FROM part")
def canonical_more(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, size = F.col("p_partkey"), F.col("p_size")
    return table(spark, sf_dir, "part").select(
        k, canonical.integer(F.concat(F.lit(" "), k.cast("string"))).alias("whole"), canonical.unsigned(size.cast("string")).alias("positive"), canonical.binary(F.when(k % 3 != 0, F.col("p_name").cast("binary"))).alias("bytes"),
        canonical.json(F.concat(F.lit('{ "a" : [ '), size.cast("string"), F.lit(' , "'), F.col("p_brand"), F.lit('" ] }'))).alias("js"),
    )


# --- schema evolution and streams ----------------------------------------------------------------------------


@query(O + "SELECT k AS o_orderkey, st AS status, CASE WHEN k % 3 = 0 THEN 'late' ELSE 'none' END AS note FROM o")
def evolve_add_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A rename, then a column that only later rows bring."""
    rows = orders(spark, sf_dir).select("o_orderkey", "o_orderstatus")
    own = Table("shop", "orders", (Column("o_orderkey", "bigint", False), Column("o_orderstatus", "varchar(1)")), KEY)
    first = ddl.classify("ALTER TABLE shop.orders RENAME COLUMN o_orderstatus TO status")
    renamed = plan_change(own, first).table
    second = ddl.classify("ALTER TABLE shop.orders ADD COLUMN note varchar(8) DEFAULT 'none'")
    grown = plan_change(renamed, second, {"note": Column("note", "varchar(8)", True, default="none")}).table
    state = evolve_state(evolve_state(rows, first, renamed), second, grown)
    late = state.where("o_orderkey % 3 = 0")
    kind = T.StructType([T.StructField(f.name, f.dataType) for f in state.schema])
    log = changes(late, F.lit("u"), image(late.columns), image(late.columns, {"note": F.lit("late")}), F.lit(1), "shop", "orders", kind)
    return apply.merge_state(state, log, KEY)


def scratch(spark: SparkSession) -> str:
    """A new folder that all executors see: under the cluster's checkpoint folder, or local in a local session."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base and not re.fullmatch(r"local(\[.*\])?", spark.sparkContext.master):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    return f"{(base or tempfile.mkdtemp(prefix='tidelog-')).rstrip('/')}/stream-{uuid.uuid4().hex}"


@query(STATE_SQL + "SELECT o_orderkey, o_custkey, o_orderstatus FROM s")
def stream_equals_batch(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The log as JSON files through a stream in several micro-batches, stopped and started again."""
    from .streaming.runner import TableApplier, change_stream, start

    folder = scratch(spark)
    log = orders_log(spark, sf_dir)
    kind = image_type(log)
    lines = log.select("seq", F.to_json(F.struct("op", "before", "after", "seq", F.struct(F.col("source_db").alias("db"), F.col("source_table").alias("table"), F.col("source_ts_ms").alias("ts_ms")).alias("source")), {"ignoreNullFields": "false"}).alias("value"))
    applier = TableApplier(spark, f"{folder}/state", KEY, compile_rule(r"shop\.orders", "o_orderkey, o_custkey, o_orderstatus"))
    for low, high in ((0, 1), (2, 4)):
        lines.where(F.col("seq").between(low, high)).select("value").write.mode("append").text(f"{folder}/log")
        start(change_stream(spark, f"{folder}/log", kind, files_per_batch=1_000), applier, f"{folder}/checkpoint").awaitTermination()
    return applier.state.read()


QUERIES |= catalog_rules.QUERIES
ORACLE_SQL |= catalog_rules.ORACLE_SQL
