"""The query catalogue over the star-schema tables, with SQL counterparts.

Every query is an operator of this package applied to a table that stands in for its own input;
QUERIES and SQL hold both sides under one name.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from somalog.functions import scalars as fn
from somalog.operators import asof, consensus, edits, indicators, layout, merge, parse_merge, raster, reports, sessions, solve, view
from somalog.sources import health_export, store

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
SQL: dict[str, str] = {}
TWELVE_HOURS = 12 * asof.HOUR


def query(sql: str | None = None):
    """Registers a function under its name, and its SQL."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _ms(ts: str) -> Column:
    """Milliseconds of a time without zone, as UTC (in a session whose zone does not change its clocks)."""
    return F.expr(f"timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {ts}) div 1000")


_SESSIONS = """
s AS (
    SELECT event_id AS session_id, user_id, (epoch_us(ts) // 1000) AS start_ms, (epoch_us(ts) // 1000) + 43200000 AS end_ms FROM events WHERE event_type = 'signup'),
n AS (SELECT *, lead(start_ms) OVER ({} ORDER BY start_ms, session_id) AS next_ms FROM s),
m AS (
    SELECT n.session_id, n.user_id, e.event_id, (epoch_us(e.ts) // 1000) AS at_ms, e.value, e.user_id AS sample_user
    FROM n JOIN events e ON e.event_type <> 'signup' {} AND (epoch_us(e.ts) // 1000) >= n.start_ms
        AND (epoch_us(e.ts) // 1000) <= n.end_ms + 1000 AND (n.next_ms IS NULL OR (epoch_us(e.ts) // 1000) < n.next_ms))"""
_KEYED = _SESSIONS.format("PARTITION BY user_id", "AND e.user_id = n.user_id")
_UNKEYED = _SESSIONS.format("", "")
_AVG = "CAST(sum(CAST(value AS DECIMAL(20,6))) AS DOUBLE) / count(*)"
_R1 = "floor({0} * 10 + 0.5) / CAST(10 AS DOUBLE)"


def _session_rows(events: DataFrame) -> DataFrame:
    return events.where("event_type = 'signup'").select(F.col("event_id").alias("session_id"), "user_id", _ms("ts").alias("start_ms")).withColumn("end_ms", F.col("start_ms") + TWELVE_HOURS)


def _sample_rows(events: DataFrame, user: str = "user_id") -> DataFrame:
    return events.where("event_type <> 'signup'").select("event_id", F.col("user_id").alias(user), _ms("ts").alias("at"), "value")


def _matched(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    return asof.attach(_sample_rows(events), _session_rows(events), ["user_id"], "at", "start_ms", "end_ms", "session_id")


@query(f"""WITH {_KEYED}
SELECT session_id, count(*) AS n, {_R1.format(_AVG)} AS average, {_R1.format("min(value)")} AS least, {_R1.format("max(value)")} AS most
FROM (SELECT DISTINCT session_id, at_ms, value FROM m WHERE value IS NOT NULL) GROUP BY session_id""")
def asof_session_enrich(spark: SparkSession, sf_dir: str) -> DataFrame:
    matched = _matched(spark, sf_dir)
    return sessions.statistics(sessions.distinct_samples(matched, "session_id", "at", None, "value"), "session_id")


@query(f"""WITH {_UNKEYED}
SELECT session_id, count(*) AS n, {_R1.format(_AVG)} AS average, {_R1.format("min(value)")} AS least, {_R1.format("max(value)")} AS most
FROM (SELECT DISTINCT session_id, at_ms, value FROM m WHERE value IS NOT NULL) GROUP BY session_id""")
def asof_global_unkeyed(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    matched = asof.attach(_sample_rows(events, "sample_user"), _session_rows(events), [], "at", "start_ms", "end_ms", "session_id")
    return sessions.statistics(sessions.distinct_samples(matched, "session_id", "at", None, "value"), "session_id")


@query(f"""WITH {_KEYED} SELECT session_id, user_id, next_ms AS next_start FROM n""")
def next_session_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _session_rows(_t(spark, sf_dir, "events"))
    return asof.with_next_start(rows, ["user_id"], "start_ms", "session_id").select("session_id", "user_id", "next_start")


@query(f"""WITH {_KEYED}
SELECT m.session_id, m.event_id, m.user_id, m.at_ms - s.start_ms AS offset_ms FROM m JOIN s USING (session_id)""")
def asof_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _matched(spark, sf_dir).select("session_id", "event_id", "user_id", (F.col("at") - F.col("start_ms")).alias("offset_ms"))


@query(f"""WITH {_KEYED}, a AS (
    SELECT session_id, count(*) AS n, {_R1.format(_AVG)} AS average FROM (SELECT DISTINCT session_id, at_ms, value FROM m WHERE value IS NOT NULL) GROUP BY session_id)
SELECT s.session_id, s.user_id, coalesce(a.n, 0) AS n, a.average FROM s LEFT JOIN a USING (session_id)""")
def session_left_keep(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = _t(spark, sf_dir, "events")
    found = asof_session_enrich(spark, sf_dir).select("session_id", "n", "average")
    return _session_rows(events).join(found, "session_id", "left").select("session_id", "user_id", F.coalesce("n", F.lit(0)).alias("n"), "average")


@query(f"""WITH {_KEYED} SELECT DISTINCT session_id, at_ms, value FROM m WHERE value IS NOT NULL""")
def sample_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    twice = _matched(spark, sf_dir)
    return sessions.distinct_samples(twice.union(twice), "session_id", "at", None, "value").select("session_id", F.col("at").alias("at_ms"), "value")


@query(f"""WITH f AS (SELECT l_orderkey, {_R1.format("sum(DISTINCT l_quantity)")} AS total FROM lineitem GROUP BY l_orderkey)
SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_totalprice ELSE f.total END AS energy
FROM orders LEFT JOIN f ON l_orderkey = o_orderkey""")
def fallback_sum(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A declared value where there is one, else the sum of distinct samples."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_quantity").withColumn("at", F.lit(0))
    totals = sessions.distinct_sum(sessions.distinct_samples(lines, "l_orderkey", "at", None, "l_quantity"), "l_orderkey")
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("o_totalprice")).alias("declared"))
    joined = orders.join(totals, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    return joined.select("o_orderkey", sessions.declared_or(F.col("declared"), F.col("total")).alias("energy"))


@query(f"""WITH {_KEYED}, d AS (SELECT DISTINCT session_id, at_ms, value FROM m WHERE value IS NOT NULL)
SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY at_ms, value) - 1 AS pos, at_ms, value AS bpm FROM d""")
def ordered_samples(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = sessions.distinct_samples(_matched(spark, sf_dir), "session_id", "at", None, "value")
    rows = sessions.ordered(kept.withColumn("end_at", F.lit(None).cast("string")), "session_id").select("session_id", F.posexplode("samples"))
    return rows.select("session_id", F.col("pos").cast("long").alias("pos"), F.col("col.at").alias("at_ms"), "col.bpm")


_HALVES = "SELECT o_orderkey AS seq, {} AS id, o_orderkey % 2 = 1 AS incoming, o_totalprice FROM orders"


@query(f"""WITH r AS ({_HALVES.format("o_custkey")}),
k AS (SELECT *, max(CASE WHEN incoming THEN seq END) OVER (PARTITION BY id) AS last FROM r)
SELECT seq, id, incoming, o_totalprice FROM k WHERE coalesce(last, seq) <= seq""")
def merge_last_wins(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("seq"), F.col("o_custkey").alias("id"), (F.col("o_orderkey") % 2 == 1).alias("incoming"), "o_totalprice")
    return merge.merged(rows, ["id"], "seq", "incoming").select("seq", "id", "incoming", "o_totalprice")


@query("""WITH r AS (
    SELECT doc_id AS seq, doc_id % 700 AS id, doc_id % 3 = 0 AS incoming,
           CASE WHEN lang <> 'de' THEN source || '/' || CAST(n_chars % 50 AS VARCHAR) END AS upload FROM documents),
k AS (SELECT *, max(CASE WHEN incoming THEN seq END) OVER (PARTITION BY id) AS a,
             CASE WHEN upload IS NOT NULL THEN max(CASE WHEN incoming THEN seq END) OVER (PARTITION BY upload) END AS b FROM r)
SELECT seq, id, incoming, upload FROM k WHERE coalesce(a, seq) <= seq AND coalesce(b, seq) <= seq""")
def merge_two_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "documents").select(
        F.col("doc_id").alias("seq"),
        (F.col("doc_id") % 700).alias("id"),
        (F.col("doc_id") % 3 == 0).alias("incoming"),
        F.when(F.col("lang") != "de", F.concat("source", F.lit("/"), (F.col("n_chars") % 50).cast("string"))).alias("upload"),
    )
    return merge.merged(rows, ["id", "upload"], "seq", "incoming").select("seq", "id", "incoming", "upload")


_PERTURBED = "CASE WHEN c_custkey % 7 = 0 THEN c_acctbal + 1 ELSE c_acctbal END"


@query(f"""SELECT count(*) FILTER (WHERE c_custkey % 11 = 0 OR {_PERTURBED} IS DISTINCT FROM c_acctbal) AS n_changed, count(*) AS n_rows FROM customer""")
def changed_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a perturbed copy that are new or differ from what is stored, by canonical JSON; the
    copy writes its fields in another order."""
    stored = _t(spark, sf_dir, "customer")
    copy = stored.withColumn("c_acctbal", F.expr(_PERTURBED)).select("c_custkey", F.to_json(F.struct("c_acctbal", "c_name", "c_custkey")).alias("payload"))
    old = stored.where("c_custkey % 11 <> 0").select("c_custkey", F.to_json(F.struct("c_custkey", "c_name", "c_acctbal")).alias("payload"))
    return merge.changed(old, copy, "c_custkey", "payload").agg(F.count_if("changed").alias("n_changed"), F.count(F.lit(1)).alias("n_rows"))


@query("""SELECT d.doc_id, CASE WHEN l.toxic = 1 THEN l.quality ELSE CAST(d.n_chars % 2 AS INTEGER) END AS reading, coalesce(l.toxic = 1, false) AS reviewed
FROM documents d LEFT JOIN labels l ON d.doc_id = l.doc_id""")
def reviewed_carry_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A stored value that was reviewed is kept; else the new one counts."""

    def shown(value: Column, source: Column) -> Column:
        text = F.concat(F.lit("0: "), (value * 5).cast("string"), F.lit("%"))
        parts = (F.lit("0").alias("level"), (value * 5).cast("int").alias("section_percent"), text.alias("reading"), F.lit(None).cast("double").alias("position"), F.lit(None).cast("double").alias("confidence"), source.alias("source"), F.lit(None).cast("string").alias("locator"))
        return F.create_map(F.lit("bmi"), F.struct(*parts)).alias("indicators")

    logs = _t(spark, sf_dir, "documents").select("doc_id", shown(F.col("n_chars") % 2, F.lit(indicators.GRAPH)))
    stored = _t(spark, sf_dir, "labels").select("doc_id", shown(F.col("quality"), F.when(F.col("toxic") == 1, indicators.MANUAL).otherwise(indicators.GRAPH)))
    kept = indicators.carried_over(logs, stored, "doc_id").select("doc_id", F.col("indicators")["bmi"].alias("i"))
    return kept.select("doc_id", (F.col("i.section_percent") / 5).cast("int").alias("reading"), (F.col("i.source") == indicators.MANUAL).alias("reviewed"))


_PERIOD = "CASE WHEN o_orderkey % 97 = 0 THEN 'unknown' ELSE strftime(o_orderdate, '%Y-%m') END"


def _periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.when(F.col("o_orderkey") % 97 != 0, F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss"))
    return _t(spark, sf_dir, "orders").withColumn("period", fn.period(fn.event_time(F.lit(None).cast("string"), time)))


@query(f"SELECT {_PERIOD} AS period, count(*) AS n, min(o_orderkey) AS first_key, 'data/events/' || {_PERIOD} || '.json' AS path FROM orders GROUP BY 1")
def period_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _periods(spark, sf_dir).groupBy("period").agg(F.count(F.lit(1)).alias("n"), F.min("o_orderkey").alias("first_key"))
    return rows.withColumn("path", F.concat(F.lit("data/events/"), "period", F.lit(".json")))


@query(f"""SELECT period, row_number() OVER (ORDER BY CASE WHEN period = 'unknown' THEN NULL ELSE period END DESC NULLS LAST) AS file_rank FROM (SELECT DISTINCT {_PERIOD} AS period FROM orders)""")
def period_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Month files, newest first and the unknown month last."""
    order = W.orderBy(store.file_rank(F.col("period")))  # a row a month
    return _periods(spark, sf_dir).select("period").distinct().withColumn("file_rank", F.row_number().over(order).cast("long"))


#: SQL for the list's columns over events, by the view's names.
_ITEMS_SQL = """SELECT event_id, user_id, (epoch_us(ts) // 1000) AS date_value, event_type AS type, 'src' || CAST(user_id % 5 AS VARCHAR) AS source,
    CASE WHEN event_id % 7 <> 0 THEN value END AS duration_minutes, CASE WHEN event_id % 5 <> 0 THEN floor(value) END AS active_energy_kcal,
    CASE WHEN event_id % 3 <> 0 THEN value / 2 END AS weight_kg, CASE WHEN event_id % 4 <> 0 THEN floor(value / 10) END AS fat_percent,
    CASE WHEN event_id % 11 <> 0 THEN floor(value / 3) END AS average_bpm, event_type || ' User ' || CAST(user_id AS VARCHAR) AS search_text FROM events"""


def _items(spark: SparkSession, sf_dir: str) -> DataFrame:
    value, id_ = F.col("value"), F.col("event_id")
    return _t(spark, sf_dir, "events").select(
        "event_id",
        "user_id",
        _ms("ts").alias("date_value"),
        F.col("event_type").alias("type"),
        F.concat(F.lit("src"), (F.col("user_id") % 5).cast("string")).alias("source"),
        F.when(id_ % 7 != 0, value).alias("duration_minutes"),
        F.when(id_ % 5 != 0, F.floor(value)).cast("double").alias("active_energy_kcal"),
        F.when(id_ % 3 != 0, value / 2).alias("weight_kg"),
        F.when(id_ % 4 != 0, F.floor(value / 10)).cast("double").alias("fat_percent"),
        F.when(id_ % 11 != 0, F.floor(value / 3)).cast("double").alias("average_bpm"),
        F.concat("event_type", F.lit(" User "), F.col("user_id").cast("string")).alias("search_text"),
    )


def _view_rank(order: str) -> None:
    column, down = view.ORDERS[order]

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = view.ranked_view(_items(spark, sf_dir), order, "event_id", ["user_id"])
        return rows.select("user_id", "event_id", F.col("view_rank").cast("long").alias("view_rank"))

    name = f"view_rank_{order.replace('-', '_')}"
    QUERIES[name] = run
    SQL[name] = f"""WITH i AS ({_ITEMS_SQL})
SELECT user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY {column} {"DESC" if down else "ASC"} NULLS LAST, date_value DESC NULLS LAST, event_id) AS view_rank FROM i"""


for _order in view.ORDERS:
    _view_rank(_order)


@query("SELECT event_id, event_type FROM events WHERE event_type <> 'click' AND user_id % 5 <> 0 AND contains(lower(event_type || ' User ' || CAST(user_id AS VARCHAR)), 'user 1')")
def view_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = {"click": "Workout", "view": "Body composition"}
    items = _items(spark, sf_dir).withColumn("kind", F.col("type")).withColumn("type", F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for p in names.items() for x in p)), F.col("type")), F.col("type")))
    items = items.withColumn("source", F.when(F.col("source") == "src0", "ACCUNIQ").otherwise(F.col("source")))
    test = view.visible({"show_workout": False, "show_accuniq": False, "show_body": True}, " USER 1 ")
    return items.where(test).select("event_id", F.col("kind").alias("event_type"))


@query("SELECT count(*) FILTER (WHERE event_type <> 'click') AS n_visible, count(*) AS n_total FROM events")
def view_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return view.counts(_items(spark, sf_dir), F.col("type") != "click")


_WHOLE = "CAST(CAST(floor({} + 0.5) AS BIGINT) AS VARCHAR)"


@query(f"""SELECT o_orderkey, concat_ws(' · ', CASE WHEN o_orderkey % 3 <> 0 THEN {_WHOLE.format("o_totalprice / 1000")} || ' min' END,
    CASE WHEN o_orderkey % 4 <> 0 THEN {_WHOLE.format("o_totalprice / 100")} || ' kcal' END,
    CASE WHEN o_orderkey % 5 <> 0 THEN {_WHOLE.format("o_totalprice / 2000")} || ' bpm avg' END) AS summary FROM orders""")
def summary_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    key, price = F.col("o_orderkey"), F.col("o_totalprice")
    line = view.workout_summary(F.when(key % 3 != 0, price / 1000), F.when(key % 4 != 0, price / 100), F.when(key % 5 != 0, price / 2000))
    return _t(spark, sf_dir, "orders").select("o_orderkey", line.alias("summary"))


@query(f"""SELECT o_orderkey, CASE WHEN o_orderkey % 3 <> 0 THEN floor(o_totalprice / 1000 + 0.5) END AS duration_minutes,
    CASE WHEN o_orderkey % 4 <> 0 THEN floor(o_totalprice / 100 + 0.5) END AS active_energy_kcal, CASE WHEN o_orderkey % 5 <> 0 THEN floor(o_totalprice / 2000 + 0.5) END AS average_bpm FROM orders""")
def row_reparse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Numbers read back from the summary line."""
    read = view.reread(F.col("summary"), F.lit("Workout"))
    return summary_line(spark, sf_dir).select("o_orderkey", *read).select("o_orderkey", "duration_minutes", "active_energy_kcal", "average_bpm")


@query("""WITH l AS (SELECT l_orderkey, count(*) AS n, avg(l_quantity) AS average FROM lineitem WHERE l_returnflag = 'R' GROUP BY 1)
SELECT count(*) AS n_logs, min((epoch_us(o_orderdate) // 1000)) AS first_start, max((epoch_us(o_orderdate) // 1000)) AS last_start, count(average) AS n_with_average,
    count(*) FILTER (WHERE n > 0) AS n_with_samples, CAST(sum(coalesce(n, 0)) AS BIGINT) AS n_samples FROM orders LEFT JOIN l ON l_orderkey = o_orderkey""")
def review_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = _t(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("n"), F.avg("l_quantity").alias("average"))
    logs = _t(spark, sf_dir, "orders").join(lines, F.col("o_orderkey") == F.col("l_orderkey"), "left").select(_ms("o_orderdate").alias("start"), "average", "n")
    return sessions.review_summary(logs, "start", "average", "n")


_KIND = """CASE WHEN page_id % 5 = 0 THEN 'apple_health_zip' WHEN page_id % 5 = 1 THEN 'apple_health_xml' WHEN page_id % 5 IN (2, 3) THEN 'body_composition_report' ELSE 'unknown' END"""


@query(f"SELECT page_id, {_KIND} AS kind FROM pages")
def upload_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("page_id") % 5
    name = F.concat("url", F.when(turn == 0, "/A.ZIP").when(turn == 1, "/b.xml").when(turn == 2, "/c.JPeG").otherwise("/d.dat"))
    return _t(spark, sf_dir, "pages").select("page_id", fn.upload_kind(name, F.when(turn == 3, "image/heic")).alias("kind"))


@query(r"""SELECT doc_id, CASE WHEN regexp_matches(t, '(?i)\bACCUNIQ\b|Selvas\s+Healthcare|Comprehensive\s+Evaluation|ACCUNIQ\s+Manager') THEN 'accuniq'
    WHEN regexp_matches(t, '(?i)\bTANITA\b|DC\s*[-–]?\s*360|VISCERAL\s+FAT\s+RATING|BIOELECTRICAL\s+DATA') THEN 'tanita' ELSE 'unknown' END AS source
FROM (SELECT doc_id, text || chr(10) || CASE doc_id % 4 WHEN 0 THEN 'dc - 360.pdf' WHEN 1 THEN 'my accuniq scan' WHEN 2 THEN 'xTANITAx' ELSE '' END AS t FROM documents)""")
def report_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("doc_id") % 4
    name = F.when(turn == 0, "dc - 360.pdf").when(turn == 1, "my accuniq scan").when(turn == 2, "xTANITAx").otherwise("")
    return _t(spark, sf_dir, "documents").select("doc_id", fn.report_source(F.col("text"), name).alias("source"))


@query(r"""SELECT event_id, TRY_CAST(nullif(regexp_extract(props, '([+-]?\d+(?:\.\d+)?)', 1), '') AS DOUBLE) AS first_number FROM events""")
def first_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", fn.number(F.regexp_extract("props", r"([+-]?\d+(?:\.\d+)?)", 1)).alias("first_number"))


@query("""SELECT c_custkey, 'input.body_type' AS path, CASE WHEN c_custkey % 3 = 0 THEN c_mktsegment || ' ' || c_name ELSE c_mktsegment END AS value FROM customer
UNION ALL SELECT c_custkey, 'input.gender', CASE WHEN c_custkey % 2 = 0 THEN 'NOT SAID' ELSE 'FEMALE' END FROM customer""")
def best_text_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of all texts found for a field the one of most words, then the longest, of made receipts."""
    key, segment = F.col("c_custkey"), F.col("c_mktsegment")
    again = F.when(key % 3 == 0, F.concat(F.lit("\nBODY TYPE = "), segment, F.lit("  "), F.col("c_name"), F.lit(" ,"))).otherwise(F.lit(""))
    text = F.concat(F.lit("Body Type: "), segment, F.lit("\nGENDER male\nAGE 30"), again, F.lit("\nGender: "), F.when(key % 2 == 0, F.lit("NOT SAID")).otherwise(F.lit("FEMALE")), F.lit("\nRESULT"))
    docs = _t(spark, sf_dir, "customer").select(key.alias("doc"), text.alias("text"), F.lit("Tanita.jpg").alias("source_name"))
    return reports.recovered_texts(docs).withColumnRenamed("doc", "c_custkey")


@query("""SELECT c_custkey, 'id' AS path, 'number' AS kind, CAST(c_custkey AS VARCHAR) AS value FROM customer
UNION ALL SELECT c_custkey, 'source.name', 'text', c_name FROM customer
UNION ALL SELECT c_custkey, 'source.segment', 'text', coalesce(CASE WHEN c_custkey % 5 <> 0 THEN c_mktsegment END, '') FROM customer
UNION ALL SELECT c_custkey, 'active', 'boolean', CASE WHEN c_custkey % 2 = 0 THEN 'true' ELSE 'false' END FROM customer""")
def flatten_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _t(spark, sf_dir, "customer").withColumn("c_mktsegment", F.when(F.col("c_custkey") % 5 != 0, F.col("c_mktsegment"))).withColumn("active", F.col("c_custkey") % 2 == 0)
    return view.flattened(rows.withColumn("id", F.col("c_custkey")), "c_custkey", {"id": ("id", "number"), "c_name": ("source.name", "text"), "c_mktsegment": ("source.segment", "text"), "active": ("active", "boolean")})


@query("""SELECT event_id, '{"k":' || json_extract_string(props, '$.k') || '}' AS canonical FROM events""")
def canonical_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "events").select("event_id", fn.canonical_json(F.col("props")).alias("canonical"))


_EXPECT = "l_extendedprice * (1 - l_discount)"


@query(f"""SELECT l_orderkey, l_linenumber, CASE WHEN l_linenumber % 3 = 0 THEN {_R1.format(_EXPECT)} ELSE l_extendedprice END AS price,
    l_linenumber % 3 = 0 AS derived, l_linenumber % 3 <> 0 AND abs(l_extendedprice - {_EXPECT}) > 0.25 AS warned FROM lineitem""")
def derive_and_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A missing value is derived from its identity; one that is there is checked against it."""
    expected = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    printed = F.when(F.col("l_linenumber") % 3 != 0, F.col("l_extendedprice"))
    rules = reports._Rules(_t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", printed.alias("price"), expected.alias("expected")))
    rules.derive("price", fn.round1(F.col("expected")), "from price and discount")
    rules.warn(F.abs(F.col("price") - F.col("expected")) > 0.25, "does not match")
    noted = F.array_contains("derived_fields", "metrics.price")
    return rules.rows.select("l_orderkey", "l_linenumber", "price", noted.alias("derived"), F.array_contains("warnings", "does not match").alias("warned"))


@query("""SELECT p_partkey, (CAST(p_partkey % 2 = 0 AS INTEGER) + CAST(p_partkey % 3 = 0 AS INTEGER) + CAST(p_partkey % 5 = 0 AS INTEGER) + 1) / CAST(4 AS DOUBLE) AS completeness FROM part""")
def completeness(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("p_partkey")
    parts = [F.when(key % 2 == 0, F.col("p_size")), F.when(key % 3 == 0, F.col("p_brand")), F.when(key % 5 == 0, F.col("p_type")), F.col("p_name")]
    return _t(spark, sf_dir, "part").select("p_partkey", sessions.completeness(parts).alias("completeness"))


@query("""WITH v AS (SELECT l_orderkey, lower(CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE lower(l_returnflag) END) AS same,
    CASE WHEN l_linenumber % 2 = 0 THEN l_returnflag ELSE lower(l_returnflag) END AS value, CAST(round(l_extendedprice * 100) AS BIGINT) AS rank, l_linestatus = 'F' AS observed FROM lineitem),
g AS (SELECT l_orderkey, same, count(*) FILTER (WHERE observed) AS n_observed, count(*) AS n, min(rank) AS rank, arg_min(value, rank) AS value FROM v GROUP BY 1, 2),
r AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY n_observed DESC, n DESC, rank) AS k,
    count(*) FILTER (WHERE n_observed > 0) OVER (PARTITION BY l_orderkey) > 1 AS conflicted FROM g)
SELECT l_orderkey, value, n_observed, n, conflicted FROM r WHERE k = 1""")
def consensus_vote(spark: SparkSession, sf_dir: str) -> DataFrame:
    votes = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("rank"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag")).otherwise(F.lower("l_returnflag")).alias("vote"), (F.col("l_linestatus") == "F").alias("observed"))
    return consensus.text_vote(votes, ["l_orderkey"], "vote", "rank", F.col("observed"))


def _number_vote_sql(entries: str, key: str, tolerance: str) -> str:
    """Common table expressions that end in voted (key, value, n_observed, n, conflicted): numbers in order of i
    join the first group whose first number is within the tolerance."""
    keys = key.split(", ")
    return f"""{entries},
folded AS (
    SELECT {key}, i, v, o, [v] AS firsts, 1 AS g FROM entries WHERE i = 1
    UNION ALL
    SELECT {key}, i, v, o, CASE WHEN p = 0 THEN list_append(firsts, v) ELSE firsts END, CASE WHEN p = 0 THEN len(firsts) + 1 ELSE p END
    FROM (SELECT {", ".join(f"e.{k}" for k in keys)}, e.i, e.v, e.o, f.firsts, coalesce(list_position(list_transform(f.firsts, lambda x: abs(x - e.v) <= {tolerance}), true), 0) AS p
          FROM folded f JOIN entries e ON {" AND ".join(f"e.{k} = f.{k}" for k in keys)} AND e.i = f.i + 1)),
groups AS (SELECT {key}, g, arg_min(v, i) AS value, min(i) AS i, count(*) FILTER (WHERE o) AS n_observed, count(*) AS n FROM folded GROUP BY {key}, g),
voted AS (
    SELECT {key}, value, n_observed, n, count(*) FILTER (WHERE n_observed > 0) OVER (PARTITION BY {key}) > 1 AS conflicted
    FROM groups QUALIFY row_number() OVER (PARTITION BY {key} ORDER BY n_observed DESC, n DESC, i) = 1)"""


@query(f"""WITH RECURSIVE {_number_vote_sql("entries AS (SELECT l_orderkey, l_discount AS v, l_linestatus = 'F' AS o, row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(round(l_extendedprice * 100) AS BIGINT), l_discount) AS i FROM lineitem WHERE l_discount IS NOT NULL)", "l_orderkey", "CAST(0.015 AS DOUBLE)")}
SELECT * FROM voted""")
def consensus_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Votes of numbers within a tolerance; the order of readings decides."""
    votes = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.round(F.col("l_extendedprice") * 100).cast("long").alias("rank"), F.col("l_discount").alias("vote"), (F.col("l_linestatus") == "F").alias("observed"))
    return consensus.number_vote(votes, ["l_orderkey"], "vote", "rank", "observed", 0.015)


#: Readings of receipts made of order lines (o, line n): path, and tenths of its number without noise.
_READ = {
    "input.age": "10 * (20 + o % 50)",
    "input.height_cm": "1500 + o % 400",
    "input.clothes_weight_kg": "5 + o % 10",
    "metrics.weight_kg": "500 + o % 400",
    "metrics.fat_percent": "150 + o % 200",
    "metrics.fat_mass_kg": "80 + o % 150",
    "metrics.ffm_kg": "400 + o % 300",
    "metrics.muscle_mass_kg": "375 + o % 300",
    "metrics.tbw_kg": "250 + o % 200",
    "metrics.tbw_percent": "450 + o % 150",
    "metrics.bone_mass_kg": "20 + o % 15",
    "metrics.bmr_kj": "50000 + 10 * (o % 300)",
    "metrics.bmr_kcal": "12000 + 10 * (o % 70)",
    "metrics.visceral_fat_rating": "10 * (1 + o % 12)",
    "metrics.bmi": "180 + o % 150",
    "metrics.ideal_body_weight_kg": "550 + o % 100",
    "reference_ranges.fat_percent.min": "100 + o % 50",
    "reference_ranges.fat_percent.max": "200 + o % 50",
    "bioelectrical.6.25_khz.r_ohm": "6000 + o % 900",
    "bioelectrical.6.25_khz.x_ohm": "-200 - o % 150",
    "bioelectrical.50_khz.r_ohm": "5300 + o % 900",
    "bioelectrical.50_khz.x_ohm": "-400 - o % 200",
}
_TENTHS = "CASE WHEN (o * 3 + n * 5 + {j}) % 5 = 0 THEN NULL ELSE ({t}) + CASE (o + n * {j}) % 11 WHEN 0 THEN 9 WHEN 1 THEN 1 ELSE 0 END END"
_READ_TEXTS = {
    "input.gender": "CASE WHEN (o + n) % 9 = 0 THEN NULL WHEN (o + n) % 4 = 0 THEN 'male ' WHEN (o + n) % 4 = 1 THEN 'FEMALE' ELSE 'MALE' END",
    "date": "concat('2031-11-1', CAST(o % 9 + CASE WHEN n % 5 = 0 THEN 1 ELSE 0 END AS VARCHAR(2)))",
    "time": "CASE WHEN n % 4 = 0 THEN NULL ELSE concat('07:0', CAST(n % 3 AS VARCHAR(2))) END",
}
_MEASURED = "concat({date}, 'T', coalesce({time}, '00:00'), ':00')".format(**_READ_TEXTS)
_LISTED, _DERIVED = "(o + n + {j}) % 3 > 0", "(o + n * 7 + {j}) % 8 = 0"


def _readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order lines as readings of a receipt, with the columns of reports.receipts."""
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o"), F.col("l_linenumber").alias("n"))
    paths = list(_READ)
    value = {path: F.expr(_TENTHS.format(t=t, j=paths.index(path))).cast("double") / 10 for path, t in _READ.items()}
    none = F.lit(None)
    number = lambda path: value.get(path, none).cast("double")
    marked = lambda test: F.array_compact(F.array(*(F.when(F.expr(test.format(j=j)), F.lit(p)) for j, p in enumerate(paths))))
    limits = lambda path: F.struct(*(number(f"reference_ranges.{path}.{end}").alias(end) for end in ("min", "max")))
    ohms = F.create_map(*(x for f in (parse_merge.LOW, parse_merge.HIGH) for x in (F.lit(f), F.struct(*(number(f"bioelectrical.{f}.{c}").alias(c) for c in ("r_ohm", "x_ohm"))))))
    return lines.select(
        "o",
        "n",
        *(F.expr(_READ_TEXTS.get(path, _MEASURED if path == "measured_at_local" else "CAST(NULL AS STRING)")).alias(c) for path, c in parse_merge.TEXTS.items()),
        *(number(path).alias(c) for path, c in parse_merge.NUMBERS.items() if "." not in c),
        limits("fat_percent").alias("fat_percent_range"),
        limits("fat_mass_kg").alias("fat_mass_range"),
        ohms.alias("bioelectrical"),
        (F.expr("(n * 37 + o) % 20") / F.lit(20.0)).alias("completeness"),
        F.array_repeat(F.lit("w"), F.expr("CAST((o + n) % 3 AS INT)")).alias("warnings"),
        marked(_DERIVED).alias("derived_fields"),
        marked(_LISTED).alias("review_fields"),
    )


def _merged_parses_sql() -> str:
    paths = list(_READ)
    said = ", ".join(f"{{'path': '{p}', 't': {_TENTHS.format(t=t, j=j)}, 'derived': {_DERIVED.format(j=j)}, 'listed': {_LISTED.format(j=j)}}}" for j, (p, t) in enumerate(_READ.items()))
    texts = ", ".join(f"{{'path': '{p}', 'v': {t}}}" for p, t in ({"measured_at_local": f"CASE WHEN {_READ_TEXTS['time']} IS NOT NULL THEN {_MEASURED} END"} | _READ_TEXTS).items())
    column = {p: p.split(".")[-1] if p.startswith(("input.", "metrics.")) else p.replace(".", "_") for p in paths}
    pivot = ", ".join(f"max(value) FILTER (WHERE path = '{p}') AS {c}" for p, c in column.items())
    pair = lambda what, off, fits: (
        f"arg_min([lo, hi], ({off}, n)) FILTER (WHERE lo IS NOT NULL AND hi IS NOT NULL AND {fits}) FROM (SELECT o, n, max(v) FILTER (WHERE path = 'bioelectrical.6.25_khz.{what}') AS lo, max(v) FILTER (WHERE path = 'bioelectrical.50_khz.{what}') AS hi FROM long GROUP BY o, n) GROUP BY o"
    )
    sql, last = "", "wide"
    r1 = lambda x: _R1.format(f"({x})")
    kj, metres = "CAST(4.184 AS DOUBLE)", "(height_cm / CAST(100 AS DOUBLE))"
    index = f"weight_kg / ({metres} * {metres})"
    muscle = r1("ffm_kg - bone_mass_kg")
    told = lambda x: f"CASE WHEN {x} = floor({x}) THEN CAST(CAST({x} AS BIGINT) AS VARCHAR) ELSE CAST({x} AS VARCHAR) END"
    rules = (
        ("muscle_mass_kg", muscle, f"muscle_mass_kg IS NULL OR abs(muscle_mass_kg - {muscle}) > CAST(0.05 AS DOUBLE)"),
        ("fat_mass_kg", r1("weight_kg - ffm_kg"), "fat_mass_kg IS NULL"),
        ("fat_percent", r1("fat_mass_kg / weight_kg * 100"), "fat_percent IS NULL"),
        ("tbw_kg", r1("weight_kg * tbw_percent / 100"), "tbw_kg IS NULL"),
        ("tbw_percent", r1("tbw_kg / weight_kg * 100"), "tbw_percent IS NULL"),
        ("bmr_kj", f"floor(bmr_kcal * {kj} + 0.5)", "bmr_kj IS NULL"),
        ("bmr_kcal", f"floor(bmr_kj / {kj} + 0.5)", "bmr_kcal IS NULL"),
        ("bmi", r1(index), "bmi IS NULL"),
    )
    for k, (name, value, test) in enumerate(rules):
        warned = f"CASE WHEN _new IS NOT NULL AND abs(muscle_mass_kg - _new) > 0.5 THEN list_append(warnings, 'muscle_mass_kg was read as ' || {told('muscle_mass_kg')} || ', which contradicts other values; it is set to ' || {told('_new')} || '.') ELSE warnings END" if k == 0 else "warnings"
        sql += f",\nw{k} AS (SELECT * EXCLUDE (_new) REPLACE (coalesce(_new, {name}) AS {name}, CASE WHEN _new IS NOT NULL THEN list_append(corrected, 'metrics.{name}') ELSE corrected END AS corrected, {warned} AS warnings) FROM (SELECT *, CASE WHEN {test} THEN {value} END AS _new FROM {last}))"
        last = f"w{k}"
    for k, (test, text) in enumerate((("abs(weight_kg - fat_mass_kg - ffm_kg) > 0.35", "Weight, fat mass and FFM do not reconcile; review them."), ("abs(weight_kg * fat_percent / 100 - fat_mass_kg) > 0.45", "Fat %, weight and fat mass do not reconcile; review them."), (f"abs({index} - bmi) > 0.35", "BMI does not match weight and height; review it."))):
        sql += f",\nc{k} AS (SELECT * REPLACE (CASE WHEN {test} THEN list_append(warnings, '{text}') ELSE warnings END AS warnings) FROM {last})"
        last = f"c{k}"
    listed = lambda test: f"array_to_string(list_filter([{', '.join(repr(p) for p in parse_merge.PATHS)}], lambda p: {test}), ',')"
    count = lambda names: " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE 1 END" for c in names)
    results = [c for c in parse_merge.RESULTS if c in column.values()]
    ohm = ", ".join(f"coalesce({w[0]}[{k}], bioelectrical_{f.replace('.', '_')}_{w}) AS {w}_{name}" for w in ("r_ohm", "x_ohm") for k, f, name in ((1, parse_merge.LOW, "low"), (2, parse_merge.HIGH, "high")))
    return f"""WITH RECURSIVE l AS (SELECT l_orderkey AS o, l_linenumber AS n FROM lineitem),
k AS (
    SELECT o, n, row_number() OVER (PARTITION BY o ORDER BY ((n * 37 + o) % 20) / CAST(20 AS DOUBLE) - CAST(0.015 AS DOUBLE) * ((o + n) % 3) DESC, n) AS rank FROM l),
u AS (SELECT o, n, rank, unnest([{said}]) AS x FROM k),
long AS (SELECT o, n, rank, x.path AS path, CAST(x.t AS DOUBLE) / 10 AS v, x.derived AS derived, x.listed AS listed FROM u),
{_number_vote_sql("entries AS (SELECT o AS ok, path, v, NOT derived AS o, row_number() OVER (PARTITION BY long.o, path ORDER BY rank) AS i FROM long WHERE v IS NOT NULL)", "ok, path", "CAST(0.11 AS DOUBLE)")},
tu AS (SELECT o, n, rank, unnest([{texts}]) AS x FROM k),
ts AS (SELECT o, x.path AS path, lower(trim(x.v)) AS same, count(*) AS n, arg_min(x.v, rank) AS v, min(rank) AS rank FROM tu WHERE x.v IS NOT NULL GROUP BY o, x.path, lower(trim(x.v))),
tv AS (SELECT o, path, v, count(*) OVER (PARTITION BY o, path) > 1 AS conflicted FROM ts QUALIFY row_number() OVER (PARTITION BY o, path ORDER BY n DESC, rank) = 1),
tw AS (SELECT o, {", ".join(f"max(v) FILTER (WHERE path = '{p}') AS {p.split('.')[-1]}" for p in ("measured_at_local", *_READ_TEXTS))}, coalesce(list(path) FILTER (WHERE conflicted), []) AS text_conflicts FROM tv GROUP BY o),
best AS (SELECT o, count(*) AS candidate_count, arg_min({_MEASURED}, rank) AS best_time FROM k GROUP BY o),
nw AS (SELECT ok AS o, {pivot}, coalesce(list(path) FILTER (WHERE n_observed = 0), []) AS unseen, coalesce(list(path) FILTER (WHERE conflicted), []) AS conflicts FROM voted GROUP BY ok),
rp AS (SELECT o, {pair("r_ohm", "abs(lo - hi - 65)", "lo > hi").replace(" FROM (", " AS r FROM (", 1)}),
xp AS (SELECT o, {pair("x_ohm", "abs(abs(hi) - abs(lo) - 22)", "true").replace(" FROM (", " AS x FROM (", 1)}),
ls AS (SELECT o, list(DISTINCT path) AS listed FROM long WHERE listed GROUP BY o),
wide AS (
    SELECT best.o, candidate_count, coalesce(measured_at_local, best_time) AS measured_at_local, date, time, gender, nw.* EXCLUDE (o), r, x, text_conflicts, coalesce(listed, []) AS listed,
           CAST([] AS VARCHAR[]) AS corrected, CAST([] AS VARCHAR[]) AS warnings
    FROM best LEFT JOIN tw USING (o) LEFT JOIN nw USING (o) LEFT JOIN rp USING (o) LEFT JOIN xp USING (o) LEFT JOIN ls USING (o)){sql}
SELECT o AS l_orderkey, measured_at_local, date, time, gender, {", ".join(c for p, c in column.items() if p.startswith(("input.", "metrics.")))},
       reference_ranges_fat_percent_min AS fat_percent_min, reference_ranges_fat_percent_max AS fat_percent_max, {ohm},
       ({count(reports.RECEIPT_CORE)}) / CAST(10 AS DOUBLE) AS completeness, CAST({count(results)} AS INTEGER) AS fields_found, candidate_count,
       array_to_string(warnings, ' ') AS warnings, array_to_string(corrected, ',') AS corrected_fields,
       {listed("list_contains(unseen, p) OR list_contains(corrected, p)")} AS derived_fields,
       {listed("(list_contains(conflicts, p) OR list_contains(text_conflicts, p)) AND regexp_matches(p, '^(metrics|input|bioelectrical)[.]')")} AS conflicted_fields,
       {listed("p = 'measured_at_local' OR list_contains(listed, p)")} AS review_fields
FROM {last}"""


@query(_merged_parses_sql())
def merged_parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An order's lines as readings of one receipt that see, derive, miss and misread its fields."""
    rows = parse_merge.merged(_readings(spark, sf_dir), "o", "n")
    ohm = lambda f, c: F.try_element_at("bioelectrical", F.lit(f))[c]
    joined = lambda c, by=",": F.array_join(c, by).alias(c)
    numbers = [path.split(".")[-1] for path in _READ if path.startswith(("input.", "metrics."))]
    return rows.select(
        F.col("o").alias("l_orderkey"), "measured_at_local", "date", "time", "gender", *numbers,
        F.col("fat_percent_range.min").alias("fat_percent_min"), F.col("fat_percent_range.max").alias("fat_percent_max"),
        *(ohm(f, c).alias(f"{c}_{name}") for c in ("r_ohm", "x_ohm") for f, name in ((parse_merge.LOW, "low"), (parse_merge.HIGH, "high"))),
        "completeness", "fields_found", "candidate_count", joined("warnings", " "), *(joined(f"{c}_fields") for c in ("corrected", "derived", "conflicted", "review")),
    )


@query("""SELECT l_orderkey, l_linenumber, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_discount - CAST(0.015 AS DOUBLE) * l_quantity DESC, l_linenumber) AS candidate_rank FROM lineitem""")
def candidate_ranking(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = consensus.ranked(_t(spark, sf_dir, "lineitem"), "l_orderkey", "l_discount", "l_quantity", "l_linenumber")
    return rows.select("l_orderkey", "l_linenumber", F.col("candidate_rank").cast("long").alias("candidate_rank"))


@query("""WITH b AS (SELECT l_returnflag, CAST(floor(l_extendedprice / 400) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, sum(n) OVER (PARTITION BY l_returnflag ORDER BY bin) AS seen, sum(n) OVER (PARTITION BY l_returnflag) AS total FROM b)
SELECT l_returnflag, min(bin) AS percentile FROM c WHERE seen >= total * CAST(0.985 AS DOUBLE) GROUP BY 1""")
def hist_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    bins = layout.histogram(_t(spark, sf_dir, "lineitem"), ["l_returnflag"], F.floor(F.col("l_extendedprice") / 400))
    return layout.histogram_percentile(bins, ["l_returnflag"], 0.985)


@query("SELECT p_brand, median(p_retailprice) AS median FROM part GROUP BY p_brand")
def median(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.median(_t(spark, sf_dir, "part"), ["p_brand"], "p_retailprice")


@query("""WITH n AS (SELECT a.p_brand, a.p_partkey, a.p_size, (SELECT count(*) FROM part b WHERE b.p_brand = a.p_brand AND abs(b.p_size - a.p_size) <= 8) AS size, count(*) OVER (PARTITION BY a.p_brand) AS total FROM part a),
c AS (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY size DESC, p_partkey) AS r FROM n)
SELECT c.p_brand, median(p.p_size) AS position, count(*) AS cluster_size, max(total) AS sample_size
FROM c JOIN part p ON p.p_brand = c.p_brand AND abs(p.p_size - c.p_size) <= 8 WHERE r = 1 AND size >= 3 AND size >= CAST(0.25 AS DOUBLE) * total GROUP BY 1""")
def dominant_cluster(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.dominant_cluster(_t(spark, sf_dir, "part").select("p_brand", "p_partkey", "p_size"), ["p_brand"], "p_size", "p_partkey", 8)


_DAYS = "SELECT DISTINCT user_id, CAST(floor((epoch_us(ts) // 1000) / 86400000) AS BIGINT) AS day FROM events"


@query(f"""WITH d AS ({_DAYS}), f AS (SELECT *, CASE WHEN day - lag(day) OVER (PARTITION BY user_id ORDER BY day) > 2 THEN 1 WHEN lag(day) OVER (PARTITION BY user_id ORDER BY day) IS NULL THEN 1 ELSE 0 END AS new FROM d),
r AS (SELECT *, sum(new) OVER (PARTITION BY user_id ORDER BY day) AS run FROM f)
SELECT user_id, min(day) AS run_start, max(day) AS run_end, count(*) AS n FROM r GROUP BY user_id, run HAVING max(day) - min(day) + 1 >= 4""")
def runs_with_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = _t(spark, sf_dir, "events").select("user_id", F.floor(_ms("ts") / 86_400_000).alias("day")).distinct()
    return layout.runs(days, ["user_id"], "day", max_gap=1, least=4)


_POS = "(o_totalprice % 1000) / 1000"
_CLAMP = f"greatest(CAST(0 AS DOUBLE), least(CAST(0.999999 AS DOUBLE), {_POS}))"


@query(f"""WITH p AS (SELECT o_orderkey, {_CLAMP} AS x FROM orders), s AS (SELECT *, CAST(floor(x * 4) AS INTEGER) AS k FROM p),
v AS (SELECT *, CAST(greatest(0, least(95, floor((x - k * CAST(0.25 AS DOUBLE)) / CAST(0.25 AS DOUBLE) * 100 / 5 + CAST(0.5 AS DOUBLE)) * 5)) AS INTEGER) AS pct FROM s)
SELECT o_orderkey, ['-', '0', '+', '++'][k + 1] AS level, pct AS section_percent, ['-', '0', '+', '++'][k + 1] || ': ' || CAST(pct AS VARCHAR) || '%' AS reading FROM v""")
def band_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = fn.position_reading(F.lit("bmi"), F.col("o_totalprice") % 1000 / 1000)
    return _t(spark, sf_dir, "orders").select("o_orderkey", found.alias("r")).select("o_orderkey", "r.level", "r.section_percent", "r.reading")


def _composition_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _t(spark, sf_dir, "lineitem").select(F.floor(F.col("l_orderkey") / 3).alias("k"), (F.col("l_orderkey") % 3 * 10 + F.col("l_linenumber")).alias("place"), F.col("l_quantity").alias("v"))


@query()
def composition_solver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Seven-way joins of loose numbers take SQL minutes here; tests compare it with them in small."""
    return solve.composition(_composition_input(spark, sf_dir), "k", "place", "v")


@query()
def range_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Quantities of an order to ranges around its discounts, one to one at the least cost."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", (F.col("l_discount") * 500).alias("low"), (F.col("l_discount") * 500 + 2 + F.col("l_tax") * 100).alias("high"))
    item = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_quantity", "low", "high"))).alias("x")
    rows = lines.groupBy("l_orderkey").agg(item).withColumn("of", solve.assigned_ranges(F.col("x.l_quantity"), F.col("x.low"), F.col("x.high")))
    return rows.select("l_orderkey", F.posexplode("of")).select("l_orderkey", F.col("pos").alias("value_place"), F.col("col").alias("range_place"))


@query(r"""SELECT doc_id, trim(regexp_replace(regexp_replace(regexp_replace('key AIzaABCDEFGHIJKLMNOPQRSTU' || CAST(doc_id AS VARCHAR) || ' at https://x.org/?a=1&API_KEY=s3cret' || CAST(doc_id AS VARCHAR) || '&b=2 ' || text,
    'AIza[0-9A-Za-z_-]{20,}', '[redacted-api-key]', 'g'), '(?i)([?&](?:key|api_key)=)[^&\s]+', '\1[redacted]', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g')) AS redacted FROM documents""")
def redact_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    key = F.col("doc_id").cast("string")
    text = F.concat(F.lit("key AIzaABCDEFGHIJKLMNOPQRSTU"), key, F.lit(" at https://x.org/?a=1&API_KEY=s3cret"), key, F.lit("&b=2 "), F.col("text"))
    return _t(spark, sf_dir, "documents").select("doc_id", fn.redacted(text).alias("redacted"))


@query("SELECT o_orderkey, o_custkey FROM orders WHERE NOT (o_custkey % 10 = 3 AND strftime(o_orderdate, '%Y-%m') = '1996-03')")
def delete_by_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Deletes ids from the one month that they name; the same id in another month stays."""
    orders = _t(spark, sf_dir, "orders").select("o_orderkey", "o_custkey", F.concat(F.lit("1996-03:"), F.col("o_custkey").cast("string")).alias("id"), F.date_format("o_orderdate", "yyyy-MM").alias("period"))
    return store.without(orders, orders.where("o_custkey % 10 = 3").select("id")).select("o_orderkey", "o_custkey")


@query("""SELECT event_id, user_id, avg(CASE WHEN value > 50 THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END) OVER (PARTITION BY user_id ORDER BY event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS fraction FROM events""")
def smoothed_fraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return layout.smoothed_fraction(_t(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") > 50).select("event_id", "user_id", "fraction")


@query("""SELECT event_id, strftime(ts, '%Y-%m-%dT%H:%M:%S') || '+08:00' AS time_text, ((epoch_us(ts) // 1000) // 1000) * 1000 - 28800000 AS ms, strftime(ts, '%Y-%m') AS period FROM events""")
def date_normalise(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0800"))
    rows = _t(spark, sf_dir, "events").select("event_id", fn.export_time(raw).alias("time_text"))
    return rows.select("event_id", "time_text", fn.epoch_ms(F.col("time_text")).alias("ms"), fn.period(F.col("time_text")).alias("period"))


@query("""SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN o_totalprice / 60 WHEN 1 THEN o_totalprice * 60 ELSE o_totalprice END AS minutes FROM orders""")
def duration_minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("o_orderkey") % 4
    unit = F.when(turn == 0, "Sec").when(turn == 1, "hr").when(turn == 2, "min")
    return _t(spark, sf_dir, "orders").select("o_orderkey", fn.minutes(F.col("o_totalprice"), unit).alias("minutes"))


@query("""WITH p AS (SELECT o_orderkey, CAST(o_orderkey % 4 * 20 + o_custkey % 20 AS INTEGER) AS p, CASE WHEN o_orderkey % 2 = 0 THEN 1 ELSE -1 END AS d FROM orders),
q AS (SELECT o_orderkey, greatest(0, least(79, p + d)) AS q FROM p)
SELECT o_orderkey, ['-', '0', '+', '++'][q // 20 + 1] || ': ' || CAST(q % 20 * 5 AS VARCHAR) || '%' AS stepped FROM q""")
def step_reading(spark: SparkSession, sf_dir: str) -> DataFrame:
    levels = F.array(*(F.lit(x) for x in fn.FOUR_LEVELS))
    text = F.concat(F.element_at(levels, (F.col("o_orderkey") % 4 + 1).cast("int")), F.lit(": "), (F.col("o_custkey") % 20 * 5 + F.col("o_custkey") % 5).cast("string"), F.lit("%"))
    direction = F.when(F.col("o_orderkey") % 2 == 0, 1).otherwise(-1)
    return _t(spark, sf_dir, "orders").select("o_orderkey", fn.stepped_reading(text, direction, fn.FOUR_LEVELS).alias("stepped"))


@query("""SELECT o_orderkey, floor((o_totalprice + CASE WHEN o_orderkey % 2 = 0 THEN CAST(0.1 AS DOUBLE) ELSE CAST(-0.1 AS DOUBLE) END) * CAST(10 AS DOUBLE) + CAST(0.5 AS DOUBLE)) / CAST(10 AS DOUBLE) AS stepped FROM orders""")
def decimal_step(spark: SparkSession, sf_dir: str) -> DataFrame:
    direction = F.when(F.col("o_orderkey") % 2 == 0, 1.0).otherwise(-1.0)
    return _t(spark, sf_dir, "orders").select("o_orderkey", fn.decimal_step(F.col("o_totalprice"), direction).alias("stepped"))


@query("""SELECT c_custkey, replace(replace(replace('<' || c_name || '> & "' || c_mktsegment || '"', '&', '&amp;'), '<', '&lt;'), '>', '&gt;') AS half,
    to_base64(encode(c_name)) AS coded, c_name AS decoded FROM customer""")
def text_codecs(spark: SparkSession, sf_dir: str) -> DataFrame:
    marked = F.concat(F.lit("<"), "c_name", F.lit('> & "'), "c_mktsegment", F.lit('"'))
    rows = _t(spark, sf_dir, "customer").select("c_custkey", "c_name", F.replace(fn.escaped_html(marked), F.lit("&quot;"), F.lit('"')).alias("half"), fn.base64_from_text(F.col("c_name")).alias("coded"))
    return rows.select("c_custkey", "half", "coded", fn.text_from_base64(F.col("coded")).alias("decoded"))


def _scratch(spark: SparkSession) -> str:
    """A new folder in the shared checkpoint folder, for data that a query derives and reads; only
    a local session may do without one."""
    root, master = spark.conf.get("spark.checkpoint.dir", None), spark.sparkContext.master
    if not root and (not master.startswith("local") or master.startswith("local-cluster")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    root = root or tempfile.mkdtemp(prefix="spark-derived-")
    return f"{root}/derived-{uuid.uuid4().hex}"


@query(f"""WITH {_UNKEYED},
e AS (SELECT DISTINCT session_id, (at_ms // 1000) AS at_s, value AS bpm FROM (
    SELECT n.session_id, epoch_us(e.ts) // 1000 AS at_ms, e.value FROM n JOIN events e ON e.event_type = 'view'
        AND epoch_us(e.ts) // 1000000 >= n.start_ms // 1000 AND epoch_us(e.ts) // 1000000 <= n.start_ms // 1000 + 3600 + 1
        AND (n.next_ms IS NULL OR epoch_us(e.ts) // 1000000 < n.next_ms // 1000))),
a AS (SELECT session_id, count(*) AS n, {_R1.format("CAST(sum(CAST(bpm AS DECIMAL(20,6))) AS DOUBLE) / count(*)")} AS average FROM e GROUP BY 1)
SELECT 'apple-health:strength:' || strftime(to_timestamp(start_ms // 1000) AT TIME ZONE 'UTC', '%Y-%m-%dT%H:%M:%S') || '+00:00' AS id,
    CAST(60 AS DOUBLE) AS duration_minutes, coalesce(a.n, 0) AS n_samples, a.average AS average_bpm FROM s LEFT JOIN a USING (session_id)""")
def xml_workouts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """events written as an export (sign-ups as workouts of an hour, views as heart rates) and read
    back: XML scans, as-of join, distinct samples, statistics."""
    stamp = F.concat(F.date_format("ts", "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))
    later = F.concat(F.date_format(F.col("ts") + F.expr("INTERVAL 1 HOUR"), "yyyy-MM-dd HH:mm:ss"), F.lit(" +0000"))
    quoted = lambda **a: F.concat(*(x for k, v in a.items() for x in (F.lit(f' {k}="'), v, F.lit('"'))))
    workout = F.concat(F.lit("<Workout"), quoted(workoutActivityType=F.lit(health_export.STRENGTH), duration=F.lit("3600"), durationUnit=F.lit("sec"), startDate=stamp, endDate=later), F.lit("/>"))
    record = F.concat(F.lit("<Record"), quoted(type=F.lit(health_export.HEART_RATE), unit=F.lit("count/min"), startDate=stamp, endDate=stamp, value=F.col("value").cast("string")), F.lit("/>"))
    folder = _scratch(spark)
    lines = _t(spark, sf_dir, "events").where("event_type IN ('signup', 'view')").select(F.when(F.col("event_type") == "signup", workout).otherwise(record).alias("value"))

    def framed(batches):  # a document a file
        yield pd.DataFrame({"value": ["<HealthData>"]})
        yield from batches
        yield pd.DataFrame({"value": ["</HealthData>"]})

    lines.mapInPandas(framed, "value string").write.text(folder)
    logs = health_export.import_xml(spark, folder)
    return logs.select("id", "duration_minutes", F.coalesce(F.size("heart_rate_bpm.samples"), F.lit(0)).cast("long").alias("n_samples"), F.col("heart_rate_bpm.average_bpm").alias("average_bpm"))


_LOG = "o_custkey % 500"


@query(f"""WITH r AS (SELECT o_orderkey, {_LOG} AS id, strftime(o_orderdate, '%Y-%m') AS period, o_orderkey % 4 = 0 AS second FROM orders),
b AS (SELECT *, row_number() OVER (PARTITION BY second, id ORDER BY o_orderkey DESC) AS last FROM r),
k AS (SELECT *, row_number() OVER (PARTITION BY period, id ORDER BY second DESC) AS back FROM b WHERE last = 1)
SELECT period, id, o_orderkey AS seq FROM k WHERE back = 1""")
def store_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders saved as logs in two batches, and read again: of an id the last one of a batch stays,
    whatever its month, and of a month and id the last batch's."""
    root, key = _scratch(spark), F.concat(F.lit("log:"), F.expr(_LOG).cast("string"))
    raw = F.to_json(F.struct(key.alias("id"), F.lit("order").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd'T'HH:mm:ss").alias("start_at"), F.col("o_orderkey").alias("seq")))
    logs = _t(spark, sf_dir, "orders").select(raw.alias("raw"), F.col("o_orderkey").alias("place"))
    for second in (False, True):
        store.save(spark, root, logs.where((F.col("place") % 4 == 0) == second))
    found = store.read(spark, root).select("period", F.from_json("raw", "id string, seq long").alias("f"))
    return found.select("period", F.substring("f.id", 5, 20).cast("long").alias("id"), "f.seq")


_W = "CAST(40 + o_custkey % 600 / CAST(10 AS DOUBLE) AS DOUBLE)"
_F = "CAST(5 + o_orderkey % 150 / CAST(10 AS DOUBLE) AS DOUBLE)"


@query(f"""WITH v AS (SELECT o_orderkey, {_W} AS w, {_F} AS f FROM orders)
SELECT o_orderkey, w AS weight_kg, f AS fat_mass_kg, {_R1.format("(w - f)")} AS ffm_kg, {_R1.format("(f / w * 100)")} AS fat_percent, CAST(0.3 AS DOUBLE) AS completeness FROM v""")
def receipt_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Receipts printed from orders and parsed: what is missing is derived from identities."""
    text = F.concat(F.lit("input\nage 30\nRE SULT\nweight "), fn.number_text(F.expr(_W)), F.lit(" kg\nFAI MASS "), fn.number_text(F.expr(_F)), F.lit("kg\nDESIRABLE RANGE\n"))
    docs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), text.alias("text"), F.lit("").alias("source_name"))
    return reports.receipts(docs).select(F.col("doc").alias("o_orderkey"), "weight_kg", "fat_mass_kg", "ffm_kg", "fat_percent", "completeness")


@query(f"""WITH v AS (SELECT o_orderkey, {_W} AS w, {_F} AS f, strftime(o_orderdate, '%Y-%m-%d') AS d FROM orders)
SELECT o_orderkey, d || 'T07:05:00' AS measured_at_local, f AS fat_mass_kg, CAST(o_orderkey % 900 + 1000 AS DOUBLE) AS bmr_kcal, CAST(-2.5 AS DOUBLE) AS weight_control_kg, 'Type ' || CAST(o_orderkey % 3 AS VARCHAR) AS body_type FROM v""")
def report_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports printed from orders and parsed, without a table."""
    text = F.concat(
        F.lit("Date/Time of measurement: "),
        F.date_format("o_orderdate", "yyyy.MM.dd"),
        F.lit(" 7:05\nBMR "),
        (F.col("o_orderkey") % 900 + 1000).cast("string"),
        F.lit(" kcal Weight Control -2,5 kg\nBody Type: Type "),
        (F.col("o_orderkey") % 3).cast("string"),
        F.lit("\nBody Composition Analysis\nBody Fat kg "),
        fn.number_text(F.expr(_F)),
        F.lit("\nThank you"),
    )
    docs = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("doc"), text.alias("text"), F.lit("").alias("source_name"))
    return reports.printed_reports(docs).select(F.col("doc").alias("o_orderkey"), "measured_at_local", "fat_mass_kg", "bmr_kcal", "weight_control_kg", "body_type")


@query("""SELECT p_partkey, 'Metrics · ' || upper(p_brand[1:1]) || p_brand[2:] || ' BMR kJ' AS label, p_partkey % 2 = 1 AS editable FROM part""")
def field_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    brand = F.concat(F.lower(F.substring("p_brand", 1, 1)), F.substring("p_brand", 2, 50))
    path = F.concat(F.lit("metrics."), brand, F.lit("_bmr_kj"))
    shown = F.when(F.col("p_partkey") % 2 == 1, F.lit("indicators.bmi.reading")).otherwise(F.lit("indicators.bmi.level"))
    return _t(spark, sf_dir, "part").select("p_partkey", view.field_label(path).alias("label"), view.editor_path_visible(shown).alias("editable"))


@query("""SELECT event_id, CASE user_id % 4 WHEN 0 THEN 'TANITA DC-360' WHEN 1 THEN 'Apple Health' WHEN 2 THEN 'own device' ELSE 'Unknown' END AS source,
    CASE WHEN event_type = 'view' THEN 'Workout' ELSE event_type END AS kind FROM events""")
def source_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn = F.col("user_id") % 4
    type_ = F.when(turn == 0, "tanita_receipt").when(turn == 1, "apple_health").when(turn == 2, "other")
    kind = F.when(F.col("event_type") == "view", "workout").otherwise(F.col("event_type"))
    return _t(spark, sf_dir, "events").select("event_id", fn.source_label(type_, F.when(turn == 2, "own device")).alias("source"), fn.kind_label(kind).alias("kind"))


@query("""WITH w AS (SELECT l_orderkey, count(*) FILTER (WHERE l_quantity > 25) AS n FROM lineitem GROUP BY 1)
SELECT o_orderkey, o_custkey FROM orders JOIN w ON l_orderkey = o_orderkey WHERE n > 0 AND o_totalprice BETWEEN 1000 AND 200000""")
def plausible_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records with a plausible number behind their label that some other row knows."""
    known = _t(spark, sf_dir, "lineitem").where("l_quantity > 25").select(F.col("l_orderkey").alias("o_orderkey"))
    read = reports.read_lines(F.array(F.lit("PRICE OF 1 PIECE"), F.concat(F.lit("TOTAL "), F.col("o_totalprice").cast("string"))))
    priced = _t(spark, sf_dir, "orders").withColumn("total", reports.value_behind(read, "TOTAL", ("PIECE",), 1000, 200_000, 0)).where("total IS NOT NULL")
    return priced.join(known, "o_orderkey", "left_semi").select("o_orderkey", "o_custkey")


@query("""SELECT o_orderkey, TRY_CAST(CASE o_orderkey % 4 WHEN 0 THEN NULL WHEN 1 THEN CAST(o_custkey AS VARCHAR) WHEN 2 THEN '255' ELSE NULL END AS DOUBLE) AS value FROM orders""")
def number_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    turn, key = F.col("o_orderkey") % 4, F.col("o_custkey").cast("string")
    text = F.when(turn == 0, F.concat(key, F.lit("d"))).when(turn == 1, F.concat(F.lit("  "), key, F.lit(" "))).when(turn == 2, F.lit("0xFF")).otherwise(F.lit(""))
    return _t(spark, sf_dir, "orders").select("o_orderkey", fn.number(text).alias("value"))


@query("""SELECT user_id, epoch_us(min(ts)) // 1000 AS first_ms, row_number() OVER (ORDER BY strftime(min(ts), '%Y-%m-%dT%H:%M:%S'), user_id) AS log_rank FROM events GROUP BY user_id""")
def log_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Oldest first by time text, then id."""
    logs = _t(spark, sf_dir, "events").groupBy("user_id").agg(F.min(_ms("ts")).alias("first_ms"), F.date_format(F.min("ts"), "yyyy-MM-dd'T'HH:mm:ss").alias("at"))
    return merge.log_rank(logs.withColumnRenamed("user_id", "id"), F.col("at"), "log_rank").select(F.col("id").alias("user_id"), "first_ms", "log_rank")


@query("""SELECT doc_id, item AS word, pos FROM (SELECT doc_id, unnest(w) AS item, unnest(range(len(w))) AS pos FROM (
    SELECT doc_id, string_split(regexp_replace(text, '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS w FROM documents)) WHERE item <> ''""")
def page_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The words of documents set as boxes on pages, ten to a line, and put in rows again."""
    words = F.split(F.regexp_replace("text", r"\s+", " "), " ")
    boxes = _t(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("page"), F.posexplode(words).alias("pos", "text")).where("text <> ''")
    line, x = F.floor(F.col("pos") / 10), F.col("pos") % 10 * 20
    placed = boxes.select("page", "text", x.cast("double").alias("left"), (x + 15).cast("double").alias("right"), (line * 30 + F.col("pos") % 3).cast("double").alias("top"), (line * 30 + 12 + F.col("pos") % 3).cast("double").alias("bottom"))
    found = layout.words_to_rows(placed)
    order = W.partitionBy("page").orderBy("row", "place")
    return found.select(F.col("page").cast("long").alias("doc_id"), F.col("text").alias("word"), (F.row_number().over(order) - 1).cast("long").alias("pos"))


@query("""WITH e AS (SELECT o_orderkey, o_custkey % 100 AS kg, strftime(o_orderdate, '%Y-%m-%d') || 'T' || o_orderkey AS tm, o_orderkey % 5 = 0 AS moved,
    'tanita:' || o_orderkey AS old FROM orders),
i AS (SELECT *, CASE WHEN moved OR o_orderkey % 3 = 0 OR o_orderkey % 7 = 0 THEN CASE WHEN o_orderkey % 2 = 0 THEN 'accuniq:' ELSE 'tanita:' END
    || CASE WHEN moved THEN tm || 'b' ELSE tm END ELSE old END AS id FROM e)
SELECT o_orderkey, id, CASE WHEN id <> old THEN old END AS replaced_id, CAST(CASE WHEN o_orderkey % 3 = 0 THEN kg ELSE 50 END AS DOUBLE) AS weight_kg,
    CAST(CASE WHEN o_orderkey % 14 = 0 THEN 512.5 WHEN o_orderkey % 4 = 0 THEN 400 END AS DOUBLE) AS r_ohm,
    CASE WHEN o_orderkey % 14 = 7 THEN 'Invalid number: 5l2' END AS error FROM i""")
def record_edits(spark: SparkSession, sf_dir: str) -> DataFrame:
    """orders as measurements, of which some are edited by path: weights, times (and so ids), and
    readings of a name with a dot, some of which are no numbers."""
    key, orders = F.col("o_orderkey"), _t(spark, sf_dir, "orders")
    at = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd'T'"), key.cast("string"))
    source = F.struct(F.when(key % 2 == 0, "accuniq_report").otherwise("tanita_receipt").alias("type"))
    ohm = F.when(key % 4 == 0, F.struct(F.struct(F.lit(400.0).alias("r_ohm")).alias("6.25_khz")))
    id_ = F.concat(F.lit("tanita:"), key.cast("string"))
    logs = orders.select("o_orderkey", id_.alias("id"), F.lit(edits.BODY).alias("kind"), source.alias("source"), at.alias("measured_at_local"), F.struct(F.lit(50.0).alias("weight_kg")).alias("metrics"), ohm.alias("bioelectrical"))
    reading = F.when(key % 2 == 0, "512.5").otherwise("5l2")
    made = ((3, "metrics.weight_kg", (F.col("o_custkey") % 100).cast("string")), (5, "measured_at_local", F.concat(at, F.lit("b"))), (7, "bioelectrical.6.25_khz.r_ohm", reading))
    rows = F.array_compact(F.array(*(F.when(key % n == 0, F.struct(F.lit(path).alias("path"), value.alias("value"), F.lit(n).alias("place"))) for n, path, value in made)))
    fields = {"metrics.weight_kg": "number", "measured_at_local": "text", "bioelectrical.6.25_khz.r_ohm": "number"}
    found = edits.edited(logs, orders.select(id_.alias("id"), F.inline(rows)), fields)
    ohms = edits.get_path(F.struct(F.col("bioelectrical")), "bioelectrical.6.25_khz.r_ohm")
    return found.select("o_orderkey", "id", "replaced_id", F.col("metrics.weight_kg").alias("weight_kg"), ohms.alias("r_ohm"), "error")


@query("""WITH r AS (SELECT event_id, least(95, CAST(floor(event_id % 100 / CAST(5 AS DOUBLE) + 0.5) AS INTEGER) * 5) AS pct, user_id % 100 // 5 * 5 AS old FROM events)
SELECT event_id, pct AS section_percent, CASE WHEN pct = old THEN 'indicator_graph' ELSE 'manual_review' END AS source, CASE WHEN pct = old THEN CAST(0.5 AS DOUBLE) END AS position FROM r""")
def indicators_normalized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Readings in steps of five; those that differ from the stored ones count as reviewed."""

    def map_of(percent: Column) -> Column:
        text = F.concat(F.lit("0: "), percent.cast("string"), F.lit("%"))
        null = F.lit(None)
        parts = (F.lit("0").alias("level"), null.cast("int").alias("section_percent"), text.alias("reading"), F.lit(0.5).alias("position"), F.lit(0.9).alias("confidence"), F.lit(indicators.GRAPH).alias("source"), null.cast("string").alias("locator"))
        return F.create_map(F.lit("bmi"), F.struct(*parts))

    now, before = map_of(F.col("event_id") % 100), map_of(F.floor(F.col("user_id") % 100 / 5) * 5)
    found = _t(spark, sf_dir, "events").select("event_id", indicators.normalized(now, before)["bmi"].alias("i"))
    return found.select("event_id", "i.section_percent", "i.source", "i.position")


_PLACE = "((l_linenumber * 1000000 + l_partkey) * 100 + CAST(l_quantity AS BIGINT))"
_PARSES = f"""p AS (SELECT l_orderkey, {_PLACE} AS place, ['embedded', 'cloud', 'local'][l_linenumber % 3 + 1] AS route, CASE WHEN l_suppkey % 2 = 0 THEN 'tanita' ELSE 'accuniq' END AS source,
    round(l_discount * 100) / CAST(10 AS DOUBLE) AS completeness, CAST(l_quantity AS BIGINT) AS n_chars FROM lineitem)"""


#: The same in Spark, whose cast cuts off what SQL's cast rounds, halves to even.
_ROUNDED_PLACE = _PLACE.replace("CAST(l_quantity AS BIGINT)", "CAST(rint(l_quantity) AS BIGINT)")


def _parses(spark: SparkSession, sf_dir: str) -> DataFrame:
    routes = F.array(F.lit("embedded"), F.lit("cloud"), F.lit("local"))
    return _t(spark, sf_dir, "lineitem").select(
        "l_orderkey", F.expr(_ROUNDED_PLACE).alias("place"), F.element_at(routes, (F.col("l_linenumber") % 3 + 1).cast("int")).alias("route"),
        F.when(F.col("l_suppkey") % 2 == 0, "tanita").otherwise("accuniq").alias("source"),
        (F.round(F.col("l_discount").cast("double") * 100) / 10.0).alias("completeness"), F.col("l_quantity").cast("long").alias("n_chars"))


@query(f"""WITH {_PARSES} SELECT l_orderkey, place, completeness FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey ORDER BY completeness DESC, place) = 1""")
def best_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's lines, as parses, the most complete one."""
    return consensus.best_parse(_parses(spark, sf_dir), "l_orderkey", "completeness", "place").select("l_orderkey", "place", "completeness")


@query(f"""WITH {_PARSES}, b AS (SELECT * FROM p QUALIFY row_number() OVER (PARTITION BY l_orderkey, route ORDER BY completeness DESC, place) = 1),
k AS (SELECT DISTINCT l_orderkey FROM p),
j AS (SELECT k.l_orderkey, e.place AS ep, c.place AS cp, l.place AS lp, e.n_chars > 40 AND e.completeness >= CASE e.source WHEN 'tanita' THEN 0.9 ELSE 0.75 END AS at_hand,
    c.completeness >= CASE c.source WHEN 'tanita' THEN 0.75 ELSE 0.65 END OR (c.source = l.source AND c.completeness > l.completeness) AS by_cloud
    FROM k LEFT JOIN b e ON e.l_orderkey = k.l_orderkey AND e.route = 'embedded' LEFT JOIN b c ON c.l_orderkey = k.l_orderkey AND c.route = 'cloud'
    LEFT JOIN b l ON l.l_orderkey = k.l_orderkey AND l.route = 'local')
SELECT l_orderkey, CASE WHEN at_hand THEN ep WHEN by_cloud THEN cp ELSE coalesce(lp, cp) END AS place FROM j
WHERE CASE WHEN at_hand THEN ep WHEN by_cloud THEN cp ELSE coalesce(lp, cp) END IS NOT NULL""")
def extraction_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of an order's lines, as parses of three routes, the one that the cascade ends with."""
    return consensus.cascade(_parses(spark, sf_dir), "l_orderkey").select("l_orderkey", "place")


@query(f"""WITH s AS (SELECT l_orderkey, path, min(place * 10 + nth) AS first FROM (SELECT l_orderkey, {_PLACE} AS place, unnest([l_returnflag, l_linestatus, CAST(l_suppkey % 5 AS VARCHAR)]) AS path, unnest([0, 1, 2]) AS nth FROM lineitem) GROUP BY 1, 2)
SELECT l_orderkey, string_agg(path, ',' ORDER BY first) AS paths FROM s GROUP BY 1""")
def path_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What an order's lines list, each once, in order."""
    lines = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_ROUNDED_PLACE).alias("place"), F.array("l_returnflag", "l_linestatus", (F.col("l_suppkey") % 5).cast("string")).alias("paths"))
    return consensus.path_union(lines, "l_orderkey", "paths", "place").select("l_orderkey", F.when(F.size("paths") > 0, F.array_join("paths", ",")).alias("paths"))


@query("""WITH s AS (SELECT o_custkey AS k, min_by(o_orderkey, (o_orderdate, o_orderkey)) AS existing_id FROM orders WHERE o_orderkey % 4 = 0 GROUP BY 1)
SELECT o_orderkey, existing_id FROM orders LEFT JOIN s ON k = o_custkey WHERE o_orderkey % 4 <> 0""")
def existing_upload(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first stored order of the same customer, for orders that come in."""
    orders = _t(spark, sf_dir, "orders")
    stored = orders.where("o_orderkey % 4 = 0").select(F.col("o_orderkey").alias("id"), "o_custkey", F.struct("o_orderdate", "o_orderkey").alias("seq"))
    return merge.existing_upload(orders.where("o_orderkey % 4 <> 0"), stored, "o_custkey", "seq").select("o_orderkey", "existing_id")


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(SQL)


#: Bars of receipts drawn for suppliers (k): where each ends, and its ticks' shift.
_DRAWN = {"fat_percent": "45 + (k * 7) % 100", "bmi": "45 + (k * 13) % 100", "muscle_mass": "45 + (k * 17) % 170", "bmr": "CASE WHEN k % 4 = 0 THEN NULL ELSE 45 + (k * 29) % 170 END"}
_SHIFT = "k % 5 - 2"
_WIDE, _HIGH, _HEADER = 250, 700, (340, 347)


def _drawn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Images of receipts as lines of pixels: a header, four bars with a mark at their right end, and ticks."""
    k, y = F.col("k"), F.col("y")
    # suppliers fit one split, their images do not
    rows = _t(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("k")).repartition(4 * spark.sparkContext.defaultParallelism, "k").withColumn("y", F.explode(F.sequence(F.lit(0), F.lit(_HIGH - 1))))
    light, dark = (lambda n, c=c: F.repeat(F.lpad(F.hex(c), 2, "0"), n.cast("int") if isinstance(n, Column) else F.lit(n)) for c in (200 + k % 40, k % 30))
    line = F.when(y.between(*_HEADER), dark(_WIDE))
    for i, name in enumerate(raster.BARS):
        if name:
            top, end = int(_HEADER[1] + (raster.FIRST_BAR + raster.NEXT_BAR * i) * _WIDE), F.expr(_DRAWN[name])
            line = line.when(y.between(top, top + 9) & end.isNotNull(), F.concat(light(8), dark(end - 7), light(235 - end), dark(7), light(7)))
            sections = 4 if name in ("fat_percent", "bmi") else 3
            at = [8 + int(234 * s / sections + 0.5) + F.expr(_SHIFT) for s in range(1, sections)]
            gaps = [at[0], *(b - a - 1 for a, b in zip(at[:-1], at[1:], strict=True))]
            line = line.when(y.between(top + 13, top + 18), F.concat(*(x for gap in gaps for x in (light(gap), dark(1))), light(_WIDE - 1 - at[-1])))
    return rows.select(k.alias("image"), "y", F.unhex(line.otherwise(light(_WIDE))).alias("line"))


def _read_bars_sql(position: str, most: int, ticks: bool, rest: str) -> str:
    """Readings of the bars drawn: names, ends and levels are given, positions and sections worked out."""
    bars = " UNION ALL ".join(f"SELECT s_suppkey AS k, '{name}' AS name, {end.replace('k', 's_suppkey')} AS e, {4 if name in ('fat_percent', 'bmi') else 3} AS n FROM supplier" for name, end in _DRAWN.items())
    tick = "CAST(floor(CAST(234 AS DOUBLE) * s / n + CAST(0.5 AS DOUBLE)) + (k % 5 - 2) AS DOUBLE) / 234" if ticks else "CAST(s AS DOUBLE) / n"
    bounds = f"list_concat([CAST(0 AS DOUBLE)], list_concat(list_transform(range(1, n), lambda s: {tick}), [CAST(1 AS DOUBLE)]))"
    return f"""WITH b AS ({bars}),
p AS (SELECT CAST(k AS BIGINT) AS image, name, CASE n WHEN 4 THEN ['-', '0', '+', '++'] ELSE ['-', '0', '+'] END AS levels, {position} AS p, {bounds} AS bounds FROM b WHERE e IS NOT NULL),
s AS (SELECT *, list_position(list_transform(bounds[2:], lambda x: p < x), true) AS i FROM p),
r AS (SELECT *, CAST(greatest(0, least({most}, floor((p - bounds[i]) / (bounds[i + 1] - bounds[i]) * 100 / 5 + CAST(0.5 AS DOUBLE)) * 5)) AS INTEGER) AS section_percent FROM s)
SELECT image, name, levels[i] AS level, section_percent, levels[i] || ': ' || section_percent || '%' AS reading, floor(p * 1000 + CAST(0.5 AS DOUBLE)) / CAST(1000 AS DOUBLE) AS position, {rest} FROM r"""


@query(_read_bars_sql("CAST(e - 6 AS DOUBLE) / 236", 100, False, "CAST(0.99 AS DOUBLE) AS confidence, 'layout' AS locator"))
def indicator_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars found below the header of images and read by their place in the line."""
    return raster.indicators(_drawn(spark, sf_dir))


@query(_read_bars_sql("CAST(e - 8 AS DOUBLE) / 234", 95, True, "CAST(0.8 AS DOUBLE) AS confidence"))
def refined_bars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bars read between their ends and by the ticks between their sections."""
    return raster.refined(_drawn(spark, sf_dir))


_PLACED = "row_number() OVER (PARTITION BY l_orderkey ORDER BY CAST(round(l_extendedprice * 100) AS BIGINT), l_linenumber, l_partkey, l_quantity)"


@query(f"""WITH RECURSIVE v AS (SELECT l_orderkey, l_quantity AS v, {_PLACED} AS i FROM lineitem),
f AS (
    SELECT l_orderkey, i, [[v]] AS groups, 1 AS g FROM v WHERE i = 1
    UNION ALL
    SELECT l_orderkey, i, CASE WHEN p = 0 THEN list_append(groups, [v]) ELSE list_transform(groups, lambda x, k: CASE WHEN k = p THEN list_append(x, v) ELSE x END) END, CASE WHEN p = 0 THEN len(groups) + 1 ELSE p END
    FROM (SELECT v.*, f.groups, coalesce(list_position(list_transform(f.groups, lambda x: abs(v.v - list_aggregate(x, 'median')) <= 10), true), 0) AS p
          FROM f JOIN v ON v.l_orderkey = f.l_orderkey AND v.i = f.i + 1))
SELECT l_orderkey, i AS place, CAST(g - 1 AS BIGINT) AS cluster FROM f""")
def greedy_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Lines of an order join the first group whose median quantity is near, in order of their price."""
    rows = _t(spark, sf_dir, "lineitem").select("l_orderkey", F.expr(_PLACED).cast("long").alias("place"), "l_quantity")
    return raster.greedy_clusters(rows, ["l_orderkey"], "place", "l_quantity").select("l_orderkey", "place", "cluster")


_PRINTED = ("INDICATOR", "FAT %", "BMI 22", "VISCERAL FAT RATING", "MUSCLE MASS", "BMR", "PHYSIQUE RATING", "other words")


def _label_anchors_sql() -> str:
    sql, last = "", "h"
    for k, (name, text) in enumerate(zip((n for n, _ in raster.LABELS), _PRINTED[1:7], strict=True)):
        sql += f",\nc{k} AS (SELECT {last}.o, {last}.c, {last}.found, min(l.n) AS x FROM {last} LEFT JOIN l ON l.o = {last}.o AND l.n > {last}.c AND l.t = '{text}' GROUP BY ALL)"
        sql += f",\nd{k} AS (SELECT o, coalesce(x, c) AS c, CASE WHEN x IS NULL THEN found ELSE list_append(found, {{'name': '{name}', 'n': x}}) END AS found FROM c{k})"
        last = f"d{k}"
    return f"""WITH l AS (SELECT l_orderkey AS o, {_PLACED} AS n, [{", ".join(f"'{t}'" for t in _PRINTED)}][CAST((l_partkey + l_linenumber) % 8 + 1 AS INTEGER)] AS t FROM lineitem
    UNION ALL SELECT o_orderkey, 0, 'INDICATOR' FROM orders),
h AS (SELECT o, min(n) AS c, CAST([] AS STRUCT(name VARCHAR, n BIGINT)[]) AS found FROM l WHERE t = 'INDICATOR' GROUP BY o){sql},
u AS (SELECT o, found, unnest(range(1, len(found) + 1)) AS i FROM {last})
SELECT o AS l_orderkey, found[i].name AS name, CAST(10 * found[i].n + 8 AS DOUBLE) AS bottom, CAST(10 * found[i + 1].n AS DOUBLE) AS next_top FROM u WHERE found[i].name IN ('fat_percent', 'bmi', 'muscle_mass', 'bmr')"""


@query(_label_anchors_sql())
def label_anchors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels of an order's lines, as lines of text under a heading, in the order they are printed in."""
    texts = F.array(*map(F.lit, _PRINTED))
    lines = _t(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("image"), F.expr(_PLACED).cast("long").alias("place"), F.get(texts, (F.col("l_partkey") + F.col("l_linenumber")) % 8).alias("text"))
    heads = _t(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("image"), F.lit(0).cast("long").alias("place"), F.lit("INDICATOR").alias("text"))
    placed = lines.union(heads).withColumn("top", (F.col("place") * 10).cast("double")).withColumn("bottom", F.col("top") + 8)
    return raster.anchors(placed).select(F.col("image").alias("l_orderkey"), "name", "bottom", "next_top")
