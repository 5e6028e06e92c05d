"""Incremental builds: which targets are up to date, from fingerprints of what they depend on, as tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from waymark.streaming import events as ev
from waymark.session import shared_dir

from . import motion
from . import tables as t


def plan(targets: DataFrame, routes: DataFrame, needs: DataFrame, state: DataFrame) -> DataFrame:
    """(target, status, fingerprint): hit, rebuild, blocked or skip.

    targets: target, requested, builder; routes: route, sha256, version, complete; needs: target, route; state: target,
    fingerprint, present. A fingerprint covers the builder and every route that the target needs, in order of name; a
    missing or incomplete route blocks.
    """
    deps = needs.join(routes, "route", "left").withColumn("_d", F.concat_ws("|", "route", "version", "sha256"))
    deps = deps.groupBy("target").agg(F.array_join(F.sort_array(F.collect_list("_d")), "\n").alias("_deps"), F.min(F.coalesce("complete", F.lit(False))).alias("_whole"))
    p = targets.join(deps, "target", "left").withColumn("fingerprint", F.when(F.coalesce("_whole", F.lit(True)), F.sha2(F.concat_ws("\n", "target", "builder", "_deps"), 256)))
    s = state.select("target", F.col("fingerprint").alias("_old"), "present")
    same = F.coalesce((F.col("_old") == F.col("fingerprint")) & F.col("present"), F.lit(False))
    status = F.when(~F.col("requested"), "skip").when(F.col("fingerprint").isNull(), "blocked").when(same, "hit").otherwise("rebuild")
    return p.join(s, "target", "left").select("target", status.alias("status"), F.when(F.col("requested"), F.col("fingerprint")).alias("fingerprint"))


def g30_build_plan(spark: SparkSession, d: str) -> DataFrame:
    """Parts as targets, suppliers as routes that lines tie to them: which parts are up to date."""
    part, line, supp = (t.table(spark, d, n) for n in ("part", "lineitem", "supplier"))
    targets = part.select(F.col("p_partkey").alias("target"), (F.col("p_partkey") % 10 != 0).alias("requested"), F.col("p_brand").alias("builder"))
    routes = supp.select(F.col("s_suppkey").alias("route"), F.sha2("s_name", 256).alias("sha256"), (F.col("s_suppkey") % 3).alias("version"), (F.col("s_suppkey") % 40 != 7).alias("complete"))
    needs = line.select(F.col("l_partkey").alias("target"), F.col("l_suppkey").alias("route")).distinct()
    fresh = plan(targets, routes, needs, spark.createDataFrame([], "target long, fingerprint string, present boolean"))
    old = fresh.select("target", F.when(F.col("target") % 4 == 1, F.lit("old")).otherwise(F.col("fingerprint")).alias("fingerprint"), (F.col("target") % 7 != 3).alias("present")).where("fingerprint IS NOT NULL")
    return plan(targets, routes, needs, old)


G30 = """WITH need AS (SELECT DISTINCT l_partkey AS target, l_suppkey AS route FROM lineitem),
dep AS (SELECT target, string_agg(s_suppkey || '|' || (s_suppkey % 3) || '|' || sha256(s_name), chr(10) ORDER BY s_suppkey || '|' || (s_suppkey % 3) || '|' || sha256(s_name)) AS deps, bool_and(s_suppkey % 40 <> 7) AS ok
  FROM need JOIN supplier ON s_suppkey = route GROUP BY target),
p AS (SELECT p_partkey AS target, p_partkey % 10 <> 0 AS requested, CASE WHEN coalesce(ok, true) THEN sha256(concat_ws(chr(10), CAST(p_partkey AS VARCHAR), p_brand, deps)) END AS fp FROM part LEFT JOIN dep ON target = p_partkey)
SELECT target, CASE WHEN NOT requested THEN 'skip' WHEN fp IS NULL THEN 'blocked' WHEN target % 4 <> 1 AND target % 7 <> 3 THEN 'hit' ELSE 'rebuild' END AS status, CASE WHEN requested THEN fp END AS fingerprint FROM p"""


def _events(spark: SparkSession, d: str) -> DataFrame:
    s = ev.stream_of(spark, d, "events", t.table(spark, d, "events").schema)
    return s.select("event_id", F.col("user_id").alias("unit"), (F.unix_micros(F.col("ts").cast("timestamp")) / 1e6).alias("t"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_type").alias("kind"), "value")


def _folder(spark: SparkSession) -> str:
    return f"{shared_dir(spark)}/stream-{spark.sql('SELECT uuid()').first()[0]}"


def st_windows(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream: tumbling hours that a watermark closes, drained to a table (2.12, A22). All hours but those still open."""
    w = ev.drained(ev.windowed(_events(spark, d), "ts", "value", "1 hour", "10 minutes"), _folder(spark))
    return w.select(F.date_format("start", "yyyy-MM-dd HH:mm:ss").alias("start"), "n", F.round("avg", 6).alias("avg"), "max")


ST_WINDOWS = """SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H:%M:%S') AS start, count(*) AS n, round(avg(value), 6) AS avg, max(value) AS max FROM events
GROUP BY date_trunc('hour', ts) HAVING date_trunc('hour', ts) + INTERVAL 1 HOUR <= (SELECT max(ts) - INTERVAL 10 MINUTE FROM events)"""


def st_accepted(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream whose times run back now and then: what is late for its unit goes (F17, 2.12)."""
    s = _events(spark, d).withColumn("t", F.col("t") - (F.col("event_id") % 7) * 40_000)
    return ev.drained(ev.accepted(s), _folder(spark)).select("event_id", "unit")


ST_ACCEPTED = f"""WITH {t.OBSERVATIONS}, a AS (SELECT event_id, unit, t - (event_id % 7) * 40000 AS t FROM obs),
m AS (SELECT *, max(t) OVER (PARTITION BY unit ORDER BY event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS l FROM a) SELECT event_id, unit FROM m WHERE l IS NULL OR t >= l"""


def st_offences(spark: SparkSession, d: str) -> DataFrame:
    """The events as a stream through the offence states (G17): a fold per unit, as the batch form has it."""
    s = _events(spark, d).select("event_id", "unit", "t", (F.col("kind") != "view").alias("current"), (F.col("value") > 60).alias("offence"), (F.col("kind") == "signup").alias("complied"))
    return ev.drained(ev.offences(s, handoff_s=3600.0), _folder(spark))


QUERIES = {"G30_build_plan": g30_build_plan, "ST_windows": st_windows, "ST_accepted": st_accepted, "ST_offences": st_offences}
SQL = {"ST_offences": motion.G17, "G30_build_plan": G30, "ST_windows": ST_WINDOWS, "ST_accepted": ST_ACCEPTED}
