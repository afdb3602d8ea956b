"""Queries on the log-like tables: fields, filters, policies, collapsing, profiles, windows, indicators."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import net
from marlstone.functions.keyed import key_of
from marlstone.functions.text import canonical, compact_ranges, entropy, field_tokens, guarded, is_blank, number, utc_text
from marlstone.functions.times import Weekly, iso_time
from marlstone.operators import collapse as dup
from marlstone.operators import indicators, orgs, policy, profile, signals
from marlstone.operators.fields import resolved
from marlstone.sources.artifacts import scratch
from marlstone.sources.tables import PIECE, spread, table

QUERIES: dict = {}
ORACLE: dict = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


CANON = r"regexp_replace(lower(regexp_replace({0}, '^\s+|\s+$', '', 'g')), '\s+', '_', 'g')"


@query(f"SELECT c_custkey, {CANON.format('c_name')} AS name, {CANON.format('c_mktsegment')} AS segment, coalesce(trim(c_mktsegment), '') = '' AS no_segment FROM customer")
def canonical_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    return c.select("c_custkey", canonical(F.col("c_name")).alias("name"), canonical(F.col("c_mktsegment")).alias("segment"), is_blank(F.col("c_mktsegment")).alias("no_segment"))


@query("SELECT lang, count(*) AS n, count(*) FILTER (text IS NULL OR regexp_full_match(text, '\\s*')) AS missing, count(*) FILTER (source IS NULL OR trim(source) = '') AS no_source FROM documents GROUP BY lang")
def missing_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    blank = F.col("text").isNull() | ~F.col("text").rlike(r"\S")
    return d.groupBy("lang").agg(F.count("*").alias("n"), F.count_if(blank).alias("missing"), F.count_if(is_blank(F.col("source"))).alias("no_source"))


def _tokens_sql(name: str) -> str:
    v = CANON.format(name)
    return f"list_distinct(list_concat(['{name}=' || {v}], list_transform(list_filter(regexp_extract_all({v}, '[A-Za-z0-9]{{2,}}'), lambda x: x <> {v}), lambda x: '{name}:' || x)))"


@query(f"SELECT p_partkey, array_to_string(list_sort({_tokens_sql('p_name')}), ' ') AS name_tokens, array_to_string(list_sort({_tokens_sql('p_brand')}), ' ') AS brand_tokens FROM part")
def field_tokens_part(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", *(F.concat_ws(" ", F.array_sort(field_tokens(c, F.col(c)))).alias(a) for c, a in (("p_name", "name_tokens"), ("p_brand", "brand_tokens"))))


@query(
    """SELECT o_orderkey, CASE WHEN a <> '' AND b <> '' AND a <> b THEN NULL WHEN a <> '' THEN a WHEN b <> '' THEN b END AS value,
       CASE WHEN a <> '' AND b <> '' AND a <> b THEN NULL WHEN a <> '' THEN 'status' WHEN b <> '' THEN 'state' END AS source,
       CASE WHEN a <> '' AND b <> '' AND a <> b THEN 'status,state' ELSE '' END AS conflicts
FROM (SELECT o_orderkey, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE lower(o_orderstatus) END AS a, CASE c_nationkey % 3 WHEN 0 THEN '' WHEN 1 THEN lower(o_orderstatus) ELSE lower(left(c_mktsegment, 1)) END AS b
      FROM orders JOIN customer ON o_custkey = c_custkey)"""
)
def alias_conflict(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    n = F.col("c_nationkey") % 3
    log = o.join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", F.when(F.col("o_custkey") % 5 == 0, " ").otherwise(F.col("o_orderstatus")).alias("status"), F.when(n == 0, F.lit(None)).when(n == 1, F.concat(F.lit(" "), F.lower("o_orderstatus"))).otherwise(F.substring("c_mktsegment", 1, 1)).alias("state"))
    f = resolved(log.columns, ["status", "state", "absent"])
    return log.select("o_orderkey", f.alias("f")).select("o_orderkey", "f.value", "f.source", F.concat_ws(",", "f.conflicts").alias("conflicts"))


def _policy(event_id=None, severity=None, **more):
    base = {"version": 1, "organization_id": "org", "default_timezone": "UTC", "field_mappings": {"category": ["kind"]}}
    return policy.load_policy(base | {"prefilters": {k: v for k, v in (("event_id", event_id), ("severity", severity)) if v}} | more)


_PRE = _policy({"suppress_ids": [7, "0012"], "always_forward_ids": ["13.0"], "require_policy_match_for_suppression": False}, {"suppress_values": ["VIEW", "click"], "always_forward_values": ["error"], "require_policy_match_for_suppression": False})


@query(
    """SELECT event_id, CASE WHEN t IS NULL THEN 'EVENT_ID_MISSING' WHEN NOT regexp_full_match(t, '[A-Za-z0-9_.:-]+|[+-]?[0-9]+') THEN 'EVENT_ID_MALFORMED'
  WHEN n = '13' THEN 'EVENT_ID_ALWAYS_FORWARD' WHEN n IN ('7', '12') THEN 'EVENT_ID_SUPPRESS_MATCH' ELSE 'EVENT_ID_NEUTRAL' END AS code, n AS clean
FROM (SELECT event_id, t, CASE WHEN regexp_full_match(t, '[+-]?[0-9]+([.]0+)?') THEN CAST(CAST(CAST(t AS DOUBLE) AS BIGINT) AS VARCHAR) WHEN regexp_full_match(t, '[A-Za-z0-9_.:-]+') THEN t END AS n
FROM (SELECT event_id, CASE event_id % 11 WHEN 0 THEN NULL WHEN 1 THEN 'a b' WHEN 2 THEN '0' || (user_id % 20) || '.0' WHEN 3 THEN 'E-' || user_id ELSE CAST(user_id % 20 AS VARCHAR) END AS t FROM events))"""
)
def event_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id") % 11, F.col("user_id")
    text = F.when(k == 0, F.lit(" ")).when(k == 1, "a b").when(k == 2, F.concat(F.lit(" 0"), (u % 20).cast("string"), F.lit(".0"))).when(k == 3, F.concat(F.lit("E-"), u.cast("string"))).otherwise((u % 20).cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", text.alias("t"))
    clean = policy.event_id(F.col("t"))
    return e.select("event_id", policy.prefilter_verdict(F.col("t"), clean, _PRE.event_id, "EVENT_ID")["code"].alias("code"), clean.alias("clean"))


@query("SELECT event_id, CASE WHEN event_type = 'error' THEN 'SEVERITY_ALWAYS_FORWARD' WHEN event_type IN ('view', 'click') THEN 'SEVERITY_SUPPRESS_MATCH' ELSE 'SEVERITY_NEUTRAL' END AS code FROM events")
def severity_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, c = table(spark, sf_dir, "events"), F.upper("event_type")
    return e.select("event_id", policy.prefilter_verdict(c, policy.severity(c), _PRE.severity, "SEVERITY")["code"].alias("code"))


def log_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log made of the events: system rows, network rows, rows that are both and rows that are neither."""
    e, u, k = spread(table(spark, sf_dir, "events"), PIECE), F.col("user_id"), F.col("event_id")
    system, network = F.col("event_type").isin("view", "click", "signup"), F.col("event_type").isin("purchase", "signup")
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    return e.select(
        k.alias("event_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss").alias("event_time"), text("WS-", u % 5).alias("host"),
        F.when(system, text("User", u % 7)).alias("user"), F.when(system, F.when(k % 3 == 0, "Edit.exe").otherwise("shell.exe")).alias("process"),
        F.when(system, text("run --level ", k % 4)).alias("cmdline"), F.when(network, text("10.0.", u % 4, ".", k % 250)).alias("src_ip"),
        F.when(network, F.when(k % 5 == 0, text("93.184.", u % 3, ".7")).otherwise(text("192.0.2.", k % 200))).alias("dst_ip"), F.when(network, (F.lit(440) + k % 6).cast("string")).alias("dst_port"),
        F.when(network, F.when(k % 9 == 0, "UDP").otherwise("tcp")).alias("protocol"), F.when(network & (k % 2 == 0), F.lit("outbound")).alias("direction"),
    )


POLICY = policy.load_policy(
    {
        "version": 1,
        "organization_id": "org",
        "default_timezone": "UTC",
        "field_mappings": {"timestamp": ["event_time"], "host": ["host"], "user": ["user"], "program": ["process"], "command_line": ["cmdline"], "source_ip": ["src_ip"], "destination_ip": ["dst_ip"], "destination_port": ["dst_port"], "protocol": ["protocol"], "direction": ["direction"]},
        "system_policies": [
            {
                "policy_id": "sys",
                "hosts": ["ws-0", "WS-1", "ws-2"],
                "authorized_identities": [
                    {
                        "identity_id": "staff",
                        "users": ["user1", "user2", "user3"],
                        "authorized_time_windows": [{"days": ["mon", "tue", "wed", "thu", "fri"], "start": "08:00", "end": "18:00"}],
                        "allowed_programs": [{"name": "edit.exe"}, {"name": "shell.exe", "command_line": {"allowed_patterns": ["^run_--level_"], "prohibited_patterns": ["level_3$"]}}],
                    }
                ],
            }
        ],
        "network_policies": [
            {
                "policy_id": "net",
                "local_networks": ["10.0.0.0/23", "10.0.2.0/24"],
                "authorized_connections": [{"connection_id": "web", "direction": "outbound", "remote_cidrs": ["192.0.2.0/25", "93.184.0.0/16"], "protocols": ["tcp"], "destination_ports": ["440-443"]}],
            }
        ],
    },
    strict=True,
)

_DECIDED_SQL = """
WITH l AS (SELECT event_id AS k, user_id AS u, ts, event_type IN ('view', 'click', 'signup') AS s, event_type IN ('purchase', 'signup') AS n FROM events),
f AS (SELECT *, hour(ts) * 60 + minute(ts) AS m, isodow(ts) AS d,
  CASE WHEN k % 5 = 0 THEN true ELSE k % 200 < 128 END AS remote_ok, u % 4 < 3 AS local FROM l),
o AS (SELECT *,
  CASE WHEN u % 5 > 2 THEN 'UNAUTHORIZED_HOST' WHEN u % 7 NOT IN (1, 2, 3) THEN 'UNAUTHORIZED_USER'
       WHEN d > 5 OR m < 480 OR m > 1080 THEN 'OUTSIDE_AUTHORIZED_TIME' WHEN k % 3 = 0 THEN 'ALLOWED' WHEN k % 4 = 3 THEN 'COMMAND_LINE_POLICY_VIOLATION' ELSE 'ALLOWED' END AS sys,
  CASE WHEN NOT local THEN 'UNAUTHORIZED_LOCAL_IP' WHEN NOT remote_ok THEN 'UNAUTHORIZED_REMOTE_IP' WHEN k % 9 = 0 THEN 'UNAUTHORIZED_PROTOCOL' WHEN k % 6 > 3 THEN 'UNAUTHORIZED_PORT' ELSE 'ALLOWED' END AS net FROM f),
c AS (SELECT k AS event_id, CASE WHEN s AND n THEN 'system_and_network' WHEN s THEN 'system' WHEN n THEN 'network' ELSE 'unknown' END AS category,
  CASE WHEN s AND n THEN CASE WHEN sys = 'ALLOWED' THEN net ELSE sys END WHEN s THEN sys WHEN n THEN net ELSE 'UNKNOWN_CATEGORY' END AS reason_code,
  CASE WHEN s AND n THEN CASE WHEN sys = 'ALLOWED' AND net = 'ALLOWED' THEN 'sys,net' WHEN sys = 'ALLOWED' THEN 'net' ELSE 'sys' END WHEN s THEN 'sys' WHEN n THEN 'net' END AS matched_policy_id FROM o)
"""


@query(_DECIDED_SQL + "SELECT event_id, CASE WHEN reason_code = 'ALLOWED' THEN 'suppress' ELSE 'forward' END AS action, category, reason_code, matched_policy_id FROM c")
def policy_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = policy.with_decision(log_rows(spark, sf_dir), POLICY)
    return d.select("event_id", "decision.action", "decision.category", "decision.reason_code", "decision.matched_policy_id")


@query(_DECIDED_SQL + "SELECT reason_code, count(*) AS n, count(*) FILTER (reason_code <> 'ALLOWED') AS forwarded, round(count(*) / (SELECT count(*) FROM c), 9) AS share FROM c GROUP BY reason_code")
def policy_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return policy.summary(policy.with_decision(log_rows(spark, sf_dir), POLICY)).withColumn("share", F.round("share", 9))


_MERGE = _policy(None, {"suppress_values": ["view", "click"], "always_forward_values": ["error"], "require_policy_match_for_suppression": False}, field_mappings={"user": ["user"]})


@query("SELECT event_id, CASE WHEN event_type IN ('view', 'click') AND user_id % 2 = 0 THEN 'suppress' ELSE 'forward' END AS action, CASE WHEN event_type = 'error' THEN 'SEVERITY_ALWAYS_FORWARD' WHEN user_id % 2 = 1 THEN 'UNKNOWN_CATEGORY' WHEN event_type IN ('view', 'click') THEN 'ALLOWED' ELSE 'NO_APPLICABLE_POLICY' END AS reason_code FROM events")
def prefilter_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", "event_type", F.when(F.col("user_id") % 2 == 0, F.lit("someone")).alias("user"))
    d = policy.with_prefilters(policy.with_decision(e, _MERGE), _MERGE, severity_column="event_type")
    return d.select("event_id", "decision.action", "decision.reason_code")


def _window(w: Weekly):
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return table(spark, sf_dir, "events").where(w.contains(F.col("ts").cast("timestamp"))).select("event_id")

    return run


QUERIES["weekly_time_window"] = _window(Weekly(("mon", "wed", "fri"), "09:15", "17:30", "UTC"))
ORACLE["weekly_time_window"] = "SELECT event_id FROM events WHERE isodow(ts) IN (1, 3, 5) AND hour(ts) * 60 + minute(ts) BETWEEN 555 AND 1050"
QUERIES["overnight_window"] = _window(Weekly(("sat", "sun"), "22:00", "06:30", "UTC"))
ORACLE["overnight_window"] = "SELECT event_id FROM events WHERE (isodow(ts) IN (6, 7) AND hour(ts) >= 22) OR (isodow(ts) IN (7, 1) AND hour(ts) * 60 + minute(ts) <= 390)"


@query("SELECT event_id, t AS event_time, CASE WHEN event_id % 4 = 3 THEN '' ELSE strftime(ts, '%Y-%m-%dT%H:%M:%SZ') END AS utc FROM (SELECT *, CASE event_id % 4 WHEN 0 THEN strftime(ts, '%Y-%m-%dt%H:%M:%Sz') WHEN 1 THEN strftime(ts, '%Y-%m-%d_%H:%M:%S') WHEN 2 THEN strftime(ts + INTERVAL 2 HOUR, '%Y-%m-%d %H:%M:%S+02:00') ELSE strftime(ts, '%Y') END AS t FROM events)")
def event_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, ts = F.col("event_id") % 4, F.col("ts")
    text = F.when(k == 0, F.date_format(ts, "yyyy-MM-dd't'HH:mm:ss'z'")).when(k == 1, F.date_format(ts, "yyyy-MM-dd'_'HH:mm:ss")).when(k == 2, F.date_format(ts + F.expr("INTERVAL 2 HOUR"), "yyyy-MM-dd HH:mm:ss'+02:00'")).otherwise(F.date_format(ts, "yyyy"))
    return table(spark, sf_dir, "events").select("event_id", text.alias("event_time")).select("*", utc_text(iso_time(F.col("event_time"))).alias("utc"))


_HOST_SQL = "rtrim(regexp_replace(regexp_replace(lower(regexp_extract(url, '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', ''), '.')"


@query(f"SELECT page_id, host, host LIKE '%.example.com' OR host LIKE 'm.%.example.net' AND false OR host = 'm.example.net' AS matched FROM (SELECT page_id, {_HOST_SQL} AS host FROM pages) WHERE host <> ''")
def domain_match(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select("page_id", F.rtrim(indicators.url_host(F.col("url")), F.lit(".")).alias("host")).where("host <> ''")
    return p.select("*", net.matches_domain(F.upper("host"), ["*.Example.com", "m.example.net."]).alias("matched"))


@query("SELECT event_id, ip, user_id % 200 BETWEEN 0 AND 63 AND event_id % 256 < 300 AS in_net, user_id % 200 = 70 AND event_id % 256 BETWEEN 16 AND 31 AS in_small FROM (SELECT *, '10.1.' || (user_id % 200) || '.' || (event_id % 256) AS ip FROM events)")
def cidr_range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    ip = F.concat(F.lit("10.1."), (F.col("user_id") % 200).cast("string"), F.lit("."), (F.col("event_id") % 256).cast("string"))
    e = table(spark, sf_dir, "events").select("event_id", ip.alias("ip"))
    return e.select("*", net.in_networks(F.col("ip"), ["10.1.0.0/18"]).alias("in_net"), net.in_networks(F.col("ip"), ["10.1.70.16/28"]).alias("in_small"))


@query("SELECT event_id, CASE WHEN p BETWEEN 0 AND 65535 THEN p END AS port, p IN (443, 22) OR p BETWEEN 1000 AND 2000 AS matched FROM (SELECT event_id, CAST(event_id * 37 % 70000 AS INT) AS p FROM events)")
def port_range(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.concat((F.col("event_id") * 37 % 70000).cast("string"), F.when(F.col("event_id") % 2 == 0, ".0").otherwise(""))
    return table(spark, sf_dir, "events").select("event_id", net.port(p).alias("port"), net.in_ports(p, ["443", 22, "1000-2000"]).alias("matched"))


def _collapse_sql(key: str, order: str, micros: int) -> str:
    return f"""
WITH RECURSIVE e AS (SELECT {key} AS k, {order} AS r, epoch_us(ts) AS t FROM events),
p AS (SELECT *, max(t) OVER (ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS p, max(t) OVER (PARTITION BY k ORDER BY r ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS top FROM e),
g AS (SELECT k, r, t, greatest(t, coalesce(p, t)) AS m, row_number() OVER (PARTITION BY k ORDER BY r) AS i FROM p WHERE top IS NULL OR t >= top),
w AS (SELECT k, i, r AS a, t AS f, r, t FROM g WHERE i = 1
  UNION ALL SELECT g.k, g.i, CASE WHEN g.m <= w.f + {micros} THEN w.a ELSE g.r END, CASE WHEN g.m <= w.f + {micros} THEN w.f ELSE g.t END, g.r, g.t FROM w JOIN g ON g.k = w.k AND g.i = w.i + 1),
u AS (SELECT k, a, r, t, NULL::VARCHAR AS issue FROM w UNION ALL SELECT k, r, r, t, 'AGGREGATION_OUT_OF_ORDER_TIMESTAMP' FROM p WHERE t < top)
SELECT k AS grp, min(r) AS source_row_number_first, max(r) AS source_row_number_last, count(*) AS occurrence_count, min(t) AS first_us, max(t) AS last_us, CASE WHEN count(*) > 1 THEN 'aggregated' ELSE 'individual' END AS aggregation_status, issue AS aggregation_issue FROM u GROUP BY k, a, issue"""


def _collapsed(events: DataFrame, minutes: float) -> DataFrame:
    out = dup.collapse(events, [F.col("grp")], "ts", "events", "r", minutes)
    micros = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    return out.select("grp", "source_row_number_first", "source_row_number_last", "occurrence_count", micros("first_seen").alias("first_us"), micros("last_seen").alias("last_us"), "aggregation_status", "aggregation_issue")


@query(_collapse_sql("event_type || user_id % 3", "event_id", 900_000_000))
def dup_collapse_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat("event_type", (F.col("user_id") % 3).cast("string")).alias("grp"), F.col("event_id").alias("r"), "ts")
    return _collapsed(e, 15)


@query(_collapse_sql("'u' || user_id % 40", "event_id + 25 * (event_id % 7)", 7_200_000_000))
def dup_collapse_late(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(F.concat(F.lit("u"), (F.col("user_id") % 40).cast("string")).alias("grp"), (F.col("event_id") + 25 * (F.col("event_id") % 7)).alias("r"), "ts")
    return _collapsed(e, 120)


@query(
    """WITH v AS (SELECT DISTINCT l_orderkey AS k, l_returnflag AS f, l_linenumber AS n FROM lineitem),
i AS (SELECT k, f, n, n - row_number() OVER (PARTITION BY k, f ORDER BY n) AS g FROM v), s AS (SELECT k, f, min(n) AS a, max(n) AS b FROM i GROUP BY k, f, g)
SELECT k AS l_orderkey, f AS l_returnflag, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE a || '-' || b END, ';' ORDER BY a) AS ranges FROM s GROUP BY k, f"""
)
def compact_row_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").groupBy("l_orderkey", "l_returnflag").agg(compact_ranges(F.collect_list("l_linenumber")).alias("ranges"))


_NUMBERS = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


def _rounded(stats: DataFrame, keep: list[str]) -> DataFrame:
    return stats.select(*keep, "count", *(F.round(c, 4).alias(c) for c in ("minimum", "maximum", "mean", "deviation")))


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, count({c}) AS count, round(min({c}), 4) AS minimum, round(max({c}), 4) AS maximum, round(avg({c}), 4) AS mean, round(stddev_pop({c}), 4) AS deviation FROM lineitem" for c in _NUMBERS))
def numeric_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = profile.learn(table(spark, sf_dir, "lineitem").select(*_NUMBERS), profile.Options(numeric=_NUMBERS))
    return _rounded(p.stats, ["field"])


@query(" UNION ALL ".join(f"SELECT '{c}' AS field, {CANON.format(c)} AS value, count(*) AS n FROM orders GROUP BY ALL HAVING count(*) >= 5" for c in ("o_orderstatus", "o_orderpriority")))
def categorical_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = ("o_orderstatus", "o_orderpriority")
    p = profile.learn(table(spark, sf_dir, "orders").select(*fields), profile.Options(categorical=fields, categorical_minimum=5))
    return p.values.select("field", "value", "n")


@query("SELECT * FROM (VALUES ('p_partkey', 'numeric'), ('p_size', 'numeric'), ('p_retailprice', 'numeric'), ('p_type', 'categorical'), ('p_brand', 'categorical'), ('p_name', (SELECT CASE WHEN count(DISTINCT p_name) <= 30 THEN 'categorical' ELSE 'text' END FROM part))) t(field, kind)")
def type_inference(spark: SparkSession, sf_dir: str) -> DataFrame:
    return profile.learn(table(spark, sf_dir, "part"), profile.Options(most_values=30)).stats.select("field", "kind")


@query(
    """WITH s AS (SELECT CAST(l_suppkey AS VARCHAR) AS k, l_quantity AS v FROM lineitem)
SELECT '' AS scope, count(v) AS count, round(min(v), 4) AS minimum, round(max(v), 4) AS maximum, round(avg(v), 4) AS mean, round(stddev_pop(v), 4) AS deviation FROM s
UNION ALL SELECT '["' || k || '"]', count(v), round(min(v), 4), round(max(v), 4), round(avg(v), 4), round(stddev_pop(v), 4) FROM s GROUP BY k HAVING count(*) >= 20"""
)
def entity_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    l = table(spark, sf_dir, "lineitem").select("l_suppkey", "l_quantity")
    p = profile.learn(l, profile.Options(entity=("l_suppkey",), numeric=("l_quantity",), entity_minimum=20, most_entities=1 << 30))
    return _rounded(p.stats, ["scope"])


@query(
    """WITH e AS (SELECT event_id, CAST(user_id AS VARCHAR) AS u, event_type AS t, value AS v, event_type <> 'error' AND event_id % 3 > 0 AS good FROM events),
b AS (SELECT * FROM e WHERE good), k AS (SELECT u FROM b GROUP BY u HAVING count(*) >= 30),
n AS (SELECT '' AS s, min(v) AS lo, max(v) AS hi, avg(v) AS m, stddev_pop(v) AS d FROM b UNION ALL SELECT u, min(v), max(v), avg(v), stddev_pop(v) FROM b WHERE u IN (FROM k) GROUP BY u),
c AS (SELECT '' AS s, t FROM b GROUP BY t HAVING count(*) >= 2 UNION ALL SELECT u, t FROM b WHERE u IN (FROM k) GROUP BY u, t HAVING count(*) >= 2),
x AS (SELECT e.*, coalesce(k.u, '') AS s FROM e LEFT JOIN k USING (u)),
y AS (SELECT x.event_id, x.s, (x.s = '')::INT AS stranger, (c.t IS NULL)::INT AS novel, (x.v < n.lo OR x.v > n.hi OR (n.d > 0 AND abs(x.v - n.m) / n.d > 3))::INT AS far FROM x JOIN n ON n.s = x.s LEFT JOIN c ON c.s = x.s AND c.t = x.t)
SELECT event_id, CAST(stranger + novel + far AS DOUBLE) AS anomaly_score, stranger + novel + far >= 1 AS is_anomaly, CASE WHEN s = '' THEN 'global' ELSE 'entity' END AS profile_scope,
  array_to_string(list_filter([CASE WHEN stranger = 1 THEN 'UNKNOWN_ENTITY' END, CASE WHEN novel = 1 THEN 'UNKNOWN_CATEGORICAL_VALUE' END, CASE WHEN far = 1 THEN 'NUMERIC_OUTSIDE_BENIGN_PROFILE' END], lambda z: z IS NOT NULL), ',') AS codes FROM y"""
)
def anomaly_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = spread(table(spark, sf_dir, "events"), PIECE).select("event_id", "user_id", "event_type", "value", F.when((F.col("event_type") != "error") & (F.col("event_id") % 3 > 0), " BENIGN").otherwise("attack").alias("label"))
    o = profile.Options(entity=("user_id",), categorical=("event_type",), numeric=("value",), ignored=("event_id", "label"), categorical_minimum=2, entity_minimum=30, most_entities=1 << 30, deviations=3.0)
    path = scratch(spark, "profile")
    profile.learn(profile.benign(e, "label"), o).save(path)  # learned once, then used as it is stored
    scored = profile.score(e, profile.Profile.load(spark, path), "event_id")
    return scored.select("event_id", "anomaly_score", "is_anomaly", "profile_scope", F.concat_ws(",", F.transform("evidence", lambda x: x["reason_code"])).alias("codes"))


def _logins(spark: SparkSession, sf_dir: str) -> DataFrame:
    kind = F.col("event_type")
    what = F.when(kind == "error", "LOGIN_FAILED").when(kind == "signup", "accepted")
    return spread(table(spark, sf_dir, "events"), PIECE).select(F.col("event_id").alias("row"), F.col("user_id").cast("string").alias("user_uid"), what.alias("login_result"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("event_time_iso"))


def _pairs_sql(minutes: int) -> str:
    return f"""
WITH e AS (SELECT event_id, user_id, ts, event_type = 'error' AS bad, event_type = 'signup' AS good FROM events WHERE event_type IN ('error', 'signup'))
SELECT DISTINCT a.event_id AS row, 'cross:failed_login_burst_and_successful_login_same_user_15m' AS cross_tokens FROM e a JOIN e b
ON a.user_id = b.user_id AND b.ts >= a.ts - INTERVAL {minutes} MINUTE AND (b.ts, b.event_id) < (a.ts, a.event_id) AND a.bad = b.good"""


@query(_pairs_sql(15))
def causal_pair_15m(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.context_tokens(_logins(spark, sf_dir), "row").withColumn("cross_tokens", F.concat_ws(" ", "cross_tokens"))


@query(_pairs_sql(1440))
def causal_pair_1d(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.context_tokens(_logins(spark, sf_dir), "row", minutes=1440).withColumn("cross_tokens", F.concat_ws(" ", "cross_tokens"))


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    e, k, u = spread(table(spark, sf_dir, "events"), PIECE), F.col("event_id"), F.col("user_id")
    return e.select(k.alias("row"), F.concat(F.lit("h"), (u % 9).cast("string")).alias("host"), F.concat(F.lit("203.0."), (u % 200).cast("string"), F.lit(".9")).alias("dst_ip"), F.when(k % 4 == 0, "22").when(k % 4 == 1, "445").otherwise("443").alias("dst_port"), (F.col("value") * 100).cast("string").alias("total_size"), F.concat(F.lit("open "), F.when(u % 3 == 0, "Password").otherwise("notes"), F.lit(".txt"), F.when(k % 10 == 0, " powershell -enc x").otherwise("")).alias("process_command_line"), F.lit("label secret").alias("label"))


@query(
    """WITH f AS (SELECT event_id AS row, user_id % 3 = 0 AS secret, event_id % 10 = 0 AS coded, event_id % 4 = 0 AS ssh, event_id % 4 = 1 AS smb, value * 100 >= 5000 AS big, user_id % 200 <> 113 AS ext FROM events)
SELECT row, coded AS encoded_command, secret AS sensitive_file_read, big AS large_upload, ssh AS outbound_ssh, smb AS smb_lateral_connection, ext AS rare_destination_ip, coded AS suspicious_user_agent FROM f"""
)
def signal_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = signals.prepared(_flows(spark, sf_dir))
    every = signals.library(f.columns)
    return f.select("row", *(every[s].alias(s) for s in ("encoded_command", "sensitive_file_read", "large_upload", "outbound_ssh", "smb_lateral_connection", "rare_destination_ip", "suspicious_user_agent")))


@query(
    """WITH f AS (SELECT event_id AS row, user_id % 3 = 0 AS secret, event_id % 10 = 0 AS coded, event_id % 4 = 0 AS ssh, event_id % 4 = 1 AS smb, value * 100 >= 5000 AS big FROM events),
l AS (SELECT row, unnest(list_filter([CASE WHEN coded THEN 'encoded_command' END, CASE WHEN secret THEN 'sensitive_file_read' END, CASE WHEN secret THEN 'secret_read_tool' END], lambda x: x IS NOT NULL)) AS a FROM f),
r AS (SELECT row, unnest(list_filter([CASE WHEN big THEN 'large_upload' END, CASE WHEN ssh THEN 'outbound_ssh' END, CASE WHEN smb THEN 'smb_lateral_connection' END, CASE WHEN coded THEN 'suspicious_user_agent' END, CASE WHEN secret THEN 'system_sensitive_file_read' END], lambda x: x IS NOT NULL)) AS b FROM f)
SELECT row, count(*) * 3 AS n_tokens FROM l JOIN r USING (row) GROUP BY row"""
)
def row_cross_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.row_tokens(_flows(spark, sf_dir)).select("row", F.size("cross_tokens").cast("long").alias("n_tokens")).where("n_tokens > 0")


@query(
    f"""WITH p AS (SELECT page_id, {_HOST_SQL} AS host, regexp_extract(url, '^https?://[^/]*/([a-z][a-z])/', 1) AS org, url LIKE 'http://%' AS good FROM pages),
b AS (SELECT DISTINCT org, host FROM p WHERE good AND host <> '')
SELECT page_id, host <> '' AND (org, host) NOT IN (FROM b) AND org IN (SELECT org FROM b) AS novel FROM p"""
)
def rare_value_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    url = F.col("url")
    p = table(spark, sf_dir, "pages").select("page_id", url.alias("domain"), F.regexp_extract(url, "^https?://[^/]*/([a-z][a-z])/", 1).alias("org_index"), F.when(url.startswith("http://"), "benign").otherwise("other").alias("label"))
    key = key_of(42)
    new = signals.with_novelty(p, signals.baseline(p, key), key, "page_id")
    return new.select("page_id", F.array_contains("__novel", "domains").alias("novel"))


@query(f"""WITH h AS (SELECT DISTINCT {_HOST_SQL} AS host FROM pages WHERE url IS NOT NULL), c AS (SELECT host, unnest(string_split(regexp_replace(host, '[^a-z0-9]', '', 'g'), '')) AS x FROM h WHERE host <> ''),
n AS (SELECT host, x, count(*) AS k FROM c WHERE x <> '' GROUP BY ALL), s AS (SELECT host, sum(k) AS total FROM n GROUP BY host)
SELECT host, round(-sum(k / total * log2(k / total)), 6) AS bits FROM n JOIN s USING (host) GROUP BY host""")
def high_entropy_domain(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = table(spark, sf_dir, "pages").where("url is not null").select(F.rtrim(indicators.url_host(F.col("url")), F.lit(".")).alias("host")).where("host <> ''").distinct()
    return h.select("host", F.round(entropy(F.col("host")), 6).alias("bits"))


_IOC_SQL = f"""
WITH u AS (SELECT page_id, regexp_replace(unnest(regexp_extract_all(url, '(?i)https?://[^\\s"''<>]+')), '^[.,;:)\\]}}''"]+|[.,;:)\\]}}''"]+$', '', 'g') AS v FROM pages),
h AS (SELECT page_id, v, regexp_replace(regexp_replace(lower(regexp_extract(v, '^[A-Za-z]+://([^/?#]*)', 1)), '^.*@', ''), ':[0-9]*$', '') AS host FROM u),
k AS (SELECT *, CASE WHEN regexp_full_match(host, '((25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])[.]){{3}}(25[0-5]|2[0-4][0-9]|[01]?[0-9]?[0-9])') THEN 'ipv4' WHEN regexp_full_match(host, '([a-z0-9]([a-z0-9-]*[a-z0-9])?[.])+[a-z]{{2,63}}') THEN 'domain' END AS kind FROM h),
i AS (SELECT DISTINCT page_id, 'url' AS indicator_type, v AS indicator_value FROM k WHERE kind IS NOT NULL UNION SELECT page_id, kind, host FROM k WHERE kind IS NOT NULL)
"""


def _page_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.inline(indicators.extract(F.col("url"))))


@query(_IOC_SQL + "SELECT * FROM i")
def ioc_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_iocs(spark, sf_dir)


@query(_IOC_SQL + "SELECT indicator_type, count(*) AS count FROM i GROUP BY indicator_type")
def ioc_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.counts(_page_iocs(spark, sf_dir))


@query()
def ioc_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.inline(indicators.extract(F.col("text"))))


@query(
    _IOC_SQL
    + """, s AS (SELECT DISTINCT indicator_type, indicator_value, sha1(from_hex('7ad079d258654d7a9f467c4cf70aa1f3') || encode('indicator:' || indicator_type || ':' || indicator_value)) AS x FROM i)
SELECT indicator_type, indicator_value, 'indicator--' || x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || substr('89ab', CAST(('0x' || x[17:17])::INT % 4 + 1 AS INT), 1) || x[18:20] || '-' || x[21:32] AS indicator_id FROM s"""
)
def stix_indicator_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _page_iocs(spark, sf_dir).select("indicator_type", "indicator_value").distinct().withColumn("indicator_id", indicators.stix_id("indicator", F.concat_ws(":", "indicator_type", "indicator_value")))


_LOW_SQL = _IOC_SQL.replace("WITH u AS", ", u2 AS").replace("h AS (", "h2 AS (").replace("k AS (", "k2 AS (").replace("i AS (", "i2 AS (").replace("FROM u)", "FROM u2)").replace("FROM h)", "FROM h2)").replace("FROM k ", "FROM k2 ").replace("all(url", "all(lower(url)")
_SIDES_SQL = _IOC_SQL + _LOW_SQL + """, a AS (SELECT DISTINCT indicator_type, indicator_value FROM i), b AS (SELECT DISTINCT indicator_type, indicator_value FROM i2),
c AS (SELECT coalesce(a.indicator_type, b.indicator_type) AS indicator_type, count(a.indicator_value) AS test_count, count(b.indicator_value) AS truth_count, count(*) FILTER (a.indicator_value IS NOT NULL AND b.indicator_value IS NOT NULL) AS in_both
  FROM a FULL JOIN b ON a.indicator_type = b.indicator_type AND a.indicator_value = b.indicator_value GROUP BY 1)
"""


def _compared(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Indicators of all addresses as they are, against those of all addresses in lower case."""
    low = table(spark, sf_dir, "pages").select(F.inline(indicators.extract(F.lower("url"))))
    return indicators.compare(_page_iocs(spark, sf_dir), low)


@query(_SIDES_SQL + "SELECT *, test_count - in_both AS only_in_test, truth_count - in_both AS only_in_truth FROM c")
def indicator_set_compare(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)


@query(_SIDES_SQL + ", s AS (SELECT sum(in_both) AS t, sum(test_count - in_both) AS x, sum(truth_count - in_both) AS y FROM c) SELECT t::BIGINT AS true_positives, x::BIGINT AS false_positives, y::BIGINT AS false_negatives, round(t / (t + x), 9) AS precision, round(t / (t + y), 9) AS recall, round(2 * t / (2 * t + x + y), 9) AS f1 FROM s")
def indicator_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = indicators.quality(_compared(spark, sf_dir))
    return q.select("true_positives", "false_positives", "false_negatives", *(F.round(c, 9).alias(c) for c in ("precision", "recall", "f1")))


def _html_iocs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", F.inline(indicators.extract(F.col("html"))))


@query()
def ioc_html(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _html_iocs(spark, sf_dir)


@query()
def indicator_set_compare_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the html of all pages has, against what all their addresses have."""
    return indicators.compare(_html_iocs(spark, sf_dir), _page_iocs(spark, sf_dir))


@query()
def indicator_quality_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    return indicators.quality(indicator_set_compare_whole(spark, sf_dir))


@query(
    """WITH i AS (SELECT DISTINCT CAST(o_custkey AS VARCHAR) AS id FROM orders), g AS (SELECT id, 'org_' || ((row_number() OVER (ORDER BY sha256('42|' || id), id) - 1) % 4 + 1) AS org FROM i),
r AS (SELECT o_orderkey, a.org AS x, b.org AS y FROM orders LEFT JOIN g a ON a.id = CAST(o_custkey AS VARCHAR) LEFT JOIN g b ON o_orderkey % 2 = 0 AND b.id = CAST(o_custkey + o_orderkey % 3 AS VARCHAR))
SELECT o_orderkey, CASE WHEN y IS NULL OR x = y THEN x END AS org, CASE WHEN y IS NULL OR x = y THEN 'kept' ELSE 'inter_org' END AS fate FROM r"""
)
def org_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    o = table(spark, sf_dir, "orders").select("o_orderkey", c.cast("string").alias("normalized_id"), F.when(k % 2 == 0, (c + k % 3).cast("string")).otherwise(" NaN ").alias("entity_id"))
    return orgs.split_rows(o, orgs.org_of_ids(o, 4), "o_orderkey")


@query("SELECT event_id, event_type, value FROM events")
def aligned_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return orgs.zipped(e.select("event_id", "event_type"), e.select("event_id", "value"), "event_id")


@query("SELECT event_id, CASE WHEN left(t, 1) IN ('=', '+', '-', '@') THEN '''' || t ELSE t END AS safe, CAST(CASE WHEN t LIKE '%=' THEN NULL ELSE try_cast(t AS DOUBLE) END AS DOUBLE) AS n FROM (SELECT event_id, CASE event_id % 5 WHEN 0 THEN '=' || event_type WHEN 1 THEN '-' || event_id WHEN 2 THEN '@' || event_type WHEN 3 THEN event_id || '.50' ELSE event_type END AS t FROM events)")
def guarded_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    t = F.when(k % 5 == 0, F.concat(F.lit("="), "event_type")).when(k % 5 == 1, F.concat(F.lit("-"), k.cast("string"))).when(k % 5 == 2, F.concat(F.lit("@"), "event_type")).when(k % 5 == 3, F.concat(k.cast("string"), F.lit(".50"))).otherwise(F.col("event_type"))
    return table(spark, sf_dir, "events").select("event_id", t.alias("t")).select("event_id", guarded(F.col("t")).alias("safe"), number(F.col("t")).alias("n"))


__all__ = ["ORACLE", "POLICY", "QUERIES", "log_rows", "reduce"]
