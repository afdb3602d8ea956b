"""Queries on fields, texts, features and evaluation, each with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from marlstone.functions import net
from marlstone.functions.text import joined_text, numeric_text, utc_text
from marlstone.functions.times import context_time
from marlstone.operators import fields, indicators, model, orgs, policy, profile, signals, subcategories
from marlstone.operators.federated import evaluate, unknown_labels
from marlstone.plans.logs import _flows
from marlstone.plans.words import _PREDICTED, HIERARCHY, _State
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


@query("SELECT o_orderkey, concat_ws(' ', o_orderstatus, CASE WHEN o_custkey % 4 <> 0 THEN o_orderpriority END) AS text FROM orders")
def row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    o = o.select("o_orderkey", "o_orderstatus", F.when(F.col("o_custkey") % 4 != 0, F.col("o_orderpriority")).otherwise("  ").alias("o_orderpriority"))
    return o.select("o_orderkey", joined_text(orgs.text_columns(o.columns, ["o_orderstatus", "o_orderpriority"])).alias("text"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN CAST(user_id AS VARCHAR) WHEN 1 THEN CAST(user_id AS VARCHAR) WHEN 2 THEN user_id || '.5' END AS port FROM events")
def numeric_canonical(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id") % 4, F.col("user_id").cast("string")
    text = F.when(k == 0, F.concat(u, F.lit(".0"))).when(k == 1, F.concat(F.lit(" "), u)).when(k == 2, F.concat(u, F.lit(".5"))).otherwise(" ")
    e = table(spark, sf_dir, "events").select("event_id", text.alias("port"))
    return e.select("event_id", numeric_text("port", F.col("port"), F.col("event_id")).alias("port"))


_MAPPED = """WITH o AS (SELECT o_orderkey AS k, CASE WHEN o_custkey % 5 = 0 THEN '' ELSE lower(o_orderstatus) END AS status, replace(lower(o_orderpriority), ' ', '_') AS priority, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'clerk_' || o_custkey % 7 END AS clerk FROM orders)"""


def _log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    return o.select("o_orderkey", F.when(F.col("o_custkey") % 5 == 0, " ").otherwise(F.col("o_orderstatus")).alias("status"), F.concat(F.lit(" "), "o_orderpriority").alias("prio"), F.when(F.col("o_orderkey") % 3 == 0, F.lit(None)).otherwise(F.concat(F.lit("Clerk "), (F.col("o_custkey") % 7).cast("string"))).alias("clerk"))


_MAPPING = {"state": ["status"], "user": ["clerk", "absent"], "severity": ["prio"]}


@query(_MAPPED + """ SELECT k AS o_orderkey, n AS name, v AS value FROM (SELECT k, unnest(['state', 'status', 'user', 'clerk', 'severity', 'prio']) AS n, unnest([status, status, clerk, clerk, priority, priority]) AS v FROM o) WHERE v <> ''""")
def canonical_field_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fields.with_fields(_log(spark, sf_dir), _MAPPING)
    return wide.select("o_orderkey", F.explode(fields.canonical_map(_MAPPING)).alias("name", "value"))


@query(_MAPPED + """ SELECT k AS o_orderkey, 'clerk=' || clerk || ' prio=' || priority || ' status=' || status AS event FROM o""")
def normalised_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = _log(spark, sf_dir)
    pairs = fields.sorted_fields(wide.columns, ("o_orderkey",))
    return wide.select("o_orderkey", F.concat_ws(" ", F.transform(pairs, lambda p: F.concat(p["name"], F.lit("="), p["value"]))).alias("event"))


_NORMAL_SQL = (
    _MAPPED
    + """, f AS (SELECT k, unnest(['state', 'status', 'user', 'clerk', 'severity', 'prio']) AS n, unnest([status, status, clerk, clerk, priority, priority]) AS v FROM o),
t AS (SELECT k, n || '=' || v AS token FROM f WHERE v <> '' UNION SELECT k, n || ':' || p FROM (SELECT k, n, v, unnest(regexp_extract_all(v, '[a-z0-9]{2,}')) AS p FROM f) WHERE p <> v)"""
)


@query(_NORMAL_SQL + " SELECT k AS o_orderkey, count(*) AS tokens, sum(length(token))::BIGINT AS letters, bool_or(token LIKE 'clerk=%') AS by_clerk FROM t GROUP BY k")
def normalised_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    wide = fields.normalised(fields.with_fields(_log(spark, sf_dir), _MAPPING), _MAPPING)
    return wide.select("o_orderkey", F.size("token_counts").cast("long").alias("tokens"), F.aggregate(F.map_keys("token_counts"), F.lit(0), lambda a, t: a + F.length(t)).cast("long").alias("letters"), (F.size(F.filter(F.split("normalized_text", " "), lambda t: t.startswith("clerk="))) > 0).alias("by_clerk"))


def _rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A log of network, system and identity columns made of the events."""
    k, u = F.col("event_id"), F.col("user_id")
    return table(spark, sf_dir, "events").select(
        k.alias("row"), F.when(u % 3 > 0, F.concat(F.lit("10.0."), (u % 50).cast("string"), F.lit(".1"))).alias("src_ip"), F.when(k % 2 == 0, F.lit("443")).otherwise(" ").alias("dst_port"),
        F.concat(F.lit("Proc "), (u % 5).cast("string"), F.lit(".exe")).alias("process_name"), u.cast("string").alias("user_uid"), F.when(F.col("event_type") == "error", "Login Failed").otherwise("-").alias("login_result"), F.lit("x").alias("label"),
    )


_ROWS_SQL = """WITH r AS (SELECT event_id AS row, CASE WHEN user_id % 3 > 0 THEN '10.0.' || user_id % 50 || '.1' ELSE '' END AS src_ip, CASE WHEN event_id % 2 = 0 THEN '443' ELSE '' END AS dst_port,
  'proc_' || user_id % 5 || '.exe' AS process_name, CAST(user_id AS VARCHAR) AS user_uid, CASE WHEN event_type = 'error' THEN 'login_failed' ELSE '-' END AS login_result FROM events),
c AS (SELECT * FROM (VALUES ('network', 'src_ip'), ('network', 'dst_port'), ('identity', 'src_ip'), ('identity', 'user_uid'), ('identity', 'login_result'), ('cloud', 'src_ip'), ('cloud', 'user_uid'), ('system', 'process_name'), ('system', 'user_uid'), ('llm', 'user_uid')) v(subcategory, n)),
f AS (SELECT row, 'src_ip' AS n, src_ip AS v FROM r UNION ALL SELECT row, 'dst_port', dst_port FROM r UNION ALL SELECT row, 'process_name', process_name FROM r UNION ALL SELECT row, 'user_uid', user_uid FROM r UNION ALL SELECT row, 'login_result', login_result FROM r),
t AS (SELECT row, n, n || '=' || v AS token FROM f WHERE v <> '' UNION SELECT row, n, n || ':' || p FROM (SELECT row, n, v, unnest(regexp_extract_all(v, '[a-z0-9]{2,}')) AS p FROM f) WHERE p <> v)
"""


@query(_ROWS_SQL + "SELECT row, subcategory, string_agg(token, ' ' ORDER BY token COLLATE C) AS tokens FROM t JOIN c USING (n) GROUP BY row, subcategory".replace(" COLLATE C", ""))
def subcategory_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = subcategories.tokens(_rows(spark, sf_dir), "row", [s for s in subcategories.COLUMNS if s != "cross"], minutes=0)
    return found.where(F.size("tokens") > 0).select("row", "subcategory", F.concat_ws(" ", F.array_sort("tokens")).alias("tokens"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'free 198.51.100.' || user_id % 250 ELSE 'domain=' || event_type || '.example.org sha256=' || sha256(CAST(user_id AS VARCHAR)) END AS text FROM events")
def ioc_row_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, u = F.col("event_id") % 3 == 0, F.col("user_id").cast("string")
    e = table(spark, sf_dir, "events").select("event_id", F.when(~k, F.concat(F.lit(" "), "event_type", F.lit(".example.org"))).alias("domain"), F.when(~k, F.sha2(u, 256)).alias("sha256"), F.concat(F.lit("free 198.51.100."), (F.col("user_id") % 250).cast("string")).alias("message"))
    return e.select("event_id", indicators.log_text(e.columns, "message").alias("text"))


@query("""SELECT event_id AS row_index, indicator_type, indicator_value, CASE WHEN event_id % 4 = 0 THEN 'kept' ELSE event_type END AS predicted_label, CASE WHEN event_id % 4 = 0 THEN 0.5 ELSE 0.25 END AS max_risk_probability
FROM (SELECT event_id, event_type, unnest(['ipv4', 'domain']) AS indicator_type, unnest(['203.0.113.' || user_id % 200, event_type || '.example.org']) AS indicator_value FROM events WHERE event_type IN ('error', 'signup'))""")
def ioc_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """High-risk rows looked up in the raw rows, with what their explanations (the last of each id) say."""
    e, k = table(spark, sf_dir, "events"), F.col("event_id")
    logs = e.select(F.lit(0).alias("org_index"), k.alias("row_index"), F.concat(F.lit("203.0.113."), (F.col("user_id") % 200).cast("string")).alias("dst_ip"), F.concat("event_type", F.lit(".example.org")).alias("domain"))
    some = e.where("event_type in ('error', 'signup')").select(F.lit(0).alias("org_index"), k.alias("row_index"), orgs.internal_id(F.lit(0), k).alias("internal_log_id"), F.when(k % 4 == 0, F.lit("kept")).alias("predicted_label"), F.when(k % 4 == 0, 0.5).alias("max_risk_probability"), k.alias("order"))
    told = e.select(orgs.internal_id(F.lit(0), k).alias("internal_log_id"), "event_type", F.explode(F.array(F.lit(1), F.lit(2))).alias("order"))
    told = told.select("internal_log_id", F.when(F.col("order") == 2, F.col("event_type")).otherwise("older").alias("predicted_label"), F.lit(0.25).alias("max_risk_probability"), F.array(F.lit("x")).alias("top_contributions"), "order")
    return indicators.records(some, logs, told).select("row_index", "indicator_type", "indicator_value", "predicted_label", "max_risk_probability")


_LAST_SQL = "SELECT indicator_value, max(event_id) AS row_index FROM (SELECT event_id, event_type || '.example.org' AS indicator_value FROM events) GROUP BY indicator_value"


@query(_LAST_SQL)
def ioc_bundle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One STIX object for each indicator, of the last record that has it."""
    k = F.col("event_id")
    e = table(spark, sf_dir, "events").select(F.lit(0).alias("org_index"), k.alias("row_index"), F.concat("event_type", F.lit(".example.org")).alias("domain"), orgs.internal_id(F.lit(0), k).alias("internal_log_id"), F.lit("error").alias("predicted_label"), F.lit(0.9).alias("max_risk_probability"), k.alias("order"))
    found = indicators.records(e.drop("domain"), e.select("org_index", "row_index", "domain"))
    made = F.from_json("object", "name string, x_row_index long")
    return indicators.bundle(found).select(made.alias("o")).select(F.substring_index("o.name", ":", -1).alias("indicator_value"), F.col("o.x_row_index").alias("row_index"))


@query("SELECT l.event_id, CASE WHEN l.event_id % 10 = 0 THEN 'MALFORMED_ROW' ELSE 'UNKNOWN_CATEGORY' END AS reason_code, CASE WHEN l.event_id % 10 = 0 THEN 'malformed' ELSE 'unknown' END AS category FROM events l")
def malformed_guard(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = policy.load_policy({"version": 1, "organization_id": "org", "default_timezone": "UTC", "field_mappings": {"user": ["nobody"]}})
    e = table(spark, sf_dir, "events").select("event_id", (F.col("event_id") % 10 == 0).alias("malformed"))
    kept = policy.forwarded(policy.with_decision(e, rules))
    return kept.select("event_id", "decision.reason_code", "decision.category")


_DATED = {
    "version": 1,
    "organization_id": "org",
    "default_timezone": "UTC",
    "field_mappings": {"timestamp": ["time"], "host": ["host"], "user": ["user"], "program": ["program"]},
    "system_policies": [{"policy_id": "dated", "valid_from": "2024-01-10", "valid_until": "2024-01-20T12:00:00Z", "hosts": ["h"], "authorized_identities": [{"identity_id": "i", "users": ["u"], "allowed_programs": [{"name": "p"}]}]}],
}


@query("SELECT event_id, CASE WHEN event_id % 8 = 0 THEN 'INVALID_TIMESTAMP' WHEN date_trunc('second', ts) BETWEEN TIMESTAMP '2024-01-10' AND TIMESTAMP '2024-01-20 12:00:00' THEN 'ALLOWED' ELSE 'OUTSIDE_AUTHORIZED_TIME' END AS reason_code FROM events")
def validity_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    time = F.when(F.col("event_id") % 8 == 0, "soon").otherwise(F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    e = table(spark, sf_dir, "events").select("event_id", time.alias("time"), F.lit("H").alias("host"), F.lit("U").alias("user"), F.lit("P").alias("program"))
    return policy.with_decision(e, policy.load_policy(_DATED)).select("event_id", "decision.reason_code")


@query("SELECT event_id, event_type IN ('click', 'view') OR event_type = 'error' AND event_id % 2 = 0 AS in_six, CASE WHEN event_id % 2 = 0 THEN '2001:db8:0:7::/64' ELSE '192.0.2.0/24' END AS zone FROM events")
def ipv6_networks(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, kind = F.col("event_id"), F.col("event_type")
    ip = F.when(kind.isin("click", "view"), F.concat(F.lit("2001:db8:5::"), F.conv((k % 65536).cast("string"), 10, 16))).when((kind == "error") & (k % 2 == 0), F.lit("2001:DB8:5:ffff::1")).otherwise("2001:db8:6::1")
    end = F.when(k % 2 == 0, F.concat(F.lit("[2001:db8:0:7::"), F.conv((k % 9).cast("string"), 10, 16), F.lit("]:443"))).otherwise(F.concat(F.lit("192.0.2."), (k % 256).cast("string"), F.lit(":80")))
    e = table(spark, sf_dir, "events").select("event_id", ip.alias("ip"), end.alias("end"))
    return e.select("event_id", net.in_networks(F.col("ip"), ["2001:db8:5::/48"]).alias("in_six"), net.network_zone(F.col("end")).alias("zone"))


@query("SELECT o_custkey % 5 AS low, n, value FROM (SELECT o_custkey % 5, lower(o_orderstatus) AS value, count(*) AS n FROM orders GROUP BY ALL) t(o_custkey, value, n) WHERE false UNION ALL SELECT NULL, n, value FROM (SELECT CAST(o_custkey AS VARCHAR) AS value, count(*) AS n FROM orders GROUP BY o_custkey ORDER BY n DESC, value LIMIT 40)")
def bounded_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A field with more than twice as many values as are kept: the most frequent stay."""
    p = profile.learn(table(spark, sf_dir, "orders").select("o_custkey"), profile.Options(categorical=("o_custkey",), most_values=40))
    return p.values.select(F.lit(None).cast("long").alias("low"), "n", "value")


@query("SELECT event_id, CASE event_id % 5 WHEN 0 THEN 'MISSING' WHEN 1 THEN 'INVALID' WHEN 2 THEN 'CONFLICT' END AS issue, CASE WHEN event_id % 5 > 2 THEN strftime(date_trunc('second', ts), '%Y-%m-%dT%H:%M:%SZ') ELSE '' END AS utc FROM events")
def context_times(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, s = F.col("event_id") % 5, F.unix_seconds(F.col("ts").cast("timestamp"))
    iso = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss'Z'")
    e = table(spark, sf_dir, "events").select("event_id", F.when(k == 0, " ").when(k == 1, "-5").when(k == 2, (s + 2).cast("string")).when(k == 3, F.concat(s.cast("string"), F.lit(".0"))).alias("epoch"), F.when(k != 0, iso).alias("iso"))
    time, issue = context_time(F.col("epoch"), F.col("iso"))
    return e.select("event_id", issue.alias("issue"), utc_text(time).alias("utc"))


_SCOPED = {"host": "same_host", "user_uid": "same_user", "session_id": "same_session", "process_pid": "same_process_tree", "src_ip": "same_src_ip", "dst_ip": "same_dst_ip", "entity_id": "same_entity", "ProcessID": "same_process_pid", "parent_process": "same_parent_process", "network_zone": "same_network_zone"}
_SCOPE_ROWS = ", ".join(f"({i}, '{n}')" for i, n in enumerate(signals.SCOPES))


@query(f"""WITH s(i, scope) AS (VALUES {_SCOPE_ROWS}), e AS (SELECT event_id AS row, user_id AS u FROM events)
SELECT DISTINCT row, scope, value FROM (
SELECT row, 'same_host' AS scope, 'h_' || u % 9 AS value FROM e UNION ALL SELECT row, 'same_user', '0' || u FROM e UNION ALL SELECT row, 'same_session', CAST(u % 4 AS VARCHAR) FROM e
UNION ALL SELECT row, 'same_process_tree', CAST(u % 100 AS VARCHAR) FROM e UNION ALL SELECT row, 'same_process_tree', 'init' FROM e UNION ALL SELECT row, 'same_parent_process', 'init' FROM e UNION ALL SELECT row, 'same_process_pid', CAST(u % 100 AS VARCHAR) FROM e
UNION ALL SELECT row, 'same_src_ip', '10.0.0.' || u % 256 FROM e UNION ALL SELECT row, 'same_dst_ip', '192.0.2.' || row % 256 FROM e UNION ALL SELECT row, 'same_entity', 'e' || u % 3 FROM e UNION ALL SELECT row, 'same_entity', 'e1' FROM e
UNION ALL SELECT row, 'same_network_zone', 'name:dmz' FROM e WHERE row % 2 = 0 UNION ALL SELECT row, 'same_network_zone', '10.0.0.0/24' FROM e UNION ALL SELECT row, 'same_network_zone', '192.0.2.0/24' FROM e)""")
def scope_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every value under which a row can meet others, in all ten scopes."""
    k, u = F.col("event_id"), F.col("user_id")
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    e = table(spark, sf_dir, "events").select(k.alias("row"), text("H ", u % 9).alias("host"), text("0", u).alias("user_uid"), text(u % 4, ".0").alias("session_id"), text(u % 100).alias("process_pid"), text(" Init").alias("parent_process"), text("10.0.0.", u % 256).alias("src_ip"), text("192.0.2.", k % 256).alias("dst_ip"), text("E", u % 3).alias("entity_id"), F.lit("e1").alias("target_entity_id"), F.when(k % 2 == 0, "DMZ").alias("network_zone"))
    names = F.array(*map(F.lit, signals.SCOPES))
    return e.select("row", F.inline(signals.scopes(e.columns))).select("row", F.element_at(names, F.col("scope") + 1).alias("scope"), "value").distinct()


@query("SELECT lang AS org_index, source AS label, count(*) AS n FROM documents WHERE lang || source NOT IN (SELECT 'en' || source FROM documents) AND source NOT IN ('src1', 'src2') GROUP BY ALL")
def unknown_label_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents").select(F.col("lang").alias("org_index"), F.col("source").alias("label"))
    return unknown_labels(d.where("org_index <> 'en' or label is null"), spark.createDataFrame([("src1",), ("src2",)], "label string"))


_TRUE = ", y AS (SELECT doc_id, CASE WHEN toxic = 1 THEN 'toxic' WHEN quality = 1 THEN 'good' ELSE 'poor' END AS t FROM labels), z9 AS (SELECT lang AS org, (predicted_label = t)::INT AS ok FROM r JOIN y USING (doc_id) JOIN documents USING (doc_id))"


@query(_PREDICTED + _TRUE + " SELECT org, count(*) AS rows, round(avg(ok), 9) AS accuracy FROM z9 GROUP BY org UNION ALL SELECT 'all', count(*), round(avg(ok), 9) FROM z9")
def evaluate_by_org(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of the fused model joined with the true labels; accuracy by organisation and of all."""
    p = model.predictions(model.fused(_State(spark, sf_dir).logits, HIERARCHY, "doc_id"), 0.75, "doc_id")
    p = p.join(table(spark, sf_dir, "documents").select("doc_id", "lang"), "doc_id")
    truth = table(spark, sf_dir, "labels").select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 1, "good").otherwise("poor").alias("label"))
    accuracy, _ = evaluate(p, truth, ("doc_id",), "lang")
    return accuracy.select("org", "rows", F.round("accuracy", 9).alias("accuracy"))


def _all_signals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of 60 kinds, each with something that some signals look for."""
    k, u = F.col("event_id"), F.col("user_id")
    words = F.element_at(F.array(*map(F.lit, _WORDS)), (k % len(_WORDS) + 1).cast("int"))
    number = lambda n: (u % n).cast("string")
    return spread(table(spark, sf_dir, "events"), PIECE).select(
        k.alias("row"), words.alias("message"), F.when(k % 7 == 0, words).alias("process_command_line"), F.when(k % 11 == 0, words).alias("tool_name"), F.when(k % 13 == 0, F.lit("Outbound")).alias("direction"),
        F.element_at(F.array(*map(F.lit, _PORTS)), (u % len(_PORTS) + 1).cast("int")).alias("dst_port"), F.when(k % 5 == 0, F.concat(F.lit("203.0."), number(200), F.lit(".9"))).when(k % 5 == 1, F.concat(F.lit("10.0.0."), number(200))).alias("dst_ip"),
        F.when(k % 6 == 0, F.element_at(F.array(*map(F.lit, _DOMAINS)), (u % len(_DOMAINS) + 1).cast("int"))).alias("domain"), F.when(k % 9 == 0, F.lit("sni.example.org")).alias("tls_sni"), F.when(k % 10 == 0, F.lit("abc")).alias("ja3"),
        (u * 97 % 8000).cast("string").alias("total_size"), number(30).alias("connection_count"), number(14).alias("rate"), number(9).alias("failed_login_count"), number(70).alias("packet_number"), (u * 31 % 1200).cast("string").alias("duration"), number(8).alias("dns_query_count"), number(7).alias("dns_txt_count"), number(5).alias("tls_failure_count"),
        F.when(k % 4 == 0, F.lit("404")).alias("status"), F.when(k % 17 == 0, F.lit("4624")).alias("event_id"), F.when(k % 8 == 0, F.lit("ICMP")).alias("protocol"),
    )


_WORDS = ("quiet", "powershell -EncodedCommand x", "read_secret now", "cat notes", "denied again", "Accepted key", "bulk_download", "external_post", "POST https form upload", "new_domain", "rare_dst seen", "new_tls_sni", "dnscat", "type=txt", "NXDOMAIN", "dga", "beacon", "404_beacon", "fanout", "lateral move", "scan", "ssh login", "rdp", "smb share", "curl x", "password=1 http", "s3 put", "smtp_exfil", "icmp tunnel exfil", "handshake failure", "onion.onion", "bypass proxy", "rare_port", "geo_anomaly", "new_asn", "new_geo", "ja3 seen", "vpn up", "wallet.dat")
_PORTS = ("443", "22", "3389", "445", "8080", "25", "9001", "53", "5555", " ")
_DOMAINS = ("example.org", "a.b.c.d.e.f.example.org", "x9f3k2q8z7v1m4w6t5r0.example.net", "a1b2c3d4e5f6.example.com", "plain.example.net.")


def _values(items: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + x.lower().replace("'", "''") + "'" for x in items) + "]"


_SIGNALS_SQL = f"""
WITH e AS (SELECT event_id AS row, user_id AS u, ({_values(_WORDS)})[event_id % {len(_WORDS)} + 1] AS w, event_id AS k FROM events),
b AS (SELECT *, CASE WHEN k % 7 = 0 THEN w ELSE '' END AS cmd, CASE WHEN k % 11 = 0 THEN w ELSE '' END AS tool, k % 13 = 0 AS outward, trim(({_values(_PORTS)})[u % {len(_PORTS)} + 1]) AS port,
  CASE k % 5 WHEN 0 THEN '203.0.' || u % 200 || '.9' WHEN 1 THEN '10.0.0.' || u % 200 ELSE '' END AS ip, CASE WHEN k % 6 = 0 THEN ({_values(_DOMAINS)})[u % {len(_DOMAINS)} + 1] ELSE '' END AS dom, CASE WHEN k % 9 = 0 THEN 'sni.example.org' ELSE '' END AS sni, k % 10 = 0 AS ja,
  u * 97 % 8000 AS size, u % 30 AS conns, u % 14 AS rate, u % 9 AS fails, u % 70 AS packets, u * 31 % 1200 AS dur, u % 8 AS dnsq, u % 7 AS txt, u % 5 AS tlsf, k % 4 = 0 AS s404, k % 17 = 0 AS id4624, k % 8 = 0 AS icmp FROM e),
a AS (SELECT *, concat_ws(' ', CAST(row AS VARCHAR), w, nullif(cmd, ''), nullif(tool, ''), CASE WHEN outward THEN 'outbound' END, nullif(port, ''), nullif(ip, ''), nullif(dom, ''), nullif(sni, ''), CASE WHEN ja THEN 'abc' END,
  size, conns, rate, fails, packets, dur, dnsq, txt, tlsf, CASE WHEN s404 THEN '404' END, CASE WHEN id4624 THEN '4624' END, CASE WHEN icmp THEN 'icmp' END) AS t,
  ip LIKE '203.0.%' AND ip NOT LIKE '203.0.113.%' AS ext, dom IN ('x9f3k2q8z7v1m4w6t5r0.example.net', 'a1b2c3d4e5f6.example.com') AS random_name FROM b),
x AS (SELECT *, dom <> '' OR sni <> '' OR ext AS target, size >= 5000 AS upload, rate >= 10 OR t LIKE '%beacon%' AS beaconing, outward OR ip <> '' AS reach, regexp_matches(cmd, 'cookie|credential|key|password|secret|sensitive|token|wallet') AS sensitive FROM a)
SELECT row,
  regexp_matches(cmd, 'powershell|cmd\\.exe|encodedcommand| -enc |frombase64string') AS encoded_command, sensitive AS sensitive_file_read, sensitive AS system_sensitive_file_read, sensitive OR regexp_matches(t, 'read_secret|secret_read') AS secret_read_tool,
  regexp_matches(tool, 'cat |file_read|open_file|read_file|secret_read') AS llm_file_read_tool, regexp_matches(cmd, 'bruteforce|denied|failed login|failed_login|failure|login_failed') OR fails >= 5 AS failed_login_burst, id4624 AS successful_login,
  upload AS large_upload, upload OR t LIKE '%bulk_download%' AS bulk_download, target OR regexp_matches(t, 'external post|external_post') AS external_post,
  target AND (port = '443' OR regexp_matches(t, 'https|ssl|tls')) AND regexp_matches(t, 'post|put|upload') AS external_tls_post, ext AND t LIKE '%post%' AS http_post_to_ip, regexp_matches(t, 'new_domain|first_seen_domain') OR dom <> '' OR sni <> '' AS first_seen_domain,
  regexp_matches(t, 'new_destination|rare_destination|rare_dst') OR ext AS rare_destination_ip, regexp_matches(t, 'first_seen_sni|new_tls_sni') OR sni <> '' AS new_tls_sni, regexp_matches(t, 'dnscat|dns tunnel|dns_tunnel|iodine') OR dom = 'a.b.c.d.e.f.example.org' AS dns_tunnel_pattern,
  regexp_matches(t, 'type=txt|dns_txt| txt ') OR txt >= 5 AS dns_txt_query_burst, t LIKE '%nxdomain%' AND dnsq >= 5 AS dns_nxdomain_burst, regexp_matches(t, 'dga|domain_generation') OR random_name AS domain_generation_pattern, random_name AS high_entropy_domain,
  beaconing AS high_beacon_rate, regexp_matches(t, '404_beacon|repeated_404') OR (s404 AND beaconing) AS repeated_404_beacon, conns >= 20 OR t LIKE '%fanout%' AS high_connection_fanout, regexp_matches(t, 'lateral|east_west') AS east_west_connection_spike,
  t LIKE '%scan%' OR packets >= 50 AS internal_port_scan, dur >= 900 AS long_duration_flow, reach AND (port = '22' OR t LIKE '%ssh%') AS outbound_ssh, reach AND (port = '3389' OR t LIKE '%rdp%') AS outbound_rdp, port = '445' OR t LIKE '%smb%' AS smb_lateral_connection,
  regexp_matches(cmd, 'scanner|bot|powershell|go-http-client|python-requests|wget|curl') AS suspicious_user_agent, regexp_matches(t, 'cleartext_credential|api_key=|token=|passwd=|password=') AND (regexp_matches(t, 'http|post') OR port = '8080') AS cleartext_credential_post,
  regexp_matches(t, 'storage\\.googleapis|cloud_storage|gcs|blob|s3') AND (upload OR regexp_matches(t, 'post|put|upload')) AS cloud_storage_upload, (port = '25' OR regexp_matches(t, 'mail attachment|smtp upload|smtp_exfil')) AND (upload OR t LIKE '%exfil%') AS smtp_exfil_pattern,
  (icmp OR regexp_matches(t, 'icmp tunnel|icmp_tunnel')) AND (upload OR packets >= 50) AS icmp_tunnel_pattern, regexp_matches(t, 'tls fail|handshake failure|tls_handshake_failed') OR tlsf >= 3 AS failed_tls_handshake_burst, regexp_matches(t, '\\.onion|tor') OR port = '9001' AS tor_exit_connection,
  regexp_matches(t, 'direct_connection|bypass proxy|proxy_bypass') AS proxy_bypass_connection, port IN ('8080', '9001', '5555') OR regexp_matches(t, 'rare_port|unusual_dst_port') AS unusual_dst_port, regexp_matches(t, 'geo_anomaly|rare_country|unusual_country') AS unusual_country_destination,
  regexp_matches(t, 'new_external_asn|new_asn') AS new_external_asn, t LIKE '%new_geo%' AS new_geolocation, t LIKE '%ja3%' AND ja AS rare_ja3_fingerprint, t LIKE '%vpn%' AND (outward OR target) AS vpn_egress_connection
FROM x"""


@query(_SIGNALS_SQL)
def signal_detectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All 43 detectors on the same rows."""
    rows = signals.prepared(_all_signals(spark, sf_dir))
    return rows.select("row", *(c.alias(s) for s, c in signals.library(rows.columns).items()))


@query(
    """WITH f AS (SELECT event_id AS row, user_id % 3 = 0 AS secret, event_id % 10 = 0 AS coded, event_id % 4 = 0 AS ssh, event_id % 4 = 1 AS smb, value * 100 >= 5000 AS big FROM events),
l AS (SELECT row, unnest(list_filter([CASE WHEN coded THEN 'encoded_command' END, CASE WHEN secret THEN 'sensitive_file_read' END, CASE WHEN secret THEN 'secret_read_tool' END], lambda x: x IS NOT NULL)) AS a FROM f),
r AS (SELECT row, unnest(list_filter([CASE WHEN big THEN 'large_upload' END, CASE WHEN ssh THEN 'outbound_ssh' END, CASE WHEN smb THEN 'smb_lateral_connection' END, CASE WHEN coded THEN 'suspicious_user_agent' END, CASE WHEN secret THEN 'system_sensitive_file_read' END], lambda x: x IS NOT NULL)) AS b FROM f)
SELECT row, 'cross:' || a || '_and_' || b || '_' || s || '_15m' AS token FROM l JOIN r USING (row) CROSS JOIN (SELECT unnest(['same_host', 'same_dst_ip', 'same_network_zone']) AS s)"""
)
def row_cross_token_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return signals.row_tokens(_flows(spark, sf_dir)).select("row", F.explode("cross_tokens").alias("token"))


@query("""WITH n AS (SELECT s_suppkey, CASE s_suppkey % 3 WHEN 0 THEN 24 WHEN 1 THEN 16 ELSE 28 END AS len, s_suppkey % 200 AS b, s_suppkey * 7 % 256 AS c FROM supplier),
w AS (SELECT s_suppkey, '10.' || b || '.' || CASE len WHEN 16 THEN 0 ELSE c END || '.' || CASE len WHEN 28 THEN 32 ELSE 0 END || '/' || len AS cidr, len, b, c FROM n),
e AS (SELECT event_id, user_id % 200 AS b, event_id % 256 AS c, event_id * 3 % 256 AS d FROM events)
SELECT event_id, s_suppkey, cidr FROM e JOIN w ON e.b = w.b AND (w.len = 16 OR (w.len = 24 AND e.c = w.c) OR (w.len = 28 AND e.c = w.c AND e.d BETWEEN 32 AND 47))""")
def cidr_table_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses of events joined with a table of networks of three sizes."""
    k, key = F.col("event_id"), F.col("s_suppkey")
    text = lambda *p: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in p))
    size = F.when(key % 3 == 0, 24).when(key % 3 == 1, 16).otherwise(28)
    nets = table(spark, sf_dir, "supplier").select("s_suppkey", text("10.", key % 200, ".", F.when(size == 16, 0).otherwise(key * 7 % 256), ".", F.when(size == 28, 32).otherwise(0), "/", size).alias("cidr"))
    e = table(spark, sf_dir, "events").select("event_id", text("10.", F.col("user_id") % 200, ".", k % 256, ".", k * 3 % 256).alias("ip"))
    return net.join_networks(e, "ip", nets).select("event_id", "s_suppkey", "cidr")
