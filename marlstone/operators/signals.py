"""Signals of a row, the scopes it belongs to, and causal tokens of pairs of signals.

Every signal is a boolean Column over whatever of its columns are there.  A token
``cross:{left}_and_{right}_{scope}_15m`` is emitted for the row that closes a pair: one of the two signals is
the row's own, the other its own as well or that of an earlier row of the same scope value, up to 15 minutes before.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import net
from marlstone.functions.keyed import novelty_tag
from marlstone.functions.text import canonical, domain, entropy, finite, number_value, strip
from marlstone.functions.times import context_time

LEFT = tuple("encoded_command sensitive_file_read llm_file_read_tool failed_login_burst secret_read_tool".split())
RIGHT = tuple("large_upload external_post external_tls_post first_seen_domain rare_destination_ip dns_tunnel_pattern high_beacon_rate outbound_ssh outbound_rdp suspicious_user_agent http_post_to_ip domain_generation_pattern internal_port_scan smb_lateral_connection high_connection_fanout cleartext_credential_post cloud_storage_upload new_tls_sni successful_login system_sensitive_file_read".split())
SCOPES = tuple("same_host same_user same_session same_process_tree same_src_ip same_dst_ip same_entity same_process_pid same_parent_process same_network_zone".split())
TOKENS = tuple(f"cross:{a}_and_{b}_{s}_15m" for a in LEFT for b in RIGHT for s in SCOPES)
ACTIVE = LEFT + RIGHT
NOVELTY = {"first_seen_domain": ("domains",), "rare_destination_ip": ("destination_ips",), "new_tls_sni": ("snis",), "external_post": ("destination_ips", "domains", "snis")}
LABEL_COLUMNS = ("label", "sub_label", "sub_label_cat")
CHUNK_SECONDS = 86_400
TOGETHER = 4

_ADDRESSES = "remote_address remote_ip destination_ip dst_ip"
SCOPE_COLUMNS = {
    "same_host": "Computer computer_name device_id host hostname",
    "same_user": "UserID account_name identity principal user user_euid user_uid username",
    "same_session": "SessionID logon_id session_id",
    "same_process_tree": "parent parent_process process_pid process_ppid process_tgid",
    "same_src_ip": "local_address local_ip source_ip src_ip",
    "same_dst_ip": _ADDRESSES,
    "same_entity": "entity_id source_entity_id target_entity_id",
    "same_process_pid": "ProcessID process_pid",
    "same_parent_process": "parent parent_process process_ppid",
    "same_cloud_identity": "cloud_account cloud_identity managed_identity principal",
    "same_service_account": "ServiceName account_name cloud_identity service_account",
    "same_container": "container_id container_name pod_name",
    "same_cluster": "cluster cluster_name k8s_cluster",
    "same_cloud_account": "cloud_account cloud_provider cloud_region",
}
_PORTS = "src_port local_port remote_port destination_port dst_port"
_DOMAINS = "hostname_query tls_sni http_host query dns_query domain"
_NUMERIC = frozenset(f"{_PORTS} upload_bytes total_sum bytes_out total_size connection_rate beacon_rate drate srate rate failure_count auth_failure_count failed_login_count download_bytes bytes_in txt_query_count dns_txt_count nxdomain_count dns_query_count dst_count connection_count unique_dst_count fanout east_west_count internal_connection_count packet_number dst_port_count syn_count duration_ms duration flow_duration pkts_out failed_tls_count tls_failure_count".split())
ZONE_COLUMNS = f"{_ADDRESSES} local_address local_ip source_ip src_ip destination_endpoint source_endpoint endpoint"
_NAMES = {"domains": "hostname_query http_host query dns_query destination_domain domain", "snis": "sni tls_sni", "destination_ips": _ADDRESSES}


class Row:
    """Tests on the columns that are there; names are given with spaces in between.

    Texts, numbers and addresses are read from what ``prepared`` made of each column.
    """

    def __init__(self, columns: Sequence[str], v6: bool = False):
        self.columns, self.v6 = list(columns), v6

    def here(self, names: str) -> list[Column]:
        return [F.col(f"`{n}`").cast("string") for n in names.split() if n in self.columns]

    def made(self, kind: str, names: str) -> list[Column]:
        return [F.col(f"`__{kind}_{n}`") for n in names.split() if n in self.columns]

    def has(self, names: str, needles: str) -> Column:
        """One of the needles (separated by ``|``) occurs in the columns."""
        texts = self.made("low", names)
        return self._any(F.concat_ws(" ", *texts) if len(texts) > 1 else F.coalesce(*texts, F.lit("")), needles)

    def anywhere(self, needles: str) -> Column:
        """The same in all columns but the labels; the joined text is the column ``__all`` of ``prepared``."""
        return self._any(F.col("__all"), needles)

    @staticmethod
    def _any(text: Column, needles: str) -> Column:
        return reduce(Column.__or__, [text.contains(x) for x in needles.split("|")])

    def most(self, names: str) -> Column:
        values = [F.coalesce(c, F.lit(float("-inf"))) for c in self.made("number", names)]
        top = F.greatest(*values, F.lit(float("-inf"))) if values else F.lit(float("-inf"))
        return F.when(top == float("-inf"), 0.0).otherwise(top)

    def filled(self, names: str) -> Column:
        return reduce(Column.__or__, [c.isNotNull() for c in self.made("low", names)], F.lit(False))

    def port(self, *ports: int) -> Column:
        return reduce(Column.__or__, [F.coalesce(F.floor(c).isin(list(ports)), F.lit(False)) for c in self.made("number", _PORTS)], F.lit(False))

    def external(self, names: str) -> Column:
        return reduce(Column.__or__, [net.is_external(c, True) for c in self.here(names)] if self.v6 else [net.is_external_number(n) for n in self.made("v4", names)], F.lit(False))

    def domains(self) -> list[Column]:
        return self.made("domain", _DOMAINS)

    def target(self) -> Column:
        return self.filled("dns_query domain tls_sni http_host remote_address") | self.external(_ADDRESSES)

    def outbound(self) -> Column:
        return self.has("traffic_direction direction network_direction", "out|egress")

    def random_domain(self) -> Column:
        def one(d: Column) -> Column:
            longest = F.array_max(F.transform(F.split(d, r"\."), F.length))
            digits, bits = F.length(F.regexp_replace(d, "[^0-9]", "")), entropy(d)
            return F.coalesce(((longest >= 18) & (bits >= 3.3)) | ((digits >= 6) & (bits >= 3.0)), F.lit(False))

        return reduce(Column.__or__, map(one, self.domains()), F.lit(False))


def library(columns: Sequence[str], v6: bool = False) -> dict[str, Column]:
    """All the signals by name, as Columns over the result of ``prepared``."""
    r = Row(columns, v6)
    has, anywhere, most, port = r.has, r.anywhere, r.most, r.port
    sensitive = has("EventData.ImagePath tool_input llm_tool_input process_exe process_command_line file_path", "cookie|credential|key|password|secret|sensitive|token|wallet")
    upload = most("upload_bytes total_sum bytes_out total_size") >= 5000
    beacon = (most("connection_rate beacon_rate drate srate rate") >= 10) | anywhere("beacon")
    to_ip = r.external("remote_ip destination_ip dst_ip")
    reach = r.outbound() | r.filled("remote_address dst_ip")
    long_name = reduce(Column.__or__, [F.coalesce((F.length(d) >= 80) | (F.length(F.regexp_replace(d, r"[^.]", "")) >= 5), F.lit(False)) for d in r.domains()], F.lit(False))
    common = [3389, 995, 993, 587, 465, 445, 443, 143, 123, 110, 80, 53, 25, 22, 21, 20]
    odd_port = reduce(Column.__or__, [F.coalesce(~F.floor(c).isin(common), F.lit(False)) for c in r.made("number", "remote_port destination_port dst_port")], F.lit(False))
    return {
        "encoded_command": has("cmdline command_line process_exe process_name process_command_line", "powershell|cmd.exe|encodedcommand| -enc |frombase64string"),
        "sensitive_file_read": sensitive,
        "system_sensitive_file_read": sensitive,
        "secret_read_tool": sensitive | anywhere("read_secret|secret_read"),
        "llm_file_read_tool": has("tool_input tool_name llm_tool_input llm_tool_name", "cat |file_read|open_file|read_file|secret_read"),
        "failed_login_burst": has("event_name login_result process_command_line", "bruteforce|denied|failed login|failed_login|failure|login_failed") | (most("failure_count auth_failure_count failed_login_count") >= 5),
        "successful_login": has("event_name auth_result login_result", "accepted|success") | has("event_id eventid EventID", "4624"),
        "large_upload": upload,
        "bulk_download": (most("total_size download_bytes bytes_in") >= 5000) | anywhere("bulk_download"),
        "external_post": r.target() | anywhere("external post|external_post"),
        "external_tls_post": r.target() & (port(443) | anywhere("https|ssl|tls")) & anywhere("post|put|upload"),
        "http_post_to_ip": to_ip & anywhere("post"),
        "first_seen_domain": anywhere("new_domain|first_seen_domain") | r.filled("hostname_query tls_sni http_host query dns_query domain"),
        "rare_destination_ip": anywhere("new_destination|rare_destination|rare_dst") | to_ip,
        "new_tls_sni": anywhere("first_seen_sni|new_tls_sni") | r.filled("sni tls_sni"),
        "dns_tunnel_pattern": anywhere("dnscat|dns tunnel|dns_tunnel|iodine") | long_name,
        "dns_txt_query_burst": anywhere("type=txt|dns_txt| txt ") | (most("txt_query_count dns_txt_count") >= 5),
        "dns_nxdomain_burst": anywhere("nxdomain") & (most("nxdomain_count dns_query_count") >= 5),
        "domain_generation_pattern": anywhere("dga|domain_generation") | F.col("__random"),
        "high_entropy_domain": F.col("__random"),
        "high_beacon_rate": beacon,
        "repeated_404_beacon": anywhere("404_beacon|repeated_404") | (has("http_status status_code status", "404") & beacon),
        "high_connection_fanout": (most("dst_count connection_count unique_dst_count fanout") >= 20) | anywhere("fanout"),
        "east_west_connection_spike": anywhere("lateral|east_west") | (most("east_west_count internal_connection_count") >= 20),
        "internal_port_scan": anywhere("scan") | (most("packet_number dst_port_count syn_count") >= 50),
        "long_duration_flow": most("duration_ms duration flow_duration") >= 900,
        "outbound_ssh": reach & (port(22) | anywhere("ssh")),
        "outbound_rdp": reach & (port(3389) | anywhere("rdp")),
        "smb_lateral_connection": port(139, 445) | anywhere("admin$|c$|smb"),
        "suspicious_user_agent": has("process_command_line http_headers http_user_agent user_agent", "scanner|bot|powershell|go-http-client|python-requests|wget|curl"),
        "cleartext_credential_post": anywhere("cleartext_credential|api_key=|token=|passwd=|password=") & (anywhere("http|post") | port(80, 8080)),
        "cloud_storage_upload": anywhere("storage.googleapis|cloud_storage|gcs|blob|s3") & (upload | anywhere("post|put|upload")),
        "smtp_exfil_pattern": (port(25, 465, 587) | anywhere("mail attachment|smtp upload|smtp_exfil")) & (upload | anywhere("exfil")),
        "icmp_tunnel_pattern": (has("proto protocol_name protocol", "icmp") | anywhere("icmp tunnel|icmp_tunnel")) & (upload | (most("pkts_out packet_number") >= 50)),
        "failed_tls_handshake_burst": anywhere("tls fail|handshake failure|tls_handshake_failed") | (most("failed_tls_count tls_failure_count") >= 3),
        "tor_exit_connection": anywhere(".onion|tor") | port(9001, 9030, 9050, 9150),
        "proxy_bypass_connection": anywhere("direct_connection|bypass proxy|proxy_bypass"),
        "unusual_dst_port": odd_port | anywhere("rare_port|unusual_dst_port"),
        "unusual_country_destination": anywhere("geo_anomaly|rare_country|unusual_country"),
        "new_external_asn": anywhere("new_external_asn|new_asn"),
        "new_geolocation": anywhere("new_geo"),
        "rare_ja3_fingerprint": anywhere("ja3") & r.filled("tls_ja3 ja3_fingerprint ja3"),
        "vpn_egress_connection": anywhere("vpn") & (r.outbound() | r.target()),
    }


def prepared(df: DataFrame) -> DataFrame:
    """Add what the signals read: each column as lower-case text, null if blank, and as number, address or domain, and all texts joined.

    Each is made once, in a projection below those that use it; written out in every signal that looks at a column they
    would cost many times the signals.
    """
    names = df.columns
    text, r = {c: F.col(f"`{c}`").cast("string") for c in names}, Row(names)
    wide = df.withColumns({f"__low_{c}": F.when(strip(t) != "", F.lower(t)) for c, t in text.items()})
    low = {c: F.col(f"`__low_{c}`") for c in names}
    shown = [low[c] for c in names if c.lower() not in LABEL_COLUMNS]
    added = {"__all": F.concat_ws(" ", *shown) if shown else F.lit("")}
    added |= {f"__number_{c}": number_value(low[c]) for c in names if c in _NUMERIC}
    added |= {f"__v4_{c}": net.ipv4(low[c]) for c in names if c in _ADDRESSES.split()}
    added |= {f"__domain_{c}": F.rtrim(strip(low[c]), F.lit(".")) for c in names if c in _DOMAINS.split()}
    wide = wide.withColumns(added)
    numbers = {f"__number_{c}": finite(F.col(f"`__number_{c}`")) for c in names if c in _NUMERIC}
    return wide.withColumns(numbers | {"__random": r.random_domain()})


def novelty_values(columns: Sequence[str], kind: str) -> Column:
    """Different canonical names or addresses of one kind in a row."""
    found = Row(columns).here(_NAMES[kind])
    if not found:
        return F.array().cast("array<string>")
    values = [F.when(net.ipv4(c).isNotNull(), strip(c)) if kind == "destination_ips" else domain(c) for c in found]
    return F.array_distinct(F.array_compact(F.array(*values)))


def baseline(df: DataFrame, key: bytes, org: str = "org_index", label: str = "label") -> DataFrame:
    """(org, kind, tag): keyed tags of what benign rows of each organisation have."""
    own = df.where(F.col(label) == "benign")
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), novelty_values(df.columns, k).alias("values")) for k in _NAMES))
    flat = own.select(F.col(org), F.inline(kinds)).select(org, "kind", F.explode("values").alias("value")).distinct()
    tags = reduce(lambda out, k: out.when(F.col("kind") == k, novelty_tag(key, k, F.col("value"))), _NAMES, F)
    return flat.select(org, "kind", tags.alias("tag"))


def with_novelty(df: DataFrame, known: DataFrame, key: bytes, row: str, org: str = "org_index") -> DataFrame:
    """Add ``__novel``: the kinds for which a row has a value that its organisation's benign rows lack.

    Organisations without a baseline have no news.
    """
    kinds = F.array(*(F.struct(F.lit(k).alias("kind"), novelty_values(df.columns, k).alias("values")) for k in _NAMES))
    flat = df.select(row, org, F.inline(kinds)).select(row, org, "kind", F.explode("values").alias("value"))
    values = flat.select("kind", "value").distinct()  # a tag is two digests: once for each value
    tags = reduce(lambda out, k: out.when(F.col("kind") == k, novelty_tag(key, k, F.col("value"))), _NAMES, F)
    tagged = flat.join(values.withColumn("tag", tags), ["kind", "value"]).join(known.select(org).distinct(), org, "left_semi")
    new = tagged.join(known, [org, "kind", "tag"], "left_anti").groupBy(row).agg(F.collect_set("kind").alias("__novel"))
    return df.join(new, row, "left").withColumn("__novel", F.coalesce("__novel", F.array().cast("array<string>")))


def active(columns: Sequence[str], novel: Column | None = None, v6: bool = False) -> dict[str, Column]:
    """The 25 signals of the token vocabulary; those about novelty are false without a baseline."""
    every, r = library(columns, v6), Row(columns, v6)
    out = {}
    for s in ACTIVE:
        if s not in NOVELTY:
            out[s] = every[s]
        elif novel is None:
            out[s] = F.lit(False)
        else:
            new = reduce(Column.__or__, [F.array_contains(novel, k) for k in NOVELTY[s]])
            extra = {"rare_destination_ip": r.external(_ADDRESSES), "external_post": r.anywhere("upload|external_post|method=post|post | put ")}.get(s)
            out[s] = new & extra if extra is not None else new
    return out


def masked(df: DataFrame, signals: dict[str, Column]) -> DataFrame:
    """Add ``__mask``, the active signals as bits."""
    return gathered(df, "__mask", [signals[s] for s in ACTIVE])


def once(df: DataFrame, name: str, c: Column) -> DataFrame:
    """Add a column that comes out of an ``explode`` of one element, which keeps the planner from writing its
    expression out again in each filter and projection that uses it."""
    return df.select("*", F.explode(F.array(c)).alias(name))


def gathered(df: DataFrame, name: str, flags: Sequence[Column]) -> DataFrame:
    """Add flags as bits of a number, a few at a time.

    Each few have a method of generated code; all of them in one have more than the 8,000 bytes up to which a JVM
    compiles a method.
    """
    parts = []
    for k in range(0, len(flags), TOGETHER):
        bits = [F.when(c, F.lit(1 << i)).otherwise(F.lit(0)).cast("bigint") for i, c in enumerate(flags[k : k + TOGETHER], k)]
        parts.append(f"{name}{k}")
        df = once(df, parts[-1], _either(bits))
    return once(df, name, _either([F.col(c) for c in parts])).drop(*parts)


def _either(bits: Sequence[Column]) -> Column:
    return reduce(lambda a, b: a.bitwiseOR(b), bits)


def scope_value(c: Column) -> Column:
    """Canonical text; whole numbers without a fraction."""
    text = canonical(c)
    n = F.when(text.rlike(r"^-?\d+\.0+$"), F.regexp_replace(text, r"\.0+$", "")).otherwise(text)
    return F.when(n != "", n)


def _placed(i: int):
    return lambda v: F.struct(F.lit(i).alias("scope"), v.alias("value"))


def scopes(columns: Sequence[str], wanted: Sequence[str] = SCOPES) -> Column:
    """Array of (scope number, value): every value under which a row can meet others."""
    r, out = Row(columns), []
    for i, s in enumerate(wanted):
        if s == "same_network_zone":
            values = [net.network_zone(c) for c in r.here(ZONE_COLUMNS)]
            if "network_zone" in columns:
                zone = scope_value(F.col("network_zone").cast("string"))
                values.append(F.when(zone.isNotNull(), F.when(zone.rlike(r"^[0-9a-f:.]+/\d+$"), zone).otherwise(F.concat(F.lit("name:"), zone))))
        else:
            values = [scope_value(c) for c in r.here(SCOPE_COLUMNS[s])]
        if values:
            out.append(F.transform(F.array_distinct(F.array_compact(F.array(*values))), _placed(i)))
    return F.flatten(F.array(*out)) if out else F.array().cast("array<struct<scope:int,value:string>>")


_LEFT_BITS = (1 << len(LEFT)) - 1
_RIGHT_BITS = (1 << len(ACTIVE)) - 1 - _LEFT_BITS


def may_close(available: Column) -> Column:
    """Whether there is a signal of either side at all; most rows end here, before any pair is tried."""
    return (available.bitwiseAND(F.lit(_LEFT_BITS).cast("bigint")) != 0) & (available.bitwiseAND(F.lit(_RIGHT_BITS).cast("bigint")) != 0)


def pairs_closed(current: Column, available: Column) -> Column:
    """Numbers (in the first scope) of the pairs that a row closes, from masks of its own and of all available signals."""
    def there(first: int, many: int) -> Column:
        return F.filter(F.array(*(F.lit(i) for i in range(first, first + many))), lambda i: F.getbit(available, i) == 1)

    left, right = there(0, len(LEFT)), there(len(LEFT), len(RIGHT))

    def closed(a: Column) -> Column:
        own = F.filter(right, lambda b: (F.getbit(current, a) == 1) | (F.getbit(current, b) == 1))
        return F.transform(own, lambda b: (a * len(RIGHT) + b - len(LEFT)) * len(SCOPES))

    return F.flatten(F.transform(left, closed))


def pair_numbers(current: Column, available: Column, scope: Column) -> Column:
    """Numbers of the tokens that close a pair in a scope."""
    return F.transform(pairs_closed(current, available), lambda n: n + scope)


def _names(numbers: Column) -> Column:
    names = F.array(*map(F.lit, TOKENS))
    return F.transform(numbers, lambda k: F.element_at(names, (k + 1).cast("int")))


def _named(numbers: Column) -> Column:
    return _names(F.sort_array(F.array_distinct(numbers)))


def row_tokens(df: DataFrame, novel: Column | None = None) -> DataFrame:
    """Add ``cross_tokens`` of each row by itself; a scope counts if one of its columns is filled.

    The tokens come out of an ``explode`` of one element, as the mask does.
    """
    r = Row(df.columns)
    supported = F.array_compact(F.array(*(F.when(r.filled(f"{ZONE_COLUMNS} network_zone" if s == "same_network_zone" else SCOPE_COLUMNS[s]), F.lit(i)) for i, s in enumerate(SCOPES))))
    wide = masked(prepared(df), active(df.columns, novel)).withColumn("__scopes", supported)
    m = F.col("__mask")
    numbers = F.flatten(F.transform(pairs_closed(m, m), lambda n: F.transform("__scopes", lambda s: n + s)))  # in order, and each once
    tokens = F.when(may_close(m), _names(numbers)).otherwise(F.array().cast("array<string>"))
    return wide.select(*(F.col(f"`{c}`") for c in df.columns if c != "cross_tokens"), F.explode(F.array(tokens)).alias("cross_tokens"))


def context_tokens(df: DataFrame, row: str, epoch: str | None = "event_time_epoch", iso: str | None = "event_time_iso", minutes: float = 15, novel: Column | None = None, partition: Sequence[str] = (), chunk: int = CHUNK_SECONDS) -> DataFrame:
    """(row, cross_tokens) of rows with a token; ``row`` numbers the rows in order.

    Rows without a signal can't take part and leave first.  Of each signal the time it was last seen in a
    scope is kept by a running maximum.  Scope values are cut into chunks of time, with the rows
    of one window before a chunk carried into it, so a hot value is many tasks.
    Rows without a reliable time stand for themselves; they are spread over chunks, where the others don't see them.
    """
    if minutes <= 0:
        return row_tokens(df, novel).where(F.size("cross_tokens") > 0).select(row, "cross_tokens")
    time, _ = context_time(F.col(epoch) if epoch in df.columns else None, F.col(iso) if iso in df.columns else None)
    own = once(masked(prepared(df), active(df.columns, novel)).where("__mask <> 0"), "__time", F.unix_micros(time))
    flat = own.select(F.col(row).alias("__row"), *partition, "__time", "__mask", F.inline(scopes(df.columns)))
    window, size = int(minutes * 60_000_000), chunk * 1_000_000
    if size < window:
        raise ValueError("a chunk must hold a window")
    timed = flat.withColumn("__own", F.coalesce(F.floor(F.col("__time") / size), F.xxhash64("__row")))
    timed = timed.withColumn("__chunk", F.explode(F.array_compact(F.array(F.col("__own"), F.when(F.floor((F.col("__time") + window) / size) > F.col("__own"), F.col("__own") + 1)))))
    by = Window.partitionBy(*partition, "scope", "value", "__chunk").orderBy("__time", "__row").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    last = {f"__s{i}": F.max(F.when(F.col("__mask").bitwiseAND(F.lit(1 << i)) != 0, F.col("__time"))).over(by) for i in range(len(ACTIVE))}
    seen = timed.select("*", *(c.alias(n) for n, c in last.items())).where("__chunk = __own")
    seen = gathered(seen, "__before", [F.col("__time") - F.col(f"__s{i}") <= window for i in range(len(ACTIVE))])
    keys, available = ["__row", *partition], F.col("__available")
    closed = seen.withColumn("__available", F.when(F.col("__time").isNull(), F.col("__mask")).otherwise(F.col("__before"))).where(may_close(available))
    closed = closed.select(*keys, pair_numbers(F.col("__mask"), available, F.col("scope")).alias("n"))
    out = closed.where(F.size("n") > 0).groupBy(*keys).agg(_named(F.flatten(F.collect_list("n"))).alias("cross_tokens"))
    return out.withColumnRenamed("__row", row)
