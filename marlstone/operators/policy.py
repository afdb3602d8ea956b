"""Allow-list policies: a document is checked on the driver and compiled into Column expressions.

A row is suppressed only where a policy provably allows it; every other row gets a reason code
and the id of the policy that came nearest.  Nothing in an expression raises on odd values: they
count as missing, so the row is forwarded.  The whole decision is one narrow projection.
"""

from __future__ import annotations

import ipaddress
import json
import re
from collections.abc import Mapping
from dataclasses import dataclass, field
from datetime import datetime
from typing import Any
from zoneinfo import ZoneInfo

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marlstone.functions import net
from marlstone.functions.text import canonical
from marlstone.functions.times import DAYS, Weekly, iso_time
from marlstone.operators.fields import category, with_fields


class PolicyError(ValueError):
    """A policy document breaks a rule; the message says where."""


@dataclass(frozen=True)
class Program:
    name: str
    paths: tuple[str, ...] = ()
    parents: tuple[str, ...] = ()
    allowed: tuple[str, ...] = ()
    prohibited: tuple[str, ...] = ()


@dataclass(frozen=True)
class Identity:
    identity_id: str
    users: tuple[str, ...]
    groups: tuple[str, ...]
    windows: tuple[Weekly, ...]
    programs: tuple[Program, ...]


@dataclass(frozen=True)
class Connection:
    connection_id: str
    direction: str
    ips: tuple[str, ...]
    cidrs: tuple[str, ...]
    domains: tuple[str, ...]
    protocols: tuple[str, ...]
    ports: tuple[str, ...]
    windows: tuple[Weekly, ...]


@dataclass(frozen=True)
class Rules:
    """A system policy (with identities) or a network policy (with connections and networks)."""

    policy_id: str
    hosts: tuple[str, ...]
    ips: tuple[str, ...]
    networks: tuple[str, ...] = ()
    valid_from: str | None = None
    valid_until: str | None = None
    enabled: bool = True
    identities: tuple[Identity, ...] = ()
    connections: tuple[Connection, ...] = ()


@dataclass(frozen=True)
class Prefilter:
    suppress: tuple[str, ...] = ()
    always_forward: tuple[str, ...] = ()
    require_policy: bool = True
    ignore_case: bool = True


@dataclass(frozen=True)
class Policy:
    organization_id: str
    zone: str
    mappings: Mapping[str, tuple[str, ...]]
    aliases: Mapping[str, tuple[str, ...]]
    system: tuple[Rules, ...]
    network: tuple[Rules, ...]
    event_id: Prefilter | None = None
    severity: Prefilter | None = None
    warnings: tuple[str, ...] = field(default=())


def _unique_loader():
    import yaml

    class Loader(yaml.SafeLoader):
        pass

    def mapping(loader, node, deep=False):
        out = {}
        for k, v in node.value:
            key = loader.construct_object(k, deep=deep)
            if key in out:
                raise PolicyError(f"key {key!r} is given twice (line {k.start_mark.line + 1})")
            out[key] = loader.construct_object(v, deep=True)
        return out

    Loader.add_constructor(yaml.resolver.BaseResolver.DEFAULT_MAPPING_TAG, mapping)
    return Loader


class _Reader:
    """Checked access to a nested document; unknown keys warn, or fail if strict."""

    def __init__(self, strict: bool):
        self.strict, self.warnings = strict, []

    def known(self, d: Any, where: str, *keys: str) -> dict:
        if not isinstance(d, dict):
            raise PolicyError(f"{where}: a mapping is needed")
        if unknown := sorted(set(map(str, d)) - set(keys)):
            if self.strict:
                raise PolicyError(f"{where}: unknown keys {unknown}")
            self.warnings.append(f"{where}: unknown keys {unknown}")
        return d

    def items(self, d: dict, key: str, where: str) -> list:
        v = d.get(key, [])
        if v is None or not isinstance(v, list):
            raise PolicyError(f"{where}.{key}: a list is needed")
        return v

    def texts(self, d: dict, key: str, where: str, lower: bool = True) -> tuple[str, ...]:
        out = []
        for v in self.items(d, key, where):
            if isinstance(v, bool) or not isinstance(v, (str, int)) or not str(v).strip():
                raise PolicyError(f"{where}.{key}: texts are needed, not {v!r}")
            out.append(str(v).strip().lower() if lower else str(v))
        return tuple(out)

    def text(self, d: dict, key: str, where: str) -> str:
        v = d.get(key)
        if not isinstance(v, str) or not v.strip():
            raise PolicyError(f"{where}.{key}: a text is needed")
        return v.strip()

    def flag(self, d: dict, key: str, where: str, default: bool) -> bool:
        v = d.get(key, default)
        if not isinstance(v, bool):
            raise PolicyError(f"{where}.{key}: true or false is needed")
        return v

    def checked(self, values: tuple[str, ...], check, where: str) -> tuple[str, ...]:
        for v in values:
            try:
                check(v)
            except ValueError as wrong:
                raise PolicyError(f"{where}: {v!r}: {wrong}") from None
        return values

    def zone(self, name: Any, where: str) -> str:
        try:
            ZoneInfo(name)
        except Exception:
            raise PolicyError(f"{where}: unknown time zone {name!r}") from None
        return name

    def windows(self, d: dict, where: str, zone: str) -> tuple[Weekly, ...]:
        out = []
        for k, w in enumerate(self.items(d, "authorized_time_windows", where)):
            at = f"{where}.authorized_time_windows[{k}]"
            self.known(w, at, "days", "start", "end", "timezone")
            days = self.texts(w, "days", at)
            if not days or any(x[:3] not in DAYS for x in days):
                raise PolicyError(f"{at}.days: names of weekdays are needed")
            for key in ("start", "end"):
                if not re.fullmatch(r"([01]\d|2[0-3]):[0-5]\d", str(w.get(key))):
                    raise PolicyError(f"{at}.{key}: HH:MM is needed")
            out.append(Weekly(days, w["start"], w["end"], self.zone(w.get("timezone", zone), f"{at}.timezone")))
        return tuple(out)

    def date(self, d: dict, key: str, where: str) -> str | None:
        v = d.get(key)
        if v is None:
            return None
        try:
            return datetime.fromisoformat(str(v).replace("Z", "+00:00")).isoformat()
        except ValueError:
            raise PolicyError(f"{where}.{key}: an ISO-8601 time is needed") from None

    def patterns(self, d: dict, key: str, where: str) -> tuple[str, ...]:
        def check(p):
            try:
                re.compile(p)
            except re.error as wrong:
                raise ValueError(str(wrong)) from None

        return self.checked(self.texts(d, key, where, lower=False), check, f"{where}.{key}")


def _port_range(text: str) -> None:
    low, dash, high = str(text).partition("-")
    if not low.isdigit() or (dash and not high.isdigit()) or not 0 <= int(low) <= int(high or low) <= 65535:
        raise ValueError("a port or a range of ports is needed")


def _domain_pattern(text: str) -> None:
    name = text.removeprefix("*.").rstrip(".")
    if not name or "*" in name or not all(re.fullmatch(r"[a-z0-9_]([a-z0-9_-]*[a-z0-9_])?", x) for x in name.split(".")):
        raise ValueError("a domain or *.domain is needed")


def load_policy(source: str | Mapping, strict: bool = False) -> Policy:
    """A checked policy from a mapping, or from a YAML or JSON file without repeated keys."""
    if isinstance(source, str):
        with open(source, encoding="utf-8") as f:
            text = f.read()
        try:
            if source.endswith(".json"):
                source = json.loads(text)
            else:
                import yaml

                source = yaml.load(text, _unique_loader())  # noqa: S506 (a safe loader)
        except PolicyError:
            raise
        except Exception as wrong:
            raise PolicyError(f"the document can't be read: {wrong}") from None
    r = _Reader(strict)
    d = r.known(source, "policy", "version", "organization_id", "default_timezone", "preprocessing", "field_mappings", "category_aliases", "prefilters", "system_policies", "network_policies")
    if d.get("version") != 1 or isinstance(d["version"], bool):
        raise PolicyError("policy.version: only version 1 is known")
    zone = r.zone(d.get("default_timezone", "UTC"), "policy.default_timezone")
    if pre := d.get("preprocessing"):
        r.known(pre, "preprocessing", "text_column", "include_cross_category", "preserve_empty_fields")
        r.flag(pre, "include_cross_category", "preprocessing", False), r.flag(pre, "preserve_empty_fields", "preprocessing", False)
    mappings = d.get("field_mappings") or {}
    if not isinstance(mappings, dict) or not mappings:
        raise PolicyError("policy.field_mappings: a mapping of names to columns is needed")
    mappings = {str(k): r.texts(mappings, k, "field_mappings", lower=False) for k in mappings}
    aliases = d.get("category_aliases") or {}
    aliases = {str(k): r.texts(aliases, k, "category_aliases") for k in aliases}
    filters: dict[str, Prefilter] = {}
    for key, kind in (("event_id", "ids"), ("severity", "values")):
        if f := r.known(d.get("prefilters") or {}, "prefilters", "event_id", "severity").get(key):
            at = f"prefilters.{key}"
            r.known(f, at, f"suppress_{kind}", f"always_forward_{kind}", "require_policy_match_for_suppression", "case_insensitive")
            fold = r.flag(f, "case_insensitive", at, True)
            clean = _event_id_text if key == "event_id" else (lambda s, fold=fold: s.strip().lower() if fold else s.strip())
            drop, keep = (tuple(map(clean, r.texts(f, f"{k}_{kind}", at, lower=False))) for k in ("suppress", "always_forward"))
            if both := set(drop) & set(keep):
                raise PolicyError(f"{at}: both suppressed and always forwarded: {sorted(both)}")
            filters[key] = Prefilter(drop, keep, r.flag(f, "require_policy_match_for_suppression", at, True), fold)
    ids: set[str] = set()

    def base(p: Any, at: str, host: str, extra: tuple[str, ...]) -> dict:
        r.known(p, at, "policy_id", "enabled", "valid_from", "valid_until", host, "local_ips", *extra)
        out = {"policy_id": r.text(p, "policy_id", at), "enabled": r.flag(p, "enabled", at, True), "hosts": r.texts(p, host, at), "ips": r.checked(r.texts(p, "local_ips", at), ipaddress.ip_address, f"{at}.local_ips"), "valid_from": r.date(p, "valid_from", at), "valid_until": r.date(p, "valid_until", at)}
        if out["policy_id"] in ids:
            raise PolicyError(f"{at}.policy_id: {out['policy_id']!r} is given twice")
        ids.add(out["policy_id"])
        if out["valid_from"] and out["valid_until"] and out["valid_from"] > out["valid_until"]:
            raise PolicyError(f"{at}: valid_from comes after valid_until")
        return out

    system = []
    for k, p in enumerate(r.items(d, "system_policies", "policy")):
        at = f"system_policies[{k}]"
        own = base(p, at, "hosts", ("authorized_identities",))
        if not own["hosts"] and not own["ips"]:
            raise PolicyError(f"{at}: hosts or local_ips are needed")
        people = []
        for j, i in enumerate(r.items(p, "authorized_identities", at)):
            ia = f"{at}.authorized_identities[{j}]"
            r.known(i, ia, "identity_id", "users", "groups", "authorized_time_windows", "allowed_programs")
            users, groups, programs = r.texts(i, "users", ia), r.texts(i, "groups", ia), []
            if not users and not groups:
                raise PolicyError(f"{ia}: users or groups are needed")
            for m, g in enumerate(r.items(i, "allowed_programs", ia)):
                ga = f"{ia}.allowed_programs[{m}]"
                r.known(g, ga, "name", "paths", "allowed_parent_programs", "command_line")
                line = r.known(g.get("command_line") or {}, f"{ga}.command_line", "allowed_patterns", "prohibited_patterns")
                programs.append(Program(r.text(g, "name", ga).lower(), r.texts(g, "paths", ga, lower=False), r.texts(g, "allowed_parent_programs", ga), r.patterns(line, "allowed_patterns", ga), r.patterns(line, "prohibited_patterns", ga)))
            if not programs:
                raise PolicyError(f"{ia}: allowed_programs are needed")
            people.append(Identity(r.text(i, "identity_id", ia), users, groups, r.windows(i, ia, zone), tuple(programs)))
        if not people:
            raise PolicyError(f"{at}: authorized_identities are needed")
        system.append(Rules(identities=tuple(people), **own))
    network = []
    for k, p in enumerate(r.items(d, "network_policies", "policy")):
        at = f"network_policies[{k}]"
        own = base(p, at, "local_hosts", ("local_networks", "authorized_connections"))
        nets = r.checked(r.texts(p, "local_networks", at), lambda n: ipaddress.ip_network(n, strict=False), f"{at}.local_networks")
        if not own["hosts"] and not own["ips"] and not nets:
            raise PolicyError(f"{at}: local_hosts, local_ips or local_networks are needed")
        connections, seen = [], set()
        for j, c in enumerate(r.items(p, "authorized_connections", at)):
            ca = f"{at}.authorized_connections[{j}]"
            r.known(c, ca, "connection_id", "direction", "remote_ips", "remote_cidrs", "remote_domains", "protocols", "destination_ports", "authorized_time_windows")
            name, way = r.text(c, "connection_id", ca), str(c.get("direction", "")).lower()
            if name in seen or way not in ("inbound", "outbound", "internal", "any"):
                raise PolicyError(f"{ca}: " + ("connection_id is given twice" if name in seen else "direction must be inbound, outbound, internal or any"))
            seen.add(name)
            ips = r.checked(r.texts(c, "remote_ips", ca), ipaddress.ip_address, f"{ca}.remote_ips")
            cidrs = r.checked(r.texts(c, "remote_cidrs", ca), lambda n: ipaddress.ip_network(n, strict=False), f"{ca}.remote_cidrs")
            domains = tuple(x.rstrip(".") for x in r.checked(r.texts(c, "remote_domains", ca), _domain_pattern, f"{ca}.remote_domains"))
            if not ips and not cidrs and not domains:
                raise PolicyError(f"{ca}: remote_ips, remote_cidrs or remote_domains are needed")
            connections.append(Connection(name, way, ips, cidrs, domains, r.texts(c, "protocols", ca), r.checked(r.texts(c, "destination_ports", ca), _port_range, f"{ca}.destination_ports"), r.windows(c, ca, zone)))
        if not connections:
            raise PolicyError(f"{at}: authorized_connections are needed")
        network.append(Rules(networks=nets, connections=tuple(connections), **own))
    return Policy(r.text(d, "organization_id", "policy"), zone, mappings, aliases, tuple(system), tuple(network), filters.get("event_id"), filters.get("severity"), tuple(r.warnings))


def _event_id_text(value: str) -> str:
    text = value.strip()
    return str(int(float(text))) if re.fullmatch(r"[+-]?\d+(\.0+)?", text) else text


# Evaluation

_STEP = "struct<kind:int,depth:int,code:string,details:string,policy_id:string>"


def _step(kind: int, code: Column | str, details: Column | str, policy_id: str | None = None, depth: int = 0) -> Column:
    """kind 2: allowed, 1: an applicable policy fails, 0: the policy is for others."""
    text = [F.lit(x) if not isinstance(x, Column) else x for x in (code, details)]
    return F.struct(F.lit(kind).alias("kind"), F.lit(depth).alias("depth"), text[0].alias("code"), text[1].alias("details"), F.lit(policy_id).cast("string").alias("policy_id"))


def _branches(*pairs: tuple[Column, Column], otherwise: Column) -> Column:
    out = None
    for test, value in pairs:
        out = F.when(test, value) if out is None else out.when(test, value)
    return otherwise if out is None else out.otherwise(otherwise)


def _first_by(failures: Column, priority: tuple[str, ...]) -> Column:
    """The failure whose code comes first in the priority, the earliest of several; codes outside come last."""
    order = F.array(*map(F.lit, priority))
    ranked = F.transform(failures, lambda f, i: F.struct(F.when(F.array_position(order, f["code"]) == 0, len(priority) + 1).otherwise(F.array_position(order, f["code"])).alias("at"), i.alias("i"), f.alias("f")))
    return F.array_min(ranked)["f"]


class Kept:
    """A frame that grows by columns.  What is used more than once becomes one, or the expressions would multiply."""

    def __init__(self, df: DataFrame):
        self.df, self.n = df, 0

    def __call__(self, value: Column) -> Column:
        self.n += 1
        name = f"__k{self.n}"
        self.df = self.df.withColumn(name, value)
        return F.col(name)


def _outcome(steps: list[Column], kind: str, keep: Kept) -> Column:
    """First allowed; else the last failure of an applicable policy; else the first selector failure."""
    if not steps:
        return _step(-1, "NO_APPLICABLE_POLICY", f"no {kind} policy is enabled")
    every = keep(F.filter(F.array(*(s.cast(_STEP) for s in steps)), lambda s: s.isNotNull()))

    def only(k: int) -> Column:
        return F.filter(every, lambda s: s["kind"] == k)

    return F.coalesce(F.get(only(2), F.lit(0)), F.try_element_at(only(1), F.lit(-1)), F.get(only(0), F.lit(0)), _step(-1, "NO_APPLICABLE_POLICY", f"no enabled {kind} policy applies").cast(_STEP))


def _in_windows(time: Column, windows: tuple[Weekly, ...]) -> Column:
    """Null where it is in time, else the code that says why not."""
    if not windows:
        return F.lit(None).cast("string")
    inside = F.lit(False)
    for w in windows:
        inside = inside | w.contains(time)
    return F.when(time.isNull(), "INVALID_TIMESTAMP").when(~inside, "OUTSIDE_AUTHORIZED_TIME")


def _out_of_date(time: Column, p: Rules, zone: str) -> Column:
    if not p.valid_from and not p.valid_until:
        return F.lit(False)
    ok = time.isNotNull()
    for bound, after in ((p.valid_from, True), (p.valid_until, False)):
        if bound:
            b = iso_time(F.lit(bound.replace(" ", "T")), zone)
            ok = ok & (time >= b if after else time <= b)
    return ~ok


def _path(c: Column) -> Column:
    return F.rtrim(F.regexp_replace(c, r"\\", "/"), F.lit("/"))


def _program(p: Program, f) -> Column:
    name = F.element_at(F.split(_path(f("program_path")), "/"), -1)
    path, parent, line = f("program_path"), f("parent_program"), F.coalesce(f("command_line"), F.lit(""))
    same = F.coalesce(f("program") == p.name, F.lit(False)) | F.coalesce(name == p.name, F.lit(False))
    tests = [(~same, _step(1, "UNAUTHORIZED_PROGRAM", "the program is not on the list"))]
    if p.paths:
        tests += [(path.isNull(), _step(1, "MISSING_REQUIRED_FIELD", "program_path is missing")), (~_path(path).isin([_path_text(x) for x in p.paths]), _step(1, "UNAUTHORIZED_PROGRAM_PATH", "the program lies elsewhere"))]
    if p.parents:
        tests += [(parent.isNull(), _step(1, "MISSING_REQUIRED_FIELD", "parent_program is missing")), (~parent.isin(list(p.parents)), _step(1, "UNAUTHORIZED_PARENT_PROGRAM", "another program started it"))]
    if p.allowed:
        hit = F.lit(False)
        for x in p.allowed:
            hit = hit | line.rlike(x)
        tests.append((~hit, _step(1, "COMMAND_LINE_POLICY_VIOLATION", "no allowed pattern fits the command line")))
    for x in p.prohibited:
        tests.append((line.rlike(x), _step(1, "COMMAND_LINE_POLICY_VIOLATION", "a prohibited pattern fits the command line")))
    return _branches(*tests, otherwise=_step(2, "ALLOWED", "allowed")).cast(_STEP)


def _path_text(path: str) -> str:
    return "_".join(path.strip().lower().split()).replace("\\", "/").rstrip("/")


_PROGRAM_ORDER = ("MISSING_REQUIRED_FIELD", "UNAUTHORIZED_PROGRAM_PATH", "UNAUTHORIZED_PARENT_PROGRAM", "COMMAND_LINE_POLICY_VIOLATION", "UNAUTHORIZED_PROGRAM")
_CONNECTION_ORDER = ("UNKNOWN_NETWORK_DIRECTION", "INVALID_TIMESTAMP", "OUTSIDE_AUTHORIZED_TIME", "UNAUTHORIZED_PROTOCOL", "UNAUTHORIZED_PORT", "UNAUTHORIZED_REMOTE_DOMAIN", "UNAUTHORIZED_REMOTE_IP", "MISSING_REQUIRED_FIELD")


def system_outcome(policy: Policy, f, keep: Kept) -> Column:
    """Outcome of the system policies; ``f`` gives a logical field's value, null when missing."""
    time, steps = keep(iso_time(f("timestamp"), policy.zone)), []
    local = keep(F.coalesce(f("local_ip"), f("source_ip")))
    number = keep(net.ipv4(local))
    groups = keep(F.transform(F.split(F.coalesce(f("user_groups"), F.lit("")), "[,;]"), F.trim))
    for p in (x for x in policy.system if x.enabled):
        host, has_ip = f("host"), net.is_address(local, any(":" in i for i in p.ips), number)
        mine = F.coalesce(host.isin(list(p.hosts)), F.lit(False)) if p.hosts else F.lit(False)
        if p.ips:
            mine = mine | net.same_address(local, list(p.ips), number)
        mine = keep(mine)
        no = [(host.isNotNull(), "UNAUTHORIZED_HOST")] if p.hosts else []
        no += [(has_ip, "UNAUTHORIZED_LOCAL_IP")] if p.ips else []
        other = _branches(*((t, _step(0, c, "the policy is for other machines", p.policy_id)) for t, c in no), otherwise=_step(0, "MISSING_REQUIRED_FIELD", "the policy is for other machines", p.policy_id))
        late = keep(_out_of_date(time, p, policy.zone))
        matched, own = [], []
        for i in p.identities:
            match = F.coalesce(f("user").isin(list(i.users)), F.lit(False)) if i.users else F.lit(False)
            if i.groups:
                match = match | F.arrays_overlap(groups, F.array(*map(F.lit, i.groups)))
            match, untimely = keep(match), keep(_in_windows(time, i.windows))
            results = keep(F.array(*(_program(g, f) for g in i.programs)))
            worst = keep(_first_by(results, _PROGRAM_ORDER))
            allowed = F.exists(results, lambda s: s["kind"] == 2)
            step = _branches((untimely.isNotNull(), _step(1, untimely, "outside the identity's hours", p.policy_id)), (allowed, _step(2, "ALLOWED", "a system policy allows the row", p.policy_id)), otherwise=_step(1, worst["code"], worst["details"], p.policy_id))
            matched.append(match)
            own.append(keep(F.when(mine & ~late & match, step.cast(_STEP))))
        nobody = ~matched[0]
        for m in matched[1:]:
            nobody = nobody & ~m
        stale = F.when(time.isNull(), "INVALID_TIMESTAMP").otherwise("OUTSIDE_AUTHORIZED_TIME")
        steps.append(_branches((~mine, other.cast(_STEP)), (late, _step(1, stale, "outside the policy's dates", p.policy_id).cast(_STEP)), (nobody, _step(1, "UNAUTHORIZED_USER", "no identity has the user or a group", p.policy_id).cast(_STEP)), otherwise=F.lit(None).cast(_STEP)))
        steps += own
    return _outcome(steps, "system", keep)


def _connection(c: Connection, way: Column, time: Column, f, number: Column) -> Column:
    source, target = f("source_ip"), f("destination_ip")
    remote = F.when(way == "inbound", source).otherwise(target)
    depth, tests = 1, [(way.isNull(), _step(1, "UNKNOWN_NETWORK_DIRECTION", "the direction is missing or ambiguous"))]
    if c.direction != "any":
        tests.append((way != c.direction, _step(1, "UNKNOWN_NETWORK_DIRECTION", "another direction")))

    def stage(value: Column, fine: Column, code: str, what: str) -> None:
        nonlocal depth
        tests.append((value.isNull(), _step(1, "MISSING_REQUIRED_FIELD", f"{what} is missing", depth=depth)))
        tests.append((~fine, _step(1, code, f"{what} is not on the list", depth=depth + 1)))
        depth += 1

    if c.ips or c.cidrs:
        six = any(":" in x for x in c.ips + c.cidrs)
        stage(F.when(net.is_address(remote, six, number), remote), net.in_networks(remote, [*c.ips, *c.cidrs], number), "UNAUTHORIZED_REMOTE_IP", "the remote address")
    if c.domains:
        stage(f("domain"), net.matches_domain(f("domain"), list(c.domains)), "UNAUTHORIZED_REMOTE_DOMAIN", "the remote domain")
    if c.protocols:
        stage(f("protocol"), f("protocol").isin(list(c.protocols)), "UNAUTHORIZED_PROTOCOL", "the protocol")
    if c.ports:
        stage(net.port(f("destination_port")), net.in_ports(f("destination_port"), list(c.ports)), "UNAUTHORIZED_PORT", "the destination port")
    untimely = _in_windows(time, c.windows)
    tests.append((untimely.isNotNull(), _step(1, untimely, "outside the connection's hours", depth=depth)))
    return _branches(*tests, otherwise=_step(2, "ALLOWED", "allowed", depth=depth + 1)).cast(_STEP)


def direction(networks: tuple[str, ...], f, numbers: Mapping[str, Column] = {}) -> Column:
    """The stated direction, or what the local networks say of both addresses; null if neither tells."""
    stated = f("direction")
    told = F.when(stated.isin("inbound", "outbound", "internal"), stated)
    if not networks:
        return told
    six = any(":" in n for n in networks)
    ends = [(net.is_address(f(n), six, numbers.get(n)), net.in_networks(f(n), list(networks), numbers.get(n))) for n in ("source_ip", "destination_ip")]
    (s_ok, s), (d_ok, d) = ends
    derived = F.when(s_ok & d_ok, F.when(s & d, "internal").when(s, "outbound").when(d, "inbound"))
    return F.when(stated.isNotNull(), told).otherwise(derived)


def network_outcome(policy: Policy, f, keep: Kept) -> Column:
    """Outcome of the network policies.  Of failing connections those that got furthest are told apart by priority."""
    time, steps = keep(iso_time(f("timestamp"), policy.zone)), []
    local = keep(F.coalesce(f("local_ip"), f("source_ip")))
    number = keep(net.ipv4(local))
    numbers = {n: keep(net.ipv4(f(n))) for n in ("source_ip", "destination_ip")}
    for p in (x for x in policy.network if x.enabled):
        host, nets = f("host"), [*p.ips, *p.networks]
        has_ip = net.is_address(local, any(":" in n for n in nets), number)
        mine = F.coalesce(host.isin(list(p.hosts)), F.lit(False)) if p.hosts else F.lit(False)
        if nets:
            mine = mine | net.in_networks(local, nets, number)
        mine = keep(mine)
        no = [(host.isNotNull(), "UNAUTHORIZED_HOST")] if p.hosts else []
        no += [(has_ip, "UNAUTHORIZED_LOCAL_IP")] if nets else []
        other = _branches(*((t, _step(0, c, "the policy is for other machines", p.policy_id)) for t, c in no), otherwise=_step(0, "MISSING_REQUIRED_FIELD", "the policy is for other machines", p.policy_id))
        way = keep(direction(p.networks, f, numbers))
        remote = keep(F.when(way == "inbound", numbers["source_ip"]).otherwise(numbers["destination_ip"]))
        results = keep(F.array(*(_connection(c, way, time, f, remote) for c in p.connections)))
        deepest = keep(F.array_max(F.transform(results, lambda s: s["depth"])))
        worst = keep(_first_by(F.filter(results, lambda s: s["depth"] == deepest), _CONNECTION_ORDER))
        stale = F.when(time.isNull(), "INVALID_TIMESTAMP").otherwise("OUTSIDE_AUTHORIZED_TIME")
        how = F.when(f("direction").isNull(), F.concat(F.lit("a network policy allows the row; direction derived as "), way)).otherwise("a network policy allows the row")
        steps.append(
            _branches(
                (~mine, other.cast(_STEP)),
                (_out_of_date(time, p, policy.zone), _step(1, stale, "outside the policy's dates", p.policy_id).cast(_STEP)),
                (F.exists(results, lambda s: s["kind"] == 2), _step(2, "ALLOWED", how, p.policy_id).cast(_STEP)),
                otherwise=_step(1, worst["code"], worst["details"], p.policy_id).cast(_STEP),
            )
        )
    return _outcome(steps, "network", keep)


def _decision(action: str, kind: Column | str, code: Column | str, details: Column | str, policy_id: Column | None = None) -> Column:
    kind, code, details = (x if isinstance(x, Column) else F.lit(x) for x in (kind, code, details))
    return F.struct(F.lit(action).alias("action"), kind.alias("category"), code.alias("reason_code"), details.alias("reason_details"), (policy_id if policy_id is not None else F.lit(None)).cast("string").alias("matched_policy_id"))


def with_decision(df: DataFrame, policy: Policy) -> DataFrame:
    """Add ``decision``: action, category, reason_code, reason_details, matched_policy_id.

    A column ``malformed`` (and ``malformed_reason``), if there, forwards its rows first.  The
    intermediate columns are projections of their own, which keeps each generated method small.
    """
    columns = df.columns
    wide = with_fields(df, policy.mappings, "__f")

    def f(name: str) -> Column:
        return F.col("__f")[name]["value"] if name in policy.mappings else F.lit(None).cast("string")

    keep = Kept(wide)
    kind = keep(category(f("category"), F.col("__f"), list(policy.mappings), policy.aliases))
    s = keep(system_outcome(policy, f, keep))
    n = keep(network_outcome(policy, f, keep))
    clash = F.flatten(F.array(*(F.when(F.size(F.col("__f")[n]["conflicts"]) > 0, F.array(F.concat(F.lit(f"{n}: "), F.concat_ws(", ", F.col("__f")[n]["conflicts"])))).otherwise(F.array().cast("array<string>")) for n in policy.mappings)))
    clash = keep(clash)
    s_ok, n_ok = s["kind"] == 2, n["kind"] == 2
    fail = F.when(kind == "network", n).when(kind == "system", s).when(s_ok, n).otherwise(s)
    both = _decision("suppress", kind, "ALLOWED", "system and network policies allow the row", F.concat_ws(",", s["policy_id"], n["policy_id"]))
    tests = []
    if "malformed" in columns:
        why = F.col("malformed_reason") if "malformed_reason" in columns else F.lit(None)
        tests.append((F.coalesce(F.col("malformed").cast("boolean"), F.lit(False)), _decision("forward", "malformed", "MALFORMED_ROW", F.coalesce(why.cast("string"), F.lit("malformed row")))))
    tests += [
        (F.size(clash) > 0, _decision("forward", kind, "CONFLICTING_FIELD_VALUES", F.concat_ws("; ", clash))),
        (kind == "unknown", _decision("forward", kind, "UNKNOWN_CATEGORY", "neither a category nor evidence of one")),
        ((kind == "system") & s_ok, _decision("suppress", kind, "ALLOWED", s["details"], s["policy_id"])),
        ((kind == "network") & n_ok, _decision("suppress", kind, "ALLOWED", n["details"], n["policy_id"])),
        ((kind == "system_and_network") & s_ok & n_ok, both),
    ]
    decided = _branches(*tests, otherwise=_decision("forward", kind, fail["code"], fail["details"], fail["policy_id"]))
    return keep.df.select(*(F.col(f"`{c}`") for c in columns if c != "decision"), decided.alias("decision"))


# Prefilters

_VERDICT = "struct<forward:boolean,suppress:boolean,waives:boolean,code:string,details:string>"


def _verdict(forward: bool, suppress: bool, waives: bool, code: str, details: Column | str) -> Column:
    details = details if isinstance(details, Column) else F.lit(details)
    return F.struct(F.lit(forward).alias("forward"), F.lit(suppress).alias("suppress"), F.lit(waives).alias("waives"), F.lit(code).alias("code"), details.alias("details")).cast(_VERDICT)


def event_id(c: Column) -> Column:
    """The id's text; whole numbers without sign of plus, leading zeros or a fraction; null when malformed or blank."""
    text = F.trim(c.cast("string"))
    whole = text.rlike(r"^[+-]?\d+(\.0+)?$")
    return F.when(whole, text.try_cast("double").cast("decimal(38,0)").cast("string")).when(text.rlike(r"^[A-Za-z0-9_.:-]+$"), text)


def severity(c: Column, ignore_case: bool = True) -> Column:
    text = F.trim(c.cast("string"))
    good = F.when(~text.rlike(r"[\x00-\x1f]") & (text != ""), text)
    return F.lower(good) if ignore_case else good


def prefilter_verdict(value: Column, clean: Column, rule: Prefilter, what: str) -> Column:
    """What a prefilter says of a row: it must be forwarded, may be suppressed, or neither."""
    blank = value.isNull() | (F.trim(value.cast("string")) == "")
    shown = F.concat(F.lit(f"{what} "), clean)
    tests = [
        (blank, _verdict(True, False, False, f"{what}_MISSING", f"{what} is missing")),
        (clean.isNull(), _verdict(True, False, False, f"{what}_MALFORMED", f"{what} is malformed")),
        (clean.isin(list(rule.always_forward)), _verdict(True, False, False, f"{what}_ALWAYS_FORWARD", F.concat(shown, F.lit(" is always forwarded")))),
        (clean.isin(list(rule.suppress)), _verdict(False, True, not rule.require_policy, f"{what}_SUPPRESS_MATCH", F.concat(shown, F.lit(" is on the suppress list")))),
    ]
    return _branches(*tests, otherwise=_verdict(False, False, False, f"{what}_NEUTRAL", F.concat(shown, F.lit(" is on no list"))))


def with_prefilters(df: DataFrame, policy: Policy, event_id_column: str | None = None, severity_column: str | None = None) -> DataFrame:
    """Merge the prefilters into ``decision``: the first that must forward wins (event id before severity).

    Rows are suppressed without a policy only if all candidates waive it and no policy applies.
    """
    verdicts = []
    missing = F.lit(None).cast("string")
    if policy.event_id and event_id_column:
        c = F.col(f"`{event_id_column}`") if event_id_column in df.columns else missing
        verdicts.append(prefilter_verdict(c, event_id(c), policy.event_id, "EVENT_ID"))
    if policy.severity and severity_column:
        c = F.col(f"`{severity_column}`") if severity_column in df.columns else missing
        verdicts.append(prefilter_verdict(c, severity(c, policy.severity.ignore_case), policy.severity, "SEVERITY"))
    if not verdicts:
        return df
    wide, d, v = df.withColumn("__v", F.array(*verdicts)), F.col("decision"), F.col("__v")
    details = F.concat_ws("; ", F.filter(F.concat(F.array(d["reason_details"]), F.transform(v, lambda x: x["details"])), lambda x: x != ""))
    must, may = F.filter(v, lambda x: x["forward"]), F.filter(v, lambda x: x["suppress"])
    waived = (F.size(may) > 0) & F.forall(may, lambda x: x["waives"]) & (d["reason_code"] == "NO_APPLICABLE_POLICY")
    drop = (F.size(must) == 0) & waived
    action = F.when(F.size(must) > 0, "forward").when(drop, "suppress").otherwise(d["action"])
    code = F.when(F.size(must) > 0, F.get(must, F.lit(0))["code"]).when(drop, "ALLOWED").otherwise(d["reason_code"])
    merged = F.struct(action.alias("action"), d["category"].alias("category"), code.alias("reason_code"), details.alias("reason_details"), d["matched_policy_id"].alias("matched_policy_id"))
    return wide.withColumn("decision", merged).drop("__v")


def forwarded(df: DataFrame, action: str = "forward") -> DataFrame:
    """The rows with an action.

    The action comes out of an ``explode`` of one element, or the planner would write the filter out over all that the
    decision is made of.
    """
    return df.select("*", F.explode(F.array("decision.action")).alias("__action")).where(F.col("__action") == action).drop("__action")


def summary(df: DataFrame) -> DataFrame:
    """(reason_code, n, forwarded, share): counts by reason, and the share of all rows."""
    by = df.groupBy(F.col("decision.reason_code").alias("reason_code")).agg(F.count("*").alias("n"), F.count_if(F.col("decision.action") == "forward").alias("forwarded"))
    return by.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # one row a reason


__all__ = ["Policy", "PolicyError", "canonical", "forwarded", "load_policy", "summary", "with_decision", "with_prefilters"]
