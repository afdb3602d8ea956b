"""Policies: validation, reason codes, prefilters, quirks of canonical values, fail-open behaviour."""

import copy

import pytest

from marlstone.operators import policy as P

SYSTEM = {
    "version": 1,
    "organization_id": "o",
    "default_timezone": "UTC",
    "field_mappings": {"timestamp": ["time"], "host": ["host", "hostname"], "user": ["user"], "user_groups": ["groups"], "program": ["process"], "program_path": ["path"], "parent_program": ["parent"], "command_line": ["cmd"], "source_ip": ["src_ip"], "destination_ip": ["dst_ip"], "domain": ["domain"], "protocol": ["protocol"], "destination_port": ["dst_port"], "direction": ["direction"]},
    "system_policies": [
        {
            "policy_id": "s1",
            "hosts": ["ws1"],
            "valid_from": "2026-01-01",
            "valid_until": "2026-12-31T23:59:59Z",
            "authorized_identities": [
                {
                    "identity_id": "i1",
                    "users": ["ann"],
                    "groups": ["staff"],
                    "authorized_time_windows": [{"days": ["mon"], "start": "22:00", "end": "02:00", "timezone": "UTC"}, {"days": ["tue"], "start": "09:00", "end": "18:00"}],
                    "allowed_programs": [{"name": "Tool.exe", "paths": ["C:\\Program Files\\tool.exe"], "allowed_parent_programs": ["shell"], "command_line": {"allowed_patterns": ["^tool_-a"], "prohibited_patterns": ["secret"]}}],
                }
            ],
        }
    ],
}
NETWORK = {
    "version": 1,
    "organization_id": "o",
    "field_mappings": SYSTEM["field_mappings"],
    "network_policies": [
        {
            "policy_id": "n1",
            "local_networks": ["10.0.0.0/8", "2001:db8::/32"],
            "authorized_connections": [
                {"connection_id": "a", "direction": "outbound", "remote_cidrs": ["198.51.100.0/24", "2001:db9::/32"], "remote_domains": ["*.vendor.com"], "protocols": ["TCP"], "destination_ports": [443, "8000-8010"]},
                {"connection_id": "b", "direction": "inbound", "remote_ips": ["203.0.113.9"]},
            ],
        }
    ],
}
GOOD = {"time": "2026-07-21T10:00:00Z", "host": "WS1", "user": "Ann", "groups": None, "process": "TOOL.EXE", "path": "c:/program files/Tool.exe", "parent": "Shell", "cmd": "tool -a x"}
FLOW = {"src_ip": "10.1.1.1", "dst_ip": "198.51.100.7", "domain": "API.Vendor.com.", "protocol": "tcp", "dst_port": "443.0"}


def decisions(spark, document, rows, **types):
    names = sorted({k for r in rows for k in r} | {"id"})
    df = spark.createDataFrame([tuple(i if n == "id" else r.get(n) for n in names) for i, r in enumerate(rows)], ", ".join(f"{n} {types.get(n, 'int' if n == 'id' else 'string')}" for n in names))
    out = P.with_decision(df, P.load_policy(document)).orderBy("id").collect()
    return [(r.decision.action, r.decision.reason_code) for r in out]


def test_system_reasons(spark):
    cases = [
        ({}, ("suppress", "ALLOWED")),
        ({"user": "bob", "groups": "x;staff"}, ("suppress", "ALLOWED")),
        ({"user": "bob", "groups": "x, staff"}, ("forward", "UNAUTHORIZED_USER")),  # canonical text has _staff
        ({"host": "ws2"}, ("forward", "UNAUTHORIZED_HOST")),
        ({"host": " "}, ("forward", "MISSING_REQUIRED_FIELD")),
        ({"user": "bob"}, ("forward", "UNAUTHORIZED_USER")),
        ({"process": "other", "path": None}, ("forward", "UNAUTHORIZED_PROGRAM")),
        ({"path": None}, ("forward", "MISSING_REQUIRED_FIELD")),
        ({"path": "d:/tool.exe"}, ("forward", "UNAUTHORIZED_PROGRAM_PATH")),
        ({"parent": "mail"}, ("forward", "UNAUTHORIZED_PARENT_PROGRAM")),
        ({"cmd": "tool -b"}, ("forward", "COMMAND_LINE_POLICY_VIOLATION")),
        ({"cmd": "tool -a secret"}, ("forward", "COMMAND_LINE_POLICY_VIOLATION")),
        ({"time": "2026-07-21T18:00:59Z"}, ("suppress", "ALLOWED")),
        ({"time": "2026-07-21T18:01:00Z"}, ("forward", "OUTSIDE_AUTHORIZED_TIME")),
        ({"time": "2026-07-21T01:59:00Z"}, ("suppress", "ALLOWED")),  # Monday's window runs on
        ({"time": "2026-07-22T01:59:00Z"}, ("forward", "OUTSIDE_AUTHORIZED_TIME")),
        ({"time": "2027-07-20T10:00:00Z"}, ("forward", "OUTSIDE_AUTHORIZED_TIME")),
        ({"time": "soon"}, ("forward", "INVALID_TIMESTAMP")),
        ({"hostname": "ws9"}, ("forward", "CONFLICTING_FIELD_VALUES")),
        ({"hostname": " ws1 "}, ("suppress", "ALLOWED")),
    ]
    assert decisions(spark, SYSTEM, [GOOD | c for c, _ in cases]) == [w for _, w in cases]


def test_network_reasons(spark):
    cases = [
        ({}, ("suppress", "ALLOWED")),
        ({"dst_port": "8005"}, ("suppress", "ALLOWED")),
        ({"dst_port": "8011"}, ("forward", "UNAUTHORIZED_PORT")),
        ({"protocol": "udp"}, ("forward", "UNAUTHORIZED_PROTOCOL")),
        ({"domain": "vendor.com"}, ("forward", "UNAUTHORIZED_REMOTE_DOMAIN")),
        ({"domain": None}, ("forward", "MISSING_REQUIRED_FIELD")),
        ({"dst_ip": "198.51.101.7"}, ("forward", "UNAUTHORIZED_REMOTE_IP")),
        ({"src_ip": "192.168.0.1"}, ("forward", "UNAUTHORIZED_LOCAL_IP")),
        ({"src_ip": "nowhere"}, ("forward", "MISSING_REQUIRED_FIELD")),
        ({"direction": "sideways"}, ("forward", "UNKNOWN_NETWORK_DIRECTION")),
        ({"src_ip": "2001:db8::1", "dst_ip": "2001:db9::7"}, ("suppress", "ALLOWED")),
        ({"src_ip": "2001:db8::1", "dst_ip": "2001:dba::7"}, ("forward", "UNAUTHORIZED_REMOTE_IP")),
    ]
    assert decisions(spark, NETWORK, [FLOW | c for c, _ in cases]) == [w for _, w in cases]


def test_malformed_and_unknown_rows_are_forwarded(spark):
    rows = [{"host": "ws1", "malformed": False}, {"host": None, "malformed": True}]
    assert decisions(spark, SYSTEM, rows, malformed="boolean") == [("forward", "UNKNOWN_CATEGORY"), ("forward", "MALFORMED_ROW")]


def test_no_policy_applies(spark):
    document = {k: v for k, v in SYSTEM.items() if k != "system_policies"}
    assert decisions(spark, document, [GOOD]) == [("forward", "NO_APPLICABLE_POLICY")]


@pytest.mark.parametrize(
    "change",
    [
        lambda d: d.update(version=2),
        lambda d: d.update(default_timezone="Mars/One"),
        lambda d: d["system_policies"][0].update(hosts=[]),
        lambda d: d["system_policies"][0].update(enabled="yes"),
        lambda d: d["system_policies"][0].update(local_ips=["300.1.1.1"]),
        lambda d: d["system_policies"][0].update(authorized_identities=[]),
        lambda d: d["system_policies"][0]["authorized_identities"][0].update(users=[], groups=[]),
        lambda d: d["system_policies"][0]["authorized_identities"][0]["authorized_time_windows"][0].update(start="25:00"),
        lambda d: d["system_policies"][0]["authorized_identities"][0]["allowed_programs"][0]["command_line"].update(allowed_patterns=["("]),
        lambda d: d.update(network_policies=[NETWORK["network_policies"][0] | {"local_networks": ["10.0.0.0/40"]}]),
        lambda d: d.update(network_policies=[NETWORK["network_policies"][0] | {"authorized_connections": [{"connection_id": "a", "direction": "up", "remote_ips": ["1.1.1.1"]}]}]),
        lambda d: d.update(network_policies=[NETWORK["network_policies"][0] | {"authorized_connections": [{"connection_id": "a", "direction": "any", "remote_ips": ["1.1.1.1"], "destination_ports": ["9-5"]}]}]),
        lambda d: d.update(prefilters={"severity": {"suppress_values": ["Info"], "always_forward_values": ["info"]}}),
    ],
)
def test_bad_documents_are_refused(change):
    d = copy.deepcopy(SYSTEM)
    change(d)
    with pytest.raises(P.PolicyError):
        P.load_policy(d)


def test_unknown_keys_warn_or_fail():
    assert P.load_policy(SYSTEM | {"extra": 1}).warnings
    with pytest.raises(P.PolicyError):
        P.load_policy(SYSTEM | {"extra": 1}, strict=True)


def test_yaml_with_a_repeated_key_is_refused(tmp_path):
    path = tmp_path / "p.yaml"
    path.write_text("version: 1\nversion: 1\n")
    with pytest.raises(P.PolicyError, match="twice"):
        P.load_policy(str(path))


def test_addresses_are_parsed_once(spark):
    from marlstone.plans.logs import POLICY, log_rows

    out = P.with_decision(log_rows(spark, "/root/testdata/sf0.001"), POLICY).select("event_id", "decision.reason_code")
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert 0 < plan.count("^(25[0-5]") <= 3 * 4  # three addresses of four parts
