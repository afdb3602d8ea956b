"""The federated flow from files to files, its settings, and the command lines."""

import json

import pytest

from marlstone import cli
from marlstone.operators import federated, profile, signals, subcategories
from marlstone.sources import artifacts, tables


@pytest.fixture(scope="module")
def orgs(tmp_path_factory):
    """Two organisations, 30 rows each: benign web flows and attacks with words of their own."""
    base = tmp_path_factory.mktemp("orgs")
    logs, truths = [], []
    for k in range(2):
        log, truth = ["event_time_iso,src_ip,dst_ip,dst_port,process_name,process_command_line,user_uid,login_result,log_id"], ["Tactic,more"]
        for i in range(30):
            bad = i % 3 == 0
            log.append(f"2024-01-01T10:{i:02d}:00Z,10.0.{k}.{i % 4},192.0.2.{i % 5},{'4444' if bad else '443'}.0,{'evil.exe' if bad else 'web.exe'},{'powershell -enc payload' if bad else 'open page'},{i % 3},{'failed login' if bad else 'accepted'},id{i}")
            truth.append(f"{'Exfil' if bad else 'Benign'},x")
        logs.append(base / f"log{k}.csv")
        truths.append(base / f"truth{k}.csv")
        logs[k].write_text("\n".join(log) + "\n")
        truths[k].write_text("\n".join(truth) + "\n")
    return [str(p) for p in logs], [str(p) for p in truths], base


def config(orgs, **more):
    logs, truths, base = orgs
    return federated.Config.of({"org_data": logs, "org_groundtruth": truths, "output_dir": str(base / "out"), "label_column": "Tactic", "federation_iterations": 2, "num_features": 50, "min_df": 1, "learning_rate": 0.5, "local_epochs": 3} | more)


def test_train_predict_and_test_from_files(spark, orgs):
    trained = federated.run(spark, config(orgs))
    out = config(orgs).output_dir
    assert trained.labels == ["benign", "exfil"] and set(trained.hierarchy.subcategories["exfil"]) == {"system", "network", "llm", "cross"}
    rows = spark.read.json(f"{out}/predictions/predictions").collect()
    assert len(rows) == 60 and {r.internal_log_id for r in rows} == {f"org_{k}_row_{i}" for k in range(2) for i in range(30)}
    assert all(abs(sum(json.loads(r.probabilities).values() if isinstance(r.probabilities, str) else r.probabilities.asDict().values()) - 1) < 1e-9 for r in rows)
    accuracy = {r.org: (r.rows, r.accuracy) for r in spark.read.json(f"{out}/accuracy").collect()}
    assert accuracy["all"][0] == 12 and accuracy["all"][1] >= 0.9
    assert artifacts.read_baseline(spark, f"{out}/baseline").where("kind = 'destination_ips'").count() > 0
    scored = federated.test(spark, config(orgs, output_dir=out + "-test", risk_threshold=0.5), f"{out}/model")
    right = {(r.org_index, r.row_index): r.predicted_label for r in scored.predictions.collect()}
    assert sum(v == ("exfil" if i % 3 == 0 else "benign") for (_, i), v in right.items()) >= 54
    assert scored.explanations.where("size(top_contributions) > 0").count() > 0
    assert "accuracy" in "\n".join(r[0] for r in spark.read.text(f"{out}-test/report").collect())
    with pytest.raises(ValueError, match="does not know"):
        federated.known_only(spark.createDataFrame([(0, "new")], "org_index int, label string"), spark.createDataFrame([("benign",)], "label string"))


@pytest.mark.parametrize(
    "wrong",
    [{"num_features": 0}, {"test_size": 1.0}, {"risk_threshold": 2}, {"class_weight": "odd"}, {"context_window_minutes": 7.0}, {"context_timestamp_iso_field": "event_time_epoch"}, {"org_groundtruth": []}, {"odd": 1}, {"aggregation_weighting": "x"}, {"min_df": 0}],
)
def test_settings_are_checked(orgs, wrong):
    with pytest.raises(ValueError):
        config(orgs, **wrong)


def test_settings_tell_what_weights_depend_on():
    d = json.loads(federated.Config().to_json())
    assert d["cross_vocabulary"]["size"] == len(signals.TOKENS) == 1000 and d["tags"]["format"] == "subcategory|token" and d["cross_context"]["window_minutes"] == 15


def test_subcategories_never_hold_labels():
    assert list(subcategories.checked(["cross", "system"])) == ["system", "cross"]
    assert all("label" not in c for names in subcategories.COLUMNS.values() for c in names)
    assert subcategories.missing_columns(["src_ip"], ["identity", "cross"])["cross"] == []
    with pytest.raises(ValueError):
        subcategories.checked(["odd"])


def test_a_bad_line_is_named(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": 1}\n\n{"a": 2}\n')
    assert tables.read_jsonl(spark, str(tmp_path / "a.jsonl"), "a int").count() == 2
    (tmp_path / "b.jsonl").write_text('{"a": 1}\n\nnothing\n')
    with pytest.raises(ValueError, match=r"b\.jsonl:3"):
        tables.read_jsonl(spark, str(tmp_path / "b.jsonl"), "a int")


def test_options_from_files(tmp_path):
    (tmp_path / "o.yaml").write_text("entity: [host]\nnumeric: [duration]\nthreshold: 2\n")
    (tmp_path / "o.json").write_text('{"entity": ["host"], "numeric": ["duration"], "threshold": 2}')
    assert profile.Options.read(str(tmp_path / "o.yaml")) == profile.Options.read(str(tmp_path / "o.json"))
    (tmp_path / "bad.yaml").write_text("- a\n")
    with pytest.raises(ValueError):
        profile.Options.read(str(tmp_path / "bad.yaml"))


def test_baseline_of_another_version_is_refused(spark, tmp_path):
    tags = spark.createDataFrame([("1", "domains", "a" * 64)], "org_index string, kind string, tag string")
    artifacts.write_baseline(tags, str(tmp_path / "b"))
    assert artifacts.read_baseline(spark, str(tmp_path / "b")).count() == 1
    artifacts.write_document(spark, {"version": 9}, str(tmp_path / "b" / "head"))
    with pytest.raises(ValueError, match="version"):
        artifacts.read_baseline(spark, str(tmp_path / "b"))


POLICY = """
version: 1
organization_id: org
default_timezone: UTC
field_mappings: {timestamp: [time], host: [host], user: [user], program: [program]}
system_policies:
  - policy_id: sys
    hosts: [h]
    authorized_identities: [{identity_id: i, users: [u], allowed_programs: [{name: p}]}]
"""


def test_command_lines(spark, orgs, tmp_path):
    logs, truths, _ = orgs
    log = tmp_path / "log.csv"
    log.write_text("time,host,user,program\n" + "2024-01-01T10:00:00Z,h,u,p\n2024-01-01T10:01:00Z,h,x,p\n2024-01-01T10:02:00Z,h,x,p\n")
    (tmp_path / "policy.yaml").write_text(POLICY)
    out = str(tmp_path / "out")
    assert cli.main(["filter", "--logs", str(log), "--policy", str(tmp_path / "policy.yaml"), "--output", out, "--iso-field", "time", "--window", "15"], spark) == 0
    rows = tables.read_csv(spark, out).collect()
    assert [(r.filter_reason, r.occurrence_count, r.user) for r in rows] == [("UNAUTHORIZED_USER", "2", "x")]
    assert artifacts.read_document(spark, f"{out}-summary") == {"total_rows": 3, "forwarded_rows": 2, "suppressed_rows": 1, "suppressed_share": 1 / 3, "collapsed_rows": 1, "rows_by_reason": {"ALLOWED": 1, "UNAUTHORIZED_USER": 2}}
    assert cli.main(["filter", "--logs", str(log), "--policy", str(tmp_path / "policy.yaml"), "--output", out, "--severity-field", "s"], spark) == 2
    assert cli.main(["filter", "--logs", str(log), "--policy", str(tmp_path / "absent.yaml"), "--output", out], spark) == 2
    (tmp_path / "options.json").write_text('{"categorical": ["process_name"], "numeric": ["dst_port"], "ignored": ["log_id", "event_time_iso", "src_ip", "dst_ip", "process_command_line", "user_uid", "login_result"]}')
    assert cli.main(["profile", "--log", logs[0], "--groundtruth", truths[0], "--label-column", "Tactic", "--config", str(tmp_path / "options.json"), "--output", f"{out}-profile"], spark) == 0
    assert cli.main(["detect", "--log", logs[1], "--profile", f"{out}-profile", "--output", f"{out}-anomalies"], spark) == 0
    assert tables.read_csv(spark, f"{out}-anomalies").count() == 10
    (tmp_path / "ids.csv").write_text("normalized_id,x\na,1\nb,2\nnan,3\na,4\n")
    (tmp_path / "gold.csv").write_text("label\nq\nq\nq\nq\n")
    assert cli.main(["split", "--log", str(tmp_path / "ids.csv"), "--groundtruth", str(tmp_path / "gold.csv"), "--output", f"{out}-split", "--orgs", "2"], spark) == 0
    assert artifacts.read_document(spark, f"{out}-split/summary")["unassigned_rows"] == 1
    for name, host in (("a", "x.org"), ("b", "y.org")):
        (tmp_path / f"{name}.jsonl").write_text(json.dumps({"type": "indicator", "pattern": f"[domain-name:value = '{host}']"}) + "\n" + json.dumps({"type": "indicator", "pattern": "[ipv4-addr:value = '192.0.2.1']"}) + "\n")
    assert cli.main(["compare", "--test-file", str(tmp_path / "a.jsonl"), "--groundtruth-file", str(tmp_path / "b.jsonl"), "--output", f"{out}-compared"], spark) == 0
    assert spark.read.json(f"{out}-compared/overall").first()["true_positives"] == 1
