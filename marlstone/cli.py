"""Command lines: ``python -m marlstone.cli filter|profile|detect|train|test|indicators|compare|split --help``.

Thin wrappers for ``spark-submit``.  A wrong setting, policy or file ends with code 2, success with 0.
"""

from __future__ import annotations

import argparse
import json
import logging
import sys
from collections.abc import Sequence

from pyspark.errors import AnalysisException
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

LOG = logging.getLogger("marlstone")


def _filter(spark: SparkSession, a: argparse.Namespace) -> None:
    from marlstone.functions.times import event_time
    from marlstone.operators import collapse, policy
    from marlstone.sources import artifacts, sinks, tables

    rules = policy.load_policy(a.policy, strict=a.strict)
    if a.event_id_field and rules.event_id is None:
        raise ValueError("--event-id-field needs prefilters.event_id in the policy")
    if a.severity_field and rules.severity is None:
        raise ValueError("--severity-field needs prefilters.severity in the policy")
    if a.window > 0 and not (a.epoch_field or a.iso_field):
        raise ValueError("--window needs --epoch-field or --iso-field")
    columns = tables.union_header(spark, a.logs, delimiter=a.delimiter, encoding=a.encoding)
    rows = tables.read_csv_lines(spark, a.logs, columns, a.delimiter, a.encoding)
    decided = policy.with_prefilters(policy.with_decision(rows, rules), rules, a.event_id_field, a.severity_field)
    kept, collapsed = policy.forwarded(decided), 0
    if a.window > 0:
        time, issue = event_time(F.col(f"`{a.epoch_field}`") if a.epoch_field in columns else None, F.col(f"`{a.iso_field}`") if a.iso_field in columns else None, rules.zone)
        key = [F.col(f"`{c}`") for c in columns if c not in (a.epoch_field, a.iso_field)] + [F.col("decision.reason_code"), F.col("decision.matched_policy_id")]
        before = kept.count()
        kept = collapse.collapse(kept.withColumn("__time", time).withColumn("__issue", issue), key, "__time", "source_file", "source_row_number", a.window, "__issue", "source_line_number").drop("__time", "__issue")
        collapsed = before - kept.count()
    extra = [c for c in kept.columns if c.startswith(("source_row_numbers", "source_line_numbers", "occurrence", "first_seen", "last_seen", "aggregation_"))]
    sinks.write_csv(sinks.forwarded_columns(kept, columns, extra), a.output)
    out = artifacts.write_summary(policy.summary(decided), f"{a.output}-summary", collapsed)
    LOG.info("%s", json.dumps(out))


def _profile(spark: SparkSession, a: argparse.Namespace) -> None:
    from marlstone.operators import orgs, profile
    from marlstone.sources import tables

    options = profile.Options.read(a.config)
    logs = tables.read_csv_lines(spark, [a.log])
    truth = tables.read_csv_lines(spark, [a.groundtruth])
    name = orgs.label_column([c for c in truth.columns if c not in tables.PROVENANCE], a.label_column)
    rows = orgs.zipped(logs, truth.select("source_row_number", F.col(f"`{name}`").alias("__label")), "source_row_number")
    own = profile.benign(rows, "__label", a.benign_label, "malformed")
    profile.learn(own.drop("__label", *tables.PROVENANCE), options).save(a.output)


def _detect(spark: SparkSession, a: argparse.Namespace) -> None:
    from marlstone.operators import profile
    from marlstone.sources import sinks, tables

    rows = tables.read_csv_lines(spark, [a.log])
    scored = profile.score(rows, profile.Profile.load(spark, a.profile), "source_row_number")
    sinks.write_anomalies(scored, a.output)
    sinks.write_json(scored.where("is_anomaly"), f"{a.output}-lines")


def _train(spark: SparkSession, a: argparse.Namespace) -> None:
    from marlstone.operators import federated

    federated.run(spark, _config(a))


def _test(spark: SparkSession, a: argparse.Namespace) -> None:
    from marlstone.operators import federated

    federated.test(spark, _config(a), a.model)


def _config(a: argparse.Namespace):
    from marlstone.operators import federated

    settings = {}
    if a.config:
        with open(a.config, encoding="utf-8") as f:
            settings = json.load(f)
    given = {"org_data": a.org_data, "org_groundtruth": a.org_groundtruth, "output_dir": a.output, "label_column": a.label_column, "risk_threshold": a.risk_threshold, "num_features": a.num_features, "federation_iterations": a.iterations}
    return federated.Config.of(settings | {k: v for k, v in given.items() if v is not None})


def _indicators(spark: SparkSession, a: argparse.Namespace) -> None:
    from marlstone.operators import indicators
    from marlstone.sources import artifacts, tables

    risky = tables.read_jsonl(spark, a.high_risk, "org_index int, row_index long, internal_log_id string, predicted_label string, max_risk_probability double").withColumn("order", F.monotonically_increasing_id())
    logs = None
    for k, path in enumerate(a.org_data):
        own = tables.read_csv_lines(spark, [path]).withColumn("org_index", F.lit(k)).withColumn("row_index", F.col("source_row_number") - 1).drop(*tables.PROVENANCE)
        logs = own if logs is None else logs.unionByName(own, allowMissingColumns=True)
    artifacts.write_indicators(indicators.records(risky, logs, text_column=a.text_column), a.output)


def _compare(spark: SparkSession, a: argparse.Namespace) -> None:
    from marlstone.operators import indicators
    from marlstone.sources import artifacts

    compared = indicators.compare(*(indicators.stix_indicators(indicators.read_stix(spark, p)) for p in (a.test_file, a.groundtruth_file)))
    artifacts.write_comparison(compared, indicators.quality(compared), a.output)
    for (line,) in artifacts.comparison_table(compared).collect():  # a line for each type
        print(line)


def _split(spark: SparkSession, a: argparse.Namespace) -> None:
    from marlstone.operators import orgs
    from marlstone.sources import artifacts, tables

    raw, truth = (tables.read_csv_lines(spark, [p]).drop("source_file", "source_line_number", "malformed", "malformed_reason") for p in (a.log, a.groundtruth))
    owners = orgs.org_of_ids(raw, a.orgs, a.seed)
    out = artifacts.write_split(raw, truth, orgs.split_rows(raw, owners, "source_row_number"), "source_row_number", a.output, a.seed)
    LOG.info("%s", json.dumps(out))


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="marlstone")
    every = top.add_subparsers(dest="command", required=True)

    def command(name: str, run, *options: tuple[str, dict]) -> None:
        p = every.add_parser(name)
        p.set_defaults(run=run)
        for flag, how in options:
            p.add_argument(flag, **how)

    need = {"required": True}
    many = {"required": True, "nargs": "+"}
    command("filter", _filter, ("--logs", many), ("--policy", need), ("--output", need), ("--delimiter", {"default": ","}), ("--encoding", {"default": "utf-8"}), ("--strict", {"action": "store_true"}), ("--event-id-field", {}), ("--severity-field", {}), ("--epoch-field", {}), ("--iso-field", {}), ("--window", {"type": float, "default": 0.0}))
    command("profile", _profile, ("--log", need), ("--groundtruth", need), ("--config", need), ("--output", need), ("--label-column", {}), ("--benign-label", {"default": "Benign"}))
    command("detect", _detect, ("--log", need), ("--profile", need), ("--output", need))
    run = [("--org-data", many), ("--org-groundtruth", many), ("--output", need), ("--config", {}), ("--label-column", {}), ("--risk-threshold", {"type": float}), ("--num-features", {"type": int}), ("--iterations", {"type": int})]
    command("train", _train, *run)
    command("test", _test, *run, ("--model", need))
    command("indicators", _indicators, ("--high-risk", need), ("--org-data", many), ("--output", need), ("--text-column", {}))
    command("compare", _compare, ("--test-file", need), ("--groundtruth-file", need), ("--output", need))
    command("split", _split, ("--log", need), ("--groundtruth", need), ("--output", need), ("--orgs", {"type": int, "default": 3}), ("--seed", {"type": int, "default": 42}))
    return top


def main(argv: Sequence[str] | None = None, spark: SparkSession | None = None) -> int:
    logging.basicConfig(level=logging.INFO, format="%(levelname)s %(message)s")
    a = parser().parse_args(argv)
    spark = spark or SparkSession.builder.appName("marlstone").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    try:
        a.run(spark, a)
    except (OSError, ValueError, AnalysisException) as wrong:
        LOG.error("%s", wrong)
        return 2
    return 0


if __name__ == "__main__":
    sys.exit(main())
