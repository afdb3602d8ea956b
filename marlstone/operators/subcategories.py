"""Columns of the six feature families, and a log row's tokens in each of them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import row_tokens
from marlstone.operators import signals
from marlstone.operators.model import SUBCATEGORIES

_TIME = "event_time_iso event_time_epoch"
_ENDS = "dst_ip src_ip"
_TCP = " ".join(f"tcp_{f}" for f in sorted(("fin", "syn", "rst", "psh", "ack", "urg", "ece", "cwr")))
_COUNTS = " ".join(f"{f}_count" for f in sorted(("ack", "syn", "fin", "urg", "rst")))
_PROTOCOLS = " ".join(f"protocol_{p}" for p in sorted(("http", "https", "dns", "tcp", "udp", "icmp", "name", "number")))
_TOOL = " ".join(f"{a}tool_{b}" for a in ("", "llm_") for b in ("input", "name", "output"))

COLUMNS: dict[str, tuple[str, ...]] = {
    name: tuple(sorted(set(f"{_TIME} {names}".split())))
    for name, names in {
        "network": f"{_ENDS} src_port dst_port {_TCP} {_COUNTS} {_PROTOCOLS} network_direction duration flow_duration drate srate rate iat header_length packet_number total_sum total_size remote_port remote_address local_port local_address",
        "system": "process_tgid process_ppid process_pid process_exe process_name process_command_line source entity_type entity_id target_entity_id source_entity_id file_mode file_path file_permissions file_subtype group_egid group_gid user_euid user_uid",
        "cross": f"{_ENDS} dst_port src_port flow_duration total_size network_direction process_ppid process_pid process_exe process_name process_command_line",
        "llm": f"{_TOOL} llm_model llm_prompt llm_provider llm_response prompt response session_id user_uid",
        "identity": f"{_ENDS} account_name auth_method group_egid group_gid identity login_result principal session_id target_entity_id source_entity_id user_euid user_uid",
        "cloud": f"{_ENDS} cloud_account cloud_action cloud_identity cloud_provider cloud_region cloud_resource cloud_service entity_id source user_uid",
    }.items()
}
"""Labels are in none of them, so they never become features."""


def checked(wanted: Sequence[str]) -> list[str]:
    if unknown := [s for s in wanted if s not in COLUMNS]:
        raise ValueError(f"unknown subcategories {unknown}")
    return [s for s in SUBCATEGORIES if s in wanted]


def missing_columns(columns: Sequence[str], wanted: Sequence[str] = SUBCATEGORIES) -> dict[str, list[str]]:
    """For each subcategory the columns that a log lacks; ``cross`` works on whatever is there."""
    return {s: [] if s == "cross" else [c for c in COLUMNS[s] if c not in columns] for s in checked(wanted)}


def tokens(df: DataFrame, row: str, wanted: Sequence[str] = SUBCATEGORIES, keep: Sequence[str] = (), minutes: float = 15, novel: Column | None = None) -> DataFrame:
    """(row, keep, subcategory, tokens): field-aware tokens of each subcategory; those of ``cross`` are pairs of signals.

    ``minutes`` is the causal window of the pairs, 0 takes every row by itself.  ``novel`` names
    the kinds for which a row has something new (see ``signals.with_novelty``).
    """
    wanted = checked(wanted)
    plain = F.array(*(F.struct(F.lit(s).alias("subcategory"), row_tokens(df.columns, list(COLUMNS[s]))[0].alias("tokens")) for s in wanted if s != "cross"))
    parts = []
    if any(s != "cross" for s in wanted):
        parts.append(df.select(row, *keep, F.inline(plain)))
    if "cross" in wanted:
        found = signals.context_tokens(df, row, minutes=minutes, novel=novel, partition=keep if minutes > 0 else ()).select(row, *(keep if minutes > 0 else ()), F.col("cross_tokens").alias("tokens"))
        every = df.select(row, *keep).join(found, [row, *(keep if minutes > 0 else ())], "left")
        parts.append(every.select(row, *keep, F.lit("cross").alias("subcategory"), F.coalesce("tokens", F.array().cast("array<string>")).alias("tokens")))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
