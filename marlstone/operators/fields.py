"""Logical fields from physical columns that go by several names."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marlstone.functions.text import canonical, canonical_name, field_tokens

SYSTEM_FIELDS = ("program", "program_path", "parent_program", "command_line", "user", "user_groups")
NETWORK_FIELDS = ("destination_ip", "destination_port", "direction", "domain", "protocol", "source_ip", "source_port")


def resolved(columns: Sequence[str], aliases: Sequence[str]) -> Column:
    """Struct (value, source, original, conflicts) of one logical field.

    The filled aliases count, in order.  If they disagree after canonicalisation the value
    is null and ``conflicts`` names them; else the first gives the value.  A blank field has
    a null value and no conflicts.
    """
    here = [a for a in aliases if a in columns]
    none = F.lit(None).cast("string")
    if not here:
        return F.struct(none.alias("value"), none.alias("source"), none.alias("original"), F.array().cast("array<string>").alias("conflicts"))
    return _decided(_filled(here))


def _filled(here: Sequence[str]) -> Column:
    """Entries (name, raw, text) of the columns that are not blank."""
    entries = F.array(*(F.struct(F.lit(a).alias("name"), F.col(f"`{a}`").cast("string").alias("raw"), canonical(F.col(f"`{a}`").cast("string")).alias("text")) for a in here))
    return F.filter(entries, lambda e: e["text"] != "")


def _decided(filled: Column) -> Column:
    same = F.size(F.array_distinct(F.transform(filled, lambda e: e["text"]))) == 1
    first = F.get(filled, F.lit(0))
    conflicts = F.when(F.size(filled) > 1, F.when(~same, F.transform(filled, lambda e: e["name"])))
    return F.struct(
        F.when(same, first["text"]).alias("value"),
        F.when(same, first["name"]).alias("source"),
        F.when(same, first["raw"]).alias("original"),
        F.coalesce(conflicts, F.array().cast("array<string>")).alias("conflicts"),
    )


def with_fields(df: DataFrame, mappings: Mapping[str, Sequence[str]], name: str = "fields") -> DataFrame:
    """Add a struct column with every logical field resolved."""
    here = {logical: [a for a in aliases if a in df.columns] for logical, aliases in mappings.items()}
    wide = df.withColumn("__entries", F.struct(F.lit(0).alias("__none"), *(_filled(h).alias(k) for k, h in here.items() if h)))
    return wide.withColumn(name, F.struct(*((_decided(F.col("__entries")[k]) if h else resolved((), ())).alias(k) for k, h in here.items()))).drop("__entries")


def canonical_map(mappings: Mapping[str, Sequence[str]], keep_empty: bool = False, name: str = "fields") -> Column:
    """Map of logical names, and of the physical ones that gave the values, to canonical values."""
    pairs = []
    for logical in mappings:
        f = F.col(name)[logical]
        value = F.coalesce(f["value"], F.lit("")) if keep_empty else f["value"]
        pairs += [F.struct(F.lit(logical).alias("k"), value.alias("v")), F.struct(f["source"].alias("k"), f["value"].alias("v"))]
    kept = F.filter(F.array(*pairs), lambda p: p["k"].isNotNull() & p["v"].isNotNull())
    return F.map_from_entries(F.aggregate(kept, F.array().cast("array<struct<k:string,v:string>>"), lambda a, p: F.when(F.exists(a, lambda q: q["k"] == p["k"]), a).otherwise(F.concat(a, F.array(p)))))


def sorted_fields(columns: Sequence[str], excluded: Sequence[str] = ()) -> Column:
    """Array of (column, canonical value) in the order of the names: what makes two events the same."""
    names = sorted(c for c in columns if c not in set(excluded))
    if not names:
        return F.array().cast("array<struct<name:string,value:string>>")
    return F.array(*(F.struct(F.lit(c).alias("name"), canonical(F.col(f"`{c}`").cast("string")).alias("value")) for c in names))


def category(category_value: Column, fields: Column, logical: Sequence[str], aliases: Mapping[str, Sequence[str]]) -> Column:
    """``system``, ``network``, ``system_and_network`` or ``unknown``.

    An explicit category decides through its aliases (one without an alias is unknown);
    without one the fields that are filled decide.
    """

    def chosen(kind: str, names: Sequence[str]) -> tuple[Column, Column]:
        wanted = [kind, *(a.lower() for a in aliases.get(kind, ()))] if kind in aliases else []
        there = [fields[n]["value"].isNotNull() for n in names if n in logical]
        found = F.lit(False)
        for t in there:
            found = found | t
        return category_value.isin(wanted) if wanted else F.lit(False), found

    (is_s, has_s), (is_n, has_n) = chosen("system", SYSTEM_FIELDS), chosen("network", NETWORK_FIELDS)
    given = category_value.isNotNull() & (category_value != "")
    s, n = F.when(given, is_s).otherwise(has_s), F.when(given, is_n).otherwise(has_n)
    return F.when(s & n, "system_and_network").when(s, "system").when(n, "network").otherwise("unknown")


def _tokens(name: Column, value: Column) -> Column:
    parts = F.filter(F.regexp_extract_all(value, F.lit("[A-Za-z0-9]{2,}"), F.lit(0)), lambda p: p != value)
    return F.concat(F.array(F.concat(name, F.lit("="), value)), F.transform(parts, lambda p: F.concat(name, F.lit(":"), p)))


def _text_of(pairs: Column) -> Column:
    """Tokens of (key, value) pairs with a value, each once."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.aggregate(F.filter(pairs, lambda p: p["value"] != ""), none, lambda a, p: F.concat(a, _tokens(p["key"], p["value"]))))


def normalised(df: DataFrame, mappings: Mapping[str, Sequence[str]], text_column: str | None = None, keep_empty: bool = False, name: str = "fields") -> DataFrame:
    """Add ``normalized_text``, ``token_counts``, ``system_evidence`` and ``network_evidence`` to the result of ``with_fields``.

    Tokens are those of the logical and physical names with their canonical values, each once, and of the
    text column if there is one; evidence is the tokens of the fields of one category.  No decision needs them.
    """
    wide = df.withColumn("__pairs", F.map_entries(canonical_map(mappings, keep_empty, name)))
    tokens = _text_of(F.col("__pairs"))
    if text_column and text_column in df.columns:
        tokens = F.array_distinct(F.concat(tokens, field_tokens(text_column, F.col(f"`{text_column}`").cast("string"))))
    wide = wide.withColumn("__tokens", tokens)
    counts = F.map_from_entries(F.transform("__tokens", lambda t: F.struct(t.alias("k"), F.lit(1).alias("v"))))

    def of(names: Sequence[str]) -> Column:
        return _text_of(F.filter("__pairs", lambda p: p["key"].isin(list(names))))

    evidence = {"system_evidence": of(SYSTEM_FIELDS), "network_evidence": of(NETWORK_FIELDS)}
    return wide.withColumns({"normalized_text": F.concat_ws(" ", "__tokens"), "token_counts": counts, **evidence}).drop("__pairs", "__tokens")


__all__ = ["canonical_map", "canonical_name", "category", "normalised", "resolved", "sorted_fields", "with_fields"]
