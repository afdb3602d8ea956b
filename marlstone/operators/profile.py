"""Benign behaviour profiles, for all rows and for each entity, and scores of rows against them.

A profile is three tables keyed by (scope, field): numbers, categories and tokens.  ``scope`` is empty for
the global profile and an entity's key for its own.  Learning is one unpivot and one grouped
aggregation for each kind; detection joins the tables, which are bounded by the options, and projects.
"""

from __future__ import annotations

import json
import uuid
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import canonical, field_tokens, number


BROADCAST_BYTES = 64 << 20
RELATION_ROW = 300
"""Bytes that a field's statistics take in a hashed relation."""


@dataclass(frozen=True)
class Options:
    """Which fields are profiled, how much is kept and when a row is an anomaly."""

    entity: tuple[str, ...] = ()
    categorical: tuple[str, ...] = ()
    numeric: tuple[str, ...] = ()
    text: tuple[str, ...] = ()
    ignored: tuple[str, ...] = ()
    categorical_minimum: int = 1
    token_minimum: int = 1
    entity_minimum: int = 1
    most_entities: int = 1000
    most_values: int = 10_000
    most_tokens: int = 10_000
    numeric_ratio: float = 0.98
    threshold: float = 1.0
    deviations: float = 4.0
    unseen_ratio: float = 0.25
    enforce_range: bool = True
    missing_is_anomaly: bool = True
    unknown_entity_is_anomaly: bool = True
    weights: dict[str, float] = field(default_factory=dict)

    def weight(self, code: str) -> float:
        return float(self.weights.get(code, 1.0))

    @classmethod
    def of(cls, d: dict) -> "Options":
        """Checked options from a mapping; an unknown key, a doubled field or a bad number is an error."""
        if unknown := set(d) - set(cls.__dataclass_fields__):
            raise ValueError(f"unknown options {sorted(unknown)}")
        o = cls(**{k: tuple(v) if isinstance(v, list) else v for k, v in d.items()})
        fields = [*o.categorical, *o.numeric, *o.text]
        if len(fields) != len(set(fields)):
            raise ValueError("a field has two kinds")
        if not 0 < o.numeric_ratio <= 1 or not 0 <= o.unseen_ratio <= 1 or o.threshold <= 0 or o.deviations <= 0:
            raise ValueError("a ratio, the threshold or the deviations are out of range")
        if min(o.most_entities, o.most_values, o.most_tokens, o.categorical_minimum, o.token_minimum, o.entity_minimum) < 1:
            raise ValueError("counts must be 1 or more")
        return o


    @classmethod
    def read(cls, path: str) -> "Options":
        """Options from a YAML or JSON file; a file that is no mapping is an error."""
        with open(path, encoding="utf-8") as f:
            text = f.read()
        if path.lower().endswith(".json"):
            d = json.loads(text)
        else:
            import yaml

            d = yaml.safe_load(text)
        if not isinstance(d, dict):
            raise ValueError(f"{path} holds no mapping")
        return cls.of(d)


_TIMES = ("timestamp", "event_time", "event_time_iso", "event_time_epoch", "datetime", "date", "time", "ts")


def candidate_fields(columns: list[str], o: Options) -> list[str]:
    """The columns to profile: named ones must be there; times, entity and ignored columns are left out."""
    named = [*o.categorical, *o.numeric, *o.text]
    if absent := [c for c in [*named, *o.entity] if c not in columns]:
        raise ValueError(f"columns that are not there: {absent}")
    return [c for c in columns if c in named or (c not in o.ignored and c not in o.entity and c.lower() not in _TIMES)]


def entity_key(o: Options) -> Column:
    """Key of a row's entity; null where a part of it is blank."""
    if not o.entity:
        return F.lit(None).cast("string")
    parts = [canonical(F.col(f"`{c}`").cast("string")) for c in o.entity]
    filled = parts[0] != ""
    for p in parts[1:]:
        filled = filled & (p != "")
    return F.when(filled, F.to_json(F.array(*parts)))


def unpivoted(df: DataFrame, fields: list[str], *keep: Column, tokens: bool = False) -> DataFrame:
    """(…keep, field, value, tokens): a row for each profiled cell; value and tokens are empty when blank.  Tokens cost much and are made if asked for."""

    def cell(c: str) -> Column:
        text = F.col(f"`{c}`").cast("string")
        return F.struct(F.lit(c).alias("field"), canonical(text).alias("value"), *([field_tokens(c, text).alias("tokens")] if tokens else []))

    return df.select(*keep, F.inline(F.array(*map(cell, fields))))


@dataclass
class Profile:
    """``stats`` (scope, field, kind, count, missing, minimum, maximum, mean, deviation), ``values`` and ``tokens`` (scope, field, value, n), ``entities`` (scope, rows)."""

    options: Options
    stats: DataFrame
    values: DataFrame
    tokens: DataFrame
    entities: DataFrame

    def save(self, path: str) -> None:
        """Write the tables to a new version's folder, then the one line that names it: a reader sees the old profile or the new one."""
        spark, version = self.stats.sparkSession, f"version-{uuid.uuid4().hex}"
        for name in ("stats", "values", "tokens", "entities"):
            getattr(self, name).write.parquet(f"{path}/{version}/{name}")
        spark.createDataFrame([(1, json.dumps(asdict(self.options), sort_keys=True), version)], "version int, options string, folder string").coalesce(1).write.mode("append").json(f"{path}/profile")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> "Profile":
        """The version written last."""
        rows = spark.read.schema("version int, options string, folder string").json(f"{path}/profile").select("*", "_metadata.file_modification_time", "_metadata.file_name")
        row = rows.orderBy(F.desc("file_modification_time"), F.desc("file_name")).first()
        if row is None or row["version"] != 1 or not row["options"]:
            raise ValueError(f"{path} is no profile of version 1")
        o = Options.of(json.loads(row["options"]))
        return cls(o, *(spark.read.parquet(f"{path}/{row['folder']}/{n}") for n in ("stats", "values", "tokens", "entities")))


def benign(df: DataFrame, label: str, benign_label: str = "Benign", malformed: str | None = None) -> DataFrame:
    """The rows with the benign label (case and white space around don't count) that are not malformed."""
    out = df.where(F.lower(F.trim(F.col(label))) == benign_label.strip().lower())
    return out.where(~F.coalesce(F.col(malformed), F.lit(False))) if malformed else out


def _kept(counts: DataFrame, most: int, least: int, name: str) -> DataFrame:
    """Counts of at least ``least``.  Up to twice ``most`` different values all are kept, beyond that the ``most`` most frequent."""
    by = Window.partitionBy("scope", "field")
    ranked = counts.withColumns({"__d": F.count("*").over(by), "__r": F.row_number().over(by.orderBy(F.desc("n"), name))})
    return ranked.where((F.col("__d") <= 2 * most) | (F.col("__r") <= most)).where(F.col("n") >= least).drop("__d", "__r")


def _numeric_stats(keyed: DataFrame, names: list[str], entities: DataFrame) -> DataFrame:
    """Statistics of columns that are numbers, of all rows and of the entities, from one aggregation by entity."""
    cells = keyed.select("__scope", F.inline(F.array(*(F.struct(F.lit(c).alias("field"), F.col(f"`{c}`").cast("double").alias("x")) for c in names))))
    x = F.when(F.abs("x") < float("inf"), F.col("x"))
    each = cells.groupBy("__scope", "field").agg(F.count("*").alias("rows"), F.count("x").alias("count"), F.count(x).alias("numbers"), F.min(x).alias("minimum"), F.max(x).alias("maximum"), F.avg(x).alias("mean"), (F.var_pop(x) * F.count(x)).alias("m2"))
    own = each.withColumnRenamed("__scope", "scope").join(entities.select("scope"), "scope", "left_semi")
    middle = each.groupBy("field").agg((F.sum(F.col("mean") * F.col("numbers")) / F.sum("numbers")).alias("middle"))
    spread = F.col("m2") + F.col("numbers") * F.pow(F.col("mean") - F.col("middle"), F.lit(2))
    every = each.join(F.broadcast(middle), "field").groupBy(F.lit("").alias("scope"), "field").agg(F.sum("rows").alias("rows"), F.sum("count").alias("count"), F.sum("numbers").alias("numbers"), F.min("minimum").alias("minimum"), F.max("maximum").alias("maximum"), F.first("middle").alias("mean"), F.sum(spread).alias("m2"))
    names_ = ["scope", "field", "rows", "count", (F.col("rows") - F.col("count")).alias("missing"), "numbers", "minimum", "maximum", "mean", F.sqrt(F.col("m2") / F.nullif(F.col("numbers"), F.lit(0))).alias("deviation")]
    return every.select(*names_).unionByName(own.select(*names_))


def learn(df: DataFrame, o: Options, order: Column | None = None) -> Profile:
    """Learn a profile of rows that are all taken for benign.

    Entities beyond ``most_entities`` (by first occurrence in ``order``, else by key) and those
    with fewer than ``entity_minimum`` rows have no profile of their own.  Counts are exact.
    """
    fields = candidate_fields(df.columns, o)
    if not fields:
        raise ValueError("there is no field to profile")
    keyed = df.withColumn("__scope", entity_key(o))
    first = keyed.where("__scope is not null").groupBy(F.col("__scope").alias("scope")).agg(F.count("*").alias("rows"), F.min(order if order is not None else F.col("__scope")).alias("__first"))
    entities = first.orderBy("__first", "scope").limit(o.most_entities).where(F.col("rows") >= o.entity_minimum).select("scope", "rows")
    total = keyed.agg(F.lit("").alias("scope"), F.count("*").alias("rows"))
    numbers = [f for f in o.numeric if isinstance(df.schema[f].dataType, T.NumericType)]  # these need no text
    stats = _numeric_stats(keyed, numbers, entities) if numbers else None
    rest = [f for f in fields if f not in numbers]
    given = [(f, k) for k in ("categorical", "numeric", "text") for f in getattr(o, k)]
    own = keyed.join(entities.select(F.col("scope").alias("__scope")), "__scope", "left_semi") if o.entity else None

    def of_both(names: list[str], tokens: bool = False) -> DataFrame:
        cells = unpivoted(keyed if names else keyed.where("false"), names or fields[:1], F.lit("").alias("scope"), tokens=tokens)
        return cells if own is None or not names else cells.unionByName(unpivoted(own, names, F.col("__scope").alias("scope"), tokens=tokens))

    cells = of_both(rest)
    n, filled = number(F.col("value")), F.col("value") != ""
    textual = cells.groupBy("scope", "field").agg(F.count("*").alias("rows"), F.count_if(filled).alias("count"), F.count_if(~filled).alias("missing"), F.count(n).alias("numbers"), F.min(n).alias("minimum"), F.max(n).alias("maximum"), F.avg(n).alias("mean"), F.stddev_pop(n).alias("deviation"))
    stats = textual if stats is None else stats.unionByName(textual) if rest else stats
    values = cells.where(filled).groupBy("scope", "field", "value").agg(F.count("*").alias("n"))
    explicit = F.create_map(*(F.lit(x) for pair in given for x in pair)) if given else F.lit(None).cast("map<string,string>")
    known = stats.where("scope = ''")
    if set(fields) <= {f for f, _ in given}:
        kinds = known.select("field", F.try_element_at(explicit, F.col("field")).alias("kind"))
    else:  # only then are different values counted
        variety = values.where("scope = ''").groupBy("field").agg(F.count("*").alias("kinds"))
        guess = F.when(F.col("numbers") / F.col("count") >= o.numeric_ratio, "numeric").when(F.coalesce("kinds", F.lit(0)) <= o.most_values, "categorical").otherwise("text")
        kinds = known.join(variety, "field", "left").select("field", F.coalesce(F.try_element_at(explicit, F.col("field")), F.when(F.col("count") > 0, guess)).alias("kind")).where("kind is not null")
    kinds = F.broadcast(kinds)  # one row a column
    worded = [f for f in rest if dict(given).get(f, "text") == "text"]
    tokens = of_both(worded, True).join(kinds.where("kind = 'text'"), "field").select("scope", "field", F.explode("tokens").alias("value")).groupBy("scope", "field", "value").agg(F.count("*").alias("n"))
    stats = stats.join(kinds, "field").where("kind <> 'numeric' or numbers > 0").select("scope", "field", "kind", F.when(F.col("kind") == "numeric", F.col("numbers")).otherwise(F.col("count")).alias("count"), "missing", "minimum", "maximum", "mean", "deviation")
    values = values.join(kinds.where("kind = 'categorical'").select("field"), "field", "left_semi")
    return Profile(o, stats, _kept(values, o.most_values, o.categorical_minimum, "value"), _kept(tokens, o.most_tokens, o.token_minimum, "value"), total.unionByName(entities))


def _evidence(code: str, field: Column | None, details: Column | str, weight: float) -> Column:
    details = details if isinstance(details, Column) else F.lit(details)
    return F.struct(F.lit(code).alias("reason_code"), (field if field is not None else F.lit(None)).cast("string").alias("field"), details.alias("details"), F.lit(weight).alias("score"))


def short(c: Column) -> Column:
    """Four significant digits, as short as they can be."""
    digits = 3 - F.floor(F.log10(F.greatest(F.abs(c), F.lit(1e-300))))
    scaled = F.rint(c * F.pow(F.lit(10.0), digits)) / F.pow(F.lit(10.0), digits)
    return F.when(c == 0, "0").otherwise(F.regexp_replace(F.format_string("%.6f", scaled), r"\.?0+$", ""))


def score(df: DataFrame, profile: Profile, row: str) -> DataFrame:
    """(row, is_anomaly, anomaly_score, profile_scope, evidence): each row against the profile of its entity, else the global one.

    ``row`` names a column that tells rows apart.  A field that the entity's profile lacks
    is held against the global one.  A column ``malformed`` makes a row an anomaly whatever it has.
    """
    o = profile.options
    kinds = {r["field"]: r["kind"] for r in profile.stats.where("scope = ''").select("field", "kind").collect()}  # one row a column
    fields = sorted(c for c in df.columns if c in kinds)
    keyed = df.select("*", entity_key(o).alias("__entity"))
    known = profile.entities.where("scope <> ''").select(F.col("scope").alias("__known"))
    entities = profile.entities.count()
    small = (lambda x: F.broadcast(x)) if entities * (len(fields) + 1) * RELATION_ROW <= BROADCAST_BYTES else (lambda x: x)
    keyed = keyed.join(small(known), F.col("__entity") == F.col("__known"), "left")
    bad = F.coalesce(F.col("malformed").cast("boolean"), F.lit(False)) if "malformed" in df.columns else F.lit(False)
    scope = F.coalesce("__known", F.lit(""))
    stats = profile.stats
    own = stats.where("scope <> ''").select("scope", "field", F.struct("*").alias("own"))
    all_ = stats.where("scope = ''").select("field", F.struct("*").alias("every"))

    def cells(kind: str) -> DataFrame:
        """The rows' cells of one kind with the statistics that they are held against."""
        flat = unpivoted(keyed.where(~bad), [c for c in fields if kinds[c] == kind], F.col(row).alias("__row"), scope.alias("scope"), tokens=kind == "text")
        flat = flat.join(small(own), ["scope", "field"], "left") if o.entity else flat.withColumn("own", F.lit(None).cast(own.schema["own"].dataType))
        flat = flat.join(F.broadcast(all_), "field", "left").withColumn("s", F.coalesce("own", "every")).where("s is not null")  # ``all_``: one row a column
        return flat.withColumns({"__s": F.col("s.scope"), "__f": F.col("s.field")})

    names_, parts = ["__row", "scope", "field", "value", "s", "allowed", "unseen", "total"], []
    there = {kinds[c] for c in fields}
    if "categorical" in there:
        kept = profile.values.select(F.col("scope").alias("__s"), F.col("field").alias("__f"), "value", F.lit(True).alias("allowed"))
        parts.append(cells("categorical").join(kept, ["__s", "__f", "value"], "left").withColumn("unseen", F.lit(0)).withColumn("total", F.lit(0)).select(*names_))
    if "numeric" in there or not there:
        none_ = unpivoted(keyed.where("false"), [row], F.col(row).alias("__row"), scope.alias("scope")).crossJoin(all_.limit(0).select(F.col("every").alias("s"))) if not there else cells("numeric")
        parts.append(none_.withColumns({"allowed": F.lit(True), "unseen": F.lit(0), "total": F.lit(0)}).select(*names_))
    if "text" in there:
        vocabulary = profile.tokens.select(F.col("scope").alias("__s"), F.col("field").alias("__f"), F.col("value").alias("token"), F.lit(1).alias("hit"))
        words = cells("text").select("__row", "scope", "field", "value", "s", "__s", "__f", F.explode_outer("tokens").alias("token")).join(vocabulary, ["__s", "__f", "token"], "left")
        text = words.groupBy("__row", "scope", "field").agg(F.first("value").alias("value"), F.first("s").alias("s"), F.count("token").cast("int").alias("total"), F.count_if(F.col("token").isNotNull() & F.col("hit").isNull()).cast("int").alias("unseen")).withColumn("allowed", F.lit(True))
        parts.append(text.select(*names_))
    checked = parts[0]
    for part in parts[1:]:
        checked = checked.unionByName(part)

    f, blank, x, s = F.col("field"), F.col("value") == "", number(F.col("value")), F.col("s")
    z = F.when(s["deviation"] > 0, F.abs(x - s["mean"]) / s["deviation"]).otherwise(F.lit(0.0))
    outside = F.lit(o.enforce_range) & ~x.between(s["minimum"], s["maximum"])
    far = z > o.deviations
    why = F.concat_ws("; ", F.when(outside, "outside the benign range"), F.when(far, F.concat(F.lit("z-score "), short(z), F.lit(f" is over {o.deviations:g}"))))
    ratio = F.col("unseen") / F.col("total")
    found = (
        F.when(blank, F.when(F.lit(o.missing_is_anomaly) & (s["missing"] == 0), _evidence("MISSING_PROFILED_FIELD", f, "a profiled field is blank", o.weight("missing_field"))))
        .when(s["kind"] == "categorical", F.when(F.col("allowed").isNull(), _evidence("UNKNOWN_CATEGORICAL_VALUE", f, "the value is not in the profile", o.weight("unknown_categorical_value"))))
        .when((s["kind"] == "numeric") & x.isNull(), _evidence("NUMERIC_VALUE_MALFORMED", f, "not a finite number", o.weight("numeric_outlier")))
        .when(s["kind"] == "numeric", F.when(outside | far, _evidence("NUMERIC_OUTSIDE_BENIGN_PROFILE", f, why, o.weight("numeric_outlier"))))
        .when(ratio > o.unseen_ratio, _evidence("UNSEEN_TEXT_TOKENS", f, F.concat(F.col("unseen").cast("string"), F.lit("/"), F.col("total").cast("string"), F.lit(" tokens are new; ratio "), short(ratio), F.lit(f" is over {o.unseen_ratio:g}")), o.weight("unseen_text_tokens")))
    )
    rank = F.array_position(F.array(F.lit("categorical"), F.lit("numeric"), F.lit("text")), s["kind"])
    per_row = checked.groupBy("__row").agg(F.sort_array(F.collect_list(F.when(found.isNotNull(), F.struct(rank.alias("k"), f.alias("f"), found.alias("e"))))).alias("found"), F.count_if(~blank).alias("evaluated"))
    out = keyed.select(F.col(row).alias("__row"), "__entity", "__known", bad.alias("__bad"), *([F.col("malformed_reason").alias("__why")] if "malformed_reason" in df.columns else [F.lit(None).cast("string").alias("__why")])).join(per_row, "__row", "left")
    none = F.array().cast("array<struct<reason_code:string,field:string,details:string,score:double>>")
    stranger = F.lit(bool(o.entity) and o.unknown_entity_is_anomaly) & F.col("__known").isNull()
    listed = F.concat(F.when(stranger, F.array(_evidence("UNKNOWN_ENTITY", F.lit(",".join(o.entity)), "the entity has no profile", o.weight("unknown_entity")))).otherwise(none), F.coalesce(F.transform("found", lambda e: e["e"]), none))
    listed = F.when((F.coalesce("evaluated", F.lit(0)) == 0) & (F.size(listed) == 0), F.array(_evidence("INSUFFICIENT_PROFILE_EVIDENCE", None, "no profiled field has a value", o.weight("insufficient_evidence")))).otherwise(listed)
    listed = F.when(F.col("__bad"), F.array(_evidence("MALFORMED_ROW", None, F.coalesce("__why", F.lit("malformed row")), max(o.weight("malformed_row"), o.threshold)))).otherwise(listed)
    total = F.aggregate(F.col("evidence"), F.lit(0.0), lambda a, e: a + e["score"])
    shown = F.when(F.col("__bad"), "none").when(F.col("__known").isNotNull(), "entity").otherwise("global")
    return out.withColumn("evidence", listed).select(F.col("__row").alias(row), (F.col("__bad") | (total >= o.threshold)).alias("is_anomaly"), total.alias("anomaly_score"), shown.alias("profile_scope"), "evidence")


def with_options(profile: Profile, **changes) -> Profile:
    return replace(profile, options=replace(profile.options, **changes))
