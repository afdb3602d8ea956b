"""String expressions: blank tests, canonical values, tokens, ranges and entropy.

All but ``token_counts`` are Column expressions, so they stay in generated code.  Blank is null, empty or white
space only; white space is Unicode's.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.batches import bounded_batches, trimmed

FLOAT = r"^[+-]?(\d(_?\d)*\.?(\d(_?\d)*)?|\.\d(_?\d)*)(e[+-]?\d+)?$"
_WHITE = "".join(map(chr, [*range(9, 14), *range(28, 33), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]))


def strip(c: Column) -> Column:
    return F.btrim(c, F.lit(_WHITE))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def canonical(c: Column) -> Column:
    """Trimmed, lower-case, every run of white space one underscore; empty for a blank value."""
    return F.coalesce(F.regexp_replace(F.lower(strip(c)), r"(?U)\s+", "_"), F.lit(""))


def canonical_name(name: str) -> str:
    return "_".join(name.strip().lower().split())


def field_tokens(name: str, c: Column) -> Column:
    """``[name=value]`` and ``name:part`` for each alphanumeric part of two or more characters; none for a blank value."""
    field, value = canonical_name(name), canonical(c)
    parts = F.filter(F.regexp_extract_all(value, F.lit("[A-Za-z0-9]{2,}"), F.lit(0)), lambda p: p != value)
    tokens = F.concat(F.array(F.concat(F.lit(f"{field}="), value)), F.transform(parts, lambda p: F.concat(F.lit(f"{field}:"), p)))
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.array_distinct(tokens))


def row_tokens(df_columns: list[str], wanted: list[str]) -> tuple[Column, list[str]]:
    """(tokens of all the wanted columns that are there, names of those that are not)."""
    here = [w for w in wanted if w in df_columns]
    tokens = F.flatten(F.array(*(field_tokens(w, F.col(f"`{w}`").cast("string")) for w in here))) if here else F.array().cast("array<string>")
    return tokens, [w for w in wanted if w not in df_columns]


def joined_text(names: list[str]) -> Column:
    """The filled columns with a space in between."""
    return F.concat_ws(" ", *(F.when(~is_blank(F.col(f"`{n}`").cast("string")), F.col(f"`{n}`").cast("string")) for n in names))


_QUOTES = "\"'`“”‘’()\\[\\]{}<>;,"


def tokenize(c: Column) -> Column:
    """Lower-case words without surrounding quotes and brackets.

    A word with ``=`` or ``:`` stays whole (without ``.,;`` at its ends); others are split at
    everything that is not a letter or digit.  Tokens have two characters or more.
    """
    words = F.filter(F.transform(F.split(F.lower(F.coalesce(c, F.lit(""))), r"(?U)\s+"), lambda w: F.regexp_replace(w, f"^[{_QUOTES}]+|[{_QUOTES}]+$", "")), lambda w: w != "")
    parts = F.transform(words, lambda w: F.when(w.rlike("[=:]"), F.array(F.regexp_replace(w, "^[.,;]+|[.,;]+$", ""))).otherwise(F.split(w, "[^a-z0-9]+")))
    return F.filter(F.flatten(parts), lambda t: F.length(t) >= 2)


_AROUND, _ENDS, _BETWEEN = re.compile(f"^[{_QUOTES}]+|[{_QUOTES}]+\\Z"), re.compile(r"^[.,;]+|[.,;]+\Z"), re.compile("[^a-z0-9]+")
PIECE_BYTES = 1 << 20


def word_tokens(word: str) -> list[str]:
    """Tokens of one lower-case word, as ``tokenize`` makes them."""
    if word.isascii() and word.isalnum():
        return [word] if len(word) > 1 else []
    bare = _AROUND.sub("", word)
    return [t for t in ([_ENDS.sub("", bare)] if "=" in bare or ":" in bare else _BETWEEN.split(bare)) if len(t) > 1]


def _counted(rows: pa.RecordBatch, schema: pa.Schema) -> pa.RecordBatch:
    """Tokens of each text (the last column) and their numbers; the texts are lower case with spaces only."""
    words = pc.split_pattern(rows.column(rows.num_columns - 1), " ")
    row = np.repeat(np.arange(rows.num_rows), pc.list_value_length(words).to_numpy(zero_copy_only=False))
    coded = words.flatten().dictionary_encode()  # different words are looked at once
    number: dict[str, int] = {}
    own = [[number.setdefault(t, len(number)) for t in word_tokens(w)] for w in coded.dictionary.to_pylist()]
    size = np.fromiter(map(len, own), np.int64, len(own))
    flat, start = np.fromiter((k for ks in own for k in ks), np.int64, size.sum()), np.cumsum(size) - size
    code = coded.indices.to_numpy(zero_copy_only=False)
    many = size[code]
    at = np.repeat(start[code] - (np.cumsum(many) - many), many) + np.arange(many.sum())
    pair, tf = np.unique(np.repeat(row, many) * max(len(number), 1) + flat[at], return_counts=True)
    row, token = np.divmod(pair, max(len(number), 1))
    kept = [c.take(pa.array(row)) for c in rows.columns[:-1]]
    return pa.RecordBatch.from_arrays([*kept, pa.array(list(number), pa.string()).take(pa.array(token)), pa.array(tf, pa.int64())], schema=schema)


def token_counts(df: DataFrame, text: Column, *keep: str) -> DataFrame:
    """(keep, token, tf): the different tokens of each row's text, as ``tokenize`` makes them, with their numbers.

    A piece of rows is split and counted at once by Arrow and numpy, and only its different words are looked at;
    a row for each word would cost more than all that follows.
    """
    bounded_batches(df.sparkSession)
    flat = df.select(*keep, F.translate(F.lower(F.coalesce(text, F.lit(""))), _WHITE, " " * len(_WHITE)).alias("__text"))
    fields = T.StructType([*flat.schema.fields[:-1], T.StructField("token", T.StringType()), T.StructField("tf", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            schema = pa.schema([*(batch.schema.field(i) for i in range(batch.num_columns - 1)), ("token", pa.string()), ("tf", pa.int64())])
            ends = np.cumsum(pc.binary_length(batch.column(batch.num_columns - 1)).to_numpy(zero_copy_only=False), dtype=np.int64)
            first = 0
            while first < batch.num_rows:
                last = max(first + 1, int(np.searchsorted(ends, (ends[first - 1] if first else 0) + PIECE_BYTES, "right")))
                yield _counted(batch.slice(first, last - first), schema)
                first = last

    return flat.mapInArrow(trimmed(run), fields)


def number(c: Column) -> Column:
    """A finite double, or null; digits may be grouped by single underscores, as canonical values have them."""
    return finite(number_value(F.lower(c)))


def number_value(c: Column) -> Column:
    """The double that a lower-case text says, also an infinite one, or null."""
    text = strip(c)
    return F.replace(F.when(text.rlike(FLOAT), text), F.lit("_"), F.lit("")).try_cast("double")


def finite(value: Column) -> Column:
    return F.when(F.abs(value) < float("inf"), value)


def numeric_text(name: str, c: Column, row: Column) -> Column:
    """Whole numbers without a fraction ("443.0" becomes "443"), other numbers as they are; null when blank, an error naming column and row when neither."""
    text, exact = strip(c), strip(c).try_cast("decimal(38,12)")
    whole = F.when(exact == F.floor(exact), F.floor(exact).cast("decimal(38,0)").cast("string"))
    good = F.coalesce(whole, number(c).cast("string"))
    bad = F.raise_error(F.concat(F.lit(f"column {name}, row "), row.cast("string"), F.lit(": not a number: "), text))
    return F.when(is_blank(c), F.lit(None).cast("string")).when(good.isNull(), bad.cast("string")).otherwise(good)


def label(c: Column) -> Column:
    """Trimmed lower-case label; a blank one is an error."""
    return F.when(is_blank(c), F.raise_error(F.lit("a label is blank")).cast("string")).otherwise(F.lower(strip(c)))


def clean_id(c: Column) -> Column:
    """The id, or null where the text only stands for a missing one."""
    text = strip(c)
    return F.when(~F.lower(text).isin("", "nan", "none", "null", "<na>"), text)


def guarded(c: Column) -> Column:
    """Metadata that a spreadsheet would take for a formula gets an apostrophe in front."""
    return F.when(c.rlike(r"^[=+\-@\t\r]"), F.concat(F.lit("'"), c)).otherwise(c)


def compact_ranges(values: Column) -> Column:
    """Ascending ranges of an array of integers: ``4-5;8;10-12``."""
    every = F.array_sort(F.array_distinct(values.cast("array<bigint>")))

    def shown(s: Column) -> Column:
        last = F.size(s) - 1
        first = F.filter(s, lambda x, i: (i == 0) | (F.get(s, i - 1) != x - 1))
        final = F.filter(s, lambda x, i: (i == last) | (F.get(s, i + 1) != x + 1))
        return F.array_join(F.zip_with(first, final, lambda a, b: F.when(a == b, a.cast("string")).otherwise(F.concat(a.cast("string"), F.lit("-"), b.cast("string")))), ";")

    return F.get(F.transform(F.array(every), shown), F.lit(0))  # the sorted array is bound once


def entropy(c: Column) -> Column:
    """Shannon entropy in bits over the letters a-z and digits of a text; 0 without any."""
    chars = F.split(F.regexp_replace(F.lower(c), "[^a-z0-9]", ""), "")
    chars = F.filter(chars, lambda x: x != "")
    total = F.size(chars).cast("double")
    share = F.transform(F.array_distinct(chars), lambda x: F.size(F.filter(chars, lambda y: y == x)) / total)
    return F.aggregate(share, F.lit(0.0), lambda s, p: s - p * F.log2(p))


def domain(c: Column) -> Column:
    """Host name in lower case without a dot at the end, from a name or a URL; null when blank."""
    text = F.rtrim(F.lower(strip(c)), F.lit("."))
    host = F.when(text.contains("://"), F.rtrim(F.regexp_replace(F.coalesce(F.try_parse_url(text, F.lit("HOST")), F.lit("")), r"^\[|\]$", ""), F.lit("."))).otherwise(text)
    return F.when(host != "", host)


def utc_text(c: Column) -> Column:
    """ISO-8601 in UTC with ``Z``; a fraction only where there is one; empty for null."""
    whole = F.unix_micros(c) % 1_000_000 == 0
    return F.coalesce(F.when(whole, F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss'Z'")).otherwise(F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")), F.lit(""))
