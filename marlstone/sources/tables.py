"""Readers: CSV with provenance, JSON lines, the driver's Parquet tables.

All CSV cells are strings.  Plain CSV of any size is read by Spark's own reader (``read_csv``); where
physical line numbers are needed a file is parsed as a whole by its task (``read_csv_lines``), so
files, not blocks, are the unit of parallelism.
"""

from __future__ import annotations

import csv
import io
import os
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from marlstone.functions.text import numeric_text

NUMERIC_COLUMNS = frozenset("ack_count dst_port drate duration fin_count flow_duration header_length iat local_port packet_number process_pid process_ppid process_tgid protocol_dns protocol_http protocol_https protocol_icmp protocol_number protocol_tcp protocol_udp rate remote_port rst_count src_port srate syn_count tcp_ack tcp_cwr tcp_ece tcp_fin tcp_psh tcp_rst tcp_syn tcp_urg total_size total_sum urg_count".split())
PIECE = 2 << 20  # bytes of a log file that a task takes; a row costs much more than to read it
PROVENANCE = ("source_file", "source_row_number", "source_line_number", "malformed", "malformed_reason")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, piece: int = 0) -> DataFrame:
    """The rows over all cores, if an input has fewer partitions than there are cores; for wide projections.

    With ``piece`` there is a partition for as many bytes of files, so that tasks don't grow with the input.
    """
    wanted = df.sparkSession.sparkContext.defaultParallelism
    if piece:
        wanted = max(wanted, -(-int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())) // piece))
    return df.repartition(wanted) if df.rdd.getNumPartitions() < wanted else df


def header(spark: SparkSession, path: str, delimiter: str = ",", encoding: str = "utf-8") -> list[str]:
    """Column names of one CSV file; an empty file is an error."""
    line = spark.read.option("encoding", encoding).option("multiLine", True).option("sep", delimiter).option("quote", '"').option("escape", '"').csv(path).limit(1).collect()
    if not line or line[0][0] is None and len(line[0]) == 1:
        raise ValueError(f"{path} has no header")
    return ["" if x is None else str(x).removeprefix("﻿") for x in line[0]]


def union_header(spark: SparkSession, paths: Sequence[str], **how) -> list[str]:
    """Names of all files, in the order they are first seen."""
    return list(dict.fromkeys(c for p in paths for c in header(spark, p, **how)))


def _lines(columns: list[str], delimiter: str, encoding: str):
    names = list(columns)
    types = pa.schema([*((c, pa.string()) for c in names), ("source_file", pa.string()), ("source_row_number", pa.int64()), ("source_line_number", pa.int64()), ("malformed", pa.bool_()), ("malformed_reason", pa.string())])

    def parse(path: str, raw: bytes) -> Iterator[list]:
        reader = csv.reader(io.StringIO(raw.decode(encoding).removeprefix("﻿"), newline=""), delimiter=delimiter)
        head = next(reader, None)
        if head is None:
            return
        place = {}
        for i, c in enumerate(head):  # of columns with one name the last counts
            place[c] = i
        number, line = 0, reader.line_num + 1
        for cells in reader:
            number += 1
            reason = None if len(cells) == len(head) else f"{len(head)} fields are expected, {len(cells)} found"
            full = cells + [""] * (len(head) - len(cells))
            yield [*(full[place[c]] if c in place else "" for c in names), path, number, line, reason is not None, reason]
            line = reader.line_num + 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                held: list[list] = []
                for row in parse(path, raw):
                    held.append(row)
                    if len(held) == 8192:
                        yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(types)], schema=types)
                        held = []
                if held:
                    yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in held], f.type) for k, f in enumerate(types)], schema=types)

    return run


def read_csv_lines(spark: SparkSession, paths: Sequence[str], columns: Sequence[str] | None = None, delimiter: str = ",", encoding: str = "utf-8") -> DataFrame:
    """The files' rows as strings, with the columns of ``PROVENANCE``.

    Row numbers count from 1; line numbers are those where a row begins in its file.  Short rows are
    filled with empty texts, extra fields dropped, and both (blank lines too) marked as malformed.  Columns
    that a file lacks are empty.
    """
    columns = list(columns or union_header(spark, paths, delimiter=delimiter, encoding=encoding))
    if clash := set(columns) & set(PROVENANCE):
        raise ValueError(f"columns with reserved names: {sorted(clash)}")
    schema = T.StructType([*(T.StructField(c, T.StringType()) for c in columns), T.StructField("source_file", T.StringType()), T.StructField("source_row_number", T.LongType()), T.StructField("source_line_number", T.LongType()), T.StructField("malformed", T.BooleanType()), T.StructField("malformed_reason", T.StringType())])
    files = spark.read.format("binaryFile").load(list(paths)).select("path", "content")
    return files.mapInArrow(_lines(columns, delimiter, encoding), schema)


def read_csv(spark: SparkSession, path: str, delimiter: str = ",") -> DataFrame:
    """All cells as strings, blank ones null; rows may span lines."""
    return spark.read.option("header", True).option("multiLine", True).option("escape", '"').option("sep", delimiter).csv(path)


def canonical_numbers(df: DataFrame, row: str, names: Sequence[str] = tuple(sorted(NUMERIC_COLUMNS))) -> DataFrame:
    """The log table with its numeric columns in one form; text in them is an error that names column and row."""
    return df.withColumns({c: numeric_text(c, F.col(c), F.col(row)) for c in df.columns if c in set(names)})


def _bad_lines(files: DataFrame, schema: T.StructType) -> DataFrame:
    """(path, line) of the lines that are no object, in files read as a whole."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import json

        for batch in batches:
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, line in enumerate(raw.decode("utf-8", "replace").splitlines(), 1):
                    try:
                        good = not line.strip() or isinstance(json.loads(line), dict)
                    except ValueError:
                        good = False
                    if not good:
                        yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([k], pa.int64())], names=["path", "line"])

    return files.mapInArrow(run, "path string, line long")


def read_jsonl(spark: SparkSession, path: str, schema: str | T.StructType) -> DataFrame:
    """One object a line, blank lines skipped; a bad line is an error that names file and line.

    Files with a line that cannot be parsed are found by one pass over the lines; only they are read again for the number.
    """
    kind = T._parse_datatype_string(schema) if isinstance(schema, str) else schema
    wide = T.StructType([*kind, T.StructField("__bad", T.StringType())])
    lines = spark.read.text(path).where(F.trim("value") != "").select(F.from_json("value", wide, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "__bad"}).alias("o"), F.col("_metadata.file_path").alias("__path"))
    wrong = [r[0] for r in lines.where("o is null or o.__bad is not null").select("__path").distinct().limit(100).collect()]  # enough to name them
    if wrong:
        found = _bad_lines(spark.read.format("binaryFile").load(wrong).select("path", "content"), kind).orderBy("path", "line").first()
        raise ValueError(f"{found['path']}:{found['line']}: not a JSON object" if found else f"{wrong[0]}: a line does not fit the schema")
    return lines.select(*(F.col(f"o.`{c}`").alias(c) for c in kind.names))


def exists(path: str) -> bool:
    return os.path.exists(path)
