"""CSV records of many files with exact places: which file, which record, on which physical lines.

A quoted cell may hold line breaks, so only reading a file from its start tells where a record is. Each file is read by one task, record by
record; many files are many tasks. Spark reads the bytes, so any store it reads works; a file has at most 2 GB, beyond which Spark fails; a file of
no bytes is left out by it.
"""

from __future__ import annotations

import csv
import io
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bounds of a batch of rows on their way to Spark: rows, and characters of cells.
BATCH, BATCH_CHARS = 5_000, 8 << 20
TYPES = {"file": pa.string(), "record": pa.int64(), "first_line": pa.int64(), "line": pa.int64(), "header": pa.list_(pa.string()), "cells": pa.list_(pa.string())}
SCHEMA = "file string, record long, first_line long, line long, header array<string>, cells array<string>"


def records_of(content: bytes) -> Iterator[tuple[int, int, int, list[str], list[str]]]:
    """(record, first line, last line, header, cells) of each record but the header and those without a cell. Header names are trimmed and
    lower-cased; a byte order mark is left out; bytes that are not UTF-8 become replacement characters."""
    csv.field_size_limit((1 << 31) - 1)
    reader = csv.reader(io.TextIOWrapper(io.BytesIO(content), "utf-8-sig", errors="replace", newline=""))
    header = [h.strip().lower() for h in next(reader, [])]
    yield 0, 1, max(1, reader.line_num), header, header
    before, record = reader.line_num, 0
    for cells in reader:
        first, before = before + 1, reader.line_num
        if cells:
            record += 1
            yield record, first, before, header, cells


def records_in(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The records of ``batches`` of files (file, content). Small files share batches; large ones are many."""
    held: list[tuple] = []
    chars = 0

    def full() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [()] * len(TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, TYPES.values(), strict=True)], names=list(TYPES))

    for batch in batches:
        for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            for r in records_of(content.as_py() or b""):
                held.append((file, *r))
                chars += sum(map(len, r[3])) + sum(map(len, r[4]))
                if len(held) >= BATCH or chars >= BATCH_CHARS:
                    yield full()
                    held, chars = [], 0
    yield full()


def csv_records(files: DataFrame) -> DataFrame:
    """file, record (from 1; 0 is the header), first_line, line (where it ends), header, cells for each record of ``files`` (file, content).
    An empty file has an empty header and nothing else."""
    return files.select("file", F.col("content").cast("binary").alias("content")).mapInArrow(records_in, SCHEMA)


def read_csv_records(spark: SparkSession, path: str) -> DataFrame:
    return csv_records(spark.read.format("binaryFile").load(path).select(F.col("path").alias("file"), "content"))


def named_cells(records: DataFrame, required: tuple[str, ...], optional: tuple[str, ...]) -> DataFrame:
    """file, record, first_line, line, the named columns (null where a record is short or a file has no such column) and ``flaws``: required
    columns that a file's header lacks, told once in the header's row, and cells beyond the header. Records of blank cells only are left out,
    as are those of a file whose header lacks a required column. Of two columns with one name the last counts."""
    at = lambda name: F.array_size("header") - F.array_position(F.reverse("header"), F.lit(name)).cast("int")
    cell = lambda name: F.when(F.array_contains("header", name), F.get("cells", at(name)))
    missing = F.filter(F.array(*map(F.lit, required)), lambda c: ~F.array_contains("header", c))
    head = F.col("record") == 0
    more = F.size("cells") - F.size("header")
    flaws = F.when(head, F.transform(missing, lambda c: F.concat(F.lit("no column "), c))).otherwise(
        F.array_compact(F.array(F.when(more > 0, F.concat(F.lit("row has more cells than the header ("), more.cast("string"), F.lit(" extra)")))))
    )
    filled = F.exists("cells", lambda c: F.trim(c) != "")
    kept = records.where(F.when(head, F.size(missing) > 0).otherwise((F.size(missing) == 0) & filled))
    return kept.select("file", "record", "first_line", "line", *[F.when(~head, cell(c)).alias(c) for c in (*required, *optional)], flaws.alias("flaws"))
