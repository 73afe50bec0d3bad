"""Lines of log archives (zip, tar, tar.gz or plain files) with labels from the label files among them.

An archive is read by one task, member after member, as its bytes can only be read from the start; many archives are many tasks. Spark reads
the bytes, so any store it reads works; an archive has at most 2 GB.
"""

from __future__ import annotations

import io
import re
import tarfile
import zipfile
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from verdictflow.operators.containment import first_contained

#: Bounds of a batch of lines on their way to Spark: lines, and characters. Small archives share batches.
BATCH, BATCH_CHARS = 10_000, 8 << 20
MOST = 200_000
# What is said of an abnormal line, and what label and log files are called.
ABNORMAL = ("anomaly", "abnormal", "alert", "fail", "failure", "1")
LABEL_FILE, LOG_FILE, NO_LOG = r"(?i)[^/]*(anomal|label)[^/]*$", r"(\.log|\.txt|/[^./]+|^[^./]+)$", r"(?i)readme[^/]*$"


def members(content: bytes, wanted: Callable[[str], object] = lambda name: True) -> Iterator[tuple[str, Iterator[bytes]]]:
    """(name, lines) of each file of an archive whose name is wanted; other content is one file without a name."""
    if content[:4] == b"PK\x03\x04":
        with zipfile.ZipFile(io.BytesIO(content)) as z:
            for info in z.infolist():
                if not info.is_dir() and wanted(info.filename):
                    with z.open(info) as f:
                        yield info.filename, iter(io.BufferedReader(f))
        return
    try:
        with tarfile.open(fileobj=io.BytesIO(content)) as t:
            for info in t:
                f = t.extractfile(info) if info.isfile() and wanted(info.name) else None
                if f is not None:
                    yield info.name, iter(f)
    except tarfile.ReadError:
        if wanted(""):
            yield "", iter(io.BytesIO(content))


TYPES = {"archive": pa.string(), "member": pa.string(), "line": pa.int64(), "text": pa.string(), "error": pa.string()}


def lines_in(batches: Iterator[pa.RecordBatch], pattern: str | None = None) -> Iterator[pa.RecordBatch]:
    """The lines of ``batches`` of archives (file, content)."""
    wanted = (lambda name: True) if pattern is None else re.compile(pattern).search
    held: list[tuple] = []
    chars = 0

    def full() -> pa.RecordBatch:
        columns = zip(*held, strict=True) if held else [()] * len(TYPES)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, TYPES.values(), strict=True)], names=list(TYPES))

    for batch in batches:
        for file, content in zip(batch.column("file").to_pylist(), batch.column("content"), strict=True):
            try:
                for name, lines in members(content.as_py() or b"", wanted):
                    for n, raw in enumerate(lines, 1):
                        text = raw.decode("utf-8", "ignore").strip()
                        if text:
                            held.append((file, name, n, text, None))
                            chars += len(text)
                            if len(held) >= BATCH or chars >= BATCH_CHARS:
                                yield full()
                                held, chars = [], 0
            except (OSError, EOFError, zipfile.BadZipFile, tarfile.TarError) as e:
                held.append((file, None, None, None, f"{type(e).__name__}: {e}"))
    yield full()


def archive_lines(files: DataFrame, pattern: str | None = None) -> DataFrame:
    """archive, member, line (from 1), text of every line of ``files`` (file, content) that is not blank, trimmed. Bytes that are not UTF-8 are
    left out. An archive that breaks off gives the lines up to there and a last one with ``error``. With a ``pattern`` (Python's) only members
    with such names are opened."""
    kinds = "archive string, member string, line long, text string, error string"
    return files.select("file", F.col("content").cast("binary").alias("content")).mapInArrow(lambda batches: lines_in(batches, pattern), kinds)


def labelled_log_lines(lines: DataFrame, most: int | None = MOST, label_lines: DataFrame | None = None) -> DataFrame:
    """archive, member, line, text, label of the lines of log files; ``label`` is that of the first key of the label files (comma-separated, the
    key first and the verdict last) that the line contains, null if none. Keys count for all archives given, so give those of one data set. At most ``most`` lines of each archive, those of ``.log`` files first. ``label_lines``
    are the lines of the label files, where these can be had by less than all of ``lines``."""
    path = F.coalesce("member", F.lit(""))
    verdict = F.when(F.lower(F.trim(F.element_at(F.split("text", ","), -1))).isin(*ABNORMAL), 1).otherwise(0)
    keys = (lines if label_lines is None else label_lines).where(path.rlike(LABEL_FILE) & F.contains("text", F.lit(","))).select(F.trim(F.split_part("text", F.lit(","), F.lit(1))).alias("key"), verdict.alias("label"), F.struct("archive", "member", "line").alias("pos"))
    # The last verdict on a key counts, at the place of its first.
    keys = keys.where("key <> ''").groupBy("key").agg(F.max_by("label", "pos").alias("label"), F.min("pos").alias("pos"))
    logs = lines.where(F.col("error").isNull() & path.rlike(LOG_FILE) & ~path.rlike(NO_LOG) & ~path.rlike(LABEL_FILE)).drop("error")
    if most is not None:
        from verdictflow.operators.datasets import cap_per_key

        logs = cap_per_key(logs, ["archive"], most, [(~F.endswith("member", F.lit(".log"))).cast("int"), F.col("member"), F.col("line")])
    return first_contained(logs, "text", keys)


def read_log_archives(spark: SparkSession, path: str, most: int | None = MOST) -> DataFrame:
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path).select(F.col("path").alias("file"), "content")
    return labelled_log_lines(archive_lines(files), most, archive_lines(files, LABEL_FILE))
