"""What the operators of this subpackage share: shared storage, stable hashing terms, table access."""

from __future__ import annotations

import io
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: ASCII white space that separates words in every contract of this subpackage.
WORD_SPACE = r"[\x20\x09-\x0D]+"


_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Let Python workers import this package wherever they run: once for each application, by Spark's own file transfer."""
    app = spark.sparkContext.applicationId
    if app in _shipped:
        return
    root = Path(__file__).resolve().parents[1]
    content = io.BytesIO()
    with zipfile.ZipFile(content, "w") as z:
        for p in sorted(root.rglob("*.py")):
            z.write(p, p.relative_to(root.parent))
    path = Path(tempfile.mkdtemp(prefix="verdictflow-")) / f"{root.name}.zip"
    path.write_bytes(content.getvalue())
    spark.sparkContext.addPyFile(str(path))
    _shipped.add(app)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ship_package(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_made: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors share: the session's ``spark.checkpoint.dir``, else the context's checkpoint folder. Only where
    neither is set, and only in local mode, a temporary folder is made, one for each application."""
    found = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not found:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        app = spark.sparkContext.applicationId
        if app not in _made:
            _made[app] = f"file://{tempfile.mkdtemp(prefix='verdictflow-')}"
        found = _made[app]
    return found.rstrip("/")


#: Bytes of rows that Python gets at once.
BATCH_BYTES = 8 << 20
#: How tables are written: they are complete and shared, so the shuffle files behind them are of no more use; and Python gets rows in
#: batches of a bounded size, as ten thousand long texts at once are hundreds of MB on either side.
WRITING = {
    "spark.sql.classic.shuffleDependency.fileCleanup.enabled": "true",
    "spark.sql.execution.arrow.maxRecordsPerBatch": "1000",
    "spark.sql.execution.arrow.maxBytesPerBatch": str(BATCH_BYTES),
}


def small_batches(spark: SparkSession) -> None:
    """Bound the bytes of the session's Arrow batches, for what the caller writes: ten thousand long texts at once are held several times
    on either side. The number of rows of a batch is not changed."""
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))


def materialize(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: cuts lineage, survives lost executors, is computed once."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{label}-{uuid.uuid4().hex}"
    before = {k: spark.conf.get(k) for k in WRITING}
    try:
        for k, v in WRITING.items():
            spark.conf.set(k, v)
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    _written[id(out)] = (out, path)
    return out


_written: dict[int, tuple[DataFrame, str]] = {}


def release(*tables: DataFrame) -> None:
    """Delete materialized tables that nothing reads any more; other DataFrames are left alone."""
    for df in tables:
        _, path = _written.pop(id(df), (None, None))
        if path:
            jvm = df.sparkSession.sparkContext._jvm
            at = jvm.org.apache.hadoop.fs.Path(path)
            at.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


def fresh(docs: DataFrame, *names: str) -> list[str]:
    """The names, each changed until no column of ``docs`` has it (in any case)."""
    taken = {c.lower() for c in docs.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def text_or_empty(column: str = "text") -> Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(""))


def crc_of_id(column: str = "doc_id") -> Column:
    """crc32 of the id as text; a null id counts as the empty text."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary"))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
