"""Writers: snapshots, guarded replacement and versions named by content."""

from __future__ import annotations

import itertools
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.keys import fingerprint


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all executors share; one of this machine only for a local session that names none."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = "file://" + tempfile.mkdtemp(prefix="pairlens-")
        spark.conf.set("spark.checkpoint.dir", root)
    return f"{root}/{name}-{uuid.uuid4().hex}"


def exists(spark: SparkSession, path: str) -> bool:
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def snapshot(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


#: Files that a folder of ``text_files`` holds, about; the number of folders grows with the rows.
FOLDER_FILES = 500


def text_files(rows: DataFrame, folder: str) -> None:
    """Writes ``rows`` (name, text) as one file for each name, in numbered folders below ``folder``.

    Rows of one name are lines of one file, those without a name lines of the file ``unnamed``. A task writes a folder:
    a file is written aside and renamed, so a task may run again. Spark's own writer would need a folder for each name,
    whose files the driver moves and lists one by one.
    """
    fs, root = pa.fs.FileSystem.from_uri(folder)
    fs.create_dir(root)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, root = pa.fs.FileSystem.from_uri(folder)
        to, n = f"{root}/{TaskContext.get().partitionId():06}", 0
        fs.create_dir(to)
        lines = (x for b in batches for x in zip(b.column(0).to_pylist(), b.column(1).to_pylist()))
        for name, own in itertools.groupby(lines, lambda x: x[0]):
            if "/" in name or name[:1] in ("", "_", "."):
                raise ValueError(f"{name!r} is no name of a file that readers see")
            aside = f"{to}/.{uuid.uuid4().hex}"
            with fs.open_output_stream(aside) as out:
                out.writelines(f"{text or ''}\n".encode() for _, text in own)
            fs.move(aside, f"{to}/{name}")
            n += 1
        yield pa.RecordBatch.from_pydict({"files": [n]}, pa.schema([("files", pa.int64())]))

    rows = rows.select(F.coalesce("name", F.lit("unnamed")).alias("name"), "text")
    dealt = rows.repartition(max(1, -(-rows.count() // FOLDER_FILES)), "name").sortWithinPartitions("name")
    dealt.mapInArrow(write, "files long").agg(F.sum("files")).collect()


#: Name of the file that says which version of a table holds.
POINTER = "_current"


def _path(spark: SparkSession, path: str):
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())


def current(spark: SparkSession, root: str) -> str | None:
    """The version of a table that holds, or None."""
    where, fs = _path(spark, f"{root}/{POINTER}")
    if not fs.exists(where):
        return None
    stream = fs.open(where)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8").strip()
    finally:
        stream.close()


def _switch(spark: SparkSession, root: str, version: str) -> None:
    """Makes a written version the one that holds: the pointer is written aside and renamed over the old one in one step."""
    jvm = spark.sparkContext._jvm
    aside, fs = _path(spark, f"{root}/{POINTER}.{version}")
    out = fs.create(aside, True)
    out.write(bytearray(version, "ascii"))
    out.close()
    options = jvm.org.apache.hadoop.fs.Options.Rename
    flags = spark.sparkContext._gateway.new_array(options, 1)
    flags[0] = options.OVERWRITE
    jvm.org.apache.hadoop.fs.FileContext.getFileContext(fs.getUri(), spark.sparkContext._jsc.hadoopConfiguration()).rename(aside, jvm.org.apache.hadoop.fs.Path(f"{root}/{POINTER}"), flags)


def read_current(spark: SparkSession, root: str) -> DataFrame:
    version = current(spark, root)
    if version is None:
        raise FileNotFoundError(f"{root} holds no table yet")
    return spark.read.parquet(f"{root}/{version}")


def guarded(df: DataFrame, root: str, metric: str, force: bool = False) -> bool:
    """Replaces a table unless the new one is strictly poorer by the metric (an SQL aggregate); says whether it did.

    The new rows are written once, as a version of their own, and measured there; then the pointer moves to it. Whatever
    fails before that, readers keep the old table. A table that cannot be read or has no value of the metric is replaced;
    versions that held before stay.
    """
    spark, version = df.sparkSession, f"v-{uuid.uuid4().hex}"
    df.write.parquet(f"{root}/{version}")
    if not force and (old := _measured(spark, root, current(spark, root), metric)) is not None:
        new = _measured(spark, root, version, metric)
        if new is not None and new < old:
            where, fs = _path(spark, f"{root}/{version}")
            fs.delete(where, True)
            return False
    _switch(spark, root, version)
    return True


def _measured(spark: SparkSession, root: str, version: str | None, metric: str):
    if version is None:
        return None
    try:
        return spark.read.parquet(f"{root}/{version}").selectExpr(f"{metric} as m").first()["m"]
    except AnalysisException:  # unreadable, or without the columns of the metric
        return None


def versioned(df: DataFrame, root: str, volatile: list[str]) -> str:
    """Writes under the digest of the content; the same content is written once."""
    path = f"{root}/content_id={fingerprint(df, volatile).first()['digest']}"
    if not exists(df.sparkSession, path):
        df.write.parquet(path)
    return path
