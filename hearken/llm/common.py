"""What the operators of this folder share: the shared scratch folder, staged tables, table access."""

from __future__ import annotations

import contextlib
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder all executors and the driver see: spark.checkpoint.dir.

    Where the setting is absent (tests in local mode) a folder of this process is made; on a cluster its absence is an
    error, as a machine-local folder would lose data there.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local[") and spark.sparkContext.master != "local":
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if "dir" not in _LOCAL:
        _LOCAL["dir"] = "file://" + tempfile.mkdtemp(prefix="hearken-")
    return _LOCAL["dir"]


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


@contextlib.contextmanager
def small_batches(spark: SparkSession, rows: int = 1000, size: str = "8m") -> Iterator[None]:
    """What is executed inside gives Python workers batches of so many rows and bytes at most: texts are long, and a batch is in
    memory several times on its way."""
    wanted = {"spark.sql.execution.arrow.maxRecordsPerBatch": str(rows), "spark.sql.execution.arrow.maxBytesPerBatch": size}
    before = {k: spark.conf.get(k, None) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        yield
    finally:
        for k, v in before.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


_OPEN: list[list[str]] = []


def stage(df: DataFrame, name: str) -> DataFrame:
    """Write df as Parquet in the shared folder and read it back: its lineage ends there, whatever executors are lost."""
    spark = df.sparkSession
    path = scratch(spark, name)
    if _OPEN:
        _OPEN[-1].append(path)
    with small_batches(spark):
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def workspace(spark: SparkSession) -> Iterator[Callable[[DataFrame, str], DataFrame]]:
    """What is staged inside is deleted at the end, but for what is staged by the function that this gives."""
    paths: list[str] = []
    kept: list[str] = []
    _OPEN.append(paths)

    def keep(df: DataFrame, name: str) -> DataFrame:
        out = stage(df, name)
        kept.append(_OPEN[-1].pop())
        return out

    try:
        yield keep
    finally:
        _OPEN.pop()
        if _OPEN:
            _OPEN[-1].extend(kept)
        for path in paths:
            where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(where, True)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def aside(docs: DataFrame, used: tuple[str, ...]) -> DataFrame:
    """docs with its columns other than those used under names that clash with nothing; toDF(*names) brings them back."""
    return docs.toDF(*[c if c in used else f"__aside_{i}" for i, c in enumerate(docs.columns)])


def open_fs(uri: str):
    """The pyarrow file system of a URI of the shared folder, and the path in it."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri if "://" in uri or uri.startswith("file:") else "file://" + os.path.abspath(uri))


def words_of(text: str | None) -> list[bytes]:
    """Maximal runs of other characters than the six ASCII white-space ones; bytes.split() knows exactly these."""
    return text.encode("utf-8", "surrogatepass").split() if text else []


_SPACED = bytes(32 if i < 128 and not chr(i).isalnum() else i for i in range(256))


def terms(text: str | None) -> list[bytes]:
    """Lower-cased words; ASCII punctuation counts as white space."""
    return text.lower().encode("utf-8", "surrogatepass").translate(_SPACED).split() if text else []
