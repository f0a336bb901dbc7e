"""File sources and sinks: JSON lines, JSON documents, CSV, TSV, YAML, sets of files, resumable appends, reports."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from hearken.sources.tables import DIALOGUE


def read_dialogues(spark: SparkSession, path: str | list[str], schema: T.StructType = DIALOGUE) -> DataFrame:
    """JSON lines, one dialogue a line, by a declared schema; a broken line is null in all columns and left out."""
    return spark.read.schema(schema).option("mode", "PERMISSIVE").json(path).filter(F.col(schema.names[0]).isNotNull())


def read_document(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """One JSON document a file."""
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | str) -> DataFrame:
    """CSV with a header; quoted fields may hold line ends and doubled quotes."""
    return spark.read.schema(schema).csv(path, header=True, multiLine=True, quote='"', escape='"')


def read_tsv(spark: SparkSession, path: str, schema: T.StructType | str, first: int | None = None, order: list[str] | None = None) -> DataFrame:
    """TSV without a header; its first rows by `order`, where asked for."""
    rows = spark.read.schema(schema).csv(path, sep="\t", quote="")
    return rows.orderBy(*order).limit(first) if first is not None and order else rows if first is None else rows.limit(first)


def read_sets(spark: SparkSession, pattern: str, exclude: str = r"(_sample$|_asr$)", schema: T.StructType = DIALOGUE) -> DataFrame:
    """All files of a pattern but the excluded ones, with the file's stem as set_name."""
    stem = F.regexp_extract(F.col("_metadata.file_name"), r"^(.*?)(?:\.[^.]*)?$", 1)
    return spark.read.schema(schema).json(pattern).withColumn("set_name", stem).filter(~F.col("set_name").rlike(exclude))


def existing(spark: SparkSession, paths: list[str]) -> list[str]:
    """Those of a few paths that exist, in their order."""
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    where = [(p, jvm.org.apache.hadoop.fs.Path(p)) for p in paths]
    return [p for p, x in where if x.getFileSystem(conf).exists(x)]


def read_yaml(spark: SparkSession, path: str) -> dict:
    """A taxonomy file, a small dimension, parsed on the driver."""
    import yaml

    return yaml.safe_load("\n".join(r.value for r in spark.read.text(path, wholetext=True).collect())) or {}


def pools(spark: SparkSession, tree: dict, langs: tuple[str, ...] = ("ru", "kk")) -> DataFrame:
    """Every list of lines in a taxonomy tree as rows: path, lang, pos, line."""
    rows: list[tuple[str, str, int, str]] = []

    def walk(node: object, path: tuple[str, ...]) -> None:
        if isinstance(node, dict):
            for k, v in node.items():
                if k in langs and isinstance(v, list) and v and isinstance(v[0], str):
                    rows.extend(("/".join(path), k, i, x) for i, x in enumerate(v))
                else:
                    walk(v, (*path, str(k)))

    walk(tree, ())
    return spark.createDataFrame(rows, "path string, lang string, pos int, line string")


def write_lines(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def append_missing(new: DataFrame, path: str, key: str) -> DataFrame:
    """Append rows whose key the sink doesn't have; returns what was appended.  A second call appends nothing."""
    spark = new.sparkSession
    if existing(spark, [path]):
        new = new.join(spark.read.schema(new.schema).json(path).select(key).distinct(), key, "left_anti")
    rows = new.dropDuplicates([key])
    rows.write.mode("append").json(path)
    return rows


def write_report(df: DataFrame, path: str) -> None:
    """A small result as one JSON document a row."""
    df.select(F.to_json(F.struct("*"), {"pretty": "true"}).alias("value")).coalesce(1).write.mode("overwrite").text(path)


def markdown(df: DataFrame) -> str:
    """A small result as a Markdown table."""
    line = lambda cells: "| " + " | ".join("–" if x is None else str(x) for x in cells) + " |"
    return "\n".join([line(df.columns), line(["---"] * len(df.columns)), *map(line, df.collect())])


def signature(ids: DataFrame, key: str) -> str:
    """Eight hex digits that name a set of ids whatever their order, for a cache of results; ids never leave their tasks."""
    one = F.conv(F.substring(F.md5(F.col(key).cast("string").cast("binary")), 1, 15), 16, 10).cast("decimal(38,0)")
    total, n = ids.agg(F.coalesce(F.sum(one), F.lit(0)), F.count("*")).first()
    import hashlib

    return hashlib.md5(json.dumps([int(total), n]).encode()).hexdigest()[:8]
