"""Readers and writers: tolerant schemas, positional rows, embedded records, partitioned feature tables, key-hashed results."""

from __future__ import annotations

import hashlib
import json
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def read_tolerant(spark: SparkSession, paths: list[str], optional: dict[str, str]) -> DataFrame:
    """Yearly Parquet files as one frame; columns that older files lack become NULL."""
    out = None
    for p in paths:
        df = spark.read.parquet(p)
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    for c, kind in optional.items():
        if c not in out.columns:
            out = out.withColumn(c, F.lit(None).cast(kind))
    return out


def read_positional(spark: SparkSession, path: str, names: list[str], width: int) -> DataFrame:
    """Headerless rows; the first columns are named, the rest are kept as ext_*."""
    names = [*names, *(f"ext_{k}" for k in range(len(names), width))]
    return spark.read.schema(T.StructType([T.StructField(n, T.StringType()) for n in names])).csv(path)


def headers(spark: SparkSession, paths: list[str]) -> dict[str, list[str]]:
    """The files of each header line, which is read from the first block of a file."""
    lines = spark.read.text(paths).select("_metadata.file_path", F.col("_metadata.file_block_start").alias("at"), "value").where("at = 0")
    out: dict[str, list[str]] = {}
    for r in lines.groupBy("file_path").agg(F.first("value").alias("header")).collect():  # a row a file
        out.setdefault(r["header"], []).append(r["file_path"])
    return out


def read_wide_csv(spark: SparkSession, paths: list[str], rename: dict[str, str]) -> DataFrame:
    """CSV with dotted or bracketed headers; listed columns get plain names, the file is kept as ``source_file``.

    Each file is read by its own header and joined by column name; columns that a file lacks are NULL.
    """
    out = None
    for _, files in sorted(headers(spark, paths).items()):
        df = spark.read.option("header", True).csv(files).withColumn("source_file", F.input_file_name())
        df = df.select(*[F.col(f"`{c}`").alias(rename.get(c, c)) for c in df.columns])
        out = df if out is None else out.unionByName(df, allowMissingColumns=True)
    return spark.createDataFrame([], "source_file string") if out is None else out


#: Stand for an escaped backslash and an escaped quote while a text is cut at its quotes; code points that are no characters.
_BACKSLASH, _QUOTE = "\uFDD0", "\uFDD1"


def embedded_value(text: Column, marker: str) -> Column:
    """The JSON array or object that follows the first place of a marker (a regular expression), up to the bracket that closes it, ``undefined`` as
    null; NULL where it does not close. Brackets and ``undefined`` inside strings are text, escapes and line ends are kept."""

    def let(value, body):
        return F.element_at(F.transform(F.array(value), body), 1)

    rest = F.regexp_extract(text, "(?s)" + marker + r"\s*([\[{].*)$", 1)
    held = F.replace(F.replace(rest, F.lit("\\\\"), F.lit(_BACKSLASH)), F.lit('\\"'), F.lit(_QUOTE))

    def closing(pieces: Column) -> Column:
        """The piece and the bracket in it at which all are closed; pieces at even places lie outside strings."""
        found = F.transform(pieces, lambda p, i: F.when(i % 2 == 0, F.regexp_extract_all(p, F.lit(r"[\[\]{}]"), F.lit(0))).otherwise(F.array().cast("array<string>")))
        marks = F.flatten(F.transform(found, lambda b, i: F.transform(b, lambda c, j: F.struct(i.alias("i"), j.alias("j"), F.when(c.isin("[", "{"), 1).otherwise(-1).alias("step")))))
        none = F.struct(F.lit(0).alias("depth"), F.lit(-1).alias("i"), F.lit(-1).alias("j"))

        def step(acc, x):
            depth = acc["depth"] + x["step"]
            return F.when(acc["i"] >= 0, acc).otherwise(F.struct(depth.alias("depth"), F.when(depth == 0, x["i"]).otherwise(-1).alias("i"), F.when(depth == 0, x["j"]).otherwise(-1).alias("j")))

        return F.aggregate(marks, none, step)

    def whole(pieces: Column, end: Column) -> Column:
        last = F.get(pieces, end["i"])
        inside = F.aggregate(F.slice(F.split(last, r"[\[\]{}]"), 1, end["j"] + 1), F.lit(0), lambda n, x: n + F.length(x) + 1)
        kept = F.concat(F.slice(pieces, 1, end["i"]), F.array(F.left(last, inside)))
        kept = F.transform(kept, lambda p, i: F.when(i % 2 == 0, F.regexp_replace(p, r"\bundefined\b", "null")).otherwise(p))
        back = F.replace(F.replace(F.array_join(kept, '"'), F.lit(_QUOTE), F.lit('\\"')), F.lit(_BACKSLASH), F.lit("\\\\"))
        return F.when(end["i"] >= 0, back)

    return let(F.split(held, '"'), lambda pieces: let(closing(pieces), lambda end: whole(pieces, end)))


def extract_embedded_json(df: DataFrame, text: str, marker: str, schema: str, out: str = "record") -> DataFrame:
    """One row per record of the JSON array that follows a marker (of an object, one); text without it, or with one that does not close, gives none."""
    return df.withColumn(out, F.explode(F.from_json(embedded_value(F.col(text), marker), f"array<{schema}>")))


def write_features(df: DataFrame, path: str, season: str = "season") -> None:
    """A feature table, a folder per season."""
    df.write.mode("overwrite").partitionBy(season).parquet(path)


def write_season_replace(df: DataFrame, path: str, season: str = "season") -> None:
    """Replace the seasons that the frame holds, keep the others."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(season).parquet(path)


def memo(spark: SparkSession, folder: str, key: dict, make) -> DataFrame:
    """A result kept under a hash of all parts of its key; a path that is there is read, else made and written."""
    name = hashlib.sha256(json.dumps(key, sort_keys=True).encode()).hexdigest()[:24]
    path = f"{folder}/{name}"
    fs = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(f"{path}/_SUCCESS")
    if not fs.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(fs):
        make().write.mode("overwrite").parquet(path)
    return spark.read.parquet(path)


def new_folder(spark: SparkSession, name: str) -> str:
    """A path of its own in ``spark.checkpoint.dir``; where that is unset, in a local folder, but only for a local master."""
    folder = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("spark.checkpoint.dir has to name a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lineup-stage-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def stage(df: DataFrame, name: str = "stage") -> DataFrame:
    """A result that several later steps read, written once to the folder that driver and executors share and read back.
    """
    spark = df.sparkSession
    path = new_folder(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def read_table(spark: SparkSession, path: str, columns: list[str] | None = None, equal: dict | None = None, least: dict | None = None) -> DataFrame:
    """Columns of a table with equality and minimum filters, which reach the scan."""
    df = spark.read.parquet(path)
    for c, v in (equal or {}).items():
        df = df.where(F.col(c).isin(v) if isinstance(v, (list, tuple, set)) else F.col(c) == v)
    for c, v in (least or {}).items():
        df = df.where(F.col(c) >= v)
    return df.select(*columns) if columns else df
