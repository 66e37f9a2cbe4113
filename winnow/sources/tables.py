"""Readers: labelled CSV tables, recorded measures, recorded sequences, trial history."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from winnow.roles import Roles, col, lay_out


def check_labelled(df: DataFrame, target: str | None) -> str:
    """Name of the target column: the one given, else the last."""
    if len(df.columns) < 2:
        raise ValueError("a labelled table needs at least one feature and the target")
    if target is None:
        return df.columns[-1]
    if target not in df.columns:
        raise ValueError(f"target column {target!r} is not in the table")
    return target


def as_labelled(df: DataFrame, target: str | None = None, row_id: str | None = None) -> tuple[DataFrame, Roles]:
    """Row key first, target last under the name ``label``, types laid out. Without a key
    column rows are numbered as they come; give one where reruns must line up (a CSV file read
    by ``read_labelled_csv`` is numbered by place in the file)."""
    target = check_labelled(df, target)
    if row_id is None:
        df, row_id = df.withColumn("row_id", F.monotonically_increasing_id()), "row_id"
    feats = [c for c in df.columns if c not in (row_id, target)]
    named = df.select(col(row_id).alias("row_id"), *[col(c) for c in feats], col(target).alias("label"))
    roles = Roles("row_id", "label")
    return lay_out(named, roles), roles


def read_labelled_csv(
    spark: SparkSession, path, target: str | None = None, schema=None, row_id: str | None = None
) -> tuple[DataFrame, Roles]:
    """``schema`` avoids the extra pass that type inference costs on a large file."""
    reader = spark.read.option("header", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    scan = reader.csv(path)
    return as_labelled(scan, target, row_id) if row_id else as_labelled(in_file_order(scan), target, "row_id")


def in_file_order(scan: DataFrame, out: str = "row_id") -> DataFrame:
    """Rows numbered 0, 1, ... by file and place in it, however many cores read the files.

    Rows of one block of a file follow each other in the scan; the rows of earlier blocks are
    counted first, one number for each block.
    """
    tagged = scan.select(
        "*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_block"),
        F.monotonically_increasing_id().alias("_m"),
    )
    blocks = tagged.groupBy("_file", "_block").agg(F.count(F.lit(1)).alias("_n"), F.min("_m").alias("_m0"))
    before = Window.orderBy("_file", "_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = blocks.select("_file", "_block", "_m0", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_off"))
    numbered = tagged.join(F.broadcast(offsets), ["_file", "_block"])
    return numbered.select((F.col("_off") + F.col("_m") - F.col("_m0")).alias(out), *[col(c) for c in scan.columns])


def read_many(spark: SparkSession, roots: list[str], schema=None) -> DataFrame:
    """All CSV files under several roots in one scan; the file name gives ``dataset``."""
    reader = spark.read.option("header", True).option("recursiveFileLookup", True)
    reader = reader.schema(schema) if schema is not None else reader.option("inferSchema", True)
    df = reader.csv(roots)
    name = F.regexp_replace(F.col("_metadata.file_name"), r"\.csv$", "")
    return df.select(name.alias("dataset"), *[col(c) for c in df.columns])


def read_measures(spark: SparkSession, path) -> DataFrame:
    """Recorded measures, one row per data set; ids and names both read as text."""
    df = spark.read.option("header", True).option("inferSchema", True).csv(path)
    return df.withColumn("dataset", F.col("dataset").cast("string"))


def parse_sequences(texts: DataFrame, text: str = "value") -> DataFrame:
    """{"<data set>": [[score, [steps], [operators]], ...]} per row, to one row per entry
    (dataset, pos, score, step_order, ops); NULL operators are kept."""
    whole = texts.select(F.from_json(F.col(text), "map<string,array<array<string>>>").alias("m"))
    sets = whole.select(F.explode("m").alias("dataset", "entries"))
    rows = sets.select("dataset", F.posexplode("entries").alias("pos", "e"))
    return rows.select(
        "dataset",
        "pos",
        F.get("e", F.lit(0)).cast("double").alias("score"),
        F.from_json(F.get("e", F.lit(1)), "array<string>").alias("step_order"),
        F.from_json(F.get("e", F.lit(2)), "array<string>").alias("ops"),
    )


def read_sequences(spark: SparkSession, path) -> DataFrame:
    return parse_sequences(spark.read.text(path, wholetext=True, recursiveFileLookup=True))


def read_trials(spark: SparkSession, path) -> DataFrame:
    """Trial files of many data sets in one scan, named ``<data set>_<anything>.csv``."""
    df = spark.read.option("header", True).csv(path, schema="logic_pipe string, phy_pipe string, accuracy double")
    name = F.regexp_replace(F.col("_metadata.file_name"), r"_[^_]*\.csv$", "")
    return df.select(
        name.alias("dataset"), F.monotonically_increasing_id().alias("trial_id"), "logic_pipe", "phy_pipe", "accuracy"
    )


def locate_recorded(spark: SparkSession, root: str, model: str, metric: str) -> DataFrame:
    """Recorded sequences under ``root/<model>/<metric>/json``, falling back to accuracy."""
    for m in dict.fromkeys((metric, "accuracy")):
        try:
            return read_sequences(spark, f"{root}/{model}/{m}/json")
        except AnalysisException as e:
            if e.getCondition() != "PATH_NOT_FOUND":
                raise
    raise FileNotFoundError(f"no recorded sequences for {model} under {root}")
