"""Classification metrics from confusion counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

METRICS = (
    "accuracy", "precision_macro", "precision_weighted", "recall_macro", "recall_weighted",
    "f1_macro", "f1_weighted",
)


def confusion(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    return df.groupBy(F.col(label).alias("label"), F.col(prediction).alias("prediction")).agg(
        F.count(F.lit(1)).alias("n")
    )


def _ratio(a: Column, b: Column) -> Column:
    return F.coalesce(a / F.nullif(b.cast("double"), F.lit(0.0)), F.lit(0.0))


def classification_metrics(df: DataFrame, label: str = "label", prediction: str = "prediction") -> DataFrame:
    """One row. Macro averages run over every value seen as label or prediction; ratios
    with an empty denominator are 0. Each cell counts once for its label, once for its
    prediction, so no join is needed after the first aggregate."""
    cells = confusion(df, label, prediction)
    sides = F.array(
        F.struct(F.col("label").alias("c"), F.col("n").alias("actual"), F.lit(0).cast("long").alias("guessed"),
                 F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0).alias("hit")),
        F.struct(F.col("prediction").alias("c"), F.lit(0).cast("long").alias("actual"), F.col("n").alias("guessed"),
                 F.lit(0).cast("long").alias("hit")),
    )
    per = (
        cells.select(F.explode(sides).alias("s"))
        .select("s.*")
        .groupBy("c")
        .agg(F.sum("actual").alias("actual"), F.sum("guessed").alias("guessed"), F.sum("hit").alias("hit"))
    )
    p, r = _ratio(F.col("hit"), F.col("guessed")), _ratio(F.col("hit"), F.col("actual"))
    scored = per.select("actual", "hit", p.alias("p"), r.alias("r")).withColumn(
        "f", _ratio(2 * F.col("p") * F.col("r"), F.col("p") + F.col("r"))
    )
    n = F.sum("actual").cast("double")
    weighted = lambda c: F.sum(F.col(c) * F.col("actual")) / n
    return scored.agg(
        (F.sum("hit") / n).alias("accuracy"),
        F.avg("p").alias("precision_macro"),
        weighted("p").alias("precision_weighted"),
        F.avg("r").alias("recall_macro"),
        weighted("r").alias("recall_weighted"),
        F.avg("f").alias("f1_macro"),
        weighted("f").alias("f1_weighted"),
    )
