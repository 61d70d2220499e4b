"""Loss series from training logs and their smoothing."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.operators.ordering import rank_rows

BLOCK_ROWS = 65_536

# What the JSON reader makes of the bare words for numbers that JSON lacks.
BARE_NUMBERS = ("NaN", "Infinity", "-Infinity")
EVAL_LOSS = r"^eval_(?:.+_)?loss$"


def _is_number(value: Column) -> Column:
    kind = F.schema_of_variant(value)
    bare = (kind == "STRING") & F.try_variant_get(value, "$", "string").isin(*BARE_NUMBERS)
    return kind.isin("BIGINT", "FLOAT", "DOUBLE") | kind.startswith("DECIMAL") | bare


def record_number(value: Column) -> Column:
    """Whole or not, as a double; anything else, null and text included, is missing."""
    return F.when(_is_number(value), F.try_variant_get(value, "$", "double"))


def record_step(record: Column) -> Column:
    """The step of a record; one that is no whole number is missing."""
    step = record_number(F.try_variant_get(record, "$.step", "variant"))
    return F.when(step == F.floor(step), F.try_variant_get(record, "$.step", "bigint"))


def log_losses(records: DataFrame) -> DataFrame:
    """``step``, ``loss`` and ``eval_loss`` of records (run, pos, record), each where it is a number."""
    named = [record_number(F.try_variant_get("record", f"$.{name}", "variant")).alias(name) for name in ("loss", "eval_loss")]
    return records.select("run", "pos", record_step(F.col("record")).alias("step"), *named)


def log_metrics(records: DataFrame) -> DataFrame:
    """Every number of every record that has a step, under its key: (run, pos, step, metric, value)."""
    values = F.try_variant_get("record", "$", "map<string,variant>")
    found = records.select("run", "pos", record_step(F.col("record")).alias("step"), F.explode(values).alias("metric", "_value"))
    numbers = found.filter(F.col("step").isNotNull() & (F.col("metric") != "step")).withColumn("value", record_number(F.col("_value")))
    return numbers.filter(F.col("value").isNotNull()).drop("_value")


def eval_losses(metrics: DataFrame) -> DataFrame:
    """The evaluation losses among ``log_metrics``; with several evaluation sets each has a key of its own."""
    return metrics.filter(F.col("metric").rlike(EVAL_LOSS))


def loss_series(log: DataFrame, order: Sequence[str] = ("pos",)) -> DataFrame:
    """Records with a step and a loss, an evaluation loss, or both, as one row per series."""
    points = F.array(
        F.struct(F.lit("train").alias("series"), F.col("loss").alias("value")),
        F.struct(F.lit("eval").alias("series"), F.col("eval_loss").alias("value")),
    )
    kept = log.filter(F.col("step").isNotNull()).select("run", *order, "step", F.explode(points).alias("p"))
    return kept.select("run", "p.series", *order, "step", "p.value").filter(F.col("value").isNotNull())


def require_series(series: DataFrame) -> DataFrame:
    if series.isEmpty():
        raise ValueError("the log has neither 'loss' nor 'eval_loss' records")
    return series


def eval_window(k: int) -> int:
    return max(1, min(k, 3))


def moving_average(
    series: DataFrame, k: int = 5, order: Sequence[str] = ("pos",), block_rows: int = BLOCK_ROWS
) -> DataFrame:
    """Trailing mean over up to ``k`` rows of the run's series, in log order; lighter for eval.

    A run may hold any share of the rows. All rows get a position in (run, series, log) order, and
    windows work on blocks of ``block_rows`` positions; the last ``k - 1`` rows of a block are also
    given to the next one as context, so no window is longer than a block and none is cut short.
    """
    reach = max(k - 1, 0)
    block_rows = max(block_rows, k)
    ranked = rank_rows(series, ["run", "series", *order], "_g")
    at = F.col("_g") - 1
    block = F.floor(at / block_rows)
    copies = F.when(
        at % block_rows >= block_rows - reach,
        F.array(F.struct(block.alias("b"), F.lit(False).alias("c")), F.struct((block + 1).alias("b"), F.lit(True).alias("c"))),
    ).otherwise(F.array(F.struct(block.alias("b"), F.lit(False).alias("c"))))
    spread = ranked.withColumn("_copy", F.explode(copies)).select("*", "_copy.b", "_copy.c").drop("_copy")

    def trailing(rows: int) -> Column:
        if rows <= 1:
            return F.col("value")
        frame = Window.partitionBy("b", "run", "series").orderBy("_g").rowsBetween(-(rows - 1), 0)
        return F.avg("value").over(frame)

    smoothed = F.when(F.col("series") == "eval", trailing(eval_window(k))).otherwise(trailing(k))
    return spread.withColumn("smoothed", smoothed).filter(~F.col("c")).drop("b", "c", "_g")


def perplexity(loss: Column) -> Column:
    """Infinite where the power overflows, missing where the loss is."""
    return F.exp(loss)
