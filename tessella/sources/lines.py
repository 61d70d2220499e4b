"""Text files as line tables, and line numbers that need no single ordered pass."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.ordering import join_checked, running_total
from tessella.storage import cut_lineage


SPLIT_SETTING = "spark.sql.files.minPartitionNum"


def _pin_file_blocks(spark: SparkSession) -> None:
    """Keep file blocks the same in every scan of this session.

    By default the block size of small inputs follows the number of executors at that moment. Line
    tables are scanned twice, for chunk facts and for texts, and executors may come or go in between.
    """
    if spark.conf.get(SPLIT_SETTING, None) is None:
        spark.conf.set(SPLIT_SETTING, str(spark.sparkContext.defaultParallelism))


def scan_lines(spark: SparkSession, paths: str | Sequence[str], line_sep: str | None = None) -> DataFrame:
    """Lines of text files: ``file``, ``chunk`` (start of the file block), ``pos``, ``value``."""
    _pin_file_blocks(spark)
    scan = spark.read.text(paths if isinstance(paths, str) else list(paths), lineSep=line_sep)
    return scan.select(
        F.col("_metadata.file_path").alias("file"),
        F.col("_metadata.file_block_start").alias("chunk"),
        F.monotonically_increasing_id().alias("pos"),
        "value",
    )


def write_bundles(lines: DataFrame, path: str) -> None:
    """A line table of very many small files (``file``, ``chunk``, ``pos``, ``value``) as few text files.

    Each line begins with the name of its file (URL-encoded, so it holds no tab) and a tab. The lines of one file
    lie together, in order, in one bundle, which is compressed and so read by one task. A file of its own is made, moved, listed and opened, each a
    call or more to the file system, which for small files takes longer than their lines.
    """
    ordered = lines.repartition("file").sortWithinPartitions("file", "chunk", "pos")
    ordered.select(F.concat(F.url_encode("file"), F.lit("\t"), "value")).write.text(path, compression="gzip", lineSep="\n")


def scan_bundles(spark: SparkSession, paths: str | Sequence[str]) -> DataFrame:
    """``scan_lines`` of the files within bundles (``write_bundles``); ``chunk`` is the bundle and the start of its block."""
    lines = scan_lines(spark, paths, "\n")
    name = F.substring_index("value", "\t", 1)
    unnamed = F.raise_error(F.concat(F.lit("line without the name of its file in "), F.col("file"))).cast("string")
    # By bytes, as some of a text file may be no UTF-8.
    value = F.substr(F.col("value").cast("binary"), F.octet_length(name) + 2).cast("string")
    return lines.select(
        F.when(F.contains("value", F.lit("\t")), F.url_decode(name)).otherwise(unnamed).alias("file"),
        F.struct(F.col("file").alias("bundle"), F.col("chunk").alias("start")).alias("chunk"),
        "pos",
        value.alias("value"),
    )


def number_scanned(lines: DataFrame, within: Sequence[str] = ("file",)) -> DataFrame:
    """Line numbers for ``scan_lines`` and ``scan_bundles``: ``pos`` counts up by one within a block, so the number of a
    line follows from its block's first ``pos`` and the lines of the blocks before it. The texts
    are not shuffled as long as the table of blocks is small enough to broadcast.

    With an empty ``within`` the count runs on over all files in path order."""
    blocks = lines.groupBy("file", "chunk").agg(F.count("*").alias("_n"), F.min("pos").alias("_first"))
    earlier = Window.partitionBy(*within).orderBy("file", "chunk").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_before")
    starts = cut_lineage(blocks.select("file", "chunk", "_first", before))
    numbered = join_checked(lines, starts, ["file", "chunk"], ["pos"], how="left")
    unknown = F.raise_error(F.concat(F.lit("file changed while it was read: "), F.col("file"))).cast("long")
    number = F.coalesce(F.col("pos") - F.col("_first") + F.col("_before") + 1, unknown)
    return numbered.withColumn("line_no", number).drop("_first", "_before")


def number_lines(lines: DataFrame) -> DataFrame:
    """Line numbers for any line table, by running totals over its chunks."""
    return running_total(lines, F.lit(1), "line_no", ["file"], "chunk", ["pos"])
