"""Structured Streaming forms: a bounded sample of a text stream, and items as responses arrive."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tessella.operators.ordering import spread
from tessella.operators.teacher import items_of_judged, judge_items
from tessella.storage import cut_lineage

DEFAULT_TAKE = 200
COMPRESSION = "gzip"  # of what streams write: items repeat their prompts and sentences many times over
RESPONSE_SCHEMA = "paragraph_index BIGINT, sentence_index BIGINT, sentence STRING, body STRING"


def stream_take(stream: DataFrame, take: int | None = None) -> DataFrame:
    """The first ``take`` rows, of which those with a text stay; rows without one count as taken."""
    return stream.limit(DEFAULT_TAKE if take is None else take).filter(F.col("text").isNotNull())


def _first_rows(rows: DataFrame, n: int) -> DataFrame:
    """The first ``n`` rows in partition order, without a task that sees them all.

    The rows are kept before they are numbered for good, so that both readings see the same order.
    """
    at = cut_lineage(rows.withColumn("_at", F.monotonically_increasing_id()))
    part, index = F.shiftright("_at", 33), F.col("_at").bitwiseAND((1 << 33) - 1)
    sizes = at.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    earlier = F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1))
    starts = sizes.select("_part", F.coalesce(earlier, F.lit(0)).alias("_before"))  # one row per partition
    joined = at.join(F.broadcast(starts), part == F.col("_part"))
    return joined.filter(F.col("_before") + index < n).drop("_at", "_part", "_before")


def take_available(stream: DataFrame, path: str, checkpoint: str, take: int | None = None) -> None:
    """``stream_take`` for any ``take``, with files of its own for every batch.

    Rows with a text go below ``rows``; below ``taken`` each batch says how many rows it took, with those
    without a text. A batch counts on from the batches before it and replaces what it left itself, so
    a stopped run goes on where it was, in whatever batches the rest arrives. No task sees all rows.
    """
    spark = stream.sparkSession
    most = DEFAULT_TAKE if take is None else take
    # Before the first batch: nothing taken, and both folders are there to be read.
    spark.createDataFrame([(0,)], "n long").write.mode("overwrite").json(f"{path}/taken/batch=-1")
    spark.createDataFrame([], stream.schema).write.mode("overwrite").json(f"{path}/rows/batch=-1")

    def each(batch: DataFrame, number: int) -> None:
        earlier = spark.read.schema("n long, batch long").json(f"{path}/taken").filter(F.col("batch") < number)
        left = most - earlier.agg(F.sum("n")).first()[0]
        if left <= 0:
            return
        rows = cut_lineage(batch)
        arrived = rows.count()
        taken = rows if arrived <= left else _first_rows(rows, left)
        taken.filter(F.col("text").isNotNull()).write.mode("overwrite").json(f"{path}/rows/batch={number}")
        # Last, so that a batch that counts is whole.
        spark.createDataFrame([(min(arrived, left),)], "n long").write.mode("overwrite").json(f"{path}/taken/batch={number}")

    query = stream.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def response_stream(spark: SparkSession, folder: str, files_per_trigger: int = 1000) -> DataFrame:
    reader = spark.readStream.schema(RESPONSE_SCHEMA).option("maxFilesPerTrigger", files_per_trigger)
    return reader.json(folder)


def items_from_responses(responses: DataFrame, max_transforms: int = 3) -> DataFrame:
    """Stateless: the same parse, check and fan-out as the batch job, response by response."""
    return items_of_judged(judge_items(responses, max_transforms))


def append_available(stream: DataFrame, path: str, checkpoint: str, fmt: str = "json") -> None:
    """Append all that has arrived; a stopped run keeps its output and goes on where it was."""
    query = (
        stream.writeStream.format(fmt)
        .outputMode("append")
        .option("compression", COMPRESSION)
        .option("checkpointLocation", checkpoint)
        .trigger(availableNow=True)
        .start(path)
    )
    query.awaitTermination()


def append_judged(responses: DataFrame, path: str, checkpoint: str, max_transforms: int = 3, written=lambda name, batch: None) -> None:
    """Items and rejects of all responses that have arrived, below ``items`` and ``rejects``.

    Both sinks get a folder per batch, which a batch that is run again after a stop replaces, so neither
    has a row twice. Each response is judged once; what is kept of it until both sinks have it are its fault or the
    parts of its items. A batch of few files, which cannot be split, is judged on all cores. ``written`` is told of
    each sink's batch when it is done.
    """
    keys = ["paragraph_index", "sentence_index"]

    def each(batch: DataFrame, number: int) -> None:
        # Not by the keys themselves: files dealt out by the same hash would stay together.
        judged = judge_items(spread(batch, F.xxhash64(*keys)), max_transforms).persist(StorageLevel.DISK_ONLY)
        rejects = judged.filter(F.col("fault").isNotNull()).select(*keys, "fault.path", "fault.reason")
        for name, rows in (("items", items_of_judged(judged)), ("rejects", rejects)):
            rows.write.mode("overwrite").json(f"{path}/{name}/batch={number}", compression=COMPRESSION)
            written(name, number)
        judged.unpersist()

    query = responses.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
