"""The query compiler over streams: windows in event time, with watermarks for late rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tamarack.functions.expressions import Aggregate, Scope
from tamarack.lookups import parse
from tamarack.model import Model, Registry
from tamarack.operators.query import Query
from tamarack.sources.source import FrameSource


def stream(spark: SparkSession, model: Model, folder: str, pattern: str = "*.parquet", files_per_batch: int = 100) -> DataFrame:
    """New parquet files of ``folder`` as a stream with the model's schema."""
    return spark.readStream.schema(model.schema()).option("pathGlobFilter", pattern).option("maxFilesPerTrigger", files_per_batch).parquet(folder)


def query_stream(registry: Registry, model: Model, frames: dict[str, DataFrame]) -> Query:
    """A query whose tables may be streams: filters, projections and joins with static tables apply as they are."""
    spark = next(iter(frames.values())).sparkSession
    return Query(model, FrameSource(spark, registry, frames))


def windowed(rows: DataFrame, model: Model, time: str, aggregates: dict[str, Aggregate], *, by: tuple[str, ...] = (), size: str | None = None, slide: str | None = None, gap: str | None = None, late: str = "0 seconds") -> DataFrame:
    """Aggregates per window of event time: tumbling (size), sliding (size and slide) or by session (gap).

    Rows may be ``late`` by that much; windows past it are final, and their state is given up.
    Batch frames give the same rows in one go.
    """
    if (size is None) == (gap is None):
        raise ValueError("give either size, for tumbling and sliding windows, or gap, for sessions")
    kind = rows.schema[time].dataType.simpleString()
    if rows.isStreaming:  # watermarks ask for timestamps of the session's time zone
        rows = rows.withColumn(time, F.col(time).cast("timestamp")).withWatermark(time, late)
    when = F.session_window(time, gap) if gap else F.window(time, size, slide) if slide else F.window(time, size)
    scope = Scope(lambda path: (F.col(path[-1]), model.field(path[-1]).spark_type))
    keys = [F.col(parse(b).path[-1]) for b in by]
    made = rows.groupBy(when.alias("window"), *keys).agg(*[scope.column(a).alias(n) for n, a in aggregates.items()])
    return made.select(F.col("window.start").cast(kind).alias("window_start"), F.col("window.end").cast(kind).alias("window_end"), *[b for b in by], *aggregates)


def run_available(df: DataFrame, target: str, checkpoint: str, mode: str = "append") -> None:
    """Write what the stream has now as parquet below ``target``, exactly once for one checkpoint folder."""
    df.writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True).start().awaitTermination()
