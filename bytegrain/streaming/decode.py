"""The same decoders on a stream of payloads."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.payloads import decode_column


def read_stream(spark: SparkSession, path: str, glob: str = "*") -> DataFrame:
    """New files of a folder, one row each: path, modificationTime, payload."""
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("pathGlobFilter", glob).load(path).withColumnRenamed("content", "payload")


def decode_stream(stream: DataFrame, fmt: str, schema: str, **more) -> DataFrame:
    """Decoding is a map, so it needs no state and no watermark."""
    return decode_column(stream, fmt, schema, **more)


def _counts() -> list:
    return [F.count(F.when(F.col("error").isNull(), 1)).alias("n_good"), F.count("error").alias("n_bad")]


def counts_by_time(decoded: DataFrame, time: str, window: str = "1 minute", late: str = "5 minutes", slide: str | None = None) -> DataFrame:
    """Decoded and failed payloads by window, a sliding one where slide is given; what comes later than `late` is dropped."""
    return decoded.withWatermark(time, late).groupBy(F.window(time, window, slide).alias("w")).agg(*_counts()).select("w.start", "w.end", "n_good", "n_bad")


def counts_by_session(decoded: DataFrame, time: str, key: str, gap: str = "10 minutes", late: str = "5 minutes") -> DataFrame:
    """Decoded and failed payloads of each key's sessions, which end after a gap without any."""
    return decoded.withWatermark(time, late).groupBy(key, F.session_window(time, gap).alias("w")).agg(*_counts()).select(key, "w.start", "w.end", "n_good", "n_bad")
