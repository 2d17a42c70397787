"""Stream scoring (L12s): snapshots arriving as files -> validated -> scored
-> alert rows appended to a sink. Stateless, so every micro-batch is a plain
projection; the stream's checkpoint gives exactly-once output on restart."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vigil.plans.score import alert_table


def alert_stream(spark: SparkSession, source_dir: str, schema, model, threshold: float, sink_dir: str,
                 checkpoint_dir: str, prepare=None, keep=(), fmt: str = "parquet",
                 max_files_per_trigger: int = 1, available_now: bool = True, source_glob: str | None = None):
    """Start the stream; ``prepare`` maps the raw stream to snapshot columns."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files_per_trigger).format(fmt)
    if source_glob:
        reader = reader.option("pathGlobFilter", source_glob)
    raw = reader.load(source_dir)
    snaps = prepare(raw) if prepare else raw
    out: DataFrame = alert_table(model, threshold, snaps, keep)
    writer = (out.writeStream.format("parquet").option("path", sink_dir)
              .option("checkpointLocation", checkpoint_dir).outputMode("append"))
    writer = writer.trigger(availableNow=True) if available_now else writer.trigger(processingTime="10 seconds")
    return writer.start()
