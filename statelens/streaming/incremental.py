"""Incremental scoring: new diagram files are parsed, checked and appended as they arrive."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from statelens.operators import elements, graph

SCHEMA = "diagram_id string, text string, at timestamp"


def validated(diagrams: DataFrame) -> DataFrame:
    """Validation rows of (diagram_id, text), a table or a stream: every step works on one row."""
    v = graph.validation(graph.rules(elements.parse_graphs(diagrams.select("diagram_id", "text"))))
    return v.select("diagram_id", "strict_valid", "warning_count", "state_count", "transition_count", "score")


def validate_stream(spark: SparkSession, source: str, target: str, checkpoint: str):
    """Starts a query that validates each new Parquet file of source into target, each once: the file sink's own log
    leaves out what a failed batch had written.
    """
    diagrams = spark.readStream.schema(SCHEMA).parquet(source)
    return validated(diagrams).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()


def validity_over_time(diagrams: DataFrame, every: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """Running counts of diagrams and of those with a complete block, by event-time window; works on a stream or a table."""
    whole = F.col("text").rlike(r"(?s)@startuml.*@enduml")
    rows = diagrams.withWatermark("at", late) if diagrams.isStreaming else diagrams
    return rows.groupBy(F.window("at", every)).agg(F.count("*").alias("n"), F.count_if(whole).alias("complete"))
