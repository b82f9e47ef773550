"""Run records as a stream: each micro-batch of new records rebuilds the published history.

The history itself is always a full rebuild from the records (it is small and must
be the same whatever the order of arrival), so the stream only says when.
"""

from __future__ import annotations

from collections.abc import Callable
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..plans.stages import Project, history, publish_layer


def watch(spark: SparkSession, project: Project, checkpoint: str | Path, then: Callable[[int], None] | None = None) -> StreamingQuery:
    """Follow the folder of quality records and publish the observability layer after each batch of new ones."""
    records = spark.readStream.format("text").option("wholetext", True).option("pathGlobFilter", "*.json").load(str(project.results("dq")))

    def rebuild(batch: DataFrame, number: int) -> None:
        if not batch.isEmpty():
            publish_layer(project, "observability", history(spark, project))
            if then:
                then(number)

    return records.writeStream.foreachBatch(rebuild).option("checkpointLocation", str(checkpoint)).trigger(availableNow=True).start()
