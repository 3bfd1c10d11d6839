"""Streams: noise and cleaning on arriving rows, results appended once for each key."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import StreamingQuery

from ..operators.noise import perturb
from ..sources.sinks import append_results


def noised_stream(rows: DataFrame, noise_type: str, severity: int, seed: int) -> DataFrame:
    """The same expressions as for tables: they are stateless, so a stream needs nothing else."""
    return perturb(rows, noise_type, [severity], [seed])


def append_stream(rows: DataFrame, path: str, checkpoint: str, key: list[str]) -> StreamingQuery:
    """Each micro-batch adds the keys that the table lacks, so a replayed batch or a resumed run adds nothing."""
    return rows.writeStream.foreachBatch(lambda batch, _: append_results(batch, path, key)).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def first_by_key(rows: DataFrame, key: list[str], time: str, delay: str = "1 hour") -> DataFrame:
    """Rows given twice within the delay once only, with bounded state."""
    return rows.withWatermark(time, delay).dropDuplicatesWithinWatermark(key)
