"""Exactly-once sinks: each micro-batch owns one folder, so a replay overwrites itself."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, functions as F



def batch_folder(path: str, transform: Callable[[DataFrame], DataFrame] | None = None
                 ) -> Callable[[DataFrame, int], None]:
    """``foreachBatch`` function writing ``path/batch=<id>``."""

    def write(rows: DataFrame, batch_id: int) -> None:
        out = transform(rows) if transform else rows
        out.write.mode("overwrite").option("compression", "zstd").parquet(f"{path}/batch={batch_id}")

    return write


def run_available(stream: DataFrame, path: str, checkpoint: str, mode: str = "append",
                  transform: Callable[[DataFrame], DataFrame] | None = None) -> None:
    """Process everything there is, then stop; the checkpoint is the resume point."""
    query = (stream.writeStream.outputMode(mode)
             .foreachBatch(batch_folder(path, transform))
             .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    query.awaitTermination()


def latest(rows: DataFrame, *keys: str) -> DataFrame:
    """Current value of each key of an update-mode sink: the one of its last batch."""
    others = [c for c in rows.columns if c not in keys and c != "batch"]
    return rows.groupBy(*keys).agg(
        F.max_by(F.struct(*others), F.col("batch")).alias("_row")).select(*keys, "_row.*")
