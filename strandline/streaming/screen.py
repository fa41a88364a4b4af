"""Read screens on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql.streaming import DataStreamWriter

from strandline.operators import kmers as K


def screen_stream(reads: DataFrame, bait: DataFrame, k: int, percent: float, key: str, path: str, checkpoint: str) -> DataStreamWriter:
    """A writer that appends to ``path`` the reads of a stream that pass the k-mer screen against a static bait.

    A read is judged on its own, so each micro-batch is screened like a table and no state is kept; a batch that is run
    again after a failure overwrites its own folder.
    """

    def write(batch: DataFrame, number: int) -> None:
        K.screen(batch, bait, k, percent, key).write.mode("overwrite").parquet(f"{path}/batch={number}")

    return reads.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
