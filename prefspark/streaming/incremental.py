"""Incremental scoring with Structured Streaming.

The reference restarts extraction by skipping pairs whose output already
exists.  Here new pair-vector files dropped into a folder are scored under
a head set and appended to a parquet sink; the file source's checkpoint
(under the shared ``spark.checkpoint.dir``) records which files were done,
so a restart or a lost executor neither skips nor repeats a pair.
"""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from prefspark.operators.scoring import HeadMatrix, collect_heads, explode_scores, score_heads_packed
from prefspark.session import ensure_checkpoint_dir


def stream_key(source_dir: str, sink_dir: str, heads: HeadMatrix) -> str:
    """Name of a stream's checkpoint, the same in every process: other heads
    or another source start a stream of their own."""
    tag = hashlib.md5(f"{source_dir}\n{sink_dir}\n{list(heads.ids)}\n".encode())
    tag.update(heads.w.tobytes())
    return tag.hexdigest()[:16]


def score_new_pairs(spark: SparkSession, source_dir: str, schema: T.StructType,
                    heads: DataFrame | HeadMatrix, sink_dir: str, checkpoint: str | None = None,
                    keep: tuple[str, ...] = ("pair_id", "subset"),
                    max_files_per_trigger: int | None = None) -> None:
    """Score every pair file not yet processed and append long scores
    ``(keep..., head_id, s_chosen, s_rejected)`` to ``sink_dir``.

    Runs with ``availableNow``: processes what is there now, in bounded
    micro-batches, then stops.
    """
    hm = heads if isinstance(heads, HeadMatrix) else collect_heads(heads)
    if checkpoint is None:
        checkpoint = f"{ensure_checkpoint_dir(spark).rstrip('/')}/streams/score-{stream_key(source_dir, sink_dir, hm)}"
    reader = spark.readStream.schema(schema)
    if max_files_per_trigger:
        reader = reader.option("maxFilesPerTrigger", max_files_per_trigger)
    stream = reader.parquet(source_dir)
    packed, ids = score_heads_packed(stream, hm)
    long = explode_scores(packed, ids, list(keep))
    q = (long.writeStream.format("parquet").option("path", sink_dir)
         .option("checkpointLocation", checkpoint).outputMode("append")
         .trigger(availableNow=True).start())
    q.awaitTermination()
