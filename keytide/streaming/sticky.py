"""Sticky round-robin over a stream: keys keep their endpoint from batch to batch."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from keytide.functions.chunked import SLICE_ROWS, with_sequence
from keytide.functions.joins import BROADCAST_ROWS, dimension_join
from keytide.operators.endpoints import first_messages, take_turns
from keytide.streaming.hot_keys import AVAILABLE_NOW, start_batches
from keytide.streaming.state import VersionedState

ASSIGNED = "key string, turn bigint, endpoint_idx int, endpoint string"
TURN = "turn bigint"


def stream_sticky_round_robin(
    stream: DataFrame,
    endpoints: DataFrame,
    state_dir: str,
    out_path: str,
    checkpoint: str,
    epoch_col: str | None = None,
    trigger: dict = AVAILABLE_NOW,
    slice_rows: int = SLICE_ROWS,
    broadcast_rows: int = BROADCAST_ROWS,
) -> StreamingQuery:
    """``sticky_round_robin`` of a stream; messages with their ``endpoint`` go below ``out_path``.

    A batch writes the keys it has seen for the first time and the turn it ended with, so state grows
    by new keys only. With ``epoch_col`` a key is new in each epoch; the turn goes on.
    """
    state = VersionedState(stream.sparkSession, state_dir)
    scope = [epoch_col] if epoch_col else []
    on = [*scope, "key"]

    def step(batch: DataFrame, batch_id: int) -> None:
        kinds = dict(batch.dtypes)
        schema = ", ".join([*(f"{c} {kinds[c]}" for c in scope), ASSIGNED])
        known = state.up_to("assigned", batch_id, schema)
        base = state.before("turn", batch_id, TURN).agg(F.coalesce(F.max("turn"), F.lit(0))).scalar()
        messages = state.scratch("messages", batch_id, batch)
        fresh = first_messages(messages, scope).join(known.select(*on), on, "left_anti")
        turns = with_sequence(fresh, [], ["_ts", "_id"], "turn", slice_rows)
        turns = turns.withColumn("turn", F.col("turn") + base)
        fresh = take_turns(turns, endpoints).select(*on, "turn", "endpoint_idx", "endpoint")
        fresh = state.save("assigned", batch_id, fresh)
        last = fresh.select("turn").unionByName(state.before("turn", batch_id, TURN))
        state.save("turn", batch_id, last.agg(F.coalesce(F.max("turn"), F.lit(0)).alias("turn")))
        all_keys = known.unionByName(fresh).select(*on, "endpoint")
        placed = dimension_join(messages, all_keys, on, broadcast_rows)
        placed.write.mode("overwrite").parquet(f"{out_path}/batch={batch_id}")
        state.finish(batch_id)

    return start_batches(stream, step, checkpoint, trigger)
