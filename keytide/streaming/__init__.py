from keytide.streaming.events import stream_shift_events, stream_sync_events
from keytide.streaming.hot_keys import (
    HotKeyConfig,
    run_hot_key_stream,
    stream_sketch,
    stream_tags,
)
from keytide.streaming.latest import current_sets, stream_latest_sets
from keytide.streaming.live_map import MapVersions, stream_live_map
from keytide.streaming.rates import stream_partition_rate
from keytide.streaming.set_state import stream_tags_in_store
from keytide.streaming.sticky import stream_sticky_round_robin

__all__ = [
    "HotKeyConfig",
    "MapVersions",
    "current_sets",
    "stream_latest_sets",
    "stream_live_map",
    "stream_sticky_round_robin",
    "stream_tags_in_store",
    "run_hot_key_stream",
    "stream_sketch",
    "stream_tags",
    "stream_partition_rate",
    "stream_shift_events",
    "stream_sync_events",
]
