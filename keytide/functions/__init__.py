from keytide.functions.hashing import fnv1a, fnv_partition, msg_uniform, p2c_draws
from keytide.functions.headers import decode_tag, encode_tag, header, producer_headers
from keytide.functions.chunked import (
    chunked_lag,
    chunked_rank,
    chunked_running_sum,
    fits_one_task,
    plain_rank,
    with_sequence,
)
from keytide.functions.joins import dimension_join, interval_join, plan_interval_join

__all__ = [
    "fnv1a",
    "fnv_partition",
    "msg_uniform",
    "p2c_draws",
    "decode_tag",
    "encode_tag",
    "header",
    "producer_headers",
    "chunked_lag",
    "chunked_rank",
    "chunked_running_sum",
    "fits_one_task",
    "plain_rank",
    "with_sequence",
    "dimension_join",
    "interval_join",
    "plan_interval_join",
]
