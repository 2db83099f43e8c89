"""Record headers and the message-set tag they carry."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Header names used on the wire.
PRODUCER_HEADER = "Producer"
TAG_HEADER = "SyncEvent"

TAG_FIELDS = ("key", "src_partition", "src_idx", "dest_partition", "dest_idx")
TAG_TYPE = "struct<key:string,src_partition:int,src_idx:int,dest_partition:int,dest_idx:int>"
HEADERS_TYPE = "array<struct<key:string,value:binary>>"


def _header(name: str, value: Column) -> Column:
    return F.struct(F.lit(name).alias("key"), value.cast("binary").alias("value"))


def producer_headers(producer: Column, tag: Column | None = None) -> Column:
    """Headers of an outgoing record: the producer id, and the encoded tag if any."""
    entries = [_header(PRODUCER_HEADER, producer)]
    if tag is not None:
        entries.append(_header(TAG_HEADER, tag))
    return F.array(*entries).cast(HEADERS_TYPE)


def header(headers: Column, name: str) -> Column:
    """Value of the last header called ``name``; NULL when there is none."""
    return F.try_element_at(F.filter(headers, lambda h: h["key"] == name), F.lit(-1))["value"]


def encode_tag(tag: Column, fmt: str = "json") -> Column:
    """Tag struct to header bytes: ``json``, or ``text`` (space separated, newline).

    The text form cannot carry keys that contain white space; use json for those.
    """
    if fmt == "json":
        return F.to_json(tag).cast("binary")
    if fmt == "text":
        parts = [tag[f].cast("string") for f in TAG_FIELDS]
        return F.concat(F.concat_ws(" ", *parts), F.lit("\n")).cast("binary")
    raise ValueError(f"unknown tag format {fmt!r}")


def decode_tag(value: Column, fmt: str = "json") -> Column:
    """Header bytes to tag struct; NULL when the bytes are no complete tag."""
    text = value.cast("string")
    if fmt == "json":
        parsed = F.from_json(text, TAG_TYPE)
        ints = [parsed[f] for f in TAG_FIELDS[1:]]
        key = parsed["key"]
    elif fmt == "text":
        parts = F.split(F.regexp_replace(text, "\n$", ""), " ")
        well_formed = F.size(parts) == len(TAG_FIELDS)
        key = F.when(well_formed, F.get(parts, F.lit(0)))
        ints = [
            F.when(well_formed, F.get(parts, F.lit(i)).try_cast("int"))
            for i in range(1, len(TAG_FIELDS))
        ]
    else:
        raise ValueError(f"unknown tag format {fmt!r}")
    complete = key.isNotNull()
    for value_col in ints:
        complete = complete & value_col.isNotNull()
    fields = [key.alias("key")] + [c.alias(f) for c, f in zip(ints, TAG_FIELDS[1:])]
    return F.when(complete, F.struct(*fields))
