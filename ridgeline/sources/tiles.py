"""Vector tiles (a binary column) to features: a reader of their wire format over batches of rows."""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Field numbers of the format. Tile: layers. Layer: name, features, keys, values. Feature: id, tags.
LAYERS, LAYER_NAME, FEATURES, KEYS, VALUES, FEATURE_ID, TAGS = 3, 1, 2, 3, 4, 1, 2
#: Fields of a value.
TEXT, FLOAT, DOUBLE, INT, UINT, SINT, BOOL = 1, 2, 3, 4, 5, 6, 7


def varint(data: bytes, at: int) -> tuple[int, int]:
    """A number of up to 64 bits in groups of seven, the low ones first; and where it ends."""
    out = 0
    for k in range(10):
        if at >= len(data):
            raise ValueError("ends within a number")
        byte = data[at]
        at += 1
        out |= (byte & 0x7F) << (7 * k)
        if byte < 0x80:
            return out & (2**64 - 1), at
    raise ValueError("number of more than 64 bits")


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """Field numbers and their values: numbers, or the bytes of what has a length."""
    at = 0
    while at < len(data):
        tag, at = varint(data, at)
        kind = tag & 7
        if kind == 0:
            value, at = varint(data, at)
        elif kind in (1, 2, 5):
            size, at = (8 if kind == 1 else 4, at) if kind != 2 else varint(data, at)
            if at + size > len(data):
                raise ValueError("ends within a field")
            value, at = data[at : at + size], at + size
        else:
            raise ValueError(f"wire type {kind}")
        yield tag >> 3, value


def plain(data: bytes) -> str | None:
    """A value as text; the last field counts."""
    out = None
    for field, v in fields(data):
        if field == TEXT:
            out = v.decode()
        elif field in (FLOAT, DOUBLE):
            out = repr(struct.unpack("<f" if field == FLOAT else "<d", v)[0])
        elif field == INT:
            out = str(v - 2**64 if v >= 2**63 else v)
        elif field == UINT:
            out = str(v)
        elif field == SINT:
            out = str((v >> 1) ^ -(v & 1))
        elif field == BOOL:
            out = "true" if v else "false"
    return out


def packed(data: bytes) -> list[int]:
    out, at = [], 0
    while at < len(data):
        v, at = varint(data, at)
        out.append(v)
    return out


def features_of(tile: bytes) -> list[tuple[str, int | None, list[tuple[str, str | None]]]]:
    """(layer, id, tags) of every feature. A tag that the layer's tables do not hold makes the tile malformed."""
    out = []
    for field, layer in fields(tile):
        if field != LAYERS:
            continue
        parts = list(fields(layer))
        name = next((v.decode() for f, v in parts if f == LAYER_NAME), "")
        keys, values = [v.decode() for f, v in parts if f == KEYS], [plain(v) for f, v in parts if f == VALUES]
        for f, feature in parts:
            if f != FEATURES:
                continue
            own, number = [], None
            for g, v in fields(feature):
                if g == FEATURE_ID:
                    number = v
                elif g == TAGS:
                    own += packed(v)
            if len(own) % 2 or any(k >= len(keys) for k in own[::2]) or any(v >= len(values) for v in own[1::2]):
                raise ValueError("tags without a key or value")
            out.append((name, number, list({keys[k]: values[v] for k, v in zip(own[::2], own[1::2], strict=True)}.items())))
    return out


def decoded(tiles: DataFrame, tile_id: str = "tile_id", data: str = "data") -> DataFrame:
    """tile_id, layer, id, tags (map of texts) of every feature; of a malformed tile one row with `error`. Tiles without bytes have no rows."""

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = [tile_id, "layer", "id", "tags", "error"]
        for b in batches:
            rows = []
            for key, tile in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                try:
                    rows += [(key, layer, None if n is None else min(n, 2**63 - 1), tags, None) for layer, n, tags in features_of(tile or b"")]
                except (ValueError, TypeError, AttributeError, struct.error) as e:
                    rows.append((key, None, None, None, str(e) or type(e).__name__))
            kinds = [b.schema.field(0).type, pa.string(), pa.int64(), pa.map_(pa.string(), pa.string()), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=names)

    kind = tiles.schema[tile_id].dataType.simpleString()
    return tiles.select(tile_id, data).mapInArrow(read, f"{tile_id} {kind}, layer string, id long, tags map<string,string>, error string")


def highlights(features: DataFrame) -> DataFrame:
    """id, lat, lng, name, category of decoded features that have a name and a place; the category of others is `unknown`."""
    tag = lambda name: F.try_element_at("tags", F.lit(name))
    rows = features.where(F.col("error").isNull()).select("id", tag("lat").try_cast("double").alias("lat"), tag("lng").try_cast("double").alias("lng"), tag("name").alias("name"), F.coalesce(tag("category"), F.lit("unknown")).alias("category"))
    return rows.where(F.col("lat").isNotNull() & F.col("lng").isNotNull() & (F.col("name") != ""))
