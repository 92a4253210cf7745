"""Content-defined chunking by the maximum of a rolling checksum."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from quarry.plans.scratch import ship

# Block limits, and the rolling checksum's offset for each byte.
MIN_BLOCK, MAX_BLOCK, CHAR_OFFSET = 64 * 1024, 8 * 1024 * 1024, 31


def window_digests(data: np.ndarray, window: int) -> np.ndarray:
    """Digest of each full window: (s2 << 16 | s1) of the two 16-bit sums, for ends window..len(data)."""
    x = data.astype(np.int64) + CHAR_OFFSET
    one = np.concatenate([[0], np.cumsum(x)])
    weighted = np.concatenate([[0], np.cumsum(x * np.arange(1, len(x) + 1))])
    end = np.arange(window, len(x) + 1)
    s1 = one[end] - one[end - window]
    s2 = s1 * (end + 1) - (weighted[end] - weighted[end - window])  # the oldest byte counts window times
    return ((s2 & 0xFFFF) << 16) | (s1 & 0xFFFF)


#: Window ends whose digests are computed at a time.
SLICE = 1 << 18


def digests_between(raw: np.ndarray, first: int, last: int, window: int) -> np.ndarray:
    """Digests of the windows that end at first to last, inclusive; a slice at a time."""
    out = np.empty(max(0, last - first + 1), np.uint32)
    for a in range(first, last + 1, SLICE):
        b = min(last, a + SLICE - 1)
        out[a - first : b - first + 1] = window_digests(raw[a - window : b], window)
    return out


def cut_points(data: bytes, least: int = MIN_BLOCK, most: int = MAX_BLOCK) -> list[int]:
    """Ends of the chunks.  A buffer of over 2 * least bytes is cut where the digest is largest (the last
    such place), the rest is carried over; a smaller buffer is one chunk.

    A digest is computed once, however often its place is carried over; four bytes for each place of a
    buffer are held.
    """
    raw, start, filled, cuts = np.frombuffer(data, np.uint8), 0, 0, []
    known, known_from = np.zeros(0, np.uint32), least  # digests of ends from known_from on
    while start < len(raw):
        filled = min(len(raw), max(filled, start) + (most - max(0, filled - start)))
        size = filled - start
        if size > 2 * least:
            first = start + least
            known, known_from = (known[first - known_from :], first) if first - known_from <= len(known) else (known[:0], first)
            known = np.concatenate([known, digests_between(raw, known_from + len(known), filled, least)])
            size = least + len(known) - 1 - int(known[::-1].argmax())
        start += size
        cuts.append(start)
    return cuts


def stream_chunks(f, least: int = MIN_BLOCK, most: int = MAX_BLOCK) -> Iterator[bytes]:
    """The chunks of an open file, as ``cut_points`` makes them, in the memory of two buffers."""
    held, ended = b"", False
    while held or not ended:
        while len(held) < most and not ended:
            more = f.read(most - len(held))
            ended, held = not more, held + more
        if not held:
            return
        size = len(held)
        if size > 2 * least:
            d = digests_between(np.frombuffer(held, np.uint8), least, size, least)
            size = least + len(d) - 1 - int(d[::-1].argmax())
        yield held[:size]
        held = held[size:]


def chunk_files(files: DataFrame, id_col: str, data_col: str, least: int = MIN_BLOCK, most: int = MAX_BLOCK, carry: tuple[str, ...] = ()) -> DataFrame:
    """(file, carried columns, ordinal, offset, length, block): the chunks of each row's text or bytes; null or empty has none."""
    ship(files.sparkSession)
    keep = [id_col, *carry]
    schema = T.StructType(
        [
            *[files.schema[c] for c in keep], T.StructField("ordinal", T.IntegerType()), T.StructField("offset", T.LongType()),
            T.StructField("length", T.LongType()), T.StructField("block", T.StringType()),
        ]
    )

    def run(batches):
        for batch in batches:
            rows, ordinal, offset, length, block = [], [], [], [], []
            for k, data in enumerate(batch.column("_data")):
                data, a = data.as_py() or b"", 0
                for n, b in enumerate(cut_points(data, least, most)):
                    piece = data[a:b]
                    rows.append(k)
                    ordinal.append(n)
                    offset.append(a)
                    length.append(b - a)
                    head = (0).to_bytes(4, "big") + len(piece).to_bytes(4, "big")
                    block.append(hashlib.md5(head + piece).hexdigest())
                    a = b
            yield pa.RecordBatch.from_arrays(
                [
                    *[batch.column(c).take(pa.array(rows, pa.int64())) for c in keep], pa.array(ordinal, pa.int32()), pa.array(offset, pa.int64()),
                    pa.array(length, pa.int64()), pa.array(block, pa.string()),
                ],
                names=schema.names,
            )

    return files.select(*[files[c] for c in keep], files[data_col].cast("binary").alias("_data")).mapInArrow(run, schema)
