"""Binary layouts of the store's files: big-endian integers, counted arrays, length-prefixed strings.

Readers take a seekable file object and yield tuples; they hold one record at a time.  Writers are
their inverses.  Ids are lower-case hex in rows and 16 raw bytes in files.
"""

from __future__ import annotations

import io
import struct
import zlib
from collections.abc import Iterator
from typing import BinaryIO

# File types, markers, record types and flags of the formats.
INDEX_TYPE, META_TYPE, DATA_TYPE = 0x48534958, 0x48534D44, 0x48534442
LOG_TYPE, CACHE_TYPE = 0x48415458, 0x48414442
VERSION = 1
BLOCK_MARK, GAP_MARK = b"hblk", b"Cgap"
ADD, DEL = 0x2B414444, 0x2D44454C
DIR_MARK, CHAIN_MARK, ENTRY_MARK = 0x64626C6B, 0x6663686E, 0x66656E74
EXISTS, NO_LINKS, MARKED, INVALID = 1, 2, 4, 8
HEADER, SLOT = 16, 24
ZLIB, RAW = 0x01, 0xFF
OFFSET_BITS = 34


class Truncated(EOFError):
    """The file ends inside a record."""


def _take(f: BinaryIO, n: int) -> bytes:
    data = f.read(n)
    if len(data) < n:
        raise Truncated(f"{n} bytes wanted, {len(data)} left")
    return data


def _unpack(f: BinaryIO, layout: str) -> tuple:
    return struct.unpack(">" + layout, _take(f, struct.calcsize(">" + layout)))


def _text(f: BinaryIO) -> str:
    (n,) = _unpack(f, "I")
    return _take(f, n).decode("utf-8", "surrogateescape").encode("utf-8", "replace").decode("utf-8")


def _string(text: str) -> bytes:
    raw = text.encode("utf-8")
    return struct.pack(">I", len(raw)) + raw


def _ids(f: BinaryIO) -> list[str]:
    (n,) = _unpack(f, "I")
    raw = _take(f, 16 * n)
    return [raw[i : i + 16].hex() for i in range(0, 16 * n, 16)]


def _pack_ids(ids: list[str]) -> bytes:
    return struct.pack(">I", len(ids)) + b"".join(map(bytes.fromhex, ids))


def _location(raw: bytes) -> tuple[int, int]:
    at = int.from_bytes(raw, "big")
    return at >> OFFSET_BITS, at & ((1 << OFFSET_BITS) - 1)


def pack_location(file: int, offset: int) -> bytes:
    if not (0 <= file < 1 << 14 and 0 <= offset < 1 << OFFSET_BITS):
        raise ValueError("location out of range")
    return (file << OFFSET_BITS | offset).to_bytes(6, "big")


def file_header(kind: int, deadspace: int = 0) -> bytes:
    return struct.pack(">IIq", kind, VERSION, deadspace)


def read_file_header(f: BinaryIO) -> tuple[int, int, int]:
    """(type, version, dead space)."""
    return _unpack(f, "IIq")


def _expect(f: BinaryIO, kind: int) -> None:
    found, version, _ = read_file_header(f)
    if found != kind or version != VERSION:
        raise ValueError(f"file type {found:08x} version {version}, expected {kind:08x} version {VERSION}")


def read_data(f: BinaryIO, file_no: int = 0, payload: bool = True) -> Iterator[tuple]:
    """(block, links, data_type, data, stored_size, file, offset, entry_size, corrupt) of a .dat file.

    Gaps are skipped.  Bytes that are no record give one row with corrupt set, up to the next marker.
    """
    _expect(f, DATA_TYPE)
    end = f.seek(0, io.SEEK_END)
    at = HEADER
    while at < end:
        f.seek(at)
        mark = f.read(4)
        if mark == GAP_MARK:
            (skip,) = _unpack(f, "q")
            at += max(skip, 12)
            continue
        if mark == BLOCK_MARK:
            try:
                block = _take(f, 16).hex()
                (n,) = _unpack(f, "I")
                if n * 16 > end - f.tell():
                    raise Truncated("links")
                raw = _take(f, 16 * n)
                kind, size = _unpack(f, "BI")
                if size > end - f.tell():
                    raise Truncated("data")
                data = _take(f, size) if payload else None
                links = [raw[i : i + 16].hex() for i in range(0, 16 * n, 16)]
                yield block, links, kind, data, size, file_no, at, 29 + 16 * n + size, False
                at += 29 + 16 * n + size
                continue
            except Truncated:
                pass
        start, at = at, _next_mark(f, at + 1, end)
        yield None, [], None, None, at - start, file_no, start, at - start, True


def _next_mark(f: BinaryIO, at: int, end: int, step: int = 1 << 20) -> int:
    while at < end:
        f.seek(at)
        chunk = f.read(step + 3)
        found = [i for i in (chunk.find(BLOCK_MARK), chunk.find(GAP_MARK)) if i >= 0]
        if found:
            return at + min(found)
        at += step
    return end


def pack_data(block: str, links: list[str], kind: int, data: bytes) -> bytes:
    return BLOCK_MARK + bytes.fromhex(block) + _pack_ids(links) + struct.pack(">BI", kind, len(data)) + data


def pack_gap(size: int) -> bytes:
    return GAP_MARK + struct.pack(">q", size)


def read_meta(f: BinaryIO, file_no: int = 0) -> Iterator[tuple]:
    """(block, dat_file, dat_offset, data_size, links, meta_file, meta_offset) of a .meta file; a torn end is the end."""
    _expect(f, META_TYPE)
    at = HEADER
    while True:
        try:
            mark = _take(f, 4)
            if mark != BLOCK_MARK:
                raise ValueError(f"marker {mark!r} at {at}")
            block = _take(f, 16).hex()
            file, offset = _location(_take(f, 6))
            (size,) = _unpack(f, "I")
            links = _ids(f)
        except Truncated:
            return
        yield block, file, offset, size, links, file_no, at
        at += 34 + 16 * len(links)


def pack_meta(block: str, file: int, offset: int, size: int, links: list[str]) -> bytes:
    return BLOCK_MARK + bytes.fromhex(block) + pack_location(file, offset) + struct.pack(">I", size) + _pack_ids(links)


def read_index(f: BinaryIO, file_no: int = 0) -> Iterator[tuple]:
    """(flags, block, meta_file, meta_offset, ix_file, ix_offset) of the used slots of an .idx file."""
    _expect(f, INDEX_TYPE)
    at = HEADER
    while True:
        chunk = f.read(SLOT * 4096)
        for i in range(0, len(chunk) - SLOT + 1, SLOT):
            (flags,) = struct.unpack_from(">H", chunk, i)
            if flags & EXISTS:
                file, offset = _location(chunk[i + 18 : i + 24])
                yield flags, chunk[i + 2 : i + 18].hex(), file, offset, file_no, at + i
        if len(chunk) < SLOT * 4096:
            return
        at += len(chunk)


def pack_index(flags: int, block: str, file: int, offset: int) -> bytes:
    return struct.pack(">H", flags) + bytes.fromhex(block) + pack_location(file, offset)


def read_name_header(f: BinaryIO, kind: int) -> str:
    """The dataset's name from the header of a log or cache file."""
    found, version = _unpack(f, "II")
    if found != kind or version != VERSION:
        raise ValueError(f"file type {found:08x} version {version}, expected {kind:08x} version {VERSION}")
    return _text(f)


def name_header(kind: int, name: str) -> bytes:
    return struct.pack(">II", kind, VERSION) + _string(name)


def read_log(f: BinaryIO, start: int = 0, seq: int = 0) -> Iterator[tuple]:
    """(dataset, seq, pos, end_pos, ts_ns, op, state, block, size, unique_size) from a byte position on.

    A last record that is not complete is left for later, without an error.
    """
    dataset = read_name_header(f, LOG_TYPE)
    if start:
        f.seek(start)
    while True:
        pos = f.tell()
        try:
            ts, kind = _unpack(f, "qI")
            state = _take(f, 16).hex()
            if kind == ADD:
                row = ("ADD", state, _take(f, 16).hex(), *_unpack(f, "qq"))
            elif kind == DEL:
                row = ("DEL", state, None, None, None)
            else:
                raise ValueError(f"transaction type {kind:08x} at {pos}")
        except Truncated:
            return
        yield dataset, seq, pos, f.tell(), ts, *row
        seq += 1


#: Bytes of a whole transaction record by its type.
_TX_SIZE = {ADD: 60, DEL: 28}


def log_end(f: BinaryIO, start: int = 0, seq: int = 0, most: int | None = None) -> tuple[int, int]:
    """(byte position, number) behind the last whole record, or behind ``most`` records from start on.

    Only types are looked at and no record is kept, so that long logs cost the planner little.
    """
    read_name_header(f, LOG_TYPE)
    at, size = start or f.tell(), f.seek(0, io.SEEK_END)
    chunk, base = b"", at
    while at + 12 <= size and (most is None or most > 0):
        if at + 12 > base + len(chunk):
            f.seek(at)
            chunk, base = f.read(1 << 20), at
        (kind,) = struct.unpack_from(">I", chunk, at - base + 8)
        if kind not in _TX_SIZE:
            raise ValueError(f"transaction type {kind:08x} at {at}")
        if at + _TX_SIZE[kind] > size:
            break
        at, seq = at + _TX_SIZE[kind], seq + 1
        most = None if most is None else most - 1
    return at, seq


def pack_tx(ts: int, op: str, state: str, block: str | None = None, size: int | None = None, unique: int | None = None) -> bytes:
    if op == "DEL":
        return struct.pack(">qI", ts, DEL) + bytes.fromhex(state)
    return struct.pack(">qI", ts, ADD) + bytes.fromhex(state) + bytes.fromhex(block) + struct.pack(">qq", size, unique)


def read_cache(f: BinaryIO) -> Iterator[tuple]:
    """(dataset, flags, state, block, size, unique_size) of a .db file."""
    dataset = read_name_header(f, CACHE_TYPE)
    (n,) = _unpack(f, "I")
    for _ in range(n):
        (flags,) = _unpack(f, "B")
        yield dataset, flags, _take(f, 16).hex(), _take(f, 16).hex(), *_unpack(f, "qq")


def pack_state(flags: int, state: str, block: str, size: int, unique: int) -> bytes:
    return struct.pack(">B", flags) + bytes.fromhex(state) + bytes.fromhex(block) + struct.pack(">qq", size, unique)


def pack_cache(dataset: str, states: list[tuple]) -> bytes:
    return name_header(CACHE_TYPE, dataset) + struct.pack(">I", len(states)) + b"".join(pack_state(*s) for s in states)


def read_account(f: BinaryIO) -> Iterator[tuple]:
    """(account, access_key, dataset, size, list_h): a row for each dataset, or one without."""
    name, key = _text(f), _take(f, 16).hex()
    (n,) = _unpack(f, "I")
    for _ in range(n):
        dataset = _text(f)
        (size,) = _unpack(f, "q")
        yield name, key, dataset, size, _take(f, 16).hex()
    if not n:
        yield name, key, None, None, None


def pack_account(name: str, key: str, datasets: list[tuple[str, int, str]]) -> bytes:
    out = _string(name) + bytes.fromhex(key) + struct.pack(">I", len(datasets))
    return out + b"".join(_string(d) + struct.pack(">q", size) + bytes.fromhex(h) for d, size, h in datasets)


def read_directory(data: bytes) -> list[dict]:
    """Entries of a directory block's data."""
    f = io.BytesIO(data)
    mark, n = _unpack(f, "II")
    if mark != DIR_MARK:
        raise ValueError("not a directory block")
    return [_entry(f) for _ in range(n)]


def _entry(f: BinaryIO) -> dict:
    (mark,) = _unpack(f, "I")
    if mark != ENTRY_MARK:
        raise ValueError("not a file entry")
    name = _text(f)
    size, mode, mtime = _unpack(f, "qIq")
    reference = _take(f, 16).hex()
    (kind,) = _unpack(f, "B")
    content = _take(f, 16).hex() if kind in (1, 2, 3) else None
    key = _take(f, 16).hex() if kind == 2 else None
    target = _text(f) if kind == 4 else None
    return {
        "name": name, "size": size, "mode": mode, "mtime_ns": mtime, "reference_id": reference, "content_type": kind,
        "content": content, "decrypt_key": key, "target": target,
    }


def pack_directory(entries: list[dict]) -> bytes:
    out = struct.pack(">II", DIR_MARK, len(entries))
    for e in entries:
        kind = e["content_type"]
        out += struct.pack(">I", ENTRY_MARK) + _string(e["name"]) + struct.pack(">qIq", e["size"], e["mode"], e["mtime_ns"])
        out += bytes.fromhex(e["reference_id"]) + struct.pack(">B", kind)
        out += bytes.fromhex(e["content"]) if kind in (1, 2, 3) else b""
        out += bytes.fromhex(e["decrypt_key"]) if kind == 2 else b""
        out += _string(e["target"]) if kind == 4 else b""
    return out


def read_chain(data: bytes) -> list[tuple[str, str]]:
    """(block, key) of a chain block's data, in order."""
    f = io.BytesIO(data)
    mark, n = _unpack(f, "II")
    if mark != CHAIN_MARK:
        raise ValueError("not a chain block")
    return [(_take(f, 16).hex(), _take(f, 16).hex()) for _ in range(n)]


def pack_chain(links: list[tuple[str, str]]) -> bytes:
    return struct.pack(">II", CHAIN_MARK, len(links)) + b"".join(bytes.fromhex(b) + bytes.fromhex(k) for b, k in links)


def inflate(kind: int, data: bytes) -> bytes:
    if kind == RAW:
        return data
    if kind != ZLIB:
        raise ValueError(f"unknown data type {kind}")
    return zlib.decompress(data)
