"""Spark data sources over the store's files: format("quarry_store") with option ``kind``.

kind is data, headers, meta, index, log, cache, accounts or tree.  The path is a folder (or one file)
that every executor mounts.  Each file is one partition and is read record by record.  For data,
option ``payload`` = false leaves the payload in the file, and options ``from`` and ``to`` bound the file
numbers, so that other files are never opened.  For log, option ``dataset`` opens only matching names.
The log kind is also a stream, whose offset is a byte position for each file (see ``LogStream``).
"""

from __future__ import annotations

import base64
import glob
import hashlib
import json
import os
import stat
import sys

from pyspark import cloudpickle
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from quarry.sources import formats

SCHEMAS = {
    "data": "block string, links array<string>, data_type int, data binary, stored_size long, file int, offset long, entry_size long, corrupt boolean",
    "headers": "path string, file int, file_type long, expected_type long, version long, deadspace long, file_size long",
    "meta": "block string, file int, offset long, size long, links array<string>, meta_file int, meta_offset long",
    "index": "flags int, block string, meta_file int, meta_offset long, ix_file int, ix_offset long",
    "log": "account_h string, dataset string, seq long, pos long, end_pos long, ts_ns long, op string, state string, block string, size long, unique_size long",
    "cache": "account_h string, dataset string, flags int, state string, block string, size long, unique_size long",
    "accounts": "account string, account_h string, access_key string, dataset string, size long, list_h string",
    "tree": "path string, name string, kind string, size long, mode int, mtime_ns long, blocks long, target string",
}
_SUFFIX = {"data": ["*.dat"], "headers": ["*.dat", "*.meta", "*.idx"], "meta": ["*.meta"], "index": ["*.idx"], "log": ["*.trn"], "cache": ["*.db"], "accounts": ["*.info"]}
_KINDS = {".dat": formats.DATA_TYPE, ".meta": formats.META_TYPE, ".idx": formats.INDEX_TYPE}


def _number(path: str) -> int:
    try:
        return int(os.path.basename(path).split(".")[0], 16)
    except ValueError:
        return 0


def _name_hash(path: str, part: int) -> str | None:
    """The 16-byte hash that a part of a file's name holds in base64url, as hex; null if it is none."""
    parts = os.path.basename(path).split(".")
    try:
        raw = base64.urlsafe_b64decode(parts[part] + "==")
    except (ValueError, IndexError):
        return None
    return raw.hex() if len(raw) == 16 else None


#: Mode bits that say that an entry is no plain file.
_SPECIAL = ((stat.S_ISBLK, 1 << 26), (stat.S_ISCHR, 1 << 26), (stat.S_ISFIFO, 1 << 25), (stat.S_ISSOCK, 1 << 24))


def entry_mode(mode: int) -> int:
    """Permissions, and for devices, pipes and sockets the bit that ``snapshot.storable`` looks at."""
    return stat.S_IMODE(mode) | sum({bit for test, bit in _SPECIAL if test(mode)})


def list_files(path: str, kind: str) -> list[str]:
    if os.path.isfile(path):
        return [path]
    return sorted(f for pattern in _SUFFIX[kind] for f in glob.glob(os.path.join(path, "**", pattern), recursive=True))


class FilePart(InputPartition):
    def __init__(self, path: str):
        self.path = path


class StoreReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = dict(options)
        self.kind = self.options.get("kind", "data")

    def partitions(self):
        path = self.options["path"]
        if self.kind == "tree":
            top = sorted(os.listdir(path)) if os.path.isdir(path) else []
            return [FilePart(p) for p in top] or [FilePart("")]
        low, high = int(self.options.get("from", 0)), int(self.options.get("to", 1 << 31))
        found = [p for p in list_files(path, self.kind) if self.kind in ("log", "cache", "accounts") or low <= _number(p) <= high]
        wanted = self.options.get("dataset")
        if wanted and self.kind in ("log", "cache"):
            digest = hashlib.md5(wanted.encode("utf-8")).hexdigest()
            found = [p for p in found if _name_hash(p, 1) in (None, digest)]
        return [FilePart(p) for p in found] or [FilePart("")]

    def read(self, part):
        if self.kind == "tree":
            yield from self._tree(part.path)
            return
        if not part.path:
            return
        with open(part.path, "rb") as f:
            yield from self._rows(f, part.path)

    def _rows(self, f, path):
        kind, no = self.kind, _number(path)
        if kind == "data":
            yield from formats.read_data(f, no, self.options.get("payload", "true") != "false")
        elif kind == "headers":
            found, version, dead = formats.read_file_header(f)
            yield path, no, found, _KINDS[os.path.splitext(path)[1]], version, dead, os.path.getsize(path)
        elif kind == "meta":
            yield from formats.read_meta(f, no)
        elif kind == "index":
            yield from formats.read_index(f, no)
        elif kind == "log":
            for row in formats.read_log(f):
                yield _name_hash(path, 0), *row
        elif kind == "cache":
            for row in formats.read_cache(f):
                yield _name_hash(path, 0), *row
        elif kind == "accounts":
            for name, *row in formats.read_account(f):
                yield name, hashlib.md5(name.encode("utf-8")).hexdigest(), *row

    def _tree(self, top: str):
        """Entries below a folder; one partition for each of its direct entries."""
        base = self.options["path"]

        def entry(path):
            s = os.lstat(path)
            kind = "link" if stat.S_ISLNK(s.st_mode) else "dir" if stat.S_ISDIR(s.st_mode) else "file" if stat.S_ISREG(s.st_mode) else "special"
            target = os.readlink(path) if kind == "link" else None
            return os.path.relpath(path, base), os.path.basename(path), kind, s.st_size if kind == "file" else 0, entry_mode(s.st_mode), s.st_mtime_ns, s.st_blocks, target

        if not top:
            return
        start = os.path.join(base, top)
        yield entry(start)
        if os.path.isdir(start) and not os.path.islink(start):
            for folder, dirs, files in os.walk(start):
                for name in sorted(dirs + files):
                    yield entry(os.path.join(folder, name))


class LogPart(InputPartition):
    """The records of one log between two positions."""

    def __init__(self, path: str, start: list[int], end: list[int]):
        self.path, self.start, self.end = path, start, end


class LogStream(DataSourceStreamReader):
    """Transaction logs as a stream; an offset is the position (byte, record) in each file.

    The planner finds positions by reading record types only; each log with new records is a partition, read
    by an executor up to its end position and no further, so a batch that is run again after a failure
    has the same rows.  A torn end waits for the rest of it.  With option ``maxRecordsPerBatch`` a batch has at most
    so many records, shared out among the logs that have new ones, and no log waits for ever.  As Spark
    does not tell a restarted source where it stood, the limit needs option ``positions``, a file beside the
    checkpoint in which the source keeps its last offset; one batch after a restart may be up to twice as large.
    """

    def __init__(self, options: dict):
        self.options = dict(options)
        self.most = int(self.options["maxRecordsPerBatch"]) if "maxRecordsPerBatch" in self.options else None
        self.positions = self.options.get("positions")
        if self.most is not None and (self.most < 1 or not self.positions):
            raise ValueError("maxRecordsPerBatch must be positive and needs the option positions")
        self.at: dict[str, list[int]] = json.loads(self.options.get("startingOffset", "{}"))
        if self.positions and os.path.exists(self.positions):
            with open(self.positions) as f:
                self.at = json.load(f)
        self.turn = 0

    def initialOffset(self):
        return {"at": self.options.get("startingOffset", "{}")}

    def latestOffset(self):
        grown = [p for p in list_files(self.options["path"], "log") if os.path.getsize(p) > self.at.get(p, [0, 0])[0]]
        if self.most is not None and grown:
            self.turn = (self.turn + 1) % len(grown)
            grown = grown[self.turn :] + grown[: self.turn]
        left = self.most
        for k, path in enumerate(grown):
            share = None if left is None else -(-left // (len(grown) - k))
            pos, seq = self.at.get(path, [0, 0])
            with open(path, "rb") as f:
                end, count = formats.log_end(f, pos, seq, share)
            if count > seq:
                self.at[path] = [end, count]
                left = None if left is None else left - (count - seq)
            if left == 0:
                break
        if self.positions:
            with open(self.positions + ".new", "w") as f:
                json.dump(self.at, f)
                f.flush()
                os.fsync(f.fileno())
            os.replace(self.positions + ".new", self.positions)
        return {"at": json.dumps(self.at, sort_keys=True)}

    def partitions(self, start, end):
        begin, parts = json.loads(start["at"]), []
        for path, stop in json.loads(end["at"]).items():
            at = begin.get(path, [0, 0])
            if at[0] > stop[0]:
                raise ValueError(f"{path} was read up to {at[0]} already; a rewritten log needs a new checkpoint")
            if at[1] < stop[1]:
                parts.append(LogPart(path, at, stop))
        return parts

    def read(self, part):
        with open(part.path, "rb") as f:
            for row in formats.read_log(f, *part.start):
                if row[3] > part.end[0]:
                    return
                yield _name_hash(part.path, 0), *row


class StoreSource(DataSource):
    @classmethod
    def name(cls):
        return "quarry_store"

    def schema(self):
        return SCHEMAS[self.options.get("kind", "data")]

    def reader(self, schema):
        return StoreReader(self.options)

    def streamReader(self, schema):
        return LogStream(self.options)


def register(spark: SparkSession) -> None:
    """Make the format known; its code travels by value, so executors need no installation."""
    for name in ("quarry.sources.formats", "quarry.sources.store"):
        cloudpickle.register_pickle_by_value(sys.modules[name])
    spark.dataSource.register(StoreSource)


def read(spark: SparkSession, kind: str, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.read.format("quarry_store").option("kind", kind).options(**options).load(path)


def read_log_stream(spark: SparkSession, path: str, **options: str) -> DataFrame:
    register(spark)
    return spark.readStream.format("quarry_store").option("kind", "log").options(**options).load(path)


def write_records(rows: DataFrame, folder: str) -> None:
    """Files below a folder that all executors mount, from rows (file, ordinal, record): records in order of ordinal.

    A file is one task's, streamed after a spilling sort, and appears under its name only when it is whole,
    so that a task that is run again leaves no half of it.
    """
    os.makedirs(folder, exist_ok=True)

    def write(part) -> None:
        name, f = None, None

        def close() -> None:
            if f is not None:
                f.flush()
                os.fsync(f.fileno())
                f.close()
                os.replace(f.name, os.path.join(folder, name))

        for r in part:
            if r["file"] != name:
                close()
                name = r["file"]
                f = open(os.path.join(folder, f".{name}.{os.getpid()}"), "wb")  # noqa: SIM115
            f.write(bytes(r["record"]))
        close()

    rows.select("file", "ordinal", "record").repartition("file").sortWithinPartitions("file", "ordinal").foreachPartition(write)


def write_log(path: str, dataset: str, rows: list[tuple], append: bool = False) -> None:
    """A .trn file from (ts, op, state, block, size, unique_size); the header is written first, appends are flushed."""
    fresh = not append or not os.path.exists(path)
    with open(path, "ab" if append else "wb") as f:
        if fresh:
            f.write(formats.name_header(formats.LOG_TYPE, dataset))
        for row in rows:
            f.write(formats.pack_tx(*row))
        f.flush()
        os.fsync(f.fileno())


def dataset_of_log(path: str) -> str:
    """The dataset's name from a log's header, which must hash to what the file's name says."""
    with open(path, "rb") as f:
        name = formats.read_name_header(f, formats.LOG_TYPE)
    if _name_hash(path, 1) != hashlib.md5(name.encode("utf-8")).hexdigest():
        raise ValueError(f"{path} is not named after the dataset {name!r}")
    return name


def log_file_name(account: str, dataset: str) -> str:
    part = lambda s: base64.urlsafe_b64encode(hashlib.md5(s.encode("utf-8")).digest()).decode().rstrip("=")
    return f"{part(account)}.{part(dataset)}.trn"
