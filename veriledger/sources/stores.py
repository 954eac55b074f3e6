"""Data sources: gzip members under their own digest, and stamped text tables whose parts are verified when read.

``gzip_store`` holds one file for each object, ``<first digits>/<sha256>.gz``.  Writing computes the digest, skips what is
there and renames a finished file into place, so repeats, retries and lost tasks leave whole members or none.
Reading plans about ``tasks`` tasks: folders are grouped, or split into shares by name where there are fewer of them (also a
store without folders); the driver lists folders, tasks list files.  Very large stores take more ``fanout`` digits.  ``status`` is ``ok``, ``corrupt`` (null body) or ``mismatch`` (the bytes are not those of the name).

``stamped_table`` holds lines in the order of the written partitions.  Parts are invisible until the commit puts a manifest
(stamp, fingerprint, parts with counts and digests) in place by one rename; then parts of the table before are deleted.
Reading lines fails on a part that is missing or altered; the view ``parts`` says which one it is.
"""

from __future__ import annotations

import gzip
import hashlib
import io
import json
import sys
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark import TaskContext, cloudpickle
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

# readers and writers travel with the job, executors need not have the package
cloudpickle.register_pickle_by_value(sys.modules[__name__])

FANOUT, TASKS = 2, 32
BATCH_BYTES, BATCH_ROWS = 16 << 20, 1000


def register(spark: SparkSession) -> SparkSession:
    for source in (GzipStore, StampedTable):
        spark.dataSource.register(source)
    return spark


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    if path.startswith("file:") and not path.startswith("file://"):
        path = path[len("file:"):]
    return arrow_fs.FileSystem.from_uri(path)


def _put(store: arrow_fs.FileSystem, path: str, data: bytes) -> None:
    """``data`` at ``path``, whole or not at all."""
    aside = f"{path}.{uuid.uuid4().hex}.tmp"
    with store.open_output_stream(aside) as out:
        out.write(data)
    store.move(aside, path)


def _listing(store: arrow_fs.FileSystem, folder: str) -> list[arrow_fs.FileInfo]:
    return store.get_file_info(arrow_fs.FileSelector(folder, allow_not_found=True))


class GzipStore(DataSource):
    @classmethod
    def name(cls) -> str:
        return "gzip_store"

    def schema(self) -> str:
        return "sha256 string, body binary, status string"

    def reader(self, schema) -> DataSourceReader:
        return GzipReader(self.options["path"], int(self.options.get("tasks", TASKS)))

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if overwrite:
            raise ValueError("a store is appended to, its members never change")
        return GzipWriter(self.options["path"], schema.fieldNames().index("body"), int(self.options.get("fanout", FANOUT)))


class GzipReader(DataSourceReader):
    def __init__(self, path: str, tasks: int):
        self.path, self.tasks = path, tasks

    def partitions(self) -> list[InputPartition]:
        store, root = _open(self.path)
        found = _listing(store, root)
        folders = sorted(x.path for x in found if x.type == arrow_fs.FileType.Directory)
        if any(x.type == arrow_fs.FileType.File for x in found) or not folders:
            folders.append(root)
        groups = [folders[k :: self.tasks] for k in range(min(self.tasks, len(folders)))]
        shares = -(-self.tasks // len(groups))
        return [InputPartition((group, k, shares)) for group in groups for k in range(shares)]

    def read(self, partition: InputPartition) -> Iterator[pa.RecordBatch]:
        folders, share, of = partition.value
        store, _ = _open(self.path)
        rows, size = [], 0
        for info in (info for folder in folders for info in _listing(store, folder)):
            name = info.base_name
            if info.type != arrow_fs.FileType.File or not name.endswith(".gz") or zlib.crc32(name.encode()) % of != share:
                continue
            with store.open_input_stream(info.path, compression=None) as stream:
                raw = stream.read()
            try:
                body, status = gzip.decompress(raw), "ok"
            except (OSError, EOFError, zlib.error):
                body, status = None, "corrupt"
            digest = name[: -len(".gz")]
            if body is not None and hashlib.sha256(body).hexdigest() != digest:
                status = "mismatch"
            rows.append((digest, body, status))
            size += len(body or b"")
            if size >= BATCH_BYTES or len(rows) >= BATCH_ROWS:
                yield self._batch(rows)
                rows, size = [], 0
        if rows:
            yield self._batch(rows)

    def _batch(self, rows: list[tuple]) -> pa.RecordBatch:
        digest, body, status = zip(*rows)
        return pa.RecordBatch.from_arrays(
            [pa.array(digest, pa.string()), pa.array(body, pa.binary()), pa.array(status, pa.string())], names=["sha256", "body", "status"])


class GzipWriter(DataSourceArrowWriter):
    def __init__(self, path: str, column: int, fanout: int):
        self.path, self.column, self.fanout = path, column, fanout

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        store, root = _open(self.path)
        made = set()
        for batch in iterator:
            for value in batch.column(self.column):
                if not value.is_valid:
                    continue
                body = value.as_py()
                digest = hashlib.sha256(body).hexdigest()
                folder = f"{root}/{digest[:self.fanout]}"
                if folder not in made:
                    store.create_dir(folder, recursive=True)
                    made.add(folder)
                path = f"{folder}/{digest}.gz"
                if store.get_file_info(path).type == arrow_fs.FileType.NotFound:
                    _put(store, path, gzip.compress(body, 6, mtime=0))
        return WriterCommitMessage()


@dataclass
class Part(WriterCommitMessage):
    at: int
    name: str
    n: int
    sha256: str


class StampedTable(DataSource):
    @classmethod
    def name(cls) -> str:
        return "stamped_table"

    def schema(self) -> str:
        if self.options.get("view") == "parts":
            return "part int, stamp string, fingerprint string, n long, sha256 string, status string"
        return "part int, pos long, line string"

    def reader(self, schema) -> DataSourceReader:
        return StampedReader(self.options["path"], self.options.get("view") == "parts")

    def writer(self, schema, overwrite: bool) -> DataSourceArrowWriter:
        if not overwrite:
            raise ValueError("a stamped table is replaced as a whole")
        names = schema.fieldNames()
        return StampedWriter(self.options["path"], names.index("line"), self.options.get("stamp"), self.options.get("fingerprint"))


class StampedReader(DataSourceReader):
    def __init__(self, path: str, report: bool):
        self.path, self.report = path, report

    def partitions(self) -> list[InputPartition]:
        store, root = _open(self.path)
        with store.open_input_stream(f"{root}/manifest.json") as stream:
            manifest = json.loads(stream.read())
        return [InputPartition((i, part, manifest["stamp"], manifest["fingerprint"])) for i, part in enumerate(manifest["parts"])] or [InputPartition(None)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition.value is None:
            return
        at, part, stamp, fingerprint = partition.value
        store, root = _open(self.path)
        path, seen, n, status = f"{root}/data/{part['name']}", hashlib.sha256(), 0, "ok"
        if store.get_file_info(path).type == arrow_fs.FileType.NotFound:
            status = "missing"
        else:
            with io.BufferedReader(store.open_input_stream(path, compression=None), 1 << 20) as stream:
                for line in stream:
                    seen.update(line)
                    if not self.report:
                        yield at, n, line.removesuffix(b"\n").decode("utf-8", "replace")
                    n += 1
            if seen.hexdigest() != part["sha256"]:
                status = "altered"
        if self.report:
            yield at, stamp, fingerprint, part["n"], part["sha256"], status
        elif status != "ok":
            raise ValueError(f"part {at} of {self.path} is {status}")


class StampedWriter(DataSourceArrowWriter):
    def __init__(self, path: str, column: int, stamp: str | None, fingerprint: str | None):
        self.path, self.column, self.stamp, self.fingerprint = path, column, stamp, fingerprint

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Part:
        store, root = _open(self.path)
        store.create_dir(f"{root}/data", recursive=True)
        at, n, seen = TaskContext.get().partitionId(), 0, hashlib.sha256()
        name = f"part-{at:06d}-{uuid.uuid4().hex}.txt"
        with store.open_output_stream(f"{root}/data/{name}") as out:
            for batch in iterator:
                for line in batch.column(self.column).to_pylist():
                    if line is not None and "\n" in line:
                        raise ValueError("a line of a table holds a line feed")
                    data = f"{line or ''}\n".encode("utf-8")
                    seen.update(data)
                    out.write(data)
                    n += 1
        return Part(at, name, n, seen.hexdigest())

    def commit(self, messages: list[Part | None]) -> None:
        store, root = _open(self.path)
        parts = [p for p in sorted((m for m in messages if m is not None), key=lambda m: m.at) if p.n]
        store.create_dir(f"{root}/data", recursive=True)
        _put(store, f"{root}/manifest.json", json.dumps({
            "stamp": self.stamp, "fingerprint": self.fingerprint, "parts": [{"name": p.name, "n": p.n, "sha256": p.sha256} for p in parts],
        }).encode())
        kept = {p.name for p in parts}
        for info in _listing(store, f"{root}/data"):
            if info.base_name not in kept:
                store.delete_file(info.path)

    def abort(self, messages: list[Part | None]) -> None:
        store, root = _open(self.path)
        for part in messages:
            if part is not None:
                store.delete_file(f"{root}/data/{part.name}")
