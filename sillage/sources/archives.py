"""ZIP deliveries, nested ones included.

``read_zip_tree`` takes an archive as one value, through whatever file system Spark knows. ``read_zip_members`` is a
data source that plans by member: only the directory at an archive's end is read to plan, and each task reads the
bytes of its members, so that neither the size of an archive nor the number of archives bounds it.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Iterable, Iterator, Sequence
from concurrent.futures import ThreadPoolExecutor

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_CHUNK = 10_000
_CHUNK_BYTES = 4 << 20
_BLOCK = 1 << 20
# what a damaged archive raises; a store that fails raises OSError, which fails the task
_DAMAGED = (zipfile.BadZipFile, NotImplementedError, RuntimeError, zlib.error, EOFError, ValueError)
LINES = "archive string, membre string, numero bigint, ligne binary, rejet string"


def _check(archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> None:
    """Reads a member to its end, where its checksum is compared."""
    with archive.open(info) as member:
        while member.read(_BLOCK):
            pass


def _is_read(info: zipfile.ZipInfo) -> bool:
    return not info.is_dir() and info.filename.lower().endswith((".zip", ".csv"))


def _member_lines(name: str, archive: zipfile.ZipFile, info: zipfile.ZipInfo) -> Iterator[tuple]:
    """Lines of a member, or of the members of a nested archive; one row that says so where it cannot be read.

    A member is read through before its first line counts, so a damaged one leaves no lines.
    """
    nested = info.filename.lower().endswith(".zip")
    try:
        inner = archive.read(info) if nested else _check(archive, info)
    except _DAMAGED:
        yield name, info.filename, None, None, "membre"
        return
    if nested:
        yield from _lines(f"{name}/{info.filename}", inner)
        return
    with archive.open(info) as member:
        for number, line in enumerate(member):
            yield name, info.filename, number, line.rstrip(b"\r\n"), None


def _lines(name: str, blob: bytes) -> Iterator[tuple]:
    """Lines of the CSV members of an archive; one row that says so for each part that cannot be read."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(blob))
    except _DAMAGED:
        yield name, None, None, None, "archive"
        return
    with archive:
        for info in filter(_is_read, archive.infolist()):
            yield from _member_lines(name, archive, info)


def _batched(rows: Iterable[tuple]) -> Iterator[pa.RecordBatch]:
    """Rows of ``LINES`` in batches of ``_CHUNK`` rows or ``_CHUNK_BYTES`` and one line more at most."""
    kinds = [pa.string(), pa.string(), pa.int64(), pa.binary(), pa.string()]
    names = [c.split()[0] for c in LINES.split(", ")]

    def batch() -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*kept), kinds)], names)

    kept: list[tuple] = []
    room = _CHUNK_BYTES
    for row in rows:
        kept.append(row)
        room -= len(row[3] or b"")
        if len(kept) == _CHUNK or room <= 0:
            yield batch()
            kept, room = [], _CHUNK_BYTES
    if kept:
        yield batch()


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    return _batched(
        row for batch in batches for path, content in zip(batch.column("path"), batch.column("content"))
        for row in _lines(path.as_py(), content.as_buffer() or b"")
    )


def expand_archives(archives: DataFrame) -> DataFrame:
    """(path, content) to (archive, membre, numero, ligne, rejet); lines leave in small batches.

    ``rejet`` is null for a line, ``archive`` or ``membre`` for what was skipped. An archive
    is one row, so one task reads it whole, up to Spark's 2 GB for a value.
    """
    return archives.select("path", "content").mapInArrow(_expand, LINES)


def read_zip_tree(spark: SparkSession, path: str) -> DataFrame:
    """Every line of every CSV in the archives below a folder; archives are spread over tasks."""
    return expand_archives(
        spark.read.format("binaryFile").option("pathGlobFilter", "*.zip").option("recursiveFileLookup", "true").load(path)
    )


#: members are packed up to so many compressed bytes; a larger member is a pack of its own
PACK_BYTES = 32 << 20
#: packs have a task each, up to so many tasks for each core of the cluster; more packs share tasks
_TASKS_PER_CORE = 32
_TASKS = 1000
# bytes that opening a pack counts for when packs are dealt
_PACK_COST = 4096
_LISTING_THREADS = 32


def open_store(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a location, by its scheme; a path without one is a mounted folder."""
    return fs.FileSystem.from_uri(re.sub(r"^file:/*", "/", uri))


def _opened(store: fs.FileSystem, archive: str) -> io.BufferedReader:
    """An archive for ranged reads of a block or more."""
    return io.BufferedReader(store.open_input_file(archive), _BLOCK)


def _archives_below(store: fs.FileSystem, path: str) -> list[str]:
    if store.get_file_info(path).type == fs.FileType.File:
        return [path]
    found = store.get_file_info(fs.FileSelector(path, recursive=True))
    return sorted(f.path for f in found if f.type == fs.FileType.File and f.path.lower().endswith(".zip"))


class _Members(InputPartition):
    """Members of archives, by their places in the directory; no list where a directory cannot be read."""

    def __init__(self, parts: list[tuple[str, list[int] | None]]):
        self.parts = parts


class _MemberReader(DataSourceReader):
    def __init__(self, path: str, pack: int, tasks: int):
        self.path, self.pack, self.tasks = path, pack, tasks

    def _packs(self, store: fs.FileSystem, archive: str) -> list[tuple[str, list[int] | None, int]]:
        """Archive, places and compressed bytes of each pack."""
        with _opened(store, archive) as source:
            try:
                wanted = [(i, info.compress_size) for i, info in enumerate(zipfile.ZipFile(source).infolist()) if _is_read(info)]
            except _DAMAGED:
                return [(archive, None, 0)]
        packs: list[list[int]] = []
        sizes: list[int] = []
        for place, size in wanted:
            if not packs or sizes[-1] + size > self.pack:
                packs.append([])
                sizes.append(0)
            packs[-1].append(place)
            sizes[-1] += size
        return [(archive, places, size) for places, size in zip(packs, sizes)]

    def partitions(self) -> Sequence[InputPartition]:
        store, path = open_store(self.path)
        with ThreadPoolExecutor(_LISTING_THREADS) as pool:
            packs = [p for found in pool.map(lambda archive: self._packs(store, archive), _archives_below(store, path)) for p in found]
        if len(packs) <= self.tasks:
            # an empty plan is a plan of one task without work
            return [_Members([(archive, places)]) for archive, places, _ in packs] or [_Members([])]
        # more packs than tasks: packs that follow each other share a task, by running size
        share, before = (sum(size + _PACK_COST for *_, size in packs) + 1) / self.tasks, 0
        dealt: dict[int, list[tuple[str, list[int] | None]]] = {}
        for archive, places, size in packs:
            parts = dealt.setdefault(int(before // share), [])
            if parts and places and parts[-1][0] == archive:
                parts[-1][1].extend(places)
            else:
                parts.append((archive, places))
            before += size + _PACK_COST
        return [_Members(parts) for parts in dealt.values()]

    def _rows(self, partition: _Members) -> Iterator[tuple]:
        store, _ = open_store(self.path)
        for name, places in partition.parts:
            if places is None:
                yield name, None, None, None, "archive"
                continue
            with _opened(store, name) as source, zipfile.ZipFile(source) as archive:
                infos = archive.infolist()
                for place in places:
                    yield from _member_lines(name, archive, infos[place])

    def read(self, partition: _Members) -> Iterator[pa.RecordBatch]:
        return _batched(self._rows(partition))


class ZipMembers(DataSource):
    """``spark.read.format("zip_members").load(folder)``; options ``packBytes`` as ``PACK_BYTES`` and ``tasks``, the most there are."""

    @classmethod
    def name(cls) -> str:
        return "zip_members"

    def schema(self) -> str:
        return LINES

    def reader(self, schema) -> DataSourceReader:
        return _MemberReader(self.options["path"], int(self.options.get("packBytes", PACK_BYTES)), int(self.options.get("tasks", _TASKS)))


def read_zip_members(spark: SparkSession, path: str, pack_bytes: int = PACK_BYTES) -> DataFrame:
    """Every line of every CSV in the archives below a folder, as ``expand_archives`` gives them, planned by member.

    The location must be one that pyarrow opens (a mounted folder, S3, GCS, HDFS). A nested archive is one member, a
    member that is a CSV is read by one task, as its compression has no entry but its start. Archives that cannot be
    opened and damaged members are one row each, with their ``rejet``.
    """
    spark.dataSource.register(ZipMembers)
    tasks = spark.sparkContext.defaultParallelism * _TASKS_PER_CORE
    return spark.read.format("zip_members").option("packBytes", pack_bytes).option("tasks", tasks).load(path)
