"""Zip archives (nested to any depth) and plain CSV files as a table of CSV records.

A first job lists the members of every archive from its directory; runs of members of a bounded
size, or one larger member, are the units a second job reads. Files are opened where they lie and
streamed, so neither a long archive nor a long member is ever held whole.
"""

from __future__ import annotations

import csv
import errno
import io
import math
import posixpath
import zipfile
from collections.abc import Iterable, Iterator
from contextlib import ExitStack
from itertools import chain
from typing import NamedTuple

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import written

RECORD_SCHEMA = (
    "path string, member string, record_no bigint, fields array<string>, "
    "header array<string>, lead array<string>, error string, error_class string"
)
# A unit: members (by place) of the archive reached through ``chain``, the places of archives
# stored inside archives. Without members it is a plain file.
UNIT_SCHEMA = "path string, inside string, chain array<int>, members array<int>, bytes bigint"
# Records, and characters of them, handed on at once.
BATCH_RECORDS, BATCH_BYTES = 5_000, 8 << 20
# Unpacked bytes of a unit, and of a task.
UNIT, TASK = 64 << 20, 64 << 20
READ_AHEAD = 1 << 20
# Bytes of a member that is unpacked at once, and of a file that is read at once.
SMALL, SHORT_FILE = 1 << 20, 8 << 20


def file_system(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path behind an address as Spark writes it."""
    if uri.startswith("file:/") and not uri.startswith("file://"):
        uri = "file://" + uri[len("file:") :]
    elif uri.startswith("/"):
        return fs.LocalFileSystem(), uri
    return fs.FileSystem.from_uri(uri)


class _Remote(io.RawIOBase):
    """An open file of the file system, with the errors of an ordinary one."""

    def __init__(self, source):
        self.source = source

    def readable(self) -> bool:
        return True

    def seekable(self) -> bool:
        return True

    def tell(self) -> int:
        return self.source.tell()

    def seek(self, offset: int, whence: int = 0) -> int:
        target = offset + (0, self.source.tell(), self.source.size())[whence]
        if target < 0:
            raise OSError(errno.EINVAL, "negative seek")
        return self.source.seek(target)

    def readinto(self, into) -> int:
        return self.source.readinto(into)

    def close(self) -> None:
        self.source.close()
        super().close()


def _stream(path: str) -> io.BufferedIOBase:
    """An open file; a short one is read at once, as finding the members of an archive moves about in it."""
    system, name = file_system(path)
    source = system.open_input_file(name)
    if source.size() > SHORT_FILE:
        return io.BufferedReader(_Remote(source), READ_AHEAD)
    with source:
        return io.BytesIO(source.read())


class _Block(NamedTuple):
    """Records of a file read at once: the first one's number, their fields, (place, header) where a header begins, the file's first record.

    Without rows it says what ended the reading of the file.
    """

    path: str
    member: str
    start: int | None
    rows: list[list[str]] | None
    headers: list[tuple[int, list[str] | None]]
    lead: list[str] | None
    error: str | None = None
    error_class: str | None = None


def _problem(path: str, member: str, problem: Exception) -> _Block:
    return _Block(path, member, None, None, [(0, None)], None, str(problem), type(problem).__name__)


def _records(path: str, member: str, text, short: bool = False) -> Iterator[_Block]:
    """Records of one CSV; what was read in front of an error comes before it. A ``short`` text is no longer than a batch."""
    csv.field_size_limit(2**31 - 1)
    lead, problem, start, size = None, None, 1, 0
    rows, headers = [], [(0, None)]
    try:
        for fields in csv.reader(text):
            if fields and fields[0] == "I":
                headers.append((len(rows), fields))
            rows.append(fields)
            if not short:
                size += sum(map(len, fields))
            if len(rows) == BATCH_RECORDS or size > BATCH_BYTES:
                lead = rows[0] if start == 1 else lead
                yield _Block(path, member, start, rows, headers, lead)
                start, size, rows, headers = start + len(rows), 0, [], [(0, headers[-1][1])]
    except Exception as raised:  # noqa: BLE001 - raised again below
        problem = raised
    if rows:
        yield _Block(path, member, start, rows, headers, rows[0] if start == 1 else lead)
    if problem is not None:
        raise problem


def _flat(blocks: Iterable[_Block]) -> Iterator[tuple]:
    """Blocks as records, each with the header record in force and the file's first record."""
    for block in blocks:
        if block.rows is None:
            yield (block.path, block.member, None, None, None, None, block.error, block.error_class)
            continue
        header, changes = None, dict(block.headers)
        for place, fields in enumerate(block.rows):
            header = changes.get(place, header)
            yield (block.path, block.member, block.start + place, fields, header, block.lead, None, None)


def _small(archive: zipfile.ZipFile, inner: zipfile.ZipInfo) -> bytes | None:
    """A short member at once; None if it is long or anything is wrong, which reading it as a stream tells."""
    if inner.file_size > SMALL:
        return None
    try:
        with archive.open(inner) as handle:
            return None if len(data := handle.read(SMALL + 1)) > SMALL else data
    except Exception:  # noqa: BLE001 - the stream reports it, after the records in front of it
        return None


def _short_text(archive: zipfile.ZipFile, inner: zipfile.ZipInfo) -> str | None:
    """A short CSV member as text, under the same conditions."""
    if not inner.filename.lower().endswith(".csv") or (data := _small(archive, inner)) is None:
        return None
    try:
        return data.decode("utf-8")
    except UnicodeDecodeError:
        return None


def _blocks(path: str, member: str, name: str, stream, only: list[int] | None = None) -> Iterator[_Block]:
    """Records of a file by its suffix; what goes wrong becomes a row and ends this file only."""
    try:
        if name.lower().endswith(".zip"):
            with zipfile.ZipFile(stream) as archive:
                found = archive.infolist()
                # in the order of the bytes, so that a packed archive is unpacked forwards
                for place in sorted(range(len(found)) if only is None else only, key=lambda k: found[k].header_offset):
                    inner = found[place]
                    if inner.is_dir():
                        continue
                    inside = f"{member}/{inner.filename}" if member else inner.filename
                    if (text := _short_text(archive, inner)) is not None:
                        try:
                            yield from _records(path, inside, io.StringIO(text, newline=""), short=True)
                        except Exception as problem:  # noqa: BLE001 - a bad file must not stop its siblings
                            yield _problem(path, inside, problem)
                        continue
                    try:
                        # an archive is read from its end, so a short one is unpacked first
                        if inner.filename.lower().endswith(".zip") and (data := _small(archive, inner)) is not None:
                            yield from _blocks(path, inside, inner.filename, io.BytesIO(data))
                            continue
                        with archive.open(inner) as handle:
                            yield from _blocks(path, inside, inner.filename, handle)
                    except (zipfile.BadZipFile, NotImplementedError, RuntimeError, EOFError) as problem:
                        yield _problem(path, inside, problem)
        elif name.lower().endswith(".csv"):
            yield from _records(path, member, io.TextIOWrapper(stream, encoding="utf-8", newline=""))
        else:
            yield _Block(path, member, None, None, [(0, None)], None, f"unknown kind of file: {name}", "UnknownFile")
    except Exception as problem:  # noqa: BLE001 - a bad file must not stop its siblings
        yield _problem(path, member, problem)


def _open(path: str, member: str, name: str, stream, only: list[int] | None = None) -> Iterator[tuple]:
    return _flat(_blocks(path, member, name, stream, only))


def _units(path: str, inside: str, chain: list[int], stream) -> Iterator[tuple]:
    """Runs of members of an archive; an archive stored in it unpacked is entered, a packed one is a member."""
    run, size = [], 0
    with zipfile.ZipFile(stream) as archive:
        for place, inner in enumerate(archive.infolist()):
            if inner.is_dir():
                continue
            if inner.filename.lower().endswith(".zip") and inner.compress_type == zipfile.ZIP_STORED:
                name = f"{inside}/{inner.filename}" if inside else inner.filename
                try:
                    with archive.open(inner) as handle:
                        entered = list(_units(path, name, [*chain, place], handle))
                    yield from entered
                    continue
                except Exception:  # noqa: BLE001 - the reader says what is wrong with it
                    pass
            if run and size + inner.file_size > UNIT:
                yield (path, inside, chain, run, size)
                run, size = [], 0
            run.append(place)
            size += inner.file_size
    if run:
        yield (path, inside, chain, run, size)


def _list(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    columns = [c.split()[0] for c in UNIT_SCHEMA.split(", ")]
    for batch in batches:
        for path, length in zip(batch["path"], batch["length"]):
            whole = [(path, "", [], None, int(length))]
            units = whole
            if path.lower().endswith(".zip"):
                try:
                    with _stream(path) as stream:
                        units = list(_units(path, "", [], stream))
                except Exception:  # noqa: BLE001 - the reader says what is wrong with it
                    units = whole
            yield pd.DataFrame(units, columns=columns)


def _unit_blocks(path: str, inside: str, chain: list[int], members: list[int] | None) -> Iterator[_Block]:
    try:
        with ExitStack() as opened:
            stream = opened.enter_context(_stream(path))
            for place in chain:
                outer = opened.enter_context(zipfile.ZipFile(stream))
                stream = opened.enter_context(outer.open(outer.infolist()[place]))
            yield from _blocks(path, inside, posixpath.basename(path if members is None else inside or path), stream, members)
    except Exception as problem:  # noqa: BLE001 - a bad file must not stop its siblings
        yield _problem(path, inside, problem)


def _unit_records(path: str, inside: str, chain: list[int], members: list[int] | None) -> Iterator[tuple]:
    return _flat(_unit_blocks(path, inside, chain, members))


def _table(rows: list[tuple]) -> pa.RecordBatch:
    """Records as Arrow columns."""
    return _batch([_Block(r[0], r[1], r[2], None if r[3] is None else [r[3]], [(0, r[4])], *r[5:]) for r in rows])


def _batch(blocks: list[_Block]) -> pa.RecordBatch:
    """Blocks as Arrow columns; what records of a file share is converted once, not once per record."""
    lengths = np.array([1 if b.rows is None else len(b.rows) for b in blocks])
    begins = np.cumsum(lengths) - lengths
    of_block = pa.array(np.repeat(np.arange(len(blocks), dtype=np.int32), lengths))
    first = np.repeat(np.array([0 if b.start is None else b.start for b in blocks], np.int64) - begins, lengths)
    unread = np.repeat(np.array([b.rows is None for b in blocks]), lengths)
    marks = [(begin + at, header) for b, begin in zip(blocks, begins.tolist()) for at, header in b.headers]
    # a header that begins with its block leaves nothing to the one before
    until = np.diff([at for at, _ in marks], append=lengths.sum())
    texts = pa.list_(pa.string())
    arrays = [
        pa.array([b.path for b in blocks], pa.string()).take(of_block),
        pa.array([b.member for b in blocks], pa.string()).take(of_block),
        pa.array(first + np.arange(len(first)), pa.int64(), mask=unread),
        _lists([fields for b in blocks for fields in ([None] if b.rows is None else b.rows)]),
        pa.array([header for _, header in marks], texts).take(pa.array(np.repeat(np.arange(len(marks), dtype=np.int32), until))),
        pa.array([b.lead for b in blocks], texts).take(of_block),
        pa.array([b.error for b in blocks], pa.string()).take(of_block),
        pa.array([b.error_class for b in blocks], pa.string()).take(of_block),
    ]
    return pa.RecordBatch.from_arrays(arrays, [c.split()[0] for c in RECORD_SCHEMA.split(", ")])


def _lists(column: list[list[str] | None]) -> pa.Array:
    """Lists of texts from one flat array of them; None stays None."""
    flat = [text for fields in column if fields is not None for text in fields]
    ends = np.cumsum([0, *(0 if fields is None else len(fields) for fields in column)])
    missing = pa.array([fields is None for fields in column])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat, pa.string()), mask=missing)


def _expand(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    blocks, count, size = [], 0, 0
    for batch in batches:
        for unit in batch.to_pylist():
            for block in _unit_blocks(unit["path"], unit["inside"], unit["chain"], unit["members"]):
                rows = block.rows or ()
                # what is kept ends before it gets longer than a batch
                length = sum(map(len, chain.from_iterable(rows)))
                if blocks and (count + len(rows) > BATCH_RECORDS or size + length > BATCH_BYTES):
                    yield _batch(blocks)
                    blocks, count, size = [], 0, 0
                blocks.append(block)
                count, size = count + max(1, len(rows)), size + length
    if blocks:
        yield _batch(blocks)


def list_units(spark: SparkSession, path: str, glob: str = "*.{zip,ZIP,Zip,csv,CSV}") -> DataFrame:
    """The units of all files below ``path``, written: (path, inside, chain, members, bytes)."""
    files = (
        spark.read.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", glob)
        .load(path)
        .select("path", "length")
        .repartition(spark.sparkContext.defaultParallelism)
    )
    return written(files.mapInPandas(_list, UNIT_SCHEMA), "units")


def read_containers(spark: SparkSession, path: str, glob: str = "*.{zip,ZIP,Zip,csv,CSV}", task_bytes: int = TASK) -> DataFrame:
    """Every CSV record below ``path``: (path, member, record_no, fields, header, lead, error, error_class).

    ``fields`` counts records, not lines (quoted values may hold line breaks). A file or
    member that cannot be read shows up as a row with ``error`` set; its siblings go on.
    Directories are read at once, records when the result is used, ``task_bytes`` of them in a
    task unless one member is larger. The file system has to be one pyarrow knows.
    """
    units = list_units(spark, path, glob)
    total, n = units.agg(F.sum("bytes"), F.count(F.lit(1))).first()
    tasks = max(1, min(n, max(math.ceil((total or 0) / task_bytes), spark.sparkContext.defaultParallelism)))
    return units.repartition(tasks).mapInArrow(_expand, RECORD_SCHEMA)


class _Packer:
    """Archives of one task, written one after the other; a short member is packed at once, a long one as it comes."""

    def __init__(self, folder: str, attempt: int):
        self.system, self.base = file_system(folder)
        self.folder, self.attempt, self.done = folder, attempt, []
        self.system.create_dir(self.base, recursive=True)
        self.archive = self.member = self.nested = self.outer = self.target = self.info = self.handle = None
        self.parts, self.size = [], 0
        self.outer_stack, self.inner_stack = ExitStack(), ExitStack()

    def add(self, archive: str, member: str, content: memoryview) -> None:
        if archive != self.archive:
            self.end_archive()
            out = self.outer_stack.enter_context(self.system.open_output_stream(f"{self.base}/.{archive}-{self.attempt}"))
            self.outer = self.target = self.outer_stack.enter_context(zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED))
            self.archive = archive
        if member != self.member:
            self.begin(member)
        self.size += len(content)
        if self.handle is None and self.size > SMALL:
            self.handle = self.target.open(self.info, "w", force_zip64=True)
            for part in self.parts:
                self.handle.write(part)
            self.parts = []
        if self.handle is None:
            self.parts.append(bytes(content))
        else:
            self.handle.write(content)

    def begin(self, member: str) -> None:
        self.end_member()
        first, _, rest = member.partition(".zip/")
        nested = f"{first}.zip" if rest else None
        if nested != self.nested:
            self.inner_stack.close()
            self.target = self.outer
            if nested:
                raw = self.inner_stack.enter_context(self.outer.open(zipfile.ZipInfo(nested), "w", force_zip64=True))
                self.target = self.inner_stack.enter_context(zipfile.ZipFile(raw, "w", zipfile.ZIP_DEFLATED))
            self.nested = nested
        self.member, self.info = member, zipfile.ZipInfo(rest or member)
        self.info.compress_type = zipfile.ZIP_DEFLATED

    def end_member(self) -> None:
        if self.handle is not None:
            self.handle.close()
        elif self.member is not None:
            self.target.writestr(self.info, b"".join(self.parts))
        self.member = self.handle = None
        self.parts, self.size = [], 0

    def end_archive(self) -> None:
        self.end_member()
        self.inner_stack.close()
        self.outer_stack.close()
        if self.archive is not None:
            self.system.move(f"{self.base}/.{self.archive}-{self.attempt}", f"{self.base}/{self.archive}")
            self.done.append(f"{self.folder}/{self.archive}")
        self.archive = self.nested = None


def _runs(names: pa.Array, members: pa.Array) -> list[int]:
    """Where runs of equal (name, member) begin, and the end of the last."""
    changed = pc.or_(pc.not_equal(names[1:], names[:-1]), pc.not_equal(members[1:], members[:-1]))
    return [0, *(np.flatnonzero(changed.to_numpy(zero_copy_only=False)) + 1).tolist(), len(names)]


def write_archives(lines: DataFrame, folder: str, archive: str, member: str, order: str, line: str) -> DataFrame:
    """Pack the byte strings of ``line`` into archives below ``folder``; result: (path), one per archive.

    ``member`` is the name inside; one that starts with ``name.zip/`` goes to an archive inside the
    archive. Lines of a member follow ``order``. An archive is written by one task, streamed, under a name
    of its own attempt and renamed at the end. Evaluate the result once, for instance by writing it.
    A missing archive, member or line raises.
    """
    columns = [archive, member, line]

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = _Packer(folder, TaskContext.get().taskAttemptId())
        for batch in batches:
            if not batch.num_rows:
                continue
            names, members, contents = (batch.column(i) for i in range(3))
            if names.null_count or members.null_count or contents.null_count:
                raise ValueError("a line to be packed lacks its archive, its member or itself")
            # the lines of a run lie one behind the other in memory
            starts = _runs(names, members)
            first = pa.array(starts[:-1], pa.int32())
            contents = contents.cast(pa.large_binary())
            _, offsets, data = contents.buffers()
            ends = np.frombuffer(offsets, np.int64)[contents.offset :][starts].tolist()
            whole = memoryview(data if data is not None else b"")
            for name, inside, begin, end in zip(names.take(first).to_pylist(), members.take(first).to_pylist(), ends, ends[1:]):
                packer.add(name, inside, whole[begin:end])
        packer.end_archive()
        yield pa.RecordBatch.from_pydict({"path": pa.array(packer.done, pa.string())})

    # members of an inner archive stand together
    inner = F.when(F.contains(member, F.lit(".zip/")), F.substring_index(member, ".zip/", 1))
    ordered = lines.repartition(archive).sortWithinPartitions(F.col(archive), inner, F.col(member), F.col(order))
    return ordered.select(*columns).mapInArrow(pack, "path string")


# Archives known to be corrupt at their origin, and members not worth a complaint.
KNOWN_BAD_ARCHIVES = (
    "PUBLIC_DISPATCHPRICES_PRE_AP_20230820.zip",
    "PUBLIC_DISPATCHPRICES_PRE_AP_202308200745_0000000395024647.zip",
    "PUBLIC_TRADING_CUMULATIVE_PRICE_20230820_20230826.zip",
    "PUBLIC_TRADING_CUMULATIVE_PRICE_202308200745_0000000395024640.zip",
)
IGNORED_MEMBERS = r"7_days_High_Impact_Outages_\d+|High_Impact_Outages_\d+"


def read_problems(records: DataFrame, known_bad: tuple[str, ...] = KNOWN_BAD_ARCHIVES, ignored: str = IGNORED_MEMBERS) -> DataFrame:
    """(path, member, error, error_class, severity): 'warning' where the problem is expected, else 'error'."""
    name = F.element_at(F.split(F.when(F.col("member") == "", F.col("path")).otherwise(F.col("member")), "/"), -1)
    expected = name.isin(*known_bad) | name.rlike(ignored) | (F.col("error_class") == "UnknownFile")
    return (
        records.where(F.col("error").isNotNull())
        .select("path", "member", "error", "error_class")
        .withColumn("severity", F.when(expected, F.lit("warning")).otherwise(F.lit("error")))
    )
