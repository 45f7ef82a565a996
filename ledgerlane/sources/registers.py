"""Folders of registers as sheet rows: ``source, row_number, cells, problem``.

A Python data source, ``register``, reads and writes delimited text and workbooks. Reading streams each
file in one task, small files several to a task, and is never as large as a file in memory: a register
larger than a task should handle is split into files outside. ``source`` is the path of a file, so equal
names in two folders stay apart. A file that cannot be read to its end gives one row with row number 0
and its problem; ``load_registers`` refuses it.

Records count as the standard reader counts them, blank lines included, since line ids carry the row's
number; Spark's own reader leaves blank lines out.

Paths are local or of any scheme that ``pyarrow.fs`` opens, reachable from every executor.
"""

from __future__ import annotations

import csv
import io
import itertools
import os
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, InputPartition, WriterCommitMessage

from ledgerlane.config import DEFAULTS
from ledgerlane.operators.scale import broadcast_if_small, cut, fan_out
from ledgerlane.sources import workbooks

FORMAT = "register"
TEXT_SUFFIXES = ("csv", "txt")
WORKBOOK_SUFFIXES = ("xlsx",)
FIELD_LIMIT = 131_072
"""Characters at most in one field of delimited text; an open quote is found out by it."""
TASK_BYTES = 128 * 1024 * 1024
"""Files are read several to a task up to this size; a larger file has a task of its own."""
PACKED = 8
"""What a byte of a workbook, which is compressed, counts for against one of delimited text."""
TASKS_A_CORE = 3

RAW_TYPES = workbooks.RAW_TYPES + ", cells array<string>"
_RAW = pa.schema([
    ("source", pa.string()), ("part", pa.string()), ("a", pa.int64()), ("b", pa.int64()), ("text", pa.string()),
    ("places", pa.list_(pa.int64())), ("styles", pa.list_(pa.int64())), ("kinds", pa.list_(pa.string())),
    ("texts", pa.list_(pa.string())), ("cells", pa.list_(pa.string())),
])


def store_of(path: str) -> tuple[fs.FileSystem, str, str]:
    """The file system of a path, the path in it, and what comes before that in the whole path."""
    if path.startswith("file:"):
        path = "/" + path.removeprefix("file:").lstrip("/")
    if "://" not in path:
        return fs.LocalFileSystem(), os.path.abspath(path), ""
    store, inner = fs.FileSystem.from_uri(path)
    return store, inner, path[: path.index(inner)] if inner in path else ""


def _suffix(path: str) -> str:
    return os.path.splitext(path)[1].removeprefix(".").lower()


def _text_rows(stream, source: str) -> Iterator[tuple]:
    """Rows of one delimited file, or its problem at last."""
    csv.field_size_limit(FIELD_LIMIT)
    number = 0
    try:
        for cells in csv.reader(io.TextIOWrapper(stream, encoding="utf-8-sig", newline="")):
            number += 1
            yield "row", number, 0, "", *workbooks.NO_CELLS, cells
    except UnicodeDecodeError:
        yield _problem(f"{source} is not UTF-8 text")
    except csv.Error as error:
        open_quote = "field larger" in str(error)
        why = f"has a field of more than {FIELD_LIMIT} characters: a quote may be open" if open_quote else f"cannot be read: {error}"
        yield _problem(f"{source} {why}")
    else:
        if not number:
            yield _problem(f"{source} has a header and no rows")


def _problem(text: str) -> tuple:
    return "problem", 0, 0, text, *workbooks.NO_CELLS, None


def _file_rows(path: str, sheet: str | None) -> Iterator[tuple]:
    kind = _suffix(path)
    if kind not in TEXT_SUFFIXES + WORKBOOK_SUFFIXES:
        known = ", ".join(TEXT_SUFFIXES + WORKBOOK_SUFFIXES)
        yield _problem(f"{path}: files of type '{kind}' are not read; use {known}")
        return
    store, inner, _ = store_of(path)
    with store.open_input_file(inner) as stream:
        if kind in TEXT_SUFFIXES:
            yield from _text_rows(stream, path)
        else:
            for row in workbooks.package_rows(stream, path, sheet):
                yield (*row, None)


@dataclass
class _Files(InputPartition):
    paths: list[str]


class _Reader(DataSourceReader):
    def __init__(self, options):
        self.path, self.sheet = options["path"], options.get("sheetName")
        kinds = options.get("kinds")
        self.kinds = kinds.split(",") if kinds else None
        self.cores = int(options.get("cores", "1"))

    def partitions(self) -> list[InputPartition]:
        store, inner, before = store_of(self.path)
        found = store.get_file_info(fs.FileSelector(inner, recursive=True))
        files = sorted(
            (before + info.path, (info.size or 0) * (PACKED if _suffix(info.path) in WORKBOOK_SUFFIXES else 1))
            for info in found
            if info.type == fs.FileType.File
            and not any(name.startswith(("_", ".")) for name in info.path[len(inner):].split("/"))
            and (self.kinds is None or _suffix(info.path) in self.kinds)
        )
        # Parsing is slow for its bytes: while files are few they are spread over all cores.
        fair = sum(length for _, length in files) // (TASKS_A_CORE * self.cores)
        most = min(TASK_BYTES, max(fair, 1))
        tasks, size = [], None
        for path, length in files:
            if size is None or size + length > most:
                tasks.append(_Files([]))
                size = 0
            tasks[-1].paths.append(path)
            size += length
        return tasks or [_Files([])]

    def read(self, partition: _Files) -> Iterator[pa.RecordBatch]:
        for path in partition.paths:
            for batch in workbooks.in_batches(_file_rows(path, self.sheet)):
                columns = [[path] * len(batch), *map(list, zip(*batch))]
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(columns, _RAW)], schema=_RAW)


@dataclass
class _Written(WriterCommitMessage):
    attempt: str
    names: list[str]


class _Writer(DataSourceWriter):
    """Rows ``source, row_number, cells``, each file's in one partition in order, to files named ``source``.

    Each task writes below a folder of its own that readers pass over; the files are moved into place when all tasks
    are done, so a lost or repeated task leaves nothing half written.
    """

    def __init__(self, options):
        self.path = options["path"]

    def write(self, rows: Iterator) -> WriterCommitMessage:
        store, inner, _ = store_of(self.path)
        attempt, names = f"_attempt-{uuid.uuid4().hex}", []
        for name, group in itertools.groupby(rows, key=lambda r: r["source"]):
            if name in names:
                raise ValueError(f"rows of {name} do not lie together")
            target = f"{inner}/{attempt}/{name}"
            store.create_dir(os.path.dirname(target), recursive=True)
            with store.open_output_stream(target) as out:
                numbered = ((r["row_number"], r["cells"]) for r in group)
                if _suffix(name) in WORKBOOK_SUFFIXES:
                    workbooks.write_workbook(out, numbered)
                else:
                    write_text(out, numbered)
            names.append(name)
        return _Written(attempt, names)

    def commit(self, messages: list) -> None:
        store, inner, _ = store_of(self.path)
        written = [m for m in messages if m is not None]
        names = [name for m in written for name in m.names]
        taken = [i.path for i in store.get_file_info([f"{inner}/{n}" for n in names]) if i.type != fs.FileType.NotFound]
        if taken or len(set(names)) < len(names):
            self.abort(messages)
            raise ValueError(f"files are there already: {taken[:5]}" if taken else "rows of a file lie in several partitions")
        for message in written:
            for name in message.names:
                store.create_dir(os.path.dirname(f"{inner}/{name}"), recursive=True)
                store.move(f"{inner}/{message.attempt}/{name}", f"{inner}/{name}")
        self.abort(messages)

    def abort(self, messages: list) -> None:
        store, inner, _ = store_of(self.path)
        for message in messages:
            if message is not None and message.names:
                store.delete_dir(f"{inner}/{message.attempt}")


class RegisterFiles(DataSource):
    """Options: ``path``; reading also ``sheetName`` (else the first sheet), ``kinds``, comma-separated suffixes, and
    ``cores``, over which few files are spread."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    def schema(self) -> str:
        return RAW_TYPES

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("registers are only added: use mode append")
        return _Writer(self.options)


def write_text(out, rows: Iterator[tuple[int, list]]) -> None:
    """Delimited text in UTF-8; rows that are left out become blank lines."""
    text = io.TextIOWrapper(out, encoding="utf-8", newline="")
    writer = csv.writer(text, lineterminator="\n")
    last = 0
    for number, cells in rows:
        for _ in range(last + 1, number):
            text.write("\n")
        writer.writerow(["" if c is None else c for c in cells])
        last = number
    text.flush()
    text.detach()


def _raw(spark: SparkSession, path: str, sheet_name: str | None, kinds: tuple[str, ...]) -> DataFrame:
    spark.dataSource.register(RegisterFiles)
    cores = spark.sparkContext.defaultParallelism
    options = {"sheetName": sheet_name, "kinds": ",".join(kinds) or None, "cores": str(cores)}
    reader = spark.read.format(FORMAT)
    for name, value in options.items():
        if value is not None:
            reader = reader.option(name, value)
    return cut(reader.load(path))


def _text_part(raw: DataFrame) -> DataFrame:
    """Rows of delimited files that were read to their end, and problems of files of any kind."""
    failed = raw.where("part = 'problem'")
    rows = raw.where("part = 'row'").select("source", F.col("a").alias("row_number"), "cells")
    failed = broadcast_if_small(failed.select("source"), DEFAULTS.broadcast_rows)
    return rows.join(failed, "source", "left_anti").withColumn("problem", F.lit(None).cast("string"))


def read_register_csv(spark: SparkSession, path: str) -> DataFrame:
    """All ``.csv`` and ``.txt`` below ``path``, in any letter case."""
    raw = _raw(spark, path, None, TEXT_SUFFIXES)
    return _text_part(raw).unionByName(workbooks.problem_rows(raw))


def read_register_xlsx(spark: SparkSession, path: str, sheet_name: str | None = None) -> DataFrame:
    """All ``.xlsx`` below ``path``, in any letter case; the first sheet of each unless one is named."""
    return workbooks.resolved(_raw(spark, path, sheet_name, WORKBOOK_SUFFIXES))


def read_registers(spark: SparkSession, path: str, sheet_name: str | None = None) -> DataFrame:
    """Every file below ``path``: registers as rows, other files as a problem.

    Files and folders whose name begins with ``_`` or ``.`` are passed over.
    """
    raw = _raw(spark, path, sheet_name, ())
    return _text_part(raw).unionByName(workbooks.resolved(raw))


def write_registers(rows: DataFrame, path: str) -> None:
    """Sheet rows to files below ``path``: ``source`` is a file's name, which ends in ``.csv``, ``.txt`` or ``.xlsx``.

    A file is written by one task.
    """
    rows.sparkSession.dataSource.register(RegisterFiles)
    together = rows.select("source", F.col("row_number").cast("long"), F.col("cells").cast("array<string>"))
    together = fan_out(together, "source").sortWithinPartitions("source", "row_number")
    together.write.format(FORMAT).mode("append").save(path)
