"""Token streams as files of fixed-width numbers: a data source that writes ranges side by side and reads any chunk of them.

A stream is a run of numbers (little-endian, 2 or 4 bytes each) in files of which each holds one range. A row of the writer
has a place in the stream and the numbers that stand there; rows are dealt by ranges of the place, so that a task writes
one file. When all tasks are done the ranges are checked against each other, and a manifest that names the files is put
in place of the former one; until then readers see the former stream, and a task that runs twice leaves a file that no manifest names.
A reader cuts the stream into chunks of equal length, whatever files they lie in, and reads only the bytes of its own.

The tokens of cells are a stream (2 bytes each) whose files have a second file beside them, which says of what cells they
are: a run (the cell and how many tokens, 8 bytes each; below 0 for a cell without an id) for each cell, not a number for each token, which would be twice the
tokens' own bytes. A task doesn't know the place of its file, as places are given when all are written; so cells are dealt and
sorted once, and nothing but the files is stored.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from recollect.session import release, stored

TYPES = {"uint16": "<u2", "uint32": "<u4"}
MANIFEST = "manifest.json"
RUN = np.dtype([("cell", "<i8"), ("n", "<i8")])
#: Tokens of a batch of whole cells; a longer cell is a batch of its own.
BATCH = 1 << 19


def _opened(folder: str):
    from pyarrow import fs

    system, path = fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)
    return system, path.rstrip("/")


def read_manifest(folder: str) -> dict:
    """The kind of number, how many there are, and the files (name, start, n) in the order of the stream."""
    system, path = _opened(folder)
    with system.open_input_stream(f"{path}/{MANIFEST}") as f:
        return json.loads(f.read())


def _put_manifest(folder: str, kind: str, n: int, files: list[dict]) -> None:
    """In place of the former one, in one step."""
    system, path = _opened(folder)
    system.create_dir(path, recursive=True)
    new = f"{path}/{uuid.uuid4().hex}.tmp"
    with system.open_output_stream(new) as out:
        out.write(json.dumps({"kind": kind, "n": n, "files": files}).encode())
    system.move(new, f"{path}/{MANIFEST}")


def _names(file: dict) -> list[str]:
    return [file[k] for k in ("name", "runs") if k in file]


def _delete_files(folder: str, messages: list[WriterCommitMessage | None]) -> None:
    system, path = _opened(folder)
    for name in (x for m in messages if m for f in m.files for x in _names(f)):
        system.delete_file(f"{path}/{name}")


def _numbers(tokens: pa.Array, kind: str) -> np.ndarray:
    """All numbers of a column of arrays; ValueError if one doesn't fit."""
    flat = tokens.flatten()
    if flat.null_count:
        raise ValueError("a number is missing")
    numbers = flat.to_numpy(zero_copy_only=False)
    if len(numbers) and (numbers.min() < 0 or numbers.max() > np.iinfo(kind).max):
        raise ValueError(f"a number doesn't fit {kind}")
    return numbers


def _lengths(tokens: pa.Array) -> np.ndarray:
    return np.diff(np.asarray(tokens.offsets)) if len(tokens) else np.zeros(0, np.int64)


@dataclass
class Written(WriterCommitMessage):
    files: list[dict]


@dataclass
class Chunks(InputPartition):
    first: int
    last: int


class TokenWriter(DataSourceArrowWriter):
    """Rows are (start long, tokens array<int or long>), each task's of one range of the stream in its order."""

    def __init__(self, folder: str, kind: str):
        self.folder, self.kind = folder, kind

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, path = _opened(self.folder)
        name, first, expected, out = f"part-{uuid.uuid4().hex}.bin", None, None, None
        try:
            for b in batches:
                start, tokens = b.column("start").to_numpy(), b.column("tokens")
                lengths = _lengths(tokens)
                if not len(start):
                    continue
                if out is None:
                    system.create_dir(path, recursive=True)
                    out, first, expected = system.open_output_stream(f"{path}/{name}"), int(start[0]), int(start[0])
                if (np.concatenate([[expected], start[:-1] + lengths[:-1]]) != start).any():
                    raise ValueError("a task's rows aren't one range of the stream")
                out.write(_numbers(tokens, self.kind).astype(TYPES[self.kind]).tobytes())
                expected = int(start[-1] + lengths[-1])
        finally:
            if out is not None:
                out.close()
        return Written([] if out is None else [{"name": name, "start": first, "n": expected - first}])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files = sorted((f for m in messages if m for f in m.files), key=lambda f: (f["start"], f["n"]))
        at = 0
        for f in files:
            if f["start"] != at:
                raise ValueError(f"the stream has a gap or an overlap at {at}")
            at += f["n"]
        _put_manifest(self.folder, self.kind, at, files)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _delete_files(self.folder, messages)


class CellWriter(DataSourceArrowWriter):
    """Rows are (cell_id long, tokens array<int or long>); the stream is that of all tasks' rows, task by task. ordered: whether cells must stand in the order of their ids."""

    def __init__(self, folder: str, ordered: bool):
        self.folder, self.ordered = folder, ordered

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        system, path = _opened(self.folder)
        name, n, ends, out = f"part-{uuid.uuid4().hex}", 0, [], None
        try:
            for b in batches:
                cells, tokens = b.column("cell_id"), b.column("tokens")
                if not len(cells):
                    continue
                runs, lengths = np.zeros(len(cells), RUN), _lengths(tokens)
                known, place = cells.is_valid().to_numpy(zero_copy_only=False), cells.fill_null(np.iinfo("i8").min).to_numpy()  # null ones come first
                runs["cell"], runs["n"] = np.where(known, place, 0), np.where(known, lengths, -lengths)
                if self.ordered and ((place[1:] < place[:-1]).any() or ends and place[0] < ends[1]):
                    raise ValueError("a task's cells aren't in the order of their ids")
                ends = [ends[0] if ends else int(place[0]), int(place[-1])]
                if out is None:
                    system.create_dir(path, recursive=True)
                    out = system.open_output_stream(f"{path}/{name}.bin"), system.open_output_stream(f"{path}/{name}.runs")
                out[0].write(_numbers(tokens, "uint16").astype("<u2").tobytes())
                out[1].write(runs.tobytes())
                n += int(lengths.sum())
        finally:
            for f in out or ():
                f.close()
        return Written([] if out is None else [{"name": f"{name}.bin", "runs": f"{name}.runs", "n": n, "task": TaskContext.get().partitionId(), "cells": ends}])

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        files, at, last = sorted((f for m in messages if m for f in m.files), key=lambda f: f["task"]), 0, None
        for f in files:
            first, end = f.pop("cells")
            if self.ordered and last is not None and first < last:
                raise ValueError(f"cell {first} stands after cell {last}")
            f["start"], last = at, end
            at += f["n"]
        _put_manifest(self.folder, "uint16", at, files)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        _delete_files(self.folder, messages)


def _runs(system, path: str, file: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The cells of a file's runs, whether they have no id, and where they begin and end in it."""
    with system.open_input_stream(f"{path}/{file['runs']}") as f:
        runs = np.frombuffer(f.read(), RUN)
    ends = np.cumsum(np.abs(runs["n"]))
    return runs["cell"], runs["n"] < 0, ends - np.abs(runs["n"]), ends


class TokenReader(DataSourceReader):
    """(chunk_id long, tokens array<long>, and with `cells` the cell of each token): the stream in chunks of `length`; the rest at its end only if asked for."""

    def __init__(self, folder: str, length: int, tail: bool, per_task: int, cells: bool = False):
        self.folder, self.length, self.per_task, self.cells = folder, length, per_task, cells
        self.manifest = read_manifest(folder)
        n = self.manifest["n"]
        self.chunks = -(-n // length) if tail else n // length

    def partitions(self) -> list[InputPartition]:
        return [Chunks(a, min(a + self.per_task, self.chunks)) for a in range(0, self.chunks, self.per_task)] or [Chunks(0, 0)]

    def read(self, partition: Chunks) -> Iterator[pa.RecordBatch]:
        system, path = _opened(self.folder)
        kind = np.dtype(TYPES[self.manifest["kind"]])
        begin, end = partition.first * self.length, min(partition.last * self.length, self.manifest["n"])
        parts, of, unknown = [], [], []
        for f in self.manifest["files"]:
            a, b = max(begin, f["start"]), min(end, f["start"] + f["n"])
            if a < b and self.cells:
                cell, null, starts, ends = _runs(system, path, f)
                i, j = np.searchsorted(ends, a - f["start"], "right"), np.searchsorted(starts, b - f["start"])
                each = np.minimum(ends[i:j], b - f["start"]) - np.maximum(starts[i:j], a - f["start"])
                of.append(np.repeat(cell[i:j], each))
                unknown.append(np.repeat(null[i:j], each))
            if a < b:
                with system.open_input_file(f"{path}/{f['name']}") as source:
                    parts.append(np.frombuffer(source.read_at((b - a) * kind.itemsize, (a - f["start"]) * kind.itemsize), kind))
        numbers = np.concatenate(parts) if parts else np.zeros(0, kind)
        streams = {"tokens": (numbers, None)}
        if self.cells:
            streams["cells"] = (np.concatenate(of), np.concatenate(unknown)) if of else (np.zeros(0, np.int64), None)
        offsets = np.minimum(np.arange(partition.last - partition.first + 1) * self.length, len(numbers)).astype(np.int32)
        ids = np.arange(partition.first, partition.last)
        for a in range(0, len(ids), 4096):
            o = offsets[a : a + 4097]
            part = slice(o[0], o[-1])
            lists = [pa.ListArray.from_arrays(pa.array(o - o[0]), pa.array(x[part].astype(np.int64), mask=None if m is None else m[part])) for x, m in streams.values()]
            yield pa.RecordBatch.from_arrays([pa.array(ids[a : a + 4096]), *lists], names=["chunk_id", *streams])


@dataclass
class Begun(InputPartition):
    file: int
    first: int
    last: int


class CellReader(DataSourceReader):
    """(cell_id long, tokens array<int>): each cell as it was written. A task has the cells that begin in its part of a file, and reads them to their ends."""

    def __init__(self, folder: str, per_task: int):
        self.folder, self.per_task = folder, per_task
        self.files = read_manifest(folder)["files"]

    def partitions(self) -> list[InputPartition]:
        return [Begun(k, a, a + self.per_task) for k, f in enumerate(self.files) for a in range(0, f["n"], self.per_task)] or [Begun(0, 0, 0)]

    def read(self, partition: Begun) -> Iterator[pa.RecordBatch]:
        if not self.files:
            return
        system, path = _opened(self.folder)
        file = self.files[partition.file]
        cell, null, starts, ends = _runs(system, path, file)
        at, last = np.searchsorted(starts, [partition.first, partition.last]).tolist()
        with system.open_input_file(f"{path}/{file['name']}") as source:
            while at < last:
                to = min(max(at + 1, int(np.searchsorted(ends, starts[at] + BATCH, "right"))), last)
                begin, end = int(starts[at]), int(ends[to - 1])
                numbers = np.frombuffer(source.read_at((end - begin) * 2, begin * 2), "<u2")
                offsets = pa.array(np.append(starts[at:to], end) - begin, pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(cell[at:to], mask=null[at:to]), pa.ListArray.from_arrays(offsets, pa.array(numbers.astype(np.int32)))], names=["cell_id", "tokens"])
                at = to


class TokenFiles(DataSource):
    """Options: path; kind (uint16 or uint32) to write; length, tail, cells (whether to say the cell of each token) and per_task (chunks of a task) to read."""

    @classmethod
    def name(cls) -> str:
        return "token_files"

    def schema(self) -> str:
        return "chunk_id long, tokens array<long>" + (", cells array<long>" if self.options.get("cells", "false") == "true" else "")

    def reader(self, schema) -> TokenReader:
        flag = lambda k: self.options.get(k, "false") == "true"
        return TokenReader(self.options["path"], int(self.options.get("length", 64)), flag("tail"), int(self.options.get("per_task", 1 << 16)), flag("cells"))

    def writer(self, schema, overwrite: bool) -> TokenWriter:
        return TokenWriter(self.options["path"], self.options.get("kind", "uint16"))


class TokenCells(DataSource):
    """Options: path; ordered to write; per_task (tokens of a task) to read."""

    @classmethod
    def name(cls) -> str:
        return "token_cells"

    def schema(self) -> str:
        return "cell_id long, tokens array<int>"

    def reader(self, schema) -> CellReader:
        return CellReader(self.options["path"], int(self.options.get("per_task", 1 << 21)))

    def writer(self, schema, overwrite: bool) -> CellWriter:
        return CellWriter(self.options["path"], self.options.get("ordered", "true") == "true")


def write_stream(rows: DataFrame, folder: str, kind: str = "uint16") -> None:
    """rows: start long, tokens array: the stream's parts, each at its place, which together leave no gap. Writing again replaces the stream."""
    rows.sparkSession.dataSource.register(TokenFiles)
    placed = rows.where(F.size("tokens") > 0).select("start", F.col("tokens").cast("array<long>").alias("tokens"))
    placed.repartitionByRange("start").sortWithinPartitions("start").write.format("token_files").option("kind", kind).mode("append").save(folder)


def read_stream(spark: SparkSession, folder: str, length: int = 64, tail: bool = False) -> DataFrame:
    """chunk_id and tokens of each chunk."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("length", length).option("tail", str(tail).lower()).load(folder)


def drop_unnamed(folder: str) -> int:
    """Deletes the files of former streams and of tasks that ran twice; to be called when no reader or writer is at work. How many went."""
    from pyarrow import fs

    system, path = _opened(folder)
    named = {x for f in read_manifest(folder)["files"] for x in _names(f)}
    gone = [f for f in system.get_file_info(fs.FileSelector(path)) if f.base_name.startswith("part-") and f.base_name not in named]
    for f in gone:
        system.delete_file(f.path)
    return len(gone)


def write_sorted_cells(cells: DataFrame, folder: str, ordered: bool = True) -> None:
    """cells: cell_id, tokens; dealt by ranges and sorted, so that a partition's cells stand before those of the next. ordered: by their ids, which is checked."""
    cells.sparkSession.dataSource.register(TokenCells)
    full = cells.where(F.size("tokens") > 0).select(F.col("cell_id").cast("long").alias("cell_id"), "tokens")
    full.write.format("token_cells").option("ordered", str(ordered).lower()).mode("append").save(f"{folder}/tokens")


def write_token_cells(cells: DataFrame, folder: str, order: str = "cell_id") -> None:
    """cells: cell_id, tokens. The stream of their tokens in the order of `order`, and the cell that each is of.

    Cells are stored for the time of writing, so that tokens are made once, not for each pass of the sort.
    """
    made = stored(cells, "cells")
    write_sorted_cells(made.repartitionByRange(order).sortWithinPartitions(order), folder, order == "cell_id")
    release(made)


def read_token_cells(spark: SparkSession, folder: str, length: int = 64, tail: bool = False) -> DataFrame:
    """chunk_id, tokens and cells (the cell of each token) of each chunk."""
    spark.dataSource.register(TokenFiles)
    return spark.read.format("token_files").option("length", length).option("tail", str(tail).lower()).option("cells", "true").load(f"{folder}/tokens")


def read_cells(spark: SparkSession, folder: str) -> DataFrame:
    """cell_id and tokens of each cell that was written, without a shuffle."""
    spark.dataSource.register(TokenCells)
    out = spark.read.format("token_cells").load(f"{folder}/tokens")
    out.stored_at = folder
    return out
