"""Matrix Market files as a Spark data source: ``spark.read.format("mtx")`` and
``df.write.format("mtx")``, once ``register`` has been called.

Reading: the header gives the schema (i, j, v; of complex matrices v is a struct
of re and im).  A file is cut into byte ranges of ``split_bytes``; a range takes
the lines that begin in it, so that tasks read disjoint parts and no task reads
more than its own.  Lines are parsed in batches of ``CHUNK`` bytes into Arrow.
With ``expand`` (the default) the half that a symmetric file leaves out is
added.  A folder of parts, as the writer makes it, is one file, end to end.

Writing: each task writes its entries to a part of its own; the commit adds the
header, which holds the number of entries, as the first part.  With the option
``single`` the commit joins the parts into one file, a copy through the driver in
small pieces that suits files of a few gigabytes.  A failed job leaves nothing.

Paths are opened by every task, so they must be of a file system that all
machines reach (``file:`` on shared storage, HDFS or an object store, by
pyarrow); ``sources.mtx`` reads by Spark's own readers instead."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

from .mtx import Header, PrematureEnd, Unsupported, header

SPLIT_BYTES, CHUNK = 64 << 20, 4 << 20
_SCHEMA = {False: "i long, j long, v double", True: "i long, j long, v struct<re: double, im: double>"}


def _open(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path.split("/")[0] else (fs.LocalFileSystem(), path)


def _files(path: str) -> list[tuple[str, int]]:
    """The file, or a folder's parts by name, with their sizes."""
    system, at = _open(path)
    info = system.get_file_info(at)
    if info.type == fs.FileType.Directory:
        inner = system.get_file_info(fs.FileSelector(at))
        found = sorted((f.path, f.size) for f in inner if f.type == fs.FileType.File and not f.base_name.startswith(("_", ".")))
    else:
        found = [(at, info.size)] if info.type == fs.FileType.File else []
    if not found:
        raise PrematureEnd(f"no file at {path}")
    return found


def _head(path: str) -> tuple[Header, int]:
    """The header, and the offset after it in the first file."""
    system, _ = _open(path)
    lines: list[str] = []
    with system.open_input_file(_files(path)[0][0]) as f:
        at, held = 0, b""
        while True:
            more = f.read(1 << 16)
            held += more
            *whole, held = held.split(b"\n")
            if not more and held:
                whole, held = [*whole, held], b""
            for line in whole:
                at += len(line) + 1
                text = line.decode("utf-8", "replace")
                lines.append(text)
                if len(lines) > 1 and text.strip() and not text.startswith("%"):
                    return header([lines[0], text]), at
                del lines[1:]
            if not more:
                return header(lines), at


def _table(data: bytes, h: Header) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """0-based rows and columns, and values, of whole lines."""
    if b"%" in data:
        data = b"\n".join(x for x in data.split(b"\n") if not x.lstrip().startswith(b"%"))
    fields = {"pattern": 2, "complex": 4}.get(h.field, 3)
    words = data.split()
    if len(words) % fields:
        raise PrematureEnd(f"entries of {fields} fields expected")
    cells = np.array(words, dtype=bytes).reshape(-1, fields) if words else np.zeros((0, fields), "S1")
    i, j = (cells[:, k].astype(np.int64) - 1 for k in (0, 1))
    if fields == 2:
        return i, j, np.ones(len(i))
    v = cells[:, 2].astype(np.float64)
    return i, j, v if fields == 3 else v + 1j * cells[:, 3].astype(np.float64)


def _batch(i: np.ndarray, j: np.ndarray, v: np.ndarray) -> pa.RecordBatch:
    values = pa.StructArray.from_arrays([pa.array(v.real.copy()), pa.array(v.imag.copy())], ["re", "im"]) if np.iscomplexobj(v) else pa.array(v)
    return pa.RecordBatch.from_arrays([pa.array(i), pa.array(j), values], names=["i", "j", "v"])


class _Range(InputPartition):
    def __init__(self, path: str, begin: int, end: int, first: int):
        self.path, self.begin, self.end, self.first = path, begin, end, first


class MtxReader(DataSourceReader):
    def __init__(self, options: dict):
        self.options = options
        self.header, self.after = _head(options["path"])
        if self.header.format != "coordinate":
            raise Unsupported(self.header.banner)
        self.expand = options.get("expand", "true").lower() == "true" and self.header.symmetry != "general"

    def partitions(self) -> list[InputPartition]:
        step = max(1, int(self.options.get("split_bytes", SPLIT_BYTES)))
        out = []
        for k, (path, size) in enumerate(_files(self.options["path"])):
            first = self.after if k == 0 else 0
            out += [_Range(path, at, min(size, at + step), first) for at in range(first, size, step)]
        return out or [_Range("", 0, 0, 0)]

    def read(self, partition: _Range) -> Iterator[pa.RecordBatch]:
        if partition.end <= partition.begin:
            return
        system, _ = _open(self.options["path"])
        with system.open_input_file(partition.path) as f:
            for data in _lines(f, partition):
                i, j, v = _table(data, self.header)
                yield _batch(i, j, v)
                if self.expand:
                    off = i != j
                    other = -v if self.header.symmetry == "skew-symmetric" else np.conj(v) if self.header.symmetry == "hermitian" else v
                    yield _batch(j[off], i[off], other[off])


def _lines(f, part: _Range) -> Iterator[bytes]:
    """The lines that begin in the range, whole, in pieces of about ``CHUNK``."""
    at = part.begin
    if at > part.first:
        f.seek(at - 1)
        at -= 1
        while True:  # the line that begins before the range is another's
            more = f.read(1 << 16)
            if not more:
                return
            cut = more.find(b"\n")
            if cut >= 0:
                at += cut + 1
                break
            at += len(more)
    f.seek(at)
    held = b""
    while at < part.end:
        more = f.read(min(CHUNK, part.end - at))
        if not more:
            break
        at += len(more)
        cut = more.rfind(b"\n")
        if cut < 0:
            held += more
            continue
        yield held + more[: cut + 1]
        held = more[cut + 1 :]
    while held and not held.endswith(b"\n"):  # the last line ends beyond the range
        more = f.read(1 << 12)
        if not more:
            break
        cut = more.find(b"\n")
        held += more if cut < 0 else more[: cut + 1]
    if held:
        yield held


class _Written(WriterCommitMessage):
    def __init__(self, path: str, n: int):
        self.path, self.n = path, n


class MtxWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, overwrite: bool):
        self.options, self.overwrite, self.job = options, overwrite, uuid.uuid4().hex
        self.nrows, self.ncols = (int(options[k]) for k in ("nrows", "ncols"))
        self.pattern = options.get("pattern", "false").lower() == "true"

    def write(self, iterator: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        system, at = _open(self.options["path"])
        part, n = f"{at}/_{self.job}/{TaskContext.get().partitionId():08d}-{uuid.uuid4().hex}", 0
        system.create_dir(f"{at}/_{self.job}", recursive=True)
        with system.open_output_stream(part) as out:
            for batch in iterator:
                i, j, v = (batch.column(batch.schema.get_field_index(c)).to_pylist() for c in ("i", "j", "v"))
                rows = [f"{a + 1} {b + 1}\n" for a, b in zip(i, j, strict=True)] if self.pattern else [f"{a + 1} {b + 1} {c!r}\n" for a, b, c in zip(i, j, v, strict=True)]
                out.write("".join(rows).encode())
                n += len(rows)
        return _Written(part, n)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = _open(self.options["path"])
        parts = sorted((m.path, m.n) for m in messages if m is not None)
        h = Header(self.nrows, self.ncols, sum(n for _, n in parts), "coordinate", "pattern" if self.pattern else "real", "general")
        head = f"{h.banner}\n{h.nrows} {h.ncols} {h.nnz_file}\n".encode()
        names = [p for p, n in parts if n]
        if self.options.get("single", "false").lower() == "true":
            whole = f"{at}.{self.job}"
            with system.open_output_stream(whole) as out:
                out.write(head)
                for p in names:
                    with system.open_input_file(p) as f:
                        while piece := f.read(CHUNK):
                            out.write(piece)
            system.delete_dir(at)
            system.move(whole, at)
            return
        if self.overwrite:
            for path, _ in [(f.path, 0) for f in system.get_file_info(fs.FileSelector(at)) if f.type == fs.FileType.File]:
                system.delete_file(path)
        for k, p in enumerate(names):
            system.move(p, f"{at}/part-{k + 1:08d}.mtx")
        with system.open_output_stream(f"{at}/part-00000000.mtx") as out:
            out.write(head)
        system.delete_dir(f"{at}/_{self.job}")

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        system, at = _open(self.options["path"])
        if system.get_file_info(f"{at}/_{self.job}").type == fs.FileType.Directory:
            system.delete_dir(f"{at}/_{self.job}")


class MtxDataSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "mtx"

    def schema(self) -> str:
        return _SCHEMA[_head(self.options["path"])[0].field == "complex"]

    def reader(self, schema: StructType) -> MtxReader:
        return MtxReader(dict(self.options))

    def writer(self, schema: StructType, overwrite: bool) -> MtxWriter:
        return MtxWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(MtxDataSource)
