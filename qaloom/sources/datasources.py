"""Spark data sources in Python: NIfTI volumes in slabs, and tensor files that appear with the job's commit.

Register them with ``register(spark)``; then ``spark.read.format("nifti").load(folder)`` and
``df.write.format("tensors").mode("append").save(folder)``.  Files are reached through Arrow's file systems, by URI.
"""

from __future__ import annotations

import gzip
import io
import uuid
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from fnmatch import fnmatch

import numpy as np
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceWriter, EqualTo, Filter, GreaterThanOrEqual, In, InputPartition, LessThanOrEqual, WriterCommitMessage

from .volumes import encode_nifti, read_header

#: Bytes that are read for a header: a compressed file's first ones hold it many times over.
HEAD_BYTES = 4096
#: Compressed files, or headers, that one task reads: bytes and files at most.
TASK_BYTES, TASK_FILES = 64 << 20, 200
#: Planes a row, and so the most that a task holds of a volume.
SLAB = 32
NIFTI_SCHEMA = "case_id string, path string, shape array<int>, spacing array<double>, affine array<double>, z0 int, depth int, data array<float>, bytes_read long"


def _at(uri: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(uri) if "://" in uri or uri.startswith("file:") else (fs.LocalFileSystem(), uri)


def _header(source: fs.FileSystem, path: str) -> tuple[dict, int]:
    with source.open_input_stream(path, compression=None) as f:
        raw = f.read(HEAD_BYTES)
    plain = zlib.decompressobj(31).decompress(raw, 1024) if raw[:2] == b"\x1f\x8b" else raw
    return read_header(plain), len(raw)


@dataclass
class Slabs(InputPartition):
    """Planes ``first .. last`` of some files: a slab of one, or several that are read from their start (compressed, or headers alone)."""

    paths: tuple[str, ...]
    first: int
    last: int

    def __post_init__(self):
        super().__init__(None)


class NiftiReader(DataSourceReader):
    """Slabs as partitions; filters on ``case_id`` keep files from being opened, filters on ``z0`` planes from being read."""

    def __init__(self, options: dict):
        self.uri, self.pattern = options["path"], options.get("pattern", "*.nii*")
        self.slab, self.headers = int(options.get("slab", SLAB)), options.get("voxels", "true").lower() == "false"
        self.cases: set | None = None
        self.low, self.high = 0, 1 << 30

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:  # noqa: N802
        for f in filters:
            column = getattr(f, "attribute", None)
            if column == ("case_id",) and isinstance(f, (EqualTo, In)):
                names = {f.value} if isinstance(f, EqualTo) else set(f.value)
                self.cases = names if self.cases is None else self.cases & names
            elif column == ("z0",) and isinstance(f, GreaterThanOrEqual):
                self.low = max(self.low, f.value)
            elif column == ("z0",) and isinstance(f, LessThanOrEqual):
                self.high = min(self.high, f.value)
            else:
                yield f

    def _files(self) -> list[tuple[str, int]]:
        source, root = _at(self.uri)
        found = source.get_file_info(fs.FileSelector(root, recursive=True))
        return sorted((x.path, x.size) for x in found if x.is_file and fnmatch(x.base_name, self.pattern) and (self.cases is None or x.base_name in self.cases))

    def partitions(self) -> list[InputPartition]:
        source, out, held, size = _at(self.uri)[0], [], [], 0
        for path, n in self._files():
            if self.headers or path.endswith(".gz"):
                held.append(path)
                size += HEAD_BYTES if self.headers else n
                if size >= TASK_BYTES or len(held) >= TASK_FILES:
                    out.append(Slabs(tuple(held), self.low, self.high))
                    held, size = [], 0
            else:
                depth = _header(source, path)[0]["shape"][2]
                out += [Slabs((path,), z, z) for z in range(0, depth, self.slab) if self.low <= z <= self.high]
        return out + [Slabs(tuple(held), self.low, self.high)] if held or not out else out

    def read(self, partition: Slabs) -> Iterator[tuple]:
        for path in partition.paths:
            yield from self._rows(path, partition)

    def _rows(self, path: str, partition: Slabs) -> Iterator[tuple]:
        source = _at(self.uri)[0]
        h, used = _header(source, path)
        x, y, depth = h["shape"]
        own = (path.rsplit("/", 1)[-1], path, [depth, y, x], h["spacing"], h["affine"])
        if self.headers:
            yield (*own, 0, depth, None, used)
            return
        plane, kind = x * y * np.dtype(h["dtype"]).itemsize, h["dtype"]
        slabs = [z for z in range(0, depth, self.slab) if partition.first <= z <= partition.last]
        with source.open_input_file(path) as f:
            stream = gzip.GzipFile(fileobj=f) if path.endswith(".gz") else f
            for z in slabs:
                n = min(self.slab, depth - z)
                stream.seek(h["offset"] + z * plane)
                v = np.frombuffer(stream.read(n * plane), kind).astype(np.float32) * np.float32(h["slope"]) + np.float32(h["inter"])
                # a plane is stored with x running fastest: C order of (z, y, x)
                yield (*own, z, n, v.tolist(), used + n * plane)


class NiftiSource(DataSource):
    """Volumes below ``path``: a row for each slab of planes, or, with ``voxels=false``, one a file from its header alone."""

    @classmethod
    def name(cls) -> str:
        return "nifti"

    def schema(self) -> str:
        return NIFTI_SCHEMA

    def reader(self, schema) -> DataSourceReader:
        return NiftiReader(dict(self.options))


@dataclass
class Written(WriterCommitMessage):
    names: list[str] = field(default_factory=list)


class TensorWriter(DataSourceWriter):
    """Tasks write into a folder of the job's own; the commit moves the files of those that ended well, an abort leaves nothing."""

    def __init__(self, options: dict):
        self.uri, self.kind = options["path"].rstrip("/"), options.get("kind", "npy")
        self.job = f"_job-{uuid.uuid4().hex}"
        source, root = _at(self.uri)
        source.create_dir(f"{root}/{self.job}", recursive=True)

    def write(self, iterator) -> Written:
        source, root = _at(self.uri)
        attempt, names = uuid.uuid4().hex, []
        source.create_dir(f"{root}/{self.job}/{attempt}", recursive=True)
        for row in iterator:
            a = np.asarray(row["data"], np.float32).reshape(tuple(row["shape"]))
            name = f"{row['case_id'].removesuffix('.nii.gz')}.{self.kind}"
            with source.open_output_stream(f"{root}/{self.job}/{attempt}/{name}", compression=None) as out:
                out.write(self._encoded(a))
            names.append(f"{attempt}/{name}")
        return Written(names)

    def _encoded(self, a: np.ndarray) -> bytes:
        if self.kind.startswith("nii"):
            raw = encode_nifti(a)
            return raw if self.kind.endswith("gz") else gzip.decompress(raw)
        buf = io.BytesIO()
        np.savez_compressed(buf, arr=a) if self.kind == "npz" else np.save(buf, a)
        return buf.getvalue()

    def commit(self, messages: list[Written | None]) -> None:
        source, root = _at(self.uri)
        for m in messages:
            for name in m.names if m else []:
                source.move(f"{root}/{self.job}/{name}", f"{root}/{name.split('/', 1)[1]}")
        source.delete_dir(f"{root}/{self.job}")

    def abort(self, messages: list[Written | None]) -> None:
        source, root = _at(self.uri)
        source.delete_dir(f"{root}/{self.job}")


class TensorSink(DataSource):
    """A file a row of ``case_id, shape, data`` below ``path``: ``kind`` npy, npz, nii or nii.gz."""

    @classmethod
    def name(cls) -> str:
        return "tensors"

    def schema(self) -> str:
        return "case_id string, shape array<int>, data array<float>"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        if overwrite:
            raise ValueError("tensor files are appended; give a new folder")
        return TensorWriter(dict(self.options))


def register(spark: SparkSession) -> SparkSession:
    for source in (NiftiSource, TensorSink):
        spark.dataSource.register(source)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    return spark
