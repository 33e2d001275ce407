"""Volume sources: a NIfTI-1 data source and decoders of npy and npz files."""

from __future__ import annotations

import gzip
import io
import struct

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import VOLUME

#: numpy types of NIfTI-1 datatype codes (fixed values of the format).
DTYPES = {2: "u1", 4: "i2", 8: "i4", 16: "f4", 64: "f8", 256: "i1", 512: "u2", 768: "u4"}


def read_header(raw: bytes) -> dict:
    """Shape (x, y, z), spacing, affine rows and data layout of a NIfTI-1 file."""
    for end in "<>":
        if struct.unpack_from(end + "i", raw, 0)[0] == 348:
            break
    else:
        raise ValueError("not a NIfTI-1 file")
    dim = struct.unpack_from(end + "8h", raw, 40)
    code = struct.unpack_from(end + "h", raw, 70)[0]
    pixdim = struct.unpack_from(end + "8f", raw, 76)
    offset, slope, inter = struct.unpack_from(end + "3f", raw, 108)
    sform = struct.unpack_from(end + "h", raw, 254)[0]
    rows = struct.unpack_from(end + "12f", raw, 280)
    affine = list(rows) if sform > 0 else [pixdim[1], 0, 0, 0, 0, pixdim[2], 0, 0, 0, 0, pixdim[3], 0]
    return {"shape": list(dim[1:4]), "spacing": [float(p) for p in pixdim[1:4]], "affine": [float(v) for v in affine], "dtype": end + DTYPES[code], "offset": int(offset), "slope": slope or 1.0, "inter": inter}


def decode_nifti(raw: bytes, data: bool = True) -> dict:
    """Header fields and, if wanted, the scaled voxels as (z, y, x) float32."""
    plain = gzip.decompress(raw) if raw[:2] == b"\x1f\x8b" else raw
    h = read_header(plain)
    if data:
        n = int(np.prod(h["shape"]))
        v = np.frombuffer(plain, h["dtype"], n, h["offset"]).astype(np.float32) * np.float32(h["slope"]) + np.float32(h["inter"])
        h["data"] = v.reshape(h["shape"], order="F").transpose(2, 1, 0)
    return h


def encode_nifti(volume: np.ndarray, spacing: tuple[float, float, float] = (1.0, 1.0, 1.0), affine: list[float] | None = None) -> bytes:
    """A compressed NIfTI-1 file of a (z, y, x) volume, stored as float32."""
    x = volume.transpose(2, 1, 0)
    h = bytearray(352)
    struct.pack_into("<i", h, 0, 348)
    struct.pack_into("<8h", h, 40, 3, *x.shape, 1, 1, 1, 1)
    struct.pack_into("<hh", h, 70, 16, 32)
    struct.pack_into("<8f", h, 76, 1.0, *spacing, 0, 0, 0, 0)
    struct.pack_into("<3f", h, 108, 352.0, 1.0, 0.0)
    if affine is not None:
        struct.pack_into("<h", h, 254, 1)
        struct.pack_into("<12f", h, 280, *affine)
    h[344:348] = b"n+1\0"
    return gzip.compress(bytes(h) + x.astype("<f4").tobytes(order="F"))


def read_nifti(spark: SparkSession, root: str, voxels: bool = True) -> DataFrame:
    """Volumes below ``root`` as ``case_id, shape (z, y, x), spacing (x, y, z), affine, data``; without voxels only headers are kept."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.nii*").load(root).select("path", "content")

    def work(frames):
        for f in frames:
            for path, content in zip(f["path"], f["content"], strict=True):  # one volume a batch: they are large
                h = decode_nifti(content, voxels)
                yield pd.DataFrame({"case_id": [path.rsplit("/", 1)[-1]], "shape": [h["shape"][::-1]], "spacing": [h["spacing"]], "affine": [h["affine"]], "data": [h["data"].reshape(-1) if voxels else None]})

    return files.mapInPandas(work, VOLUME)


def probe_depth(spark: SparkSession, root: str) -> DataFrame:
    return read_nifti(spark, root, voxels=False).select("case_id", F.col("shape")[0].alias("depth"))


TENSOR = T.StructType([T.StructField("shape", T.ArrayType(T.IntegerType())), T.StructField("data", T.ArrayType(T.FloatType()))])


def decode_tensor(content: str | Column, key: str | None = None, rank: int | None = None, channels: int | None = None) -> Column:
    """Shape and float32 data of an npy or npz file.

    ``rank`` 4 lifts a three-dimensional array by a leading axis, any other mismatch raises; ``channels`` repeats a single
    channel.  Of an npz the array ``key`` (or the first) is read.
    """

    @F.pandas_udf(TENSOR)
    def work(raw: pd.Series) -> pd.DataFrame:
        out = []
        for r in raw:
            a = np.load(io.BytesIO(r), allow_pickle=False)
            if hasattr(a, "files"):
                a = a[key or a.files[0]]
            if rank == 4 and a.ndim == 3:
                a = a[None]
            if rank is not None and a.ndim != rank:
                raise ValueError(f"expected {rank} dimensions, found {a.ndim}")
            if channels and a.shape[0] == 1:
                a = np.repeat(a, channels, axis=0)
            out.append((list(a.shape), a.astype(np.float32).reshape(-1)))
        return pd.DataFrame(out, columns=["shape", "data"])

    return work(F.col(content) if isinstance(content, str) else content)


def decode_slice_pack(content: str | Column) -> Column:
    """``(slice_idx, rgb)`` rows of a pack with ``slices`` uint8 (n, h, w, 3) and ``slice_indices`` (n)."""

    @F.pandas_udf("array<struct<slice_idx:int, rgb:binary>>")
    def work(raw: pd.Series) -> pd.Series:
        out = []
        for r in raw:
            z = np.load(io.BytesIO(r), allow_pickle=False)
            s, i = z["slices"], z["slice_indices"]
            if s.ndim != 4 or s.shape[-1] != 3 or len(s) != len(i):
                raise ValueError("a slice pack needs (n, h, w, 3) slices and n indices")
            out.append([{"slice_idx": int(k), "rgb": v.tobytes()} for k, v in zip(i, s.astype(np.uint8), strict=True)])
        return pd.Series(out)

    return work(F.col(content) if isinstance(content, str) else content)
