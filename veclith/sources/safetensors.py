"""SafeTensors files: a JSON header and raw tensors."""

from __future__ import annotations

import json
import struct

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..functions import codec
from ..storage import file_system

#: Types that are decoded; others are listed in headers only.
TYPES = {"F64": (8, lambda b: np.frombuffer(b, "<f8")), "F32": (4, lambda b: np.frombuffer(b, "<f4")), "F16": (2, codec.half), "BF16": (2, codec.bfloat)}
HEADER_BYTES, SLICE_BYTES = 100 << 20, 64 << 20


def header(data: bytes, length: int | None = None, metadata: bool = False) -> tuple[dict, int]:
    """The header, and where tensors begin, of a file or the first bytes of one of ``length`` bytes.

    ``metadata`` keeps the entry of that name. Raises ValueError if the header can't be right.
    """
    length = len(data) if length is None else length
    if len(data) < 8:
        raise ValueError("no header")
    (size,) = struct.unpack_from("<Q", data)
    if size > min(HEADER_BYTES, length - 8):
        raise ValueError("header too long")
    found = json.loads(data[8 : 8 + size])
    about = found.pop("__metadata__", None)
    for name, t in found.items():
        a, b = t["data_offsets"]
        if not 0 <= a <= b <= length - 8 - size:
            raise ValueError(f"tensor {name!r} lies outside the file")
    return found | ({"__metadata__": about} if metadata and about else {}), 8 + size


def _opened(name: str, length: int, metadata: bool = False) -> tuple[dict, int]:
    """:func:`header` of a file, of which only that much is read."""
    files, place = file_system(name)
    with files.open_input_file(place) as f:
        first = f.read(8)
        size = struct.unpack("<Q", first)[0] if len(first) == 8 else 0
        return header(first + f.read(min(size, HEADER_BYTES + 1)), length, metadata)


def shape(dims: list[int]) -> tuple[int, int]:
    """Rows and columns: the first and the product of all other dimensions; a tensor of one dimension is one row.

    So a row is one index of the first dimension, whatever the number of further ones.
    """
    return (1, dims[0] if dims else 1) if len(dims) < 2 else (dims[0], int(np.prod(dims[1:])))


def _listed(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.format("binaryFile").load(path).select("path", "length")


def tensors(spark: SparkSession, path: str) -> DataFrame:
    """(file, tensor, dtype, shape, bytes) in order of names; only headers are read."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                rows = [{"file": name, "tensor": k, "dtype": t["dtype"], "shape": t["shape"], "bytes": t["data_offsets"][1] - t["data_offsets"][0]} for k, t in sorted(_opened(name, length)[0].items())]
                if rows:
                    yield pa.RecordBatch.from_pylist(rows, pa.schema([("file", pa.string()), ("tensor", pa.string()), ("dtype", pa.string()), ("shape", pa.list_(pa.int64())), ("bytes", pa.int64())]))

    return _listed(spark, path).mapInArrow(parse, "file string, tensor string, dtype string, shape array<long>, bytes long")


def metadata(spark: SparkSession, path: str) -> DataFrame:
    """(file, key, value) of the free entries of headers."""

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found = _opened(name, length, True)[0].get("__metadata__", {})
                yield pa.RecordBatch.from_pydict({"file": pa.array([name] * len(found), pa.string()), "key": pa.array(list(found), pa.string()), "value": pa.array([str(v) for v in found.values()], pa.string())})

    return _listed(spark, path).mapInArrow(parse, "file string, key string, value string")


def rows(spark: SparkSession, path: str, matrices_only: bool = True) -> DataFrame:
    """(file, tensor, row, values) of tensors of a decoded type and, by default, two dimensions or more.

    Tensors are read in ranges of about ``SLICE_BYTES``, each a piece of work, so files may be
    of any size; their folder must be one that executors reach through pyarrow's file systems.
    """

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                found, begin = _opened(name, length)
                out = []
                for key, t in sorted(found.items()):
                    if t["dtype"] not in TYPES or matrices_only and len(t["shape"]) < 2:
                        continue
                    n, width = shape(t["shape"])
                    size = width * TYPES[t["dtype"]][0]
                    if t["data_offsets"][1] - t["data_offsets"][0] != n * size:
                        raise ValueError(f"tensor {key!r} has another size than its shape")
                    step = max(1, SLICE_BYTES // max(1, size))
                    out += [(name, key, t["dtype"], width, a, min(step, n - a), begin + t["data_offsets"][0] + a * size) for a in range(0, n, step)]
                if out:
                    yield pa.RecordBatch.from_pylist([dict(zip(names, r, strict=True)) for r in out], arrow)

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for name, key, dtype, width, first, n, at in zip(*(batch.column(k).to_pylist() for k in range(7)), strict=True):
                size, decode = TYPES[dtype]
                files, place = file_system(name)
                with files.open_input_file(place) as f:
                    f.seek(at)
                    x = decode(f.read(n * width * size)).astype(np.float64).reshape(n, width)
                for start in range(0, n, 4096):
                    some = x[start : start + 4096]
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * width), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array([key] * len(some)), pa.array(np.arange(first + start, first + start + len(some))), lists], names=["file", "tensor", "row", "values"])

    import pyarrow as pa

    names = ["file", "tensor", "dtype", "width", "first", "count", "at"]
    arrow = pa.schema([*((n, pa.string()) for n in names[:3]), *((n, pa.int64()) for n in names[3:])])
    work = _listed(spark, path).mapInArrow(cut, ", ".join(f"`{n}` {'string' if k < 3 else 'long'}" for k, n in enumerate(names)))
    return work.repartition("file", "tensor", "first").mapInArrow(parse, "file string, tensor string, row long, values array<double>")


def encode(tensors: dict[str, np.ndarray]) -> bytes:
    """The bytes of a file with these float32 or float64 tensors."""
    kinds, head, body = {"float32": "F32", "float64": "F64", "float16": "F16"}, {}, b""
    for name, x in tensors.items():
        raw = np.ascontiguousarray(x).tobytes()
        head[name] = {"dtype": kinds[x.dtype.name], "shape": list(x.shape), "data_offsets": [len(body), len(body) + len(raw)]}
        body += raw
    text = json.dumps(head).encode()
    return struct.pack("<Q", len(text)) + text + body
