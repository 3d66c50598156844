"""Vector files of the public nearest-neighbour sets: records of a count and that many numbers."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from ..storage import file_system


#: Bytes of a file that are read as one piece of work.
SLICE_BYTES = 64 << 20


def read(spark: SparkSession, path: str, integers: bool = False) -> DataFrame:
    """(file, row, values) of FVECS (floats) or, with ``integers``, IVECS files, in slices of ``SLICE_BYTES``.

    Files are opened by ranges, so they may be of any size; their folder must be one that
    executors reach through pyarrow's file systems.
    """
    kind, ddl = ("<i4", "int") if integers else ("<f4", "float")

    def cut(batches):
        import pyarrow as pa

        for batch in batches:
            for name, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if not length:
                    continue
                files, place = file_system(name)
                with files.open_input_file(place) as f:
                    dim = int(np.frombuffer(f.read(4), "<i4")[0])
                if dim <= 0 or length % (4 + 4 * dim):
                    raise ValueError(f"{name} isn't a file of vectors of {dim} coordinates")
                step, rows = max(1, SLICE_BYTES // (4 + 4 * dim)), length // (4 + 4 * dim)
                starts = list(range(0, rows, step))
                yield pa.RecordBatch.from_pydict({"file": [name] * len(starts), "dim": pa.array([dim] * len(starts), pa.int32()), "start": starts, "rows": [min(step, rows - a) for a in starts]})

    def parse(batches):
        import pyarrow as pa

        for batch in batches:
            for name, dim, begin, rows in zip(*(batch.column(k).to_pylist() for k in range(4)), strict=True):
                files, place = file_system(name)
                with files.open_input_file(place) as f:
                    f.seek(begin * (4 + 4 * dim))
                    records = np.frombuffer(f.read(rows * (4 + 4 * dim)), "<i4").reshape(-1, dim + 1)
                if (records[:, 0] != dim).any():
                    raise ValueError(f"{name} has vectors of different lengths")
                for start in range(0, len(records), 4096):
                    some = np.ascontiguousarray(records[start : start + 4096, 1:]).view(kind)
                    lists = pa.ListArray.from_arrays(pa.array(np.arange(len(some) + 1, dtype=np.int32) * dim), pa.array(some.ravel()))
                    yield pa.RecordBatch.from_arrays([pa.array([name] * len(some)), pa.array(np.arange(begin + start, begin + start + len(some))), lists], names=["file", "row", "values"])

    listed = spark.read.format("binaryFile").load(path).select("path", "length")
    work = listed.mapInArrow(cut, "file string, dim int, start long, rows long").repartition("file", "start")
    return work.mapInArrow(parse, f"file string, row long, values array<{ddl}>")


def encode(rows: np.ndarray) -> bytes:
    """The bytes of a file with these rows of float32 or int32."""
    out = np.empty((len(rows), rows.shape[1] + 1), "<i4")
    out[:, 0] = rows.shape[1]
    out[:, 1:] = np.ascontiguousarray(rows).view("<i4")
    return out.tobytes()
