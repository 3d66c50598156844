"""What several training-data operators share: shared folders, file systems, columns."""

from __future__ import annotations

import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The characters that count as white space in texts, and ASCII letters.
WHITE = r"[\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share.

    Where none is set a local session gets a temporary one; on a cluster, where other machines
    couldn't see it, that raises ValueError. What operators write there stays: their results
    read it, so whoever runs them removes ``veclith-*`` when results are no longer needed.
    """
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not base:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        base = "file://" + tempfile.mkdtemp(prefix="veclith-")
        spark.sparkContext.setCheckpointDir(base)
    return base.rstrip("/")


def scratch(spark: SparkSession, name: str) -> str:
    """A new path in the shared folder."""
    return f"{shared_dir(spark)}/veclith-{uuid.uuid4().hex}/{name}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """``df`` written once to the shared folder and read again: lineage ends there."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def remove(df: DataFrame) -> None:
    """Delete the files of ``df``, which :func:`stored` made and nothing reads any more."""
    spark = df.sparkSession
    files, jvm = df.inputFiles(), spark.sparkContext._jvm
    if files:
        folder = jvm.org.apache.hadoop.fs.Path(jvm.java.net.URI(files[0])).getParent()
        folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)


def tidy() -> None:
    """Give memory that a Python worker no longer uses back to the machine; workers outlive tasks."""
    import ctypes

    import pyarrow as pa

    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)
    if trim is not None:
        trim(0)


def arrow_schema(ddl: str):
    """pyarrow's schema for a DDL string; needs a session, so it is called on the driver."""
    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    return to_arrow_schema(StructType.fromDDL(ddl))


def file_system(uri: str):
    """pyarrow's file system and path for a URI of the shared folder."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(re.sub(r"^file:/(?!/)", "file:///", uri))


def publish(uri: str, attempt: str, write) -> None:
    """Call ``write(stream)`` on a temporary name, then rename: readers never see half a file.

    Another attempt at the same file writes the same bytes under a temporary name of its
    own, so a lost executor or a speculative copy does no harm.
    """
    files, path = file_system(uri)
    folder, _, name = path.rpartition("/")
    files.create_dir(folder, recursive=True)
    temporary = f"{folder}/.{name}.{attempt}"
    with files.open_output_stream(temporary) as out:
        write(out)
    files.move(temporary, path)


def unused(df: DataFrame, name: str) -> str:
    """``name``, or that with marks in front which no column of ``df`` has."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = "_" + name
    return name


def text_of(column: str = "text") -> Column:
    """The text, null as empty."""
    return F.coalesce(F.col(column), F.lit(""))


def squeezed(text: Column) -> Column:
    """Each run of white space as one space.

    Equal to ``regexp_replace(text, WHITE, ' ')``; characters that a text doesn't have cost one
    look for a byte, others a split, the regular expression runs only where two blanks meet.
    Steps refer to a variable of the fold: expressions put into each other would hold the text
    3 ** 6 times, and plans with those cost the driver hundreds of MB.
    """

    def spaced(text: Column, char: Column) -> Column:
        return F.when(F.contains(text, char), F.array_join(F.split(text, char, -1), " ")).otherwise(text)

    def single(text: Column) -> Column:
        return F.when(F.contains(text, F.lit("  ")), F.regexp_replace(text, " {2,}", " ")).otherwise(text)

    return F.aggregate(F.array(*map(F.lit, "\t\n\x0b\f\r")), text, spaced, single)


def lower_ascii(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    return F.when(text.rlike("[A-Z]"), F.translate(text, UPPER, LOWER)).otherwise(text)


def held_out(doc_id: str = "doc_id") -> Column:
    """True for documents that no model may learn from: crc32 of the id as text, modulo 3, is 1."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")
