"""Helpers shared by the training-data operators."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: White space as every contract of this package counts it, and a word as a run of anything else.
SPACE = r"[\x20\x09-\x0D]+"
WORD = r"[^\x20\x09-\x0D]+"


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``, which driver and executors share; one of our own only where that is unset and all run on this machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        folder = spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="scribelens-")
        spark.sparkContext.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, what: str) -> DataFrame:
    """Write ``df`` once to the shared folder and read it back.

    This cuts lineage (a lost executor loses nothing that was stored) and keeps what is
    used twice from being computed twice. Columns are stored under their positions, so
    names that differ only in case don't clash.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/scribelens-{what}-{uuid.uuid4().hex}"
    names = df.columns
    plain = df.toDF(*(f"c{i}" for i in range(len(names))))
    plain.write.parquet(path)
    out = spark.read.schema(plain.schema).parquet(path).toDF(*names)
    out._scribelens_path = path
    return out


def release(*tables: DataFrame) -> None:
    """Delete stored tables that nothing needs any more; what was made of them must be stored itself."""
    for df in tables:
        path = df.sparkSession.sparkContext._jvm.org.apache.hadoop.fs.Path(df._scribelens_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def bytes_of(column: Column) -> Column:
    """UTF-8 bytes of a text; null counts as empty."""
    return F.coalesce(column.cast("binary"), F.lit("").cast("binary"))


def flat(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a binary array as one array, and where each text starts (one more entry for the end)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    _, starts, data = texts.buffers()
    kind = np.int64 if pa.types.is_large_binary(texts.type) else np.int32
    at = np.frombuffer(starts, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    if data is None or at[-1] == at[0]:
        return np.zeros(0, np.uint8), at - at[0]
    return np.frombuffer(data, np.uint8)[at[0] : at[-1]], at - at[0]


def pieces(texts: pa.Array, most: int = 4 << 20):
    """Runs of whole texts of about ``most`` bytes, so that work arrays stay small; a longer text comes alone."""
    lengths = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    begin = 0
    total = 0
    for i, n in enumerate(lengths):
        if total and total + n > most:
            yield texts.slice(begin, i - begin)
            begin, total = i, 0
        total += int(n)
    if begin < len(texts):
        yield texts.slice(begin)


def held_out(id_column: Column, mod: int, rest: int) -> Column:
    """True where crc32 of the id as text leaves ``rest`` mod ``mod``; a null id counts as an empty text."""
    return F.crc32(bytes_of(id_column.cast("string"))) % F.lit(mod) == F.lit(rest)


def temporary(df: DataFrame, *wanted: str) -> list[str]:
    """Column names like those wanted that ``df`` doesn't have, whatever the case."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in wanted:
        new = f"_sl_{name}"
        while new.lower() in taken:
            new += "_"
        taken.add(new.lower())
        out.append(new)
    return out
