"""Files that no reader opens: their signature and first bytes."""

from __future__ import annotations

from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from plumbline.sources.registry import Dataset, Options

# First bytes of formats.
SIGNATURES = (
    (b"PK\x03\x04", "ZIP container"), (b"\x1f\x8b", "gzip"), (b"BZh", "bzip2"), (b"\xfd7zXZ", "xz"), (b"7z\xbc\xaf", "7-Zip"), (b"Rar!", "RAR"), (b"\x89HDF", "HDF5"), (b"\x0e\x03\x13\x01", "HDF4"), (b"CDF", "NetCDF classic"), (b"GRIB", "GRIB"), (b"SIMPLE", "FITS"), (b"%PDF", "PDF"),
    (b"\x89PNG", "PNG"), (b"\xff\xd8\xff", "JPEG"), (b"\x00\x00\x00\x0cjP  \r\n\x87\n", "JPEG 2000"), (b"\xffO\xffQ", "JPEG 2000"), (b"II*\x00", "TIFF"), (b"MM\x00*", "TIFF"), (b"PAR1", "Parquet"), (b"SQLite format 3", "SQLite / GeoPackage"), (b"\x7fELF", "ELF executable"), (b"ARROW1", "Arrow IPC"), (b"\x93NUMPY", "NumPy .npy"), (b"\x80", "Python pickle (not opened: unsafe)"),
)


def signature(head: bytes) -> str:
    for magic, name in SIGNATURES:
        if head.startswith(magic):
            return name
    return "tar archive" if head[257:262] == b"ustar" else "unrecognised"


def read_unknown(spark: SparkSession, path: Path, options: Options) -> Dataset:
    head = b""
    if path.is_file():
        with open(path, "rb") as f:
            head = f.read(512)
    first = head[:64]
    return Dataset("binary", None, {"signature": signature(head), "first_bytes_hex": first.hex(" "), "first_bytes_ascii": "".join(chr(b) if 32 <= b < 127 else "." for b in first)})


def signatures(spark: SparkSession, pattern: str) -> DataFrame:
    """(path, length, signature) of many files at once, by Spark."""
    head = F.substring("content", 1, 512)
    named = F.coalesce(*[F.when(F.startswith(F.col("h"), F.lit(m)), F.lit(n)) for m, n in SIGNATURES], F.when(F.substring("h", 258, 5) == F.lit(b"ustar"), F.lit("tar archive")), F.lit("unrecognised"))
    return spark.read.format("binaryFile").load(pattern).select("path", "length", head.alias("h")).select("path", "length", named.alias("signature"))
