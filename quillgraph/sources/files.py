"""Files of a folder as rows: path from the folder, and text."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

# Folders that are never looked into, and the greatest file.
IGNORED = ("node_modules", "dist", "build", "target", "vendor")
MOST_BYTES = 1 << 20


def read_files(spark: SparkSession, folder: str, extensions: tuple[str, ...] = ("md",), ignore: tuple[str, ...] = IGNORED, most: int = MOST_BYTES) -> DataFrame:
    """path (from the folder) and text of the files with these extensions, outside hidden and ignored folders, of at most ``most`` bytes.

    Bytes that are no UTF-8 become U+FFFD."""
    at = spark._jvm.org.apache.hadoop.fs.Path(folder)
    root = at.getFileSystem(spark._jsc.hadoopConfiguration()).makeQualified(at).toString().rstrip("/") + "/"
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.{" + ",".join(extensions) + "}").load(root)
    path = F.substring("path", len(root) + 1, 1 << 20)
    parts = F.split(F.col("path"), "/")
    hidden = F.exists(parts, lambda p: F.startswith(p, F.lit(".")) | p.isin(*ignore))
    return found.filter(F.col("length") <= most).select(path.alias("path"), F.make_valid_utf8(F.col("content").cast("string")).alias("text")).filter(~hidden)


def read_notes(spark: SparkSession, folder: str, asciidoc: bool = False) -> DataFrame:
    return read_files(spark, folder, ("md", "adoc") if asciidoc else ("md",))
