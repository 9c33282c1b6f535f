"""Text files as documents: doc_id, path, text."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

SUFFIXES = (".txt", ".md", ".markdown", ".rst", ".text")


def read_texts(spark: SparkSession, paths: str | list[str], suffixes: Iterable[str] = SUFFIXES) -> DataFrame:
    """Files of a folder and all below, or single files; suffixes in any case. One row a file.

    A single file named outright is read whatever its suffix. Bytes that are not UTF-8 become U+FFFD.
    ``doc_id`` is a hash of the path, so it needs no ordering of the files and stays the same later."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    if not paths:
        raise FileNotFoundError("no path given")
    raw = spark.read.option("recursiveFileLookup", "true").text(paths, wholetext=True)
    out = raw.select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("text"))
    wanted = F.lower("path").rlike("(" + "|".join(s.replace(".", r"\.") for s in suffixes) + r")\z")
    named = [F.col("path").endswith(p.rsplit("://", 1)[-1]) for p in paths if "." in p.rsplit("/", 1)[-1]]
    for n in named:
        wanted = wanted | n
    return out.filter(wanted).select(F.xxhash64("path").alias("doc_id"), "path", "text")


def from_texts(spark: SparkSession, texts: Iterable[tuple[str, str]]) -> DataFrame:
    """Documents of (path, text) pairs in memory, numbered from 0."""
    return spark.createDataFrame([(i, p, t) for i, (p, t) in enumerate(texts)], "doc_id long, path string, text string")
