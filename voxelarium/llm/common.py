"""Helpers that the operators share: the shared folder, written tables, word splitting."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from ..runtime import materialize, numbered, shared_dir

__all__ = ["WORD_PATTERN", "let", "local_file", "materialize", "new_path", "numbered", "remove_path", "shared_dir", "words_of"]

#: A word is a run of characters other than these (fixed value of the contracts).
WORD_PATTERN = r"[^\x20\x09-\x0D]+"
_WHITE_SPACE = " \t\n\x0b\x0c\r"

def new_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that nothing has used before."""
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def remove_path(spark: SparkSession, path: str) -> None:
    """Delete a folder that ``new_path`` gave, once nothing reads it any more."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)


def let(value: Column, then) -> Column:
    """``then(value)`` with ``value`` evaluated once, for expressions that use it many times."""
    return F.transform(F.array(value), then)[0]


def words_of(text: Column) -> Column:
    """The words of a text as an array; null has none."""
    spaced = F.translate(F.coalesce(text, F.lit("")), _WHITE_SPACE, " " * len(_WHITE_SPACE))
    return F.array_remove(F.split(spaced, " "), "")


def local_file(uri: str):
    """``(filesystem, path)`` of a URI, for reading and writing binary files in tasks."""
    from pyarrow import fs

    return fs.FileSystem.from_uri(uri.replace("file:/", "file:///", 1) if uri.startswith("file:/") and not uri.startswith("file://") else uri)
