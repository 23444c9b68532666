"""Binary files written by tasks into a folder that every executor sees, and read back by Spark."""

from __future__ import annotations

import uuid
from urllib.parse import urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession

from rasterloom.runtime import work_folder


def output_folder(spark: SparkSession, name: str) -> str:
    """A fresh folder URI below the session's shared folder."""
    path = work_folder(spark, name)
    return path if urlparse(path).scheme else f"file://{path}"


def open_folder(uri: str) -> tuple[fs.FileSystem, str]:
    """The file system of a folder URI and the folder's path in it; called inside the task."""
    found, path = fs.FileSystem.from_uri(uri)
    found.create_dir(path, recursive=True)
    return found, path


def put(found: fs.FileSystem, path: str, name: str, content: bytes) -> None:
    """Write one file under its final name in one step: a reader never sees half a file, and a retried
    or doubled task replaces it by the same bytes."""
    hidden = f"{path}/_{uuid.uuid4().hex}"
    with found.open_output_stream(hidden) as out:
        out.write(content)
    found.move(hidden, f"{path}/{name}")


def read_files(spark: SparkSession, folder: str, glob: str) -> DataFrame:
    """(path, content) of the files of a folder; files starting with an underscore are unfinished."""
    return spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder).select("path", "content")
