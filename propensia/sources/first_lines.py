"""First lines of many files by a data source whose partitions each open their share of the files."""

from __future__ import annotations

import codecs
from collections.abc import Iterator, Sequence
from urllib.parse import unquote, urlparse

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

CHUNK = 1 << 14
"""Bytes read at a time until the first line is whole."""

FILES_PER_TASK = 64


def _locate(uri: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI as Spark lists it (escaped, ``file:/`` with one slash)."""
    parts = urlparse(uri)
    if parts.scheme in ("", "file"):
        return fs.LocalFileSystem(), unquote(parts.path) if parts.scheme else uri
    store, path = fs.FileSystem.from_uri(uri)
    return store, unquote(path)


def can_open(uri: str) -> bool:
    """Whether tasks can open files of this store without Spark's own readers."""
    return urlparse(uri).scheme in ("", "file", "hdfs", "s3", "gs", "abfs", "abfss")


def first_line(uri: str, encoding: str) -> str:
    """The first line that is not blank, without its end; empty where there is none. Compression goes by the file's name."""
    store, path = _locate(uri)
    decoder, text = codecs.getincrementaldecoder(encoding)("replace"), ""
    with store.open_input_stream(path, compression="detect") as stream:
        while True:
            chunk = stream.read(CHUNK)
            text += decoder.decode(chunk, final=not chunk)
            text = text.removeprefix("\ufeff").lstrip("\r\n")
            ends = [at for at in (text.find("\n"), text.find("\r")) if at >= 0]
            if ends or not chunk:
                line = text[: min(ends)] if ends else text
                if line.strip() or not chunk:
                    return line if line.strip() else ""
                text = text[min(ends) :].lstrip("\r\n")  # a line of blanks is none


class _Files(InputPartition):
    def __init__(self, uris: list[str]):
        self.uris = uris


class _Reader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.uris, self.encoding = options["uris"].split("\n"), options["encoding"]

    def partitions(self) -> list[InputPartition]:
        return [_Files(self.uris[i : i + FILES_PER_TASK]) for i in range(0, len(self.uris), FILES_PER_TASK)]

    def read(self, partition: _Files) -> Iterator[tuple[str, str]]:
        for uri in partition.uris:
            yield uri, first_line(uri, self.encoding)


class FirstLines(DataSource):
    """``spark.read.format("first_lines").option("uris", <one per line>).option("encoding", ...)``"""

    @classmethod
    def name(cls) -> str:
        return "first_lines"

    def schema(self) -> str:
        return "path string, line string"

    def reader(self, schema) -> DataSourceReader:
        return _Reader(self.options)


def first_lines(spark: SparkSession, uris: Sequence[str], encoding: str) -> DataFrame:
    """(path, line) of the given files; files of one task are read one after the other."""
    spark.dataSource.register(FirstLines)
    return spark.read.format("first_lines").option("uris", "\n".join(uris)).option("encoding", encoding).load()
