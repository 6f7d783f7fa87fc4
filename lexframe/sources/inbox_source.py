"""The inbox as a Spark data source: ``spark.read.format("lex_inbox")`` and ``readStream``.

Each text file of the folder is one row (name, size, modified, content); a file that is no UTF-8
has its content read as GB18030. A few files are a partition each; of many, neighbours share one. A stream takes the files that were not
there at its last offset, in the order of their names; an offset is the last name taken.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from datetime import datetime

from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

SCHEMA = "name string, size long, modified timestamp, content string"
#: What an inbox takes, and the encodings it tries.
SUFFIXES = (".txt", ".md")
ENCODINGS = ("utf-8", "gb18030")
#: Up to so many files are a partition each, and no partition has more files or bytes than these.
SINGLE_FILES = 64
PACK_FILES = 2_000
PACK_BYTES = 64 << 20


class Pack(InputPartition):
    """The (path, name) of files that one task reads, one after the other."""

    def __init__(self, files: list[tuple[str, str]]):
        super().__init__(tuple(files))


def _packs(files: list[tuple[str, str, int]]) -> list[Pack]:
    """Files in their order, dealt to partitions of at most as many files and bytes as a task should read. Of up to
    SINGLE_FILES files, and of larger ones, each has its own."""
    most = min(PACK_FILES, -(-len(files) // SINGLE_FILES)) if files else 1
    packs, pack, held = [], [], 0
    for path, name, size in files:
        if pack and (len(pack) >= most or held + size > PACK_BYTES):
            packs.append(Pack(pack))
            pack, held = [], 0
        pack.append((path, name))
        held += size
    return packs + [Pack(pack)] if pack else packs


def _files(folder: str) -> list[tuple[str, str, int]]:
    """(path, name, size) of the inbox files, sorted by name, in any file system that Arrow knows."""
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    found = system.get_file_info(fs.FileSelector(path, allow_not_found=True))
    return sorted(((f.path, f.base_name, f.size) for f in found if f.is_file and f.base_name.endswith(SUFFIXES)), key=lambda f: f[1])


def _decoded(raw: bytes) -> str:
    for encoding in ENCODINGS:
        try:
            return raw.decode(encoding)
        except UnicodeDecodeError:
            continue
    return raw.decode(ENCODINGS[0], "replace")


def _rows(folder: str, part: Pack) -> Iterator[tuple[str, int, datetime | None, str]]:
    system = fs.FileSystem.from_uri(folder)[0] if "://" in folder else fs.LocalFileSystem()
    for path, name in part.value:
        info = system.get_file_info(path)
        with system.open_input_stream(path) as file:
            yield name, info.size, info.mtime, _decoded(file.read())


class InboxReader(DataSourceReader):
    def __init__(self, folder: str):
        self.folder = folder

    def partitions(self) -> list[Pack]:
        return _packs(_files(self.folder))

    def read(self, partition: Pack) -> Iterator[tuple]:
        # An empty folder has one partition without a file.
        return iter(()) if partition is None else _rows(self.folder, partition)


class InboxStream(DataSourceStreamReader):
    def __init__(self, folder: str):
        self.folder = folder

    def initialOffset(self) -> dict:
        return {"after": ""}

    def latestOffset(self) -> dict:
        names = [name for _, name, _ in _files(self.folder)]
        return {"after": names[-1] if names else ""}

    def partitions(self, start: dict, end: dict) -> list[Pack]:
        return _packs([f for f in _files(self.folder) if start["after"] < f[1] <= end["after"]])

    def read(self, partition: Pack) -> Iterator[tuple]:
        return _rows(self.folder, partition)

    def commit(self, end: dict) -> None:
        """Files stay where they are."""


class InboxSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "lex_inbox"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema) -> InboxReader:
        return InboxReader(self.options["path"])

    def streamReader(self, schema) -> InboxStream:
        return InboxStream(self.options["path"])


def put_files(folder: str, files: Iterable[tuple[str, str]]) -> None:
    """Writes named texts into an inbox; a file that is there is replaced."""
    system, path = fs.FileSystem.from_uri(folder) if "://" in folder else (fs.LocalFileSystem(), folder)
    system.create_dir(path, recursive=True)
    for name, text in files:
        with system.open_output_stream(f"{path}/{name}") as file:
            file.write((text or "").encode())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(InboxSource)
