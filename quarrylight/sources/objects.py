"""A sink of whole objects, one file for each row, that appear together or not at all."""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from concurrent.futures import ThreadPoolExecutor
from dataclasses import dataclass
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage

from ..operators.joins import spread

#: Fixed suffixes that are stored.
SUFFIXES = (".pdf", ".docx", ".txt", ".html")
#: Objects that are moved at once when a job commits.
MOVERS = 16
#: Folders that a task which lists them hands on at once.
LISTED = 4096


def object_path(owner: Column, item: Column, file_name: Column, suffixes: tuple[str, ...] = SUFFIXES) -> Column:
    """owner/item/original.suffix with both names quoted, so that none leaves its owner's folder; null for a suffix
    that isn't stored, and for null names."""
    suffix = F.lower(F.regexp_extract(file_name, r"[^/\\\\](\.[^./\\\\]+)$", 1))
    one = lambda c: F.replace(F.url_encode(c.cast("string")), F.lit("+"), F.lit("%20"))
    return F.when(suffix.isin(*suffixes), F.concat(one(owner), F.lit("/"), one(item), F.lit("/original"), suffix))


@dataclass
class Staged(WriterCommitMessage):
    """What a task has written: its folder, and a list of its objects beside them."""

    folder: str
    count: int


class ObjectFiles(DataSource):
    """Writes rows (path string, content binary) as files below the option "root", a URI that all tasks reach.

    Each task writes below a folder of its own under root/_staged and lists its objects there; a task that fails
    removes its folder, so an attempt leaves nothing. When all have ended the driver moves the objects to their places,
    task by task; when one has failed for good it removes what the others had staged. An object that is there already
    is replaced. Paths are relative, without empty or dotted parts; two rows of one path are an error of their task, or
    the later task's object stays.
    """

    @classmethod
    def name(cls) -> str:
        return "object_files"

    def schema(self) -> str:
        return "path string, content binary"

    def writer(self, schema, overwrite: bool) -> DataSourceWriter:
        return ObjectWriter(self.options["root"])


class ObjectWriter(DataSourceWriter):
    def __init__(self, root: str):
        self.root, self.job = root.rstrip("/"), f"_staged/{uuid.uuid4().hex}"

    def _files(self):
        from pyarrow import fs

        return fs.FileSystem.from_uri(self.root)

    def write(self, rows: Iterator) -> Staged:
        files, base = self._files()
        context = TaskContext.get()
        folder = f"{self.job}/{context.partitionId() if context else 0}-{uuid.uuid4().hex}"
        written: dict[str, None] = {}
        try:
            for row in rows:
                path = row["path"]
                if not path or any(p in ("", ".", "..") for p in path.split("/")) or path in written:
                    raise ValueError(f"not an object's path, or one that was written before: {path}")
                files.create_dir(f"{base}/{folder}/{path.rpartition('/')[0]}", recursive=True)
                with files.open_output_stream(f"{base}/{folder}/{path}") as out:
                    out.write(bytes(row["content"] or b""))
                written[path] = None
            files.create_dir(f"{base}/{folder}", recursive=True)
            with files.open_output_stream(f"{base}/{folder}/_objects") as out:
                out.write("\n".join(written).encode())
        except BaseException:
            self._drop(files, f"{base}/{folder}")
            raise
        return Staged(folder, len(written))

    def commit(self, messages: list[Staged | None]) -> None:
        files, base = self._files()

        def move(folder: str, path: str) -> None:
            files.create_dir(f"{base}/{path}".rpartition("/")[0], recursive=True)
            files.move(f"{base}/{folder}/{path}", f"{base}/{path}")

        with ThreadPoolExecutor(MOVERS) as pool:
            for m in filter(None, messages):  # one task's list at a time
                with files.open_input_stream(f"{base}/{m.folder}/_objects") as listed:
                    paths = listed.read().decode().split("\n")
                list(pool.map(lambda p, f=m.folder: move(f, p), filter(None, paths)))
        self._drop(files, f"{base}/{self.job}")

    def abort(self, messages: list[Staged | None]) -> None:
        files, base = self._files()
        self._drop(files, f"{base}/{self.job}")

    @staticmethod
    def _drop(files, folder: str) -> None:
        from pyarrow import fs

        if files.get_file_info(folder).type != fs.FileType.NotFound:
            files.delete_dir(folder)


def write_objects(rows: DataFrame, root: str) -> None:
    """Store (path, content) rows below `root`; rows without a path are left out. See ObjectFiles."""
    rows.sparkSession.dataSource.register(ObjectFiles)
    rows.filter("path is not null").select("path", "content").write.format("object_files").option("root", root).mode("append").save()


def read_objects(spark: SparkSession, root: str) -> DataFrame:
    """(path, length, content) of every object owner/item/name below `root`, with paths relative to it.

    Folders are listed level by level in tasks and objects are read where they are dealt to, so that neither names nor
    contents pass the driver. Names that begin with an underscore or a dot are no objects.
    """

    def files():
        from pyarrow import fs

        return fs.FileSystem.from_uri(root.rstrip("/"))

    def entries(folder: str, kind: str) -> list[str]:
        from pyarrow import fs

        store, base = files()
        found = store.get_file_info(fs.FileSelector(f"{base}/{folder}".rstrip("/")))
        return [f"{folder}/{x.base_name}".lstrip("/") for x in found if x.type == fs.FileType[kind] and x.base_name[0] not in "_."]

    def folders(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for folder in (f for b in batches for f in b.column(0).to_pylist()):
            found = entries(folder, "Directory")
            for at in range(0, len(found), LISTED):
                yield pa.RecordBatch.from_pydict({"folder": found[at : at + LISTED]})

    def contents(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = files()
        for path in (p for b in batches for f in b.column(0).to_pylist() for p in entries(f, "File")):
            with store.open_input_file(f"{base}/{path}") as data:
                content = data.read()
            yield pa.RecordBatch.from_arrays([pa.array([path]), pa.array([len(content)], pa.int64()), pa.array([content], pa.binary())], names=["path", "length", "content"])

    owners = spark.createDataFrame([("",)], "folder string").mapInArrow(folders, "folder string")
    items = spread(owners, "folder").mapInArrow(folders, "folder string")
    return spread(items, "folder").mapInArrow(contents, "path string, length long, content binary")


def quoted_name(name: str) -> str:
    """How object_path() writes a name."""
    return quote(name, safe="*")
