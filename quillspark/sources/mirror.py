"""A tree of files as a sink: format("mirror"), by Spark's Python data source API.

Tasks write each row (path, content) into a tree beside the target: under another name first, then in one step under its own,
so that a task which is run again, or twice at once, leaves whole files and the same ones. The job's commit gives the tree the
target's name; until then, and where the job fails, the target stays as it was. The driver moves one folder, however many
files it holds.
"""

from __future__ import annotations

import posixpath
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceWriter, WriterCommitMessage
from pyspark.sql.types import StructType

_UNDER_WAY = ".under-way"


@dataclass
class Written(WriterCommitMessage):
    files: int


class MirrorWriter(DataSourceWriter):
    def __init__(self, folder: str, overwrite: bool, columns: list[str]):
        if columns != ["path", "content"]:
            raise ValueError(f"a mirror has columns path and content, not {', '.join(columns)}")
        self.folder, self.overwrite = folder.rstrip("/"), overwrite
        self.staged = f"{self.folder}.{uuid.uuid4().hex}"

    def _there(self, folder: str) -> bool:
        store, path = fs.FileSystem.from_uri(folder)
        return store.get_file_info(path).type != fs.FileType.NotFound

    def write(self, iterator: Iterator[Row]) -> Written:
        store, staged = fs.FileSystem.from_uri(self.staged)
        own, files, made = f"{staged}/{_UNDER_WAY}/{uuid.uuid4().hex}", 0, set()
        store.create_dir(own)
        for path, content in iterator:
            if path.startswith("/") or ".." in path.split("/") or posixpath.normpath(path) != path:
                raise ValueError(f"{path!r} is no path within the mirror")
            target = f"{staged}/{path}"
            if posixpath.dirname(target) not in made:
                made.add(posixpath.dirname(target))
                store.create_dir(posixpath.dirname(target))
            with store.open_output_stream(f"{own}/file") as out:
                out.write(content.encode())
            store.move(f"{own}/file", target)
            files += 1
        store.delete_dir(own)
        return Written(files)

    def commit(self, messages: list[WriterCommitMessage | None]) -> None:
        store, staged = fs.FileSystem.from_uri(self.staged)
        target = fs.FileSystem.from_uri(self.folder)[1]
        store.create_dir(staged)  # of no rows, an empty tree
        if self._there(f"{self.staged}/{_UNDER_WAY}"):
            store.delete_dir(f"{staged}/{_UNDER_WAY}")  # what attempts that were killed left
        if self._there(self.folder):
            if not self.overwrite:
                self.abort(messages)
                raise FileExistsError(f"{self.folder} is there already; overwrite replaces it")
            old = f"{target}.{uuid.uuid4().hex}"
            store.move(target, old)
            store.move(staged, target)
            store.delete_dir(old)
        else:
            store.move(staged, target)

    def abort(self, messages: list[WriterCommitMessage | None]) -> None:
        if self._there(self.staged):
            store, staged = fs.FileSystem.from_uri(self.staged)
            store.delete_dir(staged)


class Mirror(DataSource):
    """Sink of rows (path, content): mode append makes a tree where none is, overwrite replaces it. The folder's store must be
    one that all executors and the driver reach."""

    @classmethod
    def name(cls) -> str:
        return "mirror"

    def writer(self, schema: StructType, overwrite: bool) -> MirrorWriter:
        return MirrorWriter(self.options["path"], overwrite, schema.names)


def register(spark: SparkSession) -> None:
    spark.dataSource.register(Mirror)


def one_a_path(files: DataFrame, *keys: str) -> DataFrame:
    """path, content: of rows with one path the one with the smallest keys, in their order and nulls last, then content; files:
    path, content, keys."""
    order = [c for k in keys for c in (F.col(k).isNull(), F.col(k))]
    best = F.min_by("content", F.struct(*order, "content")).alias("content")
    return files.groupBy("path").agg(best)


def both_file_and_folder(files: DataFrame) -> DataFrame:
    """path of the files that others would have as a folder."""
    parts = F.split("path", "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, F.lit(1), n), "/"))
    nested = files.where(F.col("path").contains("/")).select(F.explode(folders).alias("path"))
    return files.select("path").join(nested.distinct(), "path", "left_semi")


def write_mirror(files: DataFrame, folder: str, key: str = "url", overwrite: bool = False) -> None:
    """Files (path, content and a key) as a tree, whole or not at all; of rows with one path the smallest key's is written. A file
    that others would have as a folder is an error, before anything is written."""
    rows = one_a_path(files, key)
    clash = both_file_and_folder(rows).first()
    if clash is not None:
        raise ValueError(f"{clash['path']} would be a file and a folder")
    register(files.sparkSession)
    rows.select("path", "content").write.format("mirror").mode("overwrite" if overwrite else "append").save(folder)
