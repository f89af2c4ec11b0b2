"""Reading of file trees: what is there, how big, and of what content."""

from __future__ import annotations

import hashlib
import os
from collections import deque
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from itertools import islice
from typing import BinaryIO
from urllib.parse import quote

import pyarrow
import pyarrow.fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

BLOCK, LINE_BLOCK = 2**20, 2**13
# Folders that the driver looks for before tasks walk one each, and files of folders it has seen in one task.
FOLDERS, FILES_PER_TASK = 64, 64
ROWS_PER_BATCH = 1000
# Names that a store has in Spark and in Arrow.
SCHEMES = {"s3a": "s3", "s3n": "s3"}


class Tree:
    """A folder of a local file system or of a store that Arrow knows, and what is in it."""

    def __init__(self, root: str):
        scheme, _, rest = root.partition(":")
        self.store = None
        if scheme == "file" or root.startswith("/") or not _:
            self.base = os.path.abspath("/" + rest.lstrip("/") if scheme == "file" else root)
        else:
            self.store, self.base = pyarrow.fs.FileSystem.from_uri(f"{SCHEMES.get(scheme, scheme)}:{quote(rest)}")

    def at(self, name: str) -> str:
        return f"{self.base.rstrip('/')}/{name}" if name else self.base

    def kind(self) -> str:
        """What the root is: folder, file or nothing."""
        if self.store is None:
            return "folder" if os.path.isdir(self.base) else "file" if os.path.isfile(self.base) else "nothing"
        found = self.store.get_file_info(self.base).type
        return {pyarrow.fs.FileType.Directory: "folder", pyarrow.fs.FileType.File: "file"}.get(found, "nothing")

    def children(self, folder: str) -> tuple[list[str], list[str]]:
        """Folders and files of a folder by relative name, sorted. Links to folders are neither, so that none is walked twice."""
        lead = f"{folder}/" if folder else ""
        if self.store is None:
            try:
                with os.scandir(self.at(folder)) as entries:
                    found = [(lead + e.name, e.is_dir(follow_symlinks=False), e.is_symlink() and e.is_dir()) for e in entries]
            except OSError:
                return [], []
            return sorted(n for n, is_folder, _ in found if is_folder), sorted(n for n, is_folder, link in found if not is_folder and not link)
        infos = self.store.get_file_info(pyarrow.fs.FileSelector(self.at(folder)))
        folders = [lead + i.base_name for i in infos if i.type == pyarrow.fs.FileType.Directory]
        return sorted(folders), sorted(lead + i.base_name for i in infos if i.type != pyarrow.fs.FileType.Directory)

    def size(self, name: str) -> int | None:
        try:
            return os.stat(self.at(name)).st_size if self.store is None else self.store.get_file_info(self.at(name)).size
        except OSError:
            return None

    def open(self, name: str) -> BinaryIO:
        return open(self.at(name), "rb") if self.store is None else self.store.open_input_stream(self.at(name))

    def first_line(self, name: str) -> bytes:
        """A file up to its first line end, read block by block."""
        found = b""
        with self.open(name) as file:
            while b"\n" not in found and (block := file.read(LINE_BLOCK)):
                found += block
        return found.partition(b"\n")[0].rstrip(b"\r")

    def sha256(self, name: str) -> str | None:
        """The hash of a file read block by block; none where it cannot be read."""
        digest = hashlib.sha256()
        try:
            with self.open(name) as file:
                while block := file.read(BLOCK):
                    digest.update(block)
        except OSError:
            return None
        return digest.hexdigest()

    def walk(self, folder: str) -> Iterator[str]:
        """Every file below a folder; what is still to be walked is one list of names per level."""
        waiting = [folder]
        while waiting:
            folders, files = self.children(waiting.pop())
            yield from files
            waiting.extend(reversed(folders))


@dataclass
class TreePart(InputPartition):
    """A folder to walk, or files that were met on the way to folders."""

    folder: str | None
    files: list[str]


class FileTreeReader(DataSourceReader):
    def __init__(self, root: str, hashed: bool):
        self.root, self.hashed = root, hashed

    def partitions(self) -> list[TreePart]:
        """Breadth first until there are enough folders for tasks, or no folder is left to open."""
        tree = Tree(self.root)
        if tree.kind() != "folder":
            return [TreePart(None, [""] if tree.kind() == "file" else [])]
        folders, files = deque([""]), []
        while folders and len(folders) < FOLDERS:
            below, here = tree.children(folders.popleft())
            folders.extend(below)
            files.extend(here)
        parts = [TreePart(None, files[at : at + FILES_PER_TASK]) for at in range(0, len(files), FILES_PER_TASK)]
        return [*parts, *[TreePart(folder, []) for folder in folders]] or [TreePart(None, [])]

    def read(self, partition: TreePart) -> Iterator[pyarrow.RecordBatch]:
        tree = Tree(self.root)
        names = iter(partition.files) if partition.folder is None else tree.walk(partition.folder)
        while some := list(islice(names, ROWS_PER_BATCH if not self.hashed else 1)):
            hashes = [tree.sha256(name) for name in some] if self.hashed else []
            sizes = [None if self.hashed and hashes[i] is None else tree.size(name) for i, name in enumerate(some)]
            columns = [pyarrow.array([name or tree.base.rpartition("/")[2] for name in some], pyarrow.string()), pyarrow.array(sizes, pyarrow.int64())]
            columns += [pyarrow.array(hashes, pyarrow.string())] if self.hashed else []
            yield pyarrow.record_batch(columns, names=["name", "size", "sha256"][: len(columns)])


class FileTree(DataSource):
    """`spark.read.format("file_tree").load(root)`: every file below a root by relative name, with its size.

    Empty files and those whose name begins with `_` or `.` are listed like any other. With the option
    `hash` each file is opened by the task that lists it and has its sha256; one that cannot be read keeps its
    row with nulls. A root that is a file is one row, one that is not there is none.
    """

    @classmethod
    def name(cls) -> str:
        return "file_tree"

    def hashed(self) -> bool:
        return self.options.get("hash", "false").lower() == "true"

    def schema(self) -> str:
        return "name string, size bigint" + (", sha256 string" if self.hashed() else "")

    def reader(self, schema: StructType) -> FileTreeReader:
        return FileTreeReader(self.options["path"], self.hashed())


def list_files(spark: SparkSession, root: str, hashed: bool = False) -> DataFrame:
    """Every file below a folder by relative name, with its size; contents are not opened unless hashes are asked for."""
    spark.dataSource.register(FileTree)
    return spark.read.format("file_tree").option("hash", str(hashed).lower()).load(root)


def file_inventory(spark: SparkSession, root: str) -> DataFrame:
    """Relative name, hash and size of every file, hashed block by block whatever its length; see `FileTree`."""
    return list_files(spark, root, True).select("name", "sha256", "size")


def dataset_listing(spark: SparkSession, root: str, ignored: Sequence[str] = ()) -> DataFrame:
    """Per tool and kind of a tree tool/kind/entry: the visible entries, file or folder, with all their bytes."""
    parts = F.split("name", "/")
    entry = F.get(parts, 2)
    return list_files(spark, root).filter(
        (F.size(parts) >= 3) & ~F.startswith(entry, F.lit(".")) & ~entry.isin(list(ignored))).groupBy(
        F.get(parts, 0).alias("tool"), F.get(parts, 1).alias("kind"), entry.alias("entry")).agg(
        F.max(F.when(F.size(parts) > 3, "folder").otherwise("file")).alias("type"), F.sum("size").alias("bytes"))


def campaign_index(spark: SparkSession, pattern: str) -> DataFrame:
    """One row per readable campaign summary: its file, when it was made, its arms and bytes, newest first."""
    files = spark.read.format("binaryFile").load(pattern)
    report = F.from_json(F.decode("content", "UTF-8"), "generated_at double, arms array<string>")
    return files.filter(F.schema_of_variant(F.try_parse_json(F.decode("content", "UTF-8"))).startswith("OBJECT")).select(
        F.regexp_extract("path", "([^/]*)$", 1).alias("source"), F.col("path"), report.alias("r"), F.col("length").alias("bytes")).select(
        "source", "path", "r.generated_at", F.greatest(F.size("r.arms"), F.lit(0)).alias("arms"), "bytes").orderBy(
        F.coalesce("generated_at", F.lit(0)).desc(), "source")
