"""Files of a folder: walked in parallel, skipped folders never entered, only wanted files opened, with paths from its root.

The listing is a data source of its own: the driver walks just far enough to have folders to deal out, tasks walk these. What is wanted is
decided on the listed rows, and only then are contents read. Paths may be those of any file system that pyarrow opens by its address.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, In, InputPartition, StringStartsWith

from loomgraph.functions.paths import SKIP_DIRS, wanted
from loomgraph.functions.text import is_binary

#: No wanted file is longer, so longer ones are not read at all.
LONGEST = 800_000
#: Folders that the driver looks for before it deals them out, and bytes of contents in a batch.
FOLDERS, BATCH_BYTES = 64, 8 << 20
#: Folders in folders beyond which links in a circle are taken for the reason.
DEEPEST = 64


def opened(address: str):
    """The file system of an address, and the path in it."""
    from pyarrow.fs import FileSystem

    return FileSystem.from_uri(address if ":" in address.split("/")[0] else "file://" + address)


def entered(name: str) -> bool:
    """Whether a folder of that name is looked into."""
    return name not in SKIP_DIRS and (not name.startswith(".") or name == ".github")


@dataclass
class Part(InputPartition):
    """A folder (from the root), with all below it or its own files alone."""

    folder: str
    deep: bool


class FolderReader(DataSourceReader):
    def __init__(self, address: str, under: str, every: bool = False):
        self.address, self.starts, self.every = address, [under] if under else [], every

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        """Filters on path decide which folders are looked into; Spark applies them to rows, too."""
        for f in filters:
            if getattr(f, "attribute", None) == ("path",) and isinstance(f, (EqualTo, StringStartsWith, In)):
                self.starts = self._narrowed(list(f.value) if isinstance(f, In) else [f.value])
            yield f

    def _narrowed(self, more: list[str]) -> list[str]:
        both = [max(a, b, key=len) for a in self.starts or [""] for b in more if b is not None and (a.startswith(b) or b.startswith(a))]
        return both or ["\0"]  # nothing

    def may_hold(self, folder: str) -> bool:
        return not self.starts or any((folder + "/").startswith(s) or s.startswith(folder + "/") for s in self.starts)

    def listed(self, fs, base: str, folder: str) -> tuple[list[str], list[tuple[str, str, int]]]:
        """The folders and the files (path from the root, place, size) right in a folder."""
        from pyarrow.fs import FileSelector, FileType

        folders, files = [], []
        for e in fs.get_file_info(FileSelector(f"{base}/{folder}" if folder else base)):
            path = f"{folder}/{e.base_name}" if folder else e.base_name
            if e.type == FileType.Directory:
                if (self.every or entered(e.base_name)) and self.may_hold(path) and path.count("/") < DEEPEST:
                    folders.append(path)
            elif e.type == FileType.File:
                files.append((path, e.path, e.size))
        return folders, files

    def partitions(self) -> list[Part]:
        fs, base = opened(self.address)
        out, level = [], [""]
        while level and len(level) < FOLDERS:
            below = [f for x in level for f in self.listed(fs, base, x)[0]]
            out += [Part(x, False) for x in level]
            level = below
        return out + [Part(x, True) for x in level]

    def read(self, part: Part) -> Iterator[tuple[str, str, int]]:
        fs, base = opened(self.address)
        left = [part.folder]
        while left:
            folders, files = self.listed(fs, base, left.pop())
            yield from files
            if part.deep:
                left += folders


class FolderListing(DataSource):
    """path (from the root), place and size of the files below a folder, skipped folders apart. Options: path, under (a beginning of paths) and every (skipped folders, too)."""

    @classmethod
    def name(cls) -> str:
        return "folder_listing"

    def schema(self) -> str:
        return "path string, place string, size long"

    def reader(self, schema) -> FolderReader:
        return FolderReader(self.options["path"].rstrip("/"), self.options.get("under", ""), self.options.get("every", "false") == "true")


def list_folder(spark: SparkSession, folder: str, under: str = "", every: bool = False) -> DataFrame:
    """path, place and size of all files in folders that are looked into (every: in all); under: only paths that begin so. Sources in Python get filters
    only where the session says so, which this turns on."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(FolderListing)
    found = spark.read.format("folder_listing").option("under", under).option("every", str(every).lower()).load(folder)
    return found.where(F.col("path").startswith(under)) if under else found


def contents(listing: DataFrame, folder: str) -> DataFrame:
    """path and text of the listed files, opened one after the other in each task; bytes that aren't UTF-8 are replaced. Files that have gone meanwhile give no row."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(folder)
        path, text, size = [], [], 0
        made = lambda: pa.RecordBatch.from_arrays([pa.array(path, pa.string()), pa.array(text, pa.string())], names=["path", "text"])
        for batch in batches:
            for p, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with fs.open_input_stream(place) as f:
                        data = f.read()
                except FileNotFoundError:
                    continue
                path.append(p)
                text.append(data.decode("utf-8", "replace"))
                size += len(data)
                if size > BATCH_BYTES:
                    yield made()
                    path, text, size = [], [], 0
        yield made()

    return listing.select("path", "place").mapInArrow(run, "path string, text string")


def without_shared_root(files: DataFrame) -> DataFrame:
    """files with forward slashes in path, and without the first segment that all paths share, if they do."""
    files = files.withColumn("path", F.regexp_replace(F.replace(F.col("path"), F.lit("\\"), F.lit("/")), "^(\\./|/)+", ""))
    first = F.substring_index("path", "/", 1)
    root = files.agg(F.when((F.min(first) == F.max(first)) & F.every(F.contains("path", F.lit("/"))), F.min(first)).alias("_root"))  # one row
    cut = F.when(F.col("_root").isNull(), F.col("path")).otherwise(F.expr("substr(path, length(_root) + 2)"))
    return files.join(F.broadcast(root)).withColumn("path", cut).drop("_root")


def read_files(spark: SparkSession, folder: str, under: str = "") -> DataFrame:
    """path and text of the wanted text files below a folder, binaries apart."""
    listing = list_folder(spark, folder, under).where(F.col("size") <= LONGEST).where(wanted(F.col("path"), F.col("size")))
    rooted = without_shared_root(listing)  # by the listing, so no file is opened twice
    return contents(rooted, folder).where(~is_binary(F.col("text")))
