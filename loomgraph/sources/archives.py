"""Files of ZIP archives as rows: tasks read the archives' directories, the members are dealt out, and tasks read and unpack their ranges.

No archive is loaded whole, so its size doesn't matter, and one with very many members is shared among tasks.
"""

from __future__ import annotations

import zipfile
import zlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.functions.text import is_binary
from loomgraph.sources.folders import list_folder, opened

_MEMBERS = pa.schema([("archive", pa.string()), ("place", pa.string()), ("nth", pa.int64()), ("path", pa.string()), ("at", pa.int64()), ("packed", pa.int64()), ("size", pa.int64()), ("crc", pa.int64()), ("method", pa.int32()), ("locked", pa.bool_())])
_FILES = pa.schema([("archive", pa.string()), ("path", pa.string()), ("text", pa.string()), ("failed", pa.bool_())])
#: A text of more bytes can't be a value of a row; such members are marked failed.
MOST_BYTES = 1 << 30


def name_of(m: zipfile.ZipInfo) -> str:
    """A member's name: UTF-8 where the archive says so or where its bytes are, else CP437; forward slashes, from the root."""
    name = m.filename
    if not m.flag_bits & 0x800:  # the module read these bytes as CP437
        try:
            name = name.encode("cp437").decode("utf-8")
        except UnicodeError:
            pass
    return name.replace("\\", "/").removeprefix("./").lstrip("/")


def members(spark: SparkSession, folder: str, ending: str = ".zip") -> DataFrame:
    """archive (its path from the folder), place, nth, path, and where and how a member lies, of all files in the archives below a folder; a row without a path for
    a file that is no archive. Only the directories at the archives' ends are read."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(folder)
        for batch in batches:
            for archive, place in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                try:
                    with fs.open_input_file(place) as f:
                        known = zipfile.ZipFile(f).infolist()
                except (zipfile.BadZipFile, pa.ArrowInvalid):  # the latter where a file is shorter than any archive
                    yield pa.RecordBatch.from_pylist([{"archive": archive, "place": place}], _MEMBERS)
                    continue
                for k in range(0, len(known), 10_000):
                    yield pa.RecordBatch.from_pylist([
                        {"archive": archive, "place": place, "nth": k + n, "path": name_of(m), "at": m.header_offset, "packed": m.compress_size, "size": m.file_size, "crc": m.CRC, "method": m.compress_type, "locked": bool(m.flag_bits & 1)}
                        for n, m in enumerate(known[k : k + 10_000]) if not m.is_dir()], _MEMBERS)

    listing = list_folder(spark, folder, every=True).where(F.lower("path").endswith(ending))
    kinds = {pa.string(): "string", pa.int64(): "long", pa.int32(): "int", pa.bool_(): "boolean"}
    rows = listing.select("path", "place").mapInArrow(run, ", ".join(f"{f.name} {kinds[f.type]}" for f in _MEMBERS))
    last = F.substring_index("path", "/", -1)
    return rows.where(F.col("path").isNull() | ((last != "") & ~F.col("path").startswith("__MACOSX/") & ~last.startswith("._") & (last != ".DS_Store")))


def unpacked(f, m: dict) -> bytes | None:
    """A member's bytes; None if it is locked, packed by another method, too long or damaged."""
    if m["locked"] or m["method"] not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED) or m["size"] > MOST_BYTES:
        return None
    f.seek(m["at"])
    head = f.read(30)
    if head[:4] != b"PK\x03\x04" or len(head) < 30:
        return None
    f.seek(m["at"] + 30 + int.from_bytes(head[26:28], "little") + int.from_bytes(head[28:30], "little"))  # past its name and extra fields
    data = f.read(m["packed"])
    if m["method"] == zipfile.ZIP_DEFLATED:
        try:
            data = zlib.decompressobj(-15).decompress(data, m["size"] + 1)
        except zlib.error:
            return None
    return data if len(data) == m["size"] and zlib.crc32(data) == m["crc"] else None


def read_zips(spark: SparkSession, folder: str, ending: str = ".zip") -> DataFrame:
    """archive, path, text and failed of each file in the archives below a folder. A folder that all files of an archive share is cut off;
    binary files go; members that can't be read, and archives that aren't any (null path), are marked failed."""
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fs, _ = opened(folder)
        place, f = None, None
        for batch in batches:
            for m in batch.to_pylist():
                data = None
                if m["path"] is not None:
                    if m["place"] != place:
                        if f is not None:
                            f.close()
                        place, f = m["place"], fs.open_input_file(m["place"])
                    data = unpacked(f, m)
                yield pa.RecordBatch.from_pylist([{"archive": m["archive"], "path": m["path"], "text": None if data is None else data.decode("utf-8", "replace"), "failed": data is None}], _FILES)
        if f is not None:
            f.close()

    rows = members(spark, folder, ending)
    first = F.substring_index("path", "/", 1)
    roots = rows.where("path is not null").groupBy("archive").agg(((F.min(first) == F.max(first)) & F.every(F.contains("path", F.lit("/")))).alias("shared"))
    cut = F.when(F.col("shared"), F.expr("substr(path, instr(path, '/') + 1)")).otherwise(F.col("path"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # named, else these short rows would be put together again
    dealt = rows.join(roots, "archive", "left").withColumn("path", cut).select(*_MEMBERS.names).repartition(tasks, "archive", "nth").sortWithinPartitions("archive", "at")
    return dealt.mapInArrow(run, "archive string, path string, text string, failed boolean").where(F.col("text").isNull() | ~is_binary(F.col("text")))
