"""WARC records in ZIP archives: written by tasks, and read back by ranges, without extraction.

An archive is a ZIP whose members are stored, not compressed: `archive/*.warc.gz` (each record a gzip member of its own) and
`indexes/index.cdxj` (a line per record with its offset and length). A reader parses the end record, the ZIP64 one where
there is one, and the central directory; finds the members' bytes; reads the index; and range-reads the records, in
splits that Spark deals out. A WARC member that no index names is scanned as one split.

Of records with equal payloads of at least `min_revisit` bytes the one with the largest page_id is a response and the others
are revisits, whose block holds the HTTP headers alone (with the payload's length); others are responses.

Defined results: a null html is an empty payload; rows with equal page_id and payload are alike, so all of them are
responses where one is; a null page_id takes part and is never the one that others refer to unless its group has no
other; a null url is written as the record's own id; an empty table gives no archives and no records.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import struct
import uuid
import zipfile
import zlib
from collections.abc import Callable, Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.llm._base import Scratch

MIN_REVISIT = 1000
#: Bytes of payload after which a task begins another archive.
ARCHIVE_BYTES = 64 << 20
#: Records and bytes of a split.
SPLIT_RECORDS, SPLIT_BYTES = 500, 4 << 20
_PAGE = "urn:page:"
_PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# ---- files -----------------------------------------------------------------------------------------------------------


def _at(uri: str):
    """The file system and path of a URI; local, HDFS and object stores alike."""
    from pyarrow import fs

    uri = re.sub("^file:/(?!/)", "file:///", uri)
    return fs.FileSystem.from_uri(uri)


# ---- ZIP directories -------------------------------------------------------------------------------------------------


class Member(NamedTuple):
    name: str
    method: int
    header: int  # the local header's offset
    size: int  # in the archive


def directory(read: Callable[[int, int], bytes], length: int) -> list[Member]:
    """The members of a ZIP, from its central directory. read(offset, size) gives bytes."""
    tail_at = max(0, length - 65557)
    tail = read(tail_at, length - tail_at)
    at = tail.rfind(b"PK\x05\x06")
    if at < 0 or len(tail) < at + 22:
        raise ValueError("not a ZIP: it has no end record")
    entries, size, offset = struct.unpack("<HII", tail[at + 10 : at + 20])
    if at >= 20 and tail[at - 20 : at - 16] == b"PK\x06\x07":
        (where,) = struct.unpack("<Q", tail[at - 12 : at - 4])
        end = read(where, 56)
        if end[:4] != b"PK\x06\x06":
            raise ValueError("the ZIP64 end record isn't where its locator says")
        entries, size, offset = struct.unpack("<QQQ", end[32:56])
    listing = read(offset, size)
    out, p = [], 0
    for _ in range(entries):
        if listing[p : p + 4] != b"PK\x01\x02":
            raise ValueError("the central directory is damaged")
        flags, method = struct.unpack("<HH", listing[p + 8 : p + 12])
        packed, plain, n, extra, comment = struct.unpack("<IIHHH", listing[p + 20 : p + 34])
        (header,) = struct.unpack("<I", listing[p + 42 : p + 46])
        name = listing[p + 46 : p + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
        q, last = p + 46 + n, p + 46 + n + extra
        while q + 4 <= last:
            tag, size_of = struct.unpack("<HH", listing[q : q + 4])
            if tag == 1:  # ZIP64: only those fields that overflowed, in this order
                body, k = listing[q + 4 : q + 4 + size_of], 0
                if plain == 0xFFFFFFFF:
                    k += 8
                if packed == 0xFFFFFFFF:
                    (packed,) = struct.unpack("<Q", body[k : k + 8])
                    k += 8
                if header == 0xFFFFFFFF:
                    (header,) = struct.unpack("<Q", body[k : k + 8])
            q += 4 + size_of
        out.append(Member(name, method, header, packed))
        p = last + comment
    return out


def stored_at(read: Callable[[int, int], bytes], m: Member) -> int:
    """Where a stored member's bytes begin."""
    if m.method:
        raise ValueError(f"{m.name} is compressed; records are read from stored members only")
    head = read(m.header, 30)
    if head[:4] != b"PK\x03\x04":
        raise ValueError(f"{m.name} has no local header")
    n, extra = struct.unpack("<HH", head[26:30])
    return m.header + 30 + n + extra


# ---- records ---------------------------------------------------------------------------------------------------------


def _clean(value: str) -> str:
    return re.sub(r"[\x00-\x20\x7f]", lambda m: f"%{ord(m[0]):02X}", value)


def record(page_id: int | None, url: str | None, payload: bytes, refers_to: int | None, revisit: bool, date: str = "2024-01-01T00:00:00Z") -> bytes:
    digest = base64.b32encode(hashlib.sha1(payload).digest()).decode()
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    name = f"{_PAGE}{'' if page_id is None else page_id}"
    head = ["WARC/1.1", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <{name}>", f"WARC-Target-URI: {name if url is None else _clean(url)}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Profile: {_PROFILE}", f"WARC-Refers-To: <{_PAGE}{'' if refers_to is None else refers_to}>"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode() + b"\r\n\r\n" + block + b"\r\n\r\n"


def _headers(raw: bytes) -> dict[str, str]:
    out = {}
    for line in raw.decode("utf-8", "replace").split("\r\n")[1:]:
        k, _, v = line.partition(":")
        out[k.strip().lower()] = v.strip()
    return out


def _hex_digest(value: str) -> str:
    """A labelled SHA-1 in base 32 or base 16, as lower-case base 16."""
    kind, _, text = value.partition(":")
    if kind.lower() != "sha1":
        return value
    return text.lower() if len(text) == 40 else base64.b32decode(text.upper()).hex()


class Record(NamedTuple):
    page_id: int | None
    url: str
    record_type: str
    payload: bytes | None
    payload_bytes: int
    payload_digest: str
    refers_to: int | None


def _page(uri: str | None) -> int | None:
    text = (uri or "").strip("<>").removeprefix(_PAGE)
    return int(text) if re.fullmatch(r"-?\d+", text) else None


def parse(raw: bytes) -> Record:
    """A record whose bytes are whole. A response's digest is that of its payload, and must be the one in its header."""
    head, _, rest = raw.partition(b"\r\n\r\n")
    if not head.startswith(b"WARC/"):
        raise ValueError("not a WARC record")
    warc = _headers(head)
    block = rest[: int(warc["content-length"])]
    if len(block) != int(warc["content-length"]):
        raise ValueError(f"{warc.get('warc-record-id')} is cut short")
    http, _, payload = block.partition(b"\r\n\r\n")
    digest = _hex_digest(warc["warc-payload-digest"]) if "warc-payload-digest" in warc else None
    url, kind = warc.get("warc-target-uri", ""), warc["warc-type"]
    if kind == "revisit":
        return Record(_page(warc.get("warc-record-id")), url, kind, None, int(_headers(http).get("content-length", 0)), digest or "", _page(warc.get("warc-refers-to")))
    own = hashlib.sha1(payload).hexdigest()
    if digest and digest != own:
        raise ValueError(f"the payload of {warc.get('warc-record-id')} doesn't have its digest")
    return Record(_page(warc.get("warc-record-id")), url, kind, payload, len(payload), own, None)


def scan(data: bytes) -> Iterator[bytes]:
    """The records of a whole WARC member, whether each is a gzip member or none is."""
    while data:
        if data[:2] == b"\x1f\x8b":
            one = zlib.decompressobj(31)
            yield one.decompress(data)
            data = one.unused_data
        else:
            head, mark, _ = data.partition(b"\r\n\r\n")
            size = len(head) + len(mark) + int(_headers(head)["content-length"]) + 4
            yield data[:size]
            data = data[size:]


# ---- Spark -----------------------------------------------------------------------------------------------------------


def with_revisits(pages: DataFrame, min_revisit: int = MIN_REVISIT) -> DataFrame:
    """page_id, url, payload, revisit and refers_to. Only ids and digests meet by payload, so a payload that very many pages share
    moves none of its bytes; the verdicts return by page."""
    payload = F.encode(F.coalesce("html", F.lit("")), "utf-8")
    plain = pages.select("page_id", "url", payload.alias("payload"))
    small = plain.select("page_id", F.sha1("payload").alias("sha"), F.octet_length("payload").alias("size")).where(F.col("size") >= min_revisit)
    groups = small.groupBy(F.col("sha").alias("_sha")).agg(F.max("page_id").alias("keep"), F.count("*").alias("n")).where("n > 1")
    again = small.join(groups, F.col("sha") == F.col("_sha")).where("keep is not null and not (page_id <=> keep)").select(F.struct("page_id", "sha").alias("_of"), "keep").distinct()
    joined = plain.withColumn("_key", F.struct("page_id", F.sha1("payload").alias("sha"))).join(again, F.col("_key") == F.col("_of"), "left")
    return joined.select("page_id", "url", "payload", F.col("keep").isNotNull().alias("revisit"), F.col("keep").alias("refers_to"))


def write_archives(records: DataFrame, folder: str, archive_bytes: int = ARCHIVE_BYTES) -> DataFrame:
    """The manifest: path, length and n_records of the archives that the rows of with_revisits() are written to. Each attempt at a
    task writes under names of its own; Spark commits one attempt's rows, so archives of others, or half written, are in no manifest."""
    def run(batches):
        from pyspark import TaskContext

        system, base = _at(folder)
        system.create_dir(base, recursive=True)
        part, attempt, k = TaskContext.get().partitionId(), uuid.uuid4().hex, 0
        held: list[tuple[bytes, str]] = []
        size = 0

        def flush():
            name = f"part-{part:05d}-{k:04d}-{attempt}.zip"
            warc = f"part-{part:05d}-{k:04d}.warc.gz"
            lines, at = [], 0
            with system.open_output_stream(f"{base}/{name}") as f:
                with zipfile.ZipFile(f, "w", zipfile.ZIP_STORED) as z:
                    with z.open(f"archive/{warc}", "w", force_zip64=True) as out:
                        for raw, url in held:
                            out.write(raw)
                            lines.append(f"{url} 20240101000000 " + json.dumps({"offset": str(at), "length": str(len(raw)), "filename": warc}))
                            at += len(raw)
                    z.writestr("indexes/index.cdxj", "\n".join(lines) + "\n")
                length = f.tell()
            return pa.RecordBatch.from_pydict({"path": [f"{folder}/{name}"], "length": [length], "n_records": [len(held)]})

        for batch in batches:
            for page_id, url, payload, revisit, refers_to in zip(*(c.to_pylist() for c in batch.columns)):
                raw = gzip.compress(record(page_id, url, payload, refers_to, revisit), 1, mtime=0)
                held.append((raw, _clean(url or "-") or "-"))
                size += len(raw)
                if size >= archive_bytes:
                    yield flush()
                    held, size, k = [], 0, k + 1
        if held:
            yield flush()

    return records.select("page_id", "url", "payload", "revisit", "refers_to").mapInArrow(run, "path string, length long, n_records long")


def _splits(batches):
    """From path and length of archives: where the records of a split lie; without `starts`, in all of [at, at + size)."""
    for batch in batches:
        for path, length in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            system, where = _at(path)
            with system.open_input_file(where) as f:
                read = lambda a, n, f=f: f.read_at(n, a)
                members = directory(read, length)
                warcs = {m.name.rpartition("/")[2]: m for m in members if re.search(r"(^|/)archive/.*\.warc(\.gz)?$", m.name)}
                base = {n: stored_at(read, m) for n, m in warcs.items()}
                indexed, out = set(), []

                def emit(name, run):
                    at = base[name] + run[0][0]
                    out.append((path, at, run[-1][0] + run[-1][1] - run[0][0], [o - run[0][0] for o, _ in run], [n for _, n in run]))

                for m in members:
                    if not re.search(r"(^|/)indexes/.*\.cdxj?(\.gz)?$", m.name):
                        continue
                    text = read(stored_at(read, m), m.size)
                    runs: dict[str, list[tuple[int, int]]] = {}
                    for line in (gzip.decompress(text) if m.name.endswith(".gz") else text).decode().splitlines():
                        if "{" not in line:
                            continue
                        entry = json.loads(line[line.index("{") :])
                        if entry["filename"] in base:
                            runs.setdefault(entry["filename"], []).append((int(entry["offset"]), int(entry["length"])))
                    for name, places in runs.items():
                        indexed.add(name)
                        run: list[tuple[int, int]] = []
                        for o, n in sorted(places):
                            if run and (len(run) >= SPLIT_RECORDS or o + n - run[0][0] > SPLIT_BYTES):
                                emit(name, run)
                                run = []
                            run.append((o, n))
                        if run:
                            emit(name, run)
                out += [(path, base[n], m.size, None, None) for n, m in warcs.items() if n not in indexed]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out), (pa.string(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64())))], names=["path", "at", "size", "starts", "sizes"])


def _records(batches):
    for batch in batches:
        for path, at, size, starts, sizes in zip(*(c.to_pylist() for c in batch.columns)):
            system, where = _at(path)
            with system.open_input_file(where) as f:
                data = f.read_at(size, at)
            if starts is None:
                raws = scan(data)
            else:
                raws = (gzip.decompress(r) if r[:2] == b"\x1f\x8b" else r for r in (data[a : a + n] for a, n in zip(starts, sizes)))
            got = [parse(r) for r in raws]
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(zip(*got) if got else [()] * 7, (pa.int64(), pa.string(), pa.string(), pa.binary(), pa.int64(), pa.string(), pa.int64()))], names=list(Record._fields))


def read_folder(spark: SparkSession, folder: str, glob: str = "*.zip") -> DataFrame:
    """read_archives() of all archives in a folder that others wrote."""
    return read_archives(spark.read.format("binaryFile").option("pathGlobFilter", glob).load(folder))


def read_archives(archives: DataFrame) -> DataFrame:
    """page_id, url, record_type, payload (null for a revisit), payload_bytes, payload_digest and refers_to of all records in archives (path, length)."""
    spark, files = archives.sparkSession, archives.select("path", "length")
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism)
    splits = files.mapInArrow(_splits, "path string, at long, size long, starts array<long>, sizes array<long>").repartition(n)
    return splits.mapInArrow(_records, "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")


def roundtrip(pages: DataFrame, min_revisit: int = MIN_REVISIT, scratch: Scratch | None = None) -> DataFrame:
    """Writes every page as a record, and reads the archives back."""
    spark = pages.sparkSession
    scratch = scratch or Scratch(spark, "warc")
    folder = scratch.path("archives")
    made = scratch.keep(write_archives(with_revisits(pages, min_revisit), folder), "manifest")
    if not made.agg(F.sum("n_records").alias("n")).first()["n"]:
        return spark.createDataFrame([], "page_id long, url string, record_type string, payload binary, payload_bytes long, payload_digest string, refers_to long")
    return read_archives(made)


def op5_warc(spark, sf_dir: str) -> DataFrame:
    back = roundtrip(spark.read.parquet(f"{sf_dir}/pages.parquet"))
    return back.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
