import gzip
import hashlib
import io
import struct
import zipfile
from collections import defaultdict

import pytest

from loomgraph.llm import warc as w
from loomgraph.llm._base import Scratch


def brute(pages, least=1000):
    by = defaultdict(list)
    for i, h in pages:
        by[h or ""].append(i)
    out = []
    for i, h in pages:
        p = (h or "").encode()
        ids = [x for x in by[h or ""] if x is not None]
        again = len(p) >= least and len(by[h or ""]) > 1 and ids and i != max(ids)
        out.append((i, len(p), hashlib.sha1(p).hexdigest(), "revisit" if again else "response", max(ids) if again else None))
    return sorted(out, key=repr)


def rows(df):
    return sorted((tuple(r) for r in df.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to").collect()), key=repr)


def test_query(spark):
    sf = "/root/testdata/sf0.01"
    want = brute([tuple(r) for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()])
    assert rows(w.op5_warc(spark, sf)) == want


def test_odd_rows(spark):
    long = "x" * 1500
    data = [(1, "http://a/\r\nEvil: 1", long), (2, None, long), (3, "u v", long), (None, "n", long), (4, "é", None), (5, "", ""), (6, "s", "short"), (7, "s", "short"), (3, "u v", long), (8, "r", "a\r\n\r\nb\0é" * 300), (None, "m", "y" * 1000), (None, "m", "y" * 1000)]
    df = spark.createDataFrame(data, "page_id long, url string, html string")
    for pages in (df, df.withColumn("payload", df["url"]).withColumn("revisit", df["url"]).withColumn("sha", df["url"])):
        assert rows(w.roundtrip(pages)) == brute([(d[0], d[2]) for d in data])
    back = {r["page_id"]: r for r in w.roundtrip(df).collect()}
    assert back[8]["payload"].decode() == "a\r\n\r\nb\0é" * 300 and back[1]["payload"] is None and back[3]["refers_to"] is None and back[2]["url"] == "urn:page:2"
    assert w.roundtrip(df.limit(0)).count() == 0


def test_many_archives_and_splits(spark, monkeypatch):
    monkeypatch.setattr(w, "SPLIT_RECORDS", 3)
    df = spark.range(100).selectExpr("id as page_id", "concat('u', id) as url", "repeat(cast(id % 40 as string), 600) as html")
    scratch = Scratch(spark, "t")
    made = w.write_archives(w.with_revisits(df), scratch.path("a"), archive_bytes=4000).collect()
    assert sum(r["n_records"] for r in made) == 100 and len(made) > 4
    assert rows(w.read_folder(spark, scratch.path("a"))) == brute([(r["page_id"], r["html"]) for r in df.collect()])


def test_repeated_attempts(spark):
    """What an attempt that wasn't committed left in the folder isn't read."""
    df = spark.range(200).selectExpr("id as page_id", "'u' as url", "repeat(cast(id as string), 90) as html")
    scratch = Scratch(spark, "t")
    lost = w.write_archives(w.with_revisits(df), scratch.path("a"), archive_bytes=500).collect()
    made = scratch.keep(w.write_archives(w.with_revisits(df), scratch.path("a"), archive_bytes=5000), "manifest")
    assert len(lost) > made.count() and not {r["path"] for r in lost} & {r["path"] for r in made.collect()}
    assert rows(w.read_archives(made)) == brute([(r["page_id"], r["html"]) for r in df.collect()])


def archive(members, method=zipfile.ZIP_STORED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def reader(data):
    return lambda at, n: data[at : at + n]


def zip64(data):
    """The same archive with all sizes and places in ZIP64 fields."""
    end = data.rfind(b"PK\x05\x06")
    n, size, at = struct.unpack("<HII", data[end + 10 : end + 20])
    p, out = at, b""
    for _ in range(n):
        plain, packed, name, extra, comment = struct.unpack("<IIHHH", data[p + 20 : p + 34])
        plain, packed = struct.unpack("<I", data[p + 24 : p + 28])[0], struct.unpack("<I", data[p + 20 : p + 24])[0]
        (header,) = struct.unpack("<I", data[p + 42 : p + 46])
        body = struct.pack("<HHQQQ", 1, 24, plain, packed, header)
        out += data[p : p + 20] + b"\xff" * 8 + struct.pack("<HHH", name, len(body), 0) + data[p + 34 : p + 42] + b"\xff" * 4 + data[p + 46 : p + 46 + name] + body
        p += 46 + name + extra + comment
    end64 = struct.pack("<4sQHHIIQQQQ", b"PK\x06\x06", 44, 45, 45, 0, 0, n, n, len(out), at)
    locator = struct.pack("<4sIQI", b"PK\x06\x07", 0, at + len(out), 1)
    return data[:at] + out + end64 + locator + struct.pack("<4sHHHHIIH", b"PK\x05\x06", 0, 0, 0xFFFF, 0xFFFF, 0xFFFFFFFF, 0xFFFFFFFF, 3) + b"abc"


@pytest.mark.parametrize("change", [lambda d: d, zip64])
def test_directories(change):
    data = change(archive([("archive/a.warc", b"12345"), ("b/é", b"xy")]))
    members = w.directory(reader(data), len(data))
    assert [m.name for m in members] == ["archive/a.warc", "b/é"]
    assert [data[w.stored_at(reader(data), m) :][: m.size] for m in members] == [b"12345", b"xy"]


def test_damage():
    with pytest.raises(ValueError, match="not a ZIP"):
        w.directory(reader(b"nothing"), 7)
    data = archive([("archive/a.warc", b"1" * 99)], zipfile.ZIP_DEFLATED)
    with pytest.raises(ValueError, match="compressed"):
        w.stored_at(reader(data), w.directory(reader(data), len(data))[0])
    raw = w.record(1, "u", b"payload", None, False)
    with pytest.raises(ValueError, match="digest"):
        w.parse(raw.replace(b"payload\r\n", b"pAyload\r\n"))
    with pytest.raises(ValueError, match="short"):
        w.parse(raw[:-9])


@pytest.mark.parametrize("pack", [gzip.compress, bytes])
def test_member_without_index(spark, tmp_path, pack):
    raws = [w.record(k, f"http://h/{k}", b"p" * k, None, False) for k in range(5)]
    (tmp_path / "x.zip").write_bytes(zip64(archive([("archive/x.warc" + (".gz" if pack is gzip.compress else ""), b"".join(map(pack, raws)))])))
    got = sorted((r["page_id"], r["url"], r["payload"]) for r in w.read_folder(spark, f"file://{tmp_path}").collect())
    assert got == [(k, f"http://h/{k}", b"p" * k) for k in range(5)]
