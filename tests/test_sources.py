"""Archives, folders, saved repositories, ingest and cycles of parents, on generated inputs."""

import datetime
import io
import os
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, In, StringStartsWith

from loomgraph.operators import caching, neighborhood, paths, views
from loomgraph.sources import archives, folders, links
from loomgraph.streaming import ingest


def packed(members, method=zipfile.ZIP_DEFLATED):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
    return out.getvalue()


def read(spark, folder, **files):
    for name, data in files.items():
        (folder / f"{name}.zip").write_bytes(data)
    got = {}
    for r in archives.read_zips(spark, f"file://{folder}").collect():
        got.setdefault(r["archive"].rpartition("/")[2][:-4], []).append((r["path"], r["text"], r["failed"]))
    return {k: sorted(v, key=repr) for k, v in got.items()}


def test_archives(spark, tmp_path):
    basic = packed([("proj/index.js", "1"), ("proj/lib/a.js", "2"), ("__MACOSX/._index.js", "no"), ("proj/.DS_Store", "no"), ("proj/pic.bin", b"a\0b"), ("proj/empty/", "")])
    stored = packed([("one.txt", "1"), ("two/three.txt", "2")], zipfile.ZIP_STORED)
    windows = packed([("express\\caf?.js", "x"), ("express\\index.js", "y")]).replace(b"caf?", b"caf\x82")  # é in CP437, no UTF-8
    plain = packed([("r/caf??.js", "x")]).replace(b"caf??", "café".encode())  # UTF-8 without its flag
    damaged = bytearray(packed([("a.txt", "text " * 50), ("b.txt", "other")]))
    damaged[40:44] = b"\xff\xff\xff\xff"
    got = read(spark, tmp_path, basic=basic, stored=stored, windows=windows, plain=plain, damaged=bytes(damaged), nothing=b"no archive at all")
    assert got["basic"] == [("index.js", "1", False), ("lib/a.js", "2", False)]
    assert got["stored"] == [("one.txt", "1", False), ("two/three.txt", "2", False)]
    assert got["windows"] == [("café.js", "x", False), ("index.js", "y", False)]
    assert got["plain"] == [("café.js", "x", False)]
    assert got["damaged"] == [("a.txt", None, True), ("b.txt", "other", False)]
    assert got["nothing"] == [(None, None, True)]


def test_large_archives(spark, tmp_path):
    """Members of one archive are read by several tasks, from their ranges; a ZIP64 directory; locked and otherwise packed members; archives in folders."""
    (tmp_path / "build").mkdir()
    many = [(f"p/f{k}.py", f"x = {k}\n" * (k % 50)) for k in range(400)]
    (tmp_path / "build" / "many.zip").write_bytes(packed(many))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        with z.open(zipfile.ZipInfo("big.txt"), "w", force_zip64=True) as f:
            f.write(b"def f")
        z.writestr("lz.txt", "packed otherwise", zipfile.ZIP_LZMA)
        z.writestr("locked.txt", "secret")
    data = bytearray(out.getvalue())
    at = data.rindex(b"PK\x01\x02")  # the last member's entry: its flag says that it is locked
    data[at + 8] |= 1
    (tmp_path / "odd.ZIP").write_bytes(bytes(data))
    (tmp_path / "other.txt").write_bytes(b"no archive")
    got = archives.read_zips(spark, str(tmp_path)).collect()
    assert sorted((r["path"], r["text"]) for r in got if r["archive"] == "build/many.zip") == sorted((p[2:], t) for p, t in many)
    assert sorted((r["path"], r["text"], r["failed"]) for r in got if r["archive"] == "odd.ZIP") == [("big.txt", "def f", False), ("locked.txt", None, True), ("lz.txt", None, True)]
    assert {r["archive"] for r in got} == {"build/many.zip", "odd.ZIP"}
    plan = archives.read_zips(spark, str(tmp_path))
    assert plan.rdd.getNumPartitions() == int(spark.conf.get("spark.sql.shuffle.partitions")) and len({r["p"] for r in plan.select(F.spark_partition_id().alias("p")).collect()}) > 1


def test_folders(spark, tmp_path):
    files = {"app/src/main.py": b"x = 1", "app/node_modules/y.js": b"no", "app/.git/z.py": b"no", "app/pic.py": b"a\0b", "app/src/with space+%25.md": b"md", "app/what.zzz": b"no", "app/package-lock.json": b"no"}
    for name, data in files.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    got = sorted(tuple(r) for r in folders.read_files(spark, f"file://{tmp_path}").collect())
    assert got == [("src/main.py", "x = 1"), ("src/with space+%25.md", "md")]
    loose = spark.createDataFrame([("a\\b.py",), ("./a/c.py",), ("d.py",)], "path string")
    assert sorted(r["path"] for r in folders.without_shared_root(loose).collect()) == ["a/b.py", "a/c.py", "d.py"]


def test_folder_bytes_and_names(spark, tmp_path):
    """Bytes that aren't UTF-8 are replaced, and a folder whose name comes again in paths below it loses none of them."""
    base = tmp_path / "data"
    files = {"data/x/data/y.py": b"one", "data/data/y.py": b"two", "y.py": b"three", "b.txt": "café".encode("latin-1"), "data/.github/w.yml": b"four"}
    for name, data in files.items():
        (base / name).parent.mkdir(parents=True, exist_ok=True)
        (base / name).write_bytes(data)
    for address in (f"file://{base}", f"{base}/"):
        got = {r["path"]: r["text"] for r in folders.read_files(spark, address).collect()}
        assert got == {"data/x/data/y.py": "one", "data/data/y.py": "two", "y.py": "three", "b.txt": "caf\ufffd", "data/.github/w.yml": "four"}
    assert sorted(r["path"] for r in folders.read_files(spark, str(base), "data/x").collect()) == ["x/data/y.py"]  # without the segment that all share


def test_skipped_folders_stay_closed(spark, tmp_path):
    """By their times of access: skipped folders are not listed, and unwanted or too long files not opened."""
    long = b"x" * (folders.LONGEST + 1)
    opened = {"a.py": b"1", "src/b.py": b"2", "src/deep/er/c.md": b"3"}
    closed = {"node_modules/d.js": b"4", "src/.git/e.py": b"5", "src/build/f.py": b"6", "src/g.zzz": b"7", "h.py": long, "yarn.lock": b"8"}
    for name, data in {**opened, **closed}.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(data)
    skipped = [tmp_path / d for d in ("node_modules", "src/.git", "src/build")]
    for f in [*(tmp_path / n for n in {**opened, **closed}), *skipped]:
        os.utime(f, (1, 2))
    assert sorted(r["path"] for r in folders.read_files(spark, str(tmp_path)).collect()) == sorted(opened)
    touched = {n for n in {**opened, **closed} if (tmp_path / n).stat().st_atime > 1}
    if not touched:
        pytest.skip("this file system keeps no times of access")
    assert touched == set(opened) and all(d.stat().st_atime == 1 for d in skipped)


def test_listing(spark, tmp_path, monkeypatch):
    """Many folders are dealt out, paths narrow the walk, and filters on path reach it."""
    names = [f"d{k % 90}/e{k % 7}/f{k}.py" for k in range(300)]
    for name in names:
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(b"x")
    got = folders.list_folder(spark, str(tmp_path))
    assert sorted(r["path"] for r in got.collect()) == sorted(names) and got.rdd.getNumPartitions() > 64
    assert sorted(r["path"] for r in folders.list_folder(spark, str(tmp_path), "d1/").collect()) == sorted(n for n in names if n.startswith("d1/"))
    reader = folders.FolderReader(str(tmp_path), "")
    assert len(list(reader.pushFilters([StringStartsWith(("path",), "d2/e"), EqualTo(("size",), 3)]))) == 2
    assert reader.may_hold("d2") and reader.may_hold("d2/e1") and not reader.may_hold("d20") and not reader.may_hold("d3")
    assert {p for part in reader.partitions() for p, _, _ in reader.read(part)} == {n for n in names if n.startswith("d2/e")}
    list(reader.pushFilters([In(("path",), ("d2/e2/f2.py", "d9/x"))]))
    assert reader.may_hold("d2/e2") and not reader.may_hold("d2/e1") and not reader.may_hold("d9")


def test_saved(spark, tmp_path):
    store, make = f"file://{tmp_path}/store", lambda rows: spark.createDataFrame(rows, "path string, text string")
    caching.save(make([("a", "1"), ("b", "2")]), store, "one", 1.0)
    caching.save(make([("a", "1"), ("c", "3")]), store, "two", 2.0)
    caching.save(make([("a", "9"), ("b", "2"), ("d", "2")]), store, "one", 3.0)
    load = lambda repo: sorted(tuple(r) for r in caching.load_saved(spark, store, repo).collect())
    assert load("one") == [("a", "9"), ("b", "2"), ("d", "2")] and load("two") == [("a", "1"), ("c", "3")] and load("none") == []
    assert spark.read.parquet(f"{store}/blobs").count() == 4
    assert caching.total_bytes(spark.createDataFrame([], "size long")).first()["bytes"] == 0


def test_ingest(spark, tmp_path):
    rows = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "x")], "path string, text string")
    when = lambda df: df.selectExpr("path", "text", "timestamp'2024-01-01' as arrived")
    source = str(tmp_path / "in")
    when(rows).coalesce(1).write.parquet(source)
    stream = spark.readStream.schema("path string, text string, arrived timestamp").parquet(source)

    def run():
        q = ingest.new_blobs(stream).writeStream.format("parquet").option("path", str(tmp_path / "out")).option("checkpointLocation", str(tmp_path / "state")).outputMode("append").trigger(availableNow=True).start()
        q.awaitTermination(120)

    run()
    when(spark.createDataFrame([("d", "y"), ("e", "z")], "path string, text string")).coalesce(1).write.mode("append").parquet(source)
    run()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert sorted(r["text"] for r in got) == ["x", "y", "z"] and got[0]["arrived"] == datetime.datetime(2024, 1, 1)


def test_ingest_for_good(spark, tmp_path):
    """Contents that come again after any time aren't new, and a batch that is repeated adds none."""
    store, source = f"file://{tmp_path}/blobs", str(tmp_path / "in")
    make = lambda rows: spark.createDataFrame(rows, "path string, text string").coalesce(1)
    stream = spark.readStream.schema("path string, text string").parquet
    stored = lambda: sorted((r["text"], r["batch"]) for r in ingest.blobs(spark, store).collect())
    for k, rows in enumerate([[("a", "x"), ("b", "y"), ("c", "x"), ("n", None)], [("d", "y"), ("e", "z")], [("f", "x"), ("g", "")]]):
        make(rows).write.mode("append").parquet(source)
        ingest.ingest(stream(source), store, str(tmp_path / "state")).awaitTermination(120)
    assert stored() == [("", 2), ("x", 0), ("y", 0), ("z", 1)]
    ingest.append_new(make([("d", "y"), ("e", "z")]), 1, store)  # as after a failure between the write and its commit
    ingest.append_new(make([("a", "x"), ("b", "y")]), 0, store)
    assert stored() == [("", 2), ("x", 0), ("y", 0), ("z", 1)]


def test_cycles_and_hidden_tests(spark):
    nodes = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", None)], "key string, parent_key string")
    got = sorted(tuple(r) for r in neighborhood.ancestors(nodes).collect())
    assert got == [("a", "a", 2), ("a", "b", 1), ("b", "a", 1), ("b", "b", 2), ("c", "a", 1), ("c", "b", 2)]
    files = spark.createDataFrame([("f:a.py", "file", "a.py", "src/a.py"), ("f:t.py", "file", "t.py", "tests/t.py"), ("f:r.md", "file", "r.md", "r.md")], "key string, kind string, name string, path string")
    assert [r["key"] for r in views.view_nodes(files, "files", ("tests",)).orderBy("key").collect()] == ["f:a.py", "f:r.md"]
    degrees = spark.createDataFrame([("f:a.py", 2), ("f:t.py", 9), ("f:r.md", 10)], "key string, deg int")
    assert views.default_node(files, degrees, "code").first()["key"] == "f:a.py"


def test_closest_path_and_missing_blobs(spark):
    files = spark.createDataFrame([("x/a/i.js",), ("x/ab/i.js",), ("y/i.js",)], "path string")
    asked = spark.createDataFrame([("x/abc.js", "i.js"), ("q", "i.js"), ("y/z/w.js", "i.js"), ("q", "none.js")], "from string, suffix string")
    assert sorted(tuple(r) for r in paths.closest_path(files, asked).collect()) == [("q", "i.js", "x/a/i.js"), ("x/abc.js", "i.js", "x/ab/i.js"), ("y/z/w.js", "i.js", "y/i.js")]
    listing = spark.createDataFrame([("p", "1"), ("q", "2")], "path string, sha string")
    assert [r["path"] for r in caching.missing(listing, listing.where("sha = '1'")).collect()] == ["q"]


@pytest.mark.parametrize("known, want", [([("main", "a/b")], ("main", "a/b")), ([("main/a", "b"), ("main/a/b", "")], ("main/a", "b")), ([], None)])
def test_known_tree(spark, known, want):
    specs = spark.createDataFrame([("o", "r", "main", "a/b", "")], "owner string, repo string, ref string, sub string, focus string")
    manifest = spark.createDataFrame([("o", "r", *k) for k in known], "owner string, repo string, ref string, sub string")
    got = links.known_tree(specs, manifest).collect()
    assert [(r["ref"], r["sub"]) for r in got] == ([want] if want else [])
