"""Sources and sinks by ranges, pages and runs: against plain readers, cut at every place, and damaged."""

import contextlib
import hashlib
import io
import json
import random
import re
import struct
import time

import pytest
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringStartsWith

from tidemark.functions import patterns
from tidemark.operators import grouping, numbering, objects
from tidemark.streaming import progress
from tidemark.sources import catalog, catalog_split, composed, container_index, containers, files, ledger_json, ledger_log, messagepack, object_pages, ranges


def by_ranges(data, split):
    """What the reader's two passes make of a file."""
    f, out, before = io.BytesIO(data), [], 0
    for begin in range(0, max(1, len(data)), split):
        end = min(begin + split, len(data))
        out += ledger_json.entries(f, len(data), begin, end, before)
        f.seek(begin)
        before += len(ledger_json.quotes(data[begin:end], ledger_json.slashes_before(f, begin)))
    return [(k, v) for k, v, _ in out]


def test_maps_cut_at_any_place():
    r = random.Random(4)
    for _ in range(300):
        text = lambda: "".join(r.choices(['"', "\\", "{", "}", ",", ":", "a", "é", "\n", " ", "😀", "\\\\"], k=r.randint(0, 7)))
        pairs = [(text(), text()) for _ in range(r.randint(0, 5))]
        gap = lambda: "".join(r.choices(" \n\t", k=r.randint(0, 3)))
        body = f"{gap()},{gap()}".join(f"{json.dumps(k, ensure_ascii=r.random() < 0.5)}{gap()}:{gap()}{json.dumps(v, ensure_ascii=r.random() < 0.5)}" for k, v in pairs)
        data = f"{gap()}{{{gap()}{body}{gap()}}}{gap()}".encode() * r.choice([1, 1, 2])
        want = pairs * (2 if data.count(b"{") and len(data) > 2 and by_ranges(data, 1 << 20) == pairs * 2 else 1)
        assert {tuple(by_ranges(data, s)) for s in (1, 2, 3, 7, 64, 1 << 20)} == {tuple(want)}, data


@pytest.mark.parametrize("text", ["{broken", '{"a": "1",\n "b": "2', '{\n  "a": "1",\n', '"a": "1"', '{"a": 1}', '{"a": "1"} x', '{"a": "1", "b"}', '{"a": "1" "b": "2"}', '{"a" "1"}', '{"a": null}', '{"a": "\\q"}', '{"a": "b\x01"}', '[["a","b"]]', '{"a": "\\ud800"}'])
def test_damaged_maps(text):
    for split in (1, 5, 1000):
        with pytest.raises(ledger_json.Damaged):
            by_ranges(text.encode(), split)


def test_ledgers_of_any_layout(spark, tmp_path):
    p = tmp_path / "ledger.json"
    p.write_text('{"a":\n "1",\n"b"\n:\n"2", "a": "3"}')
    assert {tuple(r) for r in catalog.read_ledger(spark, str(p), 4).collect()} == {("a", "3"), ("b", "2")} and p.exists()
    many = {f"path/{i}/é\"": "h" * (i % 90) for i in range(5000)}
    p.write_text(json.dumps(many, indent=1))
    assert {r[0]: r[1] for r in catalog.read_ledger(spark, f"file://{p}", 1000).collect()} == many
    p.write_text(json.dumps(many)[:-500])
    assert catalog.read_ledger(spark, str(p), 1000).count() == 0 and not p.exists() and (tmp_path / "ledger.json.corrupt").exists()


def value(r, depth=0):
    kind = r.randint(0, 5 if depth < 2 else 3)
    if kind < 4:
        return r.choice([None, True, False, 0, 127, 128, -1, 1 << 40, "", "abc", "é" * 40, "x" * 300])
    if kind == 4:
        return [value(r, depth + 1) for _ in range(r.randint(0, 3))]
    return {f"k{i}": value(r, depth + 1) for i in range(r.randint(0, 3))}


def test_values_are_skipped_as_they_are_built():
    r = random.Random(2)
    for _ in range(500):
        x = value(r)
        raw = messagepack.packed(x)
        assert messagepack.unpack(raw) == (x, len(raw)) and messagepack.skip(raw + b"\xc0", 0) == len(raw)
        for k in range(len(raw)):
            with pytest.raises(IndexError):
                messagepack.skip(raw[:k], 0)
    for raw in (b"\xcb" + b"0" * 8, b"\xca0000", b"\xc4\x01x", b"\x93\x01\x02\x03", b"\x81\x01\x02", b"\xd9\x01a", b"\xdc\x00\x01\xc0", b"\xde\x00\x01\xc0\xc0", b"\xcd\x00\x01", b"\xe0"):
        assert messagepack.skip(raw, 0) == len(raw) == messagepack.unpack(raw)[1]


def catalogue_bytes(n, seed=1):
    r = random.Random(seed)
    bundles = {f"b/{i}": {"hash": r.choice([None, f"h{i}"]), "category": r.choice(["StartApp", "live_pv", None]), "crc": i, "fileSize": i * 7, "paths": ["p"] * (i % 4), "more": value(r)} for i in range(n)}
    return messagepack.packed({"version": "1", "extra": [1, {"a": "b" * 200}], "bundles": bundles, "os": None}), bundles


def test_cut_entries_at_any_place():
    data, bundles = catalogue_bytes(40)
    for size in (1, 7, 100, 5000, 1 << 20):
        cutter, got = catalog_split.Cutter(200), []
        for k in range(0, len(data), size):
            for place, n, body in cutter.feed(data[k : k + size]):
                assert data[place : place + len(body)] == body
                got += catalog._bundles("f", place, n, body)
        cutter.end()
        assert [x["bundle_name"] for x in got] == list(bundles) and [x["crc"] for x in got] == list(range(40))
        short = catalog_split.Cutter(200)
        list(short.feed(data[: -10]))
        with pytest.raises(ValueError):
            short.end()


def test_catalogues_by_ranges(spark, tmp_path):
    key, iv = "00112233445566778899aabbccddeeff", "0102030405060708090a0b0c0d0e0f10"
    data, bundles = catalogue_bytes(300)
    out = spark.range(1).select(F.aes_encrypt(F.lit(data), F.unhex(F.lit(key)), F.lit("CBC"), F.lit("PKCS"), F.unhex(F.lit(iv)))).first()[0]
    (tmp_path / "c").write_bytes(bytes(out)[16:])
    (tmp_path / "p").mkdir()
    (tmp_path / "p/1").write_bytes(data)
    (tmp_path / "p/2").write_bytes(messagepack.packed({"bundles": None}))
    want = sorted((n, x["hash"] or "", x["crc"], x["fileSize"], len(x["paths"])) for n, x in bundles.items())
    for args in ((str(tmp_path / "c"), key, iv), (str(tmp_path / "p"),)):
        rows = catalog.read_catalogues(spark, *args, size=512, piece=300)
        assert sorted((r.bundle_name, r.hash, r.crc, r.file_size, len(r.paths)) for r in rows.collect()) == want
    pieces = catalog_split.entry_pieces(catalog_split.plain_ranges(ranges.file_list(spark, str(tmp_path / "p")), None, None, 512), 300)
    assert pieces.count() > 30 and max(len(r.data) for r in pieces.collect()) < 3000
    twice = messagepack.map_head(1) + messagepack.packed("bundles") + messagepack.map_head(2) + b"".join(messagepack.packed("a") + messagepack.packed({"hash": h}) for h in "xy")
    (tmp_path / "t").write_bytes(twice)
    assert [r.hash for r in catalog.read_catalogues(spark, str(tmp_path / "t")).collect()] == ["y"]
    for bad in (b"", b"x" * 17):
        (tmp_path / "bad").write_bytes(bad)
        with pytest.raises(Exception, match="multiple of 16"):
            catalog.read_catalogues(spark, str(tmp_path / "bad"), key, iv).collect()
    (tmp_path / "bad").write_bytes(data[:-40])
    with pytest.raises(Exception, match="ends within"):
        catalog.read_catalogues(spark, str(tmp_path / "bad")).collect()
    assert catalog.read_catalogues(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("joined", [False, True])
def test_written_catalogues_are_whole(spark, tmp_path, joined):
    """A file's entries lie in many partitions, beside small tables that joins by file may broadcast."""
    want = sorted((f"f{i % 3}/{i}", f"h{i}", i, i * 7, "StartApp") for i in range(600))
    bundles = spark.createDataFrame([(f"{n[:2]}.bin", n, *x) for n, *x in want] + [(None, "lost", "h", 1, 1, "StartApp")], "file string, bundle_name string, hash string, crc long, file_size long, category string")
    if joined:
        bundles = bundles.join(spark.createDataFrame([(f"f{i}.bin",) for i in range(3)], "file string"), "file")
    conf = {"spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.autoBroadcastJoinThreshold": "8k"}  # as for many rows: several tasks, no broadcast of them
    for k, v in conf.items():
        spark.conf.set(k, v)
    try:
        done = catalog.write_catalogues(bundles, str(tmp_path / "c")).collect()
    finally:
        for k in conf:
            spark.conf.unset(k)
    assert sorted((r.file, r.entries) for r in done) == [(f"f{i}.bin", 200) for i in range(3)]
    assert sorted(len(messagepack.unpack(p.read_bytes())[0]["bundles"]) for p in (tmp_path / "c").glob("*.bin")) == [200] * 3
    rows = catalog.read_catalogues(spark, str(tmp_path / "c"), size=1 << 10, piece=1 << 9).select("bundle_name", "hash", "crc", "file_size", "category")
    assert sorted(map(tuple, rows.collect())) == want


def test_containers_by_their_heads(spark, tmp_path):
    items = [(f"n{i}/é", b"x" * (i * 37 % 500)) for i in range(300)] + [("big", b"y" * 200_000), ("", b"")]
    packed = containers.pack(items)
    grouped = b"GROUP" + struct.pack("<I", len(items)) + b"".join(struct.pack("<IQ", len(n.encode()), len(d)) + n.encode() for n, d in items) + b"".join(d for _, d in items)
    for data, magic in ((packed, b""), (grouped, b"GROUP")):
        (tmp_path / "c").write_bytes(data)
        index = container_index.index_containers(ranges.file_list(spark, str(tmp_path / "c")), magic)
        got = sorted((r.ord, r.name, bytes(r.data)) for r in container_index.read_entries(index).collect())
        assert got == [(k, n, d) for k, (n, d) in enumerate(items)]
        assert [bytes(r.data) for r in container_index.read_entries(index.where("name = 'big'")).collect()] == [b"y" * 200_000]
    for cut in (len(packed) - 1, len(packed) - 100_000, 3000, 25, 10, 0):
        (tmp_path / "c").write_bytes(packed[:cut])
        rows = container_index.index_containers(ranges.file_list(spark, str(tmp_path / "c"))).orderBy("at").collect()
        whole = [r for r in rows if r.error is None]
        assert len(rows) == len(whole) + 1 and [r.name for r in whole] == [n for n, _ in items[: len(whole)]], cut
        assert all(packed[r["at"] : r["at"] + r.length] == items[r.ord][1] for r in whole)
    for bad in (packed + b"x", packed[:12] + struct.pack("<Q", 5) + packed[20:]):
        (tmp_path / "c").write_bytes(bad)
        assert [r.name for r in container_index.index_containers(ranges.file_list(spark, str(tmp_path / "c"))).where("error IS NOT NULL").collect()] == [None]


def test_pages_that_filters_leave(spark, tmp_path):
    kinds = ["Mesh", "Sprite", "Font", "Shader"]
    rows = [(f"b{i % 3}", i, None if i % 7 == 0 else f"name{i:04d}", None, kinds[i // 250], i, None, i * 2) for i in range(1000)]
    objects_ = spark.createDataFrame(rows, object_pages.SCHEMA).coalesce(1)
    place = str(tmp_path / "pages")
    assert [tuple(r)[1:] for r in object_pages.write_object_pages(objects_, place, 50).collect()] == [(20, 1000)]
    scan = object_pages.read_object_pages(spark, place, 4096)
    assert scan.rdd.getNumPartitions() > 3 and sorted(map(tuple, scan.collect()), key=lambda r: r[1]) == rows
    wanted = scan.where("type = 'Sprite' AND index > 300 AND name LIKE 'name03%' AND size IS NOT NULL")
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        wanted.explain("formatted")
    assert re.search(r"PushedFilters: \[.*EqualTo\(type,Sprite\).*GreaterThan\(index,300\).*StringStartsWith\(name,name03\)", shown.getvalue())
    assert sorted(r["index"] for r in wanted.collect()) == [r[1] for r in rows if r[4] == "Sprite" and r[1] > 300 and (r[2] or "").startswith("name03")]
    for filters, pages in (([], 20), ([EqualTo(("type",), "Sprite")], 5), ([In(("type",), ("Mesh", "Shader"))], 10), ([EqualTo(("type",), "Font"), GreaterThan(("index",), 700)], 1), ([StringStartsWith(("name",), "name09")], 2), ([EqualTo(("name",), "zzz")], 0)):
        reader = object_pages.ObjectPagesReader(place, 4096)
        assert list(reader.pushFilters(filters)) == []
        for part in reader.partitions():
            list(reader.read(part))
        assert reader.pages_read == pages, filters
    assert object_pages.write_object_pages(objects_.where("index < 0"), str(tmp_path / "none")).collect() == [] and object_pages.read_object_pages(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(ValueError):
        object_pages.read_index(io.BytesIO(b"x" * 40), 40)


def test_numbers_equal_the_window(spark):
    r = random.Random(8)
    rows = [(r.choice(["hot"] * 6 + [f"g{k}" for k in range(40)] + [None]), r.choice([1, None]), i, r.choice(["x", None])) for i in r.sample(range(5000), 3000)]
    df = spark.createDataFrame(rows, "g string, h int, o long, v string").repartition(5)
    want = df.withColumn("n", F.row_number().over(W.partitionBy("g", "h").orderBy("o")).cast("long"))
    got = numbering.numbered(df, ["g", "h"], ["o"])
    assert got.columns == want.columns and sorted(map(repr, got.collect())) == sorted(map(repr, want.collect()))
    one = df.withColumn("g", F.lit("one")).withColumn("h", F.lit(1))
    assert sorted(x.n for x in numbering.numbered(one, ["g", "h"], ["o"]).collect()) == list(range(1, 3001))
    assert numbering.numbered(df.where("o < 0"), ["g"], ["o"]).count() == 0
    o = spark.createDataFrame([("hot" if i % 3 else f"b{i % 5}", i, r.choice(["Sprite", "Mesh", "texture2d", None])) for i in range(2000)], "bundle string, index long, type string")
    chunk = (F.row_number().over(W.partitionBy("bundle").orderBy("index")) - 1) / 7
    want = {(x.bundle, x["index"]): x.c for x in o.withColumn("c", F.floor(chunk)).collect()}
    assert {(x.bundle, x["index"]): x.chunk for x in objects.in_chunks(o, 7).collect()} == want


def test_ledger_log(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(ledger_log, "MOST_RUNS", 4)
    log, r, want = ledger_log.LedgerLog(spark, str(tmp_path / "log")), random.Random(3), {}
    paths = lambda names: spark.createDataFrame([(n,) for n in names], "bundle_path string")
    assert log.newest().count() == 0 and log.known(paths(["a"])).count() == 0 and log.runs() == []
    for batch in range(7):
        rows = {f"{batch % 4}/{r.randint(0, 400)}": f"h{batch}" for _ in range(120)}
        log.append(spark.createDataFrame(list(rows.items()), ledger_log.LEDGER), batch)
        if batch == 2:  # again, as after a failure
            log.append(spark.createDataFrame(list(rows.items()), ledger_log.LEDGER), batch)
        want |= rows
        assert {x[0]: x[1] for x in log.newest().collect()} == want and len(log.runs()) <= 4
    asked = r.sample(sorted(want), 20) + ["absent", "0/x"]
    got = {x[0]: x[1] for x in log.known(paths(asked)).collect()}
    assert {k: got[k] for k in asked if k in want} == {k: want[k] for k in asked if k in want} and "absent" not in got
    log.merge()
    log.append(spark.createDataFrame([(f"9/{i}", "h") for i in range(50)], ledger_log.LEDGER), 20)
    assert log.known(paths(["9/7"])).count() >= 1 and log.opened == 1 < log.files
    log.known(paths(["9/nowhere", "00/nowhere"]))
    assert log.opened <= 1
    assert log.known(paths(["zzz"])).count() == 0 and log.opened == 0
    assert log.newest(20).count() == len(want) and len(list((tmp_path / "log").glob("run-*"))) == 2
    log.append(spark.createDataFrame([], ledger_log.LEDGER), 21)
    assert log.newest().count() == len(want) + 50


def test_payloads_that_were_lost(spark, tmp_path):
    sig = "name string, container string, suggested_extension string"
    rows = [("TextAsset", "text_bytes", "a/s.acb", b"1"), ("TextAsset", "raw", "a/m.usm.bytes", b"2"), ("Font", None, "a/f", b"3"), (None, None, "a/g", b"4"), ("TextAsset", "raw", "a/n", None)]
    reads = spark.createDataFrame(rows, "type string, payload_kind string, target string, payload binary")
    assert {(x.path, bytes(x.data)) for x in files.payload_files(reads).collect()} == {("a/s.acb", b"1"), ("a/m.usm.bytes", b"2"), ("a/f", b"3"), ("a/g", b"4")}
    packed = containers.pack([("0.png", b"p"), ("d/1.png", b"q")])
    rows = [("Font", "raw", "a/f.ttf", b"3", 1, "n", None, None), ("Font", "raw", "a/f.ttf", b"3", 2, "n", None, None), ("Font", "raw", "a/f.ttf", b"4", 3, "n", None, None), ("Texture2DArray", "image_array_bundle_png", "a/t.png", packed, 4, "t", "c", None), ("Font", "raw", "a/f.ttf", b"", 0, "n", None, None)]
    claimed = files.claimed_reads(spark.createDataFrame(rows, f"type string, payload_kind string, target string, payload binary, arrival long, {sig}"))
    written = files.write_files(files.payload_files(claimed), str(tmp_path / "out"))
    manifest = {(x.path, x.asset_type, x.name) for x in files.manifest_rows(claimed, written.select("path")).collect()}
    assert manifest == {("a/f.ttf", "Font", "n"), ("a/f__dup2.ttf", "Font", "n"), ("a/t/0.png", "Texture2DArray", "t"), ("a/t/d/1.png", "Texture2DArray", "t")}


def test_staging(spark):
    states = spark.createDataFrame([("a.bundle", "ready"), ("b.bundle", "placeholder"), ("c.bundle", "kept")], "stored string, state string")
    assert {x.path for x in files.staging_files(states).collect()} == {"b.bundle", files.SPARSE}
    assert files.staging_files(states.where("state = 'ready'")).count() == 0
    with pytest.raises(Exception, match="missing staged bundle"):
        files.staging_files(spark.createDataFrame([("a.bundle", "missing")], states.schema)).collect()


def test_arrays_of_any_spelling(spark):
    rows = [("b", 1, "texture2d_array", "c/x"), ("b", 2, "Texture2DArrayImage", "C/X"), ("b", 3, "texture 2D-array image", "c/y"), ("d", 4, "Texture2DArrayImage", "c/x")]
    o = spark.createDataFrame(rows, "bundle string, index long, type string, container string")
    assert sorted(x["index"] for x in objects.without_array_images(o).collect()) == [1, 3, 4]
    assert [x[0] for x in o.select(objects.is_image(F.col("type"))).collect()] == [True] * 4


def test_many_outputs_at_one_path(spark):
    rows = [("p.txt", bytes([i % 200, i // 200]), i, *("s",) * 5) for i in range(900)] + [("p.txt", b"\0\0", 5000, *("s",) * 5)]
    schema = "path string, payload binary, arrival long, type string, name string, container string, payload_kind string, suggested_extension string"
    got = {r.arrival: r.output for r in grouping.distinct_outputs(spark.createDataFrame(rows, schema)).collect()}
    assert got == {i: "p.txt" if not i else f"p__dup{i + 1}.txt" for i in range(900)}


def test_composed_files(spark, tmp_path):
    parts = spark.createDataFrame([(f"d/{k % 3}", k, None if k == 7 else bytes([k]) * (k * 1000)) for k in random.Random(1).sample(range(60), 60)], "path string, at long, data binary").repartition(4)
    rows = {r.path: (r.bytes, r.sha256) for r in composed.write_composed(parts, str(tmp_path)).collect()}
    for k in range(3):
        want = b"".join(bytes([i]) * (i * 1000) for i in range(k, 60, 3) if i != 7)
        assert (tmp_path / f"d/{k}").read_bytes() == want and rows[f"d/{k}"] == (len(want), hashlib.sha256(want).hexdigest())
    assert sorted(p.name for p in (tmp_path / "d").iterdir() if not p.name.endswith(".crc")) == ["0", "1", "2"]
    assert composed.write_composed(parts.where("at < 0"), str(tmp_path / "none")).count() == 0
    items = [(f"n{i}", i, b"x" * i) for i in range(20)] + [("null", 20, None)]
    df = spark.createDataFrame([("a", *x) for x in items] + [("b", "é", 1, b"")], "path string, name string, ord long, data binary")
    for magic in (b"", b"GROUP"):
        list(composed.write_composed(composed.container_parts(df, magic), str(tmp_path / "c")).collect())
        assert containers.entries((tmp_path / "c/a").read_bytes(), magic) == [(n, d or b"") for n, _, d in items] and containers.entries((tmp_path / "c/b").read_bytes(), magic) == [("é", b"")]
    assert (tmp_path / "c/a").read_bytes()[:5] == b"GROUP"
    seg = [("d", "jam-001", b"CRI"), ("d", "jam-002", b"DPA"), ("d", "jam-003", b"YLD"), ("e", "jam-001", b"A"), ("e", "jam-003", b"B"), ("f", "p-001", b"CRID"), ("f", "p-003__dup8", b"TAIL"), ("f", "p-002__dup8", b"CONT"), ("g", "solo", b"S"), ("g", "p-2", b"T")]
    cut = composed.segment_parts(spark.createDataFrame(seg, "dir string, stem string, data binary"))
    list(composed.write_composed(cut, str(tmp_path / "s")).collect())
    assert {str(p.relative_to(tmp_path / "s")): p.read_bytes() for p in (tmp_path / "s").rglob("*") if p.is_file()} == {"d/jam": b"CRIDPAYLD", "e/jam-001": b"A", "e/jam-003": b"B", "f/p": b"CRIDCONTTAIL", "g/solo": b"S", "g/p-2": b"T"}
    objects_ = spark.createDataFrame([("c/é\"x.playable", "b", 1, "T", "1"), ("c/é\"x.playable", None, 2, "T", "{}"), ("c/é\"x.playable", "a", 3, "U", None), (" ", "z", 4, "T", "")], "container string, name string, index long, type string, data string")
    (written,) = composed.write_composed(composed.document_parts(objects_), str(tmp_path / "j")).collect()
    assert json.loads((tmp_path / "j" / written.path).read_text()) == {"container": 'c/é"x.playable', "object_count": 3, "objects": [{"name": None, "type": "T", "data": "{}"}, {"name": "a", "type": "U", "data": None}, {"name": "b", "type": "T", "data": "1"}]}


def test_process_trees(spark):
    def brute(rows, root):
        found = {p for p, _, _ in rows if p == root}
        while more := {p for p, q, _ in rows if q in found} - found:
            found |= more
        return sum(c for p, _, c in rows if p in found) or None

    r = random.Random(6)
    for case in ([(i, i - 1, 1) for i in range(3000)], [(1, 3, 1), (2, 1, 2), (3, 2, 4), (4, 3, 8), (5, 6, 16), (6, 5, 32), (7, 7, 64), (8, None, 128)], [(i, r.randint(0, 60) or None, i) for i in range(1, 60)]):
        df = spark.createDataFrame(case, "pid long, ppid long, cpu long")
        for root in (1, 5, 99_999):
            assert grouping.process_tree_sum(spark, df, root).first().cpu == brute(case, root)


UPDATE = "job_id string, at timestamp, seq long, update_type string, bundle string, n long, message string"


def stream(df, folder, mode="update"):
    """What a run of a query gives for what is new."""
    rows = []
    q = df.writeStream.foreachBatch(lambda batch, n: rows.extend(batch.collect())).outputMode(mode).trigger(availableNow=True).option("checkpointLocation", folder).start()
    try:
        q.awaitTermination(60)
    finally:
        q.stop()
    return rows


def test_folds_of_streams_in_any_chunks(spark, tmp_path, monkeypatch):
    """Against the batch fold: cancellations between rows, ends in any order, chunks of a few rows."""
    from datetime import datetime, timedelta

    r, t0 = random.Random(9), datetime(2024, 1, 1)
    kinds = ["DownloadsPlanned", "BundleStarted", "BundleCompleted", "BundleFailed", "SchedulerTelemetry", "Completed", "Failed", "RecordSaved", "Phase"]
    rows = [(f"j{j}", t0 + timedelta(seconds=r.randint(0, 90)), i, r.choice(kinds), f"b{i}", i, "m") for j in range(8) for i in range(150)]
    rows += [(f"j{j}", t0 + timedelta(seconds=40 + j), 999, "Cancelled", None, None, None) for j in range(3)]
    r.shuffle(rows)
    df = spark.createDataFrame(rows, UPDATE)
    df.coalesce(1).write.parquet(str(tmp_path / "in"))
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", 20)
    try:
        snapshots = stream(progress.fold_stream(spark.readStream.schema(UPDATE).parquet(str(tmp_path / "in"))), str(tmp_path / "cp"))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    got = {x.job_id: (x.total, x.completed, x.failed, x.phase, x.status, x.at) for x in snapshots}
    want = {x.job_id: (x.total, x.completed, x.failed, x.phase, x.status, x.updated_at) for x in progress.fold(df).collect()}
    assert got == want and {v[4] for v in got.values()} > {"cancelled"}
    recent = {}
    for x in progress.recent(df.where("job_id > 'j2'")).orderBy("job_id", F.desc("place")).collect():
        recent.setdefault(x.job_id, []).append(x.text)
    assert {x.job_id: x.recent for x in snapshots if x.job_id > "j2"} == recent


def test_jobs_that_ended_stay_so_and_are_forgotten_in_time(spark, tmp_path):
    from datetime import datetime

    row = lambda k, kind: [("j", datetime(2024, 1, 1, 0, 0, k), k, kind, "b", 1, "m")]
    source, seen = str(tmp_path / "in"), []
    for k, kind in enumerate(["BundleCompleted", "Failed", "Completed", "Cancelled", "BundleCompleted"]):
        spark.createDataFrame(row(k, kind), UPDATE).write.mode("append").parquet(source)
        seen.append([(x.status, x.completed) for x in stream(progress.fold_stream(spark.readStream.schema(UPDATE).parquet(source)), str(tmp_path / "cp"))])
    assert seen == [[("running", 1)], [("failed", 1)], [("failed", 1)], [("cancelled", 1)], []]
    source, rows = str(tmp_path / "in2"), []
    spark.createDataFrame(row(0, "Completed"), UPDATE).write.parquet(source)
    kept = progress.fold_stream(spark.readStream.schema(UPDATE).parquet(source), keep_ms=1)
    q = kept.writeStream.foreachBatch(lambda batch, n: rows.extend(batch.collect())).outputMode("update").option("checkpointLocation", str(tmp_path / "cp2")).start()
    try:  # with timers a query runs batches until it is stopped
        for k, kind in enumerate(["BundleCompleted"] * 2, 1):
            for _ in range(60):
                time.sleep(0.5)
                if len(rows) >= k:
                    break
            time.sleep(2)
            spark.createDataFrame(row(k, kind), UPDATE).write.mode("append").parquet(source)
    finally:
        q.stop()
    assert [(x.status, x.completed) for x in rows[:2]] == [("completed", 0), ("running", 1)]


def test_claims_across_runs(spark, tmp_path):
    schema = "path string, payload binary, arrival long, type string, name string, container string, payload_kind string, suggested_extension string"
    r = random.Random(12)
    rows = [(r.choice(["a/x.png", "a/y", "b/z.tar.gz"]), bytes([r.randint(0, 6)]), i, r.choice(["t", None]), "n", None, "k", "e") for i in range(120)]
    source, got = str(tmp_path / "in"), {}
    for k in range(3):
        spark.createDataFrame(rows[40 * k : 40 * k + 40], schema).write.mode("append").parquet(source)
        got |= {x.arrival: x.output for x in stream(progress.claim_stream(spark.readStream.schema(schema).parquet(source)), str(tmp_path / "cp"), "append")}
    want = {x.arrival: x.output for x in grouping.distinct_outputs(spark.createDataFrame(rows, schema)).collect()}
    assert got == want and len(want) > 30


def test_literal_patterns(spark, tmp_path):
    assert [patterns.literal(p) for p in ("^a/b", "a-b", r"a\.b", "^", "a.b", "a$", "(a)", r"\d", "a\\", "é ü")] == [(True, "a/b"), (False, "a-b"), (False, "a.b"), (True, ""), None, None, None, None, None, (False, "é ü")]
    r = random.Random(14)
    word = lambda n: "".join(r.choices("ab.-/ é", k=n))
    texts = [word(r.randint(0, 12)) for _ in range(400)] + [None]
    df = spark.createDataFrame([(t,) for t in texts], "t string")
    for n in (1, 3, 5, 60):
        asked = [word(r.randint(1, 4)) for _ in range(n)]
        for anchor in ("", "^"):
            given = [anchor + re.escape(x).replace(r"\é", "é") for x in asked]
            got = [x[0] for x in df.select(patterns.any_match(F.col("t"), given)).collect()]
            test = str.startswith if anchor else str.__contains__
            assert got == [None if t is None else any(test(t, x) for x in asked) for t in texts]
            first = [x[0] for x in df.select(patterns.first_match(F.col("t"), given)).collect()]
            assert first == [None if t is None else next((k for k, x in enumerate(asked) if test(t, x)), None) for t in texts]
    many = sorted({f"bundle/{r.randint(0, 10**6)}" for _ in range(1000)})
    whole = patterns.shared_beginnings(many)
    assert whole.count("bundle/") == 1 and [re.match(whole, m) is not None for m in many] == [True] * len(many) and not re.match(whole, "bundle/x")
    assert patterns.any_match(F.col("t"), many) is not None
    df.write.parquet(str(tmp_path / "t"))
    shown = io.StringIO()
    with contextlib.redirect_stdout(shown):
        spark.read.parquet(str(tmp_path / "t")).where(patterns.any_match(F.col("t"), ["^a/", "^b"])).explain("formatted")
    assert re.search(r"PushedFilters: \[.*StringStartsWith\(t,a/\).*StringStartsWith\(t,b\)", shown.getvalue())
