"""The engine's expressions and operators against fixtures, and its streams against their batch twins."""

import json
import struct

import pytest
from pyspark.sql import functions as F

from tidemark.functions import codecs, paths, patterns, values
from tidemark.operators import grouping, metrics, objects, planning
from tidemark.sources import catalog, containers, files, messagepack, sinks
from tidemark.sources.ledger_log import LedgerLog
from tidemark.streaming import progress


def one(spark, expression, **columns):
    row = spark.range(1).select(*[F.lit(v).alias(k) for k, v in columns.items()], F.lit(0).alias("_")).select(expression).first()
    return row[0]


def test_patterns(spark):
    match = lambda text, *p: one(spark, patterns.any_match(F.col("x"), list(p)), x=text)
    assert match("start/a", "^start/") and not match("other/a", "^start/") and not match("x")
    assert not match("abc\n", "abc$") and match("é", r"^\w$") and match("a\rb", "a.b")
    first = lambda text: one(spark, patterns.first_match(F.col("x"), ["^music/.*", "^event/.*"]), x=text)
    assert (first("music/long/test"), first("event/live"), first("other/path")) == (0, 1, None)
    for bad in ("(", "(?=a)b", r"(a)\1"):
        with pytest.raises(patterns.PatternError):
            patterns.check_all([bad])


@pytest.mark.parametrize("given, stored", [("live/body/foo", "live/body/foo.bundle"), ("a/01_00.bundle", "a/01_00.bundle"), ("a.b", "a.bundle"), ("", None), ("/abs", None), ("../x", None), ("s/../x", None), ("s/./x", None), ("a/.hid", "a/.hid.bundle")])
def test_bundle_file(spark, given, stored):
    assert one(spark, paths.bundle_file(F.col("x")), x=given) == stored


@pytest.mark.parametrize("given, entry", [("../escape/asset.bin", "escape/asset.bin"), ("/abs.bin", "abs.bin"), ("..", "payload.bin"), ("a\\b", "a/b")])
def test_safe_entry(spark, given, entry):
    assert one(spark, paths.safe_entry(F.col("x")), x=given) == entry


def test_names(spark):
    fix = lambda x: one(spark, paths.fix_file_name(F.col("x")), x=x)
    assert fix("CharacterMotionClip(Clone)(Clone)(Clone)(Clone)") == "CharacterMotionClip__clone4"
    assert fix("a(Clone)") == "a(Clone)" and fix('a<b>:"/\\|?*\x01') == "a_b" + "_" * 9
    assert len(fix("é" * 300)) == 220 and fix("é" * 300).endswith("__truncated")
    text = lambda x: one(spark, paths.text_asset_file(F.col("x")), x=x)
    assert [text(f"out/{x}.bytes") for x in ("foo.acb", "foo.usm", "foo", "banner.jpg")] == ["out/foo.acb", "out/foo.usm", "out/foo", "out/banner.jpg"]
    assert text("out/music_score/001/append.bytes") == "out/music_score/001/append.txt"
    assert one(spark, paths.percent_encode(F.col("x")), x="a b~*é+") == "a%20b~%2A%C3%A9%2B"
    base, n = paths.segment_key(F.col("x"))
    assert [(one(spark, base, x=x), one(spark, n, x=x)) for x in ("t-001", "t-2__dup8", "x-0", "plain")] == [("t", 1), ("t", 2), (None, None), (None, None)]
    assert one(spark, paths.render("{b}-{bucket}", b=F.lit("{bucket}"), bucket=F.lit("x"))) == "x-x"
    assert one(spark, paths.storage_prefix(F.col("x")), x=" /upload/test/ ") == "upload/test" and one(spark, paths.storage_prefix(F.col("x")), x="  ") is None
    assert one(spark, paths.components(F.lit("a/b")) < paths.components(F.lit("a.b")))


def test_values(spark):
    assert one(spark, values.metric_lines(F.col("x")), x="a\nx metrics: 1\nPlanned 2\nb") == "x metrics: 1 | Planned 2"
    assert one(spark, values.failure_kind(F.col("x"))[0], x="HTTP 500") == "network" and one(spark, values.failure_kind(F.col("x"))[1], x="HTTP 500")
    assert one(spark, values.category(F.col("x")), x="live_pv") == "LivePv" and one(spark, values.category(F.lit(None).cast("string"))) == ""
    assert one(spark, objects.read_kind(F.lit("AnimatorController"), {"all": "raw", "animator": "typetree_json"})) == "typetree_json"
    assert [one(spark, objects.read_kind(F.lit(t), {})) for t in ("Sprite", "TextAsset", "ParticleSystem")] == ["image", "text_bytes", "typetree_json"]
    ext = lambda kind, p, s=None: one(spark, objects.output_extension(F.lit(kind), F.lit(p), F.lit(s).cast("string")))
    assert (ext("X", "typetree_json"), ext("X", "raw"), ext("X", "animator_bundle_fbx"), ext("X", "text_bytes", ".TXT"), ext("Mesh", None)) == ("json", "dat", "", "txt", "obj")
    assert one(spark, values.retry_status(F.lit(429))) and not one(spark, values.retry_status(F.lit(404)))
    assert one(spark, values.backoff_ms(F.lit(5), 100, 1000)) == 1000


@pytest.mark.parametrize("n", [0, 3, 127, 128, 300])
def test_deobfuscate(spark, n):
    body = bytes(i * 7 % 256 for i in range(n))
    mask = bytes([255] * 5 + [0] * 3) * 16
    shown = bytes(a ^ b for a, b in zip(body, mask)) + body[128:] if n >= 128 else body
    get = lambda data: bytes(one(spark, codecs.deobfuscate(F.lit(data))))
    assert get(b"\x10\0\0\0" + body) == shown and get(b"\x20\0\0\0" + body) == body and get(b"\x09\x08\x07") == b"\x09\x08\x07"
    assert one(spark, codecs.little_endian(F.lit(b"\x01\x02\x00\x00"), 0, 4)) == 513 and one(spark, codecs.little_endian(F.lit(b"\x01"), 0, 4)) is None


def mp(x):
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        return struct.pack(">Bq", 0xD3, x)
    if isinstance(x, str):
        return struct.pack(">BH", 0xDA, len(x.encode())) + x.encode()
    if isinstance(x, list):
        return struct.pack(">BH", 0xDC, len(x)) + b"".join(map(mp, x))
    return struct.pack(">BI", 0xDF, len(x)) + b"".join(mp(k) + mp(v) for k, v in x.items())


def test_encrypted_catalogue(spark, tmp_path):
    key, iv = "00112233445566778899aabbccddeeff", "0102030405060708090a0b0c0d0e0f10"
    whole = mp({"version": "1", "bundles": {"start/a": {"hash": "hash-a", "category": "StartApp", "crc": 123, "fileSize": 1, "dependencies": ["x"], "isBuiltin": False}, "b": {"hash": None, "category": None}}})
    out = spark.range(1).select(F.aes_encrypt(F.lit(whole), F.unhex(F.lit(key)), F.lit("CBC"), F.lit("PKCS"), F.unhex(F.lit(iv)))).first()[0]
    (tmp_path / "c").write_bytes(bytes(out)[16:])
    rows = {r.bundle_name: r for r in catalog.read_catalogues(spark, str(tmp_path / "c"), key, iv).collect()}
    assert (rows["start/a"].hash, rows["start/a"].crc, rows["start/a"].category, rows["start/a"].paths) == ("hash-a", 123, "StartApp", [])
    assert (rows["b"].hash, rows["b"].category) == ("", "")
    for k, v in (("00", iv), (key, "00"), ("zz" * 16, iv)):
        with pytest.raises(ValueError):
            codecs.check_key(k, v)
    assert one(spark, codecs.decrypt(F.lit(b"123"), key, iv, strict=False)) is None


def test_containers(spark):
    items = [("7", b"abc"), ("b.bin", b"def")]
    packed = containers.pack(items)
    grouped = b"GROUPED" + struct.pack("<I", 2) + b"".join(struct.pack("<IQ", len(n), 3) + n.encode() for n in ("layer_0000.bmp", "nested/layer_0001.bmp")) + b"onetwo"
    assert containers.entries(packed) == items
    assert containers.entries(grouped, b"GROUPED") == [("layer_0000.bmp", b"one"), ("nested/layer_0001.bmp", b"two")]
    for bad in (packed + b"x", packed[:-1], b"", b"x" * 40):
        with pytest.raises(ValueError):
            containers.entries(bad)
    rows = spark.createDataFrame([(1, packed), (2, b"bad")], "id long, content binary")
    out = containers.explode_containers(rows, "content", ["id"]).collect()
    assert [(r.id, r.ord, r.name, r.data and bytes(r.data)) for r in out if r.error is None] == [(1, 0, "7", b"abc"), (1, 1, "b.bin", b"def")] and sum(r.error is not None for r in out) == 1
    again = containers.containers_of(containers.explode_containers(rows.where("id = 1"), "content", ["id"]), "id").first()
    assert bytes(again.content) == packed
    image = b"\0" * 16 + struct.pack("<IIII", 1, 2, 8, 1) + b"\0" * 4 + b"RGBA----rgba----"
    assert containers.pixels(image) == (1, 2, b"RGBArgba") and containers.png(1, 2, b"RGBArgba").startswith(b"\x89PNG")


def test_planning(spark):
    cat = spark.createDataFrame([("start/a", "h1", 5, 1, "StartApp", None), ("start/aa", "h2", 6, 1, "StartApp", None), ("ond/a", "h", 1, 1, "OnDemand", None), ("other/a", "h", 1, 1, "OnDemand", None), ("skip/a", "h", 1, 1, "StartApp", None), ("live/body", "h", 1, 1, "LivePv", None)], "bundle_name string, hash string, crc long, file_size long, category string, download_path string")
    f = planning.Filters(start_app=["^start/"], on_demand=["^ond/"], skip=["^skip/"], priority=["^ond/", "^start/aa"])
    led = lambda h: spark.createDataFrame([("start/a", h)], "bundle_path string, hash string")
    names = lambda df: [r.bundle_path for r in planning.in_order(df).collect()]
    assert names(planning.plan(cat, led("h1"), f)) == ["ond/a", "start/aa"] and names(planning.plan(cat, led("OLD"), f)) == ["ond/a", "start/aa", "start/a"]
    none = spark.createDataFrame([], "bundle_path string, hash string")
    staged = planning.plan_staged(cat, none, f, ["^(start/a$|live/body)"])
    both = {r.bundle_path: (r.export_payloads, r.stage_3d) for r in planning.merge(planning.plan(cat, none, planning.Filters(start_app=["^start/a$"])), staged).collect()}
    assert both == {"start/a": (True, True), "live/body": (False, True)}
    assert planning.plan_staged(cat, none, f, []).count() == 0 and planning.prefetch(cat, f, []).count() == 6 and planning.prefetch(cat, f, None).count() == 0
    assert planning.plan(cat, none, planning.Filters()).count() == 0


def test_ledger_files(spark, tmp_path):
    p = tmp_path / "ledger.json"
    assert catalog.read_ledger(spark, str(p)).count() == 0
    p.write_text(json.dumps({"a": "1", "b": "2"}))
    led = catalog.read_ledger(spark, str(p))
    assert {(r.bundle_path, r.hash) for r in led.collect()} == {("a", "1"), ("b", "2")}
    p.write_text("{broken")
    assert catalog.read_ledger(spark, str(p)).count() == 0 and not p.exists() and (tmp_path / "ledger.json.corrupt").read_text() == "{broken"
    for text in ('{"a": "1",\n "b": "2', '{\n  "a": "1",\n', '"a": "1"', '{"a": 1]}'):
        p.write_text(text)
        assert catalog.read_ledger(spark, str(p)).count() == 0 and not p.exists(), text
    odd = {"a": "1", 'q"}{,': "x}", "ü/b c": "", "e\\n": "2,"}
    for text in (json.dumps(odd), json.dumps(odd, indent=2, sort_keys=True), "{}", ""):
        p.write_text(text)
        assert {r.bundle_path: r.hash for r in catalog.read_ledger(spark, str(p)).collect()} == (odd if len(text) > 2 else {}) and p.exists()
    rows = spark.createDataFrame(list(odd.items()), "bundle_path string, hash string")
    for ledger in (rows, rows.limit(0)):
        sinks.write_ledger_json(ledger, str(tmp_path / "out"))
        assert sorted(map(tuple, catalog.read_ledger(spark, str(tmp_path / "out")).collect())) == sorted(map(tuple, ledger.collect()))
    table = str(tmp_path / "table")
    assert catalog.read_ledger_table(spark, table).count() == 0
    for n in (3, 2, 4, 1):
        sinks.write_ledger(rows.limit(n), table)
        assert catalog.read_ledger_table(spark, table).count() == n and len(catalog.ledger_versions(spark, table)) <= 2
    (tmp_path / "table/version=9").mkdir()  # a crash left one that isn't whole
    assert catalog.read_ledger_table(spark, table).count() == 1
    (tmp_path / "x").mkdir()
    (tmp_path / "x/A.PNG").write_bytes(b"1")
    (tmp_path / "x/b.txt").write_bytes(b"22")
    assert [r.length for r in catalog.list_files(spark, str(tmp_path / "x"), "png").collect()] == [1]


def test_segments_and_duplicates(spark):
    rows = [("d", "jam-001", b"CRI"), ("d", "jam-002", b"DPA"), ("d", "jam-003", b"YLD"), ("e", "jam-001", b"A"), ("e", "jam-003", b"B"), ("f", "p-001", b"CRID"), ("f", "p-003__dup8", b"TAIL"), ("f", "p-002__dup8", b"CONT"), ("g", "solo", b"S")]
    out = {(r.dir, r.stem): (bytes(r.data), r.merged) for r in grouping.merge_segments(spark.createDataFrame(rows, "dir string, stem string, data binary")).collect()}
    assert out == {("d", "jam"): (b"CRIDPAYLD", 3), ("e", "jam-001"): (b"A", 0), ("e", "jam-003"): (b"B", 0), ("f", "p"): (b"CRIDCONTTAIL", 3), ("g", "solo"): (b"S", 0)}
    sig = ("t", "n", "c", "k", "e")
    given = [("a/x.png", b"1", 1, *sig), ("a/x.png", b"1", 2, *sig), ("a/x.png", b"2", 3, *sig), ("a/x.png", b"1", 4, *sig[:4], None), ("a/x.png", b"1", 5, *sig[:4], None)]
    found = grouping.distinct_outputs(spark.createDataFrame(given, "path string, payload binary, arrival long, type string, name string, container string, payload_kind string, suggested_extension string"))
    assert sorted((r.arrival, r.output) for r in found.collect()) == [(1, "a/x.png"), (3, "a/x__dup2.png"), (4, "a/x__dup3.png")]
    tree = spark.createDataFrame([(10, 1, 3), (11, 10, 5), (12, 10, 7), (13, 11, 11), (14, 99, 13)], "pid long, ppid long, cpu long")
    assert grouping.process_tree_sum(spark, tree, 10).first().cpu == 26


def test_batches(spark):
    o = lambda kinds: spark.createDataFrame([("b", i, k) for i, k in enumerate(kinds)], "bundle string, index long, type string")
    size = lambda kinds, n: objects.batch_size(o(kinds), n).first().batch
    assert (size(["Sprite"] * 80, 32), size(["MonoBehaviour"] * 60 + ["X"] * 20, 128), size(["TextAsset"], 0)) == (64, 32, 1)
    parts = objects.in_chunks(o(["TextAsset", "Mesh", "Sprite", "Sprite", "Mesh", "Mesh"]), 5).orderBy("index").collect()
    assert [(r.chunk, r.part) for r in parts] == [(0, 0), (0, 0), (0, 1), (0, 2), (0, 3), (1, 0)]
    stats = metrics.merged(spark.sql("SELECT 1 AS k, map('a', 1L, 'b', 2L) AS m UNION ALL SELECT 1, map('a', 5L)"), "m", ["k"]).first()
    assert stats.metrics == {"a": 6, "b": 2}


UPDATE = "job_id string, at timestamp, seq long, update_type string, bundle string, n long, message string"


def test_progress_stream_agrees_with_batch(spark, tmp_path):
    from datetime import datetime, timedelta

    t0 = datetime(2024, 1, 1)
    kinds = ["DownloadsPlanned", "BundleStarted", "BundleCompleted", "BundleFailed", "SchedulerTelemetry", "BundleCompleted", "RecordSaved"]
    rows = [(f"j{j}", t0 + timedelta(seconds=i), i, kinds[i % 7], f"b{i}", i, "m") for j in range(3) for i in range(40)] + [("j1", t0 + timedelta(seconds=20, milliseconds=1), 99, "Cancelled", None, None, None)]
    df = spark.createDataFrame(rows, UPDATE)
    df.write.parquet(str(tmp_path / "in"))
    q = progress.fold_stream(spark.readStream.schema(UPDATE).parquet(str(tmp_path / "in"))).writeStream.format("memory").queryName("snapshots").outputMode("update").trigger(availableNow=True).option("checkpointLocation", str(tmp_path / "cp")).start()
    q.awaitTermination(180)
    streamed = {r.job_id: (r.total, r.completed, r.failed, r.phase, r.status == "cancelled") for r in spark.table("snapshots").collect()}
    folded = {r.job_id: (r.total, r.completed, r.failed, r.phase, r.cancelled) for r in progress.fold(df).collect()}
    assert streamed == folded and folded["j1"][4] and folded["j1"][1] < folded["j0"][1]
    assert all(len(r.recent) <= 20 for r in spark.table("snapshots").collect()) and progress.recent(df).groupBy("job_id").count().agg(F.max("count")).first()[0] == 20


def test_incremental_stream(spark, tmp_path):
    schema = "bundle_name string, hash string, crc long, file_size long, category string, download_path string"
    ledger, drops = str(tmp_path / "ledger"), str(tmp_path / "drops")
    LedgerLog(spark, ledger).append(spark.createDataFrame([("start/a", "h1")], "bundle_path string, hash string"), -1)
    seen = []
    plan = lambda batch, known: planning.plan(batch, known, planning.Filters(start_app=["^start/"]))
    for k, rows in enumerate([[("start/a", "h1"), ("start/b", "h1")], [("start/a", "h2"), ("start/b", "h1")]]):
        spark.createDataFrame([(n, h, 0, 0, "StartApp", None) for n, h in rows], schema).write.mode("append").parquet(drops)
        progress.incremental(spark.readStream.schema(schema).parquet(drops), ledger, plan, lambda t, n: seen.append(sorted(r.bundle_path for r in t.collect())), str(tmp_path / "cp")).awaitTermination(180)
    assert seen == [["start/b"], ["start/a"]]
    log = LedgerLog(spark, ledger)
    assert sorted(map(tuple, log.newest().collect())) == [("start/a", "h2"), ("start/b", "h1")] and sorted(map(tuple, log.newest(0).collect())) == [("start/a", "h1")]
    spark.createDataFrame([("start/z", "h", 0, 0, "StartApp", None)], schema).write.parquet(str(tmp_path / "more"))
    progress.incremental(spark.readStream.schema(schema).parquet(str(tmp_path / "more")), str(tmp_path / "no-ledger-yet"), plan, lambda t, n: seen.append(t.count()), str(tmp_path / "cp2")).awaitTermination(180)
    assert seen[-1] == 1 and LedgerLog(spark, str(tmp_path / "no-ledger-yet")).newest().count() == 1


def test_terminal_states(spark):
    from datetime import datetime, timedelta

    def status(*kinds):
        rows = [("j", datetime(2024, 1, 1) + timedelta(seconds=i), i, k, None, None, None) for i, k in enumerate(kinds)]
        return progress.fold(spark.createDataFrame(rows, UPDATE)).first().status

    assert status("BundleStarted") == "running" and status("Completed", "Failed") == "completed" and status("Failed", "Completed") == "failed"
    assert status("Failed", "Cancelled") == "cancelled" and status("Cancelled", "Completed") == "cancelled" and status("Completed", "BundleFailed") == "completed"


def test_files(spark, tmp_path):
    head = bytes.fromhex(codecs.PLAIN_HEAD)
    given = spark.createDataFrame([("a/b.dat", head + b"x" * 9), ("c", b"plain"), ("a/d.bundle", b"")], "bundle_path string, content binary")
    root = tmp_path / "out"
    for _ in range(2):  # again, as a task does that is run again
        written = {r.path: r.bytes for r in files.write_files(files.bundle_files(given), str(root)).collect()}
        assert written == {"a/b.bundle": 9, "c.bundle": 5, "a/d.bundle": 0}
        assert {str(p.relative_to(root)): p.read_bytes() for p in root.rglob("*") if p.is_file()} == {"a/b.bundle": b"x" * 9, "c.bundle": b"plain", "a/d.bundle": b""}
    with pytest.raises(Exception, match="unsafe bundle path"):
        files.bundle_files(spark.createDataFrame([("../x", b"")], given.schema)).collect()
    assert files.write_files(files.bundle_files(given.limit(0)), str(root)).count() == 0
    image = b"\0" * 16 + struct.pack("<IIII", 1, 1, 4, 1) + b"\0" * 4 + b"RGBA"
    reads = [("Font", "font", "x/f.ttf", b"f"), ("Font", "raw", "x/empty", b""), ("Sprite", "image_raw_rgba", "x/s.bin", image), ("Sprite", "image_raw_rgba", "x/t.bin", b"bad"), ("Texture2DArray", "image_array_bundle_png", "x/arr.png", containers.pack([("../l0.png", b"0"), ("sub/l1.png", b"1")])), ("Texture2DArray", "image_array_bundle_png", "bad", b"?"), ("Mesh", "unsupported", "x/m", b"m")]
    found = {r.path: (r.data and bytes(r.data), r.error is None) for r in files.payload_files(spark.createDataFrame(reads, "type string, payload_kind string, target string, payload binary")).collect()}
    assert found.pop("x/s.png")[0].startswith(b"\x89PNG")
    assert found == {"x/f.ttf": (b"f", True), "x/t.png": (None, False), "x/arr/l0.png": (b"0", True), "x/arr/sub/l1.png": (b"1", True), "bad": (None, False)}


def test_lookups_that_fail(spark):
    known = spark.createDataFrame([("one", "s3"), (None, "gcs"), (" ", "s3"), ("two", "s3"), ("two", "x")], "name string, scheme string")
    ask = lambda *names: planning.providers(known, spark.createDataFrame([(n,) for n in names], "selector string"))
    assert sorted((r.selector, r.scheme) for r in ask(" one", "GCS", "S3").collect()) == [("GCS", "gcs"), ("S3", "s3"), ("one", "s3")]
    for bad in ("two", "none"):
        with pytest.raises(Exception, match="not exactly one storage provider"):
            ask(bad).collect()
    batches = lambda failed: spark.sql(f"SELECT array(1, 2) AS assets, array('x') AS outputs, {failed} AS failed")
    assert objects.paired(batches("true")).count() == 0
    with pytest.raises(Exception, match="as many outputs"):
        objects.paired(batches("false")).collect()
    for cut in (b"\xa5ab", b"\xcb\0", b"\xd9", b"\xcd\1", b"\xdd\0", b""):
        with pytest.raises(ValueError):
            messagepack.unpack(cut)
