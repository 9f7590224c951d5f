"""More queries: sinks read back, configuration joins, and the scalar functions that plans use here and there."""

from __future__ import annotations

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import codecs, paths, values
from ..operators import grouping, metrics, objects, planning
from ..sources import catalog, containers, files, sinks
from ..sources.scratch import scratch
from ..streaming import progress
from .queries import FILTERS, IMAGE, STAGED, TASKS, query
from .stand_ins import CATALOGUE, OBJECTS, catalogue, ledger, ledger_sql, table
from .stand_ins import objects as object_rows

LEDGER = f"WITH {CATALOGUE}, {ledger_sql()} SELECT bundle_path, hash FROM ledger"


@query(LEDGER)
def ledger_round_trip(spark, d):
    """A ledger written as JSON maps and read back."""
    place = scratch(spark, "ledger")
    sinks.write_ledger_json(ledger(spark, d), place)
    return catalog.read_ledger(spark, place)


@query(LEDGER)
def ledger_versions(spark, d):
    """A ledger table whose newest of three versions counts."""
    place = scratch(spark, "ledger")
    for rows in (ledger(spark, d, "toxic"), ledger(spark, d, "toxic"), ledger(spark, d)):
        sinks.write_ledger(rows, place)
    return catalog.read_ledger_table(spark, place)


@query("SELECT 'p/' || page_id || '.bundle' AS path, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages")
def bundle_sink(spark, d):
    """Pages as bundles behind a plain head, written to files."""
    content = F.concat(F.unhex(F.lit(codecs.PLAIN_HEAD)), F.col("html").cast("binary"))
    bundles = table(spark, d, "pages").select(F.concat(F.lit("p/"), F.col("page_id").cast("string"), F.lit(".dat")).alias("bundle_path"), content.alias("content"))
    return files.write_files(files.bundle_files(bundles), scratch(spark, "bundles"))


@query("SELECT 'p/' || page_id AS bundle_path, sha256(html) AS hash FROM pages")
def staged_hashes(spark, d):
    content = F.concat(F.unhex(F.lit(codecs.PLAIN_HEAD)), F.col("html").cast("binary"))
    return files.staged_index(table(spark, d, "pages").select(F.concat(F.lit("p\\"), F.col("page_id").cast("string")).alias("bundle_path"), content.alias("content")))


@query("""SELECT 'out/' || page_id || '.bin' AS path, strlen(html) AS bytes, sha256(html) AS sha256 FROM pages WHERE page_id % 4 IN (1, 3) AND html <> ''
UNION ALL SELECT 'out/' || page_id || '/a/x.png', strlen(html), sha256(html) FROM pages WHERE page_id % 4 = 2 UNION ALL SELECT 'out/' || page_id || '/y.png', strlen(url), sha256(url) FROM pages WHERE page_id % 4 = 2""")
def payload_sink(spark, d):
    """Payloads by route: unsupported ones go, those of several files are taken apart, others are files."""
    pages = table(spark, d, "pages").withColumn("target", F.concat(F.lit("out/"), F.col("page_id").cast("string"), F.lit(".bin")))
    entry = lambda k, name, c: F.struct(F.lit(k).alias("ord"), F.lit(name).alias("name"), F.col(c).cast("binary").alias("data"))
    entries = pages.where("page_id % 4 = 2").select("target", F.explode(F.array(entry(0, "a/x.png", "html"), entry(1, "../y.png", "url"))).alias("e")).select("target", "e.*")
    several = containers.containers_of(entries, "target").select("target", F.lit("Texture2DArray").alias("type"), F.lit("image_array_bundle_png").alias("payload_kind"), F.col("content").alias("payload"))
    single = pages.where("page_id % 4 != 2").select("target", F.lit("Font").alias("type"), F.when(F.col("page_id") % 4 == 0, "unsupported").otherwise("raw").alias("payload_kind"), F.col("html").cast("binary").alias("payload"))
    return files.write_files(files.payload_files(several.unionByName(single)), scratch(spark, "payloads"))


@query(f"WITH {OBJECTS} SELECT container, count(*) AS object_count, count(name) AS named FROM objects WHERE container IS NOT NULL GROUP BY container")
def document_sink(spark, d):
    """Documents of containers written as JSON files and read back."""
    place = scratch(spark, "documents")
    files.write_files(files.document_files(grouping.grouped_documents(object_rows(spark, d))), place).write.format("noop").mode("overwrite").save()
    back = spark.read.schema("container string, object_count long, objects array<struct<name:string>>").option("multiLine", True).option("recursiveFileLookup", True).json(place)
    return back.select("container", "object_count", F.size(F.filter("objects", lambda x: x["name"].isNotNull())).cast("long").alias("named"))


@query("SELECT conv_id, turn, role AS name, text, form FROM conversations, (VALUES ('interleaved'), ('grouped')) f(form)")
def container_round_trip(spark, d):
    """Turns packed into a container for each conversation, in both forms, and taken out again."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("name"), F.col("text").cast("binary").alias("data"))
    # ord of an entry is its place; turns count from 0 without gaps here.
    out = [containers.explode_containers(containers.containers_of(c, "conv_id", magic), "content", ["conv_id"], magic).withColumn("form", F.lit(form)) for form, magic in (("interleaved", b""), ("grouped", b"GROUPED1"))]
    return out[0].unionByName(out[1]).select("conv_id", F.col("ord").alias("turn"), "name", F.col("data").cast("string").alias("text"), "form")


@query(f"""WITH {OBJECTS}, o AS (SELECT * REPLACE (CASE WHEN index % 17 = 0 THEN NULL WHEN index % 19 = 0 THEN ' ' ELSE type END AS type) FROM objects), p AS (SELECT DISTINCT bundle, lower(container) AS container FROM o WHERE type = 'Texture2DArray')
SELECT index, CASE WHEN p.bundle IS NOT NULL THEN 'covered by its texture array' WHEN trim(type) = '' THEN 'type has no read strategy' END AS skipped FROM o LEFT JOIN p ON o.bundle = p.bundle AND lower(o.container) = p.container AND o.type = 'Texture2DArrayImage' WHERE type IS NOT NULL""")
def skipped_objects(spark, d):
    o = object_rows(spark, d)
    kind = F.when(F.col("index") % 17 == 0, None).when(F.col("index") % 19 == 0, " ").otherwise(F.col("type"))
    return objects.readable(o.withColumn("type", kind), ["all"]).select("index", "skipped")


@query(f"WITH {OBJECTS} SELECT bundle, index, row_number() OVER (PARTITION BY bundle ORDER BY {IMAGE}, index) AS place FROM objects")
def isolation_order(spark, d):
    return object_rows(spark, d).select("bundle", "index", F.row_number().over(W.partitionBy("bundle").orderBy(objects.isolation_key())).cast("long").alias("place"))


@query("SELECT l_orderkey AS o_orderkey, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey) - 1 AS place, l_partkey AS asset, l_suppkey AS output FROM lineitem WHERE l_orderkey % 5 <> 0")
def paired_outputs(spark, d):
    """Objects of batches with their outputs by place; failed batches, which lack some, give none."""
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey"))).alias("x"))  # one batch
    outputs = F.col("x.l_suppkey")
    failed = F.col("l_orderkey") % 5 == 0
    batches = lines.select(F.col("l_orderkey").alias("o_orderkey"), F.col("x.l_partkey").alias("assets"), F.when(failed, F.slice(outputs, 2, 99)).otherwise(outputs).alias("outputs"), failed.alias("failed"))
    return objects.paired(batches).withColumn("place", F.col("place").cast("long"))


@query("SELECT trim(n_name) AS selector, n_nationkey AS id FROM nation")
def provider_choice(spark, d):
    """Providers by name, and unnamed ones by scheme."""
    n = table(spark, d, "nation")
    known = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name"), F.lower("n_name").alias("scheme"), F.col("n_nationkey").alias("id"))
    return planning.providers(known, n.select(F.concat(F.lit(" "), "n_name", F.lit(" ")).alias("selector"))).select("selector", "id")


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 < 2 THEN 'h' || o_orderkey % 3 END AS hash, CASE WHEN o_orderkey % 3 = 2 THEN 'no hash is configured for profile p2' END AS note FROM orders")
def profile_hashes(spark, d):
    found, note = values.profile_hash(F.create_map(F.lit("p0"), F.lit("h0"), F.lit("p1"), F.lit("h1")), F.concat(F.lit("p"), (F.col("o_orderkey") % 3).cast("string")))
    return table(spark, d, "orders").select("o_orderkey", found.alias("hash"), note.alias("note"))


@query(f"""WITH {CATALOGUE}, {ledger_sql()}, {TASKS}, t AS (SELECT bundle_path, CAST(regexp_extract(bundle_path, '[0-9]+$') AS BIGINT) AS n FROM standard)
SELECT bundle_path, bundle_path || '.bundle' AS stored, CASE WHEN n % 2 = 0 THEN CASE WHEN n % 3 > 0 THEN 'ready' ELSE 'missing' END WHEN n % 3 > 0 THEN 'kept' ELSE 'placeholder' END AS state FROM t""")
def staging_states(spark, d):
    tasks = planning.plan(catalogue(spark, d), ledger(spark, d), FILTERS).select("bundle_path")
    n = F.substring_index("bundle_path", "/", -1).cast("long")
    return planning.staging(tasks, tasks.where(n % 2 == 0), tasks.where(n % 3 > 0).select(F.concat("bundle_path", F.lit(".bundle")).alias("path")))


@query(f"WITH {CATALOGUE}, {ledger_sql('ledger_3d', 'toxic')}, {STAGED} SELECT bundle_path, row_number() OVER (ORDER BY bundle_path) AS place FROM staged ORDER BY place LIMIT 50")
def first_staged(spark, d):
    """The first tasks of the second ledger, in order of path."""
    tasks = planning.plan_staged(catalogue(spark, d), ledger(spark, d, "toxic"), FILTERS, ["^src[1-3]/"], ["/fr/"])
    return planning.staged_in_order(tasks).limit(50).withColumn("place", F.row_number().over(W.orderBy("bundle_path")).cast("long")).select("bundle_path", "place")


@query("SELECT 'c/' || conv_id AS dir, conv_id || '.usm' AS name, md5(string_agg(text, '' ORDER BY turn, text)) AS digest, count(*) AS merged FROM conversations GROUP BY conv_id")
def merged_folders(spark, d):
    c = table(spark, d, "conversations").select(F.concat(F.lit("c/"), F.col("conv_id").cast("string")).alias("dir"), F.col("turn").alias("ord"), F.col("text").cast("binary").alias("data"))
    return grouping.merge_all(c).select("dir", "name", F.md5("data").alias("digest"), "merged")


@query("""SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'tex2d,audio,Other' WHEN 1 THEN 'monoBehaviour' ELSE 'monoBehaviour,textAsset,tex2d,tex2dArray,sprite,audio' END AS selectors FROM orders""")
def export_selectors(spark, d):
    some = lambda *x: F.array(*[F.lit(v) for v in x])
    types = F.when(F.col("o_orderkey") % 3 == 0, some(" Texture2D", "AudioClip", "tex2d", "Other", "audio")).when(F.col("o_orderkey") % 3 == 1, some("mono_behavior", "", "MonoBehaviour")).otherwise(some(" ", ""))
    return table(spark, d, "orders").select("o_orderkey", F.array_join(values.selectors(types), ",").alias("selectors"))


@query("SELECT format, count(*) AS n, min(path) AS first FROM (SELECT p_partkey || '.' || format AS path, format FROM part, (VALUES ('png'), ('webp'), ('jpg')) f(format)) GROUP BY format")
def format_counts(spark, d):
    """Files of images in several formats."""
    images = table(spark, d, "part").select(F.concat(F.col("p_partkey").cast("string"), F.lit(".bmp")).alias("target"))
    return files.fan_out(images, ["png", "webp", "png", "jpg"]).groupBy("format").agg(F.count("*").alias("n"), F.min("path").alias("first"))


@query(f"WITH {OBJECTS} SELECT index, coalesce(contains(replace(container, 'assets/', '/character/member_cutout/'), '/character/member_cutout'), FALSE) AS cutout FROM objects")
def member_cutouts(spark, d):
    return object_rows(spark, d).select("index", objects.is_member_cutout(F.replace("container", F.lit("assets/"), F.lit("\\character\\member_cutout/"))).alias("cutout"))


@query("SELECT o_orderkey AS id, o_custkey AS parent_job_id, o_orderpriority AS kind, 'r' AS region, o_orderstatus AS status FROM orders")
def job_listing(spark, d):
    o = table(spark, d, "orders")
    none = F.lit(None).cast("string")
    jobs = o.select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("parent_job_id"), F.col("o_orderpriority").alias("kind"), F.lit("r").alias("region"), F.col("o_orderstatus").alias("status"), F.lit(False).alias("dry_run"), none.alias("asset_version"), none.alias("asset_hash"), none.alias("message"), F.col("o_orderdate").alias("created_at"), F.col("o_orderdate").alias("updated_at"), F.lit(1).alias("progress"))
    return progress.job_list(jobs).select("id", "parent_job_id", "kind", "region", "status")


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'completed' ELSE 'running' END AS status, event_id % 3 <> 0 AS open FROM events")
def unfinished_jobs(spark, d):
    status = F.when(F.col("event_id") % 3 == 0, "completed").otherwise("running")
    return table(spark, d, "events").select("event_id", status.alias("status"), progress.can_finish(status).alias("open"))


@query("SELECT event_id, '[' || event_type || '] 200 GET /u/' || user_id || ' ' || CASE WHEN event_id % 100 < 50 THEN (event_id % 100) || 'ms' ELSE printf('%.2f', (event_id % 100) * 50 / 1000.0) || 's' END AS line FROM events")
def access_lines(spark, d):
    e = table(spark, d, "events")
    line = values.access_line("[{time}] {status} {method} {path} {latency}", F.col("event_type"), F.lit(200), F.lit("GET"), F.concat(F.lit("/u/"), F.col("user_id").cast("string")), F.when(F.col("event_id") % 100 < 50, F.col("event_id") % 100).otherwise(F.col("event_id") % 100 * 50))
    return e.select("event_id", line.alias("line"))


@query("SELECT o_orderkey, CASE o_orderkey % 4 WHEN 0 THEN 'tex2d' WHEN 1 THEN 'audio' WHEN 2 THEN 'monoBehaviour' END AS selector FROM orders")
def type_selectors(spark, d):
    given = F.element_at(F.array(*[F.lit(x) for x in ("\tTexture2D ", "AUDIOCLIP", "mono_behaviour", "other")]), (F.col("o_orderkey") % 4 + 1).cast("int"))
    return table(spark, d, "orders").select("o_orderkey", values.type_selector(given).alias("selector"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_linenumber <= 1 THEN CAST(l_partkey AS VARCHAR) ELSE l_partkey || '/' || l_linenumber END AS rate, CASE WHEN l_linenumber % 2 = 0 THEN l_linenumber * 1000 ELSE 0 END AS elapsed, CASE WHEN l_linenumber % 3 = 0 THEN l_partkey ELSE l_linenumber % 3 END AS counted FROM lineitem")
def small_numbers(spark, d):
    """Frame rates, elapsed times and counts with a field in reserve."""
    n, now = F.col("l_linenumber"), F.lit("2024-01-01 00:01:00").cast("timestamp")
    since = now + F.make_dt_interval(secs=F.when(n % 2 == 0, -n).otherwise(n))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", values.frame_rate(F.col("l_partkey"), n).alias("rate"), values.elapsed_ms(since, now).alias("elapsed"), metrics.or_else(n % 3, F.col("l_partkey")).cast("long").alias("counted"))


@query("SELECT p_partkey, CASE p_partkey % 3 WHEN 0 THEN 'from ' || p_partkey WHEN 1 THEN p_name ELSE 'path' END AS asset, '{\"a\":' || p_size || ',\"b\":' || p_partkey || '}' AS json FROM part")
def json_names(spark, d):
    key = F.col("p_partkey")
    document = F.when(key % 3 == 0, F.concat(F.lit('{"m_AssetBundleName": " ", "m_Name": "from '), key.cast("string"), F.lit('"}'))).otherwise("{}")
    as_json = values.sorted_json(F.create_map(F.lit("b"), key.cast("long"), F.lit("a"), F.col("p_size").cast("long")))
    return table(spark, d, "part").select("p_partkey", values.asset_name(document, F.when(key % 3 == 1, F.col("p_name")), F.lit("path")).alias("asset"), as_json.alias("json"))


@query("SELECT doc_id, contains(lower(text), 'the ') OR contains(lower(text), 'de la') AS again FROM documents")
def retry_messages(spark, d):
    return table(spark, d, "documents").select("doc_id", values.retry_message(F.col("text"), ["THE ", "de la"]).alias("again"))


@query("SELECT p_partkey, NOT (p_partkey % 2 = 0 AND p_partkey % 3 < 2) AS kept FROM part")
def track_filter(spark, d):
    key = F.col("p_partkey")
    source = F.when(key % 2 == 0, "a/music/long/b.acb").otherwise("a/music/short/b.acb")
    name = F.element_at(F.array(F.lit("song_VR"), F.lit("song_screen"), F.lit("song")), (key % 3 + 1).cast("int"))
    return table(spark, d, "part").select("p_partkey", objects.keep_track(source, name, F.lit("hca")).alias("kept"))


@query(f"WITH {OBJECTS} SELECT index, type = 'MonoBehaviour' AND container IS NOT NULL AS playable FROM objects")
def playable_objects(spark, d):
    playable = objects.is_playable(F.col("type"), F.lit("typetree_json"), F.upper(F.replace("container", F.lit("/"), F.lit("\\"))))
    return object_rows(spark, d).select("index", F.coalesce(playable, F.lit(False)).alias("playable"))


@query(f"""WITH {OBJECTS} SELECT index, CASE WHEN index % 10 = 0 THEN 'skip' WHEN type = 'TextAsset' AND index % 3 = 0 THEN 'audio_archive' WHEN type = 'TextAsset' AND index % 3 = 1 THEN 'video_archive' WHEN type = 'Texture2DArray' THEN 'several' WHEN type = 'Sprite' THEN 'image' ELSE 'bytes' END AS route FROM objects""")
def payload_routes(spark, d):
    o = object_rows(spark, d)
    kind = F.when(F.col("type") == "Texture2DArray", "image_array_bundle_bmp").when(F.col("type") == "Sprite", "image_png").otherwise("raw")
    target = F.element_at(F.array(F.lit("a/b.ACB"), F.lit("a/b.usm.bytes"), F.lit("a/b.txt")), (F.col("index") % 3 + 1).cast("int"))
    return o.select("index", objects.routes(kind, F.when(F.col("index") % 10 == 0, F.lit(b"")).otherwise(F.lit(b"x")), target, F.col("type")).alias("route"))


@query("""SELECT n_name, CASE WHEN n_nationkey % 2 = 0 THEN 'https://' || n_name || '.example' ELSE 'http://' || n_name END AS endpoint, 'pre/' || n_name AS prefix,
 '/w/' || n_name || '/' || CASE n_nationkey % 3 WHEN 0 THEN '1_2_3' WHEN 1 THEN 'current' ELSE 'v' END || '/AssetBundles' AS work, CASE n_nationkey % 3 WHEN 0 THEN 'own/' ELSE 'startapp/x/' END || n_name AS export FROM nation""")
def place_names(spark, d):
    """Endpoints, storage prefixes, work folders and export prefixes."""
    k, name = F.col("n_nationkey"), F.col("n_name")
    version = F.when(k % 3 == 0, "1/2:3").when(k % 3 == 1, " ").otherwise("v")
    path = F.concat(F.when(k % 3 == 0, "own/").otherwise("x/"), name)
    return table(spark, d, "nation").select(
        "n_name", paths.endpoint(F.when(k % 2 == 0, F.concat(name, F.lit(".example//"))).otherwise(F.concat(F.lit("http://"), name))).alias("endpoint"), paths.storage_prefix(F.concat(F.lit(" /pre/"), name, F.lit("/"))).alias("prefix"),
        paths.work_dir("/w", name, version).alias("work"), paths.export_prefix(path, F.lit("StartApp"), False, "own/").alias("export"),
    )


@query("SELECT page_id, page_id % 2 = 0 AS video, CAST(page_id % 256 + 256 * (page_id % 7) AS BIGINT) AS number, CASE page_id % 3 WHEN 0 THEN 'StartApp' WHEN 1 THEN 'LivePv' ELSE 'else' END AS category FROM pages")
def head_bytes(spark, d):
    """Magic numbers, little-endian integers and categories."""
    key = F.col("page_id")
    data = F.concat(F.when(key % 2 == 0, F.unhex(F.lit(codecs.VIDEO_MAGIC))).otherwise(F.lit(b"RIFF")), codecs.to_little_endian(key % 256 + 256 * (key % 7), 4))
    spelt = F.when(key % 3 == 0, "startApp").when(key % 3 == 1, "live_pv").otherwise("else")
    return table(spark, d, "pages").select("page_id", codecs.is_video(data).alias("video"), codecs.little_endian(data, 4, 4).cast("long").alias("number"), values.category(spelt).alias("category"))


@query("SELECT bucket, string_agg(path, ',' ORDER BY parts) AS listed FROM (SELECT page_id % 50 AS bucket, 'a' || CASE WHEN page_id % 2 = 0 THEN '/b' ELSE '.b' END || page_id AS path, string_split('a' || CASE WHEN page_id % 2 = 0 THEN '/b' ELSE '.b' END || page_id, '/') AS parts FROM pages) GROUP BY bucket")
def component_order(spark, d):
    """Paths in order of their components."""
    key = F.col("page_id")
    path = F.concat(F.lit("a"), F.when(key % 2 == 0, "/b").otherwise(".b"), key.cast("string"))
    rows = table(spark, d, "pages").select((key % 50).alias("bucket"), path.alias("path"))
    listed = F.sort_array(F.collect_list(F.struct(paths.components(F.col("path")).alias("parts"), "path")))
    return rows.groupBy("bucket").agg(F.array_join(F.transform(listed, lambda x: x["path"]), ",").alias("listed"))


@query("SELECT event_id, 'Planned ' || event_id || ' | x metrics: ' || event_type AS kept FROM events")
def program_output(spark, d):
    """What a program's output tells of plans and metrics."""
    text = F.concat(F.lit("start\nPlanned "), F.col("event_id").cast("string"), F.lit("\r\nx metrics: "), "event_type", F.lit("\nend"))
    return table(spark, d, "events").select("event_id", values.metric_lines(text).alias("kept"))


@query("SELECT o_orderkey, CAST(o_orderkey % 100 // 2 + o_orderkey % 7 % (o_orderkey % 100 // 2 + 1) AS BIGINT) AS wait FROM orders")
def jittered_waits(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", values.jittered_ms(key % 100, key % 7).alias("wait"))


@query("SELECT p_name AS path, p_type AS asset_type FROM part")
def export_manifest(spark, d):
    """The manifest of an export, read back."""
    place = scratch(spark, "manifest")
    none = F.lit(None).cast("string")
    rows = table(spark, d, "part").select(F.col("p_name").alias("path"), F.col("p_type").alias("asset_type"), F.lit("n").alias("name"), none.alias("container"), none.alias("payload_kind"), none.alias("suggested_extension"))
    for half in (F.length("path") % 2 == 0, F.length("path") % 2 == 1):
        sinks.append_manifest(rows.where(half), place)
    return spark.read.schema("path string, asset_type string").json(place)
