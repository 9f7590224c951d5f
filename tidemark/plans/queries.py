"""Queries over the tables that stand in for the engine's relations, and the same in DuckDB's SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codecs, paths, patterns, values
from ..operators import grouping, metrics, objects, planning
from ..streaming import progress
from .stand_ins import CATALOGUE, OBJECTS, UPDATES, catalogue, ledger, ledger_sql, table, updates
from .stand_ins import objects as object_rows

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


FILTERS = planning.Filters(start_app=["^src1/", "^src2/"], on_demand=["^src[3-6]/", "/en/"], skip=["^src4/de/"], priority=["^src2/", "/en/"])
WANTED = "NOT regexp_matches(bundle_name, '^src4/de/') AND CASE WHEN category = 'StartApp' THEN regexp_matches(bundle_name, '^src1/') OR regexp_matches(bundle_name, '^src2/') WHEN category IN ('OnDemand', 'LivePv') THEN regexp_matches(bundle_name, '^src[3-6]/') OR regexp_matches(bundle_name, '/en/') ELSE FALSE END"
PRIORITY = "CASE WHEN regexp_matches(bundle_name, '^src2/') THEN 0 WHEN regexp_matches(bundle_name, '/en/') THEN 1 END"
TASKS = f"""standard AS (SELECT bundle_name AS download_path, bundle_name AS bundle_path, hash AS bundle_hash, category, file_size, CAST({PRIORITY} AS BIGINT) AS priority, TRUE AS export_payloads, FALSE AS stage_3d
  FROM catalogue c WHERE {WANTED} AND NOT EXISTS (SELECT 1 FROM ledger l WHERE l.bundle_path = c.bundle_name AND l.hash = c.hash))"""
STAGED = """staged AS (SELECT bundle_name AS download_path, bundle_name AS bundle_path, hash AS bundle_hash, category, file_size, CAST(NULL AS BIGINT) AS priority, FALSE AS export_payloads, TRUE AS stage_3d
  FROM catalogue c WHERE regexp_matches(bundle_name, '^src[1-3]/') AND NOT regexp_matches(bundle_name, '/fr/') AND NOT EXISTS (SELECT 1 FROM ledger_3d l WHERE l.bundle_path = c.bundle_name AND l.hash = c.hash))"""
TASK = ", ".join(planning.TASK)


def _standard(spark, d):
    return planning.plan(catalogue(spark, d), ledger(spark, d), FILTERS)


def _staged(spark, d):
    return planning.plan_staged(catalogue(spark, d), ledger(spark, d, "toxic"), FILTERS, ["^src[1-3]/"], ["/fr/"])


@query(f"WITH {CATALOGUE}, {ledger_sql()}, {TASKS} SELECT {TASK} FROM standard")
def incremental_plan(spark, d):
    """New and changed bundles that the filters want, in order of priority."""
    return planning.in_order(_standard(spark, d))


@query(f"WITH {CATALOGUE}, {ledger_sql('ledger_3d', 'toxic')}, {STAGED} SELECT {TASK} FROM staged")
def plan_3d(spark, d):
    return _staged(spark, d)


@query(f"""WITH {CATALOGUE}, {ledger_sql()}, {ledger_sql('ledger_3d', 'toxic')}, {TASKS}, {STAGED}, pooled AS (SELECT *, 0 AS l FROM standard UNION ALL SELECT *, 1 FROM staged),
r AS (SELECT *, row_number() OVER (PARTITION BY bundle_path ORDER BY priority NULLS LAST, l) AS k, bool_or(export_payloads) OVER (PARTITION BY bundle_path) AS e, bool_or(stage_3d) OVER (PARTITION BY bundle_path) AS s FROM pooled)
SELECT download_path, bundle_path, bundle_hash, category, file_size, priority, e AS export_payloads, s AS stage_3d FROM r WHERE k = 1""")
def plan_union_dedup(spark, d):
    return planning.merge(_standard(spark, d), _staged(spark, d))


@query(f"""WITH {CATALOGUE} SELECT download_path || '/' || bundle_name AS download_path, bundle_name AS bundle_path, CAST(crc AS VARCHAR) AS bundle_hash, category, file_size, CAST(NULL AS BIGINT) AS priority, FALSE AS export_payloads, FALSE AS stage_3d
FROM catalogue WHERE NOT regexp_matches(bundle_name, '^src7/')""")
def prefetch_plan(spark, d):
    return planning.prefetch(catalogue(spark, d), planning.Filters(by_crc=True), [], ["^src7/"])


@query(f"""WITH {CATALOGUE}, {ledger_sql()}, {ledger_sql('ledger_3d', 'toxic')}, {TASKS} SELECT s.bundle_path, CASE WHEN EXISTS (SELECT 1 FROM ledger_3d l WHERE l.bundle_path = s.bundle_path AND l.hash = s.bundle_hash) THEN 'current' ELSE 'pending' END AS state FROM standard s""")
def pending_split(spark, d):
    """Tasks that the second ledger does not have yet, and those that it has."""
    tasks, known = _standard(spark, d), ledger(spark, d, "toxic")
    return planning.not_current(tasks, known).select("bundle_path", F.lit("pending").alias("state")).unionByName(planning.current(tasks, known).select("bundle_path", F.lit("current").alias("state")))


OUTCOMES = "outcomes AS (SELECT s.*, coalesce(l.toxic, 0) = 0 AS ok FROM standard s JOIN catalogue c ON c.bundle_name = s.bundle_path LEFT JOIN labels l USING (doc_id))"


def _outcomes(spark, d):
    doc = F.element_at(F.split("bundle_path", "/"), -1).cast("long")
    return _standard(spark, d).withColumn("doc_id", doc).join(table(spark, d, "labels"), "doc_id", "left").withColumn("ok", F.coalesce("toxic", F.lit(0)) == 0)


SUMMARY = f"WITH {CATALOGUE}, {ledger_sql()}, {TASKS}, {OUTCOMES}, s AS (SELECT (SELECT count(*) FROM catalogue) AS discovered, count(*) AS queued, count(*) FILTER (WHERE ok) AS completed, count(*) FILTER (WHERE NOT ok) AS failed, count(*) FILTER (WHERE ok AND export_payloads) AS updated FROM outcomes)"


@query(f"{SUMMARY} SELECT * FROM s")
def execution_summary(spark, d):
    return planning.summary(catalogue(spark, d), _outcomes(spark, d))


@query(f"{SUMMARY} SELECT *, queued > 0 AND completed = 0 AND failed > 0 AS total_failure FROM s")
def total_failure(spark, d):
    return execution_summary(spark, d).withColumn("total_failure", planning.is_total_failure())


@query(f"WITH {CATALOGUE}, {ledger_sql()} SELECT bundle_path, hash FROM ledger WHERE bundle_path LIKE 'src1/%'")
def chart_hashes(spark, d):
    return planning.chart_hashes(ledger(spark, d), "src1/")


@query(f"WITH {CATALOGUE}, {ledger_sql()}, {TASKS} SELECT coalesce(s.bundle_path, l.bundle_path) AS bundle_path, coalesce(s.bundle_hash, l.hash) AS hash FROM ledger l FULL JOIN standard s ON s.bundle_path = l.bundle_path")
def ledger_upsert(spark, d):
    return planning.updated_ledger(ledger(spark, d), _standard(spark, d))


@query(f"WITH {CATALOGUE}, {ledger_sql()}, {TASKS} SELECT bundle_path, 'https://cdn.example/v1/' || bundle_hash || '/' || download_path AS url FROM standard")
def task_urls(spark, d):
    return planning.with_urls(_standard(spark, d), "https://cdn.example/{version}/{hash}/{bundle_path}", version=F.lit("v1"), hash=F.col("bundle_hash")).select("bundle_path", "url")


@query("""SELECT page_id, CAST(CASE WHEN regexp_matches(url, '/en/') THEN 0 WHEN regexp_matches(url, 'ti.*net') THEN 1 WHEN regexp_matches(url, 'feed$') THEN 2 END AS BIGINT) AS priority FROM pages""")
def priority_index(spark, d):
    return table(spark, d, "pages").select("page_id", patterns.first_match(F.col("url"), ["/en/", "ti.*net", "feed$"]).alias("priority"))


PAGE_PATH = "p AS (SELECT page_id, regexp_replace(split_part(url, '?', 1), '^https?://', '') AS path FROM pages)"


def _page_paths(spark, d):
    return table(spark, d, "pages").select("page_id", F.regexp_replace(F.substring_index("url", "?", 1), "^https?://", "").alias("path"))


@query(f"WITH {PAGE_PATH} SELECT page_id, len(list_filter(string_split(path, '/'), lambda c: c IN ('', '.', '..'))) = 0 AS safe, CASE WHEN len(list_filter(string_split(path, '/'), lambda c: c NOT IN ('', '.', '..'))) = 0 THEN 'payload.bin' ELSE array_to_string(list_filter(string_split(path, '/'), lambda c: c NOT IN ('', '.', '..')), '/') END AS entry FROM p")
def safe_paths(spark, d):
    return _page_paths(spark, d).select("page_id", paths.is_safe(F.col("path")).alias("safe"), paths.safe_entry(F.col("path")).alias("entry"))


@query(f"WITH {PAGE_PATH}, l AS (SELECT *, string_split(path, '/')[-1] AS n FROM p) SELECT page_id, CASE WHEN len(list_filter(string_split(path, '/'), lambda c: c IN ('', '.', '..'))) = 0 THEN CASE WHEN regexp_matches(n, '^.+\\.[^.]*$') THEN regexp_replace(path, '\\.[^./]*$', '.bundle') ELSE path || '.bundle' END END AS stored FROM l")
def bundle_ext(spark, d):
    return _page_paths(spark, d).select("page_id", paths.bundle_file(F.col("path")).alias("stored"))


@query("SELECT page_id, regexp_replace(url, '[<>:\"/\\\\|?*]', '_', 'g') || CASE WHEN page_id % 3 = 1 THEN '(Clone)' WHEN page_id % 3 = 2 THEN '__clone2' ELSE '' END AS fixed FROM pages")
def file_name_fix(spark, d):
    cloned = F.concat("url", F.repeat(F.lit("(Clone)"), (F.col("page_id") % 3).cast("int")))
    return table(spark, d, "pages").select("page_id", paths.fix_file_name(cloned).alias("fixed"))


@query("SELECT p_partkey, lower(regexp_replace(p_type, '[_\\-\\s]', '', 'g')) AS normal FROM part")
def type_norm(spark, d):
    return table(spark, d, "part").select("p_partkey", values.normal_type(F.col("p_type")).alias("normal"))


@query("""SELECT doc_id, CASE WHEN t LIKE '%timed out%' THEN 'timeout' WHEN t LIKE '%cancelled%' THEN 'cancelled' WHEN t LIKE '%http%' OR t LIKE '%request%' OR t LIKE '%status%' THEN 'network' WHEN t LIKE '%decrypt%' OR t LIKE '%msgpack%' OR t LIKE '%aes%' THEN 'decode'
 WHEN t LIKE '%s3 upload%' OR t LIKE '%bucket%' OR t LIKE '%storage%' THEN 'storage' WHEN t LIKE '%git%' OR t LIKE '%chart hash%' THEN 'git_sync' WHEN t LIKE '%assetstudio%' OR t LIKE '%ffmpeg%' OR t LIKE '%media conversion%' OR t LIKE '%export%' THEN 'export'
 WHEN t LIKE '%config%' OR t LIKE '%missing%' OR t LIKE '%region%' THEN 'configuration' ELSE 'internal' END AS kind FROM (SELECT doc_id, lower(text) AS t FROM documents)""")
def failure_class(spark, d):
    return table(spark, d, "documents").select("doc_id", values.failure_kind(F.col("text"))[0].alias("kind"))


NO_ARRAY_IMAGES = "chosen AS (SELECT * FROM objects o WHERE NOT (type = 'Texture2DArrayImage' AND EXISTS (SELECT 1 FROM objects p WHERE p.type = 'Texture2DArray' AND p.bundle = o.bundle AND p.container = o.container)))"


@query(f"WITH {OBJECTS}, {NO_ARRAY_IMAGES} SELECT bundle, index, type FROM chosen")
def array_parent_antijoin(spark, d):
    return objects.without_array_images(object_rows(spark, d)).select("bundle", "index", "type")


@query(f"WITH {OBJECTS}, {NO_ARRAY_IMAGES} SELECT bundle, index, type FROM chosen WHERE type IN ('Texture2DArray', 'Texture2DArrayImage', 'TextAsset', 'Shader')")
def readable_objects(spark, d):
    return objects.readable(object_rows(spark, d), ["tex2d_array", "text-asset", "shader"]).where("skipped IS NULL").select("bundle", "index", "type")


@query(f"""WITH {OBJECTS} SELECT index, CASE type WHEN 'Animator' THEN 'typetree_json' WHEN 'Shader' THEN 'text' ELSE 'raw' END AS kind, CASE type WHEN 'Texture2D' THEN 'image' WHEN 'Texture2DArray' THEN 'image' WHEN 'Texture2DArrayImage' THEN 'image' WHEN 'Sprite' THEN 'image' WHEN 'TextAsset' THEN 'text_bytes' WHEN 'MonoBehaviour' THEN 'typetree_json'
 WHEN 'AudioClip' THEN 'audio' WHEN 'Mesh' THEN 'obj' WHEN 'Animator' THEN 'fbx' ELSE 'shader' END AS default_kind FROM objects""")
def read_kind(spark, d):
    kind = F.col("type")
    return object_rows(spark, d).select("index", objects.read_kind(kind, {"all": "raw", "animator": "typetree_json", "shader": " Text "}).alias("kind"), objects.read_kind(kind, {}).alias("default_kind"))


IMAGE = "type IN ('Texture2D', 'Texture2DArray', 'Texture2DArrayImage', 'Sprite')"


@query(f"""WITH {OBJECTS}, c AS (SELECT *, (row_number() OVER (PARTITION BY bundle ORDER BY index) - 1) // 8 AS chunk FROM objects), s AS (SELECT *, CASE WHEN {IMAGE} OR coalesce(lag({IMAGE}) OVER (PARTITION BY bundle, chunk ORDER BY index), TRUE) THEN 1 ELSE 0 END AS st FROM c)
SELECT bundle, index, CAST(chunk AS BIGINT) AS chunk, CAST(sum(st) OVER (PARTITION BY bundle, chunk ORDER BY index) - 1 AS BIGINT) AS part FROM s""")
def subchunks(spark, d):
    return objects.in_chunks(object_rows(spark, d), 8).select("bundle", "index", "chunk", "part")


@query(f"""WITH {OBJECTS}, a AS (SELECT bundle, count(*) AS n, count(*) FILTER (WHERE {IMAGE}) AS i, count(*) FILTER (WHERE type = 'MonoBehaviour') AS m FROM objects GROUP BY bundle)
SELECT bundle, CAST(greatest(1, least(n, CASE WHEN i * 2 >= n THEN 64 WHEN m * 2 >= n THEN 32 ELSE 48 END)) AS BIGINT) AS batch FROM a""")
def batch_size(spark, d):
    return objects.batch_size(object_rows(spark, d), 48)


@query(f"WITH {OBJECTS} SELECT bundle, CAST(sum(CASE WHEN {IMAGE} THEN greatest(size, 0) * 16 + 1048576 ELSE greatest(size, 0) * 2 + 65536 END) AS BIGINT) AS bytes FROM objects GROUP BY bundle")
def capacity_hint(spark, d):
    return object_rows(spark, d).groupBy("bundle").agg(F.sum(objects.capacity(F.col("type"), F.col("size"))).cast("long").alias("bytes"))


@query(f"""WITH {OBJECTS}, o AS (SELECT *, CASE type WHEN 'TextAsset' THEN 'bytes' WHEN 'MonoBehaviour' THEN 'json' WHEN 'Mesh' THEN 'obj' WHEN 'Animator' THEN 'fbx' WHEN 'Shader' THEN 'shader' ELSE 'dat' END AS ext,
 CASE type WHEN 'Sprite' THEN 'sprite' WHEN 'Mesh' THEN 'mesh' WHEN 'Animator' THEN 'animator' WHEN 'MonoBehaviour' THEN 'monobehaviour' WHEN 'Texture2DArray' THEN 'texture2d_array' WHEN 'Texture2DArrayImage' THEN 'texture2d_array' WHEN 'Shader' THEN 'shader' END AS folder, coalesce(name, type) AS stem FROM objects WHERE container IS NOT NULL),
 p AS (SELECT *, 'out/' || regexp_replace(container, '^assets/', '') AS base FROM o)
SELECT index, CASE WHEN folder IS NULL THEN regexp_replace(base, '\\.playable$', '') || '.' || ext ELSE regexp_replace(base, '\\.playable$', '') || '.assets/' || folder || '/' || stem || '.' || ext END AS path FROM p""")
def output_path(spark, d):
    rows = object_rows(spark, d).where("container IS NOT NULL").withColumns({"payload_kind": F.lit(None).cast("string"), "suggested_extension": F.lit(None).cast("string")})
    return rows.select("index", objects.output_path(rows, "out", F.lit("x"), "assets", True).alias("path"))


@query("""WITH r AS (SELECT source || '/' || lang || '.txt' AS path, sha256(text) AS signature, CASE WHEN doc_id % 3 > 0 THEN 'x' END AS name, min(doc_id) AS arrival, strlen(any_value(text)) AS bytes FROM documents GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY arrival) AS n FROM r) SELECT arrival, signature, CAST(bytes AS BIGINT) AS bytes, CASE WHEN n = 1 THEN path ELSE regexp_replace(path, '\\.txt$', '') || '__dup' || n || '.txt' END AS output FROM n""")
def signature_dedupe(spark, d):
    rows = table(spark, d, "documents").select(F.concat(F.concat_ws("/", "source", "lang"), F.lit(".txt")).alias("path"), F.col("text").cast("binary").alias("payload"), F.col("doc_id").alias("arrival"), *[(F.when(F.col("doc_id") % 3 > 0, "x") if c == "name" else F.lit(None).cast("string")).alias(c) for c in grouping.SIGNATURE])
    return grouping.distinct_outputs(rows).select("arrival", "signature", "bytes", "output")


@query("""WITH f AS (SELECT CAST(conv_id AS VARCHAR) AS dir, 'c' || conv_id AS base, turn + 1 AS n, text FROM conversations WHERE NOT (conv_id % 4 = 0 AND turn = 1)), g AS (SELECT dir, base, count(*) AS k, min(n) AS lo, max(n) AS hi, count(DISTINCT n) AS dn, string_agg(text, '' ORDER BY n, text) AS t FROM f GROUP BY ALL)
SELECT dir, base AS stem, md5(t) AS digest, CAST(k AS BIGINT) AS merged FROM g WHERE k > 1 AND lo = 1 AND hi = k AND dn = k
UNION ALL SELECT f.dir, f.base || '-' || printf('%03d', n), md5(text), 0 FROM f JOIN g USING (dir, base) WHERE NOT (k > 1 AND lo = 1 AND hi = k AND dn = k)""")
def segment_merge(spark, d):
    c = table(spark, d, "conversations").where("NOT (conv_id % 4 = 0 AND turn = 1)")
    files = c.select(F.col("conv_id").cast("string").alias("dir"), F.format_string("c%d-%03d", "conv_id", F.col("turn") + 1).alias("stem"), F.col("text").cast("binary").alias("data"))
    return grouping.merge_segments(files).select("dir", "stem", F.md5("data").alias("digest"), "merged")


@query(f"""WITH {OBJECTS} SELECT container, count(*) AS object_count, string_agg(coalesce(name, '-') || ':' || type, '|' ORDER BY name IS NOT NULL, name, index) AS listed FROM objects WHERE container IS NOT NULL GROUP BY container""")
def playable_groups(spark, d):
    g = grouping.grouped_documents(object_rows(spark, d))
    return g.select("container", "object_count", F.array_join(F.transform("objects", lambda x: F.concat(F.coalesce(x["name"], F.lit("-")), F.lit(":"), x["type"])), "|").alias("listed"))


@query("SELECT user_id, string_agg('m.' || event_type || '=' || v || 'ms', ', ' ORDER BY event_type) AS metrics FROM (SELECT user_id, event_type, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def metric_merge(spark, d):
    e = table(spark, d, "events").select("user_id", F.create_map("event_type", F.floor("value").cast("long")).alias("m"))
    return metrics.merged(e, "m", ["user_id"], "m").select("user_id", values.metric_text(F.col("metrics")).alias("metrics"))


@query("SELECT user_id, event_type, CAST(max(CAST(floor(value) AS BIGINT)) AS BIGINT) AS highest, max_by(CAST(floor(value) AS BIGINT), event_id) AS latest FROM events GROUP BY ALL")
def metric_max_last(spark, d):
    n = F.floor("value").cast("long")
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.max(n).alias("highest"), metrics.last_written(n, F.col("event_id")).alias("latest"))


@query("SELECT event_type AS payload_kind, count(*) AS n, CAST(sum(CAST(floor(value) AS BIGINT)) AS BIGINT) AS bytes FROM events WHERE event_id % 7 <> 0 GROUP BY ALL")
def kind_counts(spark, d):
    reads = table(spark, d, "events").select((F.col("event_id") % 7 != 0).alias("success"), F.col("event_type").alias("payload_kind"), F.floor("value").cast("long").alias("payload_len"))
    return metrics.kind_counts(reads)


@query(f"""WITH {UPDATES}, c AS (SELECT job_id, min((moment, seq)) AS cut FROM updates WHERE update_type = 'Cancelled' GROUP BY job_id), k AS (SELECT u.* FROM updates u LEFT JOIN c USING (job_id) WHERE cut IS NULL OR (moment, seq) <= cut)
SELECT job_id, coalesce(max_by(n, (moment, seq)) FILTER (WHERE update_type = 'DownloadsPlanned'), 0) AS total, count(*) FILTER (WHERE update_type = 'BundleCompleted') AS completed, count(*) FILTER (WHERE update_type = 'BundleFailed') AS failed,
 max_by(CASE update_type WHEN 'DownloadsPlanned' THEN 'planning_downloads' WHEN 'RecordSaved' THEN 'persisting_state' ELSE 'downloading_bundles' END, (moment, seq)) FILTER (WHERE update_type NOT IN ('Cancelled', 'Completed', 'Failed')) AS phase, CAST(epoch_us(max(moment)) AS BIGINT) AS updated_us, bool_or(update_type = 'Cancelled') AS cancelled,
 CASE WHEN bool_or(update_type = 'Cancelled') THEN 'cancelled' ELSE coalesce(min_by(lower(update_type), (moment, seq)) FILTER (WHERE update_type IN ('Completed', 'Failed')), 'running') END AS status FROM k GROUP BY job_id""")
def progress_fold(spark, d):
    return progress.fold(updates(spark, d)).withColumn("updated_us", F.unix_micros(F.col("updated_at").cast("timestamp"))).drop("updated_at")


@query(f"""WITH {UPDATES}, e AS (SELECT job_id, seq, CASE update_type WHEN 'DownloadsPlanned' THEN 'planned ' || n || ' bundle download(s)' WHEN 'BundleFailed' THEN 'failed bundle `' || bundle || '`: error' WHEN 'RecordSaved' THEN 'saved downloaded asset record with ' || n || ' entries' ELSE 'completed bundle `' || bundle || '`' END AS text,
 row_number() OVER (PARTITION BY job_id ORDER BY moment DESC, seq DESC) AS place FROM updates WHERE update_type NOT IN ('Cancelled', 'Completed', 'Failed')) SELECT job_id, place, text FROM e WHERE place <= 20""")
def recent_events(spark, d):
    return progress.recent(updates(spark, d)).select("job_id", F.col("place").cast("long").alias("place"), "text")


@query("""WITH j AS (SELECT o_orderkey AS job_id, o_orderstatus AS status, o_orderdate AS updated_at FROM orders) SELECT job_id, status FROM j WHERE status <> 'F'
UNION ALL SELECT job_id, status FROM (SELECT * FROM j WHERE status = 'F' ORDER BY updated_at DESC, job_id LIMIT 100)""")
def retain_jobs(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"), F.col("o_orderdate").alias("updated_at"))
    return grouping.retain(jobs, 100, F.col("status") == "F").select("job_id", "status")


@query("SELECT o_custkey AS bucket, coalesce(string_agg(CASE WHEN o_orderstatus IN ('O', 'P') THEN o_orderkey END, ',' ORDER BY o_orderkey), '') AS open, coalesce(string_agg(CASE WHEN o_orderstatus = 'F' THEN o_orderkey END, ',' ORDER BY o_orderkey), '') AS done FROM orders GROUP BY o_custkey")
def status_lists(spark, d):
    jobs = table(spark, d, "orders").select(F.col("o_custkey").alias("bucket"), F.col("o_orderkey").alias("job_id"), F.col("o_orderstatus").alias("status"))
    lists = grouping.status_lists(jobs, {"open": ["O", "P"], "done": ["F"]})
    return lists.select("bucket", *[F.array_join(F.transform(c, lambda x: x.cast("string")), ",").alias(c) for c in ("open", "done")])


@query("""SELECT t.target, t.prefix || '/' || f.path AS key, 'application/octet-stream' AS content_type, CASE WHEN regexp_matches(f.path, '^A') THEN 'public-read' ELSE 'private' END AS acl FROM (SELECT n_name AS path FROM nation) f, (VALUES ('one', 'a'), ('two', 'b/c')) t(target, prefix)""")
def upload_cross(spark, d):
    from ..sources.sinks import uploads

    return uploads(table(spark, d, "nation").select(F.col("n_name").alias("path")), [("one", "a"), ("two", "b/c")], ["^A", " "]).drop("path")


@query("SELECT page_id, upper(sha256(CASE WHEN page_id % 2 = 0 THEN html ELSE html END)) AS digest FROM pages")
def deobfuscated_digest(spark, d):
    """Pages behind a plain head or as they are come out the same."""
    raw = F.col("html").cast("binary")
    shown = F.when(F.col("page_id") % 2 == 0, F.concat(F.unhex(F.lit(codecs.PLAIN_HEAD)), raw)).otherwise(raw)
    return table(spark, d, "pages").select("page_id", F.upper(codecs.sha256_hex(codecs.deobfuscate(shown))).alias("digest"))


@query("SELECT page_id, replace(replace(url_encode(url), '+', '%20'), '*', '%2A') AS encoded FROM pages")
def percent_encoded(spark, d):
    return table(spark, d, "pages").select("page_id", paths.percent_encode(F.col("url")).alias("encoded"))


@query(f"""WITH {OBJECTS}, c AS (SELECT *, (row_number() OVER (PARTITION BY bundle ORDER BY index) - 1) // 8 AS chunk FROM objects)
SELECT bundle, CAST(chunk AS BIGINT) AS chunk, count(*) AS n, min(index) AS first_index, max(index) AS last_index FROM c GROUP BY ALL""")
def read_batches(spark, d):
    """A bundle's objects in batches of fixed size, in order of index."""
    return objects.in_chunks(object_rows(spark, d), 8).groupBy("bundle", "chunk").agg(F.count("*").alias("n"), F.min("index").alias("first_index"), F.max("index").alias("last_index"))


@query(f"""WITH {OBJECTS} SELECT bundle, count(*) AS planned, count(*) FILTER (WHERE index % 7 <> 0) AS successful, count(*) FILTER (WHERE index % 7 = 0 AND index % 14 <> 0) AS failed, count(*) FILTER (WHERE index % 14 = 0) AS skipped,
 count(DISTINCT index // 8) AS batches, CAST(coalesce(sum(size) FILTER (WHERE index % 7 <> 0), 0) AS BIGINT) AS bytes, CAST(sum(index % 5) AS BIGINT) AS duration_ms FROM objects GROUP BY bundle""")
def plan_statistics(spark, d):
    reads = object_rows(spark, d).select("bundle", F.expr("index div 8").alias("batch"), (F.col("index") % 7 != 0).alias("success"), F.when(F.col("index") % 14 == 0, "no reader").alias("skipped"), F.col("size").alias("payload_len"), (F.col("index") % 5).alias("duration_ms"))
    return metrics.plan_statistics(reads)


@query(f"""WITH {OBJECTS}, s AS (SELECT bundle, count(DISTINCT container) AS n, count(DISTINCT regexp_replace(container, '/[^/]*$', '')) AS folders FROM objects GROUP BY bundle)
SELECT bundle, CASE WHEN n = 0 THEN 'none' WHEN n = 1 THEN 'one' WHEN folders = 1 THEN 'folder' ELSE 'many' END AS route FROM s""")
def container_routes(spark, d):
    found = object_rows(spark, d).groupBy("bundle").agg(F.collect_set("container").alias("containers"))  # distinct before the shuffle
    return found.select("bundle", grouping.container_route(F.col("containers")).alias("route"))


@query("""SELECT p_partkey AS path_id, coalesce(max_by(l_returnflag, (l_orderkey, l_linenumber, l_returnflag)), '') AS data FROM part LEFT JOIN lineitem ON l_partkey = p_partkey GROUP BY p_partkey""")
def payload_lookup(spark, d):
    """Reads with the last entry of their name in a container."""
    items = table(spark, d, "lineitem").select(F.col("l_partkey").cast("string").alias("name"), F.col("l_returnflag").cast("binary").alias("data"), F.struct("l_orderkey", "l_linenumber", "l_returnflag").alias("ord"))
    return objects.payloads(table(spark, d, "part").select(F.col("p_partkey").alias("path_id")), items).select("path_id", F.col("data").cast("string").alias("data"))


@query(f"WITH {PAGE_PATH} SELECT page_id, path || CASE WHEN page_id % 3 = 1 THEN '/music_score/x.txt' ELSE '' END AS published FROM p")
def text_asset_names(spark, d):
    ending = F.when(F.col("page_id") % 3 == 0, ".bytes").when(F.col("page_id") % 3 == 1, "/music_score/x.BYTES").otherwise("")
    return _page_paths(spark, d).select("page_id", paths.text_asset_file(F.concat("path", ending)).alias("published"))


@query("SELECT conv_id, turn, CASE WHEN turn >= 1 THEN 'c' || conv_id END AS base, CASE WHEN turn >= 1 THEN turn END AS number FROM conversations")
def segment_keys(spark, d):
    base, number = paths.segment_key(F.format_string("c%d-%03d", "conv_id", "turn"))
    return table(spark, d, "conversations").select("conv_id", "turn", base.alias("base"), number.alias("number"))


@query("""SELECT o_orderkey, o_orderkey % 200 + 400 >= 500 OR o_orderkey % 200 + 400 IN (429, 408) AS again, CAST(least(100.0 * pow(2, o_orderkey % 10), 5000) AS BIGINT) AS wait_ms FROM orders""")
def retry_policy(spark, d):
    key = F.col("o_orderkey")
    return table(spark, d, "orders").select("o_orderkey", values.retry_status(key % 200 + 400).alias("again"), values.backoff_ms(key % 10 + 1, 100, 5000).alias("wait_ms"))


@query("SELECT event_id, strftime(ts + INTERVAL 9 HOUR, '%Y%m%d%H%M%S') AS stamp FROM events")
def tokyo_stamps(spark, d):
    return table(spark, d, "events").select("event_id", values.tokyo_stamp(F.col("ts")).alias("stamp"))


from . import detail_queries, source_queries  # noqa: E402, F401  (add their queries to QUERIES)
