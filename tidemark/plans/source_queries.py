"""Queries over files: what is written in a format of the engine and read back by ranges, pages or runs."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import functions as F

from ..functions import patterns
from ..operators import grouping, objects, planning
from ..sources import catalog, composed, container_index, containers, files, ranges
from ..sources.ledger_log import LedgerLog
from ..sources.object_pages import read_object_pages, write_object_pages
from ..sources.scratch import scratch
from .queries import FILTERS, TASK, TASKS, query
from .stand_ins import CATALOGUE, OBJECTS, catalogue, ledger, ledger_sql, table
from .stand_ins import objects as object_rows


def run(df) -> None:
    """Evaluate what writes files."""
    df.write.format("noop").mode("overwrite").save()


@query(f"WITH {OBJECTS} SELECT bundle, index, name, container, type, size FROM objects WHERE type IN ('Sprite', 'Mesh') AND index >= 100 AND name IS NOT NULL")
def object_pages_scan(spark, d):
    """Objects written in pages; filters of type and index reach the source, which reads the pages that they leave."""
    place = scratch(spark, "pages")
    run(write_object_pages(object_rows(spark, d).repartitionByRange("type", "index").sortWithinPartitions("type", "index"), place, 50))
    wanted = read_object_pages(spark, place, 1 << 14).where("type IN ('Sprite', 'Mesh') AND index >= 100 AND name IS NOT NULL")
    return wanted.select("bundle", "index", "name", "container", "type", "size")


@query(f"WITH {OBJECTS} SELECT type, count(*) AS n, min(index) AS first, count(name) AS named FROM objects GROUP BY type")
def object_pages_counts(spark, d):
    place = scratch(spark, "pages")
    run(write_object_pages(object_rows(spark, d), place, 64))
    return read_object_pages(spark, place).groupBy("type").agg(F.count("*").alias("n"), F.min("index").alias("first"), F.count("name").alias("named"))


@query(f"WITH {CATALOGUE} SELECT bundle_name, hash, crc, file_size, category FROM catalogue")
def catalogue_decode(spark, d):
    """A catalogue file for each source, read by ranges, cut at entries and decoded by many tasks."""
    place = scratch(spark, "catalogues")
    run(catalog.write_catalogues(catalogue(spark, d).withColumn("file", F.concat(F.substring_index("bundle_name", "/", 1), F.lit(".bin"))), place))
    return catalog.read_catalogues(spark, place, size=1 << 13, piece=1 << 12).select("bundle_name", "hash", "crc", "file_size", "category")


def _layouts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Each batch as a map whose keys repeat: old values first, then the right ones."""
    for k, b in enumerate(batches):
        rows = list(zip(*(c.to_pylist() for c in b.columns)))
        layout = ({"indent": 2}, {"separators": (",", ":")}, {"indent": 1, "separators": (" ,\n", "\t:\n\n ")})[k % 3]
        maps = [json.dumps({p: "old \"{,\\" + p for p, _ in rows}, **layout), json.dumps(dict(rows), ensure_ascii=k % 2 > 0, **layout)]
        yield pa.RecordBatch.from_pydict({"value": [" \n".join(maps)]})


@query(f"WITH {CATALOGUE}, {ledger_sql()} SELECT bundle_path, hash FROM ledger")
def ledger_layouts(spark, d):
    """A ledger as JSON maps of several layouts with repeated keys, read by small ranges."""
    place = scratch(spark, "ledger")
    ledger(spark, d).select("bundle_path", "hash").mapInArrow(_layouts, "value string").write.text(place)
    return catalog.read_ledger(spark, place, 1 << 12)


@query("SELECT conv_id, turn AS ord, role AS name, text FROM conversations")
def container_entries(spark, d):
    """Turns in a container file for each conversation, found by the containers' heads and read by ranges."""
    c = table(spark, d, "conversations").select("conv_id", F.col("turn").alias("ord"), F.col("role").alias("name"), F.col("text").cast("binary").alias("data"))
    place = scratch(spark, "containers")
    run(files.write_files(containers.containers_of(c, "conv_id").select(F.concat(F.col("conv_id").cast("string"), F.lit(".bin")).alias("path"), F.col("content").alias("data")), place))
    found = container_index.read_entries(container_index.index_containers(ranges.file_list(spark, place)))
    return found.select(F.regexp_extract("file", r"([0-9]+)\.bin$", 1).cast("long").alias("conv_id"), "ord", "name", F.col("data").cast("string").alias("text"))


@query("""WITH r AS (SELECT source || '/' || lang || CASE WHEN doc_id % 2 = 0 THEN '.acb' ELSE '.txt' END AS path, sha256(text) AS sha256, CASE WHEN doc_id % 3 > 0 THEN 'x' END AS name, min(doc_id) AS arrival FROM documents WHERE text <> '' GROUP BY ALL),
n AS (SELECT *, row_number() OVER (PARTITION BY path ORDER BY arrival) AS n FROM r) SELECT CASE WHEN n = 1 THEN path ELSE regexp_replace(path, '(\\.[a-z]+)$', '__dup' || n || '\\1') END AS path, sha256, name FROM n""")
def payload_export(spark, d):
    """Text assets claimed, written, archives among them, and told of in a manifest."""
    reads = table(spark, d, "documents").select(
        F.concat(F.concat_ws("/", "source", "lang"), F.when(F.col("doc_id") % 2 == 0, ".acb").otherwise(".txt")).alias("target"), F.col("text").cast("binary").alias("payload"), F.col("doc_id").alias("arrival"), F.lit("TextAsset").alias("type"),
        F.when(F.col("doc_id") % 3 > 0, "x").alias("name"), *[F.lit(None).cast("string").alias(c) for c in ("container", "payload_kind", "suggested_extension")],
    )
    claimed = files.claimed_reads(reads)
    written = files.write_files(files.payload_files(claimed), scratch(spark, "export"))
    return written.join(files.manifest_rows(claimed.drop("payload"), written.select("path")), "path").select("path", "sha256", "name")


@query(f"""WITH {CATALOGUE}, {ledger_sql()}, {TASKS}, t AS (SELECT bundle_path, CAST(regexp_extract(bundle_path, '[0-9]+$') AS BIGINT) AS n FROM standard)
SELECT bundle_path || '.bundle' AS path, CAST(0 AS BIGINT) AS bytes FROM t WHERE n % 2 <> 0 AND n % 3 = 0 UNION ALL SELECT '.sparse-input', 0 FROM t GROUP BY ALL HAVING count(*) FILTER (WHERE n % 2 <> 0) > 0""")
def staging_placeholders(spark, d):
    """Placeholders and the marker of a staging folder where some tasks are not pending."""
    tasks = planning.plan(catalogue(spark, d), ledger(spark, d), FILTERS).select("bundle_path")
    n = F.substring_index("bundle_path", "/", -1).cast("long")
    there = tasks.where((n % 2 == 0) | (n % 3 > 0)).select(F.concat("bundle_path", F.lit(".bundle")).alias("path"))
    return files.write_files(files.staging_files(planning.staging(tasks, tasks.where(n % 2 == 0), there)), scratch(spark, "staging")).select("path", "bytes")


@query(f"WITH {CATALOGUE}, {ledger_sql()}, {TASKS} SELECT {TASK} FROM standard")
def plan_by_log(spark, d):
    """The incremental plan against a ledger in runs, older ones with stale hashes, of which only files that may hold a path are opened."""
    log = LedgerLog(spark, scratch(spark, "log"))
    rows = ledger(spark, d)
    bucket = F.xxhash64("bundle_path") % 3
    for k in range(3):
        log.append(rows.where(bucket >= k - 3).withColumn("hash", F.lit(f"old{k}")), k)
    log.append(rows, 3)
    chosen = catalogue(spark, d)
    return planning.plan(chosen, log.known(chosen.select(F.col("bundle_name").alias("bundle_path"))), FILTERS)


@query(f"""WITH {OBJECTS}, o AS (SELECT bundle, index, lower(container) AS container, lower(type) AS type FROM objects)
SELECT bundle, index FROM o WHERE NOT (type = 'texture2darrayimage' AND container IS NOT NULL AND EXISTS (SELECT 1 FROM o p WHERE p.type = 'texture2darray' AND p.bundle = o.bundle AND p.container = o.container))""")
def array_parent_spellings(spark, d):
    """Images of arrays whose types are spelt in any way."""
    o = object_rows(spark, d)
    spelt = F.when(F.col("index") % 3 == 0, F.replace("type", F.lit("2D"), F.lit("2d_"))).when(F.col("index") % 3 == 1, F.upper("type")).otherwise(F.concat(F.lit(" "), "type"))
    return objects.without_array_images(o.withColumn("type", spelt)).select("bundle", "index")


@query("SELECT trim(n_name) AS selector, n_nationkey AS id FROM nation")
def provider_repeats(spark, d):
    """Selections that repeat, with and without white space around them."""
    n = table(spark, d, "nation")
    known = n.select(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("name"), F.lower("n_name").alias("scheme"), F.col("n_nationkey").alias("id"))
    asked = n.select(F.explode(F.array(F.col("n_name"), F.concat(F.lit(" "), "n_name"), F.col("n_name"))).alias("selector"))
    return planning.providers(known, asked).select("selector", "id")


@query(f"WITH {OBJECTS} SELECT index, CASE WHEN index % 4 = 0 THEN 'type has no reader yet' ELSE 'type has no read strategy' END AS reason FROM objects")
def unread_types(spark, d):
    kind = F.when(F.col("index") % 4 == 0, "Material").otherwise(F.col("type"))
    return object_rows(spark, d).select("index", objects.unread_reason(kind).alias("reason"))


@query("""WITH f AS (SELECT CAST(conv_id AS VARCHAR) AS dir, 'c' || conv_id AS base, turn + 1 AS n, text FROM conversations WHERE NOT (conv_id % 4 = 0 AND turn = 1)), g AS (SELECT dir, base, count(*) AS k, min(n) AS lo, max(n) AS hi, count(DISTINCT n) AS dn, string_agg(text, '' ORDER BY n, text) AS t FROM f GROUP BY ALL)
SELECT dir || '/' || base AS path, strlen(t) AS bytes, sha256(t) AS sha256 FROM g WHERE k > 1 AND lo = 1 AND hi = k AND dn = k
UNION ALL SELECT f.dir || '/' || f.base || '-' || printf('%03d', n), strlen(text), sha256(text) FROM f JOIN g USING (dir, base) WHERE NOT (k > 1 AND lo = 1 AND hi = k AND dn = k)""")
def composed_segments(spark, d):
    """Segments written as one file each as they stream by."""
    c = table(spark, d, "conversations").where("NOT (conv_id % 4 = 0 AND turn = 1)")
    parts = composed.segment_parts(c.select(F.col("conv_id").cast("string").alias("dir"), F.format_string("c%d-%03d", "conv_id", F.col("turn") + 1).alias("stem"), F.col("text").cast("binary").alias("data")))
    return composed.write_composed(parts, scratch(spark, "segments"))


@query("SELECT lang || '.usm' AS name, strlen(t) AS bytes, sha256(t) AS sha256 FROM (SELECT lang, string_agg(text, '' ORDER BY doc_id, text) AS t FROM documents GROUP BY lang)")
def composed_folders(spark, d):
    """All documents of a language as one file."""
    docs = table(spark, d, "documents").select("lang", F.col("doc_id").alias("ord"), F.col("text").cast("binary").alias("data")).withColumnRenamed("lang", "dir")
    written = composed.write_composed(composed.folder_parts(docs), scratch(spark, "folders"))
    return written.select(F.substring_index("path", "/", -1).alias("name"), "bytes", "sha256")


@query("SELECT source, doc_id AS id, coalesce(text, '') AS text, form FROM documents, (VALUES ('interleaved'), ('grouped')) f(form)")
def composed_containers(spark, d):
    """All documents of a source in one container, in both forms, written in a stream and taken apart by ranges."""
    docs = table(spark, d, "documents").select(F.concat("source", F.lit(".bin")).alias("path"), F.col("doc_id").alias("ord"), F.concat_ws("/", "source", F.col("doc_id").cast("string")).alias("name"), F.col("text").cast("binary").alias("data"))
    out = []
    for form, magic in (("interleaved", b""), ("grouped", b"GROUPED1")):
        place = scratch(spark, form)
        run(composed.write_composed(composed.container_parts(docs, magic), place))
        found = container_index.read_entries(container_index.index_containers(ranges.file_list(spark, place), magic))
        out.append(found.select(F.substring_index("name", "/", 1).alias("source"), F.substring_index("name", "/", -1).cast("long").alias("id"), F.col("data").cast("string").alias("text"), F.lit(form).alias("form")))
    return out[0].unionByName(out[1])


@query(f"WITH {OBJECTS} SELECT container, count(*) AS object_count, string_agg(coalesce(name, '-') || ':' || type, '|' ORDER BY name IS NOT NULL, name, index) AS listed FROM objects WHERE container IS NOT NULL GROUP BY container")
def composed_documents(spark, d):
    """Documents of containers written in a stream and read back."""
    place = scratch(spark, "documents")
    run(composed.write_composed(composed.document_parts(object_rows(spark, d)), place))
    back = spark.read.schema("container string, object_count long, objects array<struct<name:string,type:string>>").option("multiLine", True).option("recursiveFileLookup", True).json(place)
    return back.select("container", "object_count", F.array_join(F.transform("objects", lambda x: F.concat(F.coalesce(x["name"], F.lit("-")), F.lit(":"), x["type"])), "|").alias("listed"))


@query("""WITH RECURSIVE p AS (SELECT o_orderkey AS pid, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey ELSE o_orderkey // 2 END AS ppid, o_custkey AS cpu FROM orders), t AS (SELECT pid FROM p WHERE pid = 2 UNION SELECT p.pid FROM p JOIN t ON p.ppid = t.pid)
SELECT CAST(sum(cpu) AS BIGINT) AS cpu FROM p WHERE pid IN (SELECT pid FROM t)""")
def process_tree(spark, d):
    """Orders as processes, a part of them their own parents."""
    key = F.col("o_orderkey")
    rows = table(spark, d, "orders").select(key.alias("pid"), F.when(key % 7 == 0, key).otherwise(F.expr("o_orderkey div 2")).alias("ppid"), F.col("o_custkey").alias("cpu"))
    return grouping.process_tree_sum(spark, rows, 2)


@query(f"""WITH {CATALOGUE}, p AS (SELECT bundle_name AS name, CASE WHEN doc_id % 2 = 0 THEN bundle_name ELSE regexp_replace(bundle_name, '/[^/]*$', '') END AS path FROM catalogue)
SELECT name, path LIKE 'src1/%' OR path LIKE 'src2/en/%' AS scanned, contains(path, '/7') OR contains(path, '/71') OR contains(path, 'de/3') OR contains(path, 'de/4') OR contains(path, '.x') OR contains(path, '/e') AS sought FROM p""")
def literal_patterns(spark, d):
    """Patterns that are literals: starts, and many sought at once."""
    c = catalogue(spark, d)
    path = F.when(F.col("doc_id") % 2 == 0, F.col("bundle_name")).otherwise(F.regexp_replace("bundle_name", "/[^/]*$", ""))
    return c.select(F.col("bundle_name").alias("name"), patterns.any_match(path, ["^src1/", "^src2/en/", "^src1/de/"]).alias("scanned"), patterns.any_match(path, ["/7", "/71", "de/3", "de/4", r"\.x", "/e"]).alias("sought"))
