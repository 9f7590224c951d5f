"""Objects of bundles: which to read, how, in what batches, and where results go.

Object rows: index, name, container, type, path_id, unique_id, size, and a bundle column that groups them.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import bound, extension, file_name, fix_file_name, semantic_stem, slashes, strip_prefix, without_extension
from ..functions.values import IMAGES, READ_KIND, UNREADABLE, lookup, normal_type, type_matches
from .numbering import numbered

# Folders of objects that share a container's file, and extensions by payload kind and by type.
FOLDERS = {"sprite": "sprite", "mesh": "mesh", "animator": "animator", "monobehaviour": "monobehaviour", "monobehavior": "monobehaviour", "texture2darray": "texture2d_array", "texture2darrayimage": "texture2d_array", "monoscript": "monoscript", "gameobject": "gameobject", "material": "material", "transform": "transform", "recttransform": "recttransform", "particlesystem": "particle_system", "particlesystemrenderer": "particle_system_renderer", "spriterenderer": "sprite_renderer", "spritemask": "sprite_mask", "meshfilter": "mesh_filter", "meshrenderer": "mesh_renderer", "skinnedmeshrenderer": "skinned_mesh_renderer", "playabledirector": "playable_director", "canvas": "canvas", "canvasrenderer": "canvas_renderer", "camera": "camera", "avatar": "avatar", "audiolistener": "audio_listener", "animation": "animation", "animationclip": "animation_clip", "textmesh": "text_mesh", "sortinggroup": "sorting_group", "cubemap": "cubemap", "texture3d": "texture3d", "shader": "shader", "shadervariantcollection": "shader"}
BY_KIND = {"raw": "dat", "typetree_json": "json", "image_bmp": "bmp", "image_raw_rgba": "png", "image_png": "png", "image_tga": "tga", "image_jpeg": "jpg", "image_webp": "webp", "movie_ogv": "ogv", "shader_text": "shader", "mesh_obj": "obj"}
BUNDLED = ["image_array_bundle_bmp", "image_array_bundle_png", "image_array_bundle_tga", "image_array_bundle_jpeg", "image_array_bundle_webp", "image_array_bundle_raw_rgba", "animator_bundle_fbx"]
KIND_DEFAULT = {"text_bytes": "bytes", "audio_raw": "wav", "video_raw": "bin", "font": "ttf"}
KNOWN = {"bytes": "bytes", "dat": "dat", "json": "json", "lua": "lua", "txt": "txt", "bmp": "bmp", "png": "png", "tga": "tga", "jpg": "jpg", "jpeg": "jpg", "webp": "webp", "wav": "wav", "mp3": "mp3", "flac": "flac", "ogg": "ogv", "ogv": "ogv", "ttf": "ttf", "otf": "otf", "shader": "shader", "obj": "obj", "fbx": "fbx", "bin": "bin"}
TYPE_DEFAULT = {"textasset": "bytes", "monobehaviour": "json", "monobehavior": "json", "shader": "shader", "shadervariantcollection": "shader", "mesh": "obj", "animator": "fbx"}


def enabled(kind: Column, selectors: list[str]) -> Column:
    out = F.lit(False)
    for s in selectors:
        out = out | type_matches(s, kind)
    return out


def is_image(kind: Column) -> Column:
    """Whatever the type's spelling."""
    return normal_type(kind).isin([t.lower() for t in IMAGES])


def is_playable(kind: Column, read_kind: Column, container: Column) -> Column:
    return (kind == "MonoBehaviour") & (read_kind == "typetree_json") & F.endswith(F.lower(slashes(container)), F.lit(".playable"))


def array_parents(objects: DataFrame) -> DataFrame:
    """Containers, by bundle, that hold a texture array, whatever the type's spelling."""
    return objects.where((normal_type(F.col("type")) == "texture2darray") & (F.trim("container") != "")).select("bundle", F.lower(slashes(F.col("container"))).alias("_parent")).distinct()


def _covered(objects: DataFrame) -> tuple[DataFrame, Column]:
    """The parents, and whether an object is an image that its own array covers; those without a container never are."""
    parents = array_parents(objects).withColumnRenamed("bundle", "_bundle")
    own = F.when((normal_type(F.col("type")) == "texture2darrayimage") & (F.trim("container") != ""), F.lower(slashes(F.col("container"))))
    return parents, (objects["bundle"] == parents["_bundle"]) & (own == parents["_parent"])


def without_array_images(objects: DataFrame) -> DataFrame:
    """Images of a texture array go if the array itself is there."""
    parents, covered = _covered(objects)
    return objects.join(parents, covered, "left_anti")


def readable(objects: DataFrame, selectors: list[str]) -> DataFrame:
    """Objects of the chosen types, with a reason where they are skipped: an image is covered by its array, whatever selectors the array
    has, or a type is blank. An object without a type is not chosen by any selector."""
    parents, covered = _covered(objects)
    marked = objects.join(parents, covered, "left")
    chosen = marked.where(F.col("type").isNotNull() & enabled(F.col("type"), selectors))
    reason = F.when(F.col("_parent").isNotNull(), "covered by its texture array").when(F.trim("type") == "", "type has no read strategy")
    return chosen.withColumn("skipped", reason).drop("_bundle", "_parent")


def unread_reason(kind: Column) -> Column:
    """Why a type that could not be read was not: it is known to have no reader, or has no strategy."""
    return F.when(kind.isin(UNREADABLE), "type has no reader yet").otherwise("type has no read strategy")


def is_member_cutout(container: Column) -> Column:
    return F.coalesce(F.contains(slashes(container), F.lit("/character/member_cutout")), F.lit(False))


def isolation_key() -> Column:
    """Order of reading: images, which may bring a reader down, after all others, then by index."""
    return F.struct(F.coalesce(is_image(F.col("type")), F.lit(False)), "index")


def paired(batches: DataFrame) -> DataFrame:
    """place, asset, output for batches (assets and outputs, arrays in the same order; failed), with their other columns. A failed batch
    gives none; one whose arrays differ in length fails the query."""
    same = F.assert_true(F.col("failed") | (F.size("assets") == F.size("outputs")), F.lit("a batch has as many outputs as objects"))
    pairs = F.arrays_zip(F.col("assets").alias("asset"), F.col("outputs").alias("output"))
    rest = [c for c in batches.columns if c not in ("assets", "outputs", "failed")]
    return batches.where(same.isNull() & ~F.col("failed")).select(*rest, F.posexplode(pairs).alias("place", "pair")).select(*rest, "place", F.col("pair.asset").alias("asset"), F.col("pair.output").alias("output"))


def read_kind(kind: Column, configured: dict[str, str]) -> Column:
    """How an object is read: the first selector in order of name that means its type, then 'all', then the type's default."""
    clean = lambda k: F.lit(k.strip().lower())
    out = F.coalesce(lookup(normal_type(kind), READ_KIND), F.lit("typetree_json"))
    names = sorted(configured)
    for s in [s for s in names if s.strip().lower() == "all"][:1]:
        out = clean(configured[s])
    for s in reversed([s for s in names if s.strip().lower() != "all"]):
        out = F.when(type_matches(s, kind), clean(configured[s])).otherwise(out)
    return out


def in_chunks(objects: DataFrame, size: int) -> DataFrame:
    """chunk: a bundle's objects in runs of size, in order of index; part: within a chunk each image by itself and runs of others together. No
    task holds a bundle: only a chunk's objects meet in a window."""
    rows = numbered(objects, ["bundle"], ["index"], "_n").withColumn("chunk", F.floor((F.col("_n") - 1) / size)).drop("_n")
    within = W.partitionBy("bundle", "chunk").orderBy("index")
    image = is_image(F.col("type"))
    starts = image | F.coalesce(F.lag(image).over(within), F.lit(True))
    return rows.withColumn("_starts", starts.cast("int")).withColumn("part", F.sum("_starts").over(within) - 1).drop("_starts")


def batch_size(objects: DataFrame, configured: int) -> DataFrame:
    """bundle, batch: larger than configured for mostly images, smaller for mostly type trees, at most the number of objects."""
    a = objects.groupBy("bundle").agg(F.count("*").alias("n"), F.count_if(is_image(F.col("type"))).alias("images"), F.count_if(F.lower("type").isin("monobehaviour", "monobehavior")).alias("trees"))
    size = F.when(F.col("images") * 2 >= F.col("n"), F.greatest(F.lit(configured), F.lit(64))).when(F.col("trees") * 2 >= F.col("n"), F.least(F.lit(configured), F.lit(32))).otherwise(configured)
    return a.select("bundle", F.greatest(F.lit(1), F.least(size, F.col("n"))).cast("long").alias("batch"))


def capacity(kind: Column, size: Column) -> Column:
    """Bytes to keep ready for an object."""
    known = F.greatest(size.cast("decimal(38,0)"), F.lit(0))
    return F.when(is_image(kind), known * 16 + (1 << 20)).otherwise(known * 2 + (64 << 10))


def output_extension(kind: Column, payload_kind: Column, suggested: Column) -> Column:
    """By the payload's kind, else as suggested if known, else by type; empty for payloads of several files."""
    p = F.lower(F.trim(F.coalesce(payload_kind, F.lit(""))))
    known = lookup(F.lower(F.regexp_replace(F.trim(suggested), r"^\.+", "")), KNOWN)
    by_type = F.coalesce(lookup(normal_type(kind), TYPE_DEFAULT), F.lit("dat"))
    return F.when(p.isin(BUNDLED), "").otherwise(F.coalesce(lookup(p, BY_KIND), known, lookup(p, KIND_DEFAULT), by_type))


def output_path(objects: DataFrame, root: str, export_path: Column, prefix: str, by_category: bool) -> Column:
    """Where an object's payload goes: by container, or flat under export_path; objects that share a container's file get a folder of it."""
    name, kind = F.col("name"), F.coalesce("type", F.lit(""))
    given = F.when(F.trim("container") != "", F.col("container"))
    relative = strip_prefix(F.coalesce(given, name, F.lit("asset")), prefix)
    plain = F.concat_ws("/", F.lit(root), relative) if by_category else F.concat_ws("/", F.lit(root), export_path, file_name(relative))
    ext = output_extension(kind, F.col("payload_kind"), F.col("suggested_extension"))
    stem = semantic_stem(name, F.col("unique_id"), F.col("type"))
    folder = lookup(normal_type(kind), FOLDERS)

    def named(path: Column) -> Column:
        parts = F.split(path, "/")
        parent = F.array_join(F.slice(parts, 1, F.size(parts) - 1), "/")
        last = F.when(extension(path).isNull(), stem).otherwise(F.concat(stem, F.lit("."), extension(path)))
        bare = without_extension(F.element_at(parts, -1))
        # A behaviour that is its container's main object keeps the container's name.
        main = normal_type(kind).isin("monobehaviour", "monobehavior") & (fix_file_name(name) == bare)
        own = F.concat_ws("/", parent, F.concat(bare, F.lit(".assets")), folder, last)
        return F.when(normal_type(kind) == "font", F.concat_ws("/", parent, last)).when(folder.isNotNull() & ~F.coalesce(main, F.lit(False)), own).otherwise(path)

    return bound(plain, lambda p: bound(F.when(ext == "", p).otherwise(F.concat(without_extension(p), F.lit("."), ext)), named))


def routes(payload_kind: Column, payload: Column, target: Column, kind: Column) -> Column:
    """Which writer takes a payload: none, audio and video archives of text assets, images, several files, or bytes."""
    text = normal_type(kind) == "textasset"
    ext = F.lower(target)
    return (
        F.when(payload.isNull() | (F.length(payload) == 0) | (F.lower(payload_kind) == "unsupported"), "skip")
        .when(text & ext.rlike(r"\.acb(\.bytes)?$"), "audio_archive").when(text & ext.rlike(r"\.usm(\.bytes)?$"), "video_archive")
        .when(payload_kind.isin(BUNDLED), "several").when(F.startswith(payload_kind, F.lit("image_")), "image").otherwise("bytes")
    )


def payloads(reads: DataFrame, entries: DataFrame) -> DataFrame:
    """Read results (path_id) with their container entry's data (name, data, ord); the last of equal names, empty bytes for none."""
    last = entries.groupBy("name").agg(F.max_by("data", "ord").alias("data")).withColumnRenamed("name", "_name")
    return reads.join(last, reads["path_id"].cast("string") == last["_name"], "left").withColumn("data", F.coalesce("data", F.lit(b""))).drop("_name")


def keep_track(source: Column, name: Column, ext: Column) -> Column:
    """Tracks of long songs without their variants for other screens."""
    variant = F.lower(F.concat(name, F.lit("."), ext)).rlike(r"_(vr|screen)\.hca\z")
    return ~(F.contains(source, F.lit("music/long")) & variant)
