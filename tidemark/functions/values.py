"""Other scalar expressions: types and their aliases, categories, failures, times and formats."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Selectors by alias, types by selector, types without a reader, default read kinds.
SELECTOR_OF = {"texture2d": "tex2d", "tex2d": "tex2d", "texture2darray": "tex2dArray", "tex2darray": "tex2dArray", "tex2d_array": "tex2dArray", "sprite": "sprite", "textasset": "textAsset", "text_asset": "textAsset", "monobehaviour": "monoBehaviour", "monobehavior": "monoBehaviour", "mono_behaviour": "monoBehaviour", "mono_behavior": "monoBehaviour", "font": "font", "shader": "shader", "audioclip": "audio", "audio": "audio", "videoclip": "video", "video": "video", "movietexture": "movieTexture", "movie_texture": "movieTexture", "mesh": "mesh", "animator": "animator"}
DEFAULT_SELECTORS = ["monoBehaviour", "textAsset", "tex2d", "tex2dArray", "sprite", "audio"]
TYPES_OF = {"tex2d": ["texture2d"], "texture2d": ["texture2d"], "tex2darray": ["texture2darray", "texture2darrayimage"], "texture2darray": ["texture2darray", "texture2darrayimage"], "sprite": ["sprite"], "textasset": ["textasset"], "monobehaviour": ["monobehaviour"], "monobehavior": ["monobehaviour"], "audio": ["audioclip"], "audioclip": ["audioclip"], "video": ["videoclip"], "videoclip": ["videoclip"], "movietexture": ["movietexture"], "font": ["font"], "shader": ["shader", "shadervariantcollection"], "mesh": ["mesh"], "animator": ["animator", "animatorcontroller"]}
UNREADABLE = ["Animation", "AnimationClip", "AnimatorController", "AssetBundle", "AudioListener", "Avatar", "Camera", "Canvas", "CanvasRenderer", "Cubemap", "GameObject", "Material", "MeshFilter", "MeshRenderer", "MonoScript", "ParticleSystem", "ParticleSystemRenderer", "PlayableDirector", "RectTransform", "ShaderVariantCollection", "SkinnedMeshRenderer", "SortingGroup", "SpriteMask", "SpriteRenderer", "TextMesh", "Texture3D", "Transform"]
READ_KIND = {"texture2d": "image", "texture2darray": "image", "texture2darrayimage": "image", "sprite": "image", "textasset": "text_bytes", "monobehaviour": "typetree_json", "monobehavior": "typetree_json", "audioclip": "audio", "videoclip": "video", "movietexture": "video", "font": "font", "shader": "shader", "shadervariantcollection": "shader", "mesh": "obj", "animator": "fbx"}
IMAGES = ["Texture2D", "Texture2DArray", "Texture2DArrayImage", "Sprite"]
# Failure kinds by words of the message, in order, and whether to try again.
FAILURES = [("timeout", True, ["timed out"]), ("cancelled", False, ["cancelled"]), ("network", True, ["http", "request", "status"]), ("decode", False, ["decrypt", "msgpack", "aes"]), ("storage", True, ["s3 upload", "bucket", "storage"]), ("git_sync", True, ["git", "chart hash"]), ("export", True, ["assetstudio", "ffmpeg", "media conversion", "export"]), ("configuration", False, ["config", "missing", "region"])]
CATEGORIES = {"StartApp": ["StartApp", "startApp"], "OnDemand": ["OnDemand", "onDemand"], "LivePv": ["Live_pv", "live_pv", "LivePv", "livePv"]}


def lookup(key: Column, table: dict[str, str]) -> Column:
    return F.try_element_at(F.create_map(*[F.lit(x) for kv in table.items() for x in kv]), key)


def normal_type(value: Column) -> Column:
    """Lower case, without white space, '_' and '-'."""
    return F.lower(F.regexp_replace(value, r"(?U)[_\-\s]", ""))


def type_selector(value: Column) -> Column:
    """The selector that an alias stands for, else null."""
    return lookup(F.lower(F.regexp_replace(value, r"(?U)^\s+|\s+\z", "")), SELECTOR_OF)


def selectors(types: Column) -> Column:
    """Configured types as selectors, each once, in the order given; the default ones if none is left."""
    named = F.transform(types, lambda t: F.coalesce(type_selector(t), F.trim(t)))
    kept = F.array_distinct(F.filter(named, lambda t: t != ""))
    return F.when(F.size(kept) > 0, kept).otherwise(F.array(*[F.lit(t) for t in DEFAULT_SELECTORS]))


def profile_hash(hashes: Column, profile: Column) -> tuple[Column, Column]:
    """(the hash of a profile in a map, or null; a note if it is missing)."""
    found = F.try_element_at(hashes, profile)
    return found, F.when(found.isNull(), F.concat(F.lit("no hash is configured for profile "), F.coalesce(profile, F.lit(""))))


def type_matches(selector: str, kind: Column) -> Column:
    """Whether a type is meant by a selector: 'all', itself, or one of its family."""
    name = "".join(c for c in selector if c not in "_-" and not c.isspace()).lower()
    return F.lit(True) if selector.strip().lower() == "all" else normal_type(kind).isin(sorted({name, *TYPES_OF.get(name, [])}))


def category(value: Column) -> Column:
    out = F.coalesce(value, F.lit(""))
    for name, spellings in CATEGORIES.items():
        out = F.when(value.isin(spellings), name).otherwise(out)
    return out


def failure_kind(message: Column) -> tuple[Column, Column]:
    """(kind, whether to try again): the first kind of which the message has a word, else internal."""
    low = F.lower(message)
    kind, again = F.lit("internal"), F.lit(False)
    for name, retry, words in reversed(FAILURES):
        has = F.lit(False)
        for w in words:
            has = has | F.contains(low, F.lit(w))
        kind, again = F.when(has, name).otherwise(kind), F.when(has, F.lit(retry)).otherwise(again)
    return kind, again


def retry_status(status: Column) -> Column:
    return (status >= 500) | status.isin(429, 408)


def retry_message(message: Column, marks: list[str]) -> Column:
    return F.exists(F.array(*[F.lit(m.lower()) for m in marks]), lambda m: F.contains(F.lower(message), m))


def backoff_ms(attempt: Column, first: int, most: int) -> Column:
    """The wait before an attempt from 1 on, without jitter."""
    return F.least(F.lit(float(first)) * F.pow(F.lit(2.0), attempt - 1), F.lit(float(most))).cast("long")


def jittered_ms(wait: Column, noise: Column) -> Column:
    """Half of a wait, and of the other half what noise (a whole number from 0 on) leaves: waits of many do not end at once."""
    half = F.floor(wait / 2).cast("long")
    return half + noise % (half + 1)


def tokyo_stamp(at: Column) -> Column:
    """A moment in UTC as digits of the time in Tokyo."""
    return F.date_format(F.convert_timezone(F.lit("UTC"), F.lit("Asia/Tokyo"), at), "yyyyMMddHHmmss")


def frame_rate(n: Column, d: Column) -> Column:
    return F.when(d <= 1, n.cast("string")).otherwise(F.concat_ws("/", n, d))


def elapsed_ms(since: Column, now: Column) -> Column:
    return F.greatest(F.lit(0).cast("long"), (F.unix_millis(now) - F.unix_millis(since)))


def metric_text(metrics: Column) -> Column:
    """A map of numbers as 'key=5ms' parts in order of key."""
    return F.array_join(F.transform(F.array_sort(F.map_entries(metrics)), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"), F.lit("ms"))), ", ")


def sorted_json(m: Column, pretty: bool = False) -> Column:
    """A map as JSON with its keys in order."""
    return F.to_json(F.map_from_entries(F.array_sort(F.map_entries(m))), {"pretty": "true"} if pretty else {})


def metric_lines(output: Column) -> Column:
    """The lines of a program's output that tell metrics or plans, joined."""
    return F.array_join(F.filter(F.split(output, r"\r?\n"), lambda x: F.contains(x, F.lit(" metrics:")) | F.startswith(x, F.lit("Planned "))), " | ")


def asset_name(document: Column, name: Column, path: Column) -> Column:
    """The name in a JSON document of an asset, else its own, else its path."""
    given = lambda c: F.when(F.trim(c) != "", c)
    return F.coalesce(given(F.get_json_object(document, "$.m_AssetBundleName")), given(F.get_json_object(document, "$.m_Name")), given(name), path)


def access_line(template: str, at: Column, status: Column, method: Column, path: Column, latency_ms: Column) -> Column:
    """A log line; latencies of a second or more are in seconds."""
    from .paths import render

    latency = F.when(latency_ms < 1000, F.concat(latency_ms.cast("string"), F.lit("ms"))).otherwise(F.format_string("%.2fs", latency_ms.cast("double") / 1000))
    return render(template, time=at, status=status, method=method, path=path, latency=latency)
