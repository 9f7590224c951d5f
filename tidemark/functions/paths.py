"""Paths as column expressions: checks, extensions, names and order."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Longest stem of a published file, and what a longer one ends with.
LONGEST_STEM, CUT = 220, "__truncated"
BACKSLASH = "\\"


def bound(value: Column, use) -> Column:
    """use(value), with value computed once however often use names it."""
    return F.transform(F.array(value), use)[0]


def slashes(path: Column) -> Column:
    return F.replace(path, F.lit(BACKSLASH), F.lit("/"))


def components(path: Column) -> Column:
    """Ordering by this array is ordering by path component; by text, 'a.b' would come before 'a/b'."""
    return F.split(path, "/", -1)


def is_safe(path: Column) -> Column:
    """Not empty, not absolute, and no component that is empty, '.' or '..'."""
    return ~F.exists(components(path), lambda c: c.isin("", ".", ".."))


def file_name(path: Column) -> Column:
    return F.element_at(components(path), -1)


def extension(path: Column) -> Column:
    """What follows the last dot of the last component; null without a dot or with no other than a leading one."""
    name = file_name(path)
    return F.when(name.rlike(r"^.+\.[^.]*\z") & (name != ".."), F.substring_index(name, ".", -1))


def without_extension(path: Column) -> Column:
    return F.when(extension(path).isNull(), path).otherwise(F.substr(path, F.lit(1), F.length(path) - F.length(extension(path)) - 1))


def with_extension(path: Column, ext: str) -> Column:
    """path with its last extension replaced, or with one added."""
    return F.concat(without_extension(path), F.lit("." + ext))


def bundle_file(path: Column) -> Column:
    """Where a bundle is stored; null for an unsafe path. 'a.b' and 'a.c' share a place, as the last extension gives way."""
    stored = F.when(extension(path).eqNullSafe(F.lit("bundle")), path).otherwise(with_extension(path, "bundle"))
    return F.when(is_safe(path), slashes(stored))


def safe_entry(path: Column) -> Column:
    """Only the normal components of an entry's name; 'payload.bin' if none is left."""
    kept = F.array_join(F.filter(components(slashes(path)), lambda c: ~c.isin("", ".", "..")), "/")
    return F.when(kept == "", "payload.bin").otherwise(kept)


def strip_prefix(path: Column, prefix: str) -> Column:
    """safe_entry(path) without a prefix of whole components, unless nothing would be left."""
    kept, head = safe_entry(path), prefix.strip("/")
    if not head:
        return kept
    return F.when(F.startswith(kept, F.lit(head + "/")), F.substr(kept, F.lit(len(head) + 2))).otherwise(kept)


def fix_file_name(name: Column) -> Column:
    """A name that any file system takes: reserved and control characters give way to _, a run of (Clone) to its
    number, and what is too long is cut."""
    safe = F.regexp_replace(name, r'[<>:"/\\|?*\x00-\x1f\x7f-\x9f]', "_")
    run = F.regexp_extract(safe, r"((?:\(Clone\))+)\z", 1)
    clones = (F.length(run) / 7).cast("int")
    stem = F.regexp_replace(F.substr(safe, F.lit(1), F.length(safe) - F.length(run)), r"(?U)\s+\z", "")
    named = F.when(clones > 1, F.concat(stem, F.lit("__clone"), clones.cast("string"))).otherwise(safe)
    return F.when(F.length(named) > LONGEST_STEM, F.concat(F.substring(named, 1, LONGEST_STEM - len(CUT)), F.lit(CUT))).otherwise(named)


def semantic_stem(name: Column, unique_id: Column, kind: Column) -> Column:
    """The first of the three that is not blank once fixed, else 'asset'."""
    given = lambda c: F.when(~fix_file_name(c).rlike(r"(?U)^\s*\z"), fix_file_name(c))
    return F.coalesce(given(name), given(unique_id), given(kind), F.lit("asset"))


def text_asset_file(path: Column) -> Column:
    """The published name of a text asset: its doubled extension goes, and music scores are text files."""
    lower = F.lower(path)
    cut = F.when(F.endswith(lower, F.lit(".bytes")), F.substr(path, F.lit(1), F.length(path) - 6)).otherwise(path)
    return F.when(F.contains(path, F.lit("/music_score/")) & F.endswith(lower, F.lit(".bytes")), F.concat(cut, F.lit(".txt"))).otherwise(cut)


def segment_key(stem: Column) -> tuple[Column, Column]:
    """Of a stem like name-002 or name-002__dup8: the name and the number from 1 on, else nulls."""
    pattern = r"^(.+)-([0-9]+)(?:__dup[0-9]+)?\z"
    number = F.regexp_extract(stem, pattern, 2).try_cast("long")
    ok = stem.rlike(pattern) & (number >= 1)
    return F.when(ok, F.regexp_extract(stem, pattern, 1)), F.when(ok, number)


def work_dir(root: str, region: Column, version: Column) -> Column:
    """root/region/version/AssetBundles, with a version that is one component; a blank one is 'current'."""
    one = F.regexp_replace(F.coalesce(version, F.lit("")), r"[/\\:]", "_")
    return F.concat_ws("/", F.lit(root), region, F.when(F.trim(one) == "", "current").otherwise(one), F.lit("AssetBundles"))


def export_prefix(path: Column, category: Column, by_category: bool, own_root: str = "") -> Column:
    """Where a bundle's files go: its own path, or one that starts with its category unless it lies under own_root."""
    placed = F.concat_ws("/", F.lower(category), path)
    return path if by_category else F.when(F.startswith(path, F.lit(own_root)), path).otherwise(placed) if own_root else placed


def render(template: Column | str, **values: Column) -> Column:
    """A template with {name} replaced by each value in the order given, so a value may bring in a later name."""
    out = F.lit(template) if isinstance(template, str) else template
    for name, value in values.items():
        out = F.replace(out, F.lit("{" + name + "}"), F.coalesce(value.cast("string"), F.lit("")))
    return out


def percent_encode(text: Column) -> Column:
    """RFC 3986: letters, digits, '-', '.', '_' and '~' stay."""
    out = F.url_encode(text)
    for a, b in (("+", "%20"), ("*", "%2A"), ("%7E", "~")):
        out = F.replace(out, F.lit(a), F.lit(b))
    return out


def endpoint(address: Column, tls: bool = True) -> Column:
    """An address with a scheme and without a trailing slash."""
    plain = F.regexp_replace(address, "/+$", "")
    return F.when(plain.rlike("^[a-z]+://"), plain).otherwise(F.concat(F.lit("https://" if tls else "http://"), plain))


def storage_prefix(prefix: Column) -> Column:
    """Without slashes around; null if nothing is left."""
    plain = F.btrim(F.btrim(prefix), F.lit("/"))
    return F.when(plain != "", plain)
