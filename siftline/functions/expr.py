"""Scalar expressions, each on columns (PRJ, FLT, STR, DT, HSH and B64 of the inventory)."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf

#: Codecs that lose nothing; extensions of videos; words that name another version of a work.
LOSSLESS = ["flac", "alac", "wav", "aiff", "ape", "wavpack"]
VIDEO = ["mp4", "m4v", "mkv", "webm", "mov", "avi"]
VERSION_WORDS = ["instrumental", "acapella", "a cappella"]


def folder(path: Column) -> Column:
    """PRJ-01: the text through the last slash, or ''."""
    return F.regexp_extract(path, r"(?s)^(.*/)", 1)


def basename(path: Column) -> Column:
    """STR-06."""
    return F.substring_index(path, "/", -1)


def stem(path: Column) -> Column:
    """STR-06: the base name without its last extension."""
    return F.regexp_replace(basename(path), r"(?<=.)\.[^.]*$", "")


def extension(path: Column) -> Column:
    """STR-06, SRC-02: in lower case, without the dot."""
    return F.lower(F.regexp_extract(basename(path), r"(?<=.)\.([^.]*)$", 1))


def top_dir(path: Column) -> Column:
    """PRJ-02."""
    return F.when(F.instr(path, "/") > 0, F.substring_index(path, "/", 1)).otherwise("")


def trimmed(text: Column) -> Column:
    """PRJ-10: for comparing titles: lower case, without spaces around."""
    return F.lower(F.trim(text))


def best(ordered: Column) -> Column:
    """PRJ-12: the first of an array that is in order; null of an empty one."""
    return F.try_element_at(ordered, F.lit(1))


def merged_maps(first: Column, second: Column) -> Column:
    """MAP-01: both maps' keys; where both have one, the second's value."""
    return F.map_concat(F.map_filter(first, lambda k, _: ~F.map_contains_key(second, k)), second)


def number_files(n: Column, one: str, many: str) -> Column:
    """STR-07: "1 album", "2 albums"."""
    return F.when(n == 1, F.format_string(f"%d {one}", n)).otherwise(F.format_string(f"%d {many}", n))


def inside(path: Column, root: str) -> Column:
    """FLT-02, FLT-04: below a folder, taken literally; the folder '' is that of relative paths."""
    return ~path.startswith("/") if root == "" else path.startswith(root.rstrip("/") + "/")


def damaged_at_import(error: Column, decoded: Column, stated: Column, least: float = 0.5) -> Column:
    """FLT-10: only of files that a scan complained of: less than so much of the stated length decodes; without a stated length they are."""
    known = F.coalesce(stated, F.lit(0.0))
    return (F.coalesce(error, F.lit("")) != "") & F.when(known > 0, F.coalesce(decoded, F.lit(0.0)) < least * known).otherwise(True)


def first_number(path: Column) -> Column:
    """PRJ-03: the first number in the file name."""
    return F.nullif(F.regexp_extract(basename(path), r"(\d+)", 1), F.lit("")).try_cast("int")


def _ladder(value: Column, steps: list[tuple[float, object]], rest: object) -> Column:
    out = F.lit(rest)
    for least, name in reversed(steps):
        out = F.when(value >= least, F.lit(name)).otherwise(out)
    return out


def quality_tier(lossless: Column, kbps: Column) -> Column:
    """PRJ-04: 6 for lossless, then 5 to 1 by bit rate."""
    return F.when(lossless, 6).otherwise(_ladder(F.coalesce(kbps, F.lit(0.0)), [(300, 5), (230, 4), (180, 3), (120, 2)], 1))


def stats_tier(lossless: Column, kbps: Column) -> Column:
    """PRJ-05."""
    return F.when(lossless, "lossless").otherwise(_ladder(F.coalesce(kbps, F.lit(0.0)), [(256, "256k+"), (192, "192k"), (128, "128k")], "under 128k"))


def rate_bucket(variable: Column, kbps: Column) -> Column:
    """PRJ-06."""
    return F.when(variable, "VBR").otherwise(_ladder(F.coalesce(kbps, F.lit(0.0)), [(320, "320"), (256, "256-319"), (192, "192-255"), (128, "128-191")], "<128"))


def path_order(path: Column) -> Column:
    """PRJ-07: shorter first, then by name."""
    return F.struct(F.length(path).alias("length"), path.alias("path"))


def identity(audio_id: Column, digest: Column) -> Column:
    """PRJ-08. Null when both are missing: unreadable files are no copies of one another."""
    return F.when(F.coalesce(audio_id, F.lit("")) != "", F.concat(F.lit("aid:"), audio_id)).when(digest.isNotNull(), F.concat(F.lit("sha:"), digest))


def filled(text: Column) -> Column:
    """FLT-01."""
    return text.isNotNull() & (text != "")


def share(part: Column, whole: Column, places: int = 3) -> Column:
    """PRJ-11; null of nothing."""
    return F.round(F.try_divide(part.cast("double"), whole.cast("double")), places)


def gap(distances: Column) -> Column:
    """PRJ-13: from the best to the next; 1 if there is none."""
    return F.coalesce(F.try_element_at(distances, F.lit(2)) - F.try_element_at(distances, F.lit(1)), F.lit(1.0))


def without_suffix(name: Column) -> Column:
    """PRJ-16: without a bracketed suffix."""
    return F.regexp_replace(name, r" \[[^\]]*\]$", "")


def names_list(names: Column, most: int = 3) -> Column:
    """PRJ-17: a, b, c and n more."""
    n = F.size(names)
    return F.when(n <= most, F.array_join(names, ", ")).otherwise(F.concat(F.array_join(F.slice(names, 1, most), ", "), F.format_string(" and %d more", n - most)))


def label(artist: Column, album: Column) -> Column:
    """PRJ-19."""
    return F.when(filled(artist), F.concat(artist, F.lit(" - "), album)).otherwise(album)


def free_name(name: Column, taken: Column) -> Column:
    """PRJ-15: the name with " (n)" for its nth collision (taken, from 0)."""
    return F.when(taken == 0, name).otherwise(F.format_string("%s (%d)", name, taken + 1))


@pandas_udf(T.StringType())
def fold(text: pd.Series) -> pd.Series:
    """Compatibility decomposition, ASCII only, lower case. No built-in function decomposes."""
    return text.map(lambda t: unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode().lower(), na_action="ignore")


def norm_title(title: Column) -> Column:
    """STR-01: folded, without bracketed parts and punctuation."""
    plain = F.regexp_replace(fold(F.coalesce(title, F.lit(""))), r"[(\[{].*?[)\]}]", " ")
    return F.trim(F.regexp_replace(plain, "[^a-z0-9]+", " "))


def norm_name(name: Column) -> Column:
    """STR-03: folded, letters and digits only, without a leading "the"."""
    plain = F.trim(F.regexp_replace(fold(F.coalesce(name, F.lit(""))), "[^a-z0-9]+", " "))
    return F.regexp_replace(plain, "^the ", "")


def name_key(name: Column) -> Column:
    """STR-04: word characters of any script, without a leading "the"."""
    return F.regexp_replace(F.regexp_replace(F.lower(F.trim(name)), r"^the\s+", ""), r"(?U)\W+", "")


def titles_agree(a: Column, b: Column) -> Column:
    """STR-02, on normal titles: equal, or the one begins the other and has 8 characters at least."""
    return (a != "") & (b != "") & ((a == b) | ((F.least(F.length(a), F.length(b)) >= 8) & (a.startswith(b) | b.startswith(a))))


def whole_words(text: Column, part: Column) -> Column:
    """STR-05."""
    return (F.length(part) >= 8) & F.contains(F.concat(F.lit(" "), text, F.lit(" ")), F.concat(F.lit(" "), part, F.lit(" ")))


def non_latin(text: Column) -> Column:
    """FLT-11: has a letter of another script."""
    return F.coalesce(text, F.lit("")).rlike(r"[\p{L}&&[^\p{IsLatin}]]")


def version_word(here: Column, there: Column) -> Column:
    """FLT-12: the first version word that stands in one text only."""
    a, b = F.lower(F.coalesce(here, F.lit(""))), F.lower(F.coalesce(there, F.lit("")))
    return F.coalesce(*(F.when(F.contains(a, F.lit(w)) != F.contains(b, F.lit(w)), F.lit(w)) for w in VERSION_WORDS))


def needs_scan(old_size: Column, old_mtime: Column, old_error: Column, fingerprint: Column, size: Column, mtime: Column) -> Column:
    """FLT-08, after a left join with what is known."""
    return old_size.isNull() | (old_size != size) | (old_mtime != mtime) | old_error.isNotNull() | fingerprint.isNull()


def damaged(decoded: Column, expected: Column, other_length: Column, least: float = 0.9) -> Column:
    """FLT-09: less than so much of the length decodes; an unknown or zero length tells nothing."""
    length = F.coalesce(F.nullif(other_length, F.lit(0.0)), expected)
    return F.coalesce((length > 0) & (decoded < least * length), F.lit(False))


def usable_image(kind: Column, width: Column, height: Column) -> Column:
    """FLT-14."""
    return kind.isin("JPEG", "PNG") & (F.least(width, height) >= 200)


def clock_seconds(text: Column) -> Column:
    """DT-04: h:m:s to seconds."""
    part = F.split(text, ":")
    return part[0].cast("double") * 3600 + part[1].cast("double") * 60 + part[2].cast("double")


def day(epoch: Column) -> Column:
    """DT-02."""
    return F.to_date(F.timestamp_seconds(epoch))


def digest16(value: Column) -> Column:
    """HSH-01, DOM-52: 16 hexadecimal digits of the SHA-1."""
    return F.substring(F.sha1(value), 1, 16)


def from_url_base64(text: Column) -> Column:
    """B64-01."""
    padded = F.concat(F.translate(text, "-_", "+/"), F.repeat(F.lit("="), F.pmod(-F.length(text), F.lit(4))))
    return F.unbase64(padded)


def unsorted_name(path: Column) -> Column:
    """PRJ-14: the parts after the dated folder of processed batches, joined; the whole path if there is none."""
    rest = F.regexp_extract(path, r"(?:^|/)\.processed/[^/]+/(.*)$", 1)
    return F.array_join(F.split(F.when(rest != "", rest).otherwise(path), "/"), " - ")
