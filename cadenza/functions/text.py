"""Text keys and delimited-list normalisation as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that mark another version of the same title.
BRACKETED_VERSION_WORDS = ["live", "remix", "edit", "version", "mono", "stereo"]
BARE_VERSION_WORDS = ["live", "remix", "radio edit", "edit", "version", "mono", "stereo", "remastered"]


def strip(c: Column) -> Column:
    """Trim every kind of Unicode whitespace (SQL ``trim`` removes blanks only); text between visible ASCII is left as it is."""
    c = c.cast("string")
    plain = F.substring(c, 1, 1).between("!", "~") & F.substring(c, -1, 1).between("!", "~")
    return F.when(plain, c).otherwise(F.regexp_replace(c, r"(?U)^\s+|\s+$", ""))


def is_blank(c: Column) -> Column:
    return c.isNull() | (strip(c) == "")


def non_blank(c: Column) -> Column:
    """The value, or null when it is empty after trimming."""
    return F.when(~is_blank(c), c)


def first_non_blank(*columns: Column, default: str = "") -> Column:
    return F.coalesce(*[non_blank(c) for c in columns], F.lit(default))


def slug(c: Column) -> Column:
    s = F.regexp_replace(F.lower(strip(c)), "[^a-z0-9]+", "_")
    s = F.regexp_replace(s, "^_+|_+$", "")
    return F.when(s == "", "unknown").otherwise(s)


def track_key(artist: Column, track: Column, prefix: str = "track_") -> Column:
    """Stable id of an (artist, title) pair: prefix + first 16 hex digits of a SHA-1."""
    digest = F.sha1(F.concat(slug(artist), F.lit("::"), slug(track)))
    return F.concat(F.lit(prefix), F.substring(digest, 1, 16))


def artist_token(c: Column) -> Column:
    return F.concat(F.lit("artist_"), slug(F.coalesce(c, F.lit(""))))


def token_count(c: Column) -> Column:
    words = F.filter(F.split(F.coalesce(c, F.lit("")), r"(?U)\s+"), lambda w: w != "")
    return F.size(words).cast("long")


def title_key(c: Column) -> Column:
    """Key under which versions of one title (live, remix, remaster, ...) collapse."""
    inner = "|".join(BRACKETED_VERSION_WORDS)
    bare = "|".join(BARE_VERSION_WORDS)
    s = F.lower(F.coalesce(c, F.lit("")))
    s = F.regexp_replace(s, rf"\([^)]*({inner})[^)]*\)", " ")
    s = F.regexp_replace(s, rf"\[[^\]]*({inner})[^\]]*\]", " ")
    s = F.regexp_replace(s, rf"\b({bare})\b", " ")
    return F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))


def name_artist_key(track_id: Column, title: Column, artist: Column) -> Column:
    """Duplicate key: (title key, artist key), or (id, "") when both are empty."""
    t, a = title_key(title), title_key(artist)
    empty = (t == "") & (a == "")
    return F.when(empty, F.struct(track_id.cast("string").alias("k1"), F.lit("").alias("k2"))).otherwise(
        F.struct(t.alias("k1"), a.alias("k2"))
    )


def split_list(c: Column, pattern: str = ",") -> Column:
    """Trimmed non-empty members of a delimited string."""
    return F.filter(F.transform(F.split(F.coalesce(c, F.lit("")), pattern), strip), lambda x: x != "")


def first_token(c: Column) -> Column:
    return F.coalesce(strip(F.get(F.split(c, ","), F.lit(0))), F.lit(""))


def join_list(a: Column) -> Column:
    """Non-empty members joined by ', '."""
    return F.array_join(F.filter(a, lambda x: x.isNotNull() & (x != "")), ", ")


def normalized_ids(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(F.transform(split_list(c), F.lower))), ", ")


def normalized_names(c: Column) -> Column:
    return F.array_join(F.array_sort(F.array_distinct(split_list(c))), ", ")


def normalized_genres(c: Column) -> Column:
    clean = F.transform(split_list(c), lambda g: F.replace(F.lower(g), F.lit("  "), F.lit(" ")))
    return F.array_join(F.array_sort(F.array_distinct(clean)), ", ")


def genre_terms(c: Column) -> Column:
    """Genres of a loosely delimited field (comma, bar, semicolon, slash; list brackets dropped)."""
    return split_list(F.regexp_replace(c, r"[\[\]']", ""), r"[,|;/]")


def genre_labels(c: Column) -> Column:
    """Display labels: underscores become blanks, first occurrence kept."""
    return F.array_distinct(F.transform(split_list(c), lambda g: F.replace(g, F.lit("_"), F.lit(" "))))


def genre_tokens(c: Column) -> Column:
    """Model tokens: lower case, blanks become underscores, distinct and sorted."""
    clean = F.transform(split_list(c), lambda g: F.replace(F.lower(g), F.lit(" "), F.lit("_")))
    return F.array_sort(F.array_distinct(clean))


def track_label(track: Column, artist: Column) -> Column:
    return F.concat_ws(" - ", non_blank(strip(track)), non_blank(strip(artist)))


def looks_like_catalog_id(c: Column) -> Column:
    return strip(c).rlike("^[A-Za-z0-9]{22}$")


def release_decade(c: Column) -> Column:
    year = F.regexp_extract(c.cast("string"), r"(\d{4})", 1).try_cast("int")
    return F.floor(year / 10).cast("int") * 10


def utc_timestamp(c: Column) -> Column:
    """Timestamp, or null when the text does not parse; text without a zone is UTC in every session."""
    text = strip(c.cast("string"))
    zoned = text.rlike(r"(?i)([0-9]{2}:[0-9]{2}.*([+-][0-9]{1,2}(:?[0-9]{2})?|z)|utc|gmt)$")
    dated = text.rlike(r"^[0-9]{4}-[0-9]{1,2}-[0-9]{1,2}$")
    whole = F.when(dated, F.concat(text, F.lit("T00:00:00Z"))).when(zoned, text).otherwise(F.concat(text, F.lit("Z")))
    return F.try_to_timestamp(whole)
