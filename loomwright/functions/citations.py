"""Citations as columns: "12,3-5.7b; 14,2" to segments and back.

Segments are parted by ";" (a new chapter) and "." (more verses of the same
chapter). A segment is a chapter alone, or verses from-to with letters; the end
of a range may name another chapter ("12,30-13,5").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SEGMENT = "array<struct<chapter:int,first:int,first_letter:string,last_chapter:int,last:int,last_letter:string>>"
#: Fixed pattern of one run of verses.
VERSES = r"^(\d+)([a-z]?)(?:-(?:(\d+),)?(\d+)([a-z]?))?$"


def clean(raw: Column) -> Column:
    """Dashes of all kinds to "-", no white space, ":" to ",", a leading "cf." dropped, letter l before digits to 1."""
    x = F.regexp_replace(F.lower(raw), r"[\x{2010}-\x{2015}\x{2212}]", "-")
    x = F.regexp_replace(F.regexp_replace(x, r"^\s*cf\.?", ""), r"\s+", "")
    return F.regexp_replace(F.regexp_replace(x, ":", ","), r"\bl(?=\d)", "1")


def segments(raw: Column) -> Column:
    """Array of segments in order; parts that the grammar doesn't know are left out (see leftovers). Null: null."""
    parts = F.filter(F.split(clean(raw), ";"), lambda p: p != "")
    return F.flatten(F.transform(parts, _part))


def _part(p: Column) -> Column:
    chapter = F.regexp_extract(p, r"^(\d+)", 1).try_cast("int")
    whole = F.array(_segment(chapter, None, None, chapter, None, None))
    verses = F.split(F.regexp_extract(p, r"^\d+,(.+)$", 1), r"\.")
    known = F.filter(verses, lambda v: v.rlike(VERSES))
    return F.when(p.rlike(r"^\d+$"), whole).when(p.rlike(r"^\d+,"), F.transform(known, lambda v: _verses(chapter, v))).otherwise(F.array().cast(SEGMENT))


def _verses(chapter: Column, v: Column) -> Column:
    group = lambda n: F.regexp_extract(v, VERSES, n)
    first, other, last = group(1).try_cast("int"), group(3).try_cast("int"), group(4).try_cast("int")
    letter = F.nullif(group(2), F.lit(""))
    return _segment(chapter, first, letter, F.coalesce(other, chapter), F.coalesce(last, first), F.when(last.isNull(), letter).otherwise(F.nullif(group(5), F.lit(""))))


def _segment(chapter, first, first_letter, last_chapter, last, last_letter) -> Column:
    values = {"chapter": chapter, "first": first, "first_letter": first_letter, "last_chapter": last_chapter, "last": last, "last_letter": last_letter}
    kinds = {"first_letter": "string", "last_letter": "string"}
    return F.struct(*[(F.lit(None) if c is None else c).cast(kinds.get(n, "int")).alias(n) for n, c in values.items()])


def leftovers(raw: Column) -> Column:
    """The parts that segments() leaves out."""
    parts = F.filter(F.split(clean(raw), ";"), lambda p: p != "")
    verse = VERSES
    bad = lambda p: F.when(p.rlike(r"^\d+$"), F.array().cast("array<string>")).when(p.rlike(r"^\d+,"), F.filter(F.split(F.regexp_extract(p, r"^\d+,(.*)$", 1), r"\."), lambda v: ~v.rlike(verse))).otherwise(F.array(p))
    return F.flatten(F.transform(parts, bad))


def render(found: Column) -> Column:
    """The canonical citation: every segment with its chapter, parted by "; "."""

    def one(s: Column) -> Column:
        start = F.concat(s["chapter"].cast("string"), F.lit(","), s["first"].cast("string"), F.coalesce(s["first_letter"], F.lit("")))
        end = F.concat(s["last"].cast("string"), F.coalesce(s["last_letter"], F.lit("")))
        same = (s["chapter"] == s["last_chapter"]) & (s["first"] == s["last"]) & s["first_letter"].eqNullSafe(s["last_letter"])
        far = F.concat(start, F.lit("-"), s["last_chapter"].cast("string"), F.lit(","), end)
        return F.when(s["first"].isNull(), s["chapter"].cast("string")).when(same, start).when(s["chapter"] == s["last_chapter"], F.concat(start, F.lit("-"), end)).otherwise(far)

    return F.array_join(F.transform(found, one), "; ")
