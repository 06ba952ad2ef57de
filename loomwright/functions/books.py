"""Citations with book names as columns: "Lectura del libro de Isaías 2, 1-5; Jn 6, 68c" to segments, back to one spelling, and sets of verses.

Parts are parted by ";". A part may name its book before its numbers, else it
goes on in the book before it. "," or "." or a blank follows the chapter; runs
of verses are parted by ".", ",", "y" or a blank; a short dash joins verses, a
long one verses of different chapters ("8, 23b—9, 3").
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from loomwright.functions.text import fold

SEGMENT = "struct<book:string,chapter:int,first:int,first_letter:string,last_chapter:int,last:int,last_letter:string>"
STATE = f"struct<book:string,one:boolean,chapter:int,found:array<{SEGMENT}>,rest:array<string>,unknown:boolean>"
# Fixed patterns: a response at the end, labels before a citation, the name before the numbers, a chapter and its verses, a run of verses, a run over chapters.
RESPONSE = r"\(\s*r\.?\s*:?\.?\s*([^()]*?)\s*\)\s*$"
LABEL = r"^\s*(?:aleluya|salmo responsorial|interleccional)\s*:\s*"
NAME = r"^(.*(?<![0-9a-z])[a-zñ]{2,}\.?|[1-4]\s*[a-z]\.?|[a-z]\.?)[\s:]+(\d.*)$"
CHAPTER = r"^(\d+)(?:\s*[,.]\s*|\s+)(\d.*)$"
RUN = r"^(\d+)\s*([a-z]*)(?:\s*-\s*(\d+)\s*([a-z]*))?$"
CROSSING = r"^(\d+)([a-z]*)\|(\d+)~(\d+)([a-z]*)$"


def response(raw: Column) -> Column:
    """The citation of a response in brackets at the end, or null."""
    return F.nullif(F.regexp_extract(fold(raw), RESPONSE, 1), F.lit(""))


def approximate(raw: Column) -> Column:
    """Whether the citation begins with cf. or cfr."""
    return _body(raw).rlike(r"^\s*cfr?\b\.?")


def _body(raw: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(fold(raw), RESPONSE, ""), LABEL, "")


def _run(item: Column, pattern: str, n: int) -> Column:
    return F.regexp_extract(item, pattern, n)


def read(raw: Column, books: dict[str, tuple[str, bool]]) -> Column:
    """struct<outcome, found, rest>: segments in order and the parts that the grammar doesn't know.

    books: folded name or short name to (book, whether it has one chapter, so
    that its citations name none); the longest name that the words before the
    numbers end with counts. outcome: "ok"; "benign" where nothing is cited (no
    digit, or null); "unknown_book"; "partly" and "failed" where something, or
    all, is left in rest. Psalm 113B counts its verses on from 113A's eight.
    """
    names = F.create_map(*[F.lit(x) for name, (book, one) in books.items() for x in (name, f"{int(one)}{book}")])
    body = F.regexp_replace(F.regexp_replace(_body(raw), r"^\s*cfr?\b\.?\s*", ""), r"\s+y\s+", ". ")
    body = F.regexp_replace(body, r"\s*[\x{2010}-\x{2015}]\s*", "|")
    parts = F.filter(F.transform(F.split(body, ";"), lambda p: F.trim(F.trim(p), F.lit(" ."))), lambda p: p != "")
    start = F.struct(F.lit(None).alias("book"), F.lit(False).alias("one"), F.lit(None).alias("chapter"), F.array().alias("found"), F.array().alias("rest"), F.lit(False).alias("unknown")).cast(STATE)
    state = F.aggregate(parts, start, lambda s, p: _part(s, p, names))

    def result(s: Column, cited: Column) -> Column:
        n, left = F.size(s["found"]), F.size(s["rest"])
        outcome = F.when(~cited, "benign").when(s["unknown"], "unknown_book").when(left == 0, "ok").when(n > 0, "partly").otherwise("failed")
        some = lambda x, kind: F.when(cited, x).otherwise(F.array().cast(kind))
        return F.struct(outcome.alias("outcome"), some(s["found"], f"array<{SEGMENT}>").alias("found"), some(s["rest"], "array<string>").alias("rest"))

    return _bind(F.struct(state.alias("state"), (raw.isNotNull() & body.rlike(r"\d")).alias("cited")), lambda x: result(x["state"], x["cited"]))


def _bind(value: Column, use) -> Column:
    """use(value) with the value worked out once."""
    return F.element_at(F.transform(F.array(value), use), 1)


def _part(s: Column, p: Column, names: Column) -> Column:
    """The state after a part."""
    apart = F.regexp_replace(p, r"^([1-4])([a-zñ]{1,12}\s+\d)", "$1 $2")

    def named(apart: Column, name: Column) -> Column:
        tail = F.when(name != "", F.regexp_extract(apart, NAME, 2)).otherwise(apart)
        endings = lambda words: F.transform(words, lambda w, i: F.try_element_at(names, F.array_join(F.slice(words, i + 1, F.size(words)), " ")))
        known = F.try_element_at(F.filter(_bind(F.split(F.trim(name), " "), endings), lambda x: x.isNotNull()), F.lit(1))
        return _bind(F.struct(known.alias("known"), tail.alias("tail")), lambda x: look(name, x["known"], x["tail"]))

    def look(name: Column, known: Column, tail: Column) -> Column:
        plain = F.regexp_replace(F.regexp_replace(tail, r"^113\s*[ab]\b", "113"), r"(\d+[a-z]*)\s*\|\s*(\d+)\s*,\s*(\d+[a-z]*)", "$1|$2~$3")
        return F.struct(name.alias("name"), known.alias("known"), plain.alias("tail"), F.when(tail.rlike(r"^113\s*b\b"), 8).otherwise(0).alias("shift"))

    # each step is bound, as inside a lambda nothing is worked out once for several uses
    found = _bind(apart, lambda a: _bind(F.regexp_replace(F.regexp_extract(a, NAME, 1), r"[\s.]+", " "), lambda name: named(a, name)))
    return _bind(found, lambda x: _numbers(s, p, x))


def _numbers(s: Column, p: Column, x: Column) -> Column:
    fresh = x["known"].isNotNull()
    book = F.when(fresh, F.substring(x["known"], 2, 1000)).otherwise(s["book"])
    one = F.when(fresh, F.substring(x["known"], 1, 1) == "1").otherwise(s["one"])
    before = F.when(fresh, F.when(one, 1)).otherwise(s["chapter"])
    named = ~one & x["tail"].rlike(CHAPTER)
    chapter = F.when(named, _run(x["tail"], CHAPTER, 1).try_cast("int")).otherwise(before)
    verses = F.when(named, _run(x["tail"], CHAPTER, 2)).otherwise(x["tail"])
    whole = chapter.isNull() & x["tail"].rlike(r"^\d+$")
    state = lambda b, o, c, found, rest, unknown: F.struct(b.alias("book"), o.alias("one"), c.alias("chapter"), found.alias("found"), rest.alias("rest"), unknown.alias("unknown")).cast(STATE)
    lost = lambda unknown: state(s["book"], s["one"], s["chapter"], s["found"], F.array_append(s["rest"], p), s["unknown"] | unknown)
    number = x["tail"].try_cast("int")
    all_of_it = state(book, one, number, F.array_append(s["found"], _segment(book, number, None, "", number, None, "")), s["rest"], s["unknown"])
    items = F.filter(F.transform(F.split(verses, r"\s*[.,]\s*|(?<!-)\s+(?=\d)"), lambda i: F.trim(i)), lambda i: i != "")
    begin = state(book, one, chapter, s["found"], s["rest"], s["unknown"])
    runs = F.aggregate(items, begin, lambda t, i: _item(t, i, x["shift"], state))
    return F.when((x["name"] != "") & ~fresh, lost(F.lit(True))).when(book.isNull(), lost(F.lit(True))).when(whole, all_of_it).when(chapter.isNull(), lost(F.lit(False))).otherwise(runs)


def _item(t: Column, i: Column, shift: Column, state) -> Column:
    number = lambda pattern, n: _run(i, pattern, n).try_cast("int")
    last = F.coalesce(number(RUN, 3), number(RUN, 1))
    letter = F.when(number(RUN, 3).isNull(), _run(i, RUN, 2)).otherwise(_run(i, RUN, 4))
    run = _segment(t["book"], t["chapter"], number(RUN, 1) + shift, _run(i, RUN, 2), t["chapter"], last + shift, letter)
    far = _segment(t["book"], t["chapter"], number(CROSSING, 1), _run(i, CROSSING, 2), number(CROSSING, 3), number(CROSSING, 4), _run(i, CROSSING, 5))
    crosses = i.rlike(CROSSING)
    good = crosses | i.rlike(RUN)
    found = F.when(crosses, F.array_append(t["found"], far)).when(good, F.array_append(t["found"], run)).otherwise(t["found"])
    rest = F.when(good, t["rest"]).otherwise(F.array_append(t["rest"], i))
    return state(t["book"], t["one"], F.when(crosses, number(CROSSING, 3)).otherwise(t["chapter"]), found, rest, t["unknown"])


def _segment(*values) -> Column:
    names = ("book", "chapter", "first", "first_letter", "last_chapter", "last", "last_letter")
    return F.struct(*[(v if isinstance(v, Column) else F.lit(v)).alias(n) for n, v in zip(names, values)]).cast(SEGMENT)


def render(found: Column) -> Column:
    """One spelling: "Is 2,1-5.7b; Jn 6,68c", "Mt 8,23b—9,3"; a book and a chapter stand where they change. No segments: empty."""

    def step(s, x):
        new_book = ~x["book"].eqNullSafe(s["book"])
        glue = F.when(new_book, F.concat(F.when(s["text"] == "", "").otherwise("; "), x["book"], F.lit(" "))).otherwise(".")
        chapter = F.when(new_book | ~x["chapter"].eqNullSafe(s["chapter"]), F.concat(x["chapter"].cast("string"), F.lit(","))).otherwise("")
        start, end = F.concat(x["first"].cast("string"), x["first_letter"]), F.concat(x["last"].cast("string"), x["last_letter"])
        run = F.when(x["chapter"] != x["last_chapter"], F.concat(start, F.lit("—"), x["last_chapter"].cast("string"), F.lit(","), end)).when(start == end, start).otherwise(F.concat(start, F.lit("-"), end))
        body = F.when(x["first"].isNull(), x["chapter"].cast("string")).otherwise(F.concat(chapter, run))
        return F.struct(F.concat(s["text"], glue, body).alias("text"), x["book"].alias("book"), x["last_chapter"].alias("chapter"))

    start = F.struct(F.lit("").alias("text"), F.lit(None).cast("string").alias("book"), F.lit(None).cast("int").alias("chapter"))
    return F.aggregate(found, start, step, lambda s: s["text"])


INTERVALS = "array<struct<low:int,high:int>>"


def union(intervals: Column) -> Column:
    """Disjoint intervals in order that hold the same whole numbers; neighbours are joined, empty ones and ones with a null bound left out."""
    real = F.array_sort(F.filter(intervals, lambda x: x["low"] <= x["high"]))

    def step(s, x):
        last = F.try_element_at(s, F.lit(-1))
        joined = F.concat(F.slice(s, 1, F.greatest(F.size(s) - 1, F.lit(0))), F.array(F.struct(last["low"].alias("low"), F.greatest(last["high"], x["high"]).alias("high"))))
        return F.when(last.isNotNull() & (x["low"] <= last["high"] + 1), joined).otherwise(F.concat(s, F.array(F.struct(x["low"].alias("low"), x["high"].alias("high"))))).cast(INTERVALS)

    return F.aggregate(real, F.array().cast(INTERVALS), step)


def minus(a: Column, b: Column) -> Column:
    """union(a) without the numbers of b."""

    def cut(s, x):
        left = F.transform(s, lambda i: F.struct(i["low"].alias("low"), F.least(i["high"], x["low"] - 1).alias("high")))
        right = F.transform(s, lambda i: F.struct(F.greatest(i["low"], x["high"] + 1).alias("low"), i["high"].alias("high")))
        return F.array_sort(F.filter(F.array_distinct(F.concat(left, right)), lambda i: i["low"] <= i["high"])).cast(INTERVALS)

    return F.aggregate(union(b), union(a), cut)


def total(intervals: Column) -> Column:
    """How many whole numbers the intervals hold, each once."""
    return F.aggregate(union(intervals), F.lit(0).cast("long"), lambda s, x: s + (x["high"] - x["low"] + 1))
