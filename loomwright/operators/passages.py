"""Passages asked for by chapter and verse: rules in two dimensions, spans over chapters, what is missing and why."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomwright.operators.ranges import checked_rules


def renumber_chapters(rows: DataFrame, rules: DataFrame, chapter: str, verse: str) -> DataFrame:
    """rows with new_chapter, new_verse and ruled, by the first rule whose chapter and verse ranges hold them.

    rules (a checked small table): rule_order, ch_low, ch_high, v_low, v_high,
    mode ("=" the same chapter, "+n" or "-n" so many on, or a chapter number)
    and shift of the verse. Without a rule: as they were, ruled false.
    """
    rule_table = checked_rules(rules)  # counted, all rules go to each task as one array
    table = rule_table.agg(F.sort_array(F.collect_list(F.struct("rule_order", "ch_low", "ch_high", "v_low", "v_high", "mode", "shift"))).alias("__rules"))
    fits = lambda r: (F.col(chapter) >= r["ch_low"]) & (F.col(chapter) <= r["ch_high"]) & (F.col(verse) >= r["v_low"]) & (F.col(verse) <= r["v_high"])
    x = rows.join(F.broadcast(table), F.lit(True), "left")
    x = x.withColumn("__rule", F.try_element_at(F.filter("__rules", fits), F.lit(1)))
    mode = F.col("__rule.mode")
    moved = F.when(mode == "=", F.col(chapter)).when(mode.rlike("^[+-]"), F.col(chapter) + mode.cast("int")).otherwise(mode.try_cast("int"))
    ruled = F.col("__rule").isNotNull()
    x = x.withColumn("new_chapter", F.when(ruled, moved).otherwise(F.col(chapter))).withColumn("new_verse", F.when(ruled, F.col(verse) + F.col("__rule.shift")).otherwise(F.col(verse)))
    return x.withColumn("ruled", ruled).drop("__rules", "__rule")


def _pieces(spans: DataFrame, corpus: DataFrame, book: str, tasks: int | None = None) -> DataFrame:
    """spans once for each of their chapters (__c), with the first and last number asked for there (__low, __high) and whether it is a first or last chapter (__edge)."""
    bounds = corpus.groupBy(book, F.col("chapter").alias("__c")).agg(F.min("verse").alias("__least"), F.max("verse").alias("__most"))
    pieces = _dealt(spans.where(F.col("chapter") <= F.col("last_chapter")).withColumn("__c", F.explode(F.sequence("chapter", "last_chapter"))), tasks, book, "__c")
    begins, ends = F.col("__c") == F.col("chapter"), F.col("__c") == F.col("last_chapter")
    low = F.when(begins, F.coalesce("first", "__least")).otherwise(F.coalesce(F.least("__least", F.lit(1)), F.lit(1)))
    high = F.when(ends, F.coalesce("last", "__most")).otherwise(F.col("__most"))
    return pieces.join(bounds, [book, "__c"], "left").withColumn("__low", low).withColumn("__high", high).withColumn("__edge", begins | ends)


def _dealt(rows: DataFrame, tasks: int | None, *keys: str) -> DataFrame:
    return rows.repartition(tasks, *keys) if tasks else rows


def asked_numbers(spans: DataFrame, corpus: DataFrame, span_id: str, book: str) -> DataFrame:
    """span_id, book, chapter, verse of every number that a span asks for; verse is null where a first or last chapter isn't in the corpus and its bounds aren't given.

    The corpus says how far a chapter goes: a span without `first` begins with
    the chapter's first number, one that goes on into later chapters takes each
    to its end, one without `last` ends with the last chapter. Chapters in the
    middle that the corpus hasn't are passed over. Spans meet the corpus by
    chapter, whose bounds are one row each.
    """
    low, high = F.col("__low"), F.col("__high")
    numbers = F.when(low <= high, F.sequence(low, high)).when((low.isNull() | high.isNull()) & F.col("__edge"), F.array(F.lit(None).cast("int")))
    return _pieces(spans, corpus, book).select(span_id, book, F.col("__c").alias("chapter"), F.explode(numbers).alias("verse"))


def missing_log(asked: DataFrame, corpus: DataFrame, omitted: DataFrame, span_id: str, book: str) -> DataFrame:
    """span_id, book, chapter, verse, declared of asked_numbers() that the corpus hasn't; a null verse stands for a whole chapter."""
    there = corpus.select(book, "chapter", "verse").distinct()
    known = omitted.select(book, "chapter", "verse").distinct().withColumn("declared", F.lit(True))
    lost = asked.join(there, [book, "chapter", "verse"], "left_anti").join(known, [book, "chapter", "verse"], "left")
    return lost.select(span_id, book, "chapter", "verse", F.coalesce("declared", F.lit(False)).alias("declared"))


#: Numbers of a chapter that one row holds when spans are counted against it.
SECTION = 256


def _sections(corpus: DataFrame, omitted: DataFrame, book: str, tasks: int | None) -> DataFrame:
    """book, __c, __from, __found (verse and rows), __declared (left out and not there): what is known of SECTION numbers of a chapter."""
    place = [book, "chapter", "verse"]
    marks = corpus.select(*place, F.col("letter").isNull().alias("__plain"), F.lit(False).alias("__known"))
    marks = marks.unionByName(omitted.select(*place, F.lit(False).alias("__plain"), F.lit(True).alias("__known"))).where(F.col("verse").isNotNull())
    one = _dealt(marks, tasks, book, "chapter").groupBy(*place).agg(F.count_if(~F.col("__known")).alias("__n"), F.count_if("__plain").alias("__own"))
    at, n = F.col("verse").cast("long"), F.col("__n")
    rows = F.when(F.col("__own") > 0, F.col("__own")).otherwise(n)
    found = F.collect_list(F.when(n > 0, F.struct(at.alias("verse"), rows.alias("rows")))).alias("__found")
    return one.groupBy(book, F.col("chapter").alias("__c"), (at - F.pmod(at, F.lit(SECTION))).alias("__from")).agg(found, F.collect_list(F.when(n == 0, at)).alias("__declared"))


def resolve_spans(spans: DataFrame, corpus: DataFrame, omitted: DataFrame, span_id: str, book: str, tasks: int | None = None) -> DataFrame:
    """span_id, verses, rows, missing, omitted, distinct_asked, missing_chapters of spans asked for in a corpus.

    spans: span_id, book, chapter, first, last_chapter, last; first null: the
    whole chapters; last null: to the end of last_chapter. corpus: book,
    chapter, verse, letter: a number stands for its lettered verses unless a
    row without a letter has it. omitted: book, chapter, verse declared as left
    out. missing and omitted count the numbers of asked_numbers() that the
    corpus hasn't, also where a span goes over several chapters.
    distinct_asked is how many numbers were asked for (null: open at an end).

    The numbers asked for are not written out: a span has a row for each
    SECTION numbers of a chapter, which counts them. tasks: how many the rows
    are dealt over (None: Spark's own number).
    """
    low, high = F.col("__low").cast("long"), F.col("__high").cast("long")
    start = lambda c: c - F.pmod(c, F.lit(SECTION))
    # a null section stands for a first or last chapter that isn't there
    parts = F.when(low <= high, F.sequence(start(low), start(high), F.lit(SECTION).cast("long"))).when((low.isNull() | high.isNull()) & F.col("__edge"), F.array(F.lit(None).cast("long")))
    asked = _pieces(spans, corpus, book, tasks).select(span_id, book, "__c", low.alias("__low"), high.alias("__high"), F.explode(parts).alias("__from"))
    x = asked.join(_sections(corpus, omitted, book, tasks), [book, "__c", "__from"], "left")
    inside = lambda v: (v >= F.col("__low")) & (v <= F.col("__high"))
    hits = F.filter("__found", lambda e: inside(e["verse"]))
    zero = F.lit(0).cast("long")
    x = x.select(
        span_id,
        F.coalesce(F.least("__high", F.col("__from") + SECTION - 1) - F.greatest("__low", "__from") + 1, zero).alias("__asked"),
        F.coalesce(F.size(hits), zero).alias("verses"),
        F.coalesce(F.aggregate(hits, zero, lambda n, e: n + e["rows"]), zero).alias("rows"),
        F.coalesce(F.size(F.filter("__declared", inside)), zero).alias("omitted"),
        F.col("__from").isNull().cast("long").alias("missing_chapters"),
    )
    x = x.withColumn("__asked", F.when(F.col("missing_chapters") == 0, F.col("__asked")).otherwise(zero))
    counts = _dealt(x, tasks, span_id).groupBy(span_id).agg(*[F.sum(c).alias(c) for c in ("__asked", "verses", "rows", "omitted", "missing_chapters")])
    closed = F.col("first").isNotNull() & F.col("last").isNotNull()
    known = lambda c: F.coalesce(c, zero)
    done = _dealt(spans, tasks, span_id).join(counts, span_id, "left")
    missing = known(F.col("__asked") - F.col("verses") - F.col("omitted")).alias("missing")
    return done.select(span_id, known("verses").alias("verses"), known("rows").alias("rows"), missing, known("omitted").alias("omitted"), F.when(closed, known("__asked")).alias("distinct_asked"), known("missing_chapters").alias("missing_chapters"))


def overlaps(left: DataFrame, right: DataFrame, keys: list[str], members: str) -> DataFrame:
    """keys, common: keys of both sides (one row each) whose arrays share a member, with how many."""
    x = left.select(*keys, F.array_distinct(members).alias("__a")).join(right.select(*keys, F.array_distinct(members).alias("__b")), keys)
    return x.where(F.arrays_overlap("__a", "__b")).select(*keys, F.size(F.array_intersect("__a", "__b")).cast("long").alias("common"))


def unused_rules(rules: DataFrame, ruled: DataFrame, rule_id: str) -> DataFrame:
    """Rules that no row used."""
    return rules.join(ruled.select(rule_id).distinct(), rule_id, "left_anti")

