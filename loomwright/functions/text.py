"""Folding of text to keys, as column expressions."""

from __future__ import annotations

from html.entities import name2codepoint

from pyspark.sql import Column
from pyspark.sql import functions as F

# Accented letters and what they fold to, one to one.
ACCENTED = "áàâäãåéèêëíìîïóòôöõúùûüñç"
PLAIN = "aaaaaaeeeeiiiiooooouuuunc"


def fold(x: Column) -> Column:
    """Lower case without accents; keeps the length."""
    return F.translate(F.lower(x), ACCENTED, PLAIN)


def key_fold(x: Column) -> Column:
    """Folded letters and digits, everything else one space."""
    return F.trim(F.regexp_replace(fold(x), "[^a-z0-9]+", " "))


def search_fold(x: Column) -> Column:
    """Folded with ligatures written out."""
    return F.replace(F.replace(F.replace(fold(x), F.lit("æ"), F.lit("ae")), F.lit("œ"), F.lit("oe")), F.lit("ß"), F.lit("ss"))


def words(x: Column) -> Column:
    return F.filter(F.split(key_fold(x), " "), lambda w: w != "")


def word_grams(x: Column, n: int = 3) -> Column:
    """Distinct runs of n words; none if there are fewer."""
    # the words are bound once as the only member of an array, else they are split again for each run
    runs = lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.size(w) - n + 1), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>"))
    return F.array_distinct(F.element_at(F.transform(F.array(words(x)), runs), 1))


def typographic(x: Column) -> Column:
    """Ligatures, apostrophes and ellipses written out, one space between words and none before a closing sign."""
    for a, b in (("ﬁ", "fi"), ("ﬂ", "fl"), ("’", "'"), ("…", "...")):
        x = F.replace(x, F.lit(a), F.lit(b))
    return F.regexp_replace(F.regexp_replace(x, r"[ \t]+([,.;:!?])", "$1"), r"[ \t]+", " ")


# Words that carry no name, and spellings that two languages write differently.
STOP_WORDS = ["the", "of", "and", "de", "la", "et", "en", "und", "der"]
DIGRAPHS = [("ae", "e"), ("oe", "e"), ("j", "i"), ("v", "u"), ("y", "i"), ("k", "c"), ("ph", "f"), ("th", "t"), ("ch", "c"), ("qu", "c"), ("h", ""), ("mm", "m"), ("ll", "l"), ("ss", "s")]


def root_keys(x: Column) -> Column:
    """The different roots of a text's words, in order of appearance: four letters after folding of pairs, numbers as #n; stop words don't count."""
    kept = F.filter(words(search_fold(x)), lambda w: ~w.isin(STOP_WORDS))

    def root(w: Column) -> Column:
        out = w
        for a, b in DIGRAPHS:
            out = F.replace(out, F.lit(a), F.lit(b))
        return F.when(w.rlike("^[0-9]+$"), F.concat(F.lit("#"), w)).otherwise(F.substring(out, 1, 4))

    return F.array_distinct(F.transform(kept, root))


def lax_equal(a: Column, b: Column) -> Column:
    """Whether two folded names have a common beginning of four letters, or of three where one has only three."""
    n = F.when((F.length(a) <= 3) | (F.length(b) <= 3), 3).otherwise(4)
    return (F.length(a) >= 3) & (F.length(b) >= 3) & (F.left(a, n) == F.left(b, n))


def squeezed(x: Column) -> Column:
    """A citation without blanks, dashes alike, its commas kept."""
    return F.lower(F.regexp_replace(F.translate(x, "–—−", "---"), r"\s+", ""))


def squeezed_dots(x: Column) -> Column:
    """A citation without blanks, dashes alike, its commas written as dots."""
    return F.translate(squeezed(x), ",", ".")


def text_key(x: Column) -> Column:
    """Folded letters, digits and single spaces."""
    return key_fold(x)


def letter_key(x: Column) -> Column:
    """Folded letters alone."""
    return F.regexp_replace(fold(x), "[^a-z]+", "")


def overlap(a: Column, b: Column, of: str = "least") -> Column:
    """Common members of two arrays of different words, as a share of the smaller (least) or the larger (greatest); null if that one is empty."""
    n = (F.least if of == "least" else F.greatest)(F.size(a), F.size(b))
    return F.when(n > 0, F.size(F.array_intersect(a, b)) / n)


def slug(x: Column, number: Column | None = None) -> Column:
    """Folded words joined by hyphens; with a number, that in three digits after them."""
    s = F.translate(key_fold(x), " ", "-")
    return s if number is None else F.concat_ws("-", s, F.lpad(number.cast("string"), 3, "0"))


#: The named character references of HTML with one character, from the standard library.
ENTITIES = {k: chr(v) for k, v in name2codepoint.items()} | {"apos": "'", "nbsp": " "}


def _decoded(x: Column) -> Column:
    """Character references decoded once, from left to right; what is no reference stays as it is."""
    pieces = F.regexp_extract_all(x, F.lit(r"(?s)(&#[0-9]{1,7};|&#[xX][0-9a-fA-F]{1,6};|&[a-zA-Z][a-zA-Z0-9]*;|[^&]+|&)"), 1)
    names = F.create_map(*[F.lit(v) for pair in ENTITIES.items() for v in pair])

    def one(p: Column) -> Column:
        number = F.when(p.rlike("^&#[0-9]+;$"), F.regexp_extract(p, "([0-9]+)", 1).cast("int")).when(p.rlike("^&#[xX]"), F.conv(F.regexp_extract(p, "[xX]([0-9a-fA-F]+)", 1), 16, 10).cast("int"))
        valid = (number > 0) & (number < 0x110000) & ~number.between(0xD800, 0xDFFF)
        # a code point by its four UTF-32 bytes
        char = F.decode(F.unhex(F.lpad(F.hex(number), 8, "0")), "UTF-32")
        named = F.try_element_at(names, F.regexp_extract(p, "^&([a-zA-Z][a-zA-Z0-9]*);$", 1))
        return F.when(valid, char).when(p.startswith("&"), F.coalesce(named, p)).otherwise(p)

    return F.when(F.contains(x, F.lit("&")), F.array_join(F.transform(pieces, one), "")).otherwise(x)


def clean_markup(x: Column) -> Column:
    """Without tags, with the known character references decoded, and white space squeezed."""
    return F.trim(F.regexp_replace(_decoded(F.regexp_replace(x, "<[^>]*>", " ")), "[ \\t\\n\\r]+", " "))


# Roman numerals by weight.
ROMAN = [(1000, "M"), (900, "CM"), (500, "D"), (400, "CD"), (100, "C"), (90, "XC"), (50, "L"), (40, "XL"), (10, "X"), (9, "IX"), (5, "V"), (4, "IV"), (1, "I")]


def to_roman(n: Column) -> Column:
    """Roman numeral of 1 to 3999."""
    parts, left = [], n
    for weight, letters in ROMAN:
        parts.append(F.repeat(F.lit(letters), F.floor(left / weight).cast("int")))
        left = left % weight
    return F.concat(*parts)


def from_roman(x: Column) -> Column:
    """Value of a Roman numeral; null if it isn't written as to_roman writes it."""
    value = lambda c: F.coalesce(*[F.when(c == r, w) for w, r in ROMAN if len(r) == 1], F.lit(0))
    letters = F.transform(F.sequence(F.lit(1), F.greatest(F.length(x), F.lit(1))), lambda i: value(F.substr(x, i, F.lit(1))))
    after = lambda i: F.coalesce(F.try_element_at(letters, i + 2), F.lit(0))
    total = F.aggregate(F.transform(letters, lambda v, i: F.when(v < after(i), -v).otherwise(v)), F.lit(0), lambda s, v: s + v)
    return F.when((total > 0) & (total < 4000) & (to_roman(total) == x), total)


def fold_places(x: Column) -> Column:
    """For each character of search_fold(x), its place (from 1) in x: ligatures take two places, signs that vanish none."""
    places = F.sequence(F.lit(1), F.length(x))
    width = lambda i: F.sequence(F.lit(1), F.length(search_fold(F.substr(x, i, F.lit(1)))))
    return F.when(F.length(x) > 0, F.flatten(F.transform(places, lambda i: F.transform(width(i), lambda _: i)))).otherwise(F.array().cast("array<int>"))


def _fold_start(x: Column, at: Column) -> Column:
    """fold_places(x)[at], with no more of the text looked at than its first `at` characters, and those one by one only where some fold to more than one."""
    head = F.left(x, at)  # no character folds to nothing
    chars = F.regexp_extract_all(head, F.lit("(?s)(.)"), 1)
    begin = F.struct(F.lit(0).alias("width"), F.lit(0).alias("n"))
    step = lambda s, c: F.when(s["width"] >= at, s).otherwise(F.struct((s["width"] + F.length(search_fold(c))).alias("width"), (s["n"] + 1).alias("n")))
    return F.when(F.length(search_fold(head)) == at, at).otherwise(F.aggregate(chars, begin, step, lambda s: s["n"]))


def snippet(x: Column, found: Column, before: int = 45, after: int = 90) -> Column:
    """The text around the first place where the folded text holds `found` (folded), cut from the unfolded text; null without one."""
    cut = lambda start: F.when(start > 0, F.substr(x, F.greatest(start - before, F.lit(1)), F.least(start - 1, F.lit(before)) + after))
    # the places are bound once as the only members of arrays, else they are worked out again for each use
    start = lambda at: F.when(at > 0, _fold_start(x, at))
    return F.element_at(F.transform(F.transform(F.array(F.instr(search_fold(x), found)), start), cut), 1)
