from pyspark.sql import functions as F

from loomwright.functions import text


def test_snippets_of_long_texts_with_letters_that_fold_to_two(spark):
    """Each place was looked for in all of the text, at a cost of its length squared."""
    x = spark.createDataFrame([("æ" * 3 + "a" * 150_000 + "æntire" + "b" * 20,), ("😀œ😀ent",), ("İent",), ("aæ",)], "t string")
    assert [r[0] for r in x.select(text.snippet(F.col("t"), F.lit("ent"), 2, 4)).collect()] == ["aaænti", "œ😀ent", "İent", None]
    assert x.select(text.snippet(F.col("t"), F.lit("ntire"), 2, 4)).first()[0] == "aæntir"
