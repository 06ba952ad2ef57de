"""Files as tables and tables as files: rule tables with comments, vocabularies, JSON documents, signatures."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def read_rules(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """A CSV with a header; lines that begin with # are comments."""
    return spark.read.schema(schema).csv(path, header=True, comment="#", enforceSchema=False)


def read_vocabulary_lines(spark: SparkSession, path: str, schema: str, key: str, vocabulary: DataFrame) -> DataFrame:
    """Rows of a tab-separated file without header whose key is in the vocabulary."""
    return spark.read.schema(schema).csv(path, sep="\t").join(vocabulary.select(key).distinct(), key, "left_semi")


def read_documents(spark: SparkSession, path: str, schema: str, one_a_line: bool = False) -> DataFrame:
    """JSON files, a document or an array of documents each, however many lines they take, or a document a line; what doesn't parse is an error."""
    return spark.read.schema(schema).json(path, multiLine=not one_a_line, mode="FAILFAST")


def write_documents(df: DataFrame, path: str) -> None:
    """A JSON document a line, columns in their order, nulls left out."""
    df.write.mode("overwrite").json(path)


def public_columns(df: DataFrame) -> DataFrame:
    """df without columns whose names begin with an underscore."""
    return df.select(*[c for c in df.columns if not c.startswith("_")])


def strings_in(document: Column) -> Column:
    """All string leaves of a flat JSON object with their names: array<struct<path, value>>, ordered by name."""
    pairs = F.map_entries(F.from_json(document, "map<string,string>"))
    return F.array_sort(F.transform(pairs, lambda e: F.struct(e["key"].alias("path"), e["value"].alias("value"))))


def json_get(document: Column, path: str, kind: str) -> Column:
    """The value at a path ("$.a.b"), cast to kind; null where the document, the path or the cast fails."""
    return F.get_json_object(document, path).try_cast(kind)


def signature(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row (rows, sign): two sums over digests of the rows, the same in whatever order and partitions they come.

    Every value stands with its length, a null without one, so that no two different rows read alike.
    """
    value = lambda c: F.coalesce(F.concat(F.octet_length(c).cast("string"), F.lit(":"), c), F.lit("-"))
    digest = F.md5(F.concat_ws(",", *[value(F.col(c).cast("string")) for c in columns]).cast("binary"))
    part = lambda at: F.coalesce(F.sum(F.conv(F.substring(digest, at, 15), 16, 10).cast("decimal(20,0)")), F.lit(0)).cast("string")
    return df.agg(F.count(F.lit(1)).alias("rows"), F.concat(part(1), F.lit("."), part(16)).alias("sign"))


def _brackets(document: Column) -> Column:
    """The brackets of a JSON text outside its strings, < for what opens and > for what closes; null for null."""
    return F.translate(F.regexp_replace(document, r'"[^"\\]*+(?:\\.[^"\\]*+)*+"|[^"\[\]{}]++|"', ""), "[{]}", "<<>>")


def _depth(brackets: Column) -> Column:
    step = lambda s, c: F.struct((s["now"] + F.when(c == "<", 1).when(c == ">", -1).otherwise(0)).alias("now"), F.greatest(s["most"], s["now"] + F.when(c == "<", 1).otherwise(0)).alias("most"))
    return F.coalesce(F.aggregate(F.split(brackets, ""), F.struct(F.lit(0).alias("now"), F.lit(0).alias("most")), step, lambda s: s["most"]), F.lit(0))


def json_depth(document: Column) -> Column:
    """How deep arrays and objects are nested in a JSON text; 0 for null and plain values. Brackets inside strings don't count."""
    return _depth(_brackets(document))


def json_leaves(df: DataFrame, keys: list[str], document: str, path: str = "path", value: str = "value", deepest: int | None = None) -> DataFrame:
    """keys, path, value: every string anywhere in a JSON column, values and not names, with its path ("$.a[0]."b c"").

    Names that are not plain words stand in double quotes. Each level of the
    deepest document is one explode of a VARIANT on the map side; leaves that
    lie higher pass through, so nothing is shuffled and there is no limit of
    depth but Spark's own. Null and malformed documents and ones without
    strings give no rows; a document that is itself a string has the path "$".
    Of a name that an object has twice, the document counts as malformed.
    deepest: how deep the documents are, where the caller knows it; strings
    below that are an error. None: all documents are made and looked at once
    more to find it.
    """
    known = deepest is not None
    if not known:  # most documents have their brackets in common with others
        deepest = df.select(_brackets(F.col(document)).alias("b")).distinct().agg(F.max(_depth(F.col("b")))).first()[0] or 0
    x = df.select(*keys, F.lit("$").alias("__path"), F.try_parse_json(F.col(document)).alias("__value"))
    for _ in range(deepest):
        # what holds nothing, leaves and empty objects and arrays, comes back as one row with null pos
        parts = df.sparkSession.tvf.variant_explode_outer(F.col("__value").outer()).toDF("__pos", "__name", "__part")
        plain = F.when(F.col("__name").rlike(r"^[A-Za-z0-9_]+$"), F.col("__name")).otherwise(F.concat(F.lit('"'), F.col("__name"), F.lit('"')))
        step = F.when(F.col("__name").isNotNull(), F.concat(F.lit("."), plain)).otherwise(F.concat(F.lit("["), F.col("__pos").cast("string"), F.lit("]")))
        inner = F.col("__pos").isNotNull()
        x = x.lateralJoin(parts).select(*keys, F.when(inner, F.concat("__path", step)).otherwise(F.col("__path")).alias("__path"), F.when(inner, F.col("__part")).otherwise(F.col("__value")).alias("__value"))
    # only now, when no value holds others: the schema of a whole tree is far more work than the tree
    kind = F.schema_of_variant("__value")
    is_string = kind == "STRING"
    if known:
        holds = (kind.startswith("OBJECT<") & (kind != "OBJECT<>")) | (kind.startswith("ARRAY<") & (kind != "ARRAY<VOID>"))
        is_string = F.when(is_string, True).when(holds, F.raise_error(F.lit(f"a document is deeper than {deepest}")).cast("boolean")).otherwise(False)
    strings = x.where(is_string)
    return strings.select(*keys, F.col("__path").alias(path), F.col("__value").cast("string").alias(value))
