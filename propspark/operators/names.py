"""Entity resolution: normalised names, unique and fuzzy matches, market inference."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import pandas_udf


@pandas_udf(T.StringType())
def fold_accents(names: pd.Series) -> pd.Series:
    """Letters without their accents; what then is not ASCII goes. Spark has no built-in for it."""
    return names.map(lambda s: unicodedata.normalize("NFKD", s).encode("ascii", "ignore").decode(), na_action="ignore")


def normalize_name(name: Column | str) -> Column:
    """Lower case without accents, generational suffixes and punctuation, single spaces."""
    given = F.col(name) if isinstance(name, str) else name
    foreign = given.rlike(r"[^\x00-\x7f]")  # only these leave the JVM
    low = F.lower(F.when(foreign, fold_accents(F.when(foreign, given))).otherwise(given))
    bare = F.regexp_replace(F.regexp_replace(low, r"\b(jr|sr|ii|iii|iv)\b\.?", " "), r"[^a-z0-9 \s]", "")
    return F.trim(F.regexp_replace(bare, r"\s+", " "))


def match_unique(left: DataFrame, right: DataFrame, norm: str, id_col: str) -> DataFrame:
    """Left join on the name, only with names that belong to one id."""
    unique = right.groupBy(norm).agg(F.count_distinct(id_col).alias("_n"), F.min(id_col).alias(id_col)).where("_n = 1").drop("_n")
    return left.join(unique, norm, "left")


def within(inner: DataFrame, outer: DataFrame, n: int = 3) -> DataFrame:
    """(inner, outer): every text of `inner.t` (distinct) with the texts of `outer.t` (distinct) that contain it.

    An inverted index: an outer text is posted under each of its different n-grams, an inner one
    looks up only that of its n-grams that fewest outer texts hold; what it meets is verified.
    An inner text shorter than n has one gram, itself, under which outer texts are posted only if
    inner texts of that length exist. Empty texts are in no index.
    """
    short = [r[0] for r in inner.select(F.char_length("t").alias("l")).where(F.col("l").between(1, n - 1)).distinct().collect()]  # below n
    grams = lambda size: F.transform(F.sequence(F.lit(1), F.char_length("t") - size + 1), lambda i: F.substring(F.col("t"), i, F.lit(size)))
    none = F.array().cast("array<string>")
    of_outer = F.array_distinct(F.concat(*[F.when(F.char_length("t") >= size, grams(size)).otherwise(none) for size in (*short, n)]))
    posted = outer.select(F.col("t").alias("outer"), F.explode(of_outer).alias("gram"))
    of_inner = F.when(F.char_length("t") >= n, F.array_distinct(grams(n))).when(F.char_length("t") > 0, F.array("t")).otherwise(none)
    asked = inner.select(F.col("t").alias("inner"), F.explode(of_inner).alias("gram"))
    sizes = posted.groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no outer text holds rules its text out; it counts 0 and is the rarest
    rarest = asked.join(sizes, "gram", "left").groupBy("inner").agg(F.min_by("gram", F.struct(F.coalesce("n", F.lit(0)).alias("n"), F.col("gram").alias("g"))).alias("gram"))
    return rarest.join(posted, "gram").where(F.contains("outer", "inner")).select("inner", "outer")


def fuzzy_match(left: DataFrame, dim: DataFrame, name: str, dim_name: str, id_col: str) -> DataFrame:
    """First of equal, dim within name, name within dim; the smaller id on a tie.

    Substrings are found through an index of n-grams, so no name is held against all others.
    Rows without a match go, and so do null names; an empty name matches an empty one only.
    """
    names = left.select(F.col(name).alias("t")).where(F.col(name).isNotNull()).distinct()
    dims = dim.where(F.col(dim_name).isNotNull()).groupBy(F.col(dim_name).alias("t")).agg(F.min(id_col).alias(id_col))
    texts = dims.select("t")
    equal = names.join(texts, "t").select(F.col("t").alias("name"), F.col("t").alias("dim"), F.lit(0).alias("rank"))
    inside = within(texts, names).select(F.col("outer").alias("name"), F.col("inner").alias("dim"), F.lit(1).alias("rank"))
    around = within(names, texts).select(F.col("inner").alias("name"), F.col("outer").alias("dim"), F.lit(2).alias("rank"))
    met = equal.unionByName(inside).unionByName(around).join(dims.withColumnRenamed("t", "dim"), "dim")
    best = met.groupBy(F.col("name").alias(name)).agg(F.min_by(id_col, F.struct("rank", id_col)).alias(id_col))
    return left.join(best, name)


def infer_market(df: DataFrame, market: str, actual: str, stats: list[str]) -> DataFrame:
    """(market, stat, rate): the stat that equals the settled value most often."""
    rates = df.groupBy(market).agg(*[F.avg((F.col(actual) == F.col(s)).cast("int")).alias(s) for s in stats])
    long = rates.unpivot([market], stats, "stat", "rate")
    best = F.min_by(F.struct("stat", "rate"), F.struct((-F.col("rate")).alias("r"), "stat"))
    return long.groupBy(market).agg(best.alias("_b")).select(market, "_b.stat", "_b.rate")
