"""Which names hold a token, without regard to ASCII case: a stored index of three-character grams over different names.

Posting lists of a token's grams are intersected from the rarest, and what is left is verified on the name. Tokens of
``WINDOW`` characters and more go by longer runs, which names are cut into when asked. All joins are on equality,
whatever the numbers of names and tokens.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkscope.functions.text import fold
from sparkscope.operators.sizes import broadcast_if_small
from sparkscope.session import written

GRAM = 3
#: Characters from which a token is looked up by runs of so many characters.
WINDOW = 8
#: Lists of a token that are intersected before names are looked at.
DEPTH = 2
#: Folders of stored lists, by a hash of the gram.
PARTS = 16
#: Stands after a name's end, so that its last characters begin grams as well and shorter tokens are prefixes of grams.
END = "\0"


@dataclass(frozen=True)
class Names:
    """names (name_id, name), lists (gram, name_id, part), counts (gram, n): names are folded and different."""

    names: DataFrame
    lists: DataFrame
    counts: DataFrame


def part_of(gram: Column) -> Column:
    return F.pmod(F.xxhash64(gram), F.lit(PARTS)).cast("int")


def different(*tables: tuple[DataFrame, list[str]]) -> DataFrame:
    """(name_id, name) of the different names in columns of tables; nulls and empty names are none."""
    every = [t.select(F.explode(F.array(*[fold(F.coalesce(F.col(c), F.lit(""))) for c in columns])).alias("name")) for t, columns in tables]
    names = reduce(DataFrame.unionByName, every).filter("name <> ''").distinct()
    return names.select(F.xxhash64("name").alias("name_id"), "name")


def lists(names: DataFrame) -> DataFrame:
    """(gram, name_id, part)."""
    full = F.concat("name", F.lit(END * (GRAM - 1)))
    cut = F.transform(F.sequence(F.lit(1), F.length("name")), lambda i: F.substr(full, i, F.lit(GRAM)))
    return names.select(F.explode(F.array_distinct(cut)).alias("gram"), "name_id").withColumn("part", part_of(F.col("gram")))


def counts(found: DataFrame) -> DataFrame:
    return found.groupBy("gram").agg(F.count("*").alias("n"))


def index(names: DataFrame) -> Names:
    """An index that is worked out with each question; ``write`` one for more."""
    found = lists(names)
    return Names(names, found, counts(found))


def write(names: DataFrame, path: str) -> None:
    spark = names.sparkSession
    names.write.parquet(f"{path}/names")
    found = lists(spark.read.parquet(f"{path}/names"))
    found.repartition("part", F.pmod("name_id", F.lit(4))).sortWithinPartitions("part", "gram").write.partitionBy("part").parquet(f"{path}/lists")
    counts(spark.read.parquet(f"{path}/lists")).write.parquet(f"{path}/counts")


def read(spark: SparkSession, path: str) -> Names:
    return Names(*[spark.read.parquet(f"{path}/{n}") for n in ("names", "lists", "counts")])


def both(a: Names, b: Names) -> Names:
    """One index of two; names of both lie in it twice, which ``lookup`` allows for."""
    return Names(a.names.unionByName(b.names), a.lists.unionByName(b.lists), a.counts.unionByName(b.counts))


def windows(text: str, size: int) -> Column:
    """The different runs of ``size`` characters of a column; none of a shorter text."""
    cut = F.transform(F.sequence(F.lit(1), F.length(text) - size + 1), lambda i: F.substr(F.col(text), i, F.lit(size)))
    return F.when(F.length(text) >= size, F.array_distinct(cut))


def by_windows(asked: DataFrame, names: DataFrame) -> DataFrame:
    """(token, name) of the names that hold each of ``asked`` (token, _t), of ``WINDOW`` characters at least: names with the
    rarest of a token's runs of ``WINDOW`` characters are looked at.

    A run of three is in so many names that with as many tokens as names all pairs would be looked at. Longer ones are not
    stored: names are cut as they are read, and only runs that are asked for are counted.
    """
    asked = written(asked.select("token", "_t", F.explode(windows("_t", WINDOW)).alias("_run")), "runs")
    cut = names.select("name", F.explode(windows("name", WINDOW)).alias("_run"))
    counted = cut.join(broadcast_if_small(asked.select("_run").distinct()), "_run").groupBy("_run").agg(F.count("*").alias("n"))
    order = Window.partitionBy("token").orderBy("n", "_run")
    # A token with a run that no name has is in none.
    all_met = asked.join(counted, "_run", "left").withColumn("_least", F.min(F.coalesce("n", F.lit(0))).over(Window.partitionBy("token"))).filter("_least > 0")
    rarest = written(all_met.withColumn("_rank", F.row_number().over(order)).filter("_rank = 1").select("token", "_t", "_run"), "rarest")
    return cut.join(broadcast_if_small(rarest), "_run").filter(F.contains("name", "_t")).select("token", "name")


def lookup(tokens: DataFrame, known: Names) -> DataFrame:
    """(token, name): the folded names that hold each ``token``. Null and empty tokens find nothing."""
    asked = tokens.select("token", fold(F.col("token")).alias("_t")).filter("_t <> ''").distinct()
    size = F.length("_t")
    whole, asked = by_windows(asked.filter(size >= WINDOW), known.names), asked.filter(size < WINDOW)
    # Several segments of an index may count a gram; rarity orders lists and decides nothing else.
    rarity = known.counts.groupBy("gram").agg(F.sum("n").alias("n"))
    long = asked.filter(size >= GRAM).select("*", F.explode(F.array_distinct(F.transform(F.sequence(F.lit(1), size - GRAM + 1), lambda i: F.substr("_t", i, F.lit(GRAM))))).alias("gram"))
    order = Window.partitionBy("token").orderBy(F.coalesce("n", F.lit(0)), "gram")
    ranked = long.join(rarity, "gram", "left").select("token", "_t", "gram", F.row_number().over(order).alias("_rank")).filter(F.col("_rank") <= DEPTH)
    # Shorter tokens begin grams: all lists of these.
    begins = rarity.select("gram", F.explode(F.array(*[F.substring("gram", 1, n) for n in range(1, GRAM)])).alias("_t"))
    short = asked.filter(size < GRAM).join(begins, "_t").select("token", "_t", "gram", F.lit(0).alias("_rank")).distinct()
    # The grams are stored, so that Spark knows how few they are, and lists need not be shuffled to meet them.
    ranked = written(ranked.unionByName(short).withColumn("part", part_of(F.col("gram"))), "grams")
    found = known.lists.join(broadcast_if_small(ranked.filter("_rank = 1")), ["part", "gram"]).select("token", "_t", "name_id")
    for rank in range(2, DEPTH + 1):
        more = ranked.filter(F.col("_rank") == rank).select("token", "gram", "part")
        some = known.lists.join(broadcast_if_small(more.select("part", "gram").distinct()), ["part", "gram"], "left_semi")
        both = found.join(broadcast_if_small(more), "token").join(some, ["part", "gram", "name_id"], "left_semi").select(found.columns)
        found = both.unionByName(found.join(broadcast_if_small(more), "token", "left_anti"))
    found = found.unionByName(known.lists.join(broadcast_if_small(ranked.filter("_rank = 0")), ["part", "gram"]).select("token", "_t", "name_id").distinct())
    return found.join(known.names, "name_id").filter(F.contains("name", "_t")).select("token", "name").unionByName(whole).distinct()


def holding(rows: DataFrame, columns: list[str], hits: DataFrame) -> DataFrame:
    """``rows`` with ``token`` of each of ``hits`` (token, name) that one of ``columns`` holds; once for each such column."""
    names = F.array_distinct(F.array(*[fold(F.coalesce(F.col(c), F.lit(""))) for c in columns]))
    met = rows.withColumn("_name", F.explode(names)).join(broadcast_if_small(hits.select("token", F.col("name").alias("_name"))), "_name")
    return met.drop("_name")
