"""How the filters of a corpus interact: which documents each removes, in every order of the filters.

Every document fails some of five filters: a mask of five bits. Per part and label, 32 sums of signs (the parity of the
mask's bits that an index picks) are aggregated, a Walsh-Hadamard transform of the histogram of masks. It is inverted
exactly, and all orders, steps and Shapley values are read off the 32 cells, without another look at documents.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sparkscope.llm import common

FILTERS = "ABCDE"
MASKS = 1 << len(FILTERS)
ORDERS = ["".join(p) for p in permutations(FILTERS)]
#: Bit of the filter that looks at other documents.
COPY = 1 << FILTERS.index("E")
SPACE = "\\x09-\\x0D "
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def text_mask(text: Column) -> Column:
    """The bits of the filters that a text fails by itself (null: empty). Words are what white space of ASCII parts.

    A: under 200 words. B: fewer than half of the words are different. C: over 2 % of the characters are A to Z.
    D: a character of ``#$%&*|``.
    """
    inner = F.regexp_replace(text, f"^[{SPACE}]+|[{SPACE}]+$", "")
    words = F.when(inner == "", F.array().cast("array<string>")).otherwise(F.split(inner, f"[{SPACE}]+"))
    upper = F.length(text) - F.length(F.translate(text, UPPER, ""))
    counts = F.struct(F.size(words).alias("words"), F.size(F.array_distinct(words)).alias("different"))
    fails = [counts["words"] < 200, counts["different"] * 100 < counts["words"] * 50, upper * 100 > F.length(text) * 2, text.rlike("[#$%&*|]")]
    mask = F.lit(0)
    for i, f in enumerate(fails):
        mask = mask + F.when(f, 1 << i).otherwise(0)
    return mask


def masks(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """(part, mask, good, toxic, n): how many documents of a part and of given labels fail exactly the filters of a mask.

    E fails where the text is that of a document with a smaller id. A null part is the empty string; null ids are no
    copies of any document, and none of theirs; of repeated rows with one id none is a copy for the other's sake. A
    document is good or toxic if any label of its id says so; null labels say nothing. Texts are compared by
    their SHA-256 and length. Other columns of both tables are not read.

    Rows meet as (digest, id), with equal rows counted first, so neither copies nor a part make one large group.
    """
    text = F.coalesce(docs[text_col], F.lit(""))
    rows = docs.select(docs[id_col].alias("id"), F.coalesce(docs[part_col].cast("string"), F.lit("")).alias("part"), text.alias("text"))
    facts = rows.select("id", "part", text_mask(F.col("text")).alias("mask"), F.unhex(F.sha2("text", 256)).alias("digest"), F.octet_length("text").alias("size"))
    keys = ["digest", "size"]
    facts = common.materialise(facts.groupBy("id", "part", "mask", *keys).agg(F.count("*").alias("n")), "failures")
    first = facts.filter("id IS NOT NULL").groupBy(*keys).agg(F.min("id").alias("id")).withColumn("_first", F.lit(True))
    said = labels.groupBy(labels["doc_id"].alias("id")).agg(F.max(F.coalesce(labels["quality"] == 1, F.lit(False))).alias("good"), F.max(F.coalesce(labels["toxic"] == 1, F.lit(False))).alias("toxic"))
    known = facts.join(first, ["id", *keys], "left").join(said, "id", "left")
    copy = F.col("id").isNotNull() & F.col("_first").isNull()
    no = F.lit(False)
    return known.select("part", (F.col("mask") + F.when(copy, COPY).otherwise(0)).alias("mask"), F.coalesce("good", no).alias("good"), F.coalesce("toxic", no).alias("toxic"), "n")


def _sign(mask: Column, index) -> Column:
    return 1 - 2 * (F.bit_count(mask.bitwiseAND(index)) % 2)


def parities(found: DataFrame) -> DataFrame:
    """(part, good, toxic, sums): the 32 signed sums of the documents' masks; a partial aggregate before the shuffle."""
    n = F.col("n")
    sums = [F.sum(_sign(F.col("mask"), w) * n).alias(f"_w{w}") for w in range(MASKS)]
    return found.groupBy("part", "good", "toxic").agg(*sums).select("part", "good", "toxic", F.array(*[f"_w{w}" for w in range(MASKS)]).alias("sums"))


def _each(function) -> Column:
    """The array of ``function`` of 0 to 31."""
    return F.transform(F.sequence(F.lit(0), F.lit(MASKS - 1)), function)


def cells(sums: Column) -> Column:
    """Documents by mask from the signed sums: the transform again, divided by 32 without a rest."""

    def one(mask: Column) -> Column:
        signed = _each(lambda w: F.get(sums, w) * _sign(mask, w))
        return F.aggregate(signed, F.lit(0).cast("long"), lambda s, x: s + x)

    return _each(lambda m: F.shiftright(one(m), len(FILTERS)))


def histograms(found: DataFrame) -> DataFrame:
    """(part, every, good, toxic): documents by mask, of all labels, of good ones and of toxic ones."""
    of = parities(found).withColumn("cells", cells(F.col("sums")))
    total = lambda when: [F.sum(F.when(when, F.get("cells", F.lit(m))).otherwise(0)) for m in range(MASKS)]
    return of.groupBy("part").agg(F.array(*total(F.lit(True))).alias("every"), F.array(*total(F.col("good"))).alias("good"), F.array(*total(F.col("toxic"))).alias("toxic"))


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """One row for each part, order of the filters (``filter_order``) and step (1 to 5): kept after the step, removed
    in it, redundant (fail its filter, removed earlier), unique_fails (fail no other), good_lost and toxic_lost (removed
    here), and shapley: what its filter removes, summed over all orders at any step.

    A document that fails c filters is removed by each of them in 120 / c orders. Parts without documents have no
    rows, and an empty table has none. See ``masks`` for nulls, repeated rows and labels.
    """
    of = histograms(masks(docs, labels, id_col, text_col, part_col))
    of = of.select("*", F.explode(F.array(*map(F.lit, ORDERS))).alias("filter_order"))
    of = of.select("*", F.posexplode(F.split("filter_order", "")).alias("_step", "_letter"))
    bits = F.array(*[F.lit(1 << i) for i in range(len(FILTERS))])
    bit_of = lambda letter: F.element_at(bits, F.instr(F.lit(FILTERS), letter))
    before = F.aggregate(F.split(F.substr("filter_order", F.lit(1), F.col("_step")), ""), F.lit(0), lambda s, x: s + F.when(x == "", 0).otherwise(bit_of(x)))
    of = of.withColumns({"_bit": bit_of(F.col("_letter")), "_before": before})
    bit, before = F.col("_bit"), F.col("_before")

    def total(cell: str, when, weight=lambda m: F.lit(1)) -> Column:
        return F.aggregate(_each(lambda m: F.when(when(m), F.get(cell, m) * weight(m)).otherwise(0)), F.lit(0).cast("long"), lambda s, x: s + x)

    hit = lambda m: m.bitwiseAND(bit) != 0
    fresh = lambda m: m.bitwiseAND(before) == 0
    removed = lambda m: hit(m) & fresh(m)
    share = lambda m: F.lit(len(ORDERS)) / F.bit_count(m)
    return of.select(
        "part", "filter_order", (F.col("_step") + 1).cast("int").alias("step"),
        total("every", lambda m: m.bitwiseAND(before.bitwiseOR(bit)) == 0).alias("kept"), total("every", removed).alias("removed"),
        total("every", lambda m: hit(m) & ~fresh(m)).alias("redundant"), total("every", lambda m: m == bit).alias("unique_fails"),
        total("good", removed).alias("good_lost"), total("toxic", removed).alias("toxic_lost"),
        total("every", hit, lambda m: share(m).cast("long")).alias("shapley"),
    )
