"""Full-text search: tokens, postings, vocabulary and BM25 over batches of questions.

Postings are an ordinary table (doc, term, tf). A question's terms are prefixes: they are matched against the
vocabulary, which is small beside the postings, and only what they match is joined with postings.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from sparkscope.functions.stemmer import plain, porter
from sparkscope.functions.text import query_terms, words
from sparkscope.operators.sizes import broadcast_if_small
from sparkscope.session import ship, written

K1, B = 1.2, 0.75
#: Inverse frequencies of terms in half of all documents or more are raised to this.
LEAST_IDF = 1e-6
#: Documents of a group that is scored at once, about, and words of a batch that all groups hold.
GROUP_DOCS, MOST_WORDS = 8192, 200_000
#: Scores this near to the k-th of a group are handed over with it, since rounding may place them before it; of equal ones
#: the first k documents.
MARGIN = 2e-9
#: Folders of a stored index, by a hash of the term: a question reads those of its terms only.
PARTS = 32


@dataclass(frozen=True)
class Index:
    """postings (doc, term, tf, part), lengths (doc, dl), vocabulary (term, df, cf)."""

    postings: DataFrame
    lengths: DataFrame
    vocabulary: DataFrame


def part_of(term: Column) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(PARTS)).cast("int")


def write_index(posted: DataFrame, dl: DataFrame, path: str, splits: int = 4) -> None:
    """Store an index under ``path``: postings in folders by a hash of the term, ``splits`` files each, sorted by term, so that
    few row groups hold a term."""
    posted.withColumn("part", part_of(F.col("term"))).repartition(PARTS * splits, "part", F.pmod(F.xxhash64("doc"), F.lit(splits))).sortWithinPartitions("part", "term").write.partitionBy("part").parquet(f"{path}/postings")
    dl.write.parquet(f"{path}/lengths")
    vocabulary(posted.sparkSession.read.parquet(f"{path}/postings")).write.parquet(f"{path}/vocabulary")


def read_index(spark: SparkSession, path: str) -> Index:
    return Index(*[spark.read.parquet(f"{path}/{n}") for n in ("postings", "lengths", "vocabulary")])


def tokens(docs: DataFrame, doc: str, text: Column, by: Column | None = None) -> DataFrame:
    """(doc, term): one row for each token; ``by`` replaces the plain tokenizer by another array of terms."""
    return docs.select(F.col(doc).alias("doc"), F.explode(words(text) if by is None else by).alias("term"))


def postings(docs: DataFrame, doc: str, text: Column, by: Column | None = None) -> DataFrame:
    """(doc, term, tf)."""
    return tokens(docs, doc, text, by).groupBy("doc", "term").agg(F.count("*").alias("tf"))


def lengths(docs: DataFrame, doc: str, text: Column) -> DataFrame:
    """(doc, dl): tokens of each document, also of those without any."""
    return docs.select(F.col(doc).alias("doc"), F.size(words(text)).cast("long").alias("dl"))


def vocabulary(posted: DataFrame) -> DataFrame:
    """(term, df, cf)."""
    return posted.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


def stems(vocab: DataFrame) -> DataFrame:
    """``vocab`` with ``stem``: lower-cased, without diacritics, stemmed. Runs once for each distinct term."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            yield batch.assign(stem=[porter(plain(t)) for t in batch["term"]])

    ship(vocab.sparkSession)
    return vocab.select("term").mapInPandas(run, "term string, stem string")


def stemmed(posted: DataFrame) -> DataFrame:
    """Postings with stems as their terms. The vocabulary is stemmed, not the postings."""
    table = stems(posted.select("term").distinct())
    return posted.join(table, "term").groupBy("doc", F.col("stem").alias("term")).agg(F.sum("tf").alias("tf"))


def expand(questions: DataFrame, vocab: DataFrame, prefix: bool = True, stem: bool = False) -> DataFrame:
    """(query_id, q, n, term): the vocabulary terms that each question's terms stand for. Repeated terms count once each.

    Terms are cut to the lengths that occur in the questions, so prefixes meet the vocabulary by equality.
    """
    asked = questions.select("query_id", F.posexplode(F.transform(query_terms(F.col("text")), F.lower)).alias("n", "q"))
    if stem:
        asked = asked.join(stems(asked.select(F.col("q").alias("term")).distinct()).withColumnRenamed("term", "q"), "q").select("query_id", "n", F.col("stem").alias("q"))
    if not prefix:
        return asked.join(vocab.select(F.col("term").alias("q")), "q").select("query_id", "q", "n", F.col("q").alias("term"))
    sizes = asked.agg(F.collect_set(F.length("q")).alias("_sizes"))  # one row: the lengths of the questions' words
    cut = F.transform(F.filter("_sizes", lambda n: n <= F.length("term")), lambda n: F.substr("term", F.lit(1), n))
    keyed = vocab.select("term").join(F.broadcast(sizes)).select("term", F.explode(cut).alias("q"))
    return asked.join(keyed, "q").select("query_id", "q", "n", "term")


def rarity(docs: Column, df: Column) -> Column:
    return F.greatest(F.log((docs - df + 0.5) / (df + 0.5)), F.lit(LEAST_IDF))


def bm25(questions: DataFrame, posted: DataFrame, dl: DataFrame, prefix: bool = False, stem: bool = False, vocab: DataFrame | None = None) -> DataFrame:
    """(query_id, doc, score); lower is better, rows with a match only.

    score = -sum over terms of idf * tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl)), with
    idf = ln((N - n + 0.5) / (n + 0.5)); a prefix's tf counts all tokens that start so, its n the documents with any.
    Of stored postings only the folders of the wanted terms are read.
    """
    wanted = expand(questions, posted.select("term").distinct() if vocab is None else vocab, prefix, stem)
    keys = ["term"]
    if "part" in posted.columns:
        wanted, keys = wanted.withColumn("part", part_of(F.col("term"))), ["part", "term"]
    matched = wanted.join(posted, keys).groupBy("query_id", "n", "doc").agg(F.sum("tf").alias("tf"))
    found = matched.groupBy("query_id", "n").agg(F.count("*").alias("df"))
    stats = dl.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl"))
    scored = matched.join(found, ["query_id", "n"]).join(dl, "doc").join(F.broadcast(stats))  # one row
    part = rarity(F.col("docs"), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.col("avgdl")))
    return scored.groupBy("query_id", "doc").agg((-F.sum(part)).alias("score"))


def top(scored: DataFrame, k: int, by: list[Column], key: str = "query_id") -> DataFrame:
    """The first ``k`` rows of each key in the order ``by``, with ``rank`` from 0. Cut before the shuffle as well."""
    order = Window.partitionBy(key).orderBy(*by)
    return scored.withColumn("rank", F.row_number().over(order) - 1).filter(F.col("rank") < k)


def leading(total: np.ndarray, k: int) -> np.ndarray:
    """Where the highest ``k`` sums are, with those within ``MARGIN`` of the k-th, of equal ones the first k; zeros do not count."""
    hit = np.flatnonzero(total)
    if len(hit) > k:
        hit = hit[total[hit] >= np.partition(total[hit], len(hit) - k)[len(hit) - k] - MARGIN]
        hit = hit[np.argsort(total[hit], kind="stable")]
        place = np.arange(len(hit))
        hit = hit[place - np.maximum.accumulate(np.where(np.diff(total[hit], prepend=-1) != 0, place, 0)) < k]
    return hit


def best(questions: DataFrame, index: Index, k: int, prefix: bool = False, stem: bool = False) -> DataFrame:
    """(query_id, doc, score) of the first ``k`` documents of each question, by the score rounded to nine digits and then the
    document: the rows of ``bm25``, cut by ``top``.

    Each different word of the batch meets its postings once, whatever the number of questions that ask it. Documents are
    dealt by hash over groups of about ``GROUP_DOCS``; a group's scores are summed in arrays, and k rows for each question
    leave it. With ``stem`` the words' stems are matched with those of the vocabulary, so plain postings do. A batch of more than
    ``MOST_WORDS`` words is scored by joins.
    """
    spark, vocab, order = questions.sparkSession, index.vocabulary, [F.round("score", 9), F.col("doc")]
    known = written(stems(vocab), "stems") if stem else vocab.select("term")
    wanted = written(expand(questions, known.select(F.col("stem").alias("term")).distinct() if stem else known, prefix, stem), "wanted")
    pairs = wanted.select("q", "term").distinct()
    if stem:
        pairs = pairs.withColumnRenamed("term", "stem").join(known, "stem").select("q", "term")
    pairs = written(pairs.withColumn("part", part_of(F.col("term"))), "pairs")
    matched = index.postings.join(broadcast_if_small(pairs), ["part", "term"]).filter("doc IS NOT NULL").select("q", "doc", "tf")
    if prefix or stem:
        matched = written(matched.groupBy("q", "doc").agg(F.sum("tf").alias("tf")), "matched")
    found = matched.groupBy("q").agg(F.count("*").alias("df"))
    stats = index.lengths.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")).first()
    asked = wanted.select("query_id", "n", "q").distinct()
    if asked.count() > MOST_WORDS:
        rows = asked.join(matched, "q").join(found, "q").join(index.lengths, "doc")
        part = rarity(F.lit(stats["docs"]), F.col("df")) * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("dl") / F.lit(stats["avgdl"])))
        return top(rows.groupBy("query_id", "doc").agg((-F.sum(part)).alias("score")), k, order).drop("rank")
    idf = {r["q"]: r["idf"] for r in found.select("q", rarity(F.lit(stats["docs"]), F.col("df")).alias("idf")).collect()}
    number = {q: i for i, q in enumerate(sorted(idf))}
    batch: dict = {}
    for r in asked.collect():
        if r["q"] in number:
            batch.setdefault(r["query_id"], []).append(number[r["q"]])
    shared = spark.sparkContext.broadcast((list(batch.items()), np.array([idf[q] for q in sorted(idf)])))
    avgdl = stats["avgdl"]
    kinds = dict(wanted.dtypes)["query_id"], dict(matched.dtypes)["doc"]

    def score(rows: pa.Table, sizes: pa.Table) -> pa.Table:
        asks, weight = shared.value
        ids, dl = sizes["doc"].to_numpy(), sizes["dl"].to_numpy()
        turn = np.argsort(ids, kind="stable")
        docs, first, times = np.unique(ids[turn], return_index=True, return_counts=True)
        dl = dl[turn]
        at, q, tf = np.searchsorted(docs, rows["doc"].to_numpy()), rows["q"].to_numpy(), rows["tf"].to_numpy().astype(float)
        # A repeated id has several lengths, and its postings count with each.
        n = times[at]
        row = np.repeat(np.arange(len(at)), n)
        slot = first[at][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
        share = weight[q] * np.bincount(row, tf[row] * (K1 + 1) / (tf[row] + K1 * (1 - B + B * dl[slot] / avgdl)), len(at))
        turn = np.argsort(q, kind="stable")
        at, share, cut = at[turn], share[turn], np.searchsorted(q[turn], np.arange(len(weight) + 1))
        out = []
        for query_id, terms in asks:
            total = np.zeros(len(docs))
            for t in terms:
                total[at[cut[t] : cut[t + 1]]] += share[cut[t] : cut[t + 1]]
            hit = leading(total, k)
            out.append((np.full(len(hit), query_id), docs[hit], -total[hit]))
        names = ["query_id", "doc", "score"]
        return pa.table([np.concatenate(x) for x in zip(*out)], names) if out else pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], names)

    ship(spark)
    groups = max(1, -(-stats["docs"] // GROUP_DOCS))
    group = F.pmod(F.xxhash64("doc"), F.lit(groups)).alias("_group")
    numbers = F.broadcast(spark.createDataFrame(list(number.items()), "_q string, q int"))
    left = matched.withColumnRenamed("q", "_q").join(numbers, "_q").select(group, "doc", "q", "tf")
    right = index.lengths.filter("doc IS NOT NULL").select(group, "doc", "dl")
    scored = left.groupBy("_group").cogroup(right.groupBy("_group")).applyInArrow(score, f"query_id {kinds[0]}, doc {kinds[1]}, score double")
    return top(scored, k, order).drop("rank")


def snippets(rows: DataFrame, doc: str, text: Column, terms: Column, width: int = 12) -> DataFrame:
    """(doc, snippet): of each row's text the first window of ``width`` words with most hits, hits in brackets.

    A hit is a word that starts with one of ``terms``. An approximation of an engine's snippets, meant for the few
    rows that are shown; repeated ids are one text. Texts of different ids are cut where they lie, as arrays; only repeated
    ids become rows of words, which meet in a shuffle.
    """
    told = rows.select(F.col(doc).alias("doc"), terms.alias("_terms"), F.split(F.coalesce(text, F.lit("")), r"\s+").alias("_words"))
    again = written(rows.groupBy(F.col(doc).alias("_again")).count().filter("count > 1").select("_again"), "repeated")
    if again.isEmpty():
        return _windows(told, width)
    repeated, same = broadcast_if_small(again), F.col("doc").eqNullSafe(F.col("_again"))
    return _windows(told.join(repeated, same, "left_anti"), width).unionByName(_windows_of_ids(told.join(repeated, same, "left_semi"), width))


def _windows(told: DataFrame, width: int) -> DataFrame:
    """(doc, snippet) of (doc, _terms, _words), a row each."""
    # What a lambda uses is used outside of it as well, so that it stays a column that is worked out once a row.
    starts = F.transform("_words", lambda w: F.exists("_terms", lambda t: F.lower(w).startswith(F.lower(t))))
    cut = told.withColumn("_hit", F.when(F.size("_terms") > 0, starts).otherwise(F.array_repeat(F.lit(False), F.size("_words"))))
    # A window has more hits than all before it only if it ends with one.
    ends = F.filter(F.transform("_hit", lambda h, i: F.when(h, i)), lambda i: i >= width)
    windows = F.concat(F.array(F.lit(0)), F.transform(ends, lambda i: i - width + 1))
    counted = F.transform(windows, lambda i: F.struct((-F.size(F.filter(F.slice("_hit", i + 1, F.lit(width)), lambda h: h))).alias("minus"), i.alias("at")))
    cut = cut.withColumn("_start", F.array_min(counted)["at"])
    shown = F.zip_with(F.slice("_words", F.col("_start") + 1, F.lit(width)), F.slice("_hit", F.col("_start") + 1, F.lit(width)), lambda w, h: F.when(h, F.concat(F.lit("["), w, F.lit("]"))).otherwise(w))
    return cut.select("doc", F.concat(F.when(F.col("_start") > 0, "...").otherwise(""), F.array_join(shown, " "), F.when(F.col("_start") + width < F.size("_words"), "...").otherwise("")).alias("snippet"))


def _windows_of_ids(told: DataFrame, width: int) -> DataFrame:
    """(doc, snippet) of (doc, _terms, _words) with rows of one id as one text."""
    # The terms are worked out below the explode, once for each row.
    cut = told.select("doc", "_terms", F.posexplode("_words").alias("at", "word"))
    cut = cut.withColumn("hit", F.exists("_terms", lambda t: F.lower("word").startswith(F.lower(t)))).drop("_terms")
    order = Window.partitionBy("doc").orderBy("at")
    counted = cut.withColumn("hits", F.sum(F.col("hit").cast("int")).over(order.rowsBetween(0, width - 1)))
    last = F.max("at").over(Window.partitionBy("doc"))
    full = counted.withColumns({"_last": last}).withColumn("_start", F.min(F.when((F.col("at") == 0) | (F.col("at") <= F.col("_last") - width + 1), F.struct((-F.col("hits")).alias("minus"), "at"))).over(Window.partitionBy("doc"))["at"])
    shown = full.filter((F.col("at") >= F.col("_start")) & (F.col("at") < F.col("_start") + width))
    word = F.when(F.col("hit"), F.concat(F.lit("["), "word", F.lit("]"))).otherwise(F.col("word"))
    joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("at", word.alias("w")))), lambda x: x["w"]), " ")
    grouped = shown.groupBy("doc", "_start", "_last").agg(joined.alias("s"))
    return grouped.select("doc", F.concat(F.when(F.col("_start") > 0, "...").otherwise(""), "s", F.when(F.col("_start") + width <= F.col("_last"), "...").otherwise("")).alias("snippet"))
