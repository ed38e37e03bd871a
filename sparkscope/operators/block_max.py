"""The best documents of BM25 without scoring all that match: postings in blocks, each with its largest contribution.

Documents are dealt by hash over groups; the documents of a group, in the order of their length, form blocks. A row of the
stored table is a term's postings in one block, with the most that any document of it adds to a score (without the term's
rarity). A question adds these up by block. In each group the blocks with the highest sums are scored first; of the others,
only those whose sum reaches the k-th best score so far can hold a better document and are scored too. The rest is skipped,
and the result is that of scoring everything.

Texts go through one shuffle, to their groups, where words are counted and postings gathered; a batch of questions meets the
postings of its words in one more, and k rows for each question leave a group. Nothing is multiplied by the questions.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkscope.functions.text import words
from sparkscope.operators import lexical
from sparkscope.session import ship, written

#: Documents of a block, at most; those with one id are one.
BLOCK_DOCS = 128
#: Documents and words of a group, about: this many to twice as many of what there is more of.
GROUP_DOCS, GROUP_WORDS = 4096, 2_000_000
#: Blocks of each question and group that are scored before the others are judged.
FIRST = 8
#: Above half the ninth digit, to which scores are rounded, and what sums of doubles in another order differ by.
MARGIN = 2e-9
#: Words of a batch that all groups hold; more questions are asked in several batches.
MOST_WORDS = 200_000
#: Different words up to which a search names them to the scan, whose files are sorted by term.
NAMED_TERMS = 1000


@dataclass(frozen=True)
class Blocks:
    """entries (term, block, n, most, entries of doc, tf and dl), vocabulary (term, df), stats (docs, avgdl; one row).

    ``n`` is the number of documents, ids of null included, which are in no entries. A repeated id has all its words in one
    document and an entry for each of its lengths."""

    entries: DataFrame
    vocabulary: DataFrame
    stats: DataFrame


def _saturation(tf: np.ndarray, dl: np.ndarray, avgdl: float) -> np.ndarray:
    return tf * (lexical.K1 + 1) / (tf + lexical.K1 * (1 - lexical.B + lexical.B * dl / avgdl))


def write(posted: DataFrame, dl: DataFrame, path: str, size: int = BLOCK_DOCS) -> None:
    """Store postings (doc, term, tf) and lengths (doc, dl) under ``path``."""
    told = dl.select("doc", F.lit(None).cast("array<string>").alias("w"), F.col("dl").cast("long").alias("dl"))
    rows = posted.select("doc", F.array_repeat("term", F.col("tf").cast("int")).alias("w"), F.lit(None).cast("long").alias("dl"))
    _store(rows.unionByName(told), lambda dealt: dealt, dl, path, size)


def write_documents(docs: DataFrame, doc: str, text: str, path: str, size: int = BLOCK_DOCS) -> None:
    """Store the words of texts under ``path``; the texts are read twice, first for their lengths alone."""
    rows = docs.select(F.col(doc).alias("doc"), F.col(text).alias("w"))
    lengths = rows.select(F.size(words(F.col("w"))).cast("long").alias("dl"))
    _store(rows, lambda dealt: dealt.withColumn("w", words(F.col("w"))).withColumn("dl", F.size("w").cast("long")), lengths, path, size)


def _store(rows: DataFrame, told: Callable[[DataFrame], DataFrame], lengths: DataFrame, path: str, size: int) -> None:
    """Store ``rows`` of ids, which ``told`` makes (doc, w, dl) once they are with their groups."""
    spark = rows.sparkSession
    lengths.agg(F.count("*").alias("docs"), F.avg("dl").alias("avgdl")).write.parquet(f"{path}/stats")
    stats = spark.read.parquet(f"{path}/stats").first()
    docs, avgdl = stats["docs"], stats["avgdl"]
    groups = max(1, docs // GROUP_DOCS, int(docs * (avgdl or 0)) // GROUP_WORDS)

    def run(key: tuple, rows: pa.Table) -> pa.Table:
        return _gathered(rows, key[0].as_py(), size, avgdl)

    ship(spark)
    # All that follows is worked out inside of a group, so there is no further shuffle.
    dealt = rows.withColumn("_group", F.pmod(F.xxhash64("doc"), F.lit(groups)).cast("int")).repartitionById(groups, "_group")
    kind = dict(rows.dtypes)["doc"]
    schema = f"term string, block long, n long, most double, entries array<struct<doc: {kind}, tf: long, dl: long>>"
    told(dealt).groupBy("_group").applyInArrow(run, schema).write.parquet(f"{path}/entries")
    spark.read.parquet(f"{path}/entries").groupBy("term").agg(F.sum("n").alias("df")).write.parquet(f"{path}/vocabulary")


def _coded(docs: pa.ChunkedArray | pa.Array) -> tuple[pa.Array, np.ndarray]:
    """(different ids in order, null last; where each row's is)."""
    whole = docs.combine_chunks() if isinstance(docs, pa.ChunkedArray) else docs
    coded = whole.dictionary_encode(null_encoding="encode")
    turn = pc.sort_indices(coded.dictionary).to_numpy()
    place = np.empty(len(turn), int)
    place[turn] = np.arange(len(turn))
    return coded.dictionary.take(pa.array(turn)), place[coded.indices.to_numpy()]


def _gathered(rows: pa.Table, group: int, size: int, avgdl: float) -> pa.Table:
    """(term, block, n, most, entries) of the rows (doc, w, dl) of one group, by term and block."""
    docs, at = _coded(rows["doc"])
    # The lengths of each document: none of null, several of a repeated id.
    told = pc.and_(rows["dl"].is_valid(), rows["doc"].is_valid()).to_numpy()
    dl, owner = rows["dl"].to_numpy()[told].astype(int), at[told]
    turn = np.argsort(owner, kind="stable")
    dl, times = dl[turn], np.bincount(owner, minlength=len(docs))
    first = np.cumsum(times) - times
    length = np.bincount(owner[turn], dl, len(docs))
    block = np.empty(len(docs), int)
    block[np.argsort(length, kind="stable")] = np.arange(len(docs)) // size
    w = rows["w"].combine_chunks()
    coded = w.flatten().dictionary_encode()
    turn = pc.sort_indices(coded.dictionary).to_numpy()
    rank = np.empty(len(turn), int)
    rank[turn] = np.arange(len(turn))
    owner = np.repeat(at, pc.fill_null(pc.list_value_length(w), 0).to_numpy(zero_copy_only=False))
    blocks = -(-len(docs) // size)
    key, tf = np.unique((rank[coded.indices.to_numpy()] * blocks + block[owner]) * len(docs) + owner, return_counts=True)
    cell, owner = key // len(docs), key % len(docs)
    n = times[owner]
    row = np.repeat(np.arange(len(key)), n)
    slot = first[owner][row] + np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n)
    adds = np.bincount(row, _saturation(tf[row].astype(float), dl[slot], avgdl), len(key))
    begin = np.flatnonzero(np.diff(cell, prepend=-1))
    ends = np.concatenate([[0], np.cumsum(n)])[np.append(begin, len(key))]
    each = pa.StructArray.from_arrays([docs.take(pa.array(owner[row])), pa.array(tf[row]), pa.array(dl[slot])], ["doc", "tf", "dl"])
    return pa.table({
        "term": coded.dictionary.take(pa.array(turn[cell[begin] // blocks])), "block": (group << 32) + cell[begin] % blocks,
        "n": np.diff(np.append(begin, len(key))), "most": np.maximum.reduceat(adds, begin) if len(begin) else np.zeros(0),
        "entries": pa.ListArray.from_arrays(pa.array(ends, pa.int32()), each),
    })


def read(spark: SparkSession, path: str) -> Blocks:
    return Blocks(*[spark.read.parquet(f"{path}/{n}") for n in ("entries", "vocabulary", "stats")])


class _Group:
    """The rows (q, block, most, entries) of one group: words are numbers, blocks and documents are places in arrays."""

    def __init__(self, rows: pa.Table, words: int, avgdl: float):
        rows = rows.sort_by([("q", "ascending"), ("block", "ascending")])
        entries = rows["entries"].combine_chunks()
        flat = entries.flatten()
        self.sizes, self.most = pc.list_value_length(entries).to_numpy(zero_copy_only=False), rows["most"].to_numpy()
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        self.cut = np.searchsorted(rows["q"].to_numpy(), np.arange(words + 1))
        self.blocks, self.block = np.unique(rows["block"].to_numpy(), return_inverse=True)
        self.docs, self.at = _coded(pc.struct_field(flat, "doc"))
        tf, dl = (pc.struct_field(flat, n).to_numpy().astype(float) for n in ("tf", "dl"))
        self.share = _saturation(tf, dl, avgdl)

    def bounds(self, terms: list[tuple[int, float]]) -> np.ndarray:
        """What a document of each block can reach; 0 where no word of the question is."""
        reach = np.zeros(len(self.blocks))
        for t, weight in terms:
            rows = slice(self.cut[t], self.cut[t + 1])
            reach[self.block[rows]] += weight * self.most[rows]
        return reach

    def add(self, total: np.ndarray, terms: list[tuple[int, float]], chosen: np.ndarray) -> None:
        """Add the scores of the documents in the ``chosen`` blocks to ``total``."""
        for t, weight in terms:
            first, end = self.cut[t], self.cut[t + 1]
            keep, held = chosen[self.block[first:end]], slice(self.starts[first], self.starts[end])
            at, share = self.at[held], self.share[held]
            if not keep.all():
                keep = np.repeat(keep, self.sizes[first:end])
                at, share = at[keep], share[keep]
            if len(at):
                total += weight * np.bincount(at, share, len(total))

    def scored(self, terms: list[tuple[int, float]], k: int, first: int) -> tuple[np.ndarray, int, int]:
        """(scores of documents, 0 for those that were not scored; blocks that hold a word; blocks scored)."""
        reach = self.bounds(terms)
        holds = np.flatnonzero(reach)
        chosen, total = np.zeros(len(reach), bool), np.zeros(len(self.docs))
        chosen[holds[np.argsort(-reach[holds], kind="stable")[:first]]] = True
        self.add(total, terms, chosen)
        reached = np.partition(total, len(total) - k)[len(total) - k] if np.count_nonzero(total) >= k else 0
        others = (reach > 0) & ~chosen & (reach >= reached - MARGIN)
        self.add(total, terms, others)
        return total, len(holds), int(chosen.sum() + others.sum())


def _batches(questions: DataFrame, index: Blocks) -> Iterator[DataFrame]:
    """(query_id, term, weight) of all questions that hold a known word, in batches of about ``MOST_WORDS`` rows; a repeated
    word weighs as often as it is there."""
    terms = lexical.expand(questions, index.vocabulary, prefix=False)
    known = terms.join(index.vocabulary, "term").join(F.broadcast(index.stats))  # one row
    weight = (F.count("*") * lexical.rarity(F.first("docs"), F.first("df"))).alias("weight")
    wanted = written(known.groupBy("query_id", "term").agg(weight), "wanted")
    parts = max(1, -(-wanted.count() // MOST_WORDS))
    for i in range(parts):
        yield wanted.filter(F.pmod(F.xxhash64("query_id"), F.lit(parts)) == i)


def _by_group(wanted: DataFrame, index: Blocks, schema: str, each: Callable[[_Group, list], tuple]) -> DataFrame:
    """What ``each`` makes of a group and the terms of a question, a tuple of arrays, with ``query_id`` before them."""
    spark = wanted.sparkSession
    asked, number = {}, {}
    for r in wanted.collect():
        asked.setdefault(r["query_id"], []).append((number.setdefault(r["term"], len(number)), r["weight"]))
    shared, avgdl = spark.sparkContext.broadcast((list(asked.items()), len(number))), index.stats.first()["avgdl"]
    kind = dict(wanted.dtypes)["query_id"]

    def run(rows: pa.Table) -> pa.Table:
        questions, count = shared.value
        group, found = _Group(rows, count, avgdl), []
        for place, (_, terms) in enumerate(questions):
            out = each(group, terms)
            found.append((np.full(len(out[0]), place), *out))
        places, *columns = [pa.concat_arrays([pa.array(x) for x in c]) for c in zip(*found)]
        return pa.table([pa.array([q for q, _ in questions]).take(places), *columns], ["query_id", *[f"c{i}" for i in range(len(columns))]])

    ship(spark)
    entries = index.entries.filter(F.col("term").isin(list(number))) if len(number) <= NAMED_TERMS else index.entries
    numbers = F.broadcast(spark.createDataFrame(pa.table({"term": pa.array(list(number), pa.string()), "q": pa.array(number.values(), pa.int32())})))
    met = entries.join(numbers, "term").filter("most > 0").select(F.shiftright("block", 32).alias("_group"), "q", "block", "most", "entries")
    return met.groupBy("_group").applyInArrow(run, f"query_id {kind}, {schema}")


def top(questions: DataFrame, index: Blocks, k: int, first: int = FIRST) -> DataFrame:
    """(query_id, doc, score) of the first ``k`` documents of each question, by the score rounded to nine digits and then
    the document: the rows of ``lexical.bm25`` with whole words, cut by ``lexical.top``.

    Questions without a known word have no rows; repeated words count each; documents with null text are in no block.
    """

    def each(group: _Group, terms: list) -> tuple:
        total, _, _ = group.scored(terms, k, first)
        hit = lexical.leading(total, k)
        return group.docs.take(pa.array(hit)), -total[hit]

    doc = index.entries.schema["entries"].dataType.elementType["doc"].dataType.simpleString()
    found = [_by_group(w, index, f"c0 {doc}, c1 double", each) for w in _batches(questions, index)]
    scored = _union(found).toDF("query_id", "doc", "score")
    return lexical.top(scored, k, [F.round("score", 9), F.col("doc")]).drop("rank")


def work(questions: DataFrame, index: Blocks, k: int, first: int = FIRST) -> DataFrame:
    """(query_id, blocks, scored): the blocks that hold a word of each question, and how many of them ``top`` scores."""

    def each(group: _Group, terms: list) -> tuple:
        _, blocks, scored = group.scored(terms, k, first)
        return np.array([blocks]), np.array([scored])

    found = [_by_group(w, index, "c0 long, c1 long", each) for w in _batches(questions, index)]
    return _union(found).groupBy("query_id").agg(F.sum("c0").alias("blocks"), F.sum("c1").alias("scored"))


def _union(found: list[DataFrame]) -> DataFrame:
    out = found[0]
    for df in found[1:]:
        out = out.unionByName(df)
    return out
