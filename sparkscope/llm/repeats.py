"""Removal of repeated substrings, by suffix sorting at content-defined anchors.

Each string of ``length`` bytes has an anchor: of the GRAM-byte strings inside it the one with the smallest hash, which
depends on the string's content alone. So equal strings have equal anchors at equal places, and only suffixes at equal
anchors need sorting. Consecutive strings of a document with the same anchor form a block. Where all blocks of an
anchor are equal, all their strings repeat. Else the different blocks of the anchor (one copy of each) are compared by
two suffix sorts, of what follows the anchor and, backward, of what precedes it. An anchor of very many different
blocks is split by more of their content until each part is small.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkscope.llm import common
from sparkscope.llm.shingles import mix, powers
from sparkscope.llm.suffix_sort import Extensions, SuffixSort

U = np.uint64
GRAM = 64
#: Bytes that are hashed at once; longer texts are cut, with an overlap.
PIECE = 500_000
#: Blocks that are sorted as one group; the group of an anchor with more different blocks is split by content first.
GROUP_BLOCKS = 4_000


def _pieces(texts: list[bytes], length: int) -> Iterator[list[tuple[int, int, bytes]]]:
    """Lists of (text number, offset, bytes) of about PIECE bytes; a cut text's pieces overlap by length - 1 bytes."""
    out, size = [], 0
    for i, t in enumerate(texts):
        for at in range(0, max(1, len(t) - length + 1), PIECE):
            part = t[at : at + PIECE + length - 1] if len(t) > PIECE else t
            if len(part) < length:
                continue
            if size and size + len(part) > 2 * PIECE:
                yield out
                out, size = [], 0
            out.append((i, at, part))
            size += len(part)
    if out:
        yield out


def blocks_of(texts: list[bytes], length: int) -> Iterator[tuple[np.ndarray, ...]]:
    """Blocks as arrays (text number, anchor hash, block hash, place).

    place packs the anchor's offset, how far before it the block starts, and its number of strings less one.
    """
    grams = length - GRAM + 1
    for pieces in _pieces(texts, length):
        data = np.frombuffer(b"".join(p for _, _, p in pieces), dtype=np.uint8)
        n = len(data)
        sizes = np.array([len(p) for _, _, p in pieces])
        first = np.cumsum(sizes) - sizes
        up, down = powers(n + 1)
        prefix = np.zeros(n + 1, dtype=np.uint64)
        np.cumsum((data.astype(np.uint64) + U(1)) * up[:n], out=prefix[1:])
        m = n - GRAM + 1
        gram = mix((prefix[GRAM:] - prefix[:m]) * down[:m])
        # The smaller half of a key is the position: of equal hashes the leftmost is the anchor.
        key = (gram & U(0xFFFFFFFF00000000)) | np.arange(m, dtype=np.uint64)
        width = 1
        while 2 * width <= grams:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < grams:
            key = np.minimum(key[: len(key) - (grams - width)], key[grams - width :])
        anchor = (key & U(0xFFFFFFFF)).astype(np.int64)
        valid = np.ones(len(anchor), dtype=bool)
        for f in first[1:]:
            valid[max(0, f - length + 1) : f] = False
        new = np.concatenate([[True], (anchor[1:] != anchor[:-1]) | (valid[1:] != valid[:-1])])
        start = np.flatnonzero(new)
        stop = np.append(start[1:], len(anchor)) - 1
        good = valid[start]
        start, stop = start[good], stop[good]
        at = anchor[start]
        of = np.searchsorted(first, start, side="right") - 1
        before = at - start
        whole = mix((prefix[stop + length] - prefix[start]) * down[start] + before.astype(np.uint64) * U(0x9E3779B97F4A7C15) + (stop - start).astype(np.uint64))
        number = np.array([i for i, _, _ in pieces])
        offset = np.array([o for _, o, _ in pieces])
        place = ((at - first[of] + offset[of]) << 16) | (before << 8) | (stop - start)
        yield number[of], gram[at].view(np.int64), whole.view(np.int64), place


def repeated_strings(group: np.ndarray, before: np.ndarray, count: np.ndarray, blocks: list[bytes], length: int) -> list[list[tuple[int, int]]]:
    """For each block the ranges (first, last) of its strings that some other block of its group has too.

    A string is numbered by how far before the anchor it starts. Two blocks share it if they have in common that much
    before the anchor and the rest of ``length`` after it.
    """
    n = len(blocks)
    sizes = np.array([len(b) for b in blocks], dtype=np.int64)
    data = np.frombuffer(b"".join(blocks), dtype=np.uint8)
    first = np.cumsum(sizes) - sizes
    after = SuffixSort(Extensions(data), group, first + before, sizes - before)
    backward = Extensions(data[::-1].copy())
    ahead = SuffixSort(backward, group, len(data) - (first + before), before)
    out: list[list[tuple[int, int]]] = [[] for _ in range(n)]
    open_runs: dict[int, int] = {}
    for a in range(int(before.max()) + 1):
        has = np.flatnonzero((before >= a) & (before - count < a))
        here: set[int] = set()
        if len(has) > 1:
            pair = after.classes(length - a)[has] * (n + 1) + ahead.classes(a)[has]
            order = np.argsort(pair, kind="stable")
            same = pair[order[1:]] == pair[order[:-1]]
            hit = np.concatenate([same, [False]]) | np.concatenate([[False], same])
            here = set(has[order[hit]].tolist())
        for i in [i for i in open_runs if i not in here]:
            out[i].append((open_runs.pop(i), a - 1))
        for i in here:
            open_runs.setdefault(i, a)
    for i, a in open_runs.items():
        out[i].append((a, int(before.max())))
    return out


def _spans(batch_groups: pa.Table, length: int) -> pa.RecordBatch:
    h = batch_groups.column("h").to_numpy()
    place = batch_groups.column("place").to_numpy()
    single = batch_groups.column("n").to_numpy() == 1
    found = repeated_strings(h, (place >> 8) & 255, (place & 255) + 1, batch_groups.column("block").to_pylist(), length)
    rows, starts, ends = [], [], []
    for i, ranges in enumerate(found):
        if single[i]:
            p = int(place[i]) >> 16
            for a, b in ranges:
                rows.append(i)
                starts.append(p - b)
                ends.append(p - a + length)
    taken = [batch_groups.column(c).take(pa.array(rows, pa.int64())).combine_chunks() for c in ("id", "print")]
    return pa.RecordBatch.from_arrays([*[_flat(c) for c in taken], pa.array(starts, pa.int64()), pa.array(ends, pa.int64())], ["id", "print", "start", "stop"])


def _flat(column) -> pa.Array:
    return column if isinstance(column, pa.Array) else pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], column.type)


def halves(block: bytes, place: int, low: int, high: int, length: int) -> Iterator[tuple[int, int, int, bytes, bytes]]:
    """A block's strings that start ``low`` to ``high`` bytes before the anchor, in two ranges: (low, high, place, core,
    bytes) of each that it has strings of.

    The core is what all strings of the range cover, from ``low`` bytes before the anchor on. Equal strings of a range
    have equal cores.
    """
    before, many = (place >> 8) & 255, (place & 255) + 1
    middle = (low + high) // 2
    for x, y in ((low, middle), (middle + 1, high)):
        last, first = max(x, before - many + 1), min(y, before)
        if last <= first:
            part = block[before - first : before - last + length]
            core = block[before - x : before - y + length]
            yield x, y, (place >> 16 << 16) | (first << 8) | (first - last), core, part


def split_groups(rest: DataFrame, length: int, group_blocks: int) -> tuple[list[DataFrame], list[DataFrame]]:
    """(groups for sorting, spans already found) of ``rest``: groups (h) of over ``group_blocks`` different blocks.

    A group is split by the content of cores, range by range, until its parts are small. Parts of blocks that are
    equal byte by byte become one on the way, by a grouping that is partial before the shuffle; so what very many
    documents share ends as one row. Ranges of one string end the splitting: then all blocks of a group are equal.
    """
    ready, spans = [], []
    kinds = dict(rest.dtypes)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            owner, out = [], []
            for i, (h, place, low, high, block) in enumerate(zip(*[batch.column(c).to_pylist() for c in ("h", "place", "low", "high", "block")])):
                for x, y, own, core, part in halves(block, place, low, high, length):
                    name = hashlib.blake2b(core, digest_size=8, key=b"%d %d %d" % (h, x, y)).digest()
                    owner.append(i)
                    out.append((int.from_bytes(name, "big", signed=True), own, x, y, part))
            taken = [batch.column(c).take(pa.array(owner, pa.int64())) for c in ("id", "print", "n")]
            columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))] if out else [pa.array([], k) for k in (*[pa.int64()] * 4, pa.binary())]
            yield pa.RecordBatch.from_arrays([*taken, *columns], ["id", "print", "n", "h", "place", "low", "high", "block"])

    while not rest.isEmpty():
        schema = f"id {kinds['id']}, print long, n long, h long, place long, low long, high long, block binary"
        parts = common.materialise(rest.select("id", "print", "n", "h", "place", "low", "high", "block").mapInArrow(common.lean(run), schema), "parts")
        classes = parts.groupBy("h", "low", "high", "block").agg(F.count("*").alias("c"), F.min(F.struct("id", "print", "place", "n")).alias("r"))
        classes = common.materialise(classes, "classes")
        again = classes.filter("c > 1").select("h", "block")
        spans.append(parts.filter("n = 1").join(again, ["h", "block"]).select("id", "print", *_span(length)))
        one = classes.select("h", "low", "high", "block", "r.id", "r.print", "r.place", F.when(F.col("c") > 1, F.lit(2)).otherwise(F.col("r.n")).cast("long").alias("n"))
        sizes = one.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("least = 1 AND kinds > 1").drop("least")
        one = common.materialise(one.join(common.materialise(sizes, "groups"), "h"), "contexts")
        large = (F.col("kinds") > group_blocks) & (F.col("low") < F.col("high"))
        ready.append(one.filter(~large).select("id", "print", "h", "n", "place", "block"))
        rest = one.filter(large)
    return ready, spans


def _span(length: int) -> list:
    """The bytes that a block's strings cover."""
    first = F.shiftright("place", 16) - F.shiftright("place", 8).bitwiseAND(F.lit(255))
    return [first.alias("start"), (first + F.col("place").bitwiseAND(F.lit(255)) + length).alias("stop")]


def repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """(id, print, start, stop): byte ranges covered by strings of ``length`` bytes that start elsewhere too.

    ``print`` is a hash of the text: with the id it names a row; rows that agree in both have the same ranges. Ranges
    may touch and overlap.
    """
    spark = docs.sparkSession
    common.ship(spark)
    if not GRAM < length <= GRAM + 255:
        raise ValueError(f"length must be over {GRAM} and at most {GRAM + 255}")
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.coalesce(text_col, F.lit("")).alias("text"))

    def anchors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 2000):
                part = batch.slice(at, 2000)
                for number, h, whole, place in blocks_of([t.encode() for t in part.column(2).to_pylist()], length):
                    own = pa.array(number)
                    yield pa.RecordBatch.from_arrays([part.column(0).take(own), part.column(1).take(own), pa.array(h), pa.array(whole), pa.array(place)], ["id", "print", "h", "whole", "place"])

    blocks = common.materialise(rows.filter(F.octet_length("text") >= length).mapInArrow(common.lean(anchors), f"id {kind}, print long, h long, whole long, place long"), "blocks")
    # Anchors that occur twice or more; "one": all their blocks are equal.
    known = blocks.groupBy("h").agg(F.count("*").alias("n"), F.min("whole").alias("x"), F.max("whole").alias("y")).filter("n > 1")
    known = common.materialise(known.select("h", (F.col("x") == F.col("y")).alias("one")), "anchors")
    shared = common.materialise(blocks.join(known, "h"), "shared")
    common.discard(blocks)
    mixed = shared.filter(~F.col("one"))
    # Of the other anchors one copy of each different block.
    kinds = mixed.groupBy("h", "whole").agg(F.count("*").alias("n"), F.min(F.struct("id", "print", "place")).alias("c"))
    kinds = common.materialise(kinds.select("h", "whole", "n", "c.*"), "kinds")
    groups = kinds.groupBy("h").agg(F.count("*").alias("kinds"), F.min("n").alias("least")).filter("least = 1")
    groups = common.materialise(groups, "groups")
    span = _span(length)
    parts = [shared.filter("one").select("id", "print", *span)]
    many = kinds.filter("n > 1").select("h", "whole")
    parts.append(mixed.join(many, ["h", "whole"]).select("id", "print", *span))

    asked = kinds.join(groups, "h").groupBy("id", "print").agg(F.collect_list(F.struct("h", "n", "place", "kinds")).alias("asked"))
    texts = rows.join(asked.withColumnsRenamed({"id": "_id", "print": "_print"}), F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 200):
                part = batch.slice(at, 200)
                owner, out = [], []
                for i, (text, asked) in enumerate(zip(part.column(2).to_pylist(), part.column(3).to_pylist())):
                    data = text.encode()
                    for a in asked:
                        start = (a["place"] >> 16) - ((a["place"] >> 8) & 255)
                        owner.append(i)
                        out.append((a["h"], a["n"], a["place"], a["kinds"], data[start : start + (a["place"] & 255) + length]))
                columns = [pa.array(c, k) for c, k in zip(zip(*out), (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                taken = [part.column(i).take(pa.array(owner)) for i in (0, 1)]
                yield pa.RecordBatch.from_arrays([*taken, *columns], ["id", "print", "h", "n", "place", "kinds", "block"])

    contexts = texts.select("id", "print", "text", "asked").mapInArrow(common.lean(cut), f"id {kind}, print long, h long, n long, place long, kinds long, block binary")
    # Rows that agree in id and print give the same blocks; one of each is enough.
    contexts = common.materialise(contexts.dropDuplicates(["h", "id", "print", "place"]), "contexts")

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Whole groups are sorted together; a group that goes on in the next batch waits for it."""
        held: pa.Table | None = None
        for batch in batches:
            table = pa.Table.from_batches([batch])
            held = table if held is None else pa.concat_tables([held, table])
            h = held.column("h").to_numpy()
            end = int(np.searchsorted(h, h[-1], side="left")) if len(h) else 0
            if end >= 4000:
                yield _spans(held.slice(0, end).combine_chunks(), length)
                held = held.slice(end)
        if held is not None and held.num_rows:
            yield _spans(held.combine_chunks(), length)

    spans = f"id {kind}, print long, start long, stop long"
    large = F.col("kinds") > group_blocks
    ready, found = split_groups(contexts.filter(large).withColumns({"low": F.lit(0).cast("long"), "high": F.lit(length - GRAM).cast("long")}), length, group_blocks)
    every = contexts.filter(~large).select("id", "print", "h", "n", "place", "block")
    for r in ready:
        every = every.unionByName(r)
    parts += [every.repartition("h").sortWithinPartitions("h").mapInArrow(common.lean(sort), spans), *found]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return common.materialise(out, "repeats")


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text", group_blocks: int = GROUP_BLOCKS) -> DataFrame:
    """All rows of ``docs``: id, n_bytes, n_removed, n_spans, kept_sha256, spans (removed runs: start, stop), kept.

    Texts are UTF-8 bytes; null is empty. A byte is removed if a ``length``-byte string that covers it starts anywhere
    else too: in another row, in a repeated row, or elsewhere in its own text (overlaps count). Strings do not cross
    rows. ``kept`` holds the remaining bytes, which may end inside a character.
    """
    ranges = repeats(docs, length, id_col, text_col, group_blocks)
    packed = F.collect_list((F.shiftleft(F.col("start"), 16) + (F.col("stop") - F.col("start"))))
    ranges = ranges.distinct().groupBy("id", "print").agg(packed.alias("ranges")).withColumnsRenamed({"id": "_id", "print": "_print"})
    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(text_col).alias("print"), F.col(text_col).alias("text"))
    joined = rows.join(ranges, F.col("id").eqNullSafe(F.col("_id")) & (F.col("print") == F.col("_print")), "left").select("id", "text", "ranges")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                part = batch.slice(at, 500)
                out = []
                for text, ranges in zip(part.column(1).to_pylist(), part.column(2)):
                    data = (text or "").encode()
                    spans = merged(ranges.values.to_numpy()) if ranges.is_valid else []
                    kept, last = [], 0
                    for a, b in spans:
                        kept.append(data[last:a])
                        last = b
                    rest = b"".join([*kept, data[last:]])
                    out.append((len(data), len(data) - len(rest), len(spans), hashlib.sha256(rest).hexdigest(), [{"start": a, "stop": b} for a, b in spans], rest))
                kinds = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.binary()]
                yield pa.RecordBatch.from_arrays([part.column(0), *[pa.array(c, k) for c, k in zip(zip(*out), kinds)]], ["id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans", "kept"])

    kind = docs.schema[id_col].dataType.simpleString()
    result = joined.mapInArrow(common.lean(run), f"id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans array<struct<start:bigint,stop:bigint>>, kept binary")
    return result.withColumnRenamed("id", id_col)


def merged(packed: np.ndarray) -> list[tuple[int, int]]:
    """Maximal runs of packed ranges (start in the high bits, size in the low 16)."""
    x = np.sort(packed)
    start, stop = x >> 16, (x >> 16) + (x & 65535)
    stop = np.maximum.accumulate(stop)
    first = np.concatenate([[True], start[1:] > stop[:-1]])
    at = np.flatnonzero(first)
    return list(zip(start[at].tolist(), stop[np.append(at[1:], len(x)) - 1].tolist()))
