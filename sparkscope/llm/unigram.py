"""SentencePiece encoding and decoding: unigram Viterbi over a double-array trie, with byte fallback."""

from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from sparkscope.llm import common
from sparkscope.llm.vocabulary import BYTE, SPACE, Vocabulary, WordUnits, load

#: Bytes that the pieces of units kept by a Python worker take, about.
CACHE_BYTES = 24_000_000
#: A character without a piece scores this much less than the worst piece.
UNKNOWN_PENALTY = 10.0
_caches: dict = {}


@dataclass
class DoubleArray:
    """Trie over UTF-8 bytes: the child of state s by byte b is ``base[s] + b + 1`` if ``check`` there is s.

    ``value[s]`` is the id of the piece that ends in s, or -1. State 0 is the root.
    """

    base: list[int]
    check: list[int]
    value: list[int]

    @classmethod
    def build(cls, ids: dict[str, int]) -> DoubleArray:
        children: list[dict[int, int]] = [{}]
        ends = {}
        for piece, number in ids.items():
            node = 0
            for b in piece.encode():
                nxt = children[node].get(b)
                if nxt is None:
                    nxt = children[node][b] = len(children)
                    children.append({})
                node = nxt
            ends[node] = number
        size = 2 * len(children) + 512
        base, check, value = [0] * size, [-1] * size, [-1] * size
        check[0] = 0
        free = 1  # no slot below it is looked at any more
        queue = [(0, 0)]
        for node, slot in queue:  # grows while it is read: breadth first
            value[slot] = ends.get(node, -1)
            codes = sorted(b + 1 for b in children[node])
            if not codes:
                continue
            while check[free] != -1:
                free += 1
            at, tries = max(free - codes[0], 0), 0
            while True:
                tries += 1
                if at + 258 > len(check):
                    grow = len(check)
                    base += [0] * grow
                    check += [-1] * grow
                    value += [-1] * grow
                if all(check[at + c] == -1 for c in codes):
                    break
                at += 1
            if tries > 50:  # this stretch is nearly full
                free = max(free, at + codes[0] - 256)
            base[slot] = at
            for b, child in children[node].items():
                check[at + b + 1] = slot
                queue.append((child, at + b + 1))
        while len(check) > 1 and check[-1] == -1:
            base.pop(), check.pop(), value.pop()
        pad = 258
        return cls(base + [0] * pad, check + [-1] * pad, value + [-1] * pad)


class Codec:
    """Encodes and decodes texts. Holds what is sent to the executors: bounded by the model file, whose size is checked."""

    def __init__(self, vocabulary: Vocabulary):
        ids = vocabulary.ids()
        self.trie = DoubleArray.build(ids)
        self.scores = [float(s) for s in vocabulary.scores]
        self.worst = min(vocabulary.normal().values()) - UNKNOWN_PENALTY
        self.byte_ids = vocabulary.byte_ids()
        self.is_byte = [k == BYTE for k in vocabulary.kinds]
        space = SPACE.encode()
        self.output = [bytes([int(p[1:-1], 16)]) if k == BYTE else p.encode().replace(space, b" ") for p, k in zip(vocabulary.pieces, vocabulary.kinds)]

    def best(self, unit: str) -> list[int]:
        """The pieces of one unit with the largest sum of log scores; of equal sums, the one whose last piece is longest.

        A character that is no piece by itself may also be cut out as unknown; it becomes its bytes.
        """
        data = unit.encode()
        n = len(data)
        base, check, value, scores, worst = self.trie.base, self.trie.check, self.trie.value, self.scores, self.worst
        total: list[float | None] = [None] * (n + 1)
        back: list[tuple[int, int]] = [(0, 0)] * (n + 1)
        total[0] = 0.0
        for i in range(n):
            so_far = total[i]
            if so_far is None:
                continue
            first = data[i]
            char = i + (1 if first < 0x80 else 2 if first < 0xE0 else 3 if first < 0xF0 else 4)
            state, j, single = 0, i, False
            while j < n:
                nxt = base[state] + data[j] + 1
                if check[nxt] != state:
                    break
                state = nxt
                j += 1
                piece = value[state]
                if piece >= 0:
                    single = single or j == char
                    s = so_far + scores[piece]
                    old = total[j]
                    if old is None or s > old:
                        total[j], back[j] = s, (i, piece)
            if not single:
                s = so_far + worst
                old = total[char]
                if old is None or s > old:
                    total[char], back[char] = s, (i, -1)
        out: list[int] = []
        while n:
            i, piece = back[n]
            if piece >= 0:
                out.append(piece)
            else:
                out.extend(self.byte_ids[b] for b in reversed(data[i:n]))
            n = i
        out.reverse()
        return out

    def encode(self, text: str | None, units: _Units) -> array:
        out = array("i")
        if text:
            out.frombytes(b"".join(map(units.__getitem__, WordUnits.cut(text))))
            units.bound()
        return out

    def decode(self, ids) -> str:
        """Pieces in a row with space markers as spaces, without the one that encoding puts in front."""
        data = b"".join(map(self.output.__getitem__, ids))
        return data.removeprefix(b" ").decode("utf-8", "replace")


class _Units(dict):
    """The ids of units as bytes, by key of ``WordUnits``."""

    def __init__(self, codec: Codec):
        super().__init__()
        self.codec, self.held = codec, 0

    def __missing__(self, key: str) -> bytes:
        found = self[key] = array("i", self.codec.best(WordUnits.unit(key))).tobytes()
        self.held += 200 + 4 * len(key) + len(found)
        return found

    def bound(self) -> None:
        if self.held > CACHE_BYTES:
            self.clear()
            self.held = 0


def _worker(model_path: str, shared) -> tuple[Codec, _Units]:
    found = _caches.get(model_path)
    if found is None:
        codec = shared.value
        found = _caches[model_path] = codec, _Units(codec)
    return found


def encode(docs: DataFrame, model_path: str, text_col: str = "text", output_col: str = "token_ids", decoded_col: str | None = None) -> DataFrame:
    """All rows and columns of ``docs`` with ``output_col``, the text's piece ids as array<int>.

    With ``decoded_col``, also what decoding the ids gives, in the same pass ("" for a null text).

    Null and empty texts give an empty array. A column that is already called ``output_col`` is replaced; all others
    keep their names and values, whatever they are called. No shuffle; texts of any length are encoded whole.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(Codec(load(model_path)))
    kept = docs.drop(output_col, *([decoded_col] if decoded_col else []))
    added = [T.StructField(output_col, T.ArrayType(T.IntegerType())), *([T.StructField(decoded_col, T.StringType())] if decoded_col else [])]
    schema = T.StructType([*kept.schema.fields, *added])
    at = kept.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, units = _worker(model_path, shared)
        for batch in batches:
            for start in range(0, batch.num_rows, 500):
                part = batch.slice(start, 500)
                ids, ends, texts = array("i"), [0], []
                for t in part.column(at):
                    own = codec.encode(t.as_py(), units)
                    ids.extend(own)
                    ends.append(len(ids))
                    if decoded_col:
                        texts.append(codec.decode(own))
                column = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(memoryview(ids), pa.int32()) if ids else pa.array([], pa.int32()))
                more = [pa.array(texts, pa.string())] if decoded_col else []
                yield pa.RecordBatch.from_arrays([*part.columns, column, *more], [f.name for f in schema])

    return kept.mapInArrow(common.lean(run), schema)


def decode(tokens: DataFrame, model_path: str, ids_col: str = "token_ids", output_col: str = "decoded") -> DataFrame:
    """All rows and columns of ``tokens`` with ``output_col``, the text of the ids in ``ids_col``; null ids give null.

    Encoding and decoding give back the text, but for space markers (U+2581) inside it, which become spaces. Bytes
    that are no UTF-8 become U+FFFD.
    """
    spark = tokens.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(Codec(load(model_path)))
    kept = tokens.drop(output_col)
    at = kept.columns.index(ids_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, _ = _worker(model_path, shared)
        for batch in batches:
            texts = [None if not x.is_valid else codec.decode(x.values.to_pylist()) for x in batch.column(at)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(texts, pa.string())], [*batch.schema.names, output_col])

    return kept.mapInArrow(common.lean(run), T.StructType([*kept.schema.fields, T.StructField(output_col, T.StringType())]))


def round_trip(docs: DataFrame, model_path: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Digests of encoding and decoding each text in one pass.

    Per row: ``id_col``, n_tokens, n_fallback (byte pieces), ids_sha256 (of the ids, 4 little-endian bytes each), decoded_sha256
    (of the decoded text's UTF-8) and restored (the decoded text is the text). Null counts as empty. Repeated rows stay,
    an empty table gives no rows, other columns are not read.
    """
    spark = docs.sparkSession
    common.ship(spark)
    shared = spark.sparkContext.broadcast(Codec(load(model_path)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec, units = _worker(model_path, shared)
        is_byte = np.array(codec.is_byte)
        for batch in batches:
            columns: list[list] = [[], [], [], [], []]
            for t in batch.column(1):
                text = t.as_py() or ""
                ids = codec.encode(text, units)
                decoded = codec.decode(ids)
                row = (
                    len(ids),
                    int(is_byte[np.frombuffer(ids, dtype=np.int32)].sum()) if ids else 0,
                    hashlib.sha256(ids).hexdigest(),
                    hashlib.sha256(decoded.encode()).hexdigest(),
                    decoded == text,
                )
                for column, x in zip(columns, row):
                    column.append(x)
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.bool_()]
            yield pa.RecordBatch.from_arrays([batch.column(0), *map(pa.array, columns, kinds)], ["id", "n_tokens", "n_fallback", "ids_sha256", "decoded_sha256", "restored"])

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(common.lean(run), f"id {kind}, n_tokens long, n_fallback long, ids_sha256 string, decoded_sha256 string, restored boolean").withColumnRenamed("id", id_col)
