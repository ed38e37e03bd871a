"""Packing by power-of-two decomposition: every document is cut into pieces of binary lengths, and each piece is a
training sequence by itself. Sequences of equal length lie in one bucket, so a batch of a bucket needs no padding, and no
sequence crosses documents."""

from __future__ import annotations

import json
import re
import unicodedata
import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkscope.llm import common

#: A tokenizer file over this is refused, as it is sent to every executor.
MAX_TOKENIZER_BYTES = 64_000_000
#: Characters of a text that are encoded at once, about, and the longest run without white space for the fast engine.
CHUNK, LONG = 4_000, 500
#: Token ids in a batch of results.
FLUSH = 500_000

# Fixed value: what the byte-level pre-tokenizer cuts by.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Where a text may be cut, as a token begins there in any case: after a visible character before white space, or
#: after a letter before a mark.
_CUT = re.compile("(?<=[!-~])(?=[ \\n])|(?<=[A-Za-z\u3041-\u3096\u4e00-\u9fff])(?=[,.;:!?\u3001\u3002\uff0c])")
_encoders: dict = {}


def by_rank(parsed: dict) -> tiktoken.Encoding | None:
    """The same byte-pair merges for an engine that merges by the rank of the result; None where that might differ.

    It does not differ if results' ids ascend with their merges and every token, by the listed merges, becomes itself:
    two symbols that make up a token are then adjacent only where their merge is listed, since what is between two
    symbols' ends has merged as it would have alone.
    """
    model = parsed["model"]
    pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
    rank = {pair: i for i, pair in enumerate(pairs)}
    vocab = model["vocab"]
    ids = [vocab.get(a + b, -1) for a, b in pairs]
    visible = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    of_char = {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in visible)}
    single = [vocab.get(c, -1) for c in of_char]
    if any(a >= b for a, b in zip(ids, ids[1:])) or min(single) < 0 or max(single) >= ids[0]:
        return None
    for a, b in pairs:
        symbols = list(a + b)
        while len(symbols) > 1:
            least, at = min((rank.get(pair, len(rank)), i) for i, pair in enumerate(zip(symbols, symbols[1:])))
            if least == len(rank):
                return None
            symbols[at : at + 2] = [symbols[at] + symbols[at + 1]]
    used = [*of_char, *(a + b for a, b in pairs)]
    ranks = {bytes(of_char[c] for c in token): vocab[token] for token in used}
    return tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})


@cache
def _unsettled() -> str:
    """A class of the characters that libraries of different Unicode versions may call letters, numbers or neither, or
    white space or not."""

    def role(version, c: str) -> str:
        found = version.category(c)
        return found if found == "Cn" else found[0] if found[0] in "LN" else "-"

    old = unicodedata.ucd_3_2_0
    odd = [c for c in map(chr, range(128, 0x10000)) if role(old, c) == "Cn" or role(old, c) != role(unicodedata, c)]
    return "".join(map(re.escape, odd)) + "\x1c-\x1f\u180e\u200b-\u200d\u2060\ufeff\U00010000-\U0010ffff"


class Encoder:
    """Token ids of whole texts as the library gives them, as bytes (little-endian, unsigned, 32 bits).

    Texts are cut where a token begins in any case. Chunks of settled characters take the faster engine of ``by_rank``
    if it is the same; those with special strings, other characters or very long words go to the library.
    """

    def __init__(self, definition: str, ranked: bool):
        self.library = Tokenizer.from_str(definition)
        self.library.no_truncation()
        self.library.no_padding()
        parsed = json.loads(definition)
        added = [re.escape(t["content"]) for t in parsed.get("added_tokens", [])]
        self.cut = cuts_bytes(parsed)
        self.ranked = by_rank(parsed) if ranked else None
        self.odd = re.compile(f"[{_unsettled()}]")
        self.special = re.compile("|".join(added) or r"(?!)")

    def usual(self, chunk: str) -> bool:
        """Whether the fast engine gives the same, in little time: it is slow in long runs with or without white space."""
        if self.ranked is None or self.odd.search(chunk) or self.special.search(chunk):
            return False
        sizes = [len(w) for w in chunk.split()]
        return max(sizes, default=0) < LONG and len(chunk) - sum(sizes) < LONG + len(sizes)

    def plain(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if not self.cut:
            return self.plain(text)
        out, at = [], 0
        while at < len(text):
            found = _CUT.search(text, at + CHUNK) if len(text) - at > CHUNK else None
            end = found.start() if found else len(text)
            chunk = text[at:end]
            out.append(np.array(self.ranked.encode_ordinary(chunk), "<u4").tobytes() if self.usual(chunk) else self.plain(chunk))
            at = end
        return b"".join(out)


def cuts_bytes(parsed: dict) -> bool:
    """Whether a tokenizer is byte-level with the usual pattern and nothing around it, so that texts can be cut."""
    pre, model = parsed.get("pre_tokenizer") or {}, parsed.get("model") or {}
    usual = pre.get("type") == "ByteLevel" and pre.get("use_regex", True) and not pre.get("add_prefix_space")
    plain = model.get("type") == "BPE" and not any(model.get(k) for k in ("dropout", "unk_token", "continuing_subword_prefix", "end_of_word_suffix", "ignore_merges"))
    bare = not any(parsed.get(k) for k in ("normalizer", "post_processor"))
    return bool(usual and plain and bare and not any(re.search(r"\s", t["content"]) for t in parsed.get("added_tokens", [])))


def lengths_of(tokens: int, longest: int) -> list[int]:
    """``tokens`` as full pieces of ``longest`` (a power of two) and the binary digits of the rest, longest first."""
    rest = tokens % longest
    return [longest] * (tokens // longest) + [1 << b for b in reversed(range(rest.bit_length())) if rest >> b & 1]


def pack(docs: DataFrame, target: str, tokenizer_path: str, longest: int = 1024, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Write the pieces of ``docs`` under ``target``, a folder for each length: ``length=1`` to ``length=<longest>``.

    Columns: the id, start (ids of its document before the piece), token_ids, doc_tokens, sequence_id, offset. A
    document's ids are the library's for its whole text, without added special tokens, then ``end_id``. A piece is a
    sequence of its own, so ``offset`` is 0 and no sequence is padded: ``length`` is a power of two.

    Null and empty texts are ``end_id`` alone, one piece of length 1. Rows are packed one by one: repeated rows, null
    and repeated ids stay, with sequences of their own. An empty table writes no pieces. Other columns are not read.
    Rows are not shuffled, so hot sources and copies cost what their bytes cost; a document must fit in a task with its
    ids (4 bytes each), and rows come out in batches of ``FLUSH`` ids. ``sequence_id`` is made of the number of the
    partition and a count in it: a task that runs again gives the same.
    """
    spark = docs.sparkSession
    if longest < 1 or longest & (longest - 1):
        raise ValueError("longest must be a power of two")
    with open(tokenizer_path, encoding="utf-8") as file:
        definition = file.read(MAX_TOKENIZER_BYTES + 1)
    if len(definition) > MAX_TOKENIZER_BYTES:
        raise ValueError(f"{tokenizer_path} is over {MAX_TOKENIZER_BYTES} bytes")
    common.ship(spark)
    parsed = json.loads(definition)
    ranked = cuts_bytes(parsed) and by_rank(parsed) is not None
    shared = spark.sparkContext.broadcast(definition)
    kind = docs.schema[id_col].dataType.simpleString()
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _encoders.get(tokenizer_path)
        if encoder is None:
            encoder = _encoders[tokenizer_path] = Encoder(shared.value, ranked)
        sequence = TaskContext.get().partitionId() << 33
        for batch in batches:
            owners, starts, lengths, totals, held, size = [], [], [], [], [], 0

            def full(batch=batch):
                nonlocal sequence
                n = len(owners)
                bounds = pa.array(np.concatenate([[0], np.cumsum(lengths)]).astype("i4"))
                ids = pa.ListArray.from_arrays(bounds, pa.array(np.frombuffer(b"".join(held), "<i4")))
                columns = [batch.column(0).take(pa.array(owners)), pa.array(starts, pa.int64()), pa.array(lengths, pa.int32()), ids, pa.array(totals, pa.int64()), pa.array(range(sequence, sequence + n), pa.int64()), pa.array(np.zeros(n, "i4"))]
                sequence += n
                return pa.RecordBatch.from_arrays(columns, ["id", "start", "length", "token_ids", "doc_tokens", "sequence_id", "offset"])

            for i, text in enumerate(batch.column(1)):
                value = text.as_py()
                ids = (encoder.encode(value) if value else b"") + end
                total, at = len(ids) // 4, 0
                for length in lengths_of(total, longest):
                    owners.append(i)
                    starts.append(at)
                    lengths.append(length)
                    totals.append(total)
                    held.append(ids[4 * at : 4 * (at + length)])
                    at += length
                    size += length
                    if size >= FLUSH:
                        yield full()
                        owners, starts, lengths, totals, held, size = [], [], [], [], [], 0
            if owners:
                yield full()

    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    pieces = rows.mapInArrow(common.lean(run), f"id {kind}, start long, length int, token_ids array<int>, doc_tokens long, sequence_id long, offset int")
    with common.eager_cleanup(spark):
        pieces.withColumnRenamed("id", id_col).write.partitionBy("length").parquet(target)


def read(spark: SparkSession, target: str, id_kind: str = "long", id_col: str = "doc_id") -> DataFrame:
    """The pieces that ``pack`` wrote; a filter on ``length`` reads its bucket only."""
    return spark.read.schema(f"`{id_col}` {id_kind}, start long, token_ids array<int>, doc_tokens long, sequence_id long, offset int, length int").parquet(target)


def digests(pieces: DataFrame) -> DataFrame:
    """Pieces with ids_crc32 (of the stored ids as little-endian unsigned 32-bit numbers) in place of token_ids."""
    rest = [c for c in pieces.columns if c != "token_ids"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            at, data = ids.offsets.to_numpy(), memoryview(ids.values.to_numpy().astype("<i4", copy=False)).cast("B")
            sums = [zlib.crc32(data[4 * a : 4 * b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())]
            yield pa.RecordBatch.from_arrays([*batch.columns[1:], pa.array(sums, pa.int64())], [*rest, "ids_crc32"])

    kinds = ", ".join(f"`{c}` {t}" for c, t in pieces.dtypes if c != "token_ids")
    found = pieces.select("token_ids", *rest).mapInArrow(common.lean(run), f"{kinds}, ids_crc32 long")
    return found.withColumns({c: F.col(c).cast("long") for c in ("length", "offset")})
