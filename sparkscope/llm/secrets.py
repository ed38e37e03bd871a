"""Secret scans: three fixed patterns, and strings with a sliding window of high Shannon entropy.

A candidate of 20 characters or more is reported whole as soon as one of its windows reaches its class's threshold and
the allow-list does not hold it.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame

from sparkscope.llm import common


def _either_case(word: str) -> str:
    return "".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in word)


KEYWORDS = "|".join(map(_either_case, ("password", "passwd", "secret", "token", "api_?key")))
ASSIGN = re.compile(rf"(?:{KEYWORDS})[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")
HEX = re.compile(r"[0-9a-f]{24,}")
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{20,}")
#: Order of kinds that start at one place.
KINDS = ("assign", "access", "hex", "entropy")

#: A word, or words in camel case with acronyms, and a number of up to four digits after it; or a number. Humps of one
#: small letter count only if they are words, and upper-case words have up to 15 letters: random keys would pass.
SHORT = "A[mnst]|B[ey]|Do|Go|I[dfnost]|My|No|O[fknr]|To|U[ps]|We"
HUMP = rf"(?:[A-Z][a-z]{{2,}}+|[A-Z]{{2,5}}[a-z]{{3,}}+|[A-Z]{{0,5}}(?:{SHORT})(?![a-z]))"
NAME = rf"(?>(?=[A-Za-z0-9])(?:[a-z]*+{HUMP}*[A-Z]{{0,5}}[0-9]{{0,4}}|[A-Z]{{1,15}}[0-9]{{0,4}}|[0-9]+)(?![A-Za-z0-9]))"

#: Strings that look random but are none, or are known placeholders.
ALLOWED = (
    r"[0-9a-fA-F]{8}-(?:[0-9a-fA-F]{4}-){3}[0-9a-fA-F]{12}",  # UUID
    r"[A-Za-z0-9+/_=-]*EXAMPLE[A-Za-z0-9+/_=-]*",
    r"[A-Z]+|[a-z]+|[0-9_=-]+",  # one class only: words, numbers, rules
    rf"[/_=+-]*+(?:{NAME}[/_=+-]*+)+",  # names, alone or joined by marks: identifiers, paths, dates, slugs
)


@dataclass(frozen=True)
class Rules:
    """window: characters of the sliding window. Each class has its own threshold in bits per character.

    A candidate belongs to the first class that holds all its characters. About one in a thousand windows of random
    characters lies below its threshold: of 16 (hex), of 32 (alnum: base 32, 36 and 62) and of 62 or 64 (base64).
    """

    window: int = 20
    classes: tuple[tuple[str, str, float], ...] = (("hex", r"[0-9a-fA-F]+", 2.7), ("alnum", r"[A-Za-z0-9]+", 3.1), ("base64", r"[A-Za-z0-9+/_=-]+", 3.4))
    allowed: tuple[str, ...] = ALLOWED


def entropy_runs(text: str, window: int, threshold: float) -> list[tuple[int, int]]:
    """Maximal runs covered by windows whose Shannon entropy is ``threshold`` bits or more.

    The window's character counts change by one in and one out; the sum of c*log2(c) is kept, so a step is O(1).
    """
    if len(text) < window:
        return []
    weight = [0.0] + [c * math.log2(c) for c in range(1, window + 2)]
    counts: dict[str, int] = {}
    total = 0.0
    runs: list[list[int]] = []
    most = math.log2(window)
    for i, c in enumerate(text):
        k = counts.get(c, 0)
        counts[c] = k + 1
        total += weight[k + 1] - weight[k]
        if i >= window:
            out = text[i - window]
            k = counts[out]
            counts[out] = k - 1
            total += weight[k - 1] - weight[k]
        if i >= window - 1 and most - total / window >= threshold - 1e-9:
            start = i - window + 1
            if runs and start <= runs[-1][1]:
                runs[-1][1] = i + 1
            else:
                runs.append([start, i + 1])
    return [(a, b) for a, b in runs]


class Scanner:
    def __init__(self, rules: Rules):
        self.rules = rules
        self.classes = [(name, re.compile(pattern), bits) for name, pattern, bits in rules.classes]
        self.allowed = re.compile("|".join(f"(?:{p})" for p in rules.allowed)) if rules.allowed else None

    def base(self, text: str) -> list[tuple[int, int, int]]:
        """(start, end, kind) of the fixed patterns, leftmost and non-overlapping for each kind, in order."""
        found = []
        for m in ASSIGN.finditer(text):
            if m.end(1) - m.start(1) >= 6:
                found.append((m.start(), m.end(), 0))
        if "AKIA" in text:
            found += [(m.start(), m.end(), 1) for m in ACCESS.finditer(text)]
        found += [(m.start(), m.end(), 2) for m in HEX.finditer(text)]
        found.sort(key=lambda x: (x[0], x[2]))
        return found

    def entropy(self, text: str, base: Sequence[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        """Candidates with a high-entropy window that no base span holds; allowed candidates are none.

        ``base`` is in order, so one sweep tells how far the spans reach that begin no later than a candidate.
        """
        found, at, reach = [], 0, 0
        for m in CANDIDATE.finditer(text):
            while at < len(base) and base[at][0] <= m.start():
                reach = max(reach, base[at][1])
                at += 1
            if m.end() <= reach:
                continue
            word = m.group()
            if self.allowed and self.allowed.fullmatch(word):
                continue
            bits = next((b for _, pattern, b in self.classes if pattern.fullmatch(word)), None)
            if bits is None:
                continue
            if entropy_runs(word, self.rules.window, bits):
                found.append((m.start(), m.end(), 3))
        return found

    def scan(self, text: str) -> tuple[list[tuple[int, int, int]], list[tuple[int, int, int]]]:
        base = self.base(text)
        return base, sorted([*base, *self.entropy(text, base)], key=lambda x: (x[0], x[2]))


def joined(spans: Sequence[tuple[int, int, int]]) -> str:
    return ",".join(f"{KINDS[k]}:{a}:{b}" for a, b, k in spans)


def scan(docs: DataFrame, rules: Rules = Rules(), id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Secrets in every row's text: ``id_col``, n_assign, n_access, n_hex, n_entropy, base_sha256, spans.

    Offsets are code points, ends exclusive; a span is the whole match. Null and empty texts have no spans: zero
    counts, an empty ``spans`` and the digest of the empty string. Rows are scanned one by one (no shuffle): repeated
    rows stay, an empty table gives none, other columns are not read.
    """
    common.ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            counts: list[list[int]] = [[], [], [], []]
            digests, all_spans = [], []
            for t in batch.column(1):
                base, spans = scanner.scan(t.as_py() or "")
                kinds = [k for _, _, k in spans]
                for k, column in enumerate(counts):
                    column.append(kinds.count(k))
                digests.append(hashlib.sha256(joined(base).encode()).hexdigest())
                all_spans.append(joined(spans))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), *[pa.array(c, pa.int64()) for c in counts], pa.array(digests, pa.string()), pa.array(all_spans, pa.string())],
                ["id", "n_assign", "n_access", "n_hex", "n_entropy", "base_sha256", "spans"],
            )

    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(docs[id_col].alias("id"), docs[text_col].alias("text"))
    return rows.mapInArrow(common.lean(run), f"id {kind}, n_assign long, n_access long, n_hex long, n_entropy long, base_sha256 string, spans string").withColumnRenamed("id", id_col)


def masked(text: str, spans: Sequence[tuple[int, int, int]], mask: str) -> str:
    out, at = [], 0
    for a, b, _ in spans:
        if b <= at:
            continue
        out += [text[at : max(a, at)], mask if a >= at else ""]
        at = b
    return "".join([*out, text[at:]])


def redact(docs: DataFrame, rules: Rules = Rules(), mask: str = "[SECRET]", text_col: str = "text") -> DataFrame:
    """All rows and columns of ``docs``; in ``text_col`` each secret (overlapping ones together) is ``mask``."""
    common.ship(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(rules)
        for batch in batches:
            texts = []
            for t in batch.column(at):
                text = t.as_py()
                spans = scanner.scan(text)[1] if text else ()
                texts.append(masked(text, spans, mask) if spans else text)
            columns = list(batch.columns)
            columns[at] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays(columns, batch.schema.names)

    return docs.mapInArrow(common.lean(run), docs.schema)
