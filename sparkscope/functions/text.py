"""Column expressions over identifiers, queries, paths and matches. All of them stay in the JVM."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
IDENTIFIER = r"[A-Za-z0-9_-]+"
# Fixed value: what a part of an identifier is.
SUBWORD = r"[0-9]+|[A-Z]+(?=[A-Z][a-z])|[A-Z]?[a-z]+|[A-Z]+"
LINE_BREAK = r"\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\x{2028}\x{2029}]"

# Names and patterns of test code.
TEST_SEGMENTS = ("test", "tests", "__tests__", "testing", "spec", "specs")
TEST_COMPONENT = r"^test[_A-Z]|^test$|Test$|Tests$|TestCase$|Spec$"


def fold(text: Column) -> Column:
    """ASCII letters to lower case; all else stays. What case-insensitive matching means here."""
    return F.translate(text, UPPER, LOWER)


def words(text: Column) -> Column:
    """Runs of ASCII letters and digits, folded."""
    return F.regexp_extract_all(fold(F.coalesce(text, F.lit(""))), F.lit("([a-z0-9]+)"), F.lit(1))


def identifier_runs(text: Column) -> Column:
    return F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(f"({IDENTIFIER})"), F.lit(1))


def subwords(identifier: Column) -> Column:
    """Parts of an identifier: at underscores and hyphens, case changes, acronym ends and digits."""
    return F.regexp_extract_all(F.coalesce(identifier, F.lit("")), F.lit(f"({SUBWORD})"), F.lit(1))


def augmented(text: Column) -> Column:
    """The text, followed by the subwords of every identifier that has more than one."""
    extra = F.flatten(F.filter(F.transform(identifier_runs(text), subwords), lambda parts: F.size(parts) > 1))
    whole = F.coalesce(text, F.lit(""))
    return F.when(F.size(extra) > 0, F.concat(whole, F.lit(" "), F.array_join(extra, " "))).otherwise(whole)


def query_terms(query: Column) -> Column:
    """Alphanumeric terms of a question, in order; each is meant as a prefix."""
    return F.regexp_extract_all(F.coalesce(query, F.lit("")), F.lit("([A-Za-z0-9]+)"), F.lit(1))


def evidence_terms(query: Column) -> Column:
    """Terms that count as evidence: cut at white space, underscores and colons; other marks stay."""
    spaced = F.translate(F.lower(F.coalesce(query, F.lit(""))), "_:", "  ")
    return F.filter(F.split(spaced, r"\s+"), lambda t: t != "")


def lines(text: Column) -> Column:
    """Lines of a text; one empty element at the end does not count."""
    cut = F.split(F.coalesce(text, F.lit("")), LINE_BREAK, -1)
    return F.when(F.element_at(cut, -1) == "", F.slice(cut, 1, F.size(cut) - 1)).otherwise(cut)


def directory(path: Column) -> Column:
    return F.regexp_extract(path, r"^(.*)/[^/]*$", 1)


def file_name(path: Column) -> Column:
    return F.regexp_extract(path, r"([^/]*)$", 1)


def suffix(path: Column) -> Column:
    """Last extension with its dot, lower-cased; a leading dot alone makes none."""
    return F.lower(F.regexp_extract(file_name(path), r"^.+(\.[^.]+)$", 1))


def module_of(path: Column) -> Column:
    """The directory with dots; empty at the root."""
    return F.translate(directory(path), "/", ".")


def is_test(path: Column, symbol: Column) -> Column:
    """Whether a path or a full symbol name is test code: by directories, file name patterns and name components."""
    segments = F.split(F.lower(F.coalesce(path, F.lit(""))), r"[\\/]")
    name = F.element_at(segments, -1)
    folders = F.slice(segments, 1, F.size(segments) - 1)
    by_path = (
        F.exists(folders, lambda s: s.isin(*TEST_SEGMENTS))
        | name.startswith("test_") | name.startswith("test.") | name.contains("_test.")
        | name.contains(".test.") | name.contains(".spec.") | name.endswith("_test")
    )
    parts = F.split(F.coalesce(symbol, F.lit("")), r"\.")
    by_symbol = F.exists(parts, lambda c: F.lower(c).isin(*TEST_SEGMENTS) | c.rlike(TEST_COMPONENT))
    return by_path | by_symbol


def match_score(token: Column, value: Column) -> Column:
    """100 for the same text, 60 for a prefix, 30 for a part, else 0; without regard to case."""
    v, t = F.lower(F.coalesce(value, F.lit(""))), F.lower(token)
    return F.when(v == "", 0).when(v == t, 100).when(v.startswith(t), 60).when(v.contains(t), 30).otherwise(0)


def shortened(value: Column, most: int = 60) -> Column:
    flat = F.trim(F.regexp_replace(F.coalesce(value, F.lit("")), r"\s+", " "))
    return F.when(F.length(flat) > most, F.concat(F.substring(flat, 1, most), F.lit("…"))).otherwise(flat)


def last_segment(call: Column) -> Column:
    return F.substring_index(call, ".", -1)
