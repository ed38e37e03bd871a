"""Symbols, calls, literals and facts of source files.

Python is read with the standard library's parser. Other languages go through one scanner, driven by a table: comments
and strings are cut out first, declarations are then found by pattern and their bodies by matching brackets (or
``end``). These are approximations of full parsers. Calls and literals of nested definitions also count for the
definitions around them.
"""

from __future__ import annotations

import ast
import bisect
import io
import keyword
import re
import tokenize
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import accumulate, chain

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import _parse_datatype_string

from sparkscope.session import ship

STRING, COMMENT, DOCSTRING, SIGNATURE, SECTION, SOURCE, LITERALS = 300, 500, 1000, 240, 500, 8000, 60


@dataclass
class Symbol:
    name: str
    qualified_name: str
    symbol_ref: str
    symbol_type: str
    signature: str
    line_start: int
    line_end: int
    decorators: str = ""
    docstring: str = ""
    calls: list[tuple] = field(default_factory=list)
    literals: list[tuple] = field(default_factory=list)
    primary_text: str = ""


@dataclass
class Extracted:
    facts: list[tuple] = field(default_factory=list)
    symbols: list[Symbol] = field(default_factory=list)
    errors: int = 0


QUOTED = re.compile(r"\s*(?:(?P<mark>['\"`])(?P<inside>.*)(?P=mark)|(?P<bare>.*?))\s*", re.DOTALL)


def unquoted(value: str) -> str:
    """What a pair of equal quotation marks encloses; else the value without outer white space."""
    m = QUOTED.fullmatch(value)
    return m["bare"] if m["inside"] is None else m["inside"]


def module_ref(path: str, python: bool = False) -> str:
    parts = re.sub(r"(?<=[^/])\.[^./]+$", "", path).split("/")
    if python and parts[-1] == "__init__":
        parts.pop()
    return ".".join(p for p in parts if p)


def _finish(symbol: Symbol, path: str, lines: list[str]) -> Symbol:
    source = "\n".join(lines[symbol.line_start - 1 : symbol.line_end])[:SOURCE]
    calls = " ".join(c[0] for c in symbol.calls)
    literals = " ".join(v for _, v, *_ in symbol.literals[:LITERALS])
    symbol.primary_text = "\n".join([path, symbol.qualified_name, symbol.signature, symbol.decorators, symbol.docstring, f"calls: {calls}", f"literals: {literals}", source])
    return symbol


#: What any text yields, line by line: a pattern for each type of fact, whose group is the fact.
PLAIN = tuple(
    (kind, re.compile(pattern, re.MULTILINE))
    for kind, pattern in (
        ("heading", r"^[^\S\n]*(# [^\n]*\S)"),
        ("comment", r"^[^\S\n]*(#(?! [^\n]*\S)[^\n]*)"),
        ("string_literal", r"['\"]([^'\"\n]{2,300})['\"]"),
        ("config_key", r"^[^\S\n]*([A-Za-z0-9_.-]+):"),
    )
)


def plain_facts(text: str) -> list[tuple]:
    """(type, value, line, line) of every match of ``PLAIN``, in the order of lines."""
    breaks = [m.start() for m in re.finditer("\n", text)]
    found = sorted((m.start(1), kind, m[1].rstrip()[:STRING]) for kind, pattern in PLAIN for m in pattern.finditer(text))
    return [(kind, value, n, n) for at, kind, value in found for n in [bisect.bisect_left(breaks, at) + 1]]


# Python --------------------------------------------------------------------------------------------------------------


class Source:
    """A Python text whose nodes' segments are cut by offsets: lines are found once, not for each node."""

    def __init__(self, text: str):
        self.data = text.encode()
        self.starts = [0, *[m.end() for m in re.finditer(rb"\r\n|\r|\n", self.data)]]

    def of(self, node: ast.AST) -> str:
        first = self.starts[node.lineno - 1] + node.col_offset
        last = self.starts[node.end_lineno - 1] + node.end_col_offset
        return self.data[first:last].decode("utf-8", "replace")


#: Fields that hold statements, handlers and cases, in the order in which they stand; fields that hold no nodes, or contexts
#: and operators only.
BODIES, BARE = ("body", "handlers", "orelse", "finalbody", "cases"), frozenset("name names id attr arg ctx op ops module level kind type_comment tag is_async simple asname rest kwd_attrs cls_".split())


@lru_cache(None)
def _below(kind: type, bodies: bool) -> tuple[str, ...]:
    """The fields of a kind of node that may hold statements, or nodes at all."""
    return tuple(f for f in BODIES if f in kind._fields) if bodies else tuple(f for f in kind._fields if f not in BARE)


def _statements(node: ast.AST) -> Iterator[ast.AST]:
    """The statements, handlers and cases right below a node; definitions stand in no other place."""
    for name in _below(type(node), True):
        below = getattr(node, name)
        if isinstance(below, list):
            yield from below


def python(text: str, path: str, facts: bool = True) -> Extracted:
    """Facts need the text's tokens, which take as long as all else; without them only symbols are read."""
    out = Extracted()
    try:
        tree = ast.parse(text)
        tokens = list(tokenize.generate_tokens(io.StringIO(text).readline)) if facts else []
    except (SyntaxError, ValueError, tokenize.TokenError):
        found = scan(text, path, "python_scan")
        found.errors = 1
        return found
    lines, source = text.splitlines(), Source(text)
    for node in ast.walk(tree) if facts else ():
        if isinstance(node, (ast.Import, ast.ImportFrom)):
            out.facts.append(("import", source.of(node), node.lineno, node.end_lineno))
    for t in tokens:
        if t.type == tokenize.STRING:
            out.facts.append(("string_literal", unquoted(t.string)[:STRING], t.start[0], t.end[0]))
        elif t.type == tokenize.COMMENT:
            out.facts.append(("comment", t.string.strip()[:COMMENT], t.start[0], t.start[0]))
    out.facts.sort(key=lambda f: (f[2], f[0]))
    module = module_ref(path, python=True)

    def visit(node: ast.AST, classes: list[str]) -> None:
        for child in _statements(node):
            if isinstance(child, (ast.FunctionDef, ast.AsyncFunctionDef, ast.ClassDef)):
                out.symbols.append(_python_symbol(child, classes, module, path, source, lines))
            visit(child, [*classes, child.name] if isinstance(child, ast.ClassDef) else classes)

    visit(tree, [])
    return out


def _nodes(node: ast.AST) -> list[ast.AST]:
    """A node and those below it that may hold or be calls and constants, in the order of ``ast.walk``."""
    found = [node]
    for x in found:  # grows meanwhile
        for name in _below(type(x), False):
            below = getattr(x, name)
            if isinstance(below, list):
                found += [y for y in below if isinstance(y, ast.AST)]
            elif isinstance(below, ast.AST):
                found.append(below)
    return found


def _python_symbol(node, classes: list[str], module: str, path: str, source: Source, lines: list[str]) -> Symbol:
    is_class = isinstance(node, ast.ClassDef)
    first = min([node.lineno, *[d.lineno for d in node.decorator_list]])
    head = lines[first - 1].strip() if first <= len(lines) else node.name
    signature = head.rstrip(":") if is_class else head[:-1].strip() if head.endswith(":") else head
    qualified = ".".join([*classes, node.name])
    doc = "" if node.decorator_list else (ast.get_docstring(node, clean=False) or "")
    s = Symbol(node.name, qualified, f"{module}.{qualified}" if module else f"{path}::{qualified}", "class" if is_class else "function", signature, first, node.end_lineno or first, " ".join("@" + source.of(d) for d in node.decorator_list), doc[:DOCSTRING])
    for x in _nodes(node):
        if isinstance(x, ast.Call):
            called = source.of(x.func).strip()
            receiver, _, name = called.rpartition(".")
            s.calls.append((called, receiver or None, name, x.lineno, x.end_lineno))
        elif isinstance(x, ast.Constant) and isinstance(x.value, (str, bool, int, float)):
            kind = "bool" if isinstance(x.value, bool) else "string" if isinstance(x.value, str) else "number"
            s.literals.append((kind, unquoted(source.of(x))[:STRING], x.lineno, x.end_lineno))
    s.calls.sort(key=lambda c: (c[3], c[0]))
    s.literals.sort(key=lambda v: (v[2], v[1]))
    return _finish(s, path, lines)


# Other languages -----------------------------------------------------------------------------------------------------

NAME = r"[A-Za-z_$][\w$]*"
SLASHES = (r"//[^\n]*", r"/\*.*?\*/")
QUOTES = (r'"(?:\\.|[^"\\\n])*"', r"'(?:\\.|[^'\\\n])*'")
KEYWORDS = frozenset("async if for while switch catch return function sizeof new throw typeof elif else do match loop fn impl let const var class struct def in await yield and or not end then local until repeat".split())


@dataclass(frozen=True)
class Language:
    """How to scan a language. declarations: (type, pattern with a group "name"); body: braces, end, indent or line."""

    comments: tuple[str, ...] = ()
    strings: tuple[str, ...] = QUOTES
    declarations: tuple[tuple[str, str], ...] = ()
    body: str = "braces"
    imports: str | None = None
    calls: str | None = rf"(?P<call>{NAME}(?:\s*(?:\.|::|->)\s*{NAME})*!?)\s*\("
    separators: tuple[str, ...] = (".",)
    receivers: bool = True
    in_class: bool = False
    join: str = "."
    literals: bool = True
    facts: bool = True


JS = (
    ("function", rf"\bfunction\s*\*?\s*(?P<name>{NAME})\s*\("), ("class", rf"\bclass\s+(?P<name>{NAME})"),
    ("function", rf"\b(?:const|let|var)\s+(?P<name>{NAME})\s*(?::[^=\n]+)?=\s*(?:async\s*)?(?:function\b|\([^()]*\)\s*(?::[^=]+)?=>|{NAME}\s*=>)"),
    ("method", rf"(?:^|(?<=[{{;}}]))[ \t]*(?:static\s+|async\s+|get\s+|set\s+|public\s+|private\s+|protected\s+)*(?P<name>{NAME})\s*\([^()]*\)\s*(?::[^{{\n]+)?\{{"),
)
JS_STRINGS = (*QUOTES, r"`(?:\\.|[^`\\])*`")
C_LIKE = (("function", rf"^[ \t]*(?:[\w:<>~*&]+[\s*&]+)+(?P<name>[A-Za-z_~][\w:~]*)\s*\([^;{{}}]*\)\s*(?:const\s*)?\{{"),)
TABLE = {
    "javascript": Language(SLASHES, JS_STRINGS, JS, imports=r"^[ \t]*import\b[^\n]*", in_class=True),
    "typescript": Language(SLASHES, JS_STRINGS, JS, imports=r"^[ \t]*import\b[^\n]*"),
    "rust": Language(SLASHES, (QUOTES[0],), (("function", rf"\bfn\s+(?P<name>{NAME})"), ("struct", rf"\bstruct\s+(?P<name>{NAME})")), separators=("::", "."), join="::"),
    "c": Language(SLASHES, QUOTES, C_LIKE, imports=r"^[ \t]*#[ \t]*include[^\n]*", separators=("::", "->", "."), receivers=False),
    "bash": Language((r"(?<![\w$])#[^\n]*",), QUOTES, (("function", r"^[ \t]*(?:function\s+)?(?P<name>[\w-]+)\s*\(\s*\)\s*\{"), ("function", r"^[ \t]*function\s+(?P<name>[\w-]+)\s*\{")), calls=r"(?:^|[;{|&(]|\bthen\b|\bdo\b|\$\()[ \t]*(?P<call>[A-Za-z_][\w.-]*)(?=[ \t\n;)]|$)", receivers=False, literals=False),
    "lua": Language((r"--\[\[.*?\]\]", r"--[^\n]*"), QUOTES, (("function", r"\bfunction\s+(?P<name>[\w.:]+)\s*\("),), body="end", literals=False),
    "sql": Language((r"--[^\n]*", SLASHES[1]), (r"'(?:''|[^'])*'",), (("table", r"(?i)\bcreate\s+table\s+(?:if\s+not\s+exists\s+)?(?P<name>[\w.\"`]+)"),), body="statement", calls=None, literals=False, facts=False),
    "css": Language((SLASHES[1],), (), (("selector", r"(?P<name>[^{}\s][^{};]*?)\s*\{"),), calls=None, literals=False),
    "python_scan": Language((r"#[^\n]*",), QUOTES, (("function", rf"^[ \t]*(?:async\s+)?def\s+(?P<name>{NAME})"), ("class", rf"^[ \t]*class\s+(?P<name>{NAME})")), body="indent", imports=r"^[ \t]*(?:from|import)\b[^\n]*"),
}
TABLE |= {"tsx": TABLE["typescript"], "cpp": TABLE["c"]}


def _body_end(code: str, start: int, how: str) -> int:
    if how == "indent":
        begin = code.rfind("\n", 0, start) + 1
        indent = re.compile(r"[ \t]*").match(code, begin).end() - begin
        at = code.find("\n", start)
        last = at if at >= 0 else len(code)
        while 0 <= at < len(code) - 1:
            stop = code.find("\n", at + 1)
            stop = stop if stop >= 0 else len(code)
            line = code[at + 1 : stop]
            if line.strip():
                if len(line) - len(line.lstrip(" \t")) <= indent:
                    break
                last = stop
            at = stop
        return last
    if how == "statement":
        at = code.find(";", start)
        return at + 1 if at >= 0 else len(code)
    if how == "end":
        depth = 0
        for m in re.compile(r"\b(function|if|for|while|repeat|end|until)\b").finditer(code, start):
            depth += -1 if m[1] in ("end", "until") else 1
            if depth <= 0:
                return m.end()
        return len(code)
    depth, opened = 0, False
    for m in re.compile(r"[{};]").finditer(code, start):
        if m[0] == "{":
            depth, opened = depth + 1, True
        elif m[0] == "}":
            depth -= 1
            if opened and depth <= 0:
                return m.end()
        elif not opened:
            return m.end()
    return len(code)


def scan(text: str, path: str, language: str) -> Extracted:
    """Facts and symbols by the language's table. Strings and comments are blanked, so that nothing inside is code."""
    how, out, lines = TABLE[language], Extracted(), text.splitlines()
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]

    def line_of(at: int) -> int:
        return bisect.bisect_right(starts, at)

    code = text
    literals: list[tuple[int, tuple]] = []
    pattern = "|".join([*(f"(?P<c{i}>{p})" for i, p in enumerate(how.comments)), *(f"(?P<s{i}>{p})" for i, p in enumerate(how.strings))])
    if pattern:
        pieces, last = [], 0
        for m in re.finditer(pattern, text, re.DOTALL | re.MULTILINE):
            first, final = line_of(m.start()), line_of(max(m.start(), m.end() - 1))
            if not how.facts:
                pass
            elif m.lastgroup and m.lastgroup[0] == "c":
                out.facts.append(("comment", m[0].strip()[:COMMENT], first, final))
            else:
                out.facts.append(("string_literal", unquoted(m[0])[:STRING], first, final))
                literals.append((m.start(), ("string", unquoted(m[0])[:STRING], first, final)))
            pieces += [text[last : m.start()], re.sub(r"[^\n]", " ", m[0])]
            last = m.end()
        code = "".join([*pieces, text[last:]])
    if how.imports:
        for m in re.finditer(how.imports, text, re.MULTILINE):
            out.facts.append(("import", m[0].strip(), line_of(m.start()), line_of(m.end())))
    if how.literals:
        literals += [(m.start(), ("number", m[0], line_of(m.start()), line_of(m.start()))) for m in re.finditer(r"(?<![\w.])\d+(?:\.\d+)?", code)]
        literals.sort()
    if language == "css":
        out.facts += [("css_value", m[1].strip()[:STRING], line_of(m.start(1)), line_of(m.end(1))) for m in re.finditer(r":\s*([^;:{}]+)[;}]", code)]
    out.facts.sort(key=lambda f: (f[2], f[0]))

    spans: dict[int, tuple] = {}
    for kind, declared in how.declarations:
        for m in re.finditer(declared, code, re.MULTILINE):
            name = m["name"].strip().strip('"`')
            if name in KEYWORDS or m.start("name") in spans:
                continue
            begin = m.start() + len(m[0]) - len(m[0].lstrip())
            spans[m.start("name")] = (begin, _body_end(code, m.start() if how.body == "end" else m.start("name"), how.body), kind, name)
    declared_at = set(spans)
    calls = []
    for m in re.finditer(how.calls, code, re.MULTILINE) if how.calls else ():
        called = re.sub(r"\s+", "", m["call"])
        if called not in KEYWORDS and m.start("call") not in declared_at:
            cut = max(called.rfind(s) + len(s) if s in called else 0 for s in how.separators)
            name = called[cut:]
            receiver = next((called[: cut - len(s)] for s in how.separators if called[:cut].endswith(s)), None) if cut and how.receivers else None
            n = line_of(m.start("call"))
            calls.append((m.start("call"), (called, receiver or None, name, n, n)))
    module = module_ref(path)
    # Calls and literals are in order, so those of a symbol are a range; classes around a symbol lie on a stack.
    call_at, literal_at, around = [at for at, _ in calls], [at for at, _ in literals], []
    for begin, end, kind, name in sorted(spans.values()):
        while around and around[-1][1] <= begin:
            around.pop()
        if language == "css":
            name = name.split(",", 1)[0].strip()
        owners = [x[2] for x in around if x[0] < begin and end <= x[1]]
        qualified = ".".join([*owners, name])
        if how.in_class and kind == "class":
            around.append((begin, end, name))
        if language == "sql":
            ref, signature = f"{module}.create_table_{name}", f"CREATE TABLE {name}"
        elif language == "css":
            ref, signature = f"{module}.{name.lstrip('.')}", name
        else:
            ref = f"{module}{how.join}{qualified}"
            signature = re.split(r"\{|\n", text[begin:end], maxsplit=1)[0].strip()[:SIGNATURE]
        own_calls = calls[bisect.bisect_left(call_at, begin) : bisect.bisect_left(call_at, end)]
        own_literals = literals[bisect.bisect_left(literal_at, begin) : bisect.bisect_left(literal_at, end)] if how.literals else []
        s = Symbol(name, qualified, ref, kind, signature, line_of(begin), line_of(max(begin, end - 1)), calls=[c for _, c in own_calls], literals=[v for _, v in own_literals])
        out.symbols.append(_finish(s, path, lines))
    return out


def html(text: str) -> Extracted:
    out = Extracted()
    starts = [0, *[m.end() for m in re.finditer("\n", text)]]
    line = lambda at: bisect.bisect_right(starts, at)
    quiet = text
    for kind, pattern in (("comment", r"<!--.*?-->"), ("section_script", r"(?i)<script\b.*?</script\s*>"), ("section_style", r"(?i)<style\b.*?</style\s*>")):
        for m in re.finditer(pattern, quiet, re.DOTALL):
            out.facts.append((kind, m[0].strip()[:SECTION], line(m.start()), line(m.end())))
        quiet = re.sub(pattern, lambda m: (m[0][:7] if m[0][:2] != "<!" else "").ljust(len(m[0])) if "\n" not in m[0] else re.sub(r"[^\n]", " ", m[0]), quiet, flags=re.DOTALL)
    for m in re.finditer(r"<([A-Za-z][\w-]*)", quiet):
        out.facts.append(("html_tag", m[1], line(m.start()), line(m.start())))
    out.facts.sort(key=lambda f: (f[2], f[0]))
    return out


def extract(text: str, path: str, language: str | None, facts: bool = True) -> Extracted:
    """``facts`` says whether a Python text's facts are wanted; those of other languages come with their symbols."""
    if language == "python":
        return python(text, path, facts)
    if language == "html":
        return html(text)
    if language in TABLE:
        return scan(text, path, language)
    return Extracted(facts=plain_facts(text))


FACT = "struct<fact_type:string,value:string,line_start:int,line_end:int>"
CALL = "struct<call_text:string,receiver:string,function_name:string,line_start:int,line_end:int>"
LITERAL = "struct<literal_type:string,value:string,line_start:int,line_end:int>"
SYMBOL = f"struct<name:string,qualified_name:string,symbol_ref:string,symbol_type:string,signature:string,decorators:string,docstring:string,line_start:int,line_end:int,primary_text:string,calls:array<{CALL}>,literals:array<{LITERAL}>>"


NAMES = {"calls": ("call_text", "receiver", "function_name", "line_start", "line_end"), "literals": ("literal_type", "value", "line_start", "line_end")}
KINDS = dict(re.findall(r"(\w+):(string|int|array<struct<.*?>>)", SYMBOL.removeprefix("struct<")))
#: Symbols and facts of a batch that a worker hands over, about: what it holds at once.
BATCH = 20_000
#: Blocks of Python texts whose symbols a worker remembers, shapes of blocks, and characters of the longest of them.
BLOCKS, SHAPES, BLOCK_CHARS = 100_000, 2_000, 300


def _leaves(fields: tuple[str, ...]) -> list[str]:
    """The columns that ``fields`` of symbols are handed over in: those of a list are its lengths and each of its parts."""
    found = []
    for f in fields:
        name, _, part = f.partition(".")
        found += [name, *(f"{name}.{p}" for p in ([part] if part else NAMES[name]))] if name in NAMES else [name]
    return list(dict.fromkeys(found))


@lru_cache(4)
def _places(leaves: tuple[str, ...]) -> tuple[tuple, ...]:
    return tuple((leaf, None, leaf in NAMES) if not part else (name, NAMES[name].index(part), False) for leaf in leaves for name, _, part in [leaf.partition(".")])


def _columns(symbols: list[Symbol], leaves: tuple[str, ...]) -> list[tuple]:
    out = []
    for name, part, many in _places(leaves):
        own = [getattr(s, name) for s in symbols]
        out.append(tuple(own if part is None and not many else map(len, own) if many else [x[part] for o in own for x in o]))
    return out


def _block_symbols(text: str) -> list[Symbol]:
    """The symbols of a block of a Python text, read as a text by itself that has no path, with full names as references. A
    ValueError if it can't be, or holds marks that end lines for Python's strings alone."""
    found = python(text, "", facts=False)
    if found.errors or len(text.splitlines()) != text.count("\n"):
        raise ValueError("no block by itself")
    for s in found.symbols:
        s.symbol_ref = s.qualified_name
    return found.symbols


def _block(text: str, leaves: tuple[str, ...]) -> tuple[int, *tuple[tuple, ...]]:
    """The number and the columns of a block's symbols."""
    found = _block_symbols(text)
    return len(found), *_columns(found, leaves)


#: Names, which the parser treats alike but for these; what keeps a block from being read with other names in it: more than
#: ASCII, strings, comments, continued lines and numbers that end in a point.
NAMED, RESERVED, ODD = re.compile(r"(?<!\w)[A-Za-z_]\w*"), frozenset((*keyword.kwlist, *keyword.softkwlist)), re.compile(r"[^\x09\x0a\x20-\x7e]|['\"#\\]|\d\.")
PUT = re.compile(r"zq(\d+)q")


def _shape(text: str, leaves: tuple[str, ...]) -> tuple | None:
    """(symbols, columns, text, names) of a block whose names are numbered: the strings of its columns, one after the other
    with zeros between, with a place for each of the numbered names. None if other names may change the order of calls."""
    found = _block_symbols(text)
    if any(len({c[3] for c in s.calls}) < len(s.calls) for s in found):
        return None
    columns = _columns(found, leaves)
    held, *rest = PUT.split("\0".join(v for c in columns for v in c if isinstance(v, str)).replace("%", "%%"))
    return len(found), columns, "%s".join([held, *rest[1::2]]), tuple(map(int, rest[::2]))


def _filled(text: str, leaves: tuple[str, ...], shapes: Callable[[str], tuple | None]) -> tuple[int, *tuple[tuple, ...]]:
    """``_block``, through the shape of a block: texts that differ in names only are parsed once."""
    if ODD.search(text):
        return _block(text, leaves)
    numbers: dict[str, int] = {}
    shape = shapes(NAMED.sub(lambda m: m[0] if m[0] in RESERVED else f"zq{numbers.setdefault(m[0], len(numbers))}q", text))
    if shape is None:
        return _block(text, leaves)
    n, columns, held, places = shape
    names = tuple(numbers)
    strings = iter((held % tuple([names[i] for i in places])).split("\0"))
    return n, *[tuple([next(strings) if isinstance(v, str) else v for v in c]) for c in columns]


@lru_cache(4)
def _definitions(leaves: tuple[str, ...]) -> Callable[[str], tuple]:
    """``_block`` for a definition without its first word and its last line's end, with a memory."""
    shapes = lru_cache(SHAPES)(lambda text: _shape(text, leaves))
    return lru_cache(BLOCKS)(lambda rest: _filled(f"def {rest}\n", leaves, shapes))


def python_blocks(text: str, path: str, leaves: tuple[str, ...], out: list[list]) -> int | None:
    """Adds the columns of a Python text's symbols to ``out`` and returns their number; None, and nothing added, if the text
    has to be read in one.

    A text is cut before functions that begin a line. Blocks that can all be read by themselves are, one after the other,
    the text: none of them ends inside brackets, a string, a decorated definition or a continued line. Texts repeat many
    short blocks, so a worker remembers what it found in them. Blocks that differ in names only are parsed once.
    """
    if "__future__" in text:  # may change how the rest is read
        return None
    head, *rest = f"\n{text.removesuffix('\n')}".split("\ndef ")
    known = _definitions(leaves)
    try:
        found = [_block(f"{head[1:]}\n", leaves)] if head else []
        found += [known(x) if len(x) <= BLOCK_CHARS else _block(f"def {x}\n", leaves) for x in rest]
    except ValueError:
        return None
    if not found:
        return 0
    module = module_ref(path, python=True)
    before = f"{module}." if module else f"{path}::"
    sizes, *columns = zip(*found)
    for leaf, into, held in zip(leaves, out, columns):
        if leaf == "symbol_ref":
            into += [before + v for v in chain.from_iterable(held)]
        elif leaf == "primary_text":
            into += [path + v for v in chain.from_iterable(held)]
        elif leaf.rpartition(".")[2] in ("line_start", "line_end"):
            lines = [b.count("\n") + 1 for b in ([head[1:]] if head else []) + rest]
            into += [v + shift for shift, block in zip(accumulate(lines, initial=0), held) for v in block]
        else:
            into += chain.from_iterable(held)
    return sum(sizes)


def extract_files(files: DataFrame, facts: bool = True, fields: tuple[str, ...] = tuple(KINDS)) -> DataFrame:
    """(repo, file_id, path, language) of (…, text) with parse_errors, facts and symbols as nested rows.

    Without ``facts`` there is no such column; of symbols only ``fields`` are given, of their calls and literals as well if
    these are named as in ``calls.call_text``. Files are dealt out to all cores, and a worker hands its rows over once they
    hold ``BATCH`` symbols and facts.
    """
    ship(files.sparkSession)
    kind = dict(files.dtypes)["file_id"]
    leaves = tuple(_leaves(fields))
    tops = [x for x in leaves if "." not in x]
    parts = {x: [y.partition(".")[2] for y in leaves if y.startswith(f"{x}.")] for x in tops}
    inner = {x: dict(re.findall(r"(\w+):(\w+)", k)) for x, k in (("calls", CALL), ("literals", LITERAL))}
    kinds = {x: f"array<struct<{','.join(f'{y}:{inner[x][y]}' for y in parts[x])}>>" if x in NAMES else KINDS[x] for x in tops}
    symbol = f"struct<{','.join(f'{k}:{v}' for k, v in kinds.items())}>"
    schema = f"repo string, file_id {kind}, path string, language string, parse_errors int, {f'facts array<{FACT}>, ' if facts else ''}symbols array<{symbol}>"
    types = [f.type for f in to_arrow_schema(_parse_datatype_string(schema))]
    columns = [c.strip().split(" ", 1)[0] for c in re.split(r", ", schema)]

    def lists(sizes: list[int], values: pa.Array, t: pa.DataType) -> pa.Array:
        return pa.ListArray.from_arrays(pa.array(accumulate(sizes, initial=0), pa.int32()), values, type=t)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def ready() -> pa.RecordBatch:
            struct, arrays = types[-1].value_type, []
            for i, name in enumerate(tops):
                t, own = struct.field(i).type, held[leaves.index(name)]
                if name in NAMES:
                    rows = [pa.array(held[leaves.index(f"{name}.{y}")], t.value_type.field(y).type) for y in parts[name]]
                    arrays.append(lists(own, pa.StructArray.from_arrays(rows, fields=list(t.value_type)), t))
                else:
                    arrays.append(pa.array(own, t))
            nested = lists(sizes, pa.StructArray.from_arrays(arrays, fields=list(struct)), types[-1])
            return pa.RecordBatch.from_arrays([*(pa.array(x, t) for x, t in zip(zip(*rows_out), types)), nested], columns)

        rows_out, sizes, held, count = [], [], [[] for _ in leaves], 0
        for batch in batches:
            for row in zip(*(batch.column(c) for c in ("repo", "file_id", "path", "language", "text"))):
                repo, file_id, path, language, text = (x.as_py() for x in row)
                found, n, errors = [], None, 0
                if language == "python" and not facts:
                    n = python_blocks(text or "", path, leaves, held)
                if n is None:
                    e = extract(text or "", path, language, facts)
                    n, errors = len(e.symbols), e.errors
                    for into, more in zip(held, _columns(e.symbols, leaves)):
                        into += more
                    found = [dict(zip(("fact_type", "value", "line_start", "line_end"), f)) for f in e.facts] if facts else []
                rows_out.append((repo, file_id, path, language, errors, *([found] if facts else [])))
                sizes.append(n)
                count += 1 + n + len(found)
                if count >= BATCH:
                    yield ready()
                    rows_out, sizes, held, count = [], [], [[] for _ in leaves], 0
        if rows_out:
            yield ready()

    return files.select("repo", "file_id", "path", "language", "text").mapInArrow(run, schema)
