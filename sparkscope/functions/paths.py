"""Classification of paths: kind, language, and whether a file is indexed. One ``when`` chain each."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from sparkscope.functions.text import file_name, suffix

# Extensions and names by kind.
SOURCE = (".bash", ".c", ".cc", ".cpp", ".cs", ".css", ".go", ".h", ".hpp", ".html", ".java", ".js", ".jsx", ".lua", ".mjs", ".cjs", ".py", ".rs", ".sh", ".sql", ".ts", ".tsx")
CONFIG = (".cfg", ".conf", ".env", ".ini", ".json", ".lock", ".mk", ".toml", ".yaml", ".yml")
DOCS = (".md", ".mdx", ".rst", ".txt")
USEFUL = ("Dockerfile", "Containerfile", "Makefile", "makefile", "README", "LICENSE", "CHANGELOG", "NOTICE", "requirements.txt", "Pipfile", "pyproject.toml", "package.json", "tsconfig.json")
ENVIRONMENT = (".env", ".env.local", ".envrc")
BY_SUFFIX = {
    "archive": (".7z", ".bz2", ".gz", ".rar", ".tar", ".tgz", ".xz", ".zip", ".zst"),
    "media": (".apng", ".avif", ".bmp", ".gif", ".ico", ".jpeg", ".jpg", ".mov", ".mp3", ".mp4", ".ogg", ".png", ".wav", ".webm", ".webp"),
    "font": (".eot", ".otf", ".ttf", ".woff", ".woff2"),
    "model": (".bin", ".gguf", ".h5", ".onnx", ".pt", ".pth", ".safetensors"),
    "database": (".db", ".sqlite", ".sqlite3"),
}
DUMP = (".bak", ".dump", ".dmp", ".har", ".pcap")
CACHE = (".coverage", ".pyc", ".pyo", ".swp", ".tmp")
GENERATED_FOLDERS = ("dist", "coverage", ".coverage", ".cache", "cache", "target", "build")
GENERATED_MARKS = (".generated.", ".gen.", ".min.")
IGNORED = (".git", ".venv", "__pycache__", ".mypy_cache", ".pytest_cache", "node_modules", ".sparkscope")
LANGUAGES = {
    ".bash": "bash", ".c": "c", ".cc": "cpp", ".cpp": "cpp", ".cs": "c-sharp", ".css": "css", ".go": "go", ".h": "c", ".hpp": "cpp",
    ".html": "html", ".java": "java", ".json": "json", ".py": "python", ".js": "javascript", ".jsx": "javascript", ".mjs": "javascript",
    ".cjs": "javascript", ".ts": "typescript", ".tsx": "tsx", ".lua": "lua", ".mk": "make", ".md": "markdown", ".rs": "rust",
    ".regex": "regex", ".sql": "sql", ".sh": "bash", ".toml": "toml", ".yaml": "yaml", ".yml": "yaml",
}
SAMPLE_BYTES, MAX_BYTES, SMALL_TEXT = 8192, 524288, 65536


def kind_of(path: Column) -> Column:
    """log, config, archive, media, font, model, database, dump, cache, generated, source, docs or unknown.

    Folders are judged within the repository, not by where it is checked out.
    """
    name, low, ext = file_name(path), F.lower(file_name(path)), suffix(path)
    chain = F.when((low == "nohup.out") | (ext == ".log") | low.endswith(".log.txt"), "log")
    chain = chain.when(name.isin(*ENVIRONMENT) | low.startswith(".env."), "config")
    for kind, extensions in BY_SUFFIX.items():
        chain = chain.when(ext.isin(*extensions), kind)
    chain = chain.when(ext.isin(*DUMP) | low.contains("dump"), "dump").when(ext.isin(*CACHE), "cache")
    marks = F.lit(False)
    for mark in GENERATED_MARKS:
        marks = marks | low.contains(mark)
    built = F.exists(F.split(F.lower(path), "/"), lambda p: p.isin(*GENERATED_FOLDERS))
    chain = chain.when(low.endswith(".map") | marks | built, "generated")
    chain = chain.when(ext.isin(*SOURCE), "source").when(ext.isin(*CONFIG) | name.isin(*USEFUL), "config")
    return chain.when(ext.isin(*DOCS), "docs").otherwise("unknown")


def language_of(path: Column, text: Column) -> Column:
    """Language by extension, file name, or the first line's interpreter; null if none is known."""
    table = F.create_map(*[F.lit(x) for pair in LANGUAGES.items() for x in pair])
    name = file_name(path)
    first = F.substring_index(F.coalesce(text, F.lit("")), "\n", 1)
    script = first.startswith("#!")
    named = F.when(name == "Dockerfile", "dockerfile").when(name.isin("Makefile", "makefile"), "make")
    named = named.when(script & first.contains("python"), "python").when(script & first.contains("sh"), "bash")
    return F.coalesce(F.element_at(table, suffix(path)), named)


def is_binary(sample: Column) -> Column:
    """A NUL byte, or over 30 per cent of control bytes (below 9, or 14 to 31)."""
    digits = F.hex(sample)
    pairs = F.regexp_replace(digits, "(..)", "$1 ")
    control = F.regexp_count(pairs, F.lit(r"0[0-8] |0[EF] |1[0-9A-F] "))
    return F.coalesce((F.octet_length(sample) > 0) & ((F.regexp_count(pairs, F.lit("00 ")) > 0) | (control > 0.3 * F.octet_length(sample))), F.lit(False))


def decision(path: Column, size: Column, sample: Column, max_bytes: int = MAX_BYTES) -> Column:
    """struct(decision, reason, kind) of the automatic rules; ``sample`` holds the first bytes of the file.

    A null size stands for a missing file.
    """
    kind, name, ext = kind_of(path), file_name(path), suffix(path)
    text = F.make_valid_utf8(sample.cast("string"))
    language = language_of(path, text)

    def out(choice: str, reason, of) -> Column:
        as_column = lambda x: F.lit(x) if isinstance(x, str) else x
        return F.struct(F.lit(choice).alias("decision"), as_column(reason).alias("reason"), as_column(of).alias("kind"))

    unwanted = kind.isin("archive", "media", "font", "model", "database", "dump", "log", "cache", "generated")
    by_language = F.when(language.isin("dockerfile", "json", "make", "toml", "yaml"), "config").otherwise("source")
    chain = F.when(F.exists(F.split(path, "/"), lambda p: p.isin(*IGNORED)), out("exclude", "structural_ignored_part", "cache"))
    chain = chain.when(size.isNull(), out("exclude", "missing", "unknown"))
    chain = chain.when(size > max_bytes, out("exclude", "too_large", kind))
    chain = chain.when(name.isin(*ENVIRONMENT) | F.lower(name).startswith(".env."), out("exclude", "env_file", "config"))
    chain = chain.when(unwanted, out("exclude", F.concat(kind, F.lit("_file")), kind))
    chain = chain.when(sample.isNull(), out("exclude", "unreadable", "unknown"))
    chain = chain.when(is_binary(sample), out("exclude", "binary_sample", "binary"))
    chain = chain.when(ext.isin(*SOURCE), out("include", "known_source_or_language", "source"))
    chain = chain.when(ext.isin(*CONFIG) | name.isin(*USEFUL), out("include", "known_config", "config"))
    chain = chain.when(ext.isin(*DOCS), out("include", "known_docs", "docs"))
    chain = chain.when(language.isNotNull(), out("include", "known_source_or_language", by_language))
    chain = chain.when(F.is_valid_utf8(sample.cast("string")) & (size <= min(max_bytes, SMALL_TEXT)), out("include", "small_text_fallback", "docs"))
    return chain.otherwise(out("exclude", "unknown_kind", "unknown"))


def rule_priority(rule_path: Column, path_kind: Column, action: Column, path: Column) -> Column:
    """4 for a file's include, 3 for its exclude, 2 and 1 for those of a folder above it; null if the rule is about others."""
    target = F.rtrim(rule_path, F.lit("/"))
    return (
        F.when((path_kind == "file") & (path == target), F.when(action == "include", 4).otherwise(3))
        .when((path_kind == "dir") & ((path == target) | path.startswith(F.concat(target, F.lit("/")))), F.when(action == "include", 2).otherwise(1))
    )
