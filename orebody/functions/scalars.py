"""Scalar functions of the engine: hashes, ids, paths, languages, names. All are Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Language of each file extension; others are plaintext.
LANGUAGES = {
    "javascript": (".js", ".jsx", ".mjs", ".cjs"),
    "typescript": (".ts", ".tsx"),
    "python": (".py", ".pyw", ".pyi"),
    "java": (".java",),
    "kotlin": (".kt", ".kts"),
    "scala": (".scala",),
    "c": (".c", ".h"),
    "cpp": (".cpp", ".hpp", ".cc", ".hh", ".cxx"),
    "csharp": (".cs",),
    "go": (".go",),
    "rust": (".rs",),
    "ruby": (".rb",),
    "php": (".php",),
    "swift": (".swift",),
    "shell": (".sh", ".bash", ".zsh"),
    "html": (".html", ".htm"),
    "css": (".css",),
    "scss": (".scss",),
    "sass": (".sass",),
    "less": (".less",),
    "vue": (".vue",),
    "svelte": (".svelte",),
    "json": (".json",),
    "yaml": (".yaml", ".yml"),
    "toml": (".toml",),
    "xml": (".xml",),
    "markdown": (".md", ".mdx"),
    "rst": (".rst",),
    "sql": (".sql",),
    "dart": (".dart",),
    "lua": (".lua",),
    "r": (".r",),
    "dockerfile": (".dockerfile",),
}
BY_EXTENSION = {ext: lang for lang, exts in LANGUAGES.items() for ext in exts}
#: Extensions indexed beside those above, and names indexed whatever their extension.
OTHER_INDEXED = (".ini", ".cfg", ".txt")
SPECIAL_FILES = ("Dockerfile", "Makefile", "Rakefile", "Gemfile", "Procfile", ".env.example", ".gitignore", ".dockerignore")
#: Extensions read as css in the graph, and languages with symbols and imports.
STYLE_DIALECTS = (".styl",)
GRAPH_LANGUAGES = ("javascript", "typescript", "python", "java", "kotlin", "scala", "c", "cpp", "csharp", "go", "rust", "ruby", "php", "swift", "shell", "html", "css", "scss", "sass", "less", "vue", "svelte", "dart", "lua")


def content_hash(content: Column) -> Column:
    return F.substring(F.sha2(content, 256), 1, 16)


def full_hash(content: Column) -> Column:
    return F.sha2(content, 256)


def uuid_of(text: Column) -> Column:
    """The first 32 hexadecimal digits of the SHA-256 with dashes as in a UUID."""
    h = F.sha2(text, 256)
    return F.concat_ws("-", *(F.substring(h, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))


def chunk_id(path: Column, start_line: Column) -> Column:
    return uuid_of(F.concat(path, F.lit(":"), start_line.cast("string")))


def artifact_chunk_id(path: Column, name: Column, start: Column) -> Column:
    """start counts lines from 0."""
    return uuid_of(F.concat(F.lit("context:"), path, F.lit(":"), name, F.lit(":"), start.cast("string")))


def forward_slashes(path: Column) -> Column:
    return F.translate(path, "\\", "/")


def base_name(path: Column) -> Column:
    return F.element_at(F.split(forward_slashes(path), "/"), -1)


def extension(path: Column) -> Column:
    """Lower-case extension with its dot; a name's leading dot starts none."""
    return F.lower(F.regexp_extract(base_name(path), r"^.+(\.[^.]*)$", 1))


def language(path: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in BY_EXTENSION.items() for x in pair))
    return F.coalesce(F.element_at(table, extension(path)), F.lit("plaintext"))


def grammar(path: Column) -> Column:
    """The language by which a file's imports and symbols are read."""
    return F.when(extension(path).isin(*STYLE_DIALECTS), "css").otherwise(language(path))


def extensions_of(value: str | None) -> list[str]:
    """A comma-separated list as extensions: trimmed, lower-case, with a dot, no empty ones, each once."""
    parts = [p.strip().lower() for p in (value or "").split(",")]
    return list(dict.fromkeys(p if p.startswith(".") else f".{p}" for p in parts if p))


def merged_extensions(*values: str | None) -> list[str]:
    return list(dict.fromkeys(e for v in values for e in extensions_of(v)))


def is_indexable(path: Column, extra: list[str] = ()) -> Column:
    return base_name(path).isin(*SPECIAL_FILES) | extension(path).isin(*BY_EXTENSION, *OTHER_INDEXED, *extra)


def is_graphable(path: Column, extra: list[str] = ()) -> Column:
    known = grammar(path).isin(*GRAPH_LANGUAGES)
    return known | extension(path).isin(*extra) if extra else known


def document_text(path: Column, content: Column) -> Column:
    return F.concat(F.lit("search_document: "), path, F.lit("\n"), content)


def query_text(query: Column) -> Column:
    return F.concat(F.lit("search_query: "), query)


def truncated(text: Column, tokens: int, chars_per_token: float) -> Column:
    """What fits a model's context: ratio 1.0 for local models, 3.0 for others."""
    return F.substring(text, 1, int(tokens * chars_per_token))


def capped(content: Column, limit: int = 2000) -> Column:
    return F.substring(content, 1, limit)


def branch_name(name: Column) -> Column:
    """Letters, digits and underscores; runs of underscores become one, and one goes at each end."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(name, "[^A-Za-z0-9_]", "_"), "_+", "_"), "^_|_$", "")


def project_id(absolute_path: Column, branch: Column | None = None) -> Column:
    own = F.substring(F.sha2(absolute_path, 256), 1, 12)
    return own if branch is None else F.concat(own, F.coalesce(F.concat(F.lit("__"), F.nullif(branch_name(branch), F.lit(""))), F.lit("")))


def name_shard(name: Column) -> Column:
    first = F.lower(F.substring(name, 1, 1))
    return F.when(first.rlike("^[a-z]$"), first).otherwise("_")


def reverse_shard(path: Column) -> Column:
    return F.conv(F.substring(F.sha2(path, 256), 1, 2), 16, 10).cast("int")


def symbol_file(symbol_id: Column) -> Column:
    """The part before `::`; null if there is none or it is empty."""
    return F.when(F.instr(symbol_id, "::") > 1, F.substring_index(symbol_id, "::", 1))


def looks_like_path(text: Column) -> Column:
    return text.rlike(r"[/\\]|\.[A-Za-z]{1,5}$")


def callee_name(call: Column) -> Column:
    """Last name of the dotted chain before the first bracket; null if it is no identifier."""
    last = F.element_at(F.split(F.trim(F.substring_index(call, "(", 1)), r"\.|::|->"), -1)
    return F.when(last.rlike(r"^[A-Za-z_$][\w$]*$"), last)


def html_escaped(text: Column) -> Column:
    for plain, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#39;")):
        text = F.replace(text, F.lit(plain), F.lit(entity))
    return text


def json_in_html(json: Column) -> Column:
    return F.replace(json, F.lit("<"), F.lit("\\u003c"))


def clamped(value: int | float | None, low: float, high: float, default: float):
    """A request's number: default for none or nonsense, else within low and high."""
    if value is None or value != value or value == 0 and low > 0:
        return default
    return max(low, min(high, value))


def score_text(score: Column, digits: int = 4) -> Column:
    return F.format_string(f"%.{digits}f", score.cast("double"))


def seconds_since(moment: Column) -> Column:
    return F.unix_timestamp() - F.unix_timestamp(moment)


def is_minified(content: Column, most: int = 500) -> Column:
    return F.length(content) / F.size(F.split(content, "\n", -1)) > most
