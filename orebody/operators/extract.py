"""Extraction of imports, symbols and calls from source text: file rows to many rows.

Comments and strings are masked first (blanks of the same length, so positions hold). Imports are patterns a language,
native but for Python and components, which need a parse. Symbols come from declarations found by pattern and the extent
of their block: braces, indentation or an `end` word; Python uses its own parser. There is no grammar library here, so
declarations that a line pattern cannot tell are missed; a file that cannot be parsed gives its `<module>` symbol alone.
"""

from __future__ import annotations

import ast
import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MODULE = "<module>"
JS, STYLES, JVM = ("javascript", "typescript"), ("css", "scss", "sass", "less"), ("java", "kotlin", "scala")
COMPONENTS = ("svelte", "vue")

#: Import patterns; the first group is the specifier. Masked text keeps strings, so quoted specifiers can be read.
IMPORTS: dict[tuple[str, ...], tuple[tuple[str, bool], ...]] = {
    JS: ((r"""(?m)\bimport\s+(?:type\s+)?(?:[\w*{}$,\s]+?\s+from\s+)?["']([^"'\n]+)["']""", False), (r"""(?m)\bexport\s+(?:type\s+)?[\w*{}$,\s]+?\s+from\s+["']([^"'\n]+)["']""", False), (r"""\brequire\s*\(\s*["']([^"'\n]+)["']""", False), (r"""\bimport\s*\(\s*["'`]([^"'`\n]+)["'`]""", True)),
    STYLES: ((r"""(?m)@(?:import|require)\s+(?:url\(\s*)?["']?((?!https?:)[^"')\s;]+)""", False),),
    ("java",): ((r"(?m)^\s*import\s+(?:static\s+)?([\w.]+(?:\.\*)?)\s*;", False),),
    ("kotlin", "scala", "swift"): ((r"(?m)^\s*import\s+([\w.]+(?:\.\*)?)", False),),
    ("go",): ((r"""(?m)^\s*import\s+(?:[\w.]+\s+)?"([^"\n]+)\"""", False), (r"""(?m)^\s+(?:[\w.]+\s+)?"([^"\n]+)"\s*$""", False)),
    ("rust",): ((r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?use\s+([^;{]+?)\s*(?:;|::\{)", False), (r"(?m)^\s*(?:pub(?:\([^)]*\))?\s+)?mod\s+(\w+)\s*;", False)),
    ("csharp",): ((r"(?m)^\s*(?:global\s+)?using\s+(?:static\s+)?([\w.]+)\s*;", False),),
    ("ruby",): ((r"""(?m)^\s*require(?:_relative)?\s*\(?\s*["']([^"'\n]+)["']""", False),),
    ("c", "cpp"): ((r"""(?m)^\s*#\s*include\s*"([^"\n]+)\"""", False),),
    ("php",): ((r"(?m)^\s*use\s+(?:function\s+|const\s+)?([\w\\]+(?:\{[^}]*\}|\s*(?:as\s+\w+\s*)?(?:,\s*[\w\\]+\s*(?:as\s+\w+\s*)?)*))\s*;", False), (r"""\b(?:require|include)(?:_once)?\s*\(?\s*["']([^"'\n]+)["']""", False)),
    ("shell",): ((r"""(?m)^\s*(?:source|\.)\s+["']?([^"'\s;]+)""", False),),
    ("dart",): ((r"""(?m)^\s*(?:import|export|part)\s+["']([^"'\n]+)["']""", False),),
    ("lua",): ((r"""\b(?:require|dofile|loadfile)\s*\(?\s*["']([^"'\n]+)["']""", False),),
}
#: Comments by family; block comments may span lines.
C_COMMENTS, HASH_COMMENTS, LUA_COMMENTS = r"(?s)/\*.*?\*/|//[^\n]*", r"(?m)(?<![\w$'\"])#[^\n!]*", r"(?s)--\[\[.*?\]\]|--[^\n]*"


def comment_pattern(language: str) -> str | None:
    if language in ("python", "ruby", "shell"):
        return HASH_COMMENTS
    if language == "lua":
        return LUA_COMMENTS
    return C_COMMENTS


def python_imports(text: str) -> list[str]:
    try:
        tree = ast.parse(text)
    except (SyntaxError, ValueError, RecursionError):
        return [m[1] or m[2] for m in re.finditer(r"(?m)^\s*(?:from\s+([.\w]+)\s+import|import\s+([\w.]+))", text)]
    out = []
    for node in ast.walk(tree):
        if isinstance(node, ast.Import):
            out += [(node.lineno, a.name) for a in node.names]
        elif isinstance(node, ast.ImportFrom):
            out.append((node.lineno, "." * node.level + (node.module or "")))
    return [name for _, name in sorted(out, key=lambda x: x[0])]


def parts_of_component(text: str) -> tuple[str, str]:
    """The scripts and the styles of a component file."""
    take = lambda tag: "\n".join(re.findall(rf"(?is)<{tag}\b[^>]*>(.*?)</{tag}>", text))
    return take("script"), take("style")


def file_imports(text: str, language: str) -> list[tuple[str, bool, bool]]:
    """specifier, dynamic and style of one file's imports; what imports_of() does natively for most languages."""
    if language == "python":
        return [(s, False, False) for s in python_imports(text)]
    if language in COMPONENTS:
        script, style = parts_of_component(text)
        script = re.sub(C_COMMENTS, " ", script)
        return [(m, dyn, False) for p, dyn in IMPORTS[JS] for m in re.findall(p, script)] + [(m, False, True) for p, _ in IMPORTS[STYLES] for m in re.findall(p, style)]
    patterns = next((v for k, v in IMPORTS.items() if language in k), ())
    plain = re.sub(comment_pattern(language), " ", text)
    found = [(m.strip(), dyn) for p, dyn in patterns for m in re.findall(p, plain)]
    if language == "php":
        found = [(name, dyn) for spec, dyn in found for name in php_list(spec)]
    return [(spec, dyn, language in STYLES) for spec, dyn in found]


def php_list(spec: str) -> list[str]:
    """php_names() for one text."""
    prefix, _, inner = spec.partition("{") if "{" in spec else ("", "", spec)
    names = (re.sub(r"(?i)\s+as\s+\w+\s*$|^\s*(?:function|const)\s+", "", x) for x in inner.rstrip("} ").split(","))
    return [re.sub(r"\s", "", prefix + n) for n in names if n.strip()]


def imports_of(files: DataFrame, languages: set[str] | None = None) -> DataFrame:
    """files: path, language, content. path, language, ord, specifier, dynamic, style. languages: those that occur, if that
    is known; the plan then holds no more than their patterns."""
    known = {k: v for k, v in IMPORTS.items() if languages is None or languages & set(k)}
    # one pass for all languages: each row takes the branch of its own
    lang, masked, found = F.col("language"), F.col("content"), F.lit(None).cast("array<struct<specifier:string,dynamic:boolean>>")
    for comments in {comment_pattern(family[0]): 0 for family in known}:
        own = [x for family in known for x in family if comment_pattern(family[0]) == comments]
        masked = F.when(lang.isin(*own), F.regexp_replace("content", comments, " ")).otherwise(masked)
    for family, patterns in known.items():
        specs = F.concat(*(spec_structs(p, dyn) for p, dyn in patterns))
        found = F.when(lang.isin(*family), F.flatten(F.transform(specs, php_names)) if family == ("php",) else specs).otherwise(found)
    plain = files.where(lang.isin(*(x for family in known for x in family))).select("path", "language", masked.alias("content"))
    native = plain.select("path", "language", F.posexplode(found).alias("ord", "f")).select("path", "language", "ord", F.trim("f.specifier").alias("specifier"), "f.dynamic", lang.isin(*STYLES).alias("style"))

    def parsed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for path, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                rows += [(path, lang, i, *s) for i, s in enumerate(file_imports(text or "", lang))]
            cols = list(zip(*rows)) or [()] * 6
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.string(), pa.string(), pa.int32(), pa.string(), pa.bool_(), pa.bool_()))], ["path", "language", "ord", "specifier", "dynamic", "style"])

    others = files.where(F.col("language").isin("python", *COMPONENTS)).select("path", "language", "content").mapInArrow(parsed, "path string, language string, ord int, specifier string, dynamic boolean, style boolean")
    if languages is None or known and languages & {"python", *COMPONENTS}:
        return others.unionByName(native)
    return native if known else others


def php_names(found: Column) -> Column:
    """The names of one `use`: groups and lists are taken apart, aliases and kinds dropped."""
    group = found.specifier.contains("{")
    prefix = F.when(group, F.regexp_replace(F.substring_index(found.specifier, "{", 1), r"\s", "")).otherwise("")
    listed = F.when(group, F.regexp_extract(found.specifier, r"\{([^}]*)", 1)).otherwise(found.specifier)
    names = F.transform(F.split(listed, ","), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, r"(?i)\s+as\s+\w+\s*$", ""), r"^\s*(?:function|const)\s+", "")))
    return F.transform(F.filter(F.transform(names, lambda x: F.regexp_replace(x, r"\s", "")), lambda x: x != ""), lambda x: F.struct(F.concat(prefix, x).alias("specifier"), found.dynamic.alias("dynamic")))


def spec_structs(pattern: str, dynamic: bool):
    return F.transform(F.regexp_extract_all("content", F.lit(pattern), F.lit(1)), lambda s: F.struct(s.alias("specifier"), F.lit(dynamic).alias("dynamic")))


class Symbol(NamedTuple):
    name: str
    qualified: str
    kind: str
    line: int
    end: int


class Call(NamedTuple):
    name: str
    line: int


#: Declarations: pattern (group `n` is the name), kind; and how a block ends.
NAME = r"(?P<n>[A-Za-z_$][\w$]*)"
WORDS = r"(?:@[\w.]+(?:\([^)]*\))?\s+|\[[\w., ()\"=]+\]\s*)*(?:(?:public|private|protected|internal|static|final|abstract|sealed|open|override|async|export|default|partial|virtual|inline|suspend|data|case|implicit|lazy|extern|unsafe|const|pub(?:\([^)]*\))?|mutating|factory|external|synchronized|native|readonly|declare)\s+)*"
TYPED = rf"^\s*{WORDS}(?:[\w<>\[\],.?*&:]+\s+)+?[*&]*(?P<n>~?[A-Za-z_][\w:~]*)\s*\([^;]*$"
DECLARATIONS: dict[tuple[str, ...], tuple[str, tuple[tuple[str, str], ...]]] = {
    JS: ("brace", ((rf"^\s*{WORDS}class\s+{NAME}", "class"), (rf"^\s*{WORDS}interface\s+{NAME}", "interface"), (rf"^\s*{WORDS}enum\s+{NAME}", "enum"), (rf"^\s*{WORDS}type\s+{NAME}\s*=", "type"), (rf"^\s*{WORDS}function\s*\*?\s*{NAME}\s*[(<]", "function"), (rf"^\s*{WORDS}(?:const|let|var)\s+{NAME}\s*(?::[^=]+)?=\s*(?:async\s*)?(?:function\b|\([^)]*\)\s*(?::[^=]+)?=>|[\w$]+\s*=>)", "function"), (rf"^\s+{WORDS}(?:get\s+|set\s+|\*\s*)?{NAME}\s*\([^)]*\)\s*(?::[^{{;]+)?\{{", "method"))),
    ("go",): ("brace", ((rf"^func\s*\([^)]*\)\s*{NAME}\s*[(\[]", "method"), (rf"^func\s+{NAME}\s*[(\[]", "function"))),
    ("rust",): ("brace", ((rf"^\s*{WORDS}fn\s+{NAME}", "function"),)),
    ("java",): ("brace", ((rf"^\s*{WORDS}class\s+{NAME}", "class"), (rf"^\s*{WORDS}@?interface\s+{NAME}", "interface"), (rf"^\s*{WORDS}enum\s+{NAME}", "enum"), (rf"^\s*{WORDS}record\s+{NAME}", "class"), (TYPED, "method"), (rf"^\s*(?:public|private|protected)\s+{NAME}\s*\([^;]*$", "constructor"))),
    ("kotlin",): ("brace", ((rf"^\s*{WORDS}(?:enum\s+)?class\s+{NAME}", "class"), (rf"^\s*{WORDS}interface\s+{NAME}", "interface"), (rf"^\s*{WORDS}object\s+{NAME}", "class"), (rf"^\s*{WORDS}fun\s+(?:<[^>]*>\s*)?(?:[\w<>?]+\.)?{NAME}\s*\(", "function"))),
    ("scala",): ("brace", ((rf"^\s*{WORDS}class\s+{NAME}", "class"), (rf"^\s*{WORDS}trait\s+{NAME}", "trait"), (rf"^\s*{WORDS}object\s+{NAME}", "class"), (rf"^\s*{WORDS}def\s+{NAME}", "function"))),
    ("csharp",): ("brace", ((rf"^\s*{WORDS}(?:class|record|struct)\s+{NAME}", "class"), (rf"^\s*{WORDS}interface\s+{NAME}", "interface"), (rf"^\s*{WORDS}enum\s+{NAME}", "enum"), (TYPED, "method"), (rf"^\s*(?:public|private|protected|internal)\s+{NAME}\s*\([^;]*$", "constructor"))),
    ("c", "cpp"): ("brace", ((rf"^\s*(?:class|struct)\s+{NAME}[^;]*$", "class"), (TYPED, "function"))),
    ("ruby",): ("end", ((rf"^\s*class\s+(?:\w+::)*{NAME}", "class"), (rf"^\s*module\s+(?:\w+::)*{NAME}", "class"), (r"^\s*def\s+(?:self\.)?(?P<n>[A-Za-z_]\w*[?!=]?)", "method"))),
    ("php",): ("brace", ((rf"^\s*{WORDS}class\s+{NAME}", "class"), (rf"^\s*interface\s+{NAME}", "interface"), (rf"^\s*trait\s+{NAME}", "trait"), (rf"^\s*enum\s+{NAME}", "enum"), (rf"^\s*{WORDS}function\s+&?{NAME}\s*\(", "function"))),
    ("swift",): ("brace", ((rf"^\s*{WORDS}(?:class|struct|actor)\s+{NAME}", "class"), (rf"^\s*{WORDS}protocol\s+{NAME}", "interface"), (rf"^\s*{WORDS}enum\s+{NAME}", "enum"), (rf"^\s*{WORDS}func\s+{NAME}", "function"), (r"^\s*(?:convenience\s+|required\s+|public\s+|override\s+)*(?P<n>init)[?!]?\s*[(<]", "method"))),
    ("shell",): ("brace", ((r"^\s*(?:function\s+)?(?P<n>[A-Za-z_][\w-]*)\s*\(\)\s*\{?", "function"), (r"^\s*function\s+(?P<n>[A-Za-z_][\w-]*)", "function"))),
    ("lua",): ("end", ((r"^\s*(?:local\s+)?function\s+(?P<n>[A-Za-z_][\w.:]*)", "function"), (r"^\s*(?:local\s+)?(?P<n>[A-Za-z_][\w.]*)\s*=\s*function\b", "function"))),
    ("dart",): ("brace", ((rf"^\s*{WORDS}class\s+{NAME}", "class"), (rf"^\s*mixin\s+{NAME}", "trait"), (rf"^\s*enum\s+{NAME}", "enum"), (rf"^\s*extension\s+{NAME}", "class"), (rf"^\s*typedef\s+{NAME}", "type"), (r"^\s*[\w<>?]+\s+(?P<n>operator\s*[^\s(]+)\s*\([^;]*$", "method"), (rf"^\s*(?:static\s+)?(?:[\w<>?,]+\s+)?get\s+{NAME}\s*(?:=>|\{{|async)", "method"), (rf"^\s*(?:const\s+|factory\s+)?(?P<n>[A-Z]\w*(?:\.\w+)?)\s*\([^;]*\)\s*(?::|\{{|=>)", "constructor"), (TYPED, "function"))),
}
FALLBACK = ("indent", ((rf"^\s*(?:async\s+)?(?:function|def|fn|func|sub)\s+{NAME}", "function"),))
TYPES = ("class", "interface", "trait", "enum")
#: Words before a bracket that call nothing.
NO_CALLS = frozenset("if for while switch catch return function def fn func sub elif else match when with sizeof typeof new in and or not await yield throw case do until unless loop async".split())
CALL = re.compile(r"(?<![\w$])((?:[A-Za-z_$][\w$]*\s*(?:\.|::|->)\s*)*[A-Za-z_$][\w$]*)\s*!?\(")
#: A command of a shell: a word where a command can begin, that assigns nothing.
COMMAND = re.compile(r"(?:^|[;&|]|\$\(|\b(?:if|while|until|then|do|else|elif|time|exec|sudo)\s)\s*([A-Za-z_][\w-]*)(?![\w-]*(?:=|\s*\(\)))")
NO_COMMANDS = frozenset("if then else elif fi for while until do done case esac in function select time return local export declare readonly unset shift exit break continue set".split())
STRINGS = re.compile(r'"(?:\\.|[^"\\\n])*"|\'(?:\\.|[^\'\\\n])*\'|`(?:\\.|[^`\\])*`', re.S)
BLANKED = re.compile(r"[^\n]")


def masked(text: str, language: str) -> str:
    """The text with strings and comments blanked; lines and columns stay."""
    blank = lambda m: BLANKED.sub(" ", m[0])
    return re.sub(comment_pattern(language), blank, STRINGS.sub(blank, text))


def block_end(lines: list[str], at: int, how: str) -> int:
    """Line (from 0) on which the block that is declared on line `at` ends."""
    if how == "brace":
        depth = opened = 0
        for i in range(at, len(lines)):
            for c in lines[i]:
                if c == "{":
                    depth += 1
                    opened = 1
                elif c == "}":
                    depth -= 1
            if opened and depth <= 0:
                return i
            if not opened and (";" in lines[i] or i - at > 20):
                return at
        return len(lines) - 1 if opened else at
    indent = len(lines[at]) - len(lines[at].lstrip())
    for i in range(at + 1, len(lines)):
        if lines[i].strip() and len(lines[i]) - len(lines[i].lstrip()) <= indent:
            return i if how == "end" and lines[i].strip().startswith("end") else i - 1
    return len(lines) - 1


def python_symbols(text: str) -> tuple[list[Symbol], list[Call]]:
    found, calls = [], []

    def visit(node: ast.AST, inside: tuple[str, ...], in_class: bool) -> None:
        for child in ast.iter_child_nodes(node):
            if isinstance(child, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
                is_class = isinstance(child, ast.ClassDef)
                kind = "class" if is_class else "constructor" if in_class and child.name == "__init__" else "method" if in_class else "function"
                found.append(Symbol(child.name, ".".join((*inside, child.name)), kind, child.lineno, child.end_lineno or child.lineno))
                visit(child, (*inside, child.name), is_class)
            else:
                if isinstance(child, ast.Call):
                    f = child.func
                    name = f.id if isinstance(f, ast.Name) else f.attr if isinstance(f, ast.Attribute) else None
                    if name:
                        calls.append(Call(name, child.lineno))
                visit(child, inside, in_class and not isinstance(child, ast.Lambda))

    visit(ast.parse(text), (), False)
    return found, calls


def symbols_of(text: str, language: str) -> tuple[list[Symbol], list[Call]]:
    """All symbols, the module first, and the call sites of one file."""
    n = text.count("\n") + 1
    out = [Symbol(MODULE, MODULE, "module", 1, n)]
    try:
        if language == "python":
            found, calls = python_symbols(text)
            return out + found, calls
        return (lambda s, c: (out + s, c))(*scanned(text, language))
    except (SyntaxError, ValueError, RecursionError):
        return out, []


def scanned(text: str, language: str) -> tuple[list[Symbol], list[Call]]:
    if language in COMPONENTS:
        # the script's lines keep their places
        keep = [False] * len(text)
        for m in re.finditer(r"(?is)<script\b[^>]*>(.*?)</script>", text):
            keep[m.start(1) : m.end(1)] = [True] * (m.end(1) - m.start(1))
        text, language = "".join(c if k or c == "\n" else " " for c, k in zip(text, keep)), "typescript"
    lines = masked(text, language).split("\n")
    how, patterns = next((v for k, v in DECLARATIONS.items() if language in k), FALLBACK)
    compiled = [(re.compile(p), kind) for p, kind in patterns]
    found: list[Symbol] = []
    heads: set[tuple[int, str]] = set()
    for i, line in enumerate(lines):
        for pattern, kind in compiled:
            m = pattern.match(line)
            if not m or m["n"] in NO_CALLS or line.lstrip().startswith(("return ", "else ", "new ", "throw ")):
                continue
            name, end = m["n"], block_end(lines, i, how)
            owner = next((s for s in reversed(found) if s.kind in TYPES and s.line <= i < s.end), None)
            if owner and kind in ("function", "method"):
                kind = "constructor" if name in (owner.name, "constructor", "init", "__construct", "initialize") else "method"
            elif re.search(r"::|[.:]", name):
                kind, name = "method", re.split(r"::|[.:]", name)[-1]
            found.append(Symbol(name, f"{owner.qualified}.{name}" if owner else m["n"], kind, i + 1, end + 1))
            heads.add((i + 1, name))
            break
    calls = []
    if language == "shell":
        return found, [Call(m[1], i + 1) for i, line in enumerate(lines) for m in COMMAND.finditer(line) if m[1] not in NO_COMMANDS and (i + 1, m[1]) not in heads]
    for i, line in enumerate(lines):
        for m in CALL.finditer(line):
            name = re.split(r"\.|::|->", m[1])[-1].strip()
            if name not in NO_CALLS and (i + 1, name) not in heads and (name != "import" or language in JS):
                calls.append(Call(name, i + 1))
    return found, calls


def top_regions(symbols: list[Symbol]) -> list[tuple[int, int]]:
    """Line ranges (from 0, end exclusive) of the outermost declarations, for chunking."""
    out: list[tuple[int, int]] = []
    for s in sorted(symbols, key=lambda s: (s.line, -s.end)):
        if s.name != MODULE and (not out or s.line - 1 >= out[-1][1]):
            out.append((s.line - 1, s.end))
    return out


def python_regions(text: str) -> list[tuple[int, int]]:
    """top_regions() of Python's own parse, without a walk over expressions or what lies inside a declaration."""
    out: list[tuple[int, int]] = []
    ahead: list[ast.AST] = [ast.parse(text)]
    while ahead:
        node = ahead.pop()
        if isinstance(node, (ast.ClassDef, ast.FunctionDef, ast.AsyncFunctionDef)):
            out.append((node.lineno - 1, node.end_lineno or node.lineno))
        else:
            for field in ("body", "orelse", "finalbody", "handlers", "cases"):
                inside = getattr(node, field, None)
                if isinstance(inside, list):
                    ahead += inside
    return sorted(out)


def regions_of(language: Column, content: Column) -> Column:
    """The regions that extracted() gives, as a column of the files' own rows; no symbols or calls are made for it."""
    kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def found(text: str, lang: str) -> list[tuple[int, int]]:
        try:
            return python_regions(text) if lang == "python" else top_regions(symbols_of(text, lang)[0])
        except (SyntaxError, ValueError, RecursionError):
            return []

    @F.arrow_udf("array<struct<start:int,end:int>>")
    def go(language: pa.Array, content: pa.Array) -> pa.Array:
        return pa.array([[{"start": s, "end": e} for s, e in found(t or "", n or "")] for n, t in zip(language.to_pylist(), content.to_pylist())], kind)

    return go(language, content)


def innermost(symbols: list[Symbol], line: int) -> Symbol:
    """The symbol that covers the line and starts last; the module if there is no other."""
    return max((s for s in symbols if s.line <= line <= s.end), key=lambda s: (s.line, s.name != MODULE, -s.end), default=symbols[0])


def extracted(files: DataFrame) -> DataFrame:
    """files: path, language, content. path, language, symbols, calls (with their callers' ids) and regions, one row a file."""
    types = ("path string, language string, symbols array<struct<id:string,name:string,qualified_name:string,kind:string,line:int,end_line:int>>, calls array<struct<caller_id:string,callee_name:string,line:int>>, regions array<struct<start:int,end:int>>")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows = []
            for path, lang, text in zip(*(c.to_pylist() for c in b.columns)):
                symbols, calls = symbols_of(text or "", lang or "")
                ids = {s: f"{path}::{s.qualified}#{s.line}" for s in symbols}
                rows.append({
                    "path": path, "language": lang,
                    "symbols": [{"id": ids[s], "name": s.name, "qualified_name": s.qualified, "kind": s.kind, "line": s.line, "end_line": s.end} for s in symbols],
                    "calls": [{"caller_id": ids[innermost(symbols, c.line)], "callee_name": c.name, "line": c.line} for c in calls],
                    "regions": [{"start": s, "end": e} for s, e in top_regions(symbols)],
                })
            t = pa.struct([("id", pa.string()), ("name", pa.string()), ("qualified_name", pa.string()), ("kind", pa.string()), ("line", pa.int32()), ("end_line", pa.int32())])
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("path", pa.string()), ("language", pa.string()), ("symbols", pa.list_(t)), ("calls", pa.list_(pa.struct([("caller_id", pa.string()), ("callee_name", pa.string()), ("line", pa.int32())]))), ("regions", pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())])))]))

    return files.select("path", "language", "content").mapInArrow(run, types)


def symbol_rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("path").alias("file"), "language", F.explode("symbols").alias("s")).select("s.id", "s.name", "s.qualified_name", "s.kind", "file", "s.line", "s.end_line", "language")


def call_rows(found: DataFrame) -> DataFrame:
    return found.select(F.col("path").alias("caller_file"), F.posexplode("calls").alias("i", "c")).select(F.concat("caller_file", F.lit("@"), "i").alias("call_id"), "c.caller_id", "caller_file", "c.callee_name", "c.line")
