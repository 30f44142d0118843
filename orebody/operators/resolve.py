"""Import resolution as lookups: ordered candidate paths joined with the file set, first hit wins.

Each language's rule is a list of path expressions over (specifier, folder); they are exploded with their place in the
list, joined once with the files, and the smallest place that exists is the target. So all languages share one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from orebody.operators.extract import COMPONENTS, JS, JVM, STYLES

#: Extensions tried in order.
EXTENSIONS = {**{x: (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".vue", ".svelte") for x in (*JS, *COMPONENTS)}, **{x: (".css", ".scss", ".sass", ".less", ".styl") for x in STYLES}, "python": (".py",), "ruby": (".rb",), "dart": (".dart",), "lua": (".lua",), "shell": (".sh", ".bash"), "swift": (".swift",), "php": (".php",)}
#: Modules that come with a language, by their first name.
PYTHON_LIBRARY = ("os", "sys", "re", "json", "math", "datetime", "collections", "typing", "pathlib", "io", "functools", "itertools", "abc", "asyncio", "unittest", "logging", "argparse", "subprocess", "socket", "http", "urllib", "hashlib", "copy", "enum", "dataclasses", "contextlib", "textwrap", "string", "struct", "time", "threading", "multiprocessing", "xml", "csv", "sqlite3", "pickle", "shelve", "tempfile", "shutil", "glob")
LUA_LIBRARY = ("string", "table", "math", "io", "os", "coroutine", "debug", "package", "utf8", "bit32")
APPLE_LIBRARY = ("Foundation", "UIKit", "SwiftUI", "Combine", "CoreData", "CoreGraphics", "CoreLocation", "MapKit", "XCTest")


def first_hits(candidates: DataFrame, files: DataFrame, keys: list[str]) -> DataFrame:
    """candidates: keys, ord, path; files: path. keys and the path of the smallest ord that exists."""
    return candidates.join(files.select("path").distinct(), "path").groupBy(*keys).agg(F.min_by("path", "ord").alias("path"))


def is_external(spec: Column, language: Column) -> Column:
    """Whether the specifier names a library of the language; Go is decided by its module path instead."""
    head = F.substring_index(spec, ".", 1)
    return F.coalesce(
        F.when(language == "python", head.isin(*PYTHON_LIBRARY))
        .when(language.isin(*JVM), spec.rlike(r"^(?:javax?|kotlinx?|scala|android)\."))
        .when(language == "csharp", spec.rlike(r"^(?:System(?:\.|$)|Microsoft\.)"))
        .when(language == "rust", spec.rlike("^(?:std|core|alloc)::"))
        .when(language == "swift", spec.isin(*APPLE_LIBRARY))
        .when(language == "ruby", ~spec.contains("/"))
        .when(language == "dart", spec.rlike("^(?:dart|package):"))
        .when(language == "lua", head.isin(*LUA_LIBRARY)),
        F.lit(False),
    )


def normal_path(path: Column) -> Column:
    """A relative path without `.` and `..` parts; what climbs above the root becomes null."""
    up = lambda a: F.when(F.size(a) == 0, F.lit(None).cast("array<string>")).otherwise(F.slice(a, F.lit(1), F.greatest(F.size(a) - 1, F.lit(0))))
    parts = F.aggregate(F.split(path, "/"), F.array().cast("array<string>"), lambda a, p: F.when(p.isin("", "."), a).when(p == "..", up(a)).otherwise(F.array_append(a, p)))
    return F.array_join(parts, "/")


def probes(path: Column, extensions: tuple[str, ...]) -> list[Column]:
    """The places where a possibly extensionless path may be found, in order."""
    ext = F.regexp_extract(path, r"[^/](\.[^./]+)$", 1)
    stem = F.when(ext != "", F.regexp_replace(path, r"\.[^./]+$", ""))
    out = [path, *(F.concat(path, F.lit(e)) for e in extensions), *(F.concat(stem, F.lit(e)) for e in extensions), *(F.concat(path, F.lit(f"/index{e}")) for e in extensions)]
    if ".scss" in extensions:
        partial = F.when(~path.rlike(r"(?:^|/)_[^/]*$"), F.regexp_replace(path, r"([^/]+)$", "_$1"))
        out += [partial, *(F.concat(partial, F.lit(e)) for e in extensions)]
    if ".py" in extensions:
        out.append(F.concat(path, F.lit("/__init__.py")))
    return out


def beside(folder: Column, spec: Column) -> Column:
    return normal_path(F.concat(folder, F.lit("/"), spec))


#: How a base path is probed: as it is, or with the extensions of a family.
FAMILIES = {"exact": (), "script": EXTENSIONS["typescript"], "style": EXTENSIONS["css"], "python": (".py",), "ruby": (".rb",), "dart": (".dart",), "lua": (".lua",), "shell": EXTENSIONS["shell"], "swift": EXTENSIONS["swift"]}


def bases_by_language(spec: Column, folder: Column) -> dict[tuple[str, ...], list[tuple[Column, str]]]:
    """Base paths of each language in order, with their family."""
    relative = F.when(spec.rlike(r"^\.{1,2}(?:/|$)"), beside(folder, spec))
    here = beside(folder, spec)
    slashed = F.regexp_replace(spec, r"\.", "/")
    dots = F.length(F.regexp_extract(spec, r"^(\.*)", 1))
    climbed = F.when(dots > 0, beside(folder, F.concat(F.repeat(F.lit("../"), dots - 1), F.regexp_replace(F.regexp_replace(spec, r"^\.+", ""), r"\.", "/"))))
    absolute = F.when(dots == 0, slashed)
    out: dict[tuple[str, ...], list[tuple[Column, str]]] = {(*JS, *COMPONENTS): [(relative, "script")], STYLES: [(relative, "style")]}
    out["python",] = [(x, "python") for x in (climbed, absolute, F.concat(F.lit("src/"), absolute), F.concat(F.lit("lib/"), absolute), F.when(dots == 0, beside(folder, slashed)))]
    for lang, suffix in zip(JVM, (".java", ".kt", ".scala")):
        cls = F.when(~spec.endswith("*"), F.concat(slashed, F.lit(suffix)))
        out[(lang,)] = [(F.concat(F.lit(prefix), cls), "exact") for prefix in ("", f"src/main/{lang}/", "src/main/", "src/")]
    out["c", "cpp"] = [(here, "exact")]
    out["ruby",] = [(F.when(spec.startswith("."), here).otherwise(spec), "ruby")]
    space = F.regexp_replace(F.regexp_replace(spec, r"^\\", ""), r"\\", "/")
    inner = F.when(space.contains("/"), F.regexp_replace(space, "^[^/]+/", ""))
    first_low = F.concat(F.lower(F.substring_index(space, "/", 1)), F.lit("/"), inner)
    out["php",] = [(x, "exact") for x in (relative, F.concat(relative, F.lit(".php")), space, *(F.concat(y, F.lit(".php")) for y in (space, first_low, F.concat(F.lit("src/"), inner), F.concat(F.lit("lib/"), inner))))]
    module = F.when(~spec.contains("::"), spec)
    out["rust",] = [(beside(folder, F.concat(module, F.lit(end))), "exact") for end in (".rs", "/mod.rs")]
    out["swift",], out["shell",], out["dart",] = [(relative, "swift")], [(relative, "shell")], [(here, "dart")]
    out["lua",] = [(slashed, "lua"), (F.concat(slashed, F.lit("/init.lua")), "exact"), (spec, "exact")]
    return out


def resolved_imports(imports: DataFrame, files: DataFrame, go_module: str | None = None, go_packages: DataFrame | None = None, namespaces: DataFrame | None = None, class_suffixes: DataFrame | None = None, aliases: list[tuple[str, bool, int, str]] = (), present: set[str] | None = None) -> DataFrame:
    """present: the languages that occur, if that is known; the plan then holds no more than their rules. imports: path, language, ord, specifier, dynamic, style; files: path. source, target, type and import_ord of those found."""
    spec, lang = F.col("specifier"), F.when(F.col("style"), F.lit("css")).otherwise(F.col("language"))
    folder = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    own = imports.withColumn("_lang", lang).where(~is_external(spec, F.col("_lang")))
    keys = ["source", "import_ord", "dynamic"]
    base = own.withColumnRenamed("ord", "import_ord")
    options = F.lit(None).cast("array<struct<base:string,family:string>>")
    here = lambda languages: present is None or bool(present & {*languages})
    families: set[str] = set()
    for languages, bases in bases_by_language(spec, folder).items():
        if not here(languages) and not (languages == STYLES and here(COMPONENTS)):
            continue
        if languages[0] in ("javascript", STYLES[0]):
            family = "script" if languages[0] == "javascript" else "style"
            for prefix, wild, _, target in aliases:
                hit = F.when(spec.startswith(prefix) if wild else spec == prefix, normal_path(F.concat(F.lit(target + ("/" if wild else "")), F.substring(spec, F.lit(len(prefix) + 1), F.length(spec)))))
                bases = [*bases, (hit, family)]
        families |= {f for _, f in bases}
        options = F.when(F.col("_lang").isin(*languages), F.array(*(F.struct(x.alias("base"), F.lit(f).alias("family")) for x, f in bases))).otherwise(options)
    # bases are exploded before they are probed, so that no path is worked out again for each of its probes
    based = base.withColumn("_b", options).select(F.col("path").alias("source"), "import_ord", "dynamic", F.posexplode("_b").alias("i", "b")).select("source", "import_ord", "dynamic", "i", "b.base", "b.family").where("base IS NOT NULL")
    probed = F.array(F.col("base"))
    for family, extensions in FAMILIES.items():
        if extensions and family in families:
            probed = F.when(F.col("family") == family, F.array(*probes(F.col("base"), extensions))).otherwise(probed)
    listed = based.select(*keys, "i", F.posexplode(probed).alias("j", "path")).where("path IS NOT NULL").withColumn("ord", F.col("i") * 1000 + F.col("j"))
    # joins are by shuffle: Spark takes stored imports for as small as their compressed file, and would collect their probes in the driver
    hits = listed.hint("merge").join(files.select("path").distinct(), "path").select(*keys, "ord", "path")
    lookups = []
    if go_module and go_packages is not None and here(("go",)):
        inside = F.when(spec == go_module, F.lit("")).when(spec.startswith(go_module + "/"), F.substring(spec, F.lit(len(go_module) + 2), F.length(spec)))
        lookups.append((base.where("_lang = 'go'").withColumn("k", inside), go_packages.select(F.col("folder").alias("k"), F.col("path").alias("to"))))
    if namespaces is not None and here(("csharp",)):
        lookups.append((base.where("_lang = 'csharp'").withColumn("k", spec), namespaces.select(F.col("namespace").alias("k"), F.col("path").alias("to"))))
    if class_suffixes is not None and here(JVM):
        end = F.when(F.col("_lang") == "java", ".java").when(F.col("_lang") == "kotlin", ".kt").otherwise(".scala")
        jvm = base.where(F.col("_lang").isin(*JVM)).withColumn("k", F.concat(F.regexp_replace(spec, r"\.", "/"), end))
        lookups.append((jvm, class_suffixes.select(F.col("suffix").alias("k"), F.col("path").alias("to"))))
    for n, (rows, table) in enumerate(lookups):
        # behind all probes, so that one choice of the first hit settles both
        hits = hits.unionByName(rows.hint("merge").join(table, "k").select(F.col("path").alias("source"), "import_ord", "dynamic", F.lit(1_000_000_000 + n).alias("ord"), F.col("to").alias("path")))
    found = hits.groupBy(*keys).agg(F.min_by("path", "ord").alias("path"))
    return found.select("source", F.col("path").alias("target"), F.when(F.col("dynamic"), "dynamic-import").otherwise("import").alias("type"), "import_ord")
