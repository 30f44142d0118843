"""The engine's functions for SQL: scalar ones as SQL expressions, so that they stay inside the optimiser, and table functions."""

from __future__ import annotations

from pyspark.sql import SparkSession

from orebody.functions.scalars import BY_EXTENSION

UUID = "regexp_replace(substring(sha2({0}, 256), 1, 32), '^(.{{8}})(.{{4}})(.{{4}})(.{{4}})(.{{12}})$', '$1-$2-$3-$4-$5')"
EXTENSION = r"lower(regexp_extract(element_at(split(translate(path, '\\', '/'), '/'), -1), '^.+(\\.[^.]*)$', 1))"
LANGUAGE = "coalesce(try_element_at(map(" + ", ".join(f"'{e}', '{lang}'" for e, lang in BY_EXTENSION.items()) + f"), {EXTENSION}), 'plaintext')"
LINES = "sequence(0, cast(greatest(0, ceil((size(split(content, '\\n', -1)) - lines) / (lines - shared))) as int) * (lines - shared), lines - shared)"

#: name and arguments, what comes back, and the expression.
SCALARS = (
    ("content_hash(content STRING)", "STRING", "substring(sha2(content, 256), 1, 16)"),
    ("chunk_id(path STRING, line INT)", "STRING", UUID.format("concat(path, ':', line)")),
    ("language_of(path STRING)", "STRING", LANGUAGE),
    ("bm25_score(tf DOUBLE, dl DOUBLE, df DOUBLE, docs DOUBLE, average DOUBLE)", "DOUBLE", "ln(1 + (docs - df + 0.5D) / (df + 0.5D)) * tf * 2.2D / (tf + 1.2D * (0.25D + 0.75D * dl / average))"),
    ("reciprocal_rank(place INT, k INT)", "DOUBLE", "1D / (k + place)"),
    ("symbol_file(id STRING)", "STRING", "CASE WHEN instr(id, '::') > 1 THEN substring_index(id, '::', 1) END"),
)
TABLES = (
    ("chunk_lines(content STRING, lines INT, shared INT)", "start_line INT, end_line INT, chunk STRING", f"SELECT s + 1, least(s + lines, size(split(content, '\\n', -1))), array_join(slice(split(content, '\\n', -1), s + 1, lines), '\\n') FROM (SELECT explode({LINES}) AS s)"),
)


def table_functions() -> dict:
    """Python table functions: they need a parser."""
    from pyspark.sql.functions import udtf

    @udtf(returnType="ord int, specifier string, dynamic boolean")
    class imports_in:
        def eval(self, language: str, content: str):
            from orebody.operators.extract import file_imports

            for i, (spec, dynamic, _) in enumerate(file_imports(content or "", language or "")):
                yield i, spec, dynamic

    @udtf(returnType="name string, qualified_name string, kind string, line int, end_line int")
    class symbols_in:
        def eval(self, language: str, content: str):
            from orebody.operators.extract import symbols_of

            yield from symbols_of(content or "", language or "")[0]

    return {"imports_in": imports_in, "symbols_in": symbols_in}


def register(spark: SparkSession) -> list[str]:
    """Makes the functions known to the session's SQL; their names."""
    for signature, kind, body in SCALARS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS {kind} RETURN {body}")
    for signature, kind, body in TABLES:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {signature} RETURNS TABLE ({kind}) RETURN {body}")
    more = table_functions()
    for name, function in more.items():
        spark.udtf.register(name, function)
    return [s.split("(")[0] for s, _, _ in (*SCALARS, *TABLES)] + list(more)
