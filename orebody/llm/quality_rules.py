"""Operator 2: line-first cleaning.

Every line that holds a word is judged by itself: navigation (three or more short fields between bars, chevrons or
bullets), boilerplate (a phrase of BOILERPLATE), symbols (many of `#*$%&|<>` for its words), shouting (most letters
upper case, several words) and, for lines of at least `long_line` words, a sentence's punctuation at all. Lines that
fail are removed; a document that loses more than `max_loss` of its word characters is rejected, as is one with fewer
than `min_words` words or more than `max_repeats` of its words in repeated windows of eight words.

Words are runs of characters other than space and tab to carriage return; lines end at newlines only. Null and empty
texts have no words and are rejected. Rows are judged one by one, so repeated rows and ids give repeated results; a
text is handled inside its row by SQL functions, with no shuffle and memory in proportion to that text. An empty table gives
no rows. Other columns pass through; work columns take names that none of them has.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import documents, fresh, whole_text

#: Space and tab to carriage return (fixed values).
BLANKS = " \t\n\x0b\f\r"
BLANK, WORD = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
SYMBOLS = "#*$%&|<>"
BOILERPLATE = (
    "all rights reserved", "terms of use", "terms of service", "privacy policy", "cookie policy", "accept cookies", "enable javascript", "subscribe to our newsletter", "click here to", "skip to content", "powered by wordpress",
    "alle rechte vorbehalten", "datenschutzerklärung", "cookies akzeptieren", "zum inhalt springen", "newsletter abonnieren",
    "tous droits réservés", "politique de confidentialité", "mentions légales", "accepter les cookies", "aller au contenu",
    "todos los derechos reservados", "política de privacidad", "aviso legal", "aceptar cookies", "saltar al contenido",
)
WINDOW = 8


def words_of(text: Column) -> Column:
    return let(F.btrim(text, F.lit(BLANKS)), lambda t: F.when(t == "", F.array().cast("array<string>")).otherwise(F.split(t, BLANK + "+")))


def doubled(width: int):
    """From hashes of `width` words at each place to hashes of twice as many."""
    return lambda h: F.zip_with(F.slice(h, F.lit(1), F.size(h) - width), F.slice(h, F.lit(1 + width), F.size(h) - width), lambda a, b: F.xxhash64(a, b))


def repeated_words(words: Column) -> Column:
    """Words inside windows of WINDOW words that occur twice or more in the text."""
    n = F.size(words)
    # hashes of 1, 2, 4 and 8 words: two neighbours make one of double width
    windows, width = F.transform(words, lambda w: F.xxhash64(w)), 1
    while width < WINDOW:
        windows = let(windows, doubled(width))
        width *= 2

    def covered(hashes: Column) -> Column:
        in_order = F.array_sort(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))
        # a neighbour with the same hash, before or after
        twice = lambda s: F.array_sort(F.transform(F.filter(F.transform(s, lambda x, k: F.struct(x.i.alias("i"), ((k > 0) & (F.get(s, k - 1).h == x.h) | F.coalesce(F.get(s, k + 1).h == x.h, F.lit(False))).alias("t"))), lambda x: x.t), lambda x: x.i))
        count = lambda at: F.aggregate(at, F.struct(F.lit(0).alias("n"), F.lit(0).alias("to")), lambda a, i: F.struct((a.n + i + WINDOW - F.greatest(a.to, i)).cast("int").alias("n"), (i + WINDOW).cast("int").alias("to")), lambda a: a.n)
        return let(in_order, lambda s: let(twice(s), count))

    return F.when(n < WINDOW + 1, F.lit(0)).otherwise(let(windows, lambda h: F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0)).otherwise(covered(h)))).cast("long")


def let(value: Column, use) -> Column:
    """use(value), with value computed once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def count_of(text: Column, characters: str) -> Column:
    return F.regexp_count(text, F.lit(f"[{characters}]"))


def has_phrase(text: Column) -> Column:
    def any_of(low: Column) -> Column:
        found = F.lit(False)
        for phrase in BOILERPLATE:
            found |= F.contains(low, F.lit(phrase))
        return found

    return let(F.lower(text), any_of)


def line_passes(line: Column, symbols_in_text: Column, phrases_in_text: Column, long_line: int) -> Column:
    """The rules for one line. What the whole text shows absent is not looked for in its lines."""
    n_words = F.size(F.split(line, BLANK + "+"))
    bars = count_of(line, "|»›•")
    marks = count_of(line, SYMBOLS)
    navigation = let(bars, lambda n: (n >= 3) & (3 * n >= n_words))
    symbols = let(marks, lambda n: (n >= 6) & (6 * n > F.length(line)))
    shouting = (F.upper(line) == line) & (F.lower(line) != line) & (n_words >= 4)
    unpunctuated = ~line.rlike("[.,;:?!…。]") & (n_words >= long_line)
    return ~((symbols_in_text & (navigation | symbols)) | shouting | unpunctuated | (phrases_in_text & has_phrase(line)))


def quality(docs: DataFrame, text_col: str = "text", min_words: int = 20, max_repeats: int = 30, max_loss: float = 0.5, long_line: int = 60) -> tuple[DataFrame, str]:
    """docs with one struct column more, and its name: the counts, base_failed, kept, lost_chars and cleaned_text."""
    out = fresh(docs, "quality")
    at = {x: fresh(docs, f"_ob_{x}") for x in ("text", "words", "lines", "symbols", "good", "n", "chars", "lost", "repeats", "failed")}
    text, words, lines, symbols, good, n, in_words, lost, repeats, failed = map(F.col, at.values())
    chars = lambda pieces: F.length(F.array_join(F.flatten(F.transform(pieces, words_of)), ""))
    counted = (
        docs.withColumn(at["text"], whole_text(text_col))
        .withColumn(at["words"], words_of(text))
        .withColumn(at["lines"], F.filter(F.split(text, "\n"), lambda x: x.rlike(WORD)))
        .withColumn(at["symbols"], count_of(text, SYMBOLS).cast("long"))
        .withColumn(at["good"], let(F.struct(((symbols >= 3) | text.rlike("[»›•]")).alias("listed"), has_phrase(text).alias("phrases")), lambda have: F.filter(lines, lambda x: line_passes(x, have.listed, have.phrases, long_line))))
        .withColumn(at["n"], F.size(words).cast("long"))
        .withColumn(at["chars"], F.length(F.array_join(words, "")).cast("long"))
        .withColumn(at["lost"], F.when(F.size(good) == F.size(lines), F.lit(0)).otherwise(in_words - chars(good)).cast("long"))
        .withColumn(at["repeats"], repeated_words(words))
        .withColumn(at["failed"], (n < min_words) | (100 * repeats > max_repeats * n))
    )
    return counted.withColumn(
        out,
        F.struct(
            n.alias("n_words"),
            in_words.alias("word_chars"),
            symbols.alias("n_symbols"),
            (F.size(lines) - F.size(F.array_distinct(lines))).cast("long").alias("n_dup_lines"),
            repeats.alias("n_repeat_words"),
            failed.alias("base_failed"),
            (~failed & (lost <= max_loss * in_words)).alias("kept"),
            lost.alias("lost_chars"),
            F.array_join(good, "\n").alias("cleaned_text"),
        ),
    ).select(*docs.columns, out), out


def op2_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    judged, out = quality(documents(spark, sf_dir).select("doc_id", "text"))
    return judged.select("doc_id", *(F.col(out)[c].alias(c) for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "lost_chars")))


SQL = (
    r"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (SELECT doc_id, i, array_to_string(w[i : i + 7], ' ') AS g FROM (SELECT doc_id, w, unnest(range(1, len(w) - 6)) AS i FROM d WHERE len(w) >= 8)),
r AS (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1),
c AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM r, range(8) t(k) GROUP BY doc_id),
b AS (SELECT doc_id, t, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, len(regexp_extract_all(t, '[#*$%&|<>]')) AS n_symbols, coalesce(n, 0) AS n_repeat_words FROM d LEFT JOIN c USING (doc_id)),
l AS (SELECT doc_id, n_symbols >= 3 OR regexp_matches(t, '[»›•]') AS listed, unnest(string_split(t, chr(10))) AS x FROM b),
f AS (SELECT doc_id, x, length(array_to_string(regexp_extract_all(x, '[^\x20\x09-\x0D]+'), '')) AS chars, len(regexp_split_to_array(x, '[\x20\x09-\x0D]+')) AS n, len(regexp_extract_all(x, '[|»›•]')) AS bars, len(regexp_extract_all(x, '[#*$%&|<>]')) AS marks, listed FROM l WHERE regexp_matches(x, '[^\x20\x09-\x0D]')),
v AS (SELECT doc_id, x, chars, listed AND (bars >= 3 AND 3 * bars >= n OR marks >= 6 AND 6 * marks > length(x)) OR upper(x) = x AND lower(x) <> x AND n >= 4
  OR NOT regexp_matches(x, '[.,;:?!…。]') AND n >= 60 OR regexp_matches(lower(x), '"""
    + "|".join(BOILERPLATE)
    + r"""') AS bad FROM f),
q AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n_dup_lines, coalesce(sum(chars) FILTER (WHERE bad), 0) AS lost FROM v GROUP BY doc_id)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words,
n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed, NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND coalesce(lost, 0) <= 0.5 * word_chars AS kept, CAST(coalesce(lost, 0) AS BIGINT) AS lost_chars FROM b LEFT JOIN q USING (doc_id)
"""
)
