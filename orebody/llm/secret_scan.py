"""Operator 1: secret scans with linking of multipart credentials.

Base findings stand alone: `assign` (a named value), `access` (an access identifier) and `hex` (a long hexadecimal run).
Weaker candidates are parts of a credential: `user` (a named identifier), `key` (a long mixed value) and `endpoint` (a
host after a scheme). They are reported only where complementary parts co-occur: an identifier with a secret, a secret
with an identifier, an endpoint with both. Base findings count as parts too (access: identifier; assign, hex: secret).

Parts are linked by an interval join inside a scope: a scope is a run of lines without a blank one, and two parts meet
if at most `reach` characters lie between the end of one and the start of the other. The join is a running maximum: of the
parts that start up to `reach` characters after a part's end, the furthest end tells whether one of them meets it. So no
pairs are made. Texts do not shuffle: each row's findings do, by a row number.

Positions count code points, ends exclusive. Null texts are empty and give zero counts and empty strings. Each input row
gives one row, repeated rows and ids included; an empty table gives none, and other columns are not read. A very long text is
scanned whole inside its row; time grows with its length and number of findings.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orebody.llm.common import documents, whole_text
from orebody.llm.quality_rules import let

#: The base patterns and the characters that a match needs (fixed values).
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
MIN_ASSIGN = 6
#: `AKIA[A-Z0-9]+` of 20 characters and `[0-9a-f]+` of 24: a run is taken whole, so the least length can stand in the pattern.
ACCESS, HEX = r"AKIA[A-Z0-9]{16,}", r"[0-9a-f]{24,}"
#: Weak candidates: kind, pattern, part.
WEAK = (
    ("user", r"""(?i:user(?:name)?|login|account|client_?id)["']?\x20*[:=]\x20*["']?[A-Za-z0-9_.@-]{3,}""", "identifier"),
    ("key", r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}", "secret"),
    ("endpoint", r"\b(?:https?|jdbc:\w+|postgres(?:ql)?|mysql|mongodb|redis|amqp|s3)://[A-Za-z0-9.-]+", "endpoint"),
)
BASE = ("assign", "access", "hex")
PART = {"assign": "secret", "access": "identifier", "hex": "secret"} | {k: p for k, _, p in WEAK}
ORDER = {k: i for i, k in enumerate((*BASE, *(k for k, _, _ in WEAK)))}
SPAN = "array<struct<start:int,end:int,ord:int>>"
BLOCK, HEAD, BREAK = 128, -2, -1


def spans(text: Column, pattern: str, kind: str, least: int = 1, group: int = 0) -> Column:
    """Leftmost non-overlapping matches whose group has `least` characters or more, as structs of start, end, ord.

    A split gives the pieces between the matches; lengths of pieces and matches in turn give the positions. They are summed
    in blocks: an array grows by copies, and so none grows longer than a block or the number of blocks.
    """
    found = F.struct(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)).alias("m"), F.regexp_extract_all(text, F.lit(pattern), F.lit(group)).alias("g"), F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("p"))
    start_of = lambda a, i, f: (a.at + F.get(f.p, i)).cast("int")
    end_of = lambda a, i, f: (a.at + F.get(f.p, i) + F.length(F.get(f.m, i))).cast("int")
    add = lambda a, i, f: F.struct(end_of(a, i, f).alias("at"), F.when(F.length(F.get(f.g, i)) >= least, F.array_append(a.out, F.struct(start_of(a, i, f).alias("start"), end_of(a, i, f).alias("end"), F.lit(ORDER[kind]).alias("ord")))).otherwise(a.out).alias("out"))
    begin = lambda at: F.struct(at.alias("at"), F.array().cast(SPAN).alias("out"))
    last = lambda i, f: F.least(i + (BLOCK - 1), F.size(f.m) - 1)
    block = lambda a, i, f: F.aggregate(F.sequence(i, last(i, f)), begin(a.at), lambda x, j: add(x, j, f))
    put = lambda a, i, f: let(block(a, i, f), lambda x: F.struct(x.at.alias("at"), F.array_append(a.all, x.out).alias("all")))
    start = F.struct(F.lit(0).alias("at"), F.array().cast(f"array<{SPAN}>").alias("all"))
    walk = let(found, lambda f: F.aggregate(F.sequence(F.lit(0), F.size(f.m) - 1, F.lit(BLOCK)), start, lambda a, i: put(a, i, f), lambda a: F.flatten(a.all)))
    return F.when(text.rlike(pattern), walk).otherwise(F.array().cast(SPAN))


def joined(found: Column) -> Column:
    names = F.array(*(F.lit(k) for k in ORDER))
    return F.array_join(F.transform(F.array_sort(F.transform(found, lambda s: F.struct(s.start.alias("start"), s.ord.alias("ord"), s.end.alias("end")))), lambda s: F.concat_ws(":", F.get(names, s.ord), s.start, s.end)), ",")


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", reach: int = 200) -> DataFrame:
    """One row for each row of docs: its id, base and linked (arrays of start, end, ord; ord is the place in ORDER)."""
    text = F.col("t")
    base = F.concat(spans(text, ASSIGN, "assign", MIN_ASSIGN, 2), spans(text, ACCESS, "access"), spans(text, HEX, "hex"))
    parts = {p: [k for k in ORDER if PART[k] == p] for p in ("identifier", "secret", "endpoint")}
    weak = F.concat(*(spans(text, pattern, kind) for kind, pattern, _ in WEAK))
    rows = docs.select(F.col(id_col).alias("id"), whole_text(text_col).alias("t")).select("id", "t", base.alias("base"), weak.alias("weak"), F.monotonically_increasing_id().alias("row"))

    has = lambda ords: F.exists(F.concat("base", "weak"), lambda s: s.ord.isin(*ords))
    # only these can hold a link; the scopes of the others need not be found
    linked = (F.size("weak") > 0) & has([ORDER[k] for k in parts["identifier"]]) & has([ORDER[k] for k in parts["secret"]])
    blanks = F.when(linked, spans(text, r"\n[\x20\x09\x0B-\x0D]*\n\s*", "assign")).otherwise(F.array().cast(SPAN))
    breaks = F.transform(blanks, lambda s: F.struct(s.start.alias("start"), s.end.alias("end"), F.lit(BREAK).alias("ord")))
    # one row holds the text's base findings, the others each a part, so that findings are not copied onto each other
    head = F.array(F.struct(F.lit(-1).alias("start"), F.lit(-1).alias("end"), F.lit(HEAD).alias("ord")))
    events = F.when(linked, F.concat(head, "base", "weak", breaks)).otherwise(head)
    only_head = lambda c: F.when(F.col("e.ord") == HEAD, F.col(c)).alias(c)
    parted = rows.select("id", "row", "base", F.explode(events).alias("e")).select(only_head("id"), "row", only_head("base"), "e.start", "e.end", "e.ord")

    scope = F.sum(F.when(F.col("ord") == BREAK, 1).otherwise(0)).over(Window.partitionBy("row").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, 0))
    inside = F.max(F.when(F.col("ord").isin(*(ORDER[k] for k in BASE)), F.col("end"))).over(Window.partitionBy("row", "scope").orderBy("start", "ord").rowsBetween(Window.unboundedPreceding, 0))
    placed = parted.withColumn("scope", scope).withColumn("_inside", F.coalesce(inside, F.lit(0)))
    # each part stands at its start, and once more, to be judged, `reach` characters after its end
    twice = placed.withColumn("judge", F.explode(F.when(F.col("ord") == HEAD, F.array(F.lit(True))).otherwise(F.array(F.lit(False), F.lit(True)))))
    so_far = Window.partitionBy("row", "scope").orderBy("at").rangeBetween(Window.unboundedPreceding, 0)
    meets = {p: F.max(F.when(~F.col("judge") & F.col("ord").isin(*(ORDER[k] for k in kinds)), F.col("end"))).over(so_far) >= F.col("start") - reach for p, kinds in parts.items()}
    judged = twice.withColumn("at", F.when(F.col("judge"), F.col("end") + reach).otherwise(F.col("start"))).withColumns({f"_{p}": F.coalesce(c, F.lit(False)) for p, c in meets.items()}).where("judge")
    kinds_of = {p: [ORDER[k] for k, _, q in WEAK if q == p] for p in parts}
    reported = (F.col("ord").isin(*kinds_of["identifier"]) & F.col("_secret")) | (F.col("ord").isin(*kinds_of["secret"]) & F.col("_identifier")) | (F.col("ord").isin(*kinds_of["endpoint"]) & F.col("_identifier") & F.col("_secret"))
    span = F.when(reported & (F.col("_inside") <= F.col("start")), F.struct("start", "end", "ord"))
    return judged.groupBy("row").agg(F.max("id").alias(id_col), F.first("base", ignorenulls=True).alias("base"), F.collect_list(span).alias("linked")).drop("row")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = scan_secrets(documents(spark, sf_dir))
    n = lambda kind: F.size(F.filter("base", lambda s: s.ord == ORDER[kind])).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *(n(k) for k in BASE), F.sha2(joined(F.col("base")), 256).alias("base_sha256"), joined(F.concat("base", "linked")).alias("spans"))
