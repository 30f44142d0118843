"""Operator 6: mixing to target weights under soft membership.

A classifier learned from the labelled table gives every document posteriors over domains (`high`, `low`, `toxic`): a
naive Bayes over at most `vocabulary` telling words and four shape marks, learned from at most `sample` labelled documents
of each domain (those with the smallest hash of their id), with priors counted over all labels of rows present. A word tells if its share
of a domain's rows is a multiple of its share of the others', so the number of labels does not change what is asked of it.
Only present words vote, and having none of them all votes as one mark: the function words of one language cannot speak
against texts of another. Posteriors are kept to three decimals.

Rates r >= 0 (and at most max_rate, if one is given) minimise the sum over domains of (S_d - T_d)^2 / available_d, where S_d is the sum of
r x tokens x posterior and T_d the target. Projected gradient steps do it: a step lowers each rate by the posteriors
times the domains' relative residuals and clips it, so a rate follows from the posteriors and the residuals of the steps
before. Documents of equal posteriors are summed first; each step is one aggregation over those sums, and the driver
holds one number a domain and step. The total is set so that the `anchor` domain is used whole: targets that the others
cannot reach leave their rates at max_rate.

Tokens are words (runs without white space). A document's copies are the whole part of its rate, and one more if a hash
of its id falls below the rest. Null texts have no words and are judged by their shape alone; null ids hash alike.
Labels may repeat (toxic wins, then low); label rows with nulls in both columns are not used. Without labels the
priors are even. Rows may repeat; each is judged once, inside its row (memory in proportion to its text), and written with
its posteriors to the shared folder, from where the sums and the result are read. An empty table gives no rows. All is done
by SQL functions, and other columns pass through whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from orebody.llm.common import documents, first_by_hash, fresh, saved, whole_text
from orebody.llm.quality_rules import BLANK, SYMBOLS, count_of, let

DOMAINS = ("high", "low", "toxic")
TARGET = {"high": 0.96, "low": 0.03, "toxic": 0.01}
#: Standard errors taken off a word's lift, and the least share of its domain's rows that hold the word.
SURE, SUPPORT = 2.0, 0.01


def features(text: Column) -> Column:
    """Distinct lower-case words without outer punctuation, the marks, and the number of words."""
    words = F.array_remove(F.array_distinct(F.split(F.lower(text), r"[^\p{L}]+")), "")
    n = F.when(F.btrim(text, F.lit(" \t\n\x0b\f\r")) == "", F.lit(0)).otherwise(F.size(F.split(F.btrim(text, F.lit(" \t\n\x0b\f\r")), BLANK + "+")))
    mark = lambda name, holds: F.when(holds, F.lit(f"#{name}")).otherwise(F.lit(""))
    return let(
        F.struct(words.alias("w"), n.alias("n")),
        lambda f: F.struct(
            F.concat(f.w, F.array(mark("symbols", 20 * count_of(text, SYMBOLS) > F.length(text)), mark("capitals", 2 * F.regexp_count(text, F.lit(r"\p{Lu}")) > F.length(text)), mark("few", f.n < 20), mark("repeats", (f.n >= 20) & (3 * F.size(f.w) < f.n)))).alias("words"),
            f.n.cast("long").alias("n"),
        ),
    )


def domain(labels: DataFrame) -> DataFrame:
    """doc_id and its domain."""
    one = labels.where("doc_id IS NOT NULL").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("quality").alias("quality"))
    return one.select("doc_id", F.when(F.col("toxic") == 1, "toxic").when(F.col("quality") == 0, "low").when(F.col("quality") == 1, "high").alias("domain")).where("domain IS NOT NULL")


def learn(docs: DataFrame, labels: DataFrame, id_col: str, text_col: str, sample: int, vocabulary: int, least_lift: float) -> tuple[list[float], list[float], dict[str, list[float]]]:
    """Scores of each domain: its prior, what having no word of the vocabulary adds, and what each word adds when present."""
    # only labelled rows that are here count: a stage before may have removed most of a domain
    known = domain(labels).join(docs.select(F.col(id_col).alias("doc_id")), "doc_id", "left_semi")
    priors = {r.domain: r.n for r in known.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    chosen = first_by_hash(known.select("doc_id", "domain"), "domain", "doc_id", sample)
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("t")).join(F.broadcast(chosen), "doc_id")
    seen = saved(texts.select("domain", F.array_distinct(features(F.col("t")).words).alias("words")), "mixing-labelled")
    n = {r.domain: r.n for r in seen.groupBy("domain").agg(F.count(F.lit(1)).alias("n")).collect()}
    by_domain = lambda rows: [F.count(F.when((F.col("domain") == d) & rows, 1)).alias(d) for d in DOMAINS]
    counts = seen.select("domain", F.explode("words").alias("word")).where("word <> ''").groupBy("word").agg(*by_domain(F.lit(True)))

    def lift(d: str) -> Column:
        # log ratio of the shares in d and in the rest, less SURE standard errors: more rows only make it more certain
        inside, outside = float(n.get(d, 0) + 1), float(sum(n.values()) - n.get(d, 0) + 1)
        a, c = F.col(d) + 0.5, sum((F.col(x) for x in DOMAINS if x != d), F.lit(0)) + 0.5
        return F.log(a / inside * outside / c) - SURE * F.sqrt(F.greatest(F.lit(0.0), 1 / a - 1 / inside) + F.greatest(F.lit(0.0), 1 / c - 1 / outside))

    share = lambda r: [(r[d] + 0.5) / (n.get(d, 0) + 1.0) for d in DOMAINS]
    lifts = F.array(*(F.struct(lift(d).alias("lift"), (F.col(d) / float(n.get(d) or 1)).alias("support")) for d in DOMAINS))
    best = counts.withColumn("vote", F.array_max(lifts)).where((F.col("vote.lift") >= least_lift) & (F.col("vote.support") >= SUPPORT)).orderBy(F.desc(F.col("vote.lift") * F.col("vote.support")), "word").limit(vocabulary).collect()
    adds = {r.word: [math.log(s) for s in share(r)] for r in best}
    base = [math.log((priors.get(d, 0) + 1) / (sum(priors.values()) + len(DOMAINS))) for d in DOMAINS]
    if not adds:
        return base, [0.0] * len(DOMAINS), adds
    plain = seen.agg(*by_domain(~F.arrays_overlap("words", F.array(*(F.lit(w) for w in adds))))).first()
    return base, [math.log(s) for s in share(plain)], adds


def array_of(values) -> Column:
    return F.array(*(F.lit(float(v)) for v in values))


def posteriors(words: Column, base: list[float], plain: list[float], adds: dict[str, list[float]]) -> Column:
    """Array of posteriors in the order of DOMAINS, to three decimals."""
    if adds:
        vocabulary = F.array(*(F.lit(w) for w in adds))
        table = F.map_from_arrays(vocabulary, F.array(*(array_of(v) for v in adds.values())))
        start = lambda found: F.when(F.size(found) == 0, array_of(b + p for b, p in zip(base, plain))).otherwise(array_of(base))
        score = let(F.array_intersect(words, vocabulary), lambda found: F.aggregate(found, start(found), lambda a, w: F.zip_with(a, F.element_at(table, w), lambda x, y: x + y)))
    else:
        score = array_of(base)
    top = let(score, lambda s: let(F.transform(s, lambda x: F.exp(x - F.array_max(s))), lambda e: F.transform(e, lambda x: F.round(x / F.aggregate(e, F.lit(0.0), lambda a, y: a + y), 3))))
    return top


def rate_after(p: Column, steps: list[list[float]], max_rate: float | None) -> Column:
    """The rate after projected steps that began at 1, or at max_rate if that is less."""
    rate = F.lit(float(min(1.0, max_rate or 1.0)))
    if not steps:
        return rate
    dot = lambda g: F.aggregate(F.zip_with(p, g, lambda x, y: x * y), F.lit(0.0), lambda a, y: a + y)
    bounded = lambda r: F.least(F.lit(float(max_rate)), r) if max_rate else r
    return F.aggregate(F.array(*(array_of(s) for s in steps)), rate, lambda r, g: F.greatest(F.lit(0.0), bounded(r - dot(g))))


def fit(groups: DataFrame, target: dict[str, float], anchor: str, max_rate: float | None, steps: int, tolerance: float) -> list[list[float]]:
    """groups: p and tokens. The steps' residuals, from which rate_after() gives every rate."""
    total = lambda rate: groups.agg(*(F.sum(F.col("tokens") * rate * F.col("p")[i]).alias(d) for i, d in enumerate(DOMAINS))).first()
    have = [v or 0.0 for v in total(F.lit(1.0))]
    whole = have[DOMAINS.index(anchor)] * min(1.0, max_rate or 1.0) / target[anchor]
    goal, history = [target[d] * whole for d in DOMAINS], []
    for _ in range(steps):
        now = [v or 0.0 for v in total(rate_after(F.col("p"), history, max_rate))]
        # the scaled problem's curvature is at most 1, for posteriors sum to 1
        step = [(s - t) / h if h else 0.0 for s, t, h in zip(now, goal, have)]
        if history and max(abs(a - b) for a, b in zip(step, history[-1])) < tolerance * 0.1 or max(map(abs, step)) < tolerance:
            break
        history.append(step)
    return history


def mix(docs: DataFrame, labels: DataFrame, target: dict[str, float] = TARGET, anchor: str = "high", max_rate: float | None = None, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None, sample: int = 1500, vocabulary: int = 200, least_lift: float = math.log(4), steps: int = 30, tolerance: float = 1e-3) -> tuple[DataFrame, str]:
    """docs (all columns, or those of keep) with one struct column more, and its name: n_tokens, p (array in the order of
    DOMAINS), rate, copies."""
    out, columns = fresh(docs, "mix"), docs.columns if keep is None else keep
    base, plain, adds = learn(docs, labels, id_col, text_col, sample, vocabulary, least_lift)
    chance = F.pmod(F.xxhash64(F.col(id_col), F.lit(6)), F.lit(1 << 30)) / float(1 << 30)
    judged = let(features(whole_text(text_col)), lambda f: F.struct(f.n.alias("n"), posteriors(f.words, base, plain, adds).alias("p"), chance.alias("chance")))
    seen = saved(docs.select(*columns, judged.alias(out)), "mixing")
    groups = saved(seen.groupBy(F.col(out).p.alias("p")).agg(F.sum(F.col(out).n).cast("double").alias("tokens")), "mixing-groups").coalesce(8)
    history = fit(groups, target, anchor, max_rate, steps, tolerance)
    copies = lambda r: (F.floor(r) + F.when(F.col(out).chance < r - F.floor(r), 1).otherwise(0)).cast("long")
    rated = let(rate_after(F.col(out).p, history, max_rate), lambda r: F.struct(F.col(out).n.alias("n_tokens"), F.col(out).p.alias("p"), r.alias("rate"), copies(r).alias("copies")))
    return seen.withColumn(out, rated), out


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    mixed, out = mix(documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/labels.parquet"), keep=["doc_id"])
    return mixed.select("doc_id", f"{out}.n_tokens", *(F.col(out).p[i].alias(f"p_{d}") for i, d in enumerate(DOMAINS)), f"{out}.rate", f"{out}.copies")
