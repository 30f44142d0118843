"""Operators 11 to 13 against brute force or held-out labels, and texts made to collide under polynomial hashes."""

import random
import re
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from test_operators import ROWS, near_brute, pairs

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def spoken_rows():
    """doc_id, lang, source, text: few words, so that phrases repeat; nulls, empty and long texts, repeated rows."""
    rng = random.Random(21)
    words = ["Ab", "c", "É", "dd", "new", "york", "漢字", "x1y", "don't", "the", "of", "-"]
    text = lambda n: "".join(rng.choice(words) + rng.choice((" ", " ", " ", " ", "\t", ". ", ", ", "\n", "  ")) for _ in range(n))
    rows = [(i, rng.choice(("en", "en", "en", "de", None, "")), rng.choice((None, "", *"abcdefg")), text(rng.randint(1, 60))) for i in range(160)]
    rows += [(500, "en", "a", None), (501, "fr", "only", ""), (502, "fr", "other", None), (503, None, "z", "..!? \n"), (504, "xx", "alone", "new york " * 40), (505, "en", "b", text(4000)), (505, "en", "b", "again the of"), (505, "en", "b", "again the of"), (None, "de", "h", "new york")]
    return rows


SPOKEN = spoken_rows()


@pytest.fixture(scope="module")
def spoken(spark):
    df = spark.createDataFrame(SPOKEN, "doc_id long, lang string, source string, text string").repartition(3)
    for c in ("term", "n", "no", "value", "rank", "block", "words", "id", "f", "salt"):
        df = df.withColumn(c, F.lit("clash"))
    return df.cache()


def divergence_brute(rows, min_docs, top):
    counts, docs = defaultdict(Counter), defaultdict(Counter)
    for _, lang, source, text in rows:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", (text or "").translate(LOW))
        counts[lang or "", source or ""].update(found)
        docs[lang or ""].update(set(found))
    out = []
    for lang in {g[0] for g in counts}:
        kept = sorted((t for t, n in docs[lang].items() if n >= min_docs), key=str.encode)
        own = {s: c for (x, s), c in counts.items() if x == lang}
        whole = sum(own.values(), Counter())
        p = lambda c: {t: 1 + 10**9 * (c[t] + 5) // (sum(c[u] for u in kept) + 5 * len(kept)) for t in kept}
        q, ps = p(whole), {s: p(c) for s, c in own.items()}
        for s in own:
            far = sorted(((sum(abs(ps[s][t] - ps[o][t]) for t in kept), o) for o in own if o != s), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "pair", o, v, i + 1) for i, (v, o) in enumerate(far)]
            more = sorted(((ps[s][t] - q[t], t) for t in kept if own[s][t] and ps[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))
            out += [(lang, s, "term", t, v, i + 1) for i, (v, t) in enumerate(more[:top])]
    return sorted(out)


@pytest.mark.parametrize("chunk,block,strip", [(2048, 8, 64), (2, 2, 2), (3, 1, 1)])
def test_source_divergence(spark, spoken, chunk, block, strip):
    from orebody.llm.divergence import source_divergence

    columns = ("lang", "source", "part", "item", "value", "rank")
    want = divergence_brute(SPOKEN, 5, 6)
    got = source_divergence(spoken, min_docs=5, top=6, chunk=chunk, block=block, strip=strip)
    assert sorted(tuple(r[c] for c in columns) for r in got.collect()) == want
    assert {r[2] for r in want} == {"pair", "term"} and ("fr", "only", "pair", "other", 0, 1) in want
    if block == 8:
        assert source_divergence(spoken.limit(0)).count() == 0
        # no term is frequent enough: pairs of value 0 alone
        assert {(r.part, r.value) for r in source_divergence(spoken, min_docs=10**6).collect()} == {("pair", 0)}


def test_divergence_is_exact_beyond_64_bits():
    import numpy as np

    from orebody.llm.divergence import SCALE, probabilities

    counts = np.array([0, 1, 10**11, 3 * 10**12, 4 * 10**15 - 5], np.int64)
    assert probabilities(counts, 4 * 10**15 + 7).tolist() == [1 + SCALE * (int(c) + 5) // (4 * 10**15 + 7) for c in counts]


def phrases_brute(rows, least, top):
    f, n = defaultdict(Counter), Counter()
    for _, lang, _, text in rows:
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(LOW)):
            w = re.findall(r"[^\x20\x09]+", piece)
            n[lang or "und" if lang is None else lang] += len(w)
            for k in range(1, 5):
                f["und" if lang is None else lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, own in f.items():
        found = {g: a for g, a in own.items() if 2 <= len(g) <= 4 and a >= least}
        rows = []
        for g, a in found.items():
            inside = any(len(h) > len(g) and 100 * b >= 80 * a and any(h[i : i + len(g)] == g for i in range(len(h))) for h, b in found.items())
            if not inside:
                score, k = min((2_000_000 * a // (own[g[:k]] + own[g[k:]]), k) for k in range(1, len(g)))
                rows.append((-score, -a, " ".join(g).encode(), own[g[:k]], own[g[k:]]))
        for i, (s, a, g, left, right) in enumerate(sorted(rows)[:top]):
            out.append((lang, i + 1, g.decode(), -a, left, right, n[lang], -s))
    return sorted(out)


@pytest.mark.parametrize("least,top,block,broadcast", [(30, 2000, 6_000_000, 10**6), (3, 40, 100, 0), (5, 7, 1000, 10**6)])
def test_phrases(spark, spoken, least, top, block, broadcast):
    from orebody.llm.phrases import best, mine

    got = best(mine(spoken, least=least, block=block, max_broadcast_rows=broadcast), top)
    want = phrases_brute(SPOKEN, least, top)
    assert sorted(tuple(r[c] for c in ("lang", "rank", "phrase", "a", "l", "r", "n", "score")) for r in got.collect()) == want
    assert {len(r[2].split(" ")) for r in want} >= {2} and {"en", "xx"} <= {r[0] for r in want}
    if least == 3:
        assert {len(r[2].split(" ")) for r in want} == {2, 3, 4} or any(len(r[2].split(" ")) > 2 for r in want)
        assert best(mine(spoken.limit(0))).count() == 0


@pytest.mark.parametrize("most", [0, 10])
def test_phrase_lists_hold_every_place(spark, most):
    """Lists are places in order; merging them with the adjacent words' gives all occurrences, overlaps included."""
    import numpy as np

    from orebody.llm.phrases import blocks, frequent, longer_lists

    text = "a a a b a a, a b c a b. a a"
    lists = blocks(spark.createDataFrame([("en", text)], "lang string, text string"), 1000).cache()
    r = lists.first()
    found = dict(zip(r.words, np.split(np.frombuffer(r.places, np.int32), np.cumsum(r.counts)[:-1])))
    assert {w: x.tolist() for w, x in found.items()} == {"a": [0, 1, 2, 4, 5, 7, 10, 13, 14], "b": [3, 8, 11], "c": [9]}
    words = frequent(lists, ["words"], ["word"], 2, 1).cache()
    names = {x.id: x.word for x in words.collect()}
    two = longer_lists(lists, words, ["words"], ["word"], most).first()
    assert {names[h] + names[t]: x.tolist() for h, t, x in zip(two.heads, two.tails, np.split(np.frombuffer(two.places, np.int32), np.cumsum(two.counts)[:-1]))} == {"aa": [0, 1, 4, 13], "ab": [2, 7, 10], "ba": [3]}


def test_numbers_of_phrases_are_joined_without_gathering_them(spark, spoken):
    """Beyond the broadcast no aggregate holds a block's numbers as objects; the lists are the same."""
    from orebody.llm import phrases

    lists = phrases.blocks(spoken.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.coalesce("text", F.lit("")).alias("text")), 500).cache()
    words = phrases.frequent(lists, ["words"], ["word"], 3, 1).cache()
    of = lambda rows: sorted((r.block, r.lang, r.heads, r.tails, r.counts, bytes(r.places)) for r in rows.collect() if r.heads)
    want = of(phrases.longer_lists(lists, words, ["words"], ["word"], 10**6))
    joined = phrases.longer_lists(lists, words, ["words"], ["word"], 0)
    assert want and "collect_list" not in joined._jdf.queryExecution().toString()
    assert {tuple(r[:2]) for r in of(joined)} == {tuple(r[:2]) for r in want} and sum(map(lambda r: sum(r[4]), of(joined))) == sum(map(lambda r: sum(r[4]), want))


def test_toxicity_on_labels_held_out(spark):
    from orebody.llm.toxicity import held_out, learn, toxicity

    sf = "/root/testdata/sf0.1"
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    docs = spark.read.parquet(f"{sf}/documents.parquet").join(labels.select("doc_id"), "doc_id", "left_semi").repartition(8).cache()
    found = toxicity(docs, learn(docs, labels)).withColumn("held", held_out("doc_id")).join(labels, "doc_id").where("held").collect()
    toxic, clean = [r.score for r in found if r.toxic], [r.score for r in found if not r.toxic]
    assert len(toxic) > 60 and sum(s >= 0.5 for s in toxic) > 0.8 * len(toxic)
    assert sum(s >= 0.5 for s in clean) <= 0.01 * len(clean)
    # neither language nor source nor id is read: the same texts under other ids score the same
    model = learn(docs, labels)
    other = toxicity(docs.select((-F.col("doc_id")).alias("doc_id"), "text"), model).collect()
    assert {-r.doc_id: r.score for r in other} == {r.doc_id: r.score for r in toxicity(docs, model).collect()}


def test_toxicity_of_odd_rows(spark):
    from orebody.llm.toxicity import LEVELS, features, learn, toxicity

    rows = [(None, "x"), *((i, f"word {'vile' if i % 3 == 0 else 'kind'} {i}") for i in range(60)), (70, None), (71, ""), (72, "12 . !"), (73, "word vile " * 150_000), (74, "a word vile thing"), (74, "a word kind thing")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("score", F.lit("clash")).withColumn("found", F.lit("clash"))
    labels = spark.createDataFrame([(None, 1), *((i, int(i % 3 == 0)) for i in range(60)), (3, 0), (5, None)], "doc_id long, toxic int")
    got = toxicity(docs, learn(docs, labels)).collect()
    assert len(got) == len(rows) and toxicity(docs.limit(0), learn(docs, labels)).count() == 0
    by = defaultdict(list)
    for r in got:
        by[r.doc_id].append(r.score)
    assert by[73][0] > 0.5 and max(by[74]) > 0.5 > min(by[74]) and by[70] == by[71] == by[72] and by[70][0] < 0.5
    assert {r.score for r in toxicity(docs, learn(docs, labels.limit(0))).collect()} == {0.0}
    one = {r.score for r in toxicity(docs, learn(docs, labels.where("toxic = 1"))).collect()}
    assert len(one) == 1 and one.pop() > 0.9
    assert {r.score for r in toxicity(docs.limit(0), learn(docs.limit(0), labels)).collect()} == set()
    brute = Counter(f"\0{'vile' * 3}\0"[i : i + n] for n in (3, 4, 5, 6, 7) for i in range(15 - n))
    assert len(features("VileVILEvile!", 22)) == len(brute) + sum(c >= 2 for c in brute.values()) + sum(c >= 3 for c in brute.values()) and LEVELS[0] == (1, 0)


def morse(bits, a, b):
    """Thue and Morse's word of 2^bits letters."""
    return "".join(b if bin(i).count("1") % 2 else a for i in range(1 << bits))


def colliding_rows():
    """Words, and sequences of words and of bytes, whose polynomial hashes modulo 2^64 are equal for every odd base."""
    s, t = morse(10, "a", "b"), morse(10, "b", "a")
    lead = " ".join(f"z{i}" for i in range(19))
    rows = [(1, f"{lead} {s}"), (2, f"{lead} {t}"), (3, s), (4, t), (5, f"q {s} r"), (6, f"q {t} r")]
    rows += [(10 + i, " ".join(morse(11, *letters))) for i, letters in enumerate(("cd", "dc"))]
    rows += [(20 + i, f"{i}" * 30 + morse(9, *letters) + f"{i}" * 30) for i, letters in enumerate(("ef", "fe", "gh", "hg", "ij", "ji"))]
    return rows


def test_texts_made_to_collide_near(spark):
    from orebody.llm.minhash_dedup import near_duplicates

    rows = colliding_rows()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert pairs(got, "doc_id", "n_shingles", "component_id") == sorted(near_brute(rows))


def test_texts_made_to_collide_near_in_one_order(spark):
    """The rows of the test above, with both sides in the order of pairs()."""
    from orebody.llm.minhash_dedup import near_duplicates

    rows = colliding_rows()
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert pairs(got, "doc_id", "n_shingles", "component_id") == sorted(near_brute(rows), key=repr)


def test_texts_made_to_collide_words(spark):
    from orebody.llm.substring_dedup import substring_dedup

    rows, seen, want = colliding_rows(), set(), {}
    for i, text in rows:
        w = text.split(" ")
        cover = [0] * len(w)
        for k in range(len(w) - 19):
            if tuple(w[k : k + 20]) in seen:
                cover[k : k + 20] = [1] * 20
            seen.add(tuple(w[k : k + 20]))
        want[i] = sum(cover)
    got = substring_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == want and want[2] == 0


def test_texts_made_to_collide_bytes(spark):
    from orebody.llm.suffix_array_dedup import suffix_array_dedup

    rows, count, want = colliding_rows(), Counter(), {}
    for _, text in rows:
        count.update(text[k : k + 400] for k in range(len(text) - 399))
    for i, text in rows:
        cover = [0] * len(text)
        for k in range(len(text) - 399):
            if count[text[k : k + 400]] > 1:
                cover[k : k + 400] = [1] * 400
        want[i] = sum(cover)
    got = suffix_array_dedup(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert {r.doc_id: r.n_removed for r in got} == want


def test_passages_of_many_words_are_cut_by_their_bytes(spark):
    """A shared passage of 57 words stays at 399 bytes and goes at 400, from every document that holds it."""
    from orebody.llm.suffix_array_dedup import suffix_array_dedup

    passage = lambda letter, more: " ".join(f"{letter}{i:05d}" for i in range(57)) + more
    texts = [f"{i} before{mark}{passage(letter, more)}{mark}after {i}" for i, (letter, more, mark) in enumerate((("a", "x", "<"), ("a", "x", ">"), ("b", "xx", "<"), ("b", "xx", ">")))]
    assert [len(passage("a", more)) for more in ("x", "xx")] == [399, 400]
    got = suffix_array_dedup(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.n_bytes, r.n_removed, r.n_spans) for r in got) == [(i, len(t), 400 * (i > 1), int(i > 1)) for i, t in enumerate(texts)]
    assert {bytes(r.kept).decode() for r in got if r.doc_id > 1} == {"2 before<<after 2", "3 before>>after 3"}


def test_hashes_depend_on_order_and_key():
    import pickle

    import numpy as np

    from orebody.llm.hashing import Hashes, windows

    h = Hashes()
    same = pickle.loads(pickle.dumps(h))
    words = h.of_words("a b\tc  d\n" * 50)
    assert (same.of_words("a b\tc  d\n" * 50) == words).all() and not (Hashes().of_words("a") == words[:1]).any()
    for width in (1, 2, 5, 7, 8, 20):
        w = windows(words, width)
        assert len(w) == 201 - width and len(np.unique(w)) == 4
    assert len(windows(words[:3], 4)) == 0 and len(h.of_words(None)) == len(h.shingle_set(" \n")) == 0
    assert len(np.unique([windows(np.array([a, b], np.uint64), 2)[0] for a in range(40) for b in range(40)])) == 1600
    assert (h.shingle_set("A b C d E f") == h.shingle_set("a B c D e F")).all() and len(h.shingle_set("one two")) == 1
