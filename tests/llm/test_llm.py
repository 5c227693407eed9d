"""Each operator on rows with nulls, empty and repeated texts, and extra columns with clashing names; and on no rows."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from graindeck.llm import ann, bpe, components, fixity, linededup, lm, mixing, pii, quality, rules, sigtree

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, size string"
BASE = " ".join(f"word{i}" for i in range(60))
NEAR = BASE.replace("word30", "other")
TEXTS = [BASE, BASE, NEAR, None, "", " \n\t", "one", "a b c d e f", "x " * 4000, "Line one is here now\nLine one is here now\nlast line", "mail a@b.com, 1.2.3.4, +1 (415) 555-2671, 4111111111111111 é <|endoftext|>", "&&& ### $$$ %%% " * 30, BASE.upper()]
ROWS = [(i, t, None if i == 3 else "en", None if i in (4, 5) else f"s{i % 3}", 1, 0.5, "z") for i, t in enumerate(TEXTS)] + [(None, BASE, "en", "s0", 1, None, None), (0, BASE, "en", "s0", 1, 0.5, "z")]
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(ROWS, SCHEMA).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def test_quality(spark, docs, none):
    labels = spark.createDataFrame([(i, int(i % 4 != 3), 0) for i in range(13)] + [(None, 1, 0), (2, None, 0)], "doc_id long, quality int, toxic int")
    got = quality.classify(docs, labels).collect()
    assert len(got) == len(ROWS) and all(0 <= r["score"] <= 1 and r["predicted"] == int(r["score"] >= 0.3) for r in got)
    assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"] if r["doc_id"] is not None else "").encode()) % 5 == 0) for r in got)
    assert quality.classify(none, labels).count() == 0
    assert {r["score"] for r in quality.classify(docs, labels.limit(0)).collect()} == {0.5}


def test_mixing(spark, docs, none):
    got = mixing.mix(docs).collect()
    assert len(got) == len(ROWS)
    size = {s: sum(len(WORD.findall(r[1] or "")) for r in ROWS if r[3] == s) for s in {r[3] for r in ROWS}}
    share, left, open_ = {}, 1.5 * sum(size.values()), sorted(size, key=lambda s: (s is None, s or ""))
    weight = dict(zip(open_, [5, 2, 1] * 9))
    while open_:
        level = left / sum(weight[s] for s in open_)
        full = [s for s in open_ if 2 * size[s] < level * weight[s]]
        if not full:
            share |= {s: level * weight[s] for s in open_}
            break
        share |= {s: 2.0 * size[s] for s in full}
        left -= sum(2 * size[s] for s in full)
        open_ = [s for s in open_ if s not in full]
    assert all(abs(r["target"] - share[r["source"]]) < 1e-6 and r["source_size"] == size[r["source"]] and r["taken"] <= 2 * int(r["size"]) for r in got)
    for s in size:
        mine = [r for r in got if r["source"] == s]
        assert abs(sum(r["taken"] for r in mine) - share[s]) <= max(int(r["size"]) for r in mine)
    assert sorted(map(str, got)) == sorted(map(str, mixing.mix(docs).collect())) and mixing.mix(none).count() == 0


def test_mixing_keeps_targets_over_several_levels(spark):
    many = spark.range(2000).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.expr("repeat('w ', cast(id % 37 as int))").alias("text")).unionByName(spark.sql("select -1L doc_id, 't' source, 'a b' text"))
    got = mixing.mix(many, weights=(1,), share=0.7, block=16).where("source = 's'").agg(F.sum("taken").alias("n"), F.max("target").alias("t")).first()
    assert abs(got["n"] - got["t"]) <= 37


def test_fixity(spark):
    pages = spark.createDataFrame([(i, f"http://h/{i}", None if i == 3 else f"<p>{i}</p>") for i in range(300)] + [(None, None, "x"), (7, "http://h/7", "<p>7</p>")], "page_id long, url string, html string")
    bad = pages.withColumn("html", F.when(F.col("page_id") == 42, "<p>4!</p>").otherwise(F.col("html")))
    got = fixity.verify(pages, bad).collect()
    assert len(got) == 302 and [r["page_id"] for r in got if not r["intact"]] == [42]
    levels = {r["level"]: r["n"] for r in fixity.audit(fixity.leaves(fixity.records(pages)), fixity.leaves(fixity.records(bad))).groupBy("level").agg(F.count(F.lit(1)).alias("n")).collect()}
    assert levels == {0: 1, 1: 1, 2: 1, 3: 1}
    assert fixity.verify(pages.limit(0), pages.limit(0)).count() == 0


def test_line_dedup(spark, docs, none):
    long = "alpha beta gamma delta epsilon zeta eta theta iota kappa"
    extra = spark.createDataFrame([(100, long, "en", "s0", 1, None, None), (101, long.replace("kappa", "lambda"), "en", "s0", 1, None, None), (102, "p q r s\np q r s t", "en", "s0", 1, None, None)], SCHEMA)
    df = docs.unionByName(extra)
    got = linededup.dedup_lines(df)
    assert got.columns == [*df.columns, "lines_removed"]
    rows = [r.asDict() for r in df.collect()]
    order = sorted(((r["doc_id"] is None, r["doc_id"] or 0, i, frozenset(WORD.findall(line)), r["text"]) for r in rows for i, line in enumerate((r["text"] or "").split("\n"))), key=lambda x: x[:3])
    gone, seen = Counter(), []
    for missing, key, i, words, text in order:
        at = (missing, key, i)
        if words and any(a < at and 100 * len(words & o) >= 80 * len(words | o) for a, o in seen):
            gone[(None if missing else key, i)] += 1
        seen.append((at, words)) if words else None
    assert {(r["doc_id"], i) for r in got.collect() for i in r["lines_removed"]} == set(gone)
    texts = {r["doc_id"]: r["text"] for r in got.collect()}
    assert texts[9] == "Line one is here now\nlast line" and texts[102] == "p q r s" and texts[3] is None and texts[5] == " \n\t"
    assert linededup.dedup_lines(none).count() == 0


def test_line_dedup_pairs_no_unrelated_long_lines(spark, monkeypatch):
    """Long lines that share rare words without being similar are told apart by their parities, not by verifying pairs of them."""
    r = random.Random(7)
    vocabulary = [f"w{i}" for i in range(4000)]
    lines = [r.sample(vocabulary, r.choice((140, 170, 300))) for _ in range(150)]
    lines += [x[:-n] + [f"new{i}" for i in range(n)] for x in lines[:9] for n in (3, 60)]
    df = spark.createDataFrame([(i, " ".join(x)) for i, x in enumerate(lines)], "doc_id long, text string")
    pairs, written = [], linededup.written

    def counted(d, tag):
        out = written(d, tag)
        if tag == "pairs":
            pairs.append(out.count())
        return out

    monkeypatch.setattr(linededup, "written", counted)
    gone = {r["doc_id"] for r in linededup.dedup_lines(df).collect() if r["lines_removed"]}
    sets = [set(x) for x in lines]
    assert gone == {j for j, b in enumerate(sets) if any(100 * len(a & b) >= 80 * len(a | b) for a in sets[:j])} and len(gone) >= 9
    assert sum(pairs) < 200


def test_line_dedup_joins_share_an_exchange(spark, monkeypatch):
    """Both sides of a join on prefix keys read one exchange, so that keys are dealt out once for each join."""
    r = random.Random(5)
    lines = [r.sample(range(300), 30) for _ in range(100)]
    df = spark.createDataFrame([(i, " ".join(f"w{w}" for w in x)) for i, x in enumerate(lines + [x[1:] for x in lines])], "doc_id long, text string")
    plans, written = [], linededup.written

    def seen(d, tag):
        if tag == "pairs":
            d.collect()
            plans.append(d._jdf.queryExecution().executedPlan().toString())
        return written(d, tag)

    monkeypatch.setattr(linededup, "written", seen)
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        linededup.removals(df)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert "ReusedExchange" in plans[0]


def test_line_dedup_names_classes_in_order(spark):
    """A class has the number of its earliest line, by (missing, id, document, line), and one row of it if rows are repeated."""
    rows = [(3, "a b\nc d"), (None, "c d\ne"), (2, "c d\n\nb a"), (2, "c d\n\nb a"), (5, "f\na b")]
    df = spark.createDataFrame(rows, "id long, text string").repartition(3)
    lines = linededup.lines_of(df, "text", "id").withColumn("w", linededup.word_hashes(F.col("s"))).where(F.size("w") > 0)
    k = F.sort_array("w")
    lines = lines.select(*linededup.ORDER, F.monotonically_increasing_id().alias("row"), F.xxhash64(k).alias("sig"), F.size(k).alias("n"), k.alias("prefix"), *linededup.parities(k))
    got = sorted(linededup.classed(linededup.written(lines, "lines")).collect(), key=lambda r: (r["cid"], not r["first"], r["missing"], r["id"] or 0, r["line"]))
    assert [(r["id"], r["line"], r["first"]) for r in got] == [(2, 0, True), (3, 1, False), (None, 0, False), (2, 2, True), (3, 0, False), (5, 1, False), (5, 0, True), (None, 1, True)]


def test_signature_trees(spark, docs, none):
    got = {(r["doc_id"], r["n_shingles"], r["component_id"]) for r in sigtree.link(docs).collect()}
    sets = {r[0]: shingles(r[1]) for r in ROWS if r[0] is not None}
    root = {k: k for k in sets}
    for a in sets:
        for b in sets:
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = {k: low if v == high else v for k, v in root.items()}
    assert got == {(k, len(s), root[k]) for k, s in sets.items()} | {(None, len(shingles(BASE)), None)}
    assert sigtree.link(none).count() == 0


def test_traversal_finds_every_component():
    r = np.random.default_rng(1)
    base = r.integers(-(2**62), 2**62, 80)
    sets = [np.sort(np.unique(np.concatenate((base[: 80 - k], r.integers(-(2**62), 2**62, k))))) for k in r.integers(0, 30, 120)]
    leaves = [sigtree.Node(None, i, i, len(s), w := sigtree.width_of(len(s)), sigtree.bitmap(s.view(np.uint64), w), s) for i, s in enumerate(sets)]
    links = list(sigtree.traverse([sigtree.trees(leaves)]))
    root = list(range(120))
    truth = list(range(120))
    for pairs, of in ((links, root), ([(i, j) for i in range(120) for j in range(i) if (c := len(np.intersect1d(sets[i], sets[j]))) * 100 >= 80 * (len(sets[i]) + len(sets[j]) - c)], truth)):
        for a, b in pairs:
            low, high = sorted((of[a], of[b]))
            of[:] = [low if v == high else v for v in of]
    assert root == truth


def test_bitmaps_rule_out_no_pair_that_links():
    """Of leaves and of inner nodes, of equal and of neighbouring widths."""
    r = np.random.default_rng(8)
    sets = []
    for _ in range(30):
        base = r.integers(-(2**62), 2**62, int(r.integers(5, 300)))
        sets += [np.unique(np.concatenate((base[: len(base) - k], r.integers(-(2**62), 2**62, int(r.integers(0, 1 + len(base) // 9)))))) for k in r.integers(0, 1 + len(base) // 9, 6)]
    leaves = [sigtree.Node(None, i, i, len(s), w := sigtree.width_of(len(s)), sigtree.bitmap(s.view(np.uint64), w), s) for i, s in enumerate(sets)]
    links = [(a, b) for a in range(len(sets)) for b in range(a) if sigtree.overlap_links(sets[a], sets[b])]
    assert links and all(sigtree.may_link(leaves[a], leaves[b]) for a, b in links)
    by = {w: [x for x in leaves if x.width == w] for w in {x.width for x in leaves}}
    above = {x.leaf: n for v in by.values() for i in range(0, len(v), 8) for n in [sigtree.Node(v[i : i + 8])] for x in v[i : i + 8]}
    assert {abs(leaves[a].width - leaves[b].width) for a, b in links} == {0, 1}
    assert all(sigtree.may_link(above[a], above[b]) for a, b in links)


def test_signature_trees_in_small_blocks(spark):
    """Groups that are cut into many blocks keep every component, and repeated texts are one class."""
    r = np.random.default_rng(9)
    texts = []
    for g in range(6):
        base = [f"g{g}w{i}" for i in range(60)]
        for _ in range(25):
            w = list(base)
            for i in r.integers(0, 60, int(r.integers(0, 4))):
                w[i] = f"x{r.integers(0, 10**6)}"
            texts.append(" ".join(w))
    texts += texts[:20]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    sets = [shingles(t) for t in texts]
    root = list(range(len(texts)))
    for a in range(len(texts)):
        for b in range(a):
            if 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                low, high = sorted((root[a], root[b]))
                root = [low if v == high else v for v in root]
    for block in (4, 4096):
        assert {r["doc_id"]: r["component_id"] for r in sigtree.link(df, block=block).collect()} == dict(enumerate(root))


def test_components_of_a_chain(spark):
    edges = spark.range(200).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b")).unionByName(spark.sql("select 500L a, 501L b union all select 9L, 9L"))
    got = {r["node"]: r["component"] for r in components.components(edges).collect()}
    assert got == {i: 0 for i in range(201)} | {500: 500, 501: 500}


def test_pii(spark, docs, none):
    got = {r["doc_id"]: r for r in pii.find(docs).where("doc_id is not null").collect()}
    spans = [(pii.KINDS[s["kind"]], TEXTS[10][s["start"] : s["end"]]) for s in got[10]["base"]]
    assert spans == [("email", "a@b.com"), ("ip", "1.2.3.4"), ("card", "4111111111111111"), ("phone", "+1 (415) 555-2671")]
    assert not any(got[i]["base"] or got[i]["added"] for i in got if i != 10)
    assert pii.redact(docs).where("doc_id = 10").first()["redacted"].startswith("mail [email], [ip], [phone], [card] é")
    added = pii.find(spark.createDataFrame([(1, "please call (415) 555-1234 or mail to bob at example dot com now")], "doc_id long, text string")).first()["added"]
    assert {s["m"] for s in added} == {"(415) 555-1234", "bob at example dot com"}
    assert pii.find(none).count() == 0


def test_pii_gates_let_every_loose_email_through(spark):
    texts = [f"bob{at}example{dot}com" for at in ("@", " @ ", "(at)", "[at]", " [at] ", " at ") for dot in (".", "(dot)", "[dot]", " [dot] ", "[.]", "(.)", " dot ")]
    rows = spark.createDataFrame([(t,) for t in texts], "t string")
    none = F.expr(f"cast(array() as {pii.SPAN})")
    got = rows.select("t", pii.candidates(F.col("t"), none).alias("c")).collect()
    assert [[c["m"] for c in r["c"]] for r in got] == [[r["t"]] for r in got]
    # a model that takes every candidate: what find() passes to it
    always = {k: ([1.0], 0.0) for k in range(len(pii.KINDS))}
    found = pii.find(rows, "t", always).collect()
    assert {r["t"]: [s["m"] for s in [*r["base"], *r["added"]]] for r in found} == {t: [t] for t in texts}


@pytest.mark.parametrize("text", ["a@b.c_d@e.f x@y @a.b a.@b.c.d-", "1.2.3.4.5.6.7.8 256.1.1.1 01.02.03.004", "+1 23 +123456789012345678 +12345678)(", "4111 1111-1111 1111 5 41111111111111111111", "9" * 5000])
def test_pii_base_is_the_plain_patterns(spark, text):
    plain = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}

    def fine(kind, m):
        d = re.sub("[^0-9]", "", m)
        luhn = lambda: sum(sum(divmod(int(x) * (1 + i % 2), 10)) for i, x in enumerate(reversed(d))) % 10 == 0
        return {"email": lambda: True, "ip": lambda: all(int(x) <= 255 for x in m.split(".")), "card": lambda: 16 <= len(d) <= 19 and luhn(), "phone": lambda: 8 <= len(d) <= 15}[kind]()

    want = ",".join(f"{k}:{m.start()}:{m.end()}" for k, p in plain.items() for m in re.finditer(p, text) if fine(k, m.group()))
    assert spark.createDataFrame([(text,)], "t string").select(pii.joined(pii.base_spans(F.col("t")))).first()[0] == want


def test_bpe(spark, docs, none):
    from tokenizers import Tokenizer

    ours, theirs = bpe.tokenizer(bpe.vocabulary()), Tokenizer.from_file(bpe.vocabulary())
    texts = [t or "" for t in TEXTS] + ["don't  we'll\n\n I'D", "😀é中文 ½ ١٢", "aaaaaaaaaaaaa", "\x1c\x1d \x85 x", "<|endoftext|>"]
    for t in texts + list(theirs.get_vocab())[:2000]:
        ids = theirs.encode(t, add_special_tokens=False).ids
        assert np.frombuffer(ours.encode(t), "<u4").tolist() == ids and ours.decode(ours.encode(t)) == theirs.decode(ids, skip_special_tokens=False)
    got = bpe.round_trip(docs, bpe.vocabulary()).where("doc_id = 3 or doc_id = 7").orderBy("doc_id").collect()
    assert got[0]["n_tokens"] == 0 and got[0]["ids_sha256"] == hashlib.sha256(b"").hexdigest() and got[1]["decoded_sha256"] == hashlib.sha256(b"a b c d e f").hexdigest()
    back = bpe.decode(bpe.encode(docs, bpe.vocabulary()), bpe.vocabulary())
    assert back.where("decoded <> coalesce(text, '')").count() == 0 and bpe.round_trip(none, bpe.vocabulary()).count() == 0


def test_lm(spark, docs, none):
    got = lm.score_documents(docs).collect()
    tokens = lambda t: [*(t or "").encode().lower().split(), b"\n"]
    held = lambda k: zlib.crc32(("" if k is None else str(k)).encode()) % 5 == 1
    count = Counter(w for r in ROWS if not held(r[0]) for w in tokens(r[1]))
    n, v = sum(count.values()), len(count)
    want = sorted((r[0] is None, r[0] or 0, held(r[0]), len(tokens(r[1])), sum(w in count for w in tokens(r[1])), n, round(sum(math.log10((count[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tokens(r[1])), 6)) for r in ROWS)
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 6)) for r in got) == want
    assert all(math.isfinite(r["score"]) and r["score"] < 0 for r in got)
    assert lm.score_documents(none).count() == 0


def test_lm_counts_words_not_classes(spark):
    """The score of every document is the formula's, with the counts of whole words by brute force."""
    r = np.random.default_rng(7)
    passage = " ".join(f"rare{i}x" for i in range(40))  # words that end alike, in one order in some texts and shuffled in others
    texts = [" ".join(f"w{x}" for x in r.zipf(1.4, 60) % 50) for _ in range(60)]
    texts += [passage if i % 2 else " ".join(r.permutation(passage.split())) for i in range(40)]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
    held = {i: zlib.crc32(str(i).encode()) % 5 == 1 for i in range(len(texts))}
    seqs = {i: [*t.encode().lower().split(), b"\n"] for i, t in enumerate(texts)}
    padded = {i: [None, None, *s] for i, s in seqs.items()}
    count = {k: Counter(tuple(p[j - k + 1 : j + 1]) for i, p in padded.items() if not held[i] for j in range(2, len(p))) for k in (1, 2, 3)}
    of = {k: Counter(tuple(p[j - k + 1 : j]) for i, p in padded.items() if not held[i] for j in range(2, len(p))) for k in (2, 3)}
    n, v = sum(count[1].values()), len(count[1])

    def position(p, j):
        g = {k: tuple(p[j - k + 1 : j + 1]) for k in (1, 2, 3)}
        return [count[k][g[k]] for k in (1, 2, 3)] + [of[k][g[k][:-1]] for k in (2, 3)]

    cells = Counter()
    for i, p in padded.items():
        for j in range(2, len(p)):
            if not held[i]:
                cells[tuple(x - 1 for x in position(p, j))] += 1
    c1, c2, c3, of1, of2 = (np.array(x) for x in zip(*cells))
    step = lambda f: np.where(f > 0, lm.STEPS - 1 + np.round(4 * np.log2(np.maximum(f, 1e-30))), 0).astype(np.int64)
    e1, e2, e3 = (step(f) for f in lm.estimates(c1, c2, c3, of1, of2, n - 1))
    weight = lm.interpolate(((lm.buckets(of1, of2) * lm.STEPS + e3) * lm.STEPS + e2) * lm.STEPS + e1, np.array(list(cells.values()), float), v)

    def score(i):
        total = 0.0
        for j in range(2, len(padded[i])):
            c1, c2, c3, of1, of2 = position(padded[i], j)
            m = weight[int(lm.buckets(np.array([of1]), np.array([of2]))[0])]
            total += math.log10((m[0] + (0 if of1 else m[2]) + (0 if of2 else m[3])) / (v + 1) + m[1] * c1 / n + m[2] * c2 / max(1, of1) + m[3] * c3 / max(1, of2))
        return total

    got = {r["doc_id"]: r["score"] for r in lm.score_documents(rows).collect()}
    assert got.keys() == seqs.keys() and all(abs(got[i] - score(i)) < 1e-6 for i in got)
    # a passage that training text repeats word for word is likelier than its words in another order
    odd, even = ([got[i] for i in range(60, 100) if i % 2 == k and held[i]] for k in (1, 0))
    assert odd and even and min(odd) > max(even) + 20


def test_rules(spark, docs, none):
    got = rules.judge(docs).collect()
    assert len(got) == len(ROWS) and all(not r["kept"] for r in got if r["base_failed"])
    by = {r["doc_id"]: r for r in got}
    x = by[9]
    assert (x["n_words"], x["word_chars"], x["n_symbols"], x["n_dup_lines"], x["n_repeat_words"]) == (12, sum(map(len, WORD.findall(TEXTS[9]))), 0, 1, 10)
    assert by[8]["n_repeat_words"] == 4000 and by[11]["n_symbols"] == 360 and by[3]["n_words"] == 0
    assert rules.judge(none).count() == 0


def test_ann_equals_brute_force_where_it_visits_all(spark):
    r = np.random.default_rng(2)
    x = r.normal(size=(300, 8)).astype(np.float32)
    x[7] = x[8]
    rows = [(i, v.tolist()) for i, v in enumerate(x)] + [(300, None), (301, [0.0] * 8), (302, [float("nan")] * 8), (303, [1.0]), (304, []), (305, [None] * 8)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, recall=1.0).collect()
    y = x.astype(float)
    for q in range(0, 300, 20):
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        want = np.lexsort((np.arange(300), -s))[:20].tolist()
        assert [g["vec_id"] for g in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == want
    assert len(got) == 300 and ann.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_ann_searches_each_dimension(spark):
    r = np.random.default_rng(4)
    x = [r.normal(size=6 if i < 40 else 9) for i in range(65)]
    got = ann.search(spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>"), F.col("vec_id") % 8 == 0).collect()
    for q in range(0, 65, 8):
        same = [i for i in range(65) if i != q and len(x[i]) == len(x[q])]
        want = sorted(same, key=lambda i: -float(x[i] @ x[q]))[:20]
        assert [g["vec_id"] for g in sorted((g for g in got if g["query_id"] == q), key=lambda g: g["rank"])] == want


def test_ann_routes(spark):
    r = np.random.default_rng(3)
    x = r.normal(size=(40, 16))[r.integers(0, 40, 4000)] + 0.2 * r.normal(size=(4000, 16))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 50 == 0, part_rows=250).collect()
    found = 0
    for q in range(0, 4000, 50):
        s = x @ x[q]
        s[q] = -np.inf
        found += len({g["vec_id"] for g in got if g["query_id"] == q} & set(np.argsort(-s)[:20].tolist()))
    assert found / (80 * 20) >= 0.9


def test_ann_recall_on_the_embeddings_by_part_of_the_parts(spark):
    """Queries are the ids divisible by 50; the 0.9 is measured against brute force, with fewer parts visited than there are."""
    df = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    rows = df.select("vec_id", "embedding").orderBy("vec_id").collect()
    x, ids = np.array([r["embedding"] for r in rows], float), np.array([r["vec_id"] for r in rows])
    fitted, parts = ann.index(df.select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("v")), len(rows), ann.SAMPLE, ann.PART, 11, ann.RECALL)
    assert parts >= 10 and fitted.visits < parts
    size = np.bincount(fitted.put(x), minlength=parts)
    assert size.max() <= 1.5 * size.mean()  # balanced over all rows
    got = {}
    for r in ann.search(df, F.col("vec_id") % 50 == 0).collect():
        got.setdefault(r["query_id"], set()).add(r["vec_id"])
    found = 0
    for q in np.flatnonzero(ids % 50 == 0):
        score = x @ x[q]
        score[q] = -np.inf
        found += len(got[ids[q]] & set(ids[np.lexsort((ids, -score))[:20]].tolist()))
    assert found / (20 * len(got)) >= 0.9 and len(got) == (ids % 50 == 0).sum()


def test_ann_brings_back_rows_by_shelves_not_by_parts(spark, monkeypatch):
    """What a query brings back for the last ranking doesn't grow with the number of parts that it visits."""
    x = np.random.default_rng(4).normal(size=(3200, 8))
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)], "vec_id long, embedding array<double>")
    frame, made = type(df), []
    with_column = frame.withColumn
    monkeypatch.setattr(frame, "withColumn", lambda self, name, c: (made.append(len(self.collect())) if name == "rank" else None, with_column(self, name, c))[1])
    got = ann.search(df, F.col("vec_id") % 40 == 0, part_rows=40, recall=1.0).collect()
    assert len(got) == 80 * 20 and made[0] <= 80 * 20 * (ann.SHELVES + 1)
    for q in range(0, 3200, 400):
        s = (x * x[q]).sum(axis=1)
        assert [r["vec_id"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q] == sorted(set(range(3200)) - {q}, key=lambda i: (-s[i], i))[:20]


def test_ann_repeated_rows_count_once(spark):
    r = np.random.default_rng(6)
    x = r.normal(size=(90, 5))
    rows = [(i, v.tolist()) for i, v in enumerate(x)]
    df = spark.createDataFrame(rows + [rows[20], rows[20], rows[31], (40, r.normal(size=5).tolist())], "vec_id long, embedding array<double>")
    got = ann.search(df, F.col("vec_id") % 20 == 0, recall=1.0).orderBy("query_id", "rank").collect()
    assert {q: sum(g["query_id"] == q for g in got) for q in (0, 20, 40, 60, 80)} == {0: 20, 20: 20, 40: 40, 60: 20, 80: 20}  # id 40 has two vectors
    mine = [g["vec_id"] for g in got if g["query_id"] == 20]
    every = np.array([v for _, v in rows] + [df.collect()[-1]["embedding"]])
    ids = np.array([*range(90), 40])
    score = every @ x[20]
    score[ids == 20] = -np.inf
    assert mine == ids[np.lexsort((ids, -score))][:20].tolist()


def test_quality_scores_are_the_discriminant(spark):
    """Every score recomputed from the statistics with numpy."""
    r = np.random.default_rng(5)
    texts = [" ".join("".join(r.choice(list("abcde"), int(r.integers(2, 9)))) + ("!!" if i % 3 == 0 and r.random() < 0.4 else "") for _ in range(int(r.integers(5, 80)))) for i in range(120)]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 != 0), 0) for i in range(100)], "doc_id long, quality int, toxic int")
    got = {g["doc_id"]: g["score"] for g in quality.classify(df, labels).collect()}
    x = np.array([quality.statistics(t) for t in texts])
    train = [i for i in range(100) if zlib.crc32(str(i).encode()) % 5 != 0]
    by = {k: x[[i for i in train if int(i % 3 != 0) == k]] for k in (0, 1)}
    cov = {k: np.cov(v.T, bias=True) for k, v in by.items()}
    pooled = sum(len(v) * cov[k] for k, v in by.items()) / len(train)
    log = {}
    for k, v in by.items():
        s = (1 - quality.TO_POOLED) * cov[k] + quality.TO_POOLED * pooled
        s = (1 - quality.TO_IDENTITY) * s + quality.TO_IDENTITY * np.trace(s) / len(s) * np.eye(len(s))
        d = x - v.mean(0)
        log[k] = np.log(len(v) / len(train)) - 0.5 * np.linalg.slogdet(s)[1] - 0.5 * (d * np.linalg.solve(s, d.T).T).sum(1)
    want = 1 / (1 + np.exp(-(log[1] - log[0])))
    assert all(abs(got[i] - want[i]) < 1e-6 for i in range(120))


def test_rules_are_the_least_determinant(spark):
    """Distances and verdicts recomputed with numpy: three starts, concentration steps, the least determinant."""
    r = np.random.default_rng(12)
    rows = []
    for i in range(700):
        n = int(r.integers(55, 160))
        words = ["".join(r.choice(list("abcdefgh"), int(r.integers(3, 8)))) for _ in range(n)]
        if i % 20 == 0:  # outliers: symbols or very long words
            words = [w + "#$%" for w in words] if i % 40 else ["".join(r.choice(list("xyz"), 60)) for _ in words]
        rows.append((i, " ".join(words), "en" if i < 400 else "de", f"s{i % 2}" if i < 650 else "small"))
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").repartition(3)
    got = {g["doc_id"]: g for g in rules.judge(df).collect()}
    names, floor = list(rules.FLOOR), np.array(list(rules.FLOOR.values()))
    stats = {g["doc_id"]: g for g in rules.transformed(rules.statistics(df)).collect()}
    x = np.array([[stats[i][n] for n in names] for i in range(700)])
    fine = np.array([not stats[i]["base_failed"] for i in range(700)])
    p = len(names)
    bin_limit = lambda b, share: np.sort(b)[int(np.ceil(share * len(b))) - 1]
    squared = lambda x, m, s: ((d := x - m) * np.linalg.solve(s + np.diag(floor**2), d.T).T).sum(1)
    bins = lambda d: np.floor(rules.BINS * np.log(d + 1e-6))

    def fitted(x):
        middle = lambda y: np.array([bin_limit(np.floor(rules.FINE * c + 0.5), 0.5) / rules.FINE for c in y.T])
        mid = middle(x)
        mad = 1.4826 * middle(np.abs(x - mid))
        scale = np.sqrt(mad**2 + floor**2)
        z = (x - mid) / scale
        u = z / np.sqrt(np.maximum((z**2).sum(1), 1e-12))[:, None]
        best = None
        for m, s in ((mid, np.diag(mad**2)), (x.mean(0), np.cov(x.T, bias=True)), (mid, p * (u.T @ u / len(u)) * np.outer(scale, scale))):
            for _ in range(rules.STEPS):
                b = bins(squared(x, m, s))
                near = x[b <= bin_limit(b, rules.H)]
                m, s = near.mean(0), np.cov(near.T, bias=True)
            det = np.linalg.slogdet(s + np.diag(floor**2))[1]
            if best is None or det < best[0] - 1e-9:
                best = det, m, s
        _, m, s = best
        f = rules.chi_squared(rules.H, p) / np.exp((bin_limit(bins(squared(x, m, s)), rules.H) + 1) / rules.BINS)
        return lambda y: np.sqrt(squared(y, m, s) * f)

    group = np.array([f"{r_[2]}-{r_[3]}" for r_ in rows])
    for g in set(group):
        of = (group == g) & fine
        if of.sum() < rules.SMALL:  # the language's
            of = np.array([r_[2] == g[:2] for r_ in rows]) & fine
        measure = fitted(x[of])
        for i in np.flatnonzero(group == g):
            d = measure(x[i : i + 1])[0]
            assert abs(got[i]["distance"] - d) < 1e-6 * (1 + d) and got[i]["kept"] == (bool(fine[i]) and d <= rules.CUT)
    # the planted outliers are farther away than all others
    odd = [got[i]["distance"] for i in range(0, 700, 20) if fine[i]]
    even = [got[i]["distance"] for i in range(700) if i % 20 and fine[i]]
    assert min(odd) > max(even)


def test_clashing_names(spark):
    """Helper and result names of the operators as columns of the input."""
    names = ["_id", "_doc", "_gone", "_bpe", "_key", "_words", "_lines", "n_words", "kept", "distance", "_row", "k", "m", "w", "line", "doc", "cid", "lines_removed", "n_tokens", "base", "added", "held_out", "_copy", "_h"]
    base = spark.createDataFrame([(i, " ".join(f"w{i}x{j}" for j in range(60)), "en", "s") for i in range(6)], "doc_id long, text string, lang string, source string")
    df = base.select("*", *(F.lit(7).alias(n) for n in names))
    labels = spark.createDataFrame([(i, i % 2, 0) for i in range(6)], "doc_id long, quality int, toxic int")
    for got in (linededup.dedup_lines(df), rules.judge(df), bpe.round_trip(df, bpe.vocabulary()), pii.find(df), quality.classify(df, labels), mixing.mix(df), sigtree.link(df), lm.score_documents(df)):
        assert got.count() == 6 and len(set(got.columns)) == len(got.columns)


def test_very_long_texts(spark):
    """One word of a million letters, many words, many lines, and many matches."""
    texts = ["x" * 1_000_000, "ab cd " * 50_000, "\n".join(f"line {i} has its own words {i * 7}" for i in range(2_000)), " ".join(f"u{i}@example.com" for i in range(300))]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: r for r in sigtree.link(df).collect()}
    assert [got[i]["n_shingles"] for i in range(3)] == [1, 2, len(shingles(texts[2]))]
    assert {r["doc_id"]: len(r["lines_removed"]) for r in linededup.dedup_lines(df).collect()}[0] == 0
    back = bpe.decode(bpe.encode(df, bpe.vocabulary()), bpe.vocabulary())
    assert back.where("decoded <> text").count() == 0
    assert {r["doc_id"]: r["n_words"] for r in rules.judge(df).collect()}[1] == 100_000
    assert len(pii.find(df).where("doc_id = 3").first()["base"]) == 300


def test_pii_trees_are_the_expressions(spark):
    """The log odds of the column expression are those of the trees by numpy, and secrets are told from words."""
    model = pii.fit(spark)
    assert set(model) == set(range(len(pii.KINDS)))
    rows = spark.createDataFrame([(r["t"],) for r in pii.made_examples(200, seed=77)], "t string")
    none = F.expr(f"cast(array() as {pii.SPAN})")
    found = rows.select(F.explode(pii.candidates(F.col("t"), none)).alias("c"))
    seen = found.select(F.col("c.kind"), F.array(*(f.cast("double") for f in pii.features(F.col("c")).values())).alias("x"), pii.scored(F.col("c"), model).alias("z")).collect()
    assert len(seen) > 100
    for r in seen:
        trees, threshold = model[r["kind"]]
        assert abs(r["z"] - (sum(pii.RATE * pii.predicted(t, np.array([r["x"]]))[0] for t in trees) - threshold)) < 1e-9
    texts = ["Enbe token = \"6d2ca8cc795e02fe1cd4d42fcf2aa51765e4f27c\" and more", "the key = northwesternmost place", "a token of friendship-and-understanding here"]
    got = [[s["m"] for s in r["added"]] for r in pii.find(spark.createDataFrame([(t,) for t in texts], "text string")).collect()]
    assert got == [["6d2ca8cc795e02fe1cd4d42fcf2aa51765e4f27c"], [], []]
