"""The stages of the corpus pipeline on a small fixture, each against a brute-force version on its own input."""

from collections import Counter

import numpy as np
from tokenizers import Tokenizer

import corpus_pipeline
from graindeck.llm import bpe, mixing, quality

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def text(*names):
    return " ".join(f"{n}{i}" for n in names for i in range(30))


NEAR = text("copy").replace("copy29", "other")
#: 3, its copies by other ids and without one, a repeated row; 9 is a copy of 3 and also another text.
ROWS = [(3, text("copy")), (3, text("copy")), (9, text("copy")), (9, text("alone")), (5, NEAR), (None, text("copy")), (None, text("none")), (None, text("none")), (7, text("seven")), (7, text("seven") + " more"), (8, ""), (None, None)]


def shingles(t):
    w = (t or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def kept_of_groups(rows):
    """(doc_id, text) of one row of each group, by brute force over rows."""
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            if a and b and 100 * len(a & b) >= 80 * len(a | b):
                low, high = sorted((root[i], root[j]))
                root = [low if x == high else x for x in root]
    groups = {}
    for (key, t), r in zip(rows, root):
        groups.setdefault(r, []).append((key is None, key or 0, t))
    # of one id's linked texts any may be first by hash
    return [{(m[2], None if m[0] else m[1]) for m in g if m[:2] == min(x[:2] for x in g)} for g in groups.values()]


def test_near_duplicates_leave_one_row_of_each_group(spark):
    docs = spark.createDataFrame([(k, t, "en", "s", 1) for k, t in ROWS], SCHEMA).repartition(3)
    got = [(r["text"], r["doc_id"]) for r in corpus_pipeline.one_of_each(spark, docs, "").collect()]
    want = kept_of_groups(ROWS)
    assert len(got) == len(want) and all(sum(g in w for g in got) == 1 for w in want)
    assert Counter(k for _, k in got) == {3: 1, 9: 1, 7: 1, 8: 1, None: 2}
    assert (text("alone"), 9) in got and (text("copy"), 3) in got


def test_each_stage_equals_brute_force(spark, tmp_path):
    rows = [(i, f"{text(f'n{i}x')}\nthe same line in all\n{'a b c ' * i}", "en", f"s{i % 2}", 1) for i in range(12)] + [(20, "the same line in all", "en", "s0", 1), (3, text("n3x"), "en", "s1", 1), (None, text("n4x"), "en", "s0", 1), (21, "", "en", "s0", 1), (22, None, "en", "s1", 1)]
    labels = [(i, int(i % 3 > 0), 0) for i in range(12)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    docs = spark.read.parquet(str(tmp_path / "documents.parquet"))
    columns = docs.columns
    judged = quality.classify(docs, spark.read.parquet(str(tmp_path / "labels.parquet"))).collect()
    for name, stage in corpus_pipeline.STAGES:
        given = [tuple(r[c] for c in columns) for r in docs.collect()]
        stage(spark, docs, str(tmp_path)).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        got = Counter(tuple(r[c] for c in columns if c in docs.columns) for r in docs.collect())
        if name == "quality_classifier":
            want = Counter(tuple(r[c] for c in columns) for r in judged if r["score"] >= 0.3)
        elif name == "line_dedup":
            want, seen = Counter(), []
            for key, t, *rest in sorted(given, key=lambda r: (r[0] is None, r[0] or 0, -len(r[1] or ""))):
                lines = []
                for line in (t or "").split("\n"):
                    w = set(line.split())
                    if not w or not any(100 * len(w & o) >= 80 * len(w | o) for o in seen):
                        lines.append(line)
                    seen += [w] if w else []
                cut = "\n".join(lines)
                if t is None or cut == t or cut.strip():
                    want[(key, None if t is None else cut, *rest[:2], rest[2] if t is None or cut == t else len(cut))] += 1
        elif name == "ngram_jaccard_join":
            groups = kept_of_groups([r[:2] for r in given])
            assert sum(got.values()) == len(groups) and all(sum((r[1], r[0]) in g for r in got.elements()) == 1 for g in groups)
            want = Counter({r: n for r, n in Counter(given).items() if r in got}) & got
        elif name == "source_mixing":
            want = Counter({r: got[r] for r in given if (r[1] or "").strip() and got[r]})
            for s in {r[3] for r in given}:
                size = {r: len((r[1] or "").split()) for r in given if r[3] == s}
                target = next(r["target"] for r in mixing.mix(spark.createDataFrame(given, SCHEMA)).collect() if r["source"] == s)
                assert abs(sum(n * size[r] for r, n in got.items() if r[3] == s) - target) <= max(size.values())
        else:
            theirs = Tokenizer.from_file(bpe.vocabulary())
            out = Counter((r["doc_id"], tuple(np.frombuffer(r["token_ids"], "<u4").tolist())) for r in docs.collect())
            assert out == Counter((r[0], tuple(theirs.encode(r[1] or "", add_special_tokens=False).ids)) for r in given)
            continue
        assert got and got == want, name
