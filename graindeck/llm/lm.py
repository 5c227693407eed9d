"""LM scoring by deleted interpolation over word n-grams.

Tokens are lower-cased words (A-Z only) and one end for each document. The model mixes maximum-likelihood estimates of
three orders and a uniform one:

    P(w | u, v) = a3 C(u,v,w)/C(u,v) + a2 C(v,w)/C(v) + a1 c(w)/N + a0 / (V+1)

where u and v are the two tokens before w, with two starts before a document's first token, and all counts are of whole
training text: no n-gram is left out. a0..a3 depend on the bucket of log2 C(u,v), or of log2 C(v) where u, v was never seen.
They are learned by expectation-maximisation on held-out counts: each training token is taken as held out once, with its
occurrence deleted from every count it is in. All V+1 tokens, an unseen one included, have probabilities that add up to 1.

Texts are read once: a chunk of documents becomes token numbers and, for each order, its distinct n-grams with their counts
in training text. An n-gram goes by a number of 64 bits (words) or 48 bits (pairs and triples: among n distinct ones, one
shares its number with another at a chance of n / 2^48). Numbers meet by range, packed as differences, once for each chunk
and not for each occurrence, and the counts of the whole corpus go back to the chunks. C(u,v) and C(v) are the counts at the
token before. Only cells of estimates, rounded to a quarter of a bit, reach the driver.

Nulls: a null text counts as the empty one, of one token (the end). Repeated rows count each time. With no training
document every base count is 0 (base_score is that of the formula with N = V = 0) and score is 0. Other columns aren't read.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import dropped, fold_of, input_bytes, table, written

#: Bits of the numbers of words, pairs and triples.
BITS = {1: 64, 2: 48, 3: 48}
#: Tokens of a chunk, about.
CHUNK = 1 << 20
#: Ranges of numbers: at least, at most, and input bytes for each.
RANGES, MOST_RANGES, RANGE_BYTES = 256, 1 << 14, 32 << 20
START = np.uint64(0x9E3779B97F4A7C15)  # before a document's first token
END = b"\n"  # no word holds white space
BUCKETS, ROUNDS = 24, 25
#: Tokens whose estimates are in memory at once.
SLICE = 1 << 16
STEPS = 256  # of estimates, in quarters of a bit; 0 is the estimate 0
KINDS = "chunk long, kind int, part long, a binary, b binary, c binary"


def tokens(text: str | None) -> list[bytes]:
    return (text or "").encode("utf-8", "replace").lower().split()


def packed(x: np.ndarray, raw: int = 0) -> bytes:
    """Non-negative numbers as planes of bytes; the lowest raw ones stay as they are, the others are compressed."""
    size = np.min_scalar_type(x.max() if len(x) else 0).itemsize
    planes = np.ascontiguousarray(x.astype(f"<u{size}").view(np.uint8).reshape(-1, size).T)
    raw = min(raw, size)
    return bytes([size, raw]) + len(x).to_bytes(8, "little") + planes[:raw].tobytes() + pa.compress(planes[raw:].tobytes(), codec="zstd", asbytes=True)


def unpacked(x: bytes) -> np.ndarray:
    size, raw, n = x[0], x[1], int.from_bytes(x[2:10], "little")
    at = 10 + raw * n
    rest = pa.decompress(x[at:], decompressed_size=(size - raw) * n, codec="zstd", asbytes=True) if size > raw and n else b""
    planes = np.frombuffer(x[10:at] + rest, np.uint8).reshape(size, n)
    return np.ascontiguousarray(planes.T).view(f"<u{size}").ravel().astype(np.uint64)


def packed_keys(x: np.ndarray) -> bytes:
    """Ascending numbers by their differences, whose lowest bytes are as good as random."""
    return packed(np.diff(x, prepend=np.uint64(0)), 3)


def unpacked_keys(x: bytes) -> np.ndarray:
    return np.cumsum(unpacked(x), dtype=np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    """x itself, mixed in place."""
    for shift, by in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB), (31, 1)):
        x ^= x >> np.uint64(shift)
        x *= np.uint64(by)
    return x


def grams(words: np.ndarray, first: np.ndarray, k: int) -> np.ndarray:
    """The number of the pair (k = 2) or triple (k = 3) that ends at each token. first: where documents begin."""
    v = np.concatenate(([START], words[:-1]))
    v[first] = START
    if k == 3:
        u = np.concatenate(([START], v[:-1]))
        u[first] = START
        u *= np.uint64(0xA0761D6478BD642F)
        u += v
        v = mixed(u)
    v *= np.uint64(0xE7037ED1A0B428DB)
    v += words
    return mixed(v) >> np.uint64(64 - BITS[k])


def starts(size: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(size)[:-1])).astype(np.int64)


def chunked(batches: Iterator[pd.DataFrame], ranges: int) -> Iterator[pd.DataFrame]:
    """For each chunk a row of kind 0: its tokens (b) by place of their numbers, and documents (c); and rows of kinds 1 to 3, by range:
    the numbers of its words, pairs and triples (a) and how often they are in training text (b)."""
    import xxhash
    from pyspark import TaskContext

    chunk = TaskContext.get().partitionId() << 24
    number: dict[bytes, int] = {}
    docs: list[tuple] = []
    at = 0

    def flushed() -> pd.DataFrame:
        hashes = np.array([xxhash.xxh3_64_intdigest(w) for w in number], np.uint64)
        order = np.argsort(hashes)
        place = np.empty(len(order), np.int64)
        place[order] = np.arange(len(order))
        ids, keys = place[np.concatenate([d[3] for d in docs])], hashes[order]
        size = np.array([len(d[3]) for d in docs], np.int64)
        train = np.repeat(np.array([not d[2] for d in docs]), size)
        doc = np.array([(d[0], d[1], d[2], n) for d, n in zip(docs, size)], DOC)
        rows = [(chunk, 0, chunk, None, packed(ids), zlib.compress(doc.tobytes(), 1))]
        for k in BITS:
            x, where = (keys, ids) if k == 1 else np.unique(grams(keys[ids], starts(size), k), return_inverse=True)
            count = np.bincount(where, train, len(x))
            part = (x >> np.uint64(BITS[k] - ranges.bit_length() + 1)).astype(np.int64)
            cuts = np.concatenate(([0], np.flatnonzero(np.diff(part)) + 1, [len(x)]))
            rows += [(chunk, k, int(part[i]), packed_keys(x[i:j]), packed(count[i:j].astype(np.uint64)), None) for i, j in zip(cuts[:-1], cuts[1:])]
        return pd.DataFrame(rows, columns=["chunk", "kind", "part", "a", "b", "c"])

    for b in batches:
        for key, held, text in zip(b["id"], b["held"], b["text"]):
            ids = np.array([number.setdefault(w, len(number)) for w in (*tokens(text), END)], np.uint32)
            docs.append((0 if pd.isna(key) else int(key), pd.isna(key), bool(held), ids))
            at += len(ids)
            if at >= CHUNK:
                yield flushed()
                chunk, number, docs, at = chunk + 1, {}, [], 0
    if docs:
        yield flushed()


#: A document: its key, whether that is null, whether it is held out, and its tokens.
DOC = np.dtype([("id", "<i8"), ("null", "?"), ("held", "?"), ("size", "<i8")])


def documents(x: bytes) -> np.ndarray:
    return np.frombuffer(zlib.decompress(x), DOC)


def counted(d: pd.DataFrame) -> pd.DataFrame:
    """Each chunk's rows of one kind and range with the counts of all chunks in b; words keep a. n, v: words and distinct ones of
    training text; of kind 0, whose rows pass, n is its documents."""
    kind = int(d["kind"].iloc[0])
    if not kind:
        return d.assign(n=[int((~documents(x)["held"]).sum()) for x in d["c"]], v=0)
    keys, counts = [unpacked_keys(x) for x in d["a"]], np.concatenate([unpacked(x) for x in d["b"]])
    cuts = np.cumsum([len(x) for x in keys])[:-1]
    distinct, where = np.unique(np.concatenate(keys), return_inverse=True)
    del keys
    total = np.bincount(where, counts, len(distinct)).astype(np.uint64)
    out = d.assign(a=d["a"] if kind == 1 else None, b=[packed(x) for x in np.split(total[where], cuts)], n=0, v=0)
    if kind == 1:
        out.loc[out.index[0], ["n", "v"]] = int(total.sum()), int((total > 0).sum())
    return out


def contexts(c1: np.ndarray, c2: np.ndarray, first: np.ndarray, docs: int) -> tuple[np.ndarray, np.ndarray]:
    """C(v) and C(u,v) of each token: the counts at the token before, or the number of training documents."""
    of1, of2 = (np.concatenate(([0], c[:-1])) for c in (c1, c2))
    of1[first] = of2[first] = docs
    return of1, of2


def level(c: np.ndarray) -> np.ndarray:
    return np.where(c > 0, np.minimum(1 + np.log2(np.maximum(c, 1)).astype(int), BUCKETS - 1), 0)


def buckets(of1: np.ndarray, of2: np.ndarray) -> np.ndarray:
    return np.where(of2 > 0, level(of2), BUCKETS + level(of1))


def estimates(c1, c2, c3, of1, of2, n: int) -> tuple[np.ndarray, ...]:
    return c1 / max(1, n), c2 / np.maximum(of1, 1), c3 / np.maximum(of2, 1)


def interpolate(cells: np.ndarray, held: np.ndarray, v: int, rounds: int = ROUNDS) -> np.ndarray:
    """Weights (buckets x 4 orders) by expectation-maximisation on cells of estimates with one occurrence deleted."""
    value = lambda s: np.where(s > 0, 2.0 ** ((s - STEPS + 1) / 4), 0.0)
    parts = np.stack([np.full(len(cells), 1.0 / (v + 1)), *(value(cells // STEPS**i % STEPS) for i in range(3))], axis=1)
    bucket = cells // STEPS**3
    weight = np.full((2 * BUCKETS, 4), 0.25)
    for _ in range(rounds):
        each = weight[bucket] * parts
        each *= (held / each.sum(1))[:, None]
        total = np.stack([np.bincount(bucket, each[:, i], 2 * BUCKETS) for i in range(4)], axis=1)
        seen = total.sum(1) > 0
        weight[seen] = total[seen] / total[seen].sum(1, keepdims=True)
    weight = np.maximum(weight, 1e-6)
    return weight / weight.sum(1, keepdims=True)


def looked_up(d: pd.DataFrame, n: int, docs_in_training: int) -> pd.DataFrame:
    """A chunk's documents (c) with the counts of their tokens, pairs and triples (a), and its cells of estimates (cell, number)."""
    head = d[d["kind"] == 0].iloc[0]
    doc = documents(head["c"])
    parts = {k: d[d["kind"] == k].sort_values("part") for k in BITS}
    keys, ids = np.concatenate([unpacked_keys(x) for x in parts[1]["a"]]), unpacked(head["b"]).astype(np.int64)
    answer = {k: np.concatenate([unpacked(x) for x in g["b"]]).astype(np.int64) for k, g in parts.items()}
    first = starts(doc["size"])
    c = {1: answer[1][ids]}
    for k in (2, 3):
        c[k] = answer[k][np.unique(grams(keys[ids], first, k), return_inverse=True)[1]]
    of1, of2 = contexts(c[1], c[2], first, docs_in_training)
    train = np.repeat(~doc["held"], doc["size"])
    cells = []
    for i in range(0, len(ids), SLICE):
        c1, c2, c3, o1, o2 = (x[i : i + SLICE][train[i : i + SLICE]] - 1 for x in (c[1], c[2], c[3], of1, of2))
        steps = [np.where(f > 0, np.maximum(STEPS - 1 + np.round(4 * np.log2(np.maximum(f, 1e-30))), 1), 0).astype(np.int64) for f in estimates(c1, c2, c3, o1, o2, n - 1)]
        cells.append(((buckets(o1, o2) * STEPS + steps[2]) * STEPS + steps[1]) * STEPS + steps[0])
    cell, number = np.unique(np.concatenate(cells), return_counts=True)
    return pd.DataFrame({"docs": [head["c"]], "c1": [packed(c[1])], "c2": [packed(c[2])], "c3": [packed(c[3])], "cell": [cell], "number": [number]})


def score_documents(df: DataFrame, text: str = "text", key: str = "doc_id", held: int = 1) -> DataFrame:
    """A row for each document: its key, held_out, n_tokens, n_known, train_tokens, base_score and score."""
    spark = df.sparkSession
    rows = df.select(F.col(key).cast("long").alias("id"), (fold_of(F.col(key)) == held).alias("held"), F.col(text).alias("text"))
    ranges = RANGES
    while ranges < MOST_RANGES and ranges * RANGE_BYTES < input_bytes(df):
        ranges *= 2
    # documents go with the numbers through one shuffle, so that texts are read once and numbers aren't written besides
    asked = rows.mapInPandas(lambda batches: chunked(batches, ranges), KINDS)
    answered = written(asked.groupBy("kind", "part").applyInPandas(counted, KINDS + ", n long, v long"), "counts")
    totals = {r["kind"]: (r["n"], r["v"]) for r in answered.groupBy("kind").agg(F.sum("n").alias("n"), F.sum("v").alias("v")).collect()}
    training, (n, v) = totals.get(0, (0, 0))[0], totals.get(1, (0, 0))
    found = answered.select("chunk", "kind", "part", "a", "b", "c").groupBy("chunk").applyInPandas(lambda d: looked_up(d, n, training), "docs binary, c1 binary, c2 binary, c3 binary, cell array<long>, number array<long>")
    found = written(found, "looked-up")
    dropped(answered)
    cells = found.select(F.explode(F.arrays_zip("cell", "number")).alias("x")).groupBy("x.cell").agg(F.sum("x.number").alias("number")).toPandas()
    weight = interpolate(cells["cell"].to_numpy(np.int64), cells["number"].to_numpy(float), v)

    def scored(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for d in (b.iloc[[i]] for b in batches for i in range(len(b))):
            doc = documents(d["docs"].iloc[0])
            first = starts(doc["size"])
            c1, c2, c3 = (unpacked(d[c].iloc[0]).astype(np.int64) for c in ("c1", "c2", "c3"))
            of1, of2 = contexts(c1, c2, first, training)
            base, score = np.zeros(len(c1)), np.zeros(len(c1))
            for at in (slice(i, i + SLICE) for i in range(0, len(c1), SLICE)):
                mix = weight[buckets(of1[at], of2[at])]
                e1, e2, e3 = estimates(c1[at], c2[at], c3[at], of1[at], of2[at], n)
                # an order whose context was never seen leaves its weight to the uniform one
                spare = mix[:, 0] + np.where(of1[at] > 0, 0, mix[:, 2]) + np.where(of2[at] > 0, 0, mix[:, 3])
                base[at] = np.log10((c1[at] + 0.5) / (n + 0.5 * (v + 1)))
                if n:
                    score[at] = np.log10(spare / (v + 1) + mix[:, 1] * e1 + mix[:, 2] * e2 + mix[:, 3] * e3)
            ids = pd.array(doc["id"], "Int64")
            ids[doc["null"]] = pd.NA
            yield pd.DataFrame({key: ids, "held_out": doc["held"], "n_tokens": doc["size"], "n_known": np.add.reduceat((c1 > 0).astype(np.int64), first), "train_tokens": n, "base_score": np.add.reduceat(base, first), "score": np.add.reduceat(score, first)})

    return found.select("docs", "c1", "c2", "c3").mapInPandas(scored, f"{key} long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")


def op8(spark, sf_dir: str) -> DataFrame:
    return score_documents(table(spark, sf_dir, "documents"))
