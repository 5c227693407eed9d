"""N-gram Jaccard join by signature trees.

A document's set holds the 64-bit hashes of its distinct WIDTH-word shingles. Documents whose sets have equal 64-bit
fingerprints are one class (among n distinct sets, two that differ are taken for one at a chance of about n^2 / 2^65). Two
classes link at 100 * intersection >= SIMILAR * union. Classes that may link share a shingle of their prefixes (the least
common shingles of a set, as many as any partner must share one of; commonness is read from counts of all shingles in
2^SKETCH cells). Each such shingle has a leader, the smallest fingerprint that has it; the classes of a leader's shingles
are one bucket, and the leaves of signature trees, one for each magnitude of sizes.

A leaf holds a bitmap of its set of 4 to 8 bits for each shingle; a node holds the OR of its children's bitmaps and the range
of their sizes. The trees of a bucket are traversed two at a time, and a pair of nodes is left as soon as the sizes, or the
largest overlap that the bitmaps allow, rule out every pair of leaves below. All links come from such traversals, of two
kinds: the first, over bitmaps only, joins leaves that may link into candidate groups, so that whole sets are gathered just
for classes that have a possible partner, once for each; the second, within those groups, verifies each pair of leaves on
whole sets. Only components are asked for, so both leave pairs of nodes whose leaves are one component already: a group of
near copies costs a few pairs for each member, and no link between components is lost.

Groups of over BLOCK leaves are cut by a hash. First each block is traversed alone, with the group's leader in every block,
which joins what is like the leader; only if more than one component remains do the blocks meet two by two.

Nulls: a null text has no words and links with nothing, as an empty one; rows without an id have no component. Rows of one
id and text are one document. An empty table gives an empty result. Other columns aren't read.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from .common import dropped, table, written
from .components import components

WIDTH, SIMILAR = 5, 80
SKETCH, SLICES = 20, 16
BLOCK, LEAVES = 4096, 8
#: Bits of the filter of wanted ids: of a fixed size, so at most a share of what it lets through is in vain.
WANTED = 23

BASE = 0x9E3779B97F4A7C15
MASK = (1 << 64) - 1
_powers = np.ones(1, np.uint64), np.ones(1, np.uint64)
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of BASE and of its inverse modulo 2^64."""
    global _powers
    if len(_powers[0]) < n:
        size = max(1 << 16, 2 * n)
        made = []
        for b in (BASE, pow(BASE, -1, 1 << 64)):
            p = np.full(size, b, np.uint64)
            p[0] = 1
            made.append(np.multiply.accumulate(p))
        _powers = tuple(made)
    return _powers[0][:n], _powers[1][:n]


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit integers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str | None, width: int = WIDTH) -> np.ndarray:
    """The sorted set of a text's shingle hashes (unsigned)."""
    b = np.frombuffer((text or "").encode("utf-8", "replace").lower(), np.uint8)
    if not len(b):
        return np.zeros(0, np.uint64)
    blank = np.concatenate(([True], _SPACE[b], [True]))
    starts = np.flatnonzero(blank[:-1] & ~blank[1:])
    ends = np.flatnonzero(~blank[:-1] & blank[1:])
    n = len(starts)
    if not n:
        return np.zeros(0, np.uint64)
    up, down = powers(len(b))
    sums = np.concatenate((np.zeros(1, np.uint64), np.cumsum((b.astype(np.uint64) + np.uint64(1)) * up, dtype=np.uint64)))
    words = mixed((sums[ends] - sums[starts]) * down[starts] + (ends - starts).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    size = min(n, width)
    out = np.full(n - size + 1, size, np.uint64)
    for i in range(size):
        out = mixed(out * np.uint64(0xA0761D6478BD642F) + words[i : n - size + 1 + i])
    return np.unique(out)


def fingerprint(grams: np.ndarray) -> int:
    """A signed 64-bit hash of a set."""
    with np.errstate(over="ignore"):
        x = mixed(np.array([np.bitwise_xor.reduce(mixed(grams + np.uint64(1))) + np.add.reduce(mixed(grams * np.uint64(3))) * np.uint64(31) + np.uint64(len(grams))], np.uint64))
    return int(x.view(np.int64)[0])


def prefix_length(n: int, similar: int = SIMILAR) -> int:
    """How many of n shingles to index so that any partner shares one of them."""
    return n - -(-n * similar // 100) + 1


def surveyed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """(id, n, fp) of each document, and the partition's counts of shingles by cell, in SLICES rows."""
    count = np.zeros(1 << SKETCH, np.int64)
    some = False
    for b in batches:
        sets = [shingles(t) for t in b["text"]]
        for s in sets:
            np.add.at(count, (s >> np.uint64(64 - SKETCH)).astype(np.int64), 1)
        some = some or len(b) > 0
        yield pd.DataFrame({"id": b["id"].astype("Int64"), "n": [len(s) for s in sets], "fp": [fingerprint(s) for s in sets], "cells": None})
    if some:
        yield pd.DataFrame({"id": pd.array([None] * SLICES, "Int64"), "n": range(SLICES), "fp": 0, "cells": [x.astype("<u4").tobytes() for x in count.reshape(SLICES, -1)]})


def added(part: pd.DataFrame) -> pd.DataFrame:
    total = np.zeros((1 << SKETCH) // SLICES, np.int64)
    for x in part["cells"]:
        total += np.frombuffer(x, "<u4")
    return pd.DataFrame({"n": part["n"].iloc[:1], "cells": [np.minimum(total, (1 << 32) - 1).astype("<u4").tobytes()]})


def commonness(cells: DataFrame) -> np.ndarray:
    """For each cell, how many times its count doubles the mean; 2^SKETCH bytes whatever the input."""
    small = cells.withColumn("_part", F.spark_partition_id() % 8).groupBy("n", "_part").applyInPandas(added, "n int, cells binary")
    rows = small.groupBy("n").applyInPandas(added, "n int, cells binary").collect()
    count = np.zeros((SLICES, (1 << SKETCH) // SLICES), np.int64)
    for r in rows:
        count[r["n"]] = np.frombuffer(r["cells"], "<u4")
    count = count.ravel()
    return np.maximum(0, np.floor(np.log2(np.maximum(count, 1) / max(1.0, count.mean())))).astype(np.uint8)


def width_of(n: int) -> int:
    """The power of two of the bits of a set of n shingles: 4 to 8 for each."""
    return max(6, (4 * n - 1).bit_length())


def bitmap(grams: np.ndarray, width: int) -> int:
    """The set's bits in a bitmap of 2^width: a shingle's is at its last bits."""
    out = np.zeros(1 << width, bool)
    out[grams & ((1 << width) - 1)] = True
    return int.from_bytes(np.packbits(out, bitorder="little").tobytes(), "little")


def folded(bits: int, width: int) -> int:
    """The same set's bitmap of half the width."""
    half = 1 << (width - 1)
    return (bits >> half) | (bits & ((1 << half) - 1))


class Node:
    """A leaf (kids is None) with its class, component and bitmap, or an inner node. spare: how many shingles of a leaf at most
    share a bit with another of it."""

    __slots__ = ("bits", "spare", "least", "most", "width", "kids", "leaf", "part", "grams", "half", "half_spare")

    def __init__(self, kids: list[Node] | None, leaf=None, part=None, n: int = 0, width: int = 0, bits: int = 0, grams=None):
        self.kids, self.leaf, self.part, self.grams, self.half = kids, leaf, part, grams, None
        if kids is None:
            self.bits, self.width, self.spare, self.least, self.most = bits, width, n - bits.bit_count(), n, n
        else:
            self.bits, self.width = 0, kids[0].width
            for k in kids:
                self.bits |= k.bits
            self.spare, self.least, self.most = max(k.spare for k in kids), min(k.least for k in kids), max(k.most for k in kids)

    def narrow(self) -> tuple[int, int]:
        """bits and spare at half the width."""
        if self.half is None:
            if self.kids is None:
                self.half = folded(self.bits, self.width)
                self.half_spare = self.least - self.half.bit_count()
            else:
                below = [k.narrow() for k in self.kids]
                self.half, self.half_spare = folded(self.bits, self.width), max(x for _, x in below)
        return self.half, self.half_spare


def tree(leaves: list[Node], fan: int = LEAVES) -> Node:
    while len(leaves) > 1:
        leaves = [Node(leaves[i : i + fan]) for i in range(0, len(leaves), fan)]
    return leaves[0]


def trees(leaves: list[Node]) -> list[Node]:
    """One tree for each width, of leaves ordered so that likely partners are near: by component, lowest bit and size."""
    by: dict[int, list[Node]] = {}
    for x in sorted(leaves, key=lambda x: (x.part, x.bits & -x.bits, x.least, x.leaf)):
        by.setdefault(x.width, []).append(x)
    return [tree(v) for _, v in sorted(by.items())]


def may_link(a: Node, b: Node, similar: int = SIMILAR) -> bool:
    """Whether sizes and bitmaps allow a leaf of a to link with one of b."""
    if 100 * a.most < similar * b.least or 100 * b.most < similar * a.least:
        return False
    if a.width == b.width:
        x, y, spare = a.bits, b.bits, min(a.spare, b.spare)
    elif a.width < b.width:
        y, other = b.narrow()
        x, spare = a.bits, min(a.spare, other)
    else:
        x, other = a.narrow()
        y, spare = b.bits, min(b.spare, other)
    return (x & y).bit_count() + spare >= -(-similar * (a.least + b.least) // (100 + similar))


def overlap_links(x: np.ndarray, y: np.ndarray, similar: int = SIMILAR) -> bool:
    common = len(np.intersect1d(x, y, assume_unique=True))
    return 100 * common >= similar * (len(x) + len(y) - common)


def traverse(sides: list[list[Node]], similar: int = SIMILAR) -> Iterator[tuple]:
    """Pairs of classes, from a dual traversal of one side's trees or of two sides', that join different components: leaves that
    bitmaps allow to link, verified on their sets if they have them."""
    root: dict = {}

    def find(x):
        while (y := root.get(x, x)) != x:
            root[x] = root.get(y, y)
            x = root[x]
        return x

    def component(x: Node):
        """The one component of all leaves below, if it is one; what is known to be one stays one."""
        if x.part is None:
            one = component(x.kids[0])
            if one is None or any(component(k) != one for k in x.kids[1:]):
                return None
            x.part = one
        return find(x.part)

    a, b = sides[0], sides[-1]
    todo = [(x, y) for i, x in enumerate(a) for y in (a[i:] if a is b else b) if abs(x.width - y.width) <= 1]
    while todo:
        x, y = todo.pop()
        one = component(x)
        if one is not None and one == component(y):
            continue
        if x is y:
            kids = x.kids
            todo += [(p, q) for i, p in enumerate(kids) for q in kids[i + 1 :]]
            todo += [(p, p) for p in kids if p.kids is not None]
        elif not may_link(x, y, similar):
            continue
        elif x.kids is None and y.kids is None:
            if x.grams is None or overlap_links(x.grams, y.grams, similar):
                i, j = find(x.part), find(y.part)
                root[max(i, j)] = min(i, j)
                yield x.leaf, y.leaf
        elif y.kids is None or x.kids is not None and x.most - x.least >= y.most - y.least:
            todo += [(p, y) for p in x.kids]
        else:
            todo += [(x, p) for p in y.kids]


def traversed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Links from rows (unit, i, j, side, fp, part, n and data: a bitmap, or a set in grams) sorted by unit, i and j."""
    key, rows = None, []

    def links(rows):
        sides: dict[int, list[Node]] = {}
        for side, fp, part, n, data in rows:
            width, grams = width_of(n), None
            if isinstance(data, bytes):
                bits = int.from_bytes(data, "little")
            else:
                grams = np.asarray(data)
                bits = bitmap(grams, width)
            sides.setdefault(side, []).append(Node(None, fp, part, n, width, bits, grams))
        made = [trees(v) for _, v in sorted(sides.items())]
        return pd.DataFrame(list(traverse(made)) if len(rows) > 1 else [], columns=["a", "b"], dtype="int64")

    for b in batches:
        for k, *r in zip(zip(b["unit"], b["i"], b["j"]), b["side"], b["fp"], b["part"], b["n"], b["data"]):
            if k != key:
                if len(rows) > 1:
                    yield links(rows)
                key, rows = k, []
            rows.append(r)
    if len(rows) > 1:
        yield links(rows)


def with_parts(rows: DataFrame, parts: DataFrame | None) -> DataFrame:
    """rows with part: the component of their class fp, or the class itself."""
    if parts is None:
        return rows.withColumn("part", F.col("fp"))
    return rows.join(parts.select(F.col("node").alias("fp"), "component"), "fp", "left").withColumn("part", F.coalesce("component", "fp")).drop("component")


def linked(members: DataFrame, leaves: DataFrame, block: int = BLOCK) -> DataFrame:
    """Links (a, b) within units. members: unit, lead (one of its classes) and fp; leaves: fp, n and data.

    No unit, however large, is one task's: its blocks are traversed alone, then, if more than one component is left, by twos."""
    sizes = members.groupBy("unit").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sized = members.join(sizes, "unit").withColumn("cuts", F.ceil(F.col("size") / block).cast("int"))
    sized = written(sized.withColumn("cut", F.pmod(F.xxhash64(F.lit(5), "fp"), F.col("cuts")).cast("int")).select("unit", "lead", "fp", "cut", "cuts"), "units")

    def units(rows: DataFrame) -> DataFrame:
        held = rows.join(leaves, "fp").repartition("unit", "i", "j").sortWithinPartitions("unit", "i", "j")
        return written(held.select("unit", "i", "j", "side", "fp", "part", "n", "data").mapInPandas(traversed, "a long, b long"), "links")

    # a leader is in every block of its unit
    every = F.when((F.col("fp") == F.col("lead")) & (F.col("cuts") > 1), F.sequence(F.lit(0), F.col("cuts") - 1)).otherwise(F.array("cut"))
    alone = sized.withColumn("i", F.explode(every)).select("unit", "i", F.col("i").alias("j"), F.lit(0).alias("side"), "fp", F.col("fp").alias("part"))
    out = units(alone)
    large = sized.where("cuts > 1")
    if not large.isEmpty():
        parts = components(out)
        rows = written(with_parts(large, parts), "large")
        split = rows.groupBy("unit").agg(F.min("part").alias("_least"), F.max("part").alias("_most")).where("_least < _most").select("unit")
        rows = rows.join(split, "unit", "left_semi").withColumn("other", F.explode(F.sequence(F.lit(0), F.col("cuts") - 1))).where("cut <> other")
        pairs = rows.select("unit", F.least("cut", "other").alias("i"), F.greatest("cut", "other").alias("j"), (F.col("cut") > F.col("other")).cast("int").alias("side"), "fp", "part")
        out = union([out, units(pairs)])
        dropped(rows)
    dropped(sized)
    return out


def link(df: DataFrame, text: str = "text", key: str = "doc_id", similar: int = SIMILAR, block: int = BLOCK) -> DataFrame:
    """A row for each document: key, n_shingles, component_id (null without a key) and class_id."""
    spark = df.sparkSession
    source = df.select(F.col(key).cast("long").alias("id"), F.col(text).alias("text"))
    survey = written(source.mapInPandas(surveyed, "id long, n int, fp long, cells binary"), "shingles")
    level = spark.sparkContext.broadcast(commonness(survey.where("cells is not null").select("n", "cells")))
    docs = survey.where("cells is null").select("id", "n", "fp")

    def prefixes(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: set[int] = set()
        for b in batches:
            out = []
            for t in b["text"]:
                g = shingles(t)
                if len(g) and (fp := fingerprint(g)) not in seen:
                    if len(seen) < 1 << 20:
                        seen.add(fp)
                    width = width_of(len(g))
                    order = np.lexsort((g, level.value[(g >> np.uint64(64 - SKETCH)).astype(np.int64)]))[: prefix_length(len(g), similar)]
                    out.append((fp, len(g), bitmap(g, width).to_bytes(1 << width - 3, "little"), g[order].view(np.int64)))
            yield pd.DataFrame(out, columns=["fp", "n", "data", "tokens"])

    known = written(source.where("id is not null").mapInPandas(prefixes, "fp long, n int, data binary, tokens array<long>"), "prefixes")
    tokens = known.select(F.explode("tokens").alias("token"), "fp")
    leads = tokens.groupBy("token").agg(F.min("fp").alias("lead"), F.max("fp").alias("most")).where("lead < most").select("token", "lead")
    members = written(tokens.join(leads, "token").select(F.col("lead").alias("unit"), "lead", "fp").distinct(), "members")
    some = members.select("fp").distinct()
    signatures = written(known.select("fp", "n", "data").join(some, "fp", "left_semi").dropDuplicates(["fp"]), "signatures")
    dropped(known)
    # what the bitmaps allow to link: groups that whole sets are gathered for
    near = linked(members, signatures, block)
    groups = written(components(near), "groups")
    dropped(near, signatures)
    # the class that leads most of a group is in each of its blocks
    of_lead = members.join(groups.withColumnsRenamed({"node": "fp", "component": "unit2"}), "fp").groupBy("unit2", "lead").agg(F.count(F.lit(1)).alias("c"))
    lead = of_lead.groupBy("unit2").agg(F.max_by("lead", "c").alias("lead")).withColumnRenamed("unit2", "unit")
    grouped = groups.select(F.col("component").alias("unit"), F.col("node").alias("fp")).join(lead, "unit")
    classes = written(docs.where("id is not null and n > 0").groupBy("fp").agg(F.min("id").alias("rep")), "classes")
    wanted = classes.join(groups.select(F.col("node").alias("fp")), "fp")
    filled = spark.sparkContext.broadcast(id_filter(wanted.select(F.col("rep").alias("id"))))

    def sets_of(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            out, some = [], filtered(filled.value, b["id"].to_numpy(np.int64))
            for i, t in zip(b["id"][some], b["text"][some]):
                g = shingles(t)
                if len(g):
                    out.append((fingerprint(g), i, len(g), np.sort(g.view(np.int64))))
            yield pd.DataFrame(out, columns=["fp", "id", "n", "data"])

    sets = source.where("id is not null").mapInPandas(sets_of, "fp long, id long, n int, data array<long>")
    sets = written(sets.join(wanted.withColumnRenamed("rep", "id"), ["fp", "id"], "left_semi").dropDuplicates(["fp"]), "sets")
    links = linked(grouped, sets, block)
    parts = written(components(links), "parts")
    dropped(links, sets, members, groups)
    # a class's component is named by its smallest document
    named = with_parts(classes, parts)
    names = named.groupBy("part").agg(F.min("rep").alias("component_id"))
    of_class = written(named.join(names, "part").select("fp", "component_id"), "named")
    dropped(parts, classes)
    joined = docs.join(of_class, "fp", "left")
    alone = F.col("component_id").isNull() | (F.col("n") == 0)
    return joined.select(F.col("id").alias(key), F.col("n").cast("long").alias("n_shingles"), F.when(alone, F.col("id")).when(F.col("id").isNotNull(), F.col("component_id")).alias("component_id"), F.col("fp").alias("class_id"))


def id_place(ids: np.ndarray) -> np.ndarray:
    return (mixed(ids.astype(np.int64).view(np.uint64) + np.uint64(BASE)) >> np.uint64(64 - WANTED)).astype(np.int64)


def id_filter(ids: DataFrame) -> np.ndarray:
    """A bitmap of 2^WANTED places by the ids' hashes, united in a tree of tasks."""

    def placed(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        bits = np.zeros(1 << WANTED, bool)
        for b in batches:
            bits[id_place(b["id"].to_numpy())] = True
        for i, x in enumerate(np.packbits(bits).reshape(SLICES, -1)):
            yield pd.DataFrame({"slice": [i], "bits": [x.tobytes()]})

    def united(part: pd.DataFrame) -> pd.DataFrame:
        out = np.zeros((1 << WANTED) // SLICES // 8, np.uint8)
        for x in part["bits"]:
            out |= np.frombuffer(x, np.uint8)
        return pd.DataFrame({"slice": part["slice"].iloc[:1], "bits": [out.tobytes()]})

    rows = ids.mapInPandas(placed, "slice int, bits binary").groupBy("slice").applyInPandas(united, "slice int, bits binary").collect()
    out = np.zeros((SLICES, (1 << WANTED) // SLICES // 8), np.uint8)
    for r in rows:
        out[r["slice"]] = np.frombuffer(r["bits"], np.uint8)
    return out.ravel()


def filtered(bits: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """Which ids the bitmap may hold."""
    at = id_place(ids)
    return (bits[at >> 3] >> (7 - (at & 7)).astype(np.uint8)) & 1 == 1


def union(frames: list[DataFrame]) -> DataFrame:
    out = frames[0]
    for f in frames[1:]:
        out = out.unionByName(f)
    return out


def op5(spark, sf_dir: str) -> DataFrame:
    return link(table(spark, sf_dir, "documents"))
