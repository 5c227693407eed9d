"""Line dedup: an exact set-similarity join of lines, with DataFrame functions only.

A line's set holds its distinct words (as they are). A line goes if an earlier one, by (id, line number), is equal to it or
has a Jaccard similarity of at least SIMILAR / 100. Words are ordered by rarity, read from counts of all words in 2^CELLS
cells; a word's key is its cell's rank and 49 bits of its hash, so sorting keys sorts by rarity. Lines whose sorted keys have
equal 64-bit hashes and numbers are one class, named in order of first appearance: among n distinct sets, two that differ
are taken for one at a chance of about n^2 / 2^65. Two classes can only be similar if they share a key of their prefixes; pairs that
do are kept if their lengths, the positions of that key and their parity bits (which no more positions can differ in than the
sets differ in words: 128 bits, and 256 between sets of WIDE keys or more, as 128 say little of those) allow the similarity, and
are verified on the lines themselves. p is the parities of all keys, q of a half of them from MIDDLE keys on. One similar earlier line
decides a line, so each class first meets the earliest class of each key in the shorter prefixes that suffice where sets are of one
length, and only classes that none of those decides meet all earlier classes of the keys of whole prefixes: a group of near copies
costs a few pairs for each member, and no decision changes.

Nulls: a null text has no lines and stays null; a null id comes after all others; lines without a word stay. Repeated rows
of one id and text are one document: their lines stay or go alike. An empty table gives an empty result. Other columns pass
through, whatever their names; only lines_removed is replaced.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, let, table, unused, written

SIMILAR = 80
CELLS = 18
#: The join of all is done in so many steps, each for a share of the keys, so that less disk is used at once.
SHARES = 2
ORDER = ("missing", "id", "doc", "line")
BITS = ("p", "q", "r", "s")
HASH_BITS = 49
MIDDLE, WIDE = 80, 160


def word_hashes(s: Column) -> Column:
    """The distinct hashes of the words of a line that has no white space but spaces."""
    return F.array_distinct(F.array_remove(F.transform(F.split(s, " "), lambda w: F.xxhash64(w)), F.xxhash64(F.lit(""))))


def ranks(lines: DataFrame) -> DataFrame:
    """One row: an array with the rank by rarity of each of 2^CELLS cells of the hashes in w, where a key has it; of a fixed size."""
    counts = lines.select(F.explode("w").alias("x")).groupBy(F.col("x").bitwiseAND((1 << CELLS) - 1).cast("int").alias("cell")).agg(F.count(F.lit(1)).alias("n"))
    # counts, in order of magnitude above 4096, so that few bits hold them
    level = F.when(F.col("n") <= 4096, F.col("n")).otherwise(F.floor(4096 + 256 * F.log2(F.col("n") / 4096)))
    pairs = counts.select("cell", F.shiftleft(F.least(level, F.lit(16383)).cast("long"), HASH_BITS).alias("level"))
    every = lines.sparkSession.range(1 << CELLS).select(F.col("id").cast("int").alias("cell")).join(pairs, "cell", "left")
    slices = every.groupBy(F.shiftright("cell", 10).alias("slice")).agg(F.sort_array(F.collect_list(F.struct("cell", F.coalesce("level", F.lit(0).cast("long")).alias("level")))).alias("a"))
    return slices.agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("slice", F.transform("a", lambda x: x.level).alias("a")))), lambda x: x.a)).alias("rank"))


def keys(w: Column, rank: Column) -> Column:
    """The sorted keys of an array of hashes: rank, then hash bits that tell words apart. Without nulls, longs are sorted as such."""
    key = lambda x: F.get(rank, x.bitwiseAND((1 << CELLS) - 1).cast("int")).bitwiseOR(x.bitwiseAND((1 << HASH_BITS) - 1))
    return F.sort_array(F.transform(w, lambda x: F.coalesce(key(x), F.lit(0).cast("long"))))


def bit(i: Column) -> Column:
    """A long with the bit of i's last 6 bits."""
    return F.call_function("shiftleft", F.lit(1).cast("long"), i.bitwiseAND(63).cast("int"))


def parity(k: Column, some=None) -> Column:
    """The parities, by 6 bits of another hash, of all keys or of those for which the last bit of some(key) is set."""
    one = (lambda x: some(x).bitwiseAND(1)) if some else lambda x: F.lit(1).cast("long")
    # a shift of a long reads no more than the last 6 bits
    return F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one(x), F.hash(x))))


def parities(k: Column) -> list[Column]:
    """p: the parities of all keys; q: of a half, only where there are MIDDLE keys or more; r and s: of a half of each half, from WIDE keys on."""
    odd, upper = lambda x: F.shiftright(x, 6), lambda x: F.shiftright(x, 7)
    of = lambda least, some: F.when(F.size(k) >= least, parity(k, some)).otherwise(F.lit(0).cast("long"))
    r, s = (of(WIDE, lambda x, f=f: f(x).bitwiseAND(upper(x))) for f in (lambda x: F.bitwise_not(odd(x)), odd))
    return [parity(k).alias("p"), of(MIDDLE, odd).alias("q"), r.alias("r"), s.alias("s")]


def prefix_length(n: Column, similar: int) -> Column:
    return n - F.ceil(n * similar / 100) + 1


def short_length(n: Column, similar: int) -> Column:
    """The length of the prefix in which a set must share a key with the whole prefix of any similar set that is no smaller."""
    return n - F.ceil(n * 2 * similar / (100 + similar)) + 1


def doc_hash(text: Column) -> Column:
    return F.xxhash64(F.lit(3), text)


def lines_of(df: DataFrame, text: str, key: str) -> DataFrame:
    """One row for each line: its order columns and the line (s), with a space for any other white space."""
    odd = "\t\x0b\x0c\r"
    # a split at one character finds it much faster than a regular expression or contains does
    some = reduce(Column.__or__, [F.size(F.split(text, c)) > 1 for c in odd])
    plain = F.when(some, F.translate(F.col(text), odd, " " * len(odd))).otherwise(F.col(text))
    # hashed and split before the lines are rows of their own, which then carry no text
    docs = df.where(F.col(text).isNotNull()).select(F.col(key).isNull().alias("missing"), F.col(key).cast("long").alias("id"), doc_hash(F.col(text)).alias("doc"), F.split(plain, "\n").alias("lines"))
    return docs.select("missing", "id", "doc", F.posexplode("lines").alias("line", "s"))


def numbered(lines: DataFrame) -> DataFrame:
    """One row (_id, _doc, place) for each document of the lines; place is its number, from 0, in the order of documents."""
    docs = lines.select("missing", "id", "doc").distinct().orderBy("missing", "id", "doc")
    docs = written(docs.select(F.col("id").alias("_id"), F.col("doc").alias("_doc"), F.monotonically_increasing_id().alias("at")), "docs")
    # a row for each partition of the sort
    parts = docs.groupBy(F.shiftright("at", 33).alias("part")).agg(F.count(F.lit(1)).alias("size"))
    before = F.coalesce(F.sum("size").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = F.broadcast(parts.select("part", before.alias("before")))
    place = F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1)
    out = written(docs.join(starts, F.shiftright("at", 33) == F.col("part")).select("_id", "_doc", place.alias("place")), "places")
    dropped(docs)
    return out


def classed(lines: DataFrame) -> DataFrame:
    """The lines with their class (cid, smaller for a class that appears earlier) and whether they name it (first).

    A class is named by its earliest line, and by one row of it if rows are repeated; the others are left out."""
    docs = numbered(lines)
    # long values only, which hash aggregates can hold
    cid = F.shiftleft("place", 31).bitwiseOR(F.col("line").cast("long"))
    at = lines.select("sig", "n", "row", *ORDER).join(docs, F.col("id").eqNullSafe(F.col("_id")) & (F.col("doc") == F.col("_doc")))
    at = at.select("sig", "n", "row", *ORDER, cid.alias("cid"))
    firsts = at.groupBy("sig", "n").agg(F.min("cid").alias("cid"), *[F.min_by(c, "cid").alias(f"_{c}") for c in ("row", *ORDER)])
    firsts = firsts.withColumnsRenamed({"sig": "_sig", "n": "_n"})
    joined = lines.join(firsts, (F.col("sig") == F.col("_sig")) & (F.col("n") == F.col("_n")))
    first = F.col("row") == F.col("_row")
    again = F.struct(*ORDER) == F.struct(*[F.col(f"_{c}").alias(c) for c in ORDER])
    out = written(joined.where(first | ~again).select(*ORDER, "cid", "n", first.alias("first"), F.when(first, F.col("prefix")).alias("prefix"), *BITS), "classes")
    dropped(docs)
    return out


def removals(df: DataFrame, text: str = "text", key: str = "doc_id", similar: int = SIMILAR) -> DataFrame:
    """The order columns (missing, id, doc, line) of each line that goes."""
    hashed = written(lines_of(df, text, key).select(*ORDER, word_hashes(F.col("s")).alias("w")), "hashes")
    rank = written(ranks(hashed), "ranks")
    # the optimizer merges the first two steps, so that rows don't carry the ranks
    lines = hashed.where(F.size("w") > 0).select(*ORDER, "w", rank.scalar().alias("rank"))
    lines = lines.select(*ORDER, keys(F.col("w"), F.col("rank")).alias("k"))
    k, n = F.col("k"), F.size("k")
    prefix = F.slice(k, F.lit(1), prefix_length(n, similar).cast("int"))
    lines = written(lines.select(*ORDER, F.monotonically_increasing_id().alias("row"), F.xxhash64(k).alias("sig"), n.alias("n"), prefix.alias("prefix"), *parities(k)), "lines")
    dropped(hashed, rank)
    every = classed(lines)
    dropped(lines)
    classes, equal = every.where("first"), every.where("not first").select(*ORDER)
    # sets of under 4 words are similar only if they are equal
    least = -(-similar // (100 - similar))

    def entries(c: DataFrame) -> DataFrame:
        """A row for each key of the prefixes. No column can be null, so that no filter tells the sides of a join apart and they share an exchange."""
        rows = c.where(F.col("n") >= least).select("code", "n", *BITS, F.posexplode("prefix").alias("i", "key"))
        return rows.select(*[F.coalesce(x, F.lit(0).cast(kind)).alias(x) for x, kind in rows.dtypes])

    def paired(sides: list[tuple[DataFrame, DataFrame]]) -> DataFrame:
        """The distinct pairs of the joins, done one after another, so that the shuffle files of one go before the next one's are written."""
        shares = [written(candidates(*x, similar), "pairs") for x in sides]
        used.extend(shares)
        return reduce(DataFrame.unionByName, shares).distinct()

    def similar_of(pairs: DataFrame, known: list[DataFrame]) -> DataFrame:
        wanted = pairs.select(F.explode(F.array("a", "b")).alias("cid")).distinct()
        for x in known:
            wanted = wanted.join(x, "cid", "left_anti")
        known.append(word_sets(df, classes, wanted, text, key))
        return written(similar_pairs(pairs, reduce(DataFrame.unionByName, known), similar), "near")

    used, sets = [every], []
    # a class that is similar to the leader of one of its words is decided, the leader being the earliest class
    rows = entries(classes.withColumn("code", F.col("cid"))).where(F.col("i") < short_length(F.col("n"), similar)).repartition("key")
    leaders = rows.groupBy("key").agg(*[F.min_by(c, "code").alias(c) for c in ("code", "n", *BITS, "i")])
    near = [similar_of(paired([(leaders, rows)]), sets)]
    # the others meet all earlier classes of their keys; a decided class has a negative code
    met = classes.join(near[0].withColumn("met", F.lit(True)), "cid", "left")
    state = written(met.select(F.when(F.col("met"), F.bitwise_not("cid")).otherwise(F.col("cid")).alias("code"), "n", *BITS, "prefix"), "state")
    parts = [entries(state).where(F.pmod("key", F.lit(SHARES)) == k) for k in range(SHARES)]
    near.append(similar_of(paired([(x, x) for x in parts]), sets))
    used += [state, *sets]
    gone = reduce(DataFrame.unionByName, near)
    gone = written(equal.unionByName(classes.select("cid", *ORDER).join(gone, "cid").select(*ORDER)), "gone")
    dropped(*used, *near)
    return gone


def candidates(earlier: DataFrame, later: DataFrame, similar: int) -> DataFrame:
    """Pairs (a, b) of classes, a before b and b not decided, that share a prefix key and may be similar by lengths, positions and parities."""
    a, b = earlier.alias("a"), later.alias("b")
    # a code below 0 is the complement of a decided class
    cid = F.col("a.code").bitwiseXOR(F.shiftright("a.code", 63))
    need = F.ceil(similar * (F.col("a.n") + F.col("b.n")) / (100 + similar))
    differ = F.col("a.n") + F.col("b.n") - 2 * need
    least = F.least("a.n", "b.n")
    p, q, r, s = (F.col(f"a.{c}").bitwiseXOR(F.col(f"b.{c}")) for c in BITS)
    # the parities of the keys that are in none of the named parts
    rest = lambda *parts: reduce(Column.bitwiseXOR, parts)
    middle = F.bit_count(q) + F.bit_count(rest(p, q)) <= differ
    wide = F.bit_count(r) + F.bit_count(rest(p, q, r)) + F.bit_count(s) + F.bit_count(rest(q, s)) <= differ
    fits = (
        (F.col("a.key") == F.col("b.key"))
        & (cid < F.col("b.code"))
        & (F.bit_count(p) <= differ)
        & (100 * least >= similar * F.greatest("a.n", "b.n"))
        & (F.least(F.col("a.n") - F.col("a.i"), F.col("b.n") - F.col("b.i")) >= need)
        & ((least < MIDDLE) | middle)
        & ((least < WIDE) | wide)
    )
    return a.join(b, fits).select(cid.alias("a"), F.col("b.code").alias("b")).distinct()


def word_sets(df: DataFrame, classes: DataFrame, wanted: DataFrame, text: str, key: str) -> DataFrame:
    """The word sets (cid, w) of the wanted classes, read from the lines where they first appear."""
    places = written(classes.select("cid", *ORDER).join(wanted, "cid"), "places")
    # only documents that hold such a line are read again: a bitmap of a fixed size leaves out most others
    bits = 1 << 20
    spot = lambda c: F.pmod(F.xxhash64(F.lit(9), c), F.lit(bits)).cast("int")
    bitmap = places.select(spot(F.col("doc")).alias("h")).distinct().groupBy(F.shiftright("h", 6).alias("k")).agg(F.bit_or(bit(F.col("h"))).alias("m"))
    every = df.sparkSession.range(bits >> 6).select(F.col("id").cast("int").alias("k")).join(bitmap, "k", "left")
    mask = every.agg(F.transform(F.sort_array(F.collect_list(F.struct("k", F.coalesce("m", F.lit(0).cast("long")).alias("m")))), lambda x: x.m).alias("mask"))
    doc = doc_hash(F.col(text))
    some = df.select(text, key).where(F.get(mask.scalar(), F.shiftright(spot(doc), 6)).bitwiseAND(bit(spot(doc))) != 0)
    found = lines_of(some, text, key)
    same = [found["id"].eqNullSafe(places["id"]), found["doc"] == places["doc"], found["line"] == places["line"]]
    lines = found.join(places, same[0] & same[1] & same[2]).select("cid", "s").dropDuplicates(["cid"])
    sets = written(lines.select("cid", word_hashes(F.col("s")).alias("w")), "sets")
    dropped(places)
    return sets


def similar_pairs(pairs: DataFrame, sets: DataFrame, similar: int) -> DataFrame:
    """The later class (cid) of each pair whose whole sets are similar."""
    both = pairs.join(sets.select(F.col("cid").alias("a"), F.col("w").alias("wa")), "a").join(sets.select(F.col("cid").alias("b"), F.col("w").alias("wb")), "b")
    common = both.select("b", F.size(F.array_intersect("wa", "wb")).alias("c"), (F.size("wa") + F.size("wb")).alias("t"))
    return common.where(100 * F.col("c") >= similar * (F.col("t") - F.col("c"))).select(F.col("b").alias("cid")).distinct()


def without_lines(text: Column, gone: Column) -> Column:
    """The text without the lines of the given sorted numbers, from 0: what lies between them is sliced out and joined."""
    lines = F.split(text, "\n")

    def cut(x: Column) -> Column:
        ends = F.concat(gone, F.array(F.size(x)))
        starts = F.concat(F.array(F.lit(0)), F.transform(gone, lambda i: i + 1))
        return F.array_join(F.flatten(F.transform(F.arrays_zip(starts.alias("s"), ends.alias("e")), lambda z: F.slice(x, z.s + 1, z.e - z.s))), "\n")

    return let(lines, cut)


def dedup_lines(df: DataFrame, text: str = "text", key: str = "doc_id", similar: int = SIMILAR) -> DataFrame:
    """df with its texts less the lines that go, and lines_removed, an array of their numbers from 0."""
    gone = removals(df, text, key, similar).groupBy("id", "doc").agg(F.sort_array(F.collect_set("line")).alias("lines"))
    by_id, by_doc, at = unused(df, "_id", "_doc", "_gone")
    gone = gone.withColumnsRenamed({"id": by_id, "doc": by_doc, "lines": at})
    joined = df.join(gone, F.col(key).cast("long").eqNullSafe(F.col(by_id)) & (doc_hash(F.col(text)) == F.col(by_doc)), "left")
    cleaned = F.when(F.col(at).isNull(), F.col(text)).otherwise(without_lines(F.col(text), F.col(at)))
    removed = F.coalesce(at, F.array().cast("array<int>"))
    return joined.select(*(cleaned.alias(text) if c == text else F.col(c) for c in df.columns if c != "lines_removed"), removed.alias("lines_removed"))


def op4(spark, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    gone = removals(docs).groupBy("id", "doc").agg(F.sort_array(F.collect_set("line")).alias("_gone"))
    seen = docs.select("doc_id", doc_hash(F.col("text")).alias("_doc"), F.coalesce(F.size(F.split("text", "\n")), F.lit(0)).cast("long").alias("n_lines"))
    joined = seen.join(gone.withColumnsRenamed({"doc": "_d"}), F.col("doc_id").eqNullSafe(F.col("id")) & (F.col("_doc") == F.col("_d")), "left")
    return joined.select("doc_id", "n_lines", F.coalesce(F.size("_gone"), F.lit(0)).cast("long").alias("n_removed"), F.array_join(F.coalesce("_gone", F.array().cast("array<int>")).cast("array<string>"), ",").alias("removed"))
