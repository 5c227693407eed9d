"""WARC records and a Merkle fixity audit of replicas.

Pages become WARC response records, ordered within archives of ARCHIVE consecutive ids. A record's leaf is the SHA-256 of
its bytes; a node joins the hashes of FAN neighbours, by position, and covers their range of offsets. audit() compares the
roots of two replicas, and from level to level descends only into nodes whose hashes differ, down to the records.

Nulls: a null html or url counts as empty; records of null ids go to archives by their content's hash. Repeated rows are
records one by one, ordered by id, then by digest. A record that only one replica has is missing from the other, and moves
what follows it in its archive, which the audit then lists as well. Empty tables give an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import dropped, table, written

ARCHIVE, FAN, LEVELS = 4096, 16, 3  # FAN ** LEVELS records to an archive
SPREAD = 64


def warc_record(page_id: Column, url: Column, html: Column) -> Column:
    """The text of a WARC response record; lengths are in UTF-8 bytes."""
    body = F.coalesce(html, F.lit(""))
    head = F.concat(F.lit("WARC/1.1\r\nWARC-Type: response\r\nWARC-Record-ID: <urn:page:"), F.coalesce(page_id.cast("string"), F.lit("")), F.lit(">\r\nWARC-Target-URI: "), F.coalesce(url, F.lit("")), F.lit("\r\nContent-Type: text/html\r\nContent-Length: "), F.octet_length(body).cast("string"), F.lit("\r\n\r\n"))
    return F.concat(head, body, F.lit("\r\n\r\n"))


def records(pages: DataFrame, archive: int = ARCHIVE) -> DataFrame:
    """archive, page_id, digest and length of each page's record."""
    rec = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    hashed = pages.select("page_id", F.sha2(rec, 256).alias("digest"), F.octet_length(rec).cast("long").alias("length"))
    name = F.when(F.col("page_id").isNull(), -1 - F.pmod(F.xxhash64("digest"), F.lit(SPREAD))).otherwise(F.floor(F.col("page_id") / archive))
    return hashed.select(name.cast("long").alias("archive"), "page_id", "digest", "length")


def leaves(recs: DataFrame) -> DataFrame:
    """recs with their position and offset in their archive, as a table."""
    placed = Window.partitionBy("archive").orderBy("page_id", "digest")
    before = F.coalesce(F.sum("length").over(placed.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return recs.select("archive", "page_id", "digest", "length", (F.row_number().over(placed) - 1).cast("long").alias("position"), before.alias("offset"))


def nodes(leaf: DataFrame, fan: int = FAN, levels: int = LEVELS) -> list[DataFrame]:
    """The tree of each archive, roots first: archive, node, hash, offset and end; the last are the leaves."""
    level = leaf.select("archive", F.col("position").alias("node"), F.col("digest").alias("hash"), "offset", (F.col("offset") + F.col("length")).alias("end"))
    tree = [level]
    for k in range(levels):
        up = F.floor(F.col("node") / fan) if k + 1 < levels else F.lit(0).cast("long")
        joined = F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("node", "hash"))), lambda x: x.hash), "")
        level = level.groupBy("archive", up.alias("up")).agg(F.sha2(joined, 256).alias("hash"), F.min("offset").alias("offset"), F.max("end").alias("end")).withColumnRenamed("up", "node")
        tree.append(level)
    return tree[::-1]


def audit(first: DataFrame, second: DataFrame, fan: int = FAN, levels: int = LEVELS) -> DataFrame:
    """Nodes that differ between two replicas' leaves, by level from the roots (0) down: level, archive, node, offsets.

    first and second: tables that leaves() gives. Each level is compared only below nodes that differ in the one above."""
    open_nodes, out = None, None
    for depth, (a, b) in enumerate(zip(nodes(first, fan, levels), nodes(second, fan, levels))):
        if open_nodes is not None:
            up = F.floor(F.col("node") / fan) if depth > 1 else F.lit(0).cast("long")
            below = open_nodes.select("archive", F.col("node").alias("up"))
            a, b = (x.withColumn("up", up).join(below, ["archive", "up"], "left_semi").drop("up") for x in (a, b))
        sides = [x.select(F.struct("archive", "node").alias("at"), F.struct("hash", "offset", "end").alias(s)) for x, s in ((a, "a"), (b, "b"))]
        both = sides[0].join(sides[1], "at", "full").where(~F.col("a.hash").eqNullSafe(F.col("b.hash")))
        open_nodes = written(both.select(F.lit(depth).alias("level"), "at.archive", "at.node", F.coalesce("a.offset", "b.offset").alias("offset"), F.coalesce("a.end", "b.end").alias("end"), F.when(F.col("a").isNull(), "only second").when(F.col("b").isNull(), "only first").otherwise("differs").alias("kind")), "audit")
        out = open_nodes if out is None else out.unionByName(open_nodes)
    return out


def verify(pages: DataFrame, replica: DataFrame) -> DataFrame:
    """A row for each record of pages: archive, page_id, position, offset, length, digest, root of its archive, and intact."""
    a, b = written(leaves(records(pages)), "leaves"), written(leaves(records(replica)), "leaves")
    bad = audit(a, b).where(F.col("level") == LEVELS).select("archive", F.col("node").alias("position"), F.lit(False).alias("ok"))
    roots = nodes(a)[0].select("archive", F.col("hash").alias("root"))
    out = a.join(bad, ["archive", "position"], "left").join(roots, "archive")
    return out.select("archive", "page_id", "position", "offset", "length", "digest", "root", F.coalesce("ok", F.lit(True)).alias("intact"))


def damaged(pages: DataFrame) -> DataFrame:
    """A replica with known damage for the audit to find: pages whose url's SHA-256 starts with the digits 5a lose their last character."""
    hit = F.sha2(F.coalesce("url", F.lit("")), 256).startswith("5a")
    return pages.withColumn("html", F.when(hit, F.expr("left(html, greatest(length(html) - 1, 0))")).otherwise(F.col("html")))


def op3(spark, sf_dir: str) -> DataFrame:
    pages = table(spark, sf_dir, "pages").select("page_id", "url", "html")
    return verify(pages, damaged(pages))


ORACLE = r"""
with r as (
  select page_id, url, coalesce(html, '') body from pages
), rec as (
  select page_id, floor(page_id / 4096)::bigint archive,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: response' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || page_id || '>' || chr(13) || chr(10)
    || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10) || 'Content-Length: ' || strlen(body) || chr(13) || chr(10) || chr(13) || chr(10)
    || body || chr(13) || chr(10) || chr(13) || chr(10) record, url, body from r
), leaf as (
  select archive, page_id, sha256(record) digest, strlen(record)::bigint length,
    row_number() over (partition by archive order by page_id, sha256(record)) - 1 as position,
    coalesce(sum(strlen(record)) over (partition by archive order by page_id, sha256(record) rows between unbounded preceding and 1 preceding), 0)::bigint as "offset", url, body
  from rec
), l1 as (
  select archive, position // 16 node, sha256(string_agg(digest, '' order by position)) hash from leaf group by all
), l2 as (
  select archive, node // 16 node, sha256(string_agg(hash, '' order by node)) hash from l1 group by all
), root as (
  select archive, sha256(string_agg(hash, '' order by node)) root from l2 group by all
)
select archive, page_id, position, "offset", length, digest, root, not (body <> '' and sha256(coalesce(url, '')) like '5a%') intact
from leaf join root using (archive)
"""
