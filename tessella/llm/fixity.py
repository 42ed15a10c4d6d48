"""Operator 3: Merkle fixity audit of WARC replicas.

A page is one WARC record; records are laid out by page id, so a range of ids is a range of offsets. A leaf hashes the
records of one id; 2**bits neighbouring nodes make a parent, whose hash covers, in order, its children's numbers, hashes, record
counts and bytes: the offsets of the children inside the range follow from these. Each level is a written table, at most
as large as the one below (with sparse ids levels shrink late). The audit compares the roots, then descends: at each
level only the children of mismatching nodes are joined and compared, down to single records.

Every step hash-partitions by node number, so nothing grows beyond 2**bits children in one group, whatever the input; the records of
one id are combined by sums of hash parts, which are added up before they are shuffled.

Edge cases: null url or html count as empty; records with a null id have no place in the layout: they are audited under
node numbers of a reserved range (RESERVED and below, by a 40-bit hash) and reported without id, file and offset; records that
share an id are one leaf, hashed as the multiset of their (hash, count); equal rows therefore only change a count; empty replicas
have no root and all records of the other side are reported; extra columns take no part.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tessella.llm.common import write_table

BITS = 4
#: Ids of one WARC file: a file holds 2**10 of them, offsets restart with it.
FILE_BITS = 10
#: Nodes of records without an id are at most this number and more than this number less 2**40.
RESERVED = -(1 << 50)


def warc_record(url: Column, body: Column) -> Column:
    """The bytes of a record: header lines, a blank line, the body, two line ends."""
    url, body = F.coalesce(url, F.lit("")), F.coalesce(body, F.lit(""))
    head = F.concat(F.lit("WARC/1.0\r\nWARC-Type: resource\r\nWARC-Target-URI: "), url, F.lit("\r\nContent-Length: "), F.octet_length(body).cast("string"))
    return F.concat(head, F.lit("\r\n\r\n"), body, F.lit("\r\n\r\n"))


def leaves(pages: DataFrame, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """node (the id), hash, n_records, n_bytes: one row per id."""
    record = warc_record(F.col(url).cast("string"), F.col(html).cast("string"))
    df = pages.select(F.col(page_id).cast("long").alias("id"), F.sha2(record.cast("binary"), 256).alias("digest"), F.octet_length(record).cast("long").alias("bytes"))
    nowhere = F.lit(RESERVED) - F.pmod(F.xxhash64("digest"), F.lit(1 << 40))
    df = df.groupBy(F.coalesce("id", nowhere).alias("node"), "digest", "bytes").agg(F.count(F.lit(1)).alias("n"))
    one = F.sha2(F.concat_ws(":", "digest", F.col("n").cast("string")).cast("binary"), 256)
    part = lambda i: F.conv(F.substring(one, 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
    df = df.groupBy("node").agg(*[F.sum(part(i)).alias(f"p{i}") for i in range(4)], F.sum("n").alias("n_records"), F.sum(F.col("n") * F.col("bytes")).alias("n_bytes"))
    return df.select("node", F.sha2(F.concat_ws(":", *[F.col(f"p{i}").cast("string") for i in range(4)]).cast("binary"), 256).alias("hash"), "n_records", "n_bytes")


def parents(level: DataFrame, bits: int = BITS) -> DataFrame:
    """The level above: hashes of ordered ranges of 2**bits nodes."""
    return level.groupBy(F.shiftright("node", bits).alias("node")).agg(
        F.sha2(
            F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("node", "hash", "n_records", "n_bytes"))), lambda c: F.concat_ws("=", *[c[x].cast("string") for x in ("node", "hash", "n_records", "n_bytes")])), "|").cast("binary"), 256
        ).alias("hash"),
        F.sum("n_records").alias("n_records"), F.sum("n_bytes").alias("n_bytes"),
    )


def tree(pages: DataFrame, bits: int = BITS, **columns) -> list[DataFrame]:
    """Levels from the leaves up to one with at most two nodes (ids of both signs never meet)."""
    levels = [write_table(leaves(pages, **columns), "fixity")]
    while len(levels[-1].limit(3).select("node").collect()) > 2:
        levels.append(write_table(parents(levels[-1], bits), "fixity"))
    return levels


def audit(left: list[DataFrame], right: list[DataFrame], bits: int = BITS) -> tuple[DataFrame, list[int]]:
    """Differing leaves of two trees (node, left_hash, right_hash), and how many nodes were compared at each level.

    A tree that is less deep is lifted to the other's depth first.
    """
    left, right = list(left), list(right)
    while len(left) < len(right):
        left.append(write_table(parents(left[-1], bits), "fixity"))
    while len(right) < len(left):
        right.append(write_table(parents(right[-1], bits), "fixity"))
    open_nodes, counts, differ = None, [], None
    for a, b in zip(reversed(left), reversed(right), strict=True):
        if open_nodes is not None:
            child = lambda t: t.withColumn("parent", F.shiftright("node", bits)).join(open_nodes, "parent", "left_semi").drop("parent")  # noqa: B023, E731
            a, b = child(a), child(b)
        both = a.select("node", F.col("hash").alias("left_hash")).join(b.select("node", F.col("hash").alias("right_hash")), "node", "full")
        both = write_table(both, "compared")
        counts.append(both.count())
        differ = both.where(~F.col("left_hash").eqNullSafe(F.col("right_hash")))
        open_nodes = differ.select(F.col("node").alias("parent"))
    return differ, counts


def locate(pages: DataFrame, replica: DataFrame, bits: int = BITS, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Corrupt places: page_id, kind (changed, missing, extra), file_no, file_offset, n_bytes.

    The place is the one the id has in the layout of `pages`; extra records get the place they would have had.
    """
    columns = {"page_id": page_id, "url": url, "html": html}
    left, right = tree(pages, bits, **columns), tree(replica, bits, **columns)
    differ, _ = audit(left, right, bits)
    kind = F.when(F.col("left_hash").isNull(), "extra").when(F.col("right_hash").isNull(), "missing").otherwise("changed")
    wrong = differ.select("node", kind.alias("kind"))
    # Offsets are prefix sums over the files that hold a wrong record, each of a bounded number of ids.
    wrong = wrong.withColumn("file_no", F.shiftright("node", FILE_BITS))
    sizes = left[0].select("node", "n_bytes", F.shiftright("node", FILE_BITS).alias("file_no")).join(wrong.select("file_no").distinct(), "file_no", "left_semi")
    laid = sizes.join(wrong.select("file_no", "node", "kind"), ["file_no", "node"], "full").withColumn("n_bytes", F.coalesce("n_bytes", F.lit(0)))
    laid = laid.withColumn("file_offset", F.sum("n_bytes").over(Window.partitionBy("file_no").orderBy("node")) - F.col("n_bytes")).where("kind IS NOT NULL")
    placed = lambda c: F.when(~F.col("node").between(RESERVED - (1 << 40) + 1, RESERVED), F.col(c).cast("long"))
    return laid.select(placed("node").alias("page_id"), "kind", placed("file_no").alias("file_no"), placed("file_offset").alias("file_offset"), F.col("n_bytes").cast("long").alias("n_bytes"))
