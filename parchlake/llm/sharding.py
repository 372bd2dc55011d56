"""Sharding by sampled splitters (operator 5); the law is `bytes`: shards of nearly equal size.

Records are ordered by (md5 of the text, id). Keys are sampled with probability in proportion to their record's
size, quantiles of the sample bound ``ranges`` ranges, and records are range-partitioned by them; ranges with over
twice the mean size are subdivided by splitters sampled inside them, until none is or their keys are all equal.
Exact sizes of the ranges then give every record its exact offset in bytes.

Records of equal text share a shard, if a shard can hold them. Such groups of over a twentieth of a shard (there are
at most ``20 * shards`` of them) are dealt out first: by falling size, each to the shard with the least so far. The
rest fills what room the shards have left, in the order of offsets, and a group stays with its middle; a group of more
than a shard's size is cut like rows are, by id.

Cases: a null text has size 1 and counts as an empty text; null ids sort first; repeated rows are kept, each with
a slot of its own; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, mapped, table

SHARDS = 16
#: Rows and sampled keys of a range; there are at least RANGES of them.
ROWS, SAMPLE, RANGES = 100_000, 32, 128
BROADCAST_ROWS = 1_000_000
KEYED = "h string, id long, size long, crc long"


def _keys(rows) -> list[tuple]:  # noqa: ANN001
    return [(r["h"], r["id"] is not None, r["id"] or 0) for r in rows]


def _ranged(keyed: DataFrame, splitters: list[tuple]) -> DataFrame:
    """Adds `r`, the number of splitters at or below the record's key."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        at = [bisect_right(splitters, (h, i is not None, i or 0)) for h, i in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
        return b.append_column("r", pa.array(at, pa.int32()))

    return mapped(keyed, fn, f"{KEYED}, r int")


def _drawn(df: DataFrame, rate, most: int) -> list[tuple]:  # noqa: ANN001
    """Keys drawn with probability size * rate; the draw depends on the key alone, and at most `most` come back."""
    u = F.pmod(F.xxhash64("h", "id", F.lit(5)), F.lit(1 << 40)) / F.lit(float(1 << 40))
    return sorted(set(_keys(df.where(u < F.col("size") * rate).select("h", "id").orderBy(u).limit(most).collect())))


def splitters_of(keyed: DataFrame, total: int, ranges: int, sample: int) -> list[tuple]:
    drawn = _drawn(keyed, F.lit(sample / max(1, total)), 2 * sample)
    cuts = sorted({drawn[len(drawn) * k // ranges] for k in range(1, ranges)} if drawn else set())
    while True:  # each round adds splitters, or is the last
        sizes = {x["r"]: x["s"] for x in _ranged(keyed, cuts).groupBy("r").agg(F.sum("size").alias("s")).collect()}
        large = [r for r, s in sizes.items() if s > 2 * total / ranges]
        if not large:
            return cuts
        inside = _drawn(_ranged(keyed, cuts).where(F.col("r").isin(large)), F.lit(sample / max(1, sum(sizes[r] for r in large))), 2 * sample)
        more = set(cuts)
        for r in large:
            own = [k for k in inside if bisect_right(cuts, k) == r]
            parts = min(len(own), int(sizes[r] * ranges / total) + 1)
            more |= {own[len(own) * k // parts] for k in range(1, parts)} if parts > 1 else set(own)
        if len(more) == len(cuts):
            return cuts
        cuts = sorted(more)


def dealt(groups: list[tuple[str, int]], shards: int) -> tuple[dict[str, int], list[int]]:
    """(shard by group, sizes of the shards): groups (hash, size) by falling size, each to the shard with the least so far."""
    to, room = {}, [0] * shards
    for h, size in sorted(groups, key=lambda g: (-g[1], g[0])):
        k = room.index(min(room))
        to[h] = k
        room[k] += size
    return to, room


def shard(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", shards: int = SHARDS, ranges: int | None = None, sample: int | None = None) -> DataFrame:
    """One row per input row: id, size, text_crc32, shard, slot."""
    text = F.coalesce(F.col(text_col), F.lit(""))
    keyed = cut(df.select(F.md5(text.cast("binary")).alias("h"), F.col(id_col).cast("long").alias("id"), (F.octet_length(text).cast("long") + 1).alias("size"), F.crc32(text.cast("binary")).alias("crc")), "shard-keys")
    all_ = keyed.agg(F.sum("size").alias("s"), F.count("*").alias("n")).first()
    total = all_["s"] or 0
    ranges = ranges or max(RANGES, all_["n"] // ROWS)
    by_range = _ranged(keyed, splitters_of(keyed, total, ranges, sample or SAMPLE * ranges))
    bounds, at = [], 0
    for x in by_range.groupBy("r").agg(F.sum("size").alias("s")).orderBy("r").collect():  # one row per range
        bounds.append((x["r"], at))
        at += x["s"]
    spark = df.sparkSession
    starts = F.broadcast(spark.createDataFrame(bounds or [(0, 0)], "r int, byte0 long"))
    in_order = Window.partitionBy("r").orderBy("h", F.col("id").asc_nulls_first())
    placed = by_range.withColumn("c", F.sum("size").over(in_order.rowsBetween(Window.unboundedPreceding, 0)))
    placed = cut(placed.join(starts, "r").select("r", "h", "id", "size", "crc", (F.col("byte0") + F.col("c") - F.col("size")).alias("off")), "shard-offsets")

    groups = cut(placed.groupBy("h").agg(F.min("off").alias("g0"), F.sum("size").alias("g"), F.count("*").alias("n")).where("n > 1"), "shard-groups")
    # lone records can be large too; they are groups like any other
    large = placed.where(F.col("size") * (20 * shards) > total).select("h", "size").unionByName(groups.where(F.col("g") * (20 * shards) > total).select("h", F.col("g").alias("size")))
    sizes = {r["h"]: r["s"] for r in large.groupBy("h").agg(F.max("size").alias("s")).where(F.col("s") * shards <= total).collect()}  # at most 20 * shards
    to, held = dealt(list(sizes.items()), shards)
    order = sorted(sizes)
    before = [0, *accumulate(sizes[h] for h in order)]
    target = (total + shards - 1) // shards
    ends = list(accumulate(max(0, target - x) for x in held))

    def place(b: pa.RecordBatch) -> pa.RecordBatch:
        out = []
        for h, size, off, g0, g in zip(*(b.column(k).to_pylist() for k in (1, 3, 5, 6, 7)), strict=True):
            if (k := to.get(h)) is None:
                if g is not None and g * shards <= total:  # the group's middle decides, else the row's own
                    off, size = g0, g
                off -= before[bisect_right(order, h)]
                k = min(bisect_right(ends, off + size // 2), shards - 1)
            out.append(k)
        return b.select(["r", "h", "id", "size", "crc"]).append_column("shard", pa.array(out, pa.int32()))

    small = F.broadcast(groups) if groups.count() <= BROADCAST_ROWS else groups
    rows = placed.join(small.drop("n"), "h", "left").select("r", "h", "id", "size", "crc", "off", "g0", "g")
    out = cut(mapped(rows, place, f"r int, {KEYED.replace('crc long', 'crc long, shard int')}"), "shard-of")
    heads, at = [], {}
    for x in out.groupBy("shard", "r").agg(F.count("*").alias("n")).orderBy("shard", "r").collect():  # a few rows per range
        heads.append((x["shard"], x["r"], at.get(x["shard"], 0)))
        at[x["shard"]] = heads[-1][2] + x["n"]
    heads = F.broadcast(spark.createDataFrame(heads or [(0, 0, 0)], "shard int, r int, head long"))
    own = Window.partitionBy("r", "shard").orderBy("h", F.col("id").asc_nulls_first())
    out = out.withColumn("i", F.row_number().over(own)).join(heads, ["shard", "r"])
    return out.select(F.col("id").alias(id_col), "size", F.col("crc").alias("text_crc32"), "shard", (F.col("head") + F.col("i") - 1).alias("slot"))


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = shard(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


OP5_SQL = """
WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS text, octet_length(encode(coalesce(text, '')))::BIGINT + 1 AS size FROM documents),
k AS (SELECT doc_id, size, text, md5(text) AS h FROM d),
t AS (SELECT sum(size)::BIGINT AS total FROM k),
p AS (SELECT *, (sum(size) OVER (ORDER BY h, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size)::BIGINT AS off FROM k),
g AS (SELECT *, min(off) OVER (PARTITION BY h) AS g0, sum(size) OVER (PARTITION BY h)::BIGINT AS g FROM p),
big AS (SELECT h, g, row_number() OVER (ORDER BY g DESC, h) AS k FROM (SELECT DISTINCT h, g FROM g, t WHERE g * 320 > total AND g * 16 <= total)),
deal(k, h, shard, room) AS (SELECT 0::BIGINT, NULL::VARCHAR, 0::BIGINT, list_transform(range(16), lambda x: 0::BIGINT) UNION ALL
  SELECT big.k, big.h, list_position(room, list_min(room)) - 1, list_transform(room, lambda x, i: CASE WHEN i = list_position(room, list_min(room)) THEN x + big.g ELSE x END) FROM deal JOIN big ON big.k = deal.k + 1),
room AS (SELECT room FROM deal ORDER BY k DESC LIMIT 1),
ends AS (SELECT i, sum(greatest(0, (total + 15) // 16 - room[i + 1])) OVER (ORDER BY i) AS e FROM t, room, (SELECT unnest(range(16)) AS i)),
ahead AS (SELECT h, sum(g) OVER (ORDER BY h) AS s FROM big),
s AS (SELECT g.*, CASE WHEN g * 16 <= total THEN g0 + g // 2 ELSE off + size // 2 END - coalesce(ahead.s, 0) AS mid FROM t, g ASOF LEFT JOIN ahead ON g.h >= ahead.h),
o AS (SELECT s.doc_id, s.size, s.h, s.text, coalesce(deal.shard, least(15, (SELECT count(*) FROM ends WHERE e <= mid)))::INT AS shard FROM s LEFT JOIN deal ON s.h = deal.h)
SELECT doc_id, size, xor(list_reduce(list_prepend(4294967295, list_transform(range(0, 2 * size - 2, 2), lambda i: 16 * x[i + 1] + x[i + 2])),
  lambda c, b: list_reduce([xor(c, b), 0, 0, 0, 0, 0, 0, 0, 0], lambda v, z: xor(v >> 1, 3988292384 * (v & 1)))), 4294967295)::BIGINT AS text_crc32, 'bytes' AS law, shard,
  row_number() OVER (PARTITION BY shard ORDER BY h, doc_id NULLS FIRST) - 1 AS slot, NULL::INT AS grown_shard
FROM (SELECT *, list_transform(string_split(hex(encode(text)), ''), lambda c: strpos('0123456789ABCDEF', c) - 1) AS x FROM o)
"""
