"""N-gram Jaccard join: a size-aware heavy-light join of shingle sets, and its components (operator 4).

A document's set is that of its distinct 5-word shingles, as 64-bit hashes. Two sets link if 100 * |A and B| >= 80 *
|A or B|, so they have at least ceil(0.8 n) elements in common. In any common order of all shingles, c of these are
among the first n - ceil(0.8 n) + c of either set, and this is where partners meet:

* small sets enumerate all pairs (fixed-size subsets, c = 2) of those elements; equal pairs meet;
* large sets are found by scanning the inverted lists of those elements (c = 1), which small sets that are large
  enough to link with large ones post to as well;
* the boundary is the size at which the sum of the estimated costs (subsets written, list entries scanned) is
  least, from the sizes of all sets.

The order puts shingles that are frequent last (by how many shingles of all documents fall into each of
2 ** 24 to 2 ** 26 parts of the hash range, beyond what chance puts there), so a passage that many documents share is
no meeting place for them. Two entries of a list are a candidate only if their sizes and positions allow a link.
Lists of up to ``LIST`` entries give all candidates; longer ones give each entry with its neighbour and with the
first of a band of sizes. Of candidates, only those are checked on the whole sets whose bitmaps allow enough common elements: each set
has a bitmap of 4 to 8 bits an element, and the elements behind bits that the other lacks are not common. First each
node is checked with the partner that it shares most meeting places with, then what is still between components.
At last, entries of long lists that are in different components meet, at first each with the partner alone of
which the bitmaps allow most, then with all: a list's largest component meets the others,
in blocks of ``BLOCK`` entries, and no pair leaves a block that its bitmaps, folded to a quarter, rule out. A group of near copies is one
component by then and is never expanded. Equal sets are one node from the start. Up to ``LOCAL_LINKS`` links, which
are counted, one task finds the components by union and find; beyond that alternating large and small stars do.
Nothing but a fixed-size table and counts goes to the driver.

Hashes have 64 bits: among a million documents of 500 shingles any two shingles collide with a chance of 0.7 %, and
a collision changes one element of a set.

Cases: a text of one to four words has one shingle, all its words; a null or empty text, or one without words, has
none and links with nothing; null ids take part and are never the smallest unless no other is there; repeated rows
are members of one class; an empty table gives an empty result; other columns are ignored or, in `keep_one`, kept.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from itertools import chain, combinations, groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, cut, drop, fresh, in_arrow, mapped, parts, table

N_WORDS, PERCENT = 5, 80
LIST, BLOCK = 16, 2048
#: The largest factor between sizes of a band (less than 100 / PERCENT), and a power of 2.
BAND, ORDERS = 1.12, 4
FREQUENT = 16
#: Chunks of the table, each summed as one, and the largest size that the boundary depends on.
CHUNKS, SIZES = 1 << 12, 500
#: Bytes of a batch of these that a worker sends.
SENT = 1 << 20
BROADCAST_ROWS, LOCAL_LINKS = 1_000_000, 1_000_000
_ODD = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))



def shingles(text: bytes | None) -> np.ndarray:
    """The sorted set of a text's shingle hashes."""
    words = (text or b"").lower().split()
    n = len(words)
    if not n:
        return np.empty(0, np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, n)
    k = min(n, N_WORDS)
    x = h[: n - k + 1] * _ODD[0]
    for j in range(1, k):
        x = x + mixed(h[j : n - k + 1 + j] + _ODD[j])
    x = np.sort(mixed(x + np.uint64(k)))
    return x[np.concatenate([[True], x[1:] != x[:-1]])]


def least_common(n: int) -> int:
    return -(-PERCENT * n // 100)


def in_order(s: np.ndarray, frequent: np.ndarray) -> np.ndarray:
    """The set with frequent elements last; both parts by hash. `frequent`: a bit for each part of the hash range."""
    part = (s >> np.uint64(64 - (len(frequent) * 8).bit_length() + 1)).astype(np.int64)
    flags = (frequent[part >> 3] >> (7 - (part & 7)).astype(np.uint8) & 1).astype(bool)
    return np.concatenate([s[~flags], s[flags]])


def bitmap(s: np.ndarray) -> bytes:
    """4 to 8 bits for each element; those that the elements' last bits number are set."""
    bits = np.zeros(max(256, 1 << (4 * len(s) - 1).bit_length()), np.uint8)
    bits[(s & np.uint64(len(bits) - 1)).astype(np.int64)] = 1
    return np.packbits(bits).tobytes()


def folded(x: np.ndarray, size: int) -> np.ndarray:
    """Bitmaps (in 64-bit parts, one in each row) for smaller sets."""
    while x.shape[-1] > size:
        half = x.shape[-1] // 2
        x = x[..., :half] | x[..., half:]
    return x


def most_common(na, a: np.ndarray, nb, b: np.ndarray):  # noqa: ANN001, ANN201
    """The common elements that bitmaps of equal size allow at most: none is behind a bit that the other set lacks."""
    return np.minimum(na - np.bitwise_count(a & ~b).sum(-1, dtype=np.int64), nb - np.bitwise_count(b & ~a).sum(-1, dtype=np.int64))


def enough(common, na, nb):  # noqa: ANN001, ANN201
    return (100 + PERCENT) * common >= PERCENT * (na + nb)


def keys_of(s: np.ndarray, boundary: int) -> tuple[np.ndarray, np.ndarray]:
    """(meeting places, positions) of an ordered set; a subset's position is that of its first element.

    The lowest bit tells subsets (0) from single elements (1).
    """
    n = len(s)
    least = least_common(n)
    keys, at = [], []
    one = np.uint64(1)
    if n <= boundary and n >= 4:
        head = s[: n - least + 2]
        i, j = np.array(list(combinations(range(len(head)), 2)), np.int64).T
        keys.append(mixed(head[i] * _ODD[0] + mixed(head[j] + _ODD[1])) & ~one)
        at.append(i)
    if n > boundary or (n >= 4 and 100 * n >= PERCENT * (boundary + 1)):
        head = s[: n - least + 1]
        keys.append(head | one)
        at.append(np.arange(len(head)))
    if not keys:
        return np.empty(0, np.uint64), np.empty(0, np.int64)
    return np.concatenate(keys), np.concatenate(at)


def boundary_by_cost(sizes: dict[int, int], scan: float = 4.0, most: int = 400) -> int:
    """The size up to which subsets cost less than lists; `scan`: entries read for each one posted."""
    subsets = lambda n: (n - least_common(n) + 2) * (n - least_common(n) + 1) / 2
    lists = lambda n: (n - least_common(n) + 1) * scan

    def cost(x: int) -> float:
        return sum(c * ((subsets(n) if n <= x else 0) + (lists(n) if n > x or 100 * n >= PERCENT * (x + 1) else 0)) for n, c in sizes.items() if 4 <= n)

    near = {n: c for n, c in sizes.items() if n <= most * 5 // 4}
    sizes = near or {}
    return min(range(3, most + 1), key=lambda x: (cost(x), x)) if sizes else 3


def table_bits(rows: int) -> int:
    """Bits of the frequency table's index: a few shingles for each part, within 2 ** 24 to 2 ** 26 parts."""
    return min(max((64 * rows).bit_length(), 24), 26)


def _sums(rows: Iterable[tuple[int, int, bytes | None]]) -> Iterator[pa.RecordBatch]:
    """Rows (k, n, x) as Arrow batches of about ``SENT`` bytes: a whole table at once would weigh on the worker and, sent, on its JVM."""
    held, size = [], 0
    kinds = pa.schema([("k", pa.int64()), ("n", pa.int64()), ("x", pa.binary())])
    for r in rows:
        held.append(r)
        size += 32 + len(r[2] or b"")
        if size >= SENT:
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*held, strict=True), kinds, strict=True)], schema=kinds)


def _survey(docs: DataFrame, text_col: str) -> tuple[np.ndarray, int]:
    """The table of frequent shingles (a bit for each part) and the boundary, from counts over all documents."""
    bits = table_bits(docs.count())
    chunk = (1 << bits) // CHUNKS

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, sizes = np.zeros(1 << bits, np.uint16), np.zeros(SIZES + 1, np.int64)
        for b in parts(batches):
            sets = [shingles(t) for t in set(byte_texts(b.column(0)))]  # copies side by side count once
            if sets:
                sizes += np.bincount([len(s) for s in sets if len(s) <= SIZES], minlength=SIZES + 1)
                part, n = np.unique(np.sort((np.concatenate(sets) >> np.uint64(64 - bits)).astype(np.uint32)), return_counts=True)
                counts[part] = np.minimum(counts[part] + n, 65535)
        at = np.flatnonzero(counts)
        ends = np.searchsorted(at, np.arange(0, (1 << bits) + 1, chunk))
        own = ((k, at[ends[k] : ends[k + 1]]) for k in np.flatnonzero(np.diff(ends)).tolist())
        yield from _sums(chain(((-1 - int(k), int(sizes[k]), None) for k in np.flatnonzero(sizes)), ((k, 0, np.stack([i % chunk, counts[i]]).astype(np.uint16).tobytes()) for k, i in own)))

    def total(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in the order of k, so the counts of one chunk are held at a time."""

        def of(k: int, rows: Iterable[tuple]) -> tuple:
            if k < 0:
                return k, sum(n for _, n, _ in rows), None
            out = np.zeros(chunk, np.int64)
            for _, _, x in rows:
                own, more = np.frombuffer(x, np.uint16).reshape(2, -1)
                out[own] += more
            return k, int(out.sum()), out.tobytes()

        rows = chain.from_iterable(zip(*(c.to_pylist() for c in b.columns), strict=True) for b in batches)
        yield from _sums(of(k, own) for k, own in groupby(rows, itemgetter(0)))

    schema = "k long, n long, x binary"
    counts = cut(in_arrow(in_arrow(docs.select(F.col(text_col).alias("text")), fn, schema).repartition("k").sortWithinPartitions("k"), total, schema), "shingle-counts")
    rows = counts.select("k", "n").collect()  # one for each size and chunk
    chance = sum(r["n"] for r in rows if r["k"] >= 0) / (1 << bits)
    least = FREQUENT + chance + 6 * chance**0.5

    def flagged(b: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([np.packbits(np.frombuffer(x, np.int64) >= least).tobytes() for x in b.column(1).to_pylist()])], ["k", "x"])

    frequent = np.zeros((CHUNKS, chunk // 8), np.uint8)
    for r in mapped(counts.where("k >= 0").select("k", "x"), flagged, "k long, x binary").collect():  # a bit for each part
        frequent[r["k"]] = np.frombuffer(r["x"], np.uint8)
    drop(counts)
    return frequent.ravel(), boundary_by_cost({-1 - r["k"]: r["n"] for r in rows if r["k"] < 0})


def _described(docs: DataFrame, id_col: str, text_col: str, frequent: np.ndarray, boundary: int) -> DataFrame:
    """One row per document: id, th, node, n; keys, at, bits and few (a quarter of the bits), once for each node and task."""
    kind = dict(docs.dtypes)[id_col]
    shared = docs.sparkSession.sparkContext.broadcast(frequent)

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for b in parts(batches):
            nodes, sizes, keys, ats, maps, small = [], [], [], [], [], []
            memo: dict[bytes | None, tuple[int | None, int]] = {}
            for t in byte_texts(b.column(2)):
                k = a = bits = few = None
                if t not in memo:
                    s = shingles(t)
                    node = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                    memo[t] = node, len(s)
                    if len(s) and node not in seen:
                        seen.add(node)
                        k, a = keys_of(in_order(s, shared.value), boundary)
                        k, a, bits = k.view(np.int64), a.astype(np.int32), bitmap(s)
                        few = folded(np.frombuffer(bits, np.uint64), len(bits) // 32).tobytes()
                node, n = memo[t]
                nodes.append(node)
                sizes.append(n)
                keys.append(k)
                ats.append(a)
                maps.append(bits)
                small.append(few)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(nodes, pa.int64()), pa.array(sizes, pa.int64()), pa.array(keys, pa.list_(pa.int64())), pa.array(ats, pa.list_(pa.int32())), pa.array(maps, pa.binary()), pa.array(small, pa.binary())], ["id", "th", "node", "n", "keys", "at", "bits", "few"])

    rows = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("th"), F.col(text_col).alias("text"))
    return in_arrow(rows, fn, f"id {kind}, th long, node long, n long, keys array<long>, at array<int>, bits binary, few binary")


def _may_link(n0: np.ndarray, i0: np.ndarray, n1, i1) -> np.ndarray:  # noqa: ANN001
    """Whether sets may link whose first common element has these positions."""
    need = -(-PERCENT * (n0 + n1) // (100 + PERCENT))
    return (100 * np.minimum(n0, n1) >= PERCENT * np.maximum(n0, n1)) & (1 + np.minimum(n0 - 1 - i0, n1 - 1 - i1) >= need)


FOUND = "a long, b long, key long, n long, at int"


def _scanned(entries: DataFrame, boundary: int) -> DataFrame:
    """Scans the inverted lists (key, n, node, at): candidates (a, b), and the entries of long lists (b null).

    Entries of a list are ordered by bands of sizes of which any two allow a link, and then in one of ``ORDERS`` orders
    of the nodes, which the key chooses: entries that meet in many long lists get several neighbours and band heads.
    A list streams through its task: what is longer than a batch is held as its last entry and its band's first alone.
    """
    turn = F.shiftright("key", 1).bitwiseAND(ORDERS - 1)
    ordered = entries.repartition("key").withColumn("band", F.floor(F.ln("n") * (1 / math.log(BAND)))).withColumn("h", F.xxhash64("node", turn))
    ordered = ordered.sortWithinPartitions("key", "band", "h", "node")
    out: list[tuple] = []

    def short(key: int, n: np.ndarray, node: np.ndarray, at: np.ndarray) -> None:
        order = np.argsort(n, kind="stable")
        n, node, at = n[order], node[order], at[order]
        ends = np.searchsorted(n, n * 100 // PERCENT, side="right")
        for i in range(len(n) - 1):
            js = np.arange(i + 1, ends[i])
            if key & 1:
                js = js[n[js] > boundary]  # two small sets meet in a subset
            if len(js):
                js = js[_may_link(n[i], at[i], n[js], at[js])]
                out.append((np.minimum(node[i], node[js]), np.maximum(node[i], node[js])))

    def long(key: int, band: np.ndarray, n: np.ndarray, node: np.ndarray, at: np.ndarray, new: int) -> None:
        """The last `new` entries of a list, behind its last band's first entry and its last one so far, if any."""
        m = len(n)
        i = np.arange(max(1, m - new), m)
        head = np.maximum.accumulate(np.where(np.concatenate([[True], band[1:] != band[:-1]]), np.arange(m), 0))
        for j, k in ((i - 1, i), (head[i], i)):
            ok = _may_link(n[j], at[j], n[k], at[k]) & (node[j] != node[k])
            out.append((np.minimum(node[j], node[k])[ok], np.maximum(node[j], node[k])[ok]))
        out.append((node[m - new :], None, np.full(new, key), n[m - new :], at[m - new :].astype(np.int32)))

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[np.ndarray] | None = None  # entries of the list that the last batch ended in
        opened: int | None = None  # its key, if entries are out already: rest begins with its band's first and its last one

        def lists(cols: list[np.ndarray], starts: np.ndarray, ends: np.ndarray, done: bool) -> None:
            nonlocal opened, rest
            again = np.concatenate([[False], (cols[0][1:] == cols[0][:-1]) & (cols[3][1:] == cols[3][:-1])])
            for s, e in zip(starts.tolist(), ends.tolist(), strict=True):
                keep = ~again[s:e]  # a node comes once for each task that saw it
                key, own = int(cols[0][s]), [c[s:e][keep] for c in cols[1:]]
                if opened == key:
                    known = 2 - int(again[s + 1])  # the last one may be its band's first
                    if len(own[0]) > known:
                        long(key, *own, len(own[0]) - known)
                elif len(own[0]) > LIST:
                    long(key, *own, len(own[0]))
                    opened = key
                elif done and len(own[0]) > 1:
                    short(key, *own[1:])

        for b in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in b.columns]
            if rest is not None:
                cols = [np.concatenate([x, y]) for x, y in zip(rest, cols, strict=True)]
            key = cols[0]
            starts = np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            full = np.diff(starts) > 1
            lists(cols, starts[:-1][full], starts[1:][full], True)
            last = starts[-1]
            if len(key) - last > 10_000:
                lists(cols, starts[-1:], np.array([len(key)]), False)
                head = last + int(np.argmax(cols[1][last:] == cols[1][-1]))
                rest = [c[[head, -1]] for c in cols] if opened == key[-1] else [c[last:] for c in cols]
            else:
                rest = [c[last:] for c in cols]
            if sum(len(x[0]) for x in out) > 10_000:
                yield from _joined(out)
        if rest is not None and len(rest[0]) > 1:
            lists(rest, np.array([0]), np.array([len(rest[0])]), True)
        yield from _joined(out)

    return in_arrow(ordered.select("key", "band", "n", "node", "at"), fn, FOUND)


def _joined(out: list[tuple]) -> Iterator[pa.RecordBatch]:
    """What lists have given, as few batches."""
    for own in ([x for x in out if x[1] is not None], [x for x in out if x[1] is None]):
        if m := sum(len(x[0]) for x in own):
            cols = [np.concatenate(c) if c[0] is not None else None for c in zip(*own, strict=True)]
            cols = [pa.array(c) if c is not None else pa.nulls(m, pa.int64()) for c in cols]
            yield pa.RecordBatch.from_arrays(cols if len(cols) == 5 else [*cols, pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int32())], ["a", "b", "key", "n", "at"])
    out.clear()


def _possible(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (a, b, c) that their bitmaps allow. sketches: node, n, bits."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        keep = []
        for na, x, nb, y in zip(*(c.to_pylist() for c in b.columns[3:]), strict=True):
            x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
            size = min(len(x), len(y))
            keep.append(bool(enough(most_common(na, folded(x, size), nb, folded(y, size)), na, nb)))
        return b.select(["a", "b", "c"]).filter(pa.array(keep, pa.bool_()))

    of = lambda c: sketches.select(F.col("node").alias(c), F.col("n").alias(f"n{c}"), F.col("bits").alias(f"x{c}"))
    both = pairs.join(of("a"), "a").join(of("b"), "b")
    return mapped(both.select("a", "b", "c", "na", "xa", "nb", "xb"), fn, "a long, b long, c long")


def _blocks(rows: DataFrame, block: int) -> DataFrame:
    """Deals the entries (key, n, node, at, comp) of lists with several components into units, in which partners meet.

    Entries of the list's largest component go by their hash into parts of `block`, and so do all others. Each part of
    the first meets each of the second, and each part of the second meets each such part. Adds: unit, and a side (null
    where all entries of the unit meet, else those of different sides do).
    """
    own = rows.groupBy("key", "comp").agg(F.count("*").alias("m"))
    lists = own.groupBy("key").agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.max("m").alias("most"), (F.sum("m") - F.max("m")).alias("others")).where("others > 0")
    blocks = lambda c: F.ceil(F.col(c) / block).cast("int")
    lists = cut(lists.select("key", "main", blocks("most").alias("pm"), blocks("others").alias("po")), "lists")
    dealt = rows.join(_if_small(lists, BROADCAST_ROWS), "key")
    is_main = F.col("comp") == F.col("main")
    part = F.pmod(F.xxhash64("node"), F.when(is_main, F.col("pm")).otherwise(F.col("po"))).cast("int")
    unit = lambda kind, u, v, side: F.struct(F.lit(kind).alias("kind"), u.alias("u"), v.alias("v"), side.cast("int").alias("side"))
    p = F.col("part")
    with_main = F.transform(F.sequence(F.lit(0), F.col("pm") - 1), lambda i: unit(1, i, p, F.lit(1)))
    with_others = F.transform(F.sequence(F.lit(0), F.col("po") - 1), lambda i: unit(0, F.least(i, p), F.greatest(i, p), F.when(i != p, (p > i).cast("int"))))
    mains = F.transform(F.sequence(F.lit(0), F.col("po") - 1), lambda i: unit(1, p, i, F.lit(0)))
    out = dealt.withColumn("part", part).withColumn("x", F.explode(F.when(is_main, mains).otherwise(F.concat(with_main, with_others))))
    return out.select(F.xxhash64("key", "x.kind", "x.u", "x.v").alias("unit"), F.col("x.side").alias("side"), "key", "n", "node", "at", "comp")


def _across(long: DataFrame, comps: DataFrame, sketches: DataFrame, boundary: int, block: int = BLOCK, best: bool = False) -> DataFrame:
    """Pairs (a, b) of long lists' entries in different components, if sizes, positions and bitmaps allow a link.

    best: of each entry and block only the pair of which the bitmaps allow most.
    """
    rows = long.select("key", "n", F.col("a").alias("node"), "at").join(_if_small(comps, BROADCAST_ROWS), "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    units = _blocks(rows, block).join(sketches.select("node", "few"), "node")

    def of_unit(cols: list[list]) -> list[tuple]:
        side, key, n, node, at, comp = (np.array(c) for c in cols[:-1])
        raw = cols[-1]
        words = np.array([len(x) // 8 for x in raw])
        maps: dict[tuple[int, int], np.ndarray] = {}
        where = np.zeros(len(n), np.int64)
        for w in np.unique(words).tolist():
            own = np.flatnonzero(words == w)
            where[own] = np.arange(len(own))
            maps[w, w] = np.stack([np.frombuffer(raw[i], np.uint64) for i in own])
        ends = np.searchsorted(n, n * 100 // PERCENT, side="right")
        got = []
        top, partner = np.zeros(len(n)), np.full(len(n), -1)
        for i in range(len(n) - 1):
            js = np.arange(i + 1, ends[i])
            js = js[(comp[js] != comp[i]) & ((side[js] != side[i]) | (side[i] < 0)) & (key[js] == key[i])]
            if key[i] & 1:
                js = js[n[js] > boundary]
            js = js[_may_link(n[i], at[i], n[js], at[js])] if len(js) else js
            for w in np.unique(words[js]).tolist():
                same = js[words[js] == w]
                small = int(words[i])  # of the smaller set, so at most w
                if (w, small) not in maps:
                    maps[w, small] = folded(maps[w, w], small)
                common = most_common(n[i], maps[small, small][where[i]], n[same], maps[w, small][where[same]])
                ok = enough(common, n[i], n[same])
                share, same = common[ok] / (n[i] + n[same[ok]]), same[ok]
                if best and len(same):
                    better = share > top[same]
                    top[same[better]], partner[same[better]] = share[better], i
                    if share.max() > top[i]:
                        top[i], partner[i] = share.max(), same[share.argmax()]
                elif len(same):
                    got.append((np.minimum(node[i], node[same]), np.maximum(node[i], node[same])))
        if len(i := np.flatnonzero(partner >= 0)):
            got.append((np.minimum(node[i], node[partner[i]]), np.maximum(node[i], node[partner[i]])))
        return got

    def fn(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, held = None, [[] for _ in range(7)]
        for b in (b for b in batches if b.num_rows):
            cols = [c.to_pylist() for c in b.columns]
            ends = [*(k for k in range(1, b.num_rows) if cols[0][k] != cols[0][k - 1]), b.num_rows]
            start = 0
            for e in ends:
                if cols[0][start : start + 1] != [current]:
                    yield from made(of_unit(held))
                    current, held = cols[0][start], [[] for _ in range(7)]
                for own, c in zip(held, cols[1:], strict=True):
                    own += c[start:e]
                start = e
        yield from made(of_unit(held))

    def made(got: list[tuple]) -> Iterator[pa.RecordBatch]:
        if got:
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(x)) for x in zip(*got, strict=True)], ["a", "b"])

    ordered = units.withColumn("side", F.coalesce("side", F.lit(-1))).repartition("unit").sortWithinPartitions("unit", "n", "node")
    return in_arrow(ordered.select("unit", "side", "key", "n", "node", "at", "comp", "few"), fn, "a long, b long").distinct()


def _verified(pairs: DataFrame, members: DataFrame, docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """The pairs (a, b) whose whole sets link; only the sets of nodes in these pairs are made and sent."""
    key = lambda i, th: F.xxhash64(i, th)
    nodes = pairs.select(F.explode(F.array("a", "b")).alias("node")).distinct()
    one = members.join(_if_small(cut(nodes, "pair-nodes"), BROADCAST_ROWS), "node", "left_semi").groupBy("node").agg(F.min(key(F.col("id"), F.col("th"))).alias("key"))
    keys = cut(one.select("key"), "pair-rows")
    held = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).withColumn("key", key(F.col("id"), F.xxhash64("text"))).join(_if_small(keys, BROADCAST_ROWS), "key", "left_semi").select("text")

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        sets = [shingles(t) for t in dict.fromkeys(byte_texts(b.column(0)))]
        ids = [xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) for s in sets]
        return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array([s.view(np.int64) for s in sets], pa.list_(pa.int64()))], ["node", "s"])

    sets = mapped(held, fn, "node long, s array<long>").dropDuplicates(["node"])
    both = pairs.select("a", "b").join(sets.withColumnsRenamed({"node": "a", "s": "sa"}), "a").join(sets.withColumnsRenamed({"node": "b", "s": "sb"}), "b")
    x = F.size(F.array_intersect("sa", "sb"))
    return cut(both.where(100 * x >= PERCENT * (F.size("sa") + F.size("sb") - x)).select("a", "b"), "links")


def components(links: DataFrame, local: int = LOCAL_LINKS) -> DataFrame:
    """(node, comp): the least node reachable, for every node with a link; by union and find in one task for at most
    `local` links, which are counted, else by alternating stars."""
    if links.count() <= local:
        return cut(in_arrow(links.select("a", "b").coalesce(1), _united, "node long, comp long"), "components")
    edges = cut(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), "edges")
    state = None
    while True:
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        edges = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v")
        least = edges.groupBy("u").agg(F.min("v").alias("m"))
        small = edges.join(least, "u")
        edges = cut(small.select(F.explode(F.array(F.struct(F.col("v").alias("u"), F.col("m").alias("v")), F.struct("u", F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct(), "edges")
        now = edges.agg(F.count("*").alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("x")).first()
        if now == state:
            break
        state = now
    roots = edges.select(F.col("v").alias("node")).distinct().withColumn("comp", F.col("node"))
    return edges.select(F.col("u").alias("node"), F.col("v").alias("comp")).unionByName(roots)


def _united(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    root: dict[int, int] = {}

    def find(x: int) -> int:
        while (up := root.setdefault(x, x)) != x:
            root[x] = x = root.setdefault(up, up)
        return x

    for b in batches:
        for x, y in zip(*(c.to_pylist() for c in b.columns), strict=True):
            x, y = find(x), find(y)
            root[max(x, y)] = min(x, y)
    yield pa.RecordBatch.from_arrays([pa.array([*root], pa.int64()), pa.array([*map(find, [*root])], pa.int64())], ["node", "comp"])


def linked(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, th (hash of the text), n (size of the set), component_id; the last three have a _ more
    at the end where the id's name is the same."""
    return _placed(docs, id_col, text_col).select(F.col("id").alias(id_col), *(F.col(c).alias(fresh(c, [id_col])) for c in ("th", "n", "component_id")))


def _placed(docs: DataFrame, id_col: str, text_col: str, local: int = LOCAL_LINKS, block: int = BLOCK) -> DataFrame:
    """id, th, n, component_id, and comp: the component's own number, null for a row without words."""
    frequent, boundary = _survey(docs, text_col)
    described = cut(_described(docs, id_col, text_col, frequent, boundary), "described")
    entries = described.where(F.col("keys").isNotNull()).select("node", F.col("n"), F.explode(F.arrays_zip("keys", "at")).alias("x"))
    found = cut(_scanned(entries.select(F.col("x.keys").alias("key"), "n", "node", F.col("x.at").alias("at")), boundary), "candidates")
    members = cut(described.select("id", "th", "node", "n"), "members")
    meeting = cut(found.select(F.explode(F.array("a", "b")).alias("node")).where("node is not null").distinct(), "meeting-nodes")
    sketches = described.where(F.col("bits").isNotNull()).select("node", "n", "bits", "few").join(_if_small(meeting, BROADCAST_ROWS), "node", "left_semi")
    sketches = cut(sketches.dropDuplicates(["node"]), "sketches")
    drop(described)
    long = found.where("b is null")
    pairs = cut(_possible(found.where("b is not null").groupBy("a", "b").agg(F.count("*").alias("c")), sketches), "pairs")

    # first each node with the partner that it shares most meeting places with, then what is still between components
    best = cut(pairs.groupBy("b").agg(F.max_by("a", F.struct("c", "a")).alias("a")).select("a", "b"), "best-pairs")
    links = _verified(best, members, docs, id_col, text_col)
    comps = components(links, local)
    more = cut(_between(pairs.select("a", "b").join(best, ["a", "b"], "left_anti"), comps), "pairs-between")
    if not more.isEmpty() and not (new := _verified(more, members, docs, id_col, text_col)).isEmpty():
        links = links.unionByName(new)
        comps = components(links, local)
    checked, best = pairs, not long.isEmpty()
    for best in [True, False] if best else []:
        more = _across(long, comps, sketches, boundary, block, best).join(checked, ["a", "b"], "left_anti").withColumn("c", F.lit(1).cast("long"))
        more = cut(_possible(more, sketches), "pairs-across")
        if not more.isEmpty() and not (new := _verified(more, members, docs, id_col, text_col)).isEmpty():
            links, checked = links.unionByName(new), checked.unionByName(more)
            comps = components(links, local)
    drop(found, pairs, sketches, meeting)
    classes = members.where("node is not null").groupBy("node").agg(F.min("id").alias("low"))
    placed = classes.join(comps, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    lows = placed.groupBy("comp").agg(F.min("low").alias("component_id"))
    of_node = placed.join(lows, "comp").select("node", "comp", "component_id")
    out = members.join(of_node, "node", "left")
    return out.select("id", "th", "n", "comp", F.when(F.col("node").isNull(), F.col("id")).otherwise(F.col("component_id")).alias("component_id"))


def _if_small(df: DataFrame, rows: int) -> DataFrame:
    """Broadcast only what was counted to be small; beyond that the join is shuffled."""
    return F.broadcast(df) if df.count() <= rows else df


def _between(pairs: DataFrame, comps: DataFrame) -> DataFrame:
    small = _if_small(comps, BROADCAST_ROWS)
    of = lambda c: small.select(F.col("node").alias(c), F.col("comp").alias(f"c{c}"))
    out = pairs.join(of("a"), "a", "left").join(of("b"), "b", "left")
    return out.where(F.coalesce("ca", "a") != F.coalesce("cb", "b")).select("a", "b")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows with all columns; of each component only one row stays, that with the least (id, hash of the text).

    Null ids come last. Rows without words are in no component, and stay, repeated ones too. Texts aren't shuffled
    while the keys of rows that go are few enough to be broadcast (they are counted).
    """
    found = _placed(docs, id_col, text_col).where("comp is not null")
    key = lambda i, th: F.xxhash64(i.isNull(), F.coalesce(i.cast("string"), F.lit("")), th)
    same = cut(found.groupBy("comp", "id", "th").agg(F.count("*").alias("rows")).select("comp", "rows", key(F.col("id"), F.col("th")).alias("key"), F.struct(F.col("id").isNull().alias("none"), "id", "th").alias("at")), "class-rows")
    several = cut(same.groupBy("comp").agg(F.min_by("key", "at").alias("lead"), F.count("*").alias("n")).where("n > 1").drop("n"), "several")
    gone = cut(same.join(_if_small(several, BROADCAST_ROWS), "comp").where("key <> lead").select("key"), "rows-to-drop")
    again = cut(same.where("rows > 1").join(gone, "key", "left_anti").select("key"), "rows-to-merge")
    name = fresh("key", docs.columns)
    keyed = docs.withColumn(name, key(F.col(id_col), F.xxhash64(F.col(text_col))))
    rows = keyed.join(_if_small(gone.withColumnRenamed("key", name), BROADCAST_ROWS), name, "left_anti")
    if not again.isEmpty():
        again = _if_small(again.withColumnRenamed("key", name), BROADCAST_ROWS)
        rows = rows.join(again, name, "left_anti").unionByName(rows.join(again, name, "left_semi").dropDuplicates([name]))
    return rows.select(*docs.columns)


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linked(table(spark, sf_dir, "documents")).select("doc_id", F.col("n").alias("n_shingles"), "component_id")


OP4_SQL = r"""
WITH RECURSIVE d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS g FROM (SELECT r, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS a, b.r AS b, count(*) AS c FROM s a JOIN s b ON a.g = b.g AND a.r <> b.r GROUP BY a.r, b.r),
e AS (SELECT a, b FROM p JOIN n x ON x.r = a JOIN n y ON y.r = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
reach AS (SELECT r AS a, r AS b FROM d UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
m AS (SELECT reach.a AS r, min(d.doc_id) AS component_id FROM reach JOIN d ON d.r = reach.b GROUP BY reach.a)
SELECT doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, component_id FROM d JOIN m USING (r) LEFT JOIN n USING (r)
"""
