"""Benchmark decontamination by winnowing, with DataFrame functions only (operator 3).

Words are hashed in k-grams of ``K`` = 5, and of each window of ``W`` = 4 neighbouring hashes the least is the
fingerprint. A window of 8 words spans exactly 4 k-grams, so two equal windows have equal fingerprints: every
shared span of 8 words or more is found. Fingerprints of training texts are joined with those of the benchmark,
and hits are extended to the words around them, which must be equal. Items of fewer than 8 words are one window,
whose hash of all its words is its fingerprint, and are looked up by length in a scan of their own.

The benchmark's windows are broadcast only if there are at most ``BROADCAST_ROWS`` of them (they were counted);
beyond that the join is shuffled, and each training fingerprint is sent once per run of windows that share it.
Hits and results are kept per (id, text), so equal texts do not meet in one task.

Cases: a null text has no words, no hits and is not contaminated; a null item id is not counted; repeated rows
give repeated results; empty tables give empty results or no hits; other columns of the inputs are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, fresh, table

K, W, N = 5, 4, 8
BROADCAST_ROWS = 200_000
#: The words [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ in a positive form, which Java matches over ten times as fast.
WORD = r"[a-z0-9\x{80}-\x{10FFFF}]+"
#: The same words before A-Z are lower-cased, and all else.
CASED = r"[a-zA-Z0-9\x{80}-\x{10FFFF}]"
GAP = r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def words(text: Column) -> Column:
    """lower() does for ASCII texts, and is much faster than translate()."""
    low = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))
    return F.coalesce(F.regexp_extract_all(low, F.lit(WORD), F.lit(0)), F.array().cast("array<string>"))


def _run(first: int, last: Column) -> Column:
    return F.when(last >= first, F.sequence(F.lit(first), last)).otherwise(F.array().cast("array<int>"))


def gram_hashes(w: Column, k: int) -> Column:
    return F.transform(_run(0, F.size(w) - k), lambda i: F.xxhash64(*(F.get(w, i + j) for j in range(k))))


def slice_hashes(w: Column, n: int) -> Column:
    return F.transform(_run(0, F.size(w) - n), lambda i: F.xxhash64(F.slice(w, i + 1, n)))


def window_minima(h: Column) -> Column:
    return F.transform(_run(0, F.size(h) - W), lambda i: F.least(*(F.get(h, i + j) for j in range(W))))


def spelled(w: Column, at: Column, n: int | Column) -> Column:
    return F.array_join(F.slice(w, at + 1, n), " ")


def _key(id_col: str, text_col: str) -> Column:
    return F.md5(F.concat_ws("|", F.col(id_col).cast("string"), F.md5(F.col(text_col).cast("binary"))).cast("binary"))


def benchmark_windows(bench: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Distinct (item, n, fp, win): each window's length, fingerprint and words.

    The outer forms of explode keep Catalyst from pushing a filter on the array's size through the projections
    below, which would compute all of these arrays anew for each of their elements.
    """
    b = bench.select(F.col(id_col).cast("string").alias("item"), words(F.col(text_col)).alias("w"))
    size = F.size("w")
    long = b.where(size >= N).withColumn("h", gram_hashes(F.col("w"), K)).withColumn("m", window_minima(F.col("h")))
    long = long.select("item", "w", F.posexplode_outer("m").alias("at", "fp")).select("item", F.lit(N).alias("n"), "fp", spelled(F.col("w"), F.col("at"), N).alias("win"))
    win = F.array_join("w", " ")
    short = b.where((size > 0) & (size < N)).select("item", size.alias("n"), F.xxhash64("w").alias("fp"), win.alias("win"))
    return long.unionByName(short).distinct()


def find_hits(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", broadcast_rows: int = BROADCAST_ROWS) -> tuple[DataFrame, DataFrame]:
    """(hits, windows): hits (key, at, n, fp, win) of each window at each word offset; windows (item, n, fp, win)."""
    windows = cut(benchmark_windows(bench, item_col, item_text_col), "bench-windows")
    distinct = windows.select("n", "fp", "win").distinct()
    counts = {r["n"]: r["c"] for r in distinct.groupBy("n").agg(F.count("*").alias("c")).collect()}  # at most N rows
    small = sum(counts.values()) <= broadcast_rows
    d = docs.select(_key(id_col, text_col).alias("key"), words(F.col(text_col)).alias("w"))
    parts = []
    if N in counts:
        own = distinct.where(F.col("n") == N)
        m = d.withColumn("h", gram_hashes(F.col("w"), K)).withColumn("m", window_minima(F.col("h")))
        if small:
            at = m.select("key", "w", F.posexplode_outer("m").alias("at", "fp")).join(F.broadcast(own), "fp")
            parts.append(at.where(spelled(F.col("w"), F.col("at"), N) == F.col("win")))
        else:
            # a fingerprint is sent where it first appears, with the words of the windows that can share it
            m = m.withColumn("first", F.filter(_run(0, F.size("m") - 1), lambda i: (i == 0) | (F.get("m", i) != F.get("m", i - 1))))
            ctx = m.select("key", F.explode_outer(F.transform("first", lambda i: F.struct(i.alias("at0"), F.get("m", i).alias("fp"), F.slice("w", i + 1, F.coalesce(F.get(F.filter("first", lambda j: j > i), F.lit(0)), F.size("m")) - i + N - 1).alias("ctx")))).alias("x")).select("key", "x.*")
            found = ctx.join(own, "fp").select("key", "fp", "n", "win", "at0", "ctx", F.explode(_run(0, F.size("ctx") - N)).alias("o"))
            parts.append(found.where(spelled(F.col("ctx"), F.col("o"), N) == F.col("win")).withColumn("at", F.col("at0") + F.col("o")))
    for n in sorted(set(counts) - {N}):
        own = distinct.where(F.col("n") == n)
        grams = d.withColumn("h", slice_hashes(F.col("w"), n))
        at = grams.select("key", "w", F.posexplode_outer("h").alias("at", "fp"))
        if small:
            parts.append(at.join(F.broadcast(own), "fp").where(spelled(F.col("w"), F.col("at"), n) == F.col("win")))
        else:
            at = at.select("key", "at", "fp", spelled(F.col("w"), F.col("at"), n).alias("dw"))
            parts.append(at.join(own, "fp").where(F.col("dw") == F.col("win")))
    cols = [F.col("key"), F.col("at").cast("int").alias("at"), "n", "fp", "win"]
    if not parts:
        return docs.sparkSession.createDataFrame([], "key string, at int, n int, fp long, win string"), windows
    hits = parts[0].select(*cols)
    for p in parts[1:]:
        hits = hits.unionByName(p.select(*cols))
    return cut(hits.distinct(), "bench-hits"), windows


def contamination(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", **names) -> DataFrame:  # noqa: ANN003
    """One row per (id, text) with hits: key, hit (offsets of the words in windows), items (sorted as strings)."""
    hits, windows = find_hits(docs, bench, id_col, text_col, **names)
    spans = hits.groupBy("key").agg(F.collect_set(F.struct("at", "n")).alias("s"))  # at most a few for each word of one text
    spans = spans.select("key", F.array_distinct(F.flatten(F.transform("s", lambda x: F.sequence(x["at"], x["at"] + x["n"] - 1)))).alias("hit"))
    windows = F.broadcast(windows) if windows.count() <= names.get("broadcast_rows", BROADCAST_ROWS) else windows
    pairs = hits.select("key", "n", "fp", "win").distinct().join(windows, ["n", "fp", "win"]).select("key", "item").distinct()
    items = pairs.groupBy("key").agg(F.array_sort(F.collect_list("item")).alias("items"))
    return spans.join(items, "key", "left").withColumn("items", F.coalesce("items", F.array().cast("array<string>")))


def _held(found: DataFrame, rows: int, hit: str = "hit", items: str = "items") -> DataFrame:
    """What `contamination` found as a table, broadcast if its rows and words are counted to be few."""
    found = cut(found, "contaminated")
    size = found.agg(F.count("*").alias("n"), F.sum(F.size(hit) + F.size(items)).alias("parts")).first()
    return F.broadcast(found) if size["n"] <= rows and (size["parts"] or 0) <= 20 * rows else found


def contaminated(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_items: int = 2, **names) -> DataFrame:  # noqa: ANN003
    """One row per input row: id, n_words, n_hit, n_items, items, contaminated."""
    found = _held(contamination(docs, bench, id_col, text_col, **names), names.get("broadcast_rows", BROADCAST_ROWS))
    base = docs.select(F.col(id_col), _key(id_col, text_col).alias("key"), F.coalesce(F.size(F.regexp_extract_all(F.col(text_col), F.lit(CASED + "+"), F.lit(0))), F.lit(0)).alias("n"))
    base = base.withColumn("n", F.greatest("n", F.lit(0)))
    out = base.join(found, "key", "left")
    n_items = F.coalesce(F.size("items"), F.lit(0))
    n_items = F.when(F.col("items").isNull(), 0).otherwise(n_items)
    return out.select(
        F.col(id_col), F.col("n").cast("long").alias("n_words"), F.when(F.col("hit").isNull(), 0).otherwise(F.size("hit")).cast("long").alias("n_hit"),
        n_items.cast("long").alias("n_items"), F.coalesce("items", F.array().cast("array<string>")).alias("items"), (n_items >= least_items).alias("contaminated"),
    )


def clean(docs: DataFrame, bench: DataFrame, id_col: str = "doc_id", text_col: str = "text", least_items: int = 2, **names) -> DataFrame:  # noqa: ANN003
    """Contaminated rows go; from others, words in benchmark windows are cut out, with the gap before each.

    All columns stay; rows without hits are unchanged. What was found is broadcast if its rows and words are counted to
    be few (at most ``BROADCAST_ROWS`` and twenty times as many), so that texts stay where they are; else it is shuffled.
    """
    key = fresh("key", docs.columns)
    x = fresh("found", [*docs.columns, key])
    found = contamination(docs, bench, id_col, text_col, **names).select(F.col("key").alias(key), F.struct("hit", "items").alias(x))
    found = _held(found, names.get("broadcast_rows", BROADCAST_ROWS), f"{x}.hit", f"{x}.items")
    rows = docs.withColumn(key, _key(id_col, text_col)).join(found, key, "left")
    rows = rows.where(F.col(x).isNull() | (F.size(f"{x}.items") < least_items))
    text, parts = F.col(text_col), fresh("parts", [*docs.columns, key, x])
    rows = rows.withColumn(parts, F.when(F.col(x).isNotNull(), F.regexp_extract_all(text, F.lit(f"{GAP}*{CASED}+"), F.lit(0))))
    tail = F.regexp_extract(text, f"{GAP}*$", 0)
    kept = F.array_except(F.sequence(F.lit(0), F.size(parts) - 1), f"{x}.hit")
    less = F.concat(F.array_join(F.transform(kept, lambda i: F.get(parts, i)), ""), tail)
    return rows.withColumn(text_col, F.when(F.col(x).isNull(), text).otherwise(less)).select(*docs.columns)


def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = contaminated(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_words", "n_hit", "n_items", F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated")


OP3_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bn AS (SELECT item, w, least(8, len(w)) AS n FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item, n, array_to_string(w[i:i + n - 1], ' ') AS win FROM (SELECT item, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM bn)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (SELECT r, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS win FROM d, ns WHERE len(w) >= n),
h AS (SELECT DISTINCT r, i, n, item FROM dw JOIN bw USING (n, win)),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT DISTINCT r, unnest(range(i, i + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r)
"""
