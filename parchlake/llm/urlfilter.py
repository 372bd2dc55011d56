"""URL filter: rules first, then gradient-boosted trees on lexical features (operator 10).

The host is what stands between the first `://` and the next `/`, `?`, `#` or the end, with A-Z lower-cased; the path follows up
to `?`, `#` or the end. A rule (host, path) fits its host and all subdomains if the path starts with its path; of
several the longest wins. URLs that a rule decides are the labelled ones: from the counts over all of them come
smoothed block rates by suffix and by first path segment, and a sample of about ``TRAIN_ROWS`` of them (at most twice as
many, chosen by a hash of id and URL against the share of ``TRAIN_ROWS`` in all) trains the trees. The trees judge every URL that no rule fits; without labels of both kinds the more frequent
label is given, and `allow` without any.

Cases: a null URL, or one without `://`, has an empty host and path and is judged by the trees like any other; urls
of any length count whole; repeated rows give repeated results; an empty table gives an empty result; columns other
than the two named are ignored.
"""

from __future__ import annotations

import math
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mapped, table

#: Fixed values: (host, path, verdict).
RULES = (("com", "/", "allow"), ("example.com", "/en/", "block"), ("www.example.com", "/en/", "allow"), ("net", "/es/", "block"), ("net", "/fr/", "block"))
TRAIN_ROWS = 20_000
SUFFIX_BUCKETS = 1024
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def host_path(url: Column) -> tuple[Column, Column]:
    at = F.instr(url, "://")
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))
    rest = F.coalesce(rest, F.lit(""))
    host = F.regexp_extract(rest, "^[^/?#]*", 0)
    return F.translate(host, UPPER, LOWER), F.regexp_extract(F.substr(rest, F.length(host) + 1), "^[^?#]*", 0)


def ruled(host: Column, path: Column, rules=RULES) -> Column:  # noqa: ANN001
    """A struct (rule, verdict) of the longest rule that fits, else null."""
    out = F.lit(None).cast("struct<rule:string,verdict:string>")
    for h, p, verdict in sorted(rules, key=lambda x: len(x[0] + x[1])):
        fits = ((host == h) | host.endswith("." + h)) & path.startswith(p)
        out = F.when(fits, F.struct(F.lit(h + p).alias("rule"), F.lit(verdict).alias("verdict"))).otherwise(out)
    return out


def suffix_bucket(host: str) -> int:
    return zlib.crc32(host.rsplit(".", 1)[-1].encode()) % SUFFIX_BUCKETS


def segment_bucket(path: str) -> int:
    """Of the path's first segment; these follow the suffixes' buckets."""
    return SUFFIX_BUCKETS + zlib.crc32(path.removeprefix("/").partition("/")[0].encode()) % SUFFIX_BUCKETS


def lexical(url: str, host: str, path: str, rates: dict[int, float], overall: float) -> list[float]:
    n = len(url)
    counts = Counter(url)
    entropy = -sum(c / n * math.log2(c / n) for c in counts.values()) if n else 0.0
    query = url.partition("#")[0].partition("?")[2]
    parts = [x for x in path.split("/") if x]
    return [
        n, len(path), len(parts), sum(map(url.count, "0123456789")) / max(1, n), entropy, query.count("&") + 1 if query else 0,
        host.count("."), len(host), max(map(len, parts), default=0), len(parts[0]) if parts else 0, float("." in (parts[-1] if parts else "")),
        rates.get(suffix_bucket(host), overall), rates.get(segment_bucket(path), overall),
    ]


class Trees:
    """Gradient boosting for the logistic loss with trees of fixed depth over histogram bins."""

    def __init__(self, rounds: int = 40, depth: int = 3, rate: float = 0.2, bins: int = 32) -> None:
        self.rounds, self.depth, self.rate, self.bins = rounds, depth, rate, bins
        self.base, self.trees, self.edges = 0.0, [], None

    def fit(self, x: np.ndarray, y: np.ndarray) -> Trees:
        share = (y.sum() + 0.5) / (len(y) + 1)
        self.base = math.log(share / (1 - share))
        self.edges = [np.unique(np.quantile(c, np.linspace(0, 1, self.bins + 1)[1:-1])) for c in x.T]
        if y.min(initial=1) == y.max(initial=0):
            return self
        b = self.binned(x)
        f = np.full(len(y), self.base)
        for _ in range(self.rounds):
            p = 1 / (1 + np.exp(-f))
            tree = self._grown(b, y - p, p * (1 - p))
            self.trees.append(tree)
            f += self._out(tree, b)
        return self

    def binned(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, c, side="left") for e, c in zip(self.edges, x.T, strict=True)], 1)

    def _grown(self, b: np.ndarray, g: np.ndarray, h: np.ndarray) -> tuple:
        node = np.zeros(len(g), int)
        feature, split = np.zeros(2**self.depth - 1, int), np.full(2**self.depth - 1, self.bins)
        for level in range(self.depth):
            first, width = 2**level - 1, 2**level
            best = np.full(width, 1e-6)
            for k in range(b.shape[1]):
                cell = node * (self.bins + 1) + b[:, k]
                gs, hs = (np.bincount(cell, v, width * (self.bins + 1)).reshape(width, -1).cumsum(1) for v in (g, h))
                gain = gs**2 / (hs + 1) + (gs[:, -1:] - gs) ** 2 / (hs[:, -1:] - hs + 1) - gs[:, -1:] ** 2 / (hs[:, -1:] + 1)
                at = gain.argmax(1)
                top = gain[np.arange(width), at]
                for j in np.flatnonzero(top > best):
                    best[j], feature[first + j], split[first + j] = top[j], k, at[j]
            node = 2 * node + (b[np.arange(len(g)), feature[first + node]] > split[first + node])
        leaves = np.bincount(node, g, 2**self.depth) / (np.bincount(node, h, 2**self.depth) + 1) * self.rate
        return feature, split, leaves

    def _out(self, tree: tuple, b: np.ndarray) -> np.ndarray:
        feature, split, leaves = tree
        node, rows = np.zeros(len(b), int), np.arange(len(b))
        for level in range(self.depth):
            at = 2**level - 1 + node
            node = 2 * node + (b[rows, feature[at]] > split[at])
        return leaves[node]

    def logit(self, x: np.ndarray) -> np.ndarray:
        out = np.full(len(x), self.base)
        if self.trees:
            b = self.binned(x)
            for t in self.trees:
                out += self._out(t, b)
        return out


def parsed(df: DataFrame, id_col: str, url_col: str, rules=RULES) -> DataFrame:  # noqa: ANN001
    host, path = host_path(F.col(url_col))
    out = df.select(F.col(id_col).alias("id"), F.coalesce(F.col(url_col), F.lit("")).alias("url"), host.alias("host"), path.alias("path"))
    return out.withColumn("r", ruled(F.col("host"), F.col("path"), rules)).select("id", "url", "host", "path", F.col("r.rule").alias("rule"), F.col("r.verdict").alias("verdict"))


def trained(labelled: DataFrame, train_rows: int = TRAIN_ROWS) -> tuple[dict[int, float], float, Trees]:
    """Block rates by suffix and by first path segment over all labelled rows (in 2 * SUFFIX_BUCKETS buckets), the
    overall rate, and the trees."""
    bucket = lambda c: F.pmod(F.crc32(c.cast("binary")), F.lit(SUFFIX_BUCKETS)).cast("int")
    suffix, segment = F.element_at(F.split("host", r"\."), -1), F.regexp_extract("path", "^/?([^/]*)", 1)
    counts = labelled.select(F.explode(F.array(bucket(suffix), bucket(segment) + SUFFIX_BUCKETS)).alias("k"), "verdict").groupBy("k").agg(F.count("*").alias("n"), F.sum((F.col("verdict") == "block").cast("int")).alias("bad")).collect()
    n, bad = sum(c["n"] for c in counts), sum(c["bad"] for c in counts)
    overall = bad / n if n else 0.0
    rates = {c["k"]: (c["bad"] + 10 * overall) / (c["n"] + 10) for c in counts}
    h = F.xxhash64("id", "url")
    drawn = labelled.where(F.pmod(h, F.lit(1 << 40)) < F.lit((1 << 40) * train_rows / max(1, n // 2)))  # n counts each row twice
    rows = drawn.select("url", "host", "path", "verdict", h.alias("h")).orderBy("h", "url").limit(2 * train_rows).collect()
    x = np.array([lexical(r["url"], r["host"], r["path"], rates, overall) for r in rows], float)
    y = np.array([r["verdict"] == "block" for r in rows], float)
    return rates, overall, Trees().fit(x, y) if len(rows) else Trees()


def judge(df: DataFrame, id_col: str = "page_id", url_col: str = "url", rules=RULES, train_rows: int = TRAIN_ROWS) -> DataFrame:  # noqa: ANN001
    """One row per input row: id, host, path, rule, verdict, score (the trees' block probability)."""
    rows = parsed(df, id_col, url_col, rules)
    rates, overall, trees = trained(rows.where(F.col("rule").isNotNull()), train_rows)
    if trees.edges is None:
        trees.base = -1.0
    kind = dict(df.dtypes)[id_col]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        urls, hosts, paths = (b.column(k).to_pylist() for k in (1, 2, 3))
        x = np.array([lexical(u, h, p, rates, overall) for u, h, p in zip(urls, hosts, paths, strict=True)], float)
        logit = trees.logit(x)
        verdict = [v or ("block" if z > 0 else "allow") for v, z in zip(b.column(5).to_pylist(), logit, strict=True)]
        return pa.RecordBatch.from_arrays([*(b.column(k) for k in (0, 2, 3, 4)), pa.array(verdict), pa.array(1 / (1 + np.exp(-logit)))], ["id", "host", "path", "rule", "verdict", "score"])

    return mapped(rows, fn, f"id {kind}, host string, path string, rule string, verdict string, score double").withColumnRenamed("id", id_col)


def op10_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge(table(spark, sf_dir, "pages")).select("page_id", "host", "path", "rule", "verdict")
