"""Quality rules as a short-circuit cascade (operator 9).

Each rule has a cost and a share of documents that it rejects. Both are measured where the rows are, on a random sample
of about ``SAMPLE_ROWS`` rows (a share of all, which are counted); rules then run in the order of rejections per second, and the first that rejects ends the
work on that document. The sample decides the order alone: a document is kept if and only if no rule rejects it,
so verdicts are the same for every order.

Cases: a null text is an empty one, which has no words and is rejected; repeated rows and ids are judged one by
one; an empty table gives an empty result; other columns of the input are ignored (`rule_stats`) or kept as they
are (`keep_good`).
"""

from __future__ import annotations

import time
from collections.abc import Callable
from functools import cached_property

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import SPACES, byte_texts, mapped, table

SAMPLE_ROWS = 2000
SYMBOLS = b"#*$%&|<>"
STATS = "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean"


class Doc:
    """The features of one text, each computed when a rule first asks for it."""

    def __init__(self, text: bytes | None) -> None:
        self.text = text or b""

    @cached_property
    def words(self) -> list[bytes]:
        return self.text.split()

    @cached_property
    def n_words(self) -> int:
        return len(self.words)

    @cached_property
    def word_chars(self) -> int:
        dense = self.text.translate(None, SPACES)
        return len(dense) if dense.isascii() else len(dense.decode("utf-8", "replace"))

    @cached_property
    def n_symbols(self) -> int:
        return len(self.text) - len(self.text.translate(None, SYMBOLS))

    @cached_property
    def lines(self) -> list[bytes]:
        return [x for x in self.text.split(b"\n") if x and not x.isspace()]

    @cached_property
    def n_dup_lines(self) -> int:
        return len(self.lines) - len(set(self.lines))

    @cached_property
    def n_repeat_words(self) -> int:
        n = self.n_words
        if n < 4:
            return 0
        number: dict[bytes, int] = {}
        ids = np.array([number.setdefault(w, len(number)) for w in self.words], np.int64)
        m = len(number)
        pairs = ids[:-1] * m + ids[1:]
        if m >= 2_000_000:  # three factors would not fit into 63 bits
            pairs = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        keys = pairs[:-1] * m + ids[2:]
        order = np.argsort(keys, kind="stable")
        same = keys[order[1:]] == keys[order[:-1]]
        if not same.any():
            return 0
        twice = np.zeros(n - 2, bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        hit = np.zeros(n, bool)
        for k in range(3):
            hit[k : n - 2 + k] |= twice
        return int(hit.sum())


#: A rule rejects where its function is true. The first two are the base rules.
RULES: dict[str, Callable[[Doc], bool]] = {
    "few_words": lambda d: d.n_words < 50,
    "repeated_words": lambda d: 100 * d.n_repeat_words > 50 * d.n_words,
    "symbols": lambda d: 100 * d.n_symbols > 15 * d.n_words,
    "word_length": lambda d: d.word_chars < 2 * d.n_words or d.word_chars > 15 * d.n_words,
    "repeated_lines": lambda d: 100 * d.n_dup_lines > 40 * len(d.lines),
}


def measured(df: DataFrame, text_col: str, sample_rows: int) -> list[tuple[str, float, float]]:
    """(rule, seconds a document, share rejected), on a sample; features are not shared between rules here."""

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts, out = byte_texts(b.column(0)), []
        for name, rule in RULES.items():
            began = time.perf_counter()
            bad = sum(rule(Doc(t)) for t in texts)
            out.append((name, time.perf_counter() - began, bad, len(texts)))
        return pa.RecordBatch.from_pydict(dict(zip(("rule", "s", "bad", "n"), map(list, zip(*out, strict=True)), strict=True)))

    share = min(1.0, sample_rows / max(1, df.count()))
    rows = mapped(df.select(F.col(text_col).alias("text")).sample(share, 9), fn, "rule string, s double, bad long, n long")
    return [(r["rule"], r["s"] / max(1, r["n"]), r["bad"] / max(1, r["n"])) for r in rows.groupBy("rule").agg(F.sum("s").alias("s"), F.sum("bad").alias("bad"), F.sum("n").alias("n")).collect()]


def cascade_order(df: DataFrame, text_col: str = "text", sample_rows: int = SAMPLE_ROWS) -> list[str]:
    """Rules by rejections per second, highest first; those that the sample doesn't know come last, by name."""
    got = {r: (share / max(s, 1e-9), -s) for r, s, share in measured(df, text_col, sample_rows)}
    return sorted(RULES, key=lambda r: (*(-x for x in got.get(r, (0.0, 0.0))), r))


def first_failed(doc: Doc, order: list[str]) -> str | None:
    return next((r for r in order if RULES[r](doc)), None)


def rule_stats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The id with all features and the cascade's verdict: one row per input row."""
    order = order or cascade_order(df, text_col)
    base = ("few_words", "repeated_words")
    kind = dict(df.dtypes)[id_col]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        rows = []
        for t in byte_texts(b.column(1)):
            d = Doc(t)
            failed = first_failed(d, order)
            rows.append((d.n_words, d.word_chars, d.n_symbols, d.n_dup_lines, d.n_repeat_words, any(RULES[r](d) for r in base), failed is None))
        cols = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([b.column(0), *(pa.array(c, pa.int64()) for c in cols[:5]), *(pa.array(c, pa.bool_()) for c in cols[5:])], ["id", *(x.split()[0] for x in STATS.split(", "))])

    out = mapped(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fn, f"id {kind}, {STATS}")
    return out.withColumnRenamed("id", id_col)


def keep_good(df: DataFrame, text_col: str = "text", order: list[str] | None = None) -> DataFrame:
    """The rows, with all columns, whose text no rule rejects; on rejected texts work ends at the first rejection."""
    order = order or cascade_order(df, text_col)
    at = df.columns.index(text_col)

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        return b.filter(pa.array([first_failed(Doc(t), order) is None for t in byte_texts(b.column(at))], pa.bool_()))

    return mapped(df, fn, df.schema)


def op9_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return rule_stats(table(spark, sf_dir, "documents"))


OP9_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS text FROM documents),
w AS (SELECT r, doc_id, text, regexp_extract_all(text, '[^\x20\x09-\x0D]+') AS ws, string_split(text, chr(10)) AS ls FROM d),
c AS (SELECT *, len(ws) AS n_words, list_filter(ls, lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS wl FROM w),
g AS (SELECT r, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] AS k FROM (SELECT r, ws, unnest(range(1, n_words - 1)) AS i FROM c)),
m AS (SELECT r, i FROM g QUALIFY count(*) OVER (PARTITION BY r, k) >= 2),
h AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest([i, i + 1, i + 2]) AS p FROM m) GROUP BY r),
s AS (SELECT doc_id, n_words::BIGINT AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g'))::BIGINT AS word_chars,
  (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
  (len(wl) - len(list_distinct(wl)))::BIGINT AS n_dup_lines, len(wl) AS n_lines, coalesce(h.n, 0)::BIGINT AS n_repeat_words FROM c LEFT JOIN h USING (r)),
f AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM s)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT (base_failed OR 100 * n_symbols > 15 * n_words OR word_chars < 2 * n_words OR word_chars > 15 * n_words OR 100 * n_dup_lines > 40 * n_lines) AS kept
FROM f
"""
