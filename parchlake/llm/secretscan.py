"""Secret scans with a guess-cost model for values in a credential context (operator 8).

Base spans are regular: `assign`, `access` and `hex`. The method adds spans of the kind `guess`: a value that
follows a credential word more loosely (`login: x`, `pwd x`, `pass is x`, with any white space) is a secret if its cheapest
segmentation into words, dates, times, repeats, keyboard walks and brute-force spans needs at least ``MIN_BITS`` bits
of guesses. That minimum is found by dynamic programming over the value's positions.

Words are the passwords that guessers try first and then all pieces of a public vocabulary of many languages that
consist of letters, ranked by its order; words that it lacks are composed of its pieces. So documents don't decide
what is a word, and a secret that is copied often stays one. Of a URL only the costliest part counts, as the others
are no secrets. Rare words (`hexadecimal`) and several words in a row (`correct-horse-battery`) can pass for secrets.

Cases: a null text is empty and has no spans; whole texts are scanned, and values are whole, of any length; repeated rows give repeated
results; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import functools
import hashlib
import math
import re
from bisect import bisect_right
from operator import itemgetter

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import byte_texts, mapped, table
from .pieces import MARK, default_model, vocabulary

KINDS = ("assign", "access", "hex", "guess")
MIN_BITS = 28.0

_ASSIGN = re.compile(rb"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([a-z0-9+/_.=-]+)")
_ASSIGN_WORDS = (b"passw", b"secret", b"token", b"api_key", b"apikey")
_ACCESS = re.compile(rb"AKIA[A-Z0-9]{16,}")
_HEX = re.compile(rb"[0-9a-f]{24,}")
_CONTEXT = re.compile(rb"\b(passphrase|passcode|password|passwd|pass|pwd|secret|token|api_?key|login|credentials?|auth)\b[\"']?[\t-\r\x20]*+(?:[:=][\t-\r\x20]*+|(?<=[\t-\r\x20])(?:is|was)[\t-\r\x20]++|(?<=[\t-\r\x20]))[\"']?([^\x00-\x20\"'<>,;]{6,}+)")
_CONTEXT_WORDS = (b"pass", b"pwd", b"secret", b"token", b"api_key", b"apikey", b"login", b"credential", b"auth")

#: Words that guessers try first, in the order of trial.
COMMON_WORDS = "password admin welcome letmein dragon monkey master login secret token access qwerty shadow summer winter spring autumn hello love test guest root user default changeme example sample public private server".split()
#: Rows of a keyboard, and the same with the shift key. Keys of neighbouring rows touch in the same place and one to the left.
KEY_ROWS = ("1234567890", "qwertyuiop", "asdfghjkl", "zxcvbnm")
SHIFTED = "!@#$%^&*()"
#: Characters of the longest unit whose repeat is seen.
UNIT = 64
_DATE = re.compile(r"(?:19|20)\d\d(?:[-/.]?(?:0[1-9]|1[0-2])(?:[-/.]?(?:0[1-9]|[12]\d|3[01]))?)?")
_TIME = re.compile(r"(?:[01]?\d|2[0-3]):[0-5]\d(?::[0-5]\d)?")
_URL = re.compile(r"(?:[a-z][a-z0-9+.-]*://|www\.)", re.I)
#: What joins words within a value.
JOINTS = "-_/.:+&="
_KEY_AT = {c: (r, k) for r, row in enumerate(KEY_ROWS) for k, c in enumerate(row)} | {c: (0, k) for k, c in enumerate(SHIFTED)}


def _step(a: str, b: str) -> tuple[int, int] | None:
    """The way from a key to one that touches it, as (rows, places)."""
    if a not in _KEY_AT or b not in _KEY_AT:
        return None
    step = _KEY_AT[b][0] - _KEY_AT[a][0], _KEY_AT[b][1] - _KEY_AT[a][1]
    return step if step in ((0, 1), (0, -1), (1, 0), (1, -1), (-1, 0), (-1, 1)) else None


@functools.cache
def word_ranks() -> tuple[dict[str, int], int]:
    """(rank by word, length of the longest word); ranks start at 1."""
    rank = {w: i for i, w in enumerate(COMMON_WORDS, 1)}
    for piece in vocabulary(open(default_model(), "rb").read()).pieces:
        w = piece.lstrip(MARK).lower()
        if len(w) >= 2 and w.isalpha():
            rank.setdefault(w, len(rank) + 1)
    return rank, max(map(len, rank))


def _brute_bits(c: str) -> float:
    if c in JOINTS:
        return math.log2(len(JOINTS))
    return math.log2(10 if c.isdigit() else 26 if c.isalpha() and c == c.lower() else 52 if c.isalpha() else 33)


def guess_bits(value: str, enough: float = math.inf, words: tuple[dict[str, int], int] | None = None) -> float:
    """log2 of the guesses for the cheapest segmentation of the value.

    A segment costs: a word its rank (and a bit for capitals); a date or time the number of these; a run of one
    character its alphabet and its length; a repeat of what stands just before it (``UNIT`` characters at most) one bit;
    a keyboard walk over touching keys its start, its length and two bits for each turn; any other character its
    alphabet. Each further segment costs one bit more. Every segment is looked at from its end, so the work is linear in the
    value's length for words, dates and walks of bounded length. It stops where no way to go on costs less than
    `enough`, and gives a cost of at least that.
    """
    rank, longest = words or word_ranks()
    reach = max(longest, 12, UNIT)
    low, n = value.lower(), len(value)
    best = [0.0] + [math.inf] * n
    above = 0  # positions up to here, without a break, that cost enough
    run = walk = turns = 0  # lengths of the run of one character and of the keyboard walk that end here, and its turns
    way = None
    for i in range(1, n + 1):
        c = low[i - 1]
        run = run + 1 if i > 1 and value[i - 1] == value[i - 2] else 1
        before, way = way, _step(low[i - 2], c) if i > 1 else None
        walk, turns = (walk + 1, turns + (before not in (None, way))) if way else (1, 0)
        found = [(best[i - 1], _brute_bits(value[i - 1]), False)]
        for k in range(2, min(i, reach) + 1):
            w = low[i - k : i]
            if w in rank:
                found.append((best[i - k], math.log2(rank[w]) + (value[i - k : i] != w), i > k))
            if k in (4, 5, 7, 8) and _TIME.fullmatch(w):
                found.append((best[i - k], math.log2(86400 if k > 5 else 1440), i > k))
            if k in (4, 6, 7, 8, 10) and _DATE.fullmatch(w):
                found.append((best[i - k], math.log2(200 * (12 if k > 4 else 1) * (31 if k > 7 else 1)), i > k))
        if run >= 3:
            found.append((best[i - run], _brute_bits(value[i - 1]) + math.log2(run), i > run))
        for unit in range(2, min(UNIT, i // 2) + 1):
            if value[i - 1] == value[i - 1 - unit] and value[i - unit : i] == value[i - 2 * unit : i - unit]:
                found.append((best[i - unit], 1.0, False))
        if walk >= 3:
            found.append((best[i - walk], math.log2(47) + math.log2(walk) + 2 * turns, i > walk))
        best[i] = min(b + s + more for b, s, more in found)
        above = above + 1 if best[i] >= enough else 0
        if above > reach and best[i - run] >= enough and best[i - walk] >= enough:  # all that segments can begin at
            return best[i]
    return best[n]


def is_secret(value: str, words: tuple[dict[str, int], int] | None = None) -> bool:
    """Whether a value, or any part of a URL, needs enough guesses."""
    parts = [value]
    if m := _URL.match(value):
        host, *rest = re.split(r"[/?&=#]+", value[m.end() :])
        parts = re.split(r"[.:@]", host) + rest
    return any(guess_bits(x, MIN_BITS, words) >= MIN_BITS for x in parts)


def scan(raw: bytes | None, words: tuple[dict[str, int], int] | None = None) -> list[tuple[int, int, str]]:
    """All spans (start, end, kind) in code points, ordered by start and then by kind as listed in KINDS."""
    if not raw:
        return []
    low = raw.lower()  # A-Z alone, so offsets stay
    found: list[tuple[int, int, int]] = []
    if any(w in low for w in _ASSIGN_WORDS):
        found += [(*m.span(), 0) for m in _ASSIGN.finditer(low) if m.end(2) - m.start(2) >= 6]
    if b"AKIA" in raw:
        found += [(*m.span(), 1) for m in _ACCESS.finditer(raw)]
    found += [(*m.span(), 2) for m in _HEX.finditer(raw)]
    if any(w in low for w in _CONTEXT_WORDS):
        taken = [(s, e) for s, e, k in found if k == 0]  # in order, and apart from each other
        at = 0
        while m := _CONTEXT.search(low, at):
            span = raw[slice(*m.span(2))].rstrip(b".!?)")  # ends before an ASCII byte, so never inside a character
            i = bisect_right(taken, m.start(), key=itemgetter(1))  # the first that ends behind the match's start
            at = m.start(2)  # what is no secret may be the word before one (`login token x`)
            if len(span) >= 6 and not (i < len(taken) and taken[i][0] < m.end()) and is_secret(span.decode("utf-8", "replace"), words):
                found.append((m.start(2), m.start(2) + len(span), 3))
                at = m.end(2)
    found.sort(key=lambda x: (x[0], x[2], x[1]))
    if raw.isascii():
        return [(s, e, KINDS[k]) for s, e, k in found]
    chars = {0: 0}
    at = n = 0
    for p in sorted({p for s, e, _ in found for p in (s, e)}):
        n += len(raw[at:p].decode("utf-8", "replace"))
        at = p
        chars[p] = n
    return [(chars[s], chars[e], KINDS[k]) for s, e, k in found]


def find_secrets(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: its id and `spans`, an array of structs (kind, start, end)."""
    kind = dict(df.dtypes)[id_col]
    words = df.sparkSession.sparkContext.broadcast(word_ranks())
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        out = [[{"kind": k, "start": s, "end": e} for s, e, k in scan(t, words.value)] for t in byte_texts(b.column(1))]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(out, spans)], ["id", "spans"])

    out = mapped(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fn, f"id {kind}, spans array<struct<kind:string,start:long,end:long>>")
    return out.withColumnRenamed("id", id_col)


def redacted(text: str, spans: list[tuple[int, int, str]], mask: str = "[SECRET]") -> str:
    """The text with each maximal run of overlapping spans replaced by the mask."""
    out, at = [], 0
    for s, e, _ in sorted(spans):
        if s >= at:
            out += [text[at:s], mask]
        at = max(at, e)
    return "".join([*out, text[at:]])


def redact(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The same rows and columns; secrets in the text are masked."""
    at = df.columns.index(text_col)
    words = df.sparkSession.sparkContext.broadcast(word_ranks())

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        texts = []
        for t in byte_texts(b.column(at)):
            spans = scan(t, words.value)
            texts.append(t if not spans else redacted(t.decode("utf-8", "replace"), spans).encode())
        column = pa.array(texts, pa.binary()).cast(pa.string())
        return b.set_column(at, b.schema.field(at).with_type(pa.string()), column)

    return mapped(df, fn, df.schema)


def op8_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = find_secrets(table(spark, sf_dir, "documents"))
    written = lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))
    count = lambda k: F.size(F.filter("spans", lambda s: s["kind"] == k)).cast("long").alias(f"n_{k}")
    return found.select(
        "doc_id", count("assign"), count("access"), count("hex"),
        F.sha2(F.array_join(F.transform(F.filter("spans", lambda s: s["kind"] != "guess"), written), ","), 256).alias("base_sha256"),
        F.array_join(F.transform("spans", written), ",").alias("spans"),
    )
