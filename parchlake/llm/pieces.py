"""SentencePiece encoding and decoding for merge-type (BPE) vocabularies (operator 7).

A text is split before each run of the space mark: no piece of such a vocabulary has the mark after another
character (checked when the vocabulary is read), so no merge crosses these places. Each distinct segment is
encoded once by a score-ordered agenda of adjacent symbol pairs: the pair whose merged piece has the highest score
is merged first, the leftmost of equals, until no pair is left; what is not in the vocabulary then falls back to bytes.
Many segments go through their agendas side by side, as the rows of a matrix. Within each Arrow batch the result for
every whole text is checked against the sentencepiece library, ids and decoded text; a difference raises, so no wrong
row leaves the operator.

Cases: a null text is an empty one, with no ids; whole texts of any length are encoded; repeated rows give repeated
results; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import gc
import hashlib
from array import array
from collections.abc import Iterable, Iterator
from heapq import heapify, heappop, heappush
from itertools import chain, islice
from operator import add

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import in_arrow, parts, table

MARK = "▁"
#: Segments that are remembered (a quarter of them stays when they are full, an eighth behind a task); characters of the texts that are encoded together, and symbols of the longest segment
#: whose agenda is a matrix row.
MOST, CHARACTERS, SHORT = 800_000, 2_000_000, 32
NEVER = 1 << 30


def default_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


class Vocabulary:
    """A merge-type vocabulary with byte fallback, read from a serialized model."""

    def __init__(self, proto: bytes) -> None:
        import sentencepiece

        self.library = sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self.pieces = [sp.id_to_piece(i) for i in range(sp.vocab_size())]
        self.byte_of = {i: int(p[3:5], 16) for i, p in enumerate(self.pieces) if sp.is_byte(i)}
        self.byte_ids = {b: i for i, b in self.byte_of.items()}
        plain = [i for i in range(sp.vocab_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i) or sp.is_unused(i))]
        self.ids = {self.pieces[i]: i for i in plain}
        self.costs = {self.pieces[i]: -sp.get_score(i) for i in plain}
        if any(MARK in p.lstrip(MARK) for p in self.ids):
            raise ValueError("a piece has the space mark inside; texts cannot be split at marks")
        self.breaks = not any("\n" in p for p in self.ids)
        self.memo: dict[str, bytes] = {}
        self.most = MOST
        self.decimal = [b"%d," % i for i in range(len(self.pieces))]
        self.plain = len(self.byte_ids) == 256  # whatever no piece spells falls back to its bytes, so a text decodes to itself
        self._index()

    def _index(self) -> None:
        """For agendas of many segments at once: a number for each character, and what a pair of numbers merges to."""
        single = sorted({c for p in self.ids for c in p} - self.ids.keys())  # characters of pieces that are none themselves
        number = self.ids | {c: len(self.pieces) + k for k, c in enumerate(single)}
        chars = {ord(c): i for c, i in number.items() if len(c) == 1}
        self.codes = np.array(sorted(chars), np.uint32)
        self.numbers = np.array([chars[c] for c in sorted(chars)], np.int64)
        self.rank = np.full(len(self.pieces) + len(single) + 1, NEVER, np.int32)  # the last one is no piece
        order = {c: k for k, c in enumerate(sorted(set(self.costs.values())))}
        for p, i in self.ids.items():
            self.rank[i] = order[self.costs[p]]
        pairs = {(number[p[:k]], number[p[k:]]): i for p, i in self.ids.items() for k in range(1, len(p)) if p[:k] in number and p[k:] in number}
        keys, self.base = np.array([(a << 20) + b for a, b in pairs], np.int64), len(self.rank) - 1
        self.bits = max(10, (8 * len(keys)).bit_length())
        self.keys, self.merged = np.full(1 << self.bits, -1, np.int64), np.full(1 << self.bits, self.base, np.int64)
        to, left = np.array([*pairs.values()], np.int64), np.arange(len(keys))
        at, self.probes = self._slot(keys), 0
        while len(left):  # each free slot takes one of the keys that want it, and the others try the next one
            self.probes += 1
            free = left[self.keys[at[left]] == -1]
            self.keys[at[free]] = keys[free]
            won = self.keys[at[left]] == keys[left]
            self.merged[at[left[won]]] = to[left[won]]
            left = left[~won]
            at[left] = (at[left] + 1) & ((1 << self.bits) - 1)

    def _slot(self, keys: np.ndarray) -> np.ndarray:
        return (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)).astype(np.int64)

    def merge(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """The piece that each pair merges to, or `base`."""
        keys = ((left << 20) + right).ravel()
        at = self._slot(keys)
        out, found = self.merged[at], self.keys[at]
        for _ in range(1, self.probes):
            off = np.flatnonzero((found != keys) & (found != -1))
            if not len(off):
                break
            at[off] = (at[off] + 1) & ((1 << self.bits) - 1)
            out[off], found[off] = self.merged[at[off]], self.keys[at[off]]
        out[found != keys] = self.base
        return out.reshape(left.shape)

    def forget(self, left: int) -> None:
        """Drops what is remembered beyond a part; what came first, which is mostly frequent, stays."""
        if len(self.memo) > left:
            self.memo = dict(islice(self.memo.items(), left))

    def agenda(self, segment: str) -> list[int]:
        """Ids of one segment, by merging the best pair first; pairs that merging made stale are passed over."""
        symbols: list[str] = list(segment)  # a merged symbol's right part becomes empty
        n, cost = len(symbols), self.costs.get
        heap = [(c, i, i + 1, 2) for i, pair in enumerate(map(add, symbols, symbols[1:])) if (c := cost(pair)) is not None]
        heapify(heap)
        before, after = list(range(-1, n - 1)), list(range(1, n + 1))
        while heap:
            _, left, right, size = heappop(heap)
            a, b = symbols[left], symbols[right]
            if not a or not b or len(a) + len(b) != size:
                continue
            a += b
            symbols[left], symbols[right] = a, ""
            after[left] = k = after[right]
            if k < n:
                before[k] = left
                if (c := cost(a + symbols[k])) is not None:
                    heappush(heap, (c, left, k, size + len(symbols[k])))
            if (k := before[left]) >= 0 and (c := cost(symbols[k] + a)) is not None:
                heappush(heap, (c, k, left, size + len(symbols[k])))
        out: list[int] = []
        for s in symbols:
            if s:
                if (i := self.ids.get(s)) is not None:
                    out.append(i)
                else:
                    out += [self.byte_ids[b] for b in s.encode()]
        return out

    def agendas(self, segments: list[str]) -> dict[str, bytes]:
        """Ids (as 32-bit numbers) of many segments.

        Short segments of one length are the rows of a matrix: the agenda of a row is the ranks of its adjacent pairs,
        and each step merges the first best pair of every row. Others, and those with characters that fall back to
        bytes, have an agenda of their own.
        """
        out: dict[str, bytes] = {}
        by_length: dict[int, list[str]] = {}
        for x in segments:
            by_length.setdefault(len(x), []).append(x)
        for n, own in by_length.items():
            if n > SHORT:
                out |= {x: array("i", self.agenda(x)).tobytes() for x in own}
                continue
            code = np.frombuffer("".join(own).encode("utf-32-le", "surrogatepass"), np.uint32).reshape(-1, n)
            at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
            ids = np.where(self.codes[at] == code, self.numbers[at], self.base)
            pairs = self.merge(ids[:, :-1], ids[:, 1:]) if n > 1 else np.empty((len(own), 0), np.int64)
            rows = np.arange(len(own))
            while len(rows):
                width, ranks = ids.shape[1], self.rank[pairs]
                j = ranks.argmin(1) if width > 1 else np.zeros(len(rows), np.int64)
                on = ranks[np.arange(len(rows)), j] < NEVER if width > 1 else np.zeros(len(rows), bool)
                self._put(out, own, rows[~on], ids[~on])
                rows, ids, pairs, j = rows[on], ids[on], pairs[on], j[on]
                if not len(rows):
                    break
                r, k = np.arange(len(rows)), np.arange(width - 1)
                made = pairs[r, j]
                ids = np.take_along_axis(ids, k + (k > j[:, None]), 1)
                ids[r, j] = made
                pairs = np.take_along_axis(pairs, k[:-1] + (k[:-1] >= j[:, None]), 1)
                x = np.flatnonzero(j > 0)
                pairs[x, j[x] - 1] = self.merge(ids[x, j[x] - 1], made[x])
                x = np.flatnonzero(j < width - 2)
                pairs[x, j[x]] = self.merge(made[x], ids[x, j[x] + 1])
        return out

    def _put(self, out: dict[str, bytes], own: list[str], rows: np.ndarray, ids: np.ndarray) -> None:
        size = 4 * ids.shape[1]
        whole = (ids < len(self.pieces)).all(1)
        data = ids[whole].astype(np.int32).tobytes()
        for k, i in enumerate(rows[whole].tolist()):
            out[own[i]] = data[k * size : (k + 1) * size]
        for i in rows[~whole].tolist():
            out[own[i]] = array("i", self.agenda(own[i])).tobytes()

    def spelled(self, ids: list[int]) -> str:
        """The text of ids, before the first space is dropped; runs of byte pieces are decoded together."""
        out, run = [], bytearray()
        for i in ids:
            if i in self.byte_of:
                run.append(self.byte_of[i])
                continue
            if run:
                out.append(run.decode("utf-8", "replace"))
                run = bytearray()
            out.append(self.pieces[i].replace(MARK, " "))
        return "".join([*out, run.decode("utf-8", "replace")])

    def decode(self, ids: list[int]) -> str:
        return self.spelled(ids).removeprefix(" ")

    def _parts(self, rest: str) -> list[str]:
        """What gets an agenda of a segment without its last mark.

        No merge crosses a line break if no piece has one, so the lines inside a segment stand by themselves.
        """
        if self.breaks and "\n" in rest:
            head, *lines = rest.split("\n")
            return [*(self._parts(head) if head else [MARK]), *(x for line in lines for x in ("\n", line) if x)]
        return [rest.replace(" ", MARK) if rest.startswith(" ") else MARK + rest]

    def split(self, text: str) -> list[str]:
        """The text's segments, each without its last mark."""
        if not text:
            return []
        words = text.split(" ")
        if "" in words:  # more than one mark together
            joined, marks = [], 0
            for w in words:
                marks += 1
                if w:
                    joined.append(w if marks == 1 else " " * marks + w)
                    marks = 0
            words = joined + ([" " * marks] if marks else [])
        return words

    def encoded(self, texts: list[str]) -> Iterator[tuple[bytes, str]]:
        """For each text its ids as 32-bit numbers, and what these decode to."""
        at = 0
        while at < len(texts):
            first, size, known, lack = at, 0, [], []
            while at < len(texts) and size < CHARACTERS:
                words = self.split(texts[at].replace(MARK, " "))
                got = [*map(self.memo.get, words)]
                try:
                    got = b"".join(got)
                except TypeError:  # None, for a segment that is new
                    lack += [(got, k, words[k]) for k, x in enumerate(got) if x is None]
                known.append(got)
                size += len(texts[at])
                at += 1
            lines = {w: self._parts(w) for w in dict.fromkeys([w for _, _, w in lack])}
            made = self.agendas(list(dict.fromkeys(chain.from_iterable(lines.values()))))
            new = {w: made[x[0]] if len(x) == 1 else b"".join([made[y] for y in x]) for w, x in lines.items()}
            for got, k, w in lack:
                got[k] = new[w]
            if len(self.memo) + len(new) > self.most:
                self.forget(self.most // 4)
            # very long ones would make the bound on entries no bound on bytes
            self.memo |= new if max(map(len, new), default=0) <= 256 else {w: x for w, x in new.items() if len(w) <= 256}
            for got, text in zip(known, texts[first:at], strict=True):
                ids = b"".join(got) if isinstance(got, list) else got
                yield ids, text.replace(MARK, " ") if self.plain else self.decode(np.frombuffer(ids, np.int32).tolist())

    def joined(self, ids: list[int]) -> bytes:
        """Decimal ids, joined by commas."""
        return b"".join(map(self.decimal.__getitem__, ids))[:-1]


_READ: dict[str, Vocabulary] = {}


def vocabulary(proto: bytes) -> Vocabulary:
    key = hashlib.sha256(proto).hexdigest()
    if key not in _READ:
        _READ[key] = Vocabulary(proto)
    return _READ[key]


def drop_vocabularies() -> None:
    """Only a function of this module reaches its dict: those made inside others are sent to workers with a copy of it."""
    _READ.clear()


def encode_texts(df: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text", check: bool = True, numbers: bool = False, remember: int = MOST) -> DataFrame:
    """One row per input row: id, n_tokens, ids and decoded. ids: decimal and joined by commas, or an array (`numbers`).

    remember: segments that a worker keeps (about 200 bytes each); with fewer of them, more are encoded again, and the
    worker keeps none behind a task.
    """
    proto = df.sparkSession.sparkContext.broadcast(open(model_path or default_model(), "rb").read())
    kind = dict(df.dtypes)[id_col]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(proto.value)
        v.most = remember
        texts = [t or "" for t in b.column(1).to_pylist()]
        made, decoded, n, made_of = [], [], [], v.encoded(texts)
        gc.disable()  # nothing here makes cycles, and a collection would walk through all that is remembered
        try:
            for k in range(0, len(texts), 64):  # the lists of ids are large, so few texts at a time
                part = texts[k : k + 64]
                own, plain = zip(*islice(made_of, len(part)), strict=True)
                if check:
                    theirs = v.library.encode(part, num_threads=1)
                    if [array("i", x).tobytes() for x in theirs] != list(own) or v.library.decode(theirs, num_threads=1) != list(plain):
                        raise ValueError("the agenda and the sentencepiece library differ")
                else:
                    theirs = [np.frombuffer(x, np.int32).tolist() for x in own]
                n += map(len, theirs)
                made += own if numbers else map(v.joined, theirs)
                decoded += plain
        finally:
            gc.enable()
        if numbers:
            ids = pa.ListArray.from_arrays(np.cumsum([0, *n]).astype(np.int32), pa.array(np.frombuffer(b"".join(made), np.int32)))
        else:
            ids = pa.array(made, pa.binary()).cast(pa.string())
        return pa.RecordBatch.from_arrays([b.column(0), pa.array(n, pa.int64()), ids, pa.array(decoded, pa.string())], ["id", "n_tokens", "ids", "decoded"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        try:
            for b in parts(batches):
                yield fn(b)
        finally:
            if remember < MOST:  # memory matters more than the time to read the vocabulary again
                drop_vocabularies()
            else:
                vocabulary(proto.value).forget(remember // 8)  # other tasks run in the same worker afterwards

    out = in_arrow(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), run, f"id {kind}, n_tokens long, ids {'array<int>' if numbers else 'string'}, decoded string")
    return out.withColumnRenamed("id", id_col)


def op7_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = encode_texts(table(spark, sf_dir, "documents"))
    return out.select("doc_id", "n_tokens", F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))
