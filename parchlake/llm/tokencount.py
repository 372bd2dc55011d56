"""Token counts by dynamic programming over a trie of pre-tokens (operator 2).

Pre-tokens are the words between white space, with the space mark in front. The model is a unigram one over a
public vocabulary; its scores follow Zipf's law from the vocabulary's own order (no training): the piece of rank r
has -ln(r + 2), and a character that no piece spells costs -(ln(V) + 2) for each of its bytes, one token each. A
segmentation of the highest score counts; of equal scores, the one with fewest tokens.

Distinct pre-tokens go into a trie. The forward score of a node, the best score of any segmentation of the prefix
that it stands for, is computed once, when the node is made, from the nodes above it: words that share a prefix
share that work. A terminal node keeps the number of tokens, and a document's count is the sum over its pre-tokens.
The trie starts anew beyond ``MAX_NODES`` nodes, and words of more than ``LONG`` characters get no nodes but a window of
the scores that pieces reach back to, so memory is bounded and results don't change.

Cases: a null text is empty and has no tokens; whole texts and words of any length count; repeated rows give
repeated results; an empty table gives an empty result; columns other than the two named are ignored.
"""

from __future__ import annotations

import math
from collections import deque
from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import Remembered, byte_texts, mapped, table
from .pieces import MARK, default_model, vocabulary

MAX_NODES, LONG = 400_000, 10_000


class PieceTrie:
    def __init__(self, scores: dict[str, float], byte_score: float, max_nodes: int = MAX_NODES) -> None:
        self.scores, self.byte_score, self.max_nodes = scores, byte_score, max_nodes
        self.longest = max(map(len, scores), default=1)
        self.made = 0
        self.clear()
        self.terminals = Remembered(self.insert)

    def clear(self) -> None:
        self.child: dict[tuple[int, str], int] = {}
        self.best, self.count = [0.0], [0]

    def insert(self, word: bytes) -> int:
        """Walks or makes the word's nodes; returns the token count of its terminal node."""
        text = MARK + word.decode("utf-8", "replace")
        if len(text) > LONG:
            return self.rolled(text)
        if len(self.best) + len(text) > self.max_nodes:
            self.clear()
        path = [0]
        for i, c in enumerate(text, 1):
            node = self.child.get((path[-1], c))
            if node is None:
                top, tokens = self.forward(text, i, lambda k: (self.best[path[-k]], self.count[path[-k]]))
                node = len(self.best)
                self.child[path[-1], c] = node
                self.best.append(top)
                self.count.append(tokens)
                self.made += 1
            path.append(node)
        return self.count[path[-1]]

    def forward(self, text: str, i: int, back: Callable[[int], tuple[float, int]]) -> tuple[float, int]:
        """The best score of the first i characters, and its tokens; back(k): the same of k characters fewer."""
        top, tokens = -math.inf, 0
        for k in range(1, min(i, self.longest) + 1):
            s, n = self.scores.get(text[i - k : i]), 1
            if s is None:
                if k > 1:
                    continue
                n = len(text[i - 1].encode())
                s = n * self.byte_score
            before, more = back(k)
            s, n = s + before, n + more
            if s > top or s == top and n < tokens:
                top, tokens = s, n
        return top, tokens

    def rolled(self, text: str) -> int:
        window: deque[tuple[float, int]] = deque([(0.0, 0)], self.longest)
        for i in range(1, len(text) + 1):
            window.append(self.forward(text, i, lambda k: window[-k]))
        return window[-1][1]


def zipf_scores(v) -> tuple[dict[str, float], float]:  # noqa: ANN001
    ranked = sorted(v.ids, key=v.ids.get)
    return {p: -math.log(r + 2) for r, p in enumerate(ranked)}, -(math.log(len(ranked)) + 2)


_TRIES: dict[int, PieceTrie] = {}


def count_tokens(df: DataFrame, model_path: str | None = None, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per input row: id, n_pretokens, n_tokens."""
    proto = df.sparkSession.sparkContext.broadcast(open(model_path or default_model(), "rb").read())
    kind = dict(df.dtypes)[id_col]

    def fn(b: pa.RecordBatch) -> pa.RecordBatch:
        v = vocabulary(proto.value)
        if id(v) not in _TRIES:
            _TRIES[id(v)] = PieceTrie(*zipf_scores(v))
        trie = _TRIES[id(v)]
        words = [(t or b"").split() for t in byte_texts(b.column(1))]
        known = trie.terminals
        sums = [sum([known[w] for w in ws]) for ws in words]
        return pa.RecordBatch.from_arrays([b.column(0), pa.array([len(ws) for ws in words], pa.int64()), pa.array(sums, pa.int64())], ["id", "n_pretokens", "n_tokens"])

    out = mapped(df.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")), fn, f"id {kind}, n_pretokens long, n_tokens long")
    return out.withColumnRenamed("id", id_col)


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(table(spark, sf_dir, "documents"))
