"""Token counts: greedy longest-match word-piece lengths in linear time.

The vocabulary is a trie over bytes. Each node has a failure link and the
number of tokens that taking the link completes: walking off a node replays
the greedy longest match of what was read, from tables made once, so counting
reads each byte once and never builds the pieces. A word is counted as a space
followed by its bytes, so pieces with a leading space begin words and the
others continue them.

A byte that no token can cover closes what is open and counts as one token.
"""

from __future__ import annotations

import base64
from collections import deque
from collections.abc import Iterable, Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..session import ship

#: The file to use where none is named.
DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
MEMO = 200_000


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a file with lines of base64 token and rank."""
    with open(path, "rb") as f:
        return [base64.b64decode(line.split()[0]) for line in f if line.strip()]


class Automaton:
    """Trie with failure links and popped-token counts.

    For a node v spelling s: ``fail[v]`` is the node spelling what is left of
    s after greedy longest matches are taken from its front until the rest is
    a path of the trie again; ``popped[v]`` is how many were taken. A node
    from which no match can be taken has fail -1.
    """

    def __init__(self, vocabulary: Iterable[bytes]):
        self.next: list[dict[int, int]] = [{}]
        self.fail, self.popped = [-1], [0]
        token, last = [False], [(0, 0)]
        for word in vocabulary:
            v = 0
            for b in word:
                w = self.next[v].get(b)
                if w is None:
                    w = len(self.next)
                    self.next[v][b] = w
                    self.next.append({})
                    token.append(False)
                    last.append((v, b))
                    self.fail.append(-1)
                    self.popped.append(0)
                v = w
            token[v] = v > 0
        queue = deque([0])
        while queue:
            v = queue.popleft()
            queue.extend(self.next[v].values())
            if v == 0:
                continue
            if token[v]:
                self.fail[v], self.popped[v] = 0, 1
                continue
            parent, b = last[v]
            z, n = self.fail[parent], self.popped[parent]
            while z != -1 and b not in self.next[z]:
                n += self.popped[z]
                z = self.fail[z]
            if z != -1:
                self.fail[v], self.popped[v] = self.next[z][b], n

    def count(self, word: bytes) -> int:
        """Number of greedy longest-match pieces of ``word``."""
        step, fail, popped = self.next, self.fail, self.popped
        v = n = 0
        for at, b in enumerate(word):
            while b not in step[v]:
                if v == 0:
                    n += 1  # a byte no token begins with
                    break
                if fail[v] == -1:
                    return n + self._slow(word, at - self._depth(v))
                n += popped[v]
                v = fail[v]
            else:
                v = step[v][b]
        while v:
            if fail[v] == -1:
                return n + self._slow(word, len(word) - self._depth(v))
            n += popped[v]
            v = fail[v]
        return n

    def _depth(self, v: int) -> int:
        if not hasattr(self, "depth"):
            self.depth = [0] * len(self.next)
            queue = deque([0])
            while queue:
                x = queue.popleft()
                for y in self.next[x].values():
                    self.depth[y] = self.depth[x] + 1
                    queue.append(y)
        return self.depth[v]

    def _slow(self, word: bytes, at: int) -> int:
        """From ``at``, where the trie has a path but no token begins it: only for vocabularies without single bytes."""
        n = 0
        while at < len(word):
            v, k, best = 0, at, 0
            while k < len(word) and word[k] in self.next[v]:
                v, k = self.next[v][word[k]], k + 1
                if self.fail[v] == 0 and self.popped[v] == 1:
                    best = k - at
            n, at = n + 1, at + max(best, 1)
        return n


@lru_cache(maxsize=1)
def load(path: str) -> Automaton:
    return Automaton(read_ranks(path))




class Counter(dict):
    """Pieces of a word, remembered up to a bound."""

    def __init__(self, automaton: Automaton):
        super().__init__()
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        if len(word) <= 64:
            if len(self) >= MEMO:
                self.clear()
            self[word] = n
        return n

    def text(self, text: bytes | None) -> tuple[int, int]:
        """(words, tokens) of a text; none in null."""
        words = text.split() if text else []
        return len(words), sum(map(self.__getitem__, words))


def _run(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = Counter(shared.value)
        for batch in batches:
            pairs = [counter.text(t.as_py()) for t in batch.column(1).cast(pa.binary())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([p[0] for p in pairs], pa.int64()), pa.array([p[1] for p in pairs], pa.int64())], names=["id", "n_words", "n_tokens"])

    return run


def count_tokens(docs: DataFrame, *, vocabulary: str = DEFAULT_VOCABULARY, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(``id_col``, n_words, n_tokens) for every row of ``docs``, of any id type.

    Words are runs of anything but ASCII white space. Null and empty texts
    have no words and no tokens; repeated rows each get a row, an empty table
    gives none, texts are read whole, and other columns are not read. The driver
    reads the vocabulary file once (its automaton, bounded by the file, is
    broadcast), so executors need no copy.
    """
    spark = docs.sparkSession
    ship(spark)
    shared = spark.sparkContext.broadcast(load(vocabulary))
    kind = docs.schema[id_col].dataType.simpleString()
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    return rows.mapInArrow(_run(shared), f"id {kind}, n_words long, n_tokens long").withColumnRenamed("id", id_col)
