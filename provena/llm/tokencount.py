"""Token counts by dynamic programming over a trie of pre-tokens (unigram model).

Distinct pre-tokens go into a trie. The best score of a prefix under the unigram model, and the number of tokens that
reach it, depend on the prefix alone, so they are computed once per node and shared by all pre-tokens that begin so. A
pre-token's count is stored where it ends; a document's count is the sum over its pre-tokens.

The score of a token is -ln(rank + 1): Zipf's law over the ranks of a public byte vocabulary, whose path is a parameter;
nothing is trained. All single bytes are tokens, so each text has a segmentation. Of segmentations with equal scores the
one with fewer tokens counts. The trie and the counts of a worker are bounded and start anew when full, which changes no
result: prefixes are shared up to DEPTH bytes, and what a pre-token has beyond needs the scores of the last prefixes only, as many as the
longest token has bytes. So a pre-token of any length takes a fixed amount of memory. There is no shuffle; a document is read once.

Edge cases: null counts as the empty text: no tokens; repeated rows are counted each; a null id stays null; an empty table gives no
rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import base64
import math
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from provena.llm.bpe import PATTERN
from provena.llm.common import importable, released, table

MOST_NODES = 400_000
MOST_WORDS = 400_000
#: Bytes of a pre-token that go into the trie, and characters of a text whose pre-tokens are listed at once.
DEPTH, AT_ONCE = 256, 1_000_000


def scores(path: str) -> dict[bytes, float]:
    """Tokens of a rank file (base64 and rank per line) with their scores."""
    with open(path, "rb") as f:
        pairs = [line.split() for line in f if line.strip()]
    return {base64.b64decode(a): -math.log(int(b) + 1) for a, b in pairs}


class Counter(dict):
    """From a pre-token to its number of tokens; fills itself from the trie."""

    def __init__(self, vocab: dict[bytes, float]):
        super().__init__()
        #: The vocabulary as a trie read from the last byte backwards: (node, byte) -> node, and the scores of nodes.
        self.back: dict[int, int] = {}
        self.value: list[float | None] = [None]
        for token, score in vocab.items():
            node = 0
            for b in reversed(token):
                key = node << 8 | b
                if key not in self.back:
                    self.back[key] = len(self.value)
                    self.value.append(None)
                node = self.back[key]
            self.value[node] = score
        self.longest = max(map(len, vocab), default=1)
        self.depth = max(DEPTH, self.longest)
        self.cut = regex.compile(PATTERN)
        self.clear()

    def clear(self) -> None:
        super().clear()
        self.child: dict[int, int] = {}
        self.best, self.count = [0.0], [0]

    def walk(self, word: bytes) -> int:
        """The number of tokens of a pre-token; adds what the trie lacks."""
        child, best, count, back, value = self.child, self.best, self.count, self.back, self.value
        path, node = [0], 0
        for depth, b in enumerate(word[: self.depth]):
            key = node << 8 | b
            node = child.get(key, -1)
            if node < 0:
                at, top, fewest = 0, -math.inf, 0
                for start in range(depth, -1, -1):
                    at = back.get(at << 8 | word[start], -1)
                    if at < 0:
                        break
                    if value[at] is not None:
                        before = path[start]
                        score, n = best[before] + value[at], count[before] + 1
                        if score > top or (score == top and n < fewest):
                            top, fewest = score, n
                node = child[key] = len(best)
                best.append(top)
                count.append(fewest)
            path.append(node)
        return count[node] if len(word) <= self.depth else self._beyond(word, path)

    def _beyond(self, word: bytes, path: list[int]) -> int:
        """The number of tokens of a long pre-token from the nodes of its first bytes, with the scores of its last prefixes in a ring."""
        back, value, size = self.back, self.value, self.longest + 1
        best, count = [0.0] * size, [0] * size
        for n in range(max(0, self.depth - self.longest), self.depth + 1):
            best[n % size], count[n % size] = self.best[path[n]], self.count[path[n]]
        for depth in range(self.depth, len(word)):
            at, top, fewest = 0, -math.inf, 0
            for start in range(depth, depth - self.longest, -1):
                at = back.get(at << 8 | word[start], -1)
                if at < 0:
                    break
                if value[at] is not None:
                    score, n = best[start % size] + value[at], count[start % size] + 1
                    if score > top or (score == top and n < fewest):
                        top, fewest = score, n
            best[(depth + 1) % size], count[(depth + 1) % size] = top, fewest
        return count[len(word) % size]

    def __missing__(self, word: str) -> int:
        n = self.walk(word.encode())
        if len(word) <= 64:  # longer ones hardly recur
            self[word] = n
        return n

    def of(self, text: str) -> tuple[int, int]:
        """The numbers of pre-tokens and of tokens."""
        if len(self) >= MOST_WORDS or len(self.best) >= MOST_NODES:
            self.clear()
        if len(text) <= AT_ONCE:
            words = self.cut.findall(text)
            return len(words), sum(map(self.__getitem__, words))
        n = total = 0
        for m in self.cut.finditer(text):
            n, total = n + 1, total + self[m[0]]
            if len(self) >= MOST_WORDS or len(self.best) >= MOST_NODES:
                self.clear()
        return n, total


_counters: dict[str, Counter] = {}


def counted(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: its id, n_pretokens, n_tokens."""
    importable(docs.sparkSession)
    vocab = docs.sparkSession.sparkContext.broadcast(scores(path))
    source = docs.select(id_col, text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if path not in _counters:
            _counters.clear()
            _counters[path] = Counter(vocab.value)
        counter = _counters[path]
        for batch in batches:
            pairs = [counter.of(x.as_py() or "") for x in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([a for a, _ in pairs], pa.int64()), pa.array([b for _, b in pairs], pa.int64())], names=[id_col, "n_pretokens", "n_tokens"])

    return source.mapInArrow(released(run), f"`{id_col}` {source.schema[id_col].dataType.simpleString()}, n_pretokens long, n_tokens long")


def op8_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return counted(table(spark, sf_dir, "documents", "doc_id", "text"), str(public_tokenizers.path("byte_bpe_50k.tiktoken")))
