"""BPE encoding and decoding by per-prefix dynamic programming.

For every prefix of a pre-token exactly one token can be the last of its encoding. An automaton over the vocabulary
gives the tokens that end at each place; a token is the last one of the prefix if the prefix before it ends in a token
that is compatible with it: merging the bytes of both again yields just these two. The back-pointers, followed from the
end, are the exact ids. No merge queue is run, and a pre-token of any length costs time in proportion to it.

Pre-tokens recur, so each worker keeps their ids in a table of bounded size that is emptied when full; this changes no
result. There is no shuffle. The vocabulary is read on the driver (its path is a parameter) and broadcast; it is fixed in
size. Null is taken as an empty text: no ids. The special tokens of the file are matched in the raw text first, as the
library does; the text between is cut into pre-tokens by the byte-level pattern.

Edge cases: repeated rows are coded each; a null id stays null; the last token of a prefix is unique, so there are no ties; an
empty table gives no rows; other columns, whatever their names, are not read.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from provena.llm.common import importable, released, table

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Pre-tokens and token pairs that a worker remembers.
REMEMBERED = 200_000
#: Rows that are coded at a time.
ROWS = 200


@lru_cache(maxsize=1)
def byte_letters() -> dict[str, int]:
    """The letters by which byte-level vocabularies write bytes: printable ones stand for themselves, others follow from U+0100."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(rest)}


def vocabulary(path: str) -> dict:
    """What encoding needs of a byte-level tokenizer file: tokens by order of their merge, their halves, and ids."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, letters = spec["model"], byte_letters()
    ids, raw = model["vocab"], lambda s: bytes(letters[c] for c in s)
    merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    order = {c: b for c, b in letters.items()}
    halves = [(b, b) for b in range(256)]
    tokens = [bytes([b]) for b in range(256)]
    out_ids = [0] * 256
    for c, b in letters.items():
        out_ids[b] = ids[c]
    for left, right in merges:
        if left + right in order:
            raise ValueError(f"two merges make {left + right!r}")
        order[left + right] = len(tokens)
        halves.append((order[left], order[right]))
        tokens.append(raw(left + right))
        out_ids.append(ids[left + right])
    special = {t["content"]: t["id"] for t in spec["added_tokens"]}
    return {"tokens": tokens, "halves": halves, "ids": out_ids, "special": special}


class Encoder(dict):
    """From a pre-token to its ids as little-endian 32-bit integers; fills itself."""

    def __init__(self, vocab: dict):
        import ahocorasick

        super().__init__()
        self.tokens, self.ids, self.special = vocab["tokens"], vocab["ids"], vocab["special"]
        self.left, self.right = [a for a, _ in vocab["halves"]], [b for _, b in vocab["halves"]]
        self.merged = {pair: t for t, pair in enumerate(vocab["halves"]) if t >= 256}
        self.find = ahocorasick.Automaton()
        for t, raw in enumerate(self.tokens):
            self.find.add_word(raw.decode("latin-1"), (len(raw), t))
        self.find.make_automaton()
        self.pairs: dict[tuple[int, int], bool] = {}
        self.packed = [i.to_bytes(4, "little") for i in self.ids]
        self.cut = regex.compile(PATTERN)
        self.marks = regex.compile("|".join(regex.escape(s) for s in sorted(self.special, key=len, reverse=True))) if self.special else None
        self.raw = {i: raw for i, raw in zip(self.ids, self.tokens, strict=True)} | {i: s.encode() for s, i in self.special.items()}

    def compatible(self, a: int, b: int) -> bool:
        """Whether the bytes of a and b, encoded together, are the tokens a and b again.

        Both are taken apart along their touching ends, the later merge first; a merge across the seam that would have
        come before the one just undone spoils the pair. Tokens are numbered in the order of merges."""
        known = self.pairs.get((a, b))
        if known is not None:
            return known
        x, y, before, left, right = a, b, 1 << 60, self.left, self.right
        while True:
            seam = self.merged.get((x, y))
            if seam is not None and seam < before:
                fits = False
                break
            if x < 256 and y < 256:
                fits = True
                break
            if x > y:
                before, x = x, right[x]
            else:
                before, y = y + 1, left[y]
        if len(self.pairs) >= 2 * REMEMBERED:
            self.pairs.clear()
        self.pairs[a, b] = fits
        return fits

    def orders(self, word: bytes) -> list[int]:
        """The tokens of a pre-token, as numbers in the order of merges."""
        last = [-1] * (len(word) + 1)
        for end, (n, t) in self.find.iter(word.decode("latin-1")):
            start = end + 1 - n
            if last[end + 1] < 0 and (start == 0 or (last[start] >= 0 and self.compatible(last[start], t))):
                last[end + 1] = t
        out, at = [], len(word)
        while at:
            out.append(last[at])
            at -= len(self.tokens[last[at]])
        return out[::-1]

    def __missing__(self, word: str) -> bytes:
        found = b"".join([self.packed[t] for t in self.orders(word.encode())])
        if len(word) <= 64:  # longer ones hardly recur
            self[word] = found
        return found

    def encode(self, text: str) -> bytes:
        if len(self) >= REMEMBERED:
            self.clear()
        if self.marks is None or not self.marks.search(text):
            return b"".join(map(self.__getitem__, self.cut.findall(text)))
        out, at = [], 0
        for m in self.marks.finditer(text):
            out += [*map(self.__getitem__, self.cut.findall(text[at : m.start()])), self.special[m[0]].to_bytes(4, "little")]
            at = m.end()
        return b"".join([*out, *map(self.__getitem__, self.cut.findall(text[at:]))])

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.raw.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", errors="replace")


_encoders: dict[str, Encoder] = {}


def encoder(key: str, vocab: dict) -> Encoder:
    """One per worker and vocabulary."""
    if key not in _encoders:
        _encoders.clear()
        _encoders[key] = Encoder(vocab)
    return _encoders[key]


def coded(docs: DataFrame, path: str, id_col: str = "doc_id", text: str = "text", digests: bool = True) -> DataFrame:
    """Per document: its id, n_tokens, and the digests of ids and decoded text, or else ids (array) and decoded (text)."""
    importable(docs.sparkSession)
    spark = docs.sparkSession
    vocab = spark.sparkContext.broadcast(vocabulary(path))
    source = docs.select(id_col, text)
    kind = source.schema[id_col].dataType.simpleString()
    tail = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import numpy as np

        bpe = encoder(path, vocab.value)
        for batch in (whole.slice(at, ROWS) for whole in batches for at in range(0, whole.num_rows, ROWS)):
            n, a, b = [], [], []
            for body in batch.column(1):
                ids = bpe.encode(body.as_py() or "")
                back = bpe.decode(ids)
                n.append(len(ids) // 4)
                a.append(hashlib.sha256(ids).hexdigest() if digests else np.frombuffer(ids, "<u4").astype("i4"))
                b.append(hashlib.sha256(back.encode()).hexdigest() if digests else back)
            made = [pa.array(n, pa.int64()), pa.array(a, pa.string() if digests else pa.list_(pa.int32())), pa.array(b, pa.string())]
            names = [id_col, "n_tokens", *(("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded"))]
            yield pa.RecordBatch.from_arrays([batch.column(0), *made], names=names)

    return source.mapInArrow(released(run), f"`{id_col}` {kind}, n_tokens long, {tail}")


def op6_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return coded(table(spark, sf_dir, "documents", "doc_id", "text"), str(public_tokenizers.path("byte_bpe_50k.json")))
