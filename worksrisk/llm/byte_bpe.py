"""Byte-level BPE as a monoid: encode halves, join them, decode up the same tree.

An encoding is a monoid element: two encodings of neighbouring byte strings are joined by
re-encoding a window around the seam. BPE by lowest rank has this property: a sequence of
tokens is the encoding of its bytes exactly if every two neighbouring tokens are the
encoding of their own two-token string. So once the re-encoded window ends, on both sides,
in a token that pairs with the untouched token outside, everything outside provably stays;
otherwise the window grows.

Text is cut into the matches of the pre-tokeniser's pattern, and each match is a tree of halves
down to a few bytes. Short halves and re-encoded windows recur all the time, so both are
remembered; a long run without a break costs no more than the same bytes in short matches.
Decoding concatenates up the same kind of tree: the halves of a match's tokens, then
neighbouring pieces of a text.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from worksrisk.llm.common import small_batches
from worksrisk.llm.units import REMEMBER, Remembered, kept, units

LEAF = 3             # bytes that are merged directly
WINDOW = 1           # tokens on each side of a seam that are re-encoded at first
HALF = 12            # longest halves that are remembered
RUN = 16             # pieces of a text that are joined on one level
WORDS = 600_000      # pieces and words that a Python worker remembers


class Bpe:
    """Encoder and decoder for a vocabulary of byte strings with ranks."""

    def __init__(self, ranks: dict[bytes, int], pattern: str, remember: int = REMEMBER):
        self.ranks = ranks
        self.bytes_of = {rank: token for token, rank in ranks.items()}
        self.matches = regex.compile(pattern).findall
        self.pairs: Remembered = Remembered(self._pair_fits, remember)
        self.windows: Remembered = Remembered(
            lambda seam: self.merge(self.decode(seam[0] + seam[1])), remember)
        self.halves: Remembered = Remembered(self._tree, remember)

    # ------------------------------------------------------------- the monoid
    def merge(self, data: bytes) -> tuple[int, ...]:
        """Plain BPE: join the neighbours of lowest rank, leftmost first, until none fits."""
        if not data:
            return ()
        get, none = self.ranks.get, 1 << 62
        parts = [data[i:i + 1] for i in range(len(data))]
        ranks = [get(data[i:i + 2], none) for i in range(len(data) - 1)]   # of neighbours
        while ranks and (best := min(ranks)) != none:
            i = ranks.index(best)
            parts[i] += parts.pop(i + 1)
            del ranks[i]
            if i:
                ranks[i - 1] = get(parts[i - 1] + parts[i], none)
            if i < len(ranks):
                ranks[i] = get(parts[i] + parts[i + 1], none)
        return tuple(map(self.ranks.__getitem__, parts))

    def _pair_fits(self, pair: tuple[int, int]) -> bool:
        return self.merge(self.bytes_of[pair[0]] + self.bytes_of[pair[1]]) == pair

    def join(self, left: tuple[int, ...], right: tuple[int, ...]) -> tuple[int, ...]:
        """The encoding of the joined bytes, from the encodings of both parts."""
        if not left or not right:
            return left + right
        i, j = WINDOW, WINDOW
        while True:
            window = self.windows[left[-i:], right[:j]]
            # an end that is as it was still fits the token outside
            fits_left = (i >= len(left) or window[0] == left[-i]
                         or self.pairs[left[-i - 1], window[0]])
            fits_right = (j >= len(right) or window[-1] == right[j - 1]
                          or self.pairs[window[-1], right[j]])
            if fits_left and fits_right:
                return left[:-i] + window + right[j:]
            if not fits_left:
                i *= 2
            if not fits_right:
                j *= 2

    def encode_bytes(self, data: bytes) -> tuple[int, ...]:
        """Tokens of one match: halves are encoded and joined, small pieces merged directly.

        A match that is a token is that token, as in the library.
        """
        whole = self.ranks.get(data)
        return self._tree(data) if whole is None else (whole,)

    def _tree(self, data: bytes) -> tuple[int, ...]:
        if len(data) <= LEAF:
            return self.merge(data)
        middle = len(data) // 2
        half = self.halves.__getitem__ if middle < HALF else self._tree
        return self.join(half(data[:middle]), half(data[middle:]))

    def decode(self, ids: tuple[int, ...]) -> bytes:
        """Bytes of both halves, one after the other."""
        n, bytes_of = len(ids), self.bytes_of
        if n == 2:
            return bytes_of[ids[0]] + bytes_of[ids[1]]
        if n < 2:
            return bytes_of[ids[0]] if ids else b""
        return self.decode(ids[:n // 2]) + self.decode(ids[n // 2:])

    # ------------------------------------------------------------------ texts
    def encode_unit(self, text: str) -> tuple[int, ...]:
        return tuple(i for word in self.matches(text) for i in self.encode_bytes(word.encode()))


def up(parts: list[bytes]) -> bytes:
    """All parts in one, runs of neighbours joined level by level."""
    while len(parts) > 1:
        parts = [b"".join(parts[i:i + RUN]) for i in range(0, len(parts), RUN)]
    return parts[0] if parts else b""


def load(path: str, pattern: str, remember: int = REMEMBER) -> Bpe:
    """Ranks from a file with one base64 token and its rank in each line."""
    with open(path, "rb") as lines:
        fields = (line.split() for line in lines)
        ranks = {base64.b64decode(f[0]): int(f[1]) for f in fields if len(f) == 2}
    return Bpe(ranks, pattern, remember)


def _known_units(path: str, pattern: str, digest: bool, remember: int) -> Remembered:
    """Number of tokens, ids (or their decimal text) and decoded bytes of each unit seen."""
    bpe = load(path, pattern, min(remember, REMEMBER))

    def of_word(word: str):
        ids = bpe.encode_bytes(word.encode())
        return len(ids), b" " + b" ".join([b"%d" % i for i in ids]) if digest else ids, bpe.decode(ids)

    words = Remembered(of_word, remember)

    def of_unit(unit: str):
        found = bpe.matches(unit)
        if len(found) == 1:
            return words[found[0]]
        numbers, some, pieces = zip(*map(words.__getitem__, found))
        return sum(numbers), b"".join(some) if digest else sum(some, ()), up(list(pieces))

    return Remembered(of_unit, remember)


def _each(batches: Iterator[pa.RecordBatch], *how):
    known = kept(("bpe", *how), lambda: _known_units(*how))
    get, digest = known.__getitem__, how[2]
    for batch in batches:
        counts, ids, decoded = [], [], []
        for text in batch.column("text").to_pylist():
            numbers, some, pieces = zip(*map(get, units(text))) if text else ((), (), ())
            counts.append(sum(numbers))
            data = up(list(pieces))
            if digest:
                ids.append(hashlib.sha256(b"".join(some)[1:]).hexdigest())
                decoded.append(hashlib.sha256(data).hexdigest())
            else:
                ids.append([i for s in some for i in s])
                decoded.append(data)
        yield pa.RecordBatch.from_arrays(
            [batch.column("doc_id"), pa.array(counts, pa.int64()),
             pa.array(ids, pa.string() if digest else pa.list_(pa.int32())),
             pa.array(decoded, pa.string() if digest else pa.binary())],
            names=["doc_id", "n_tokens", "_first", "_second"])


def _run(docs: DataFrame, *how) -> DataFrame:
    digest = how[2]
    kinds = "string, _second string" if digest else "array<int>, _second binary"
    small_batches(docs.sparkSession)
    rows = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(lambda it: _each(it, *how),
                           f"doc_id {kind}, n_tokens long, _first {kinds}")


def encode_documents(docs: DataFrame, path: str, pattern: str, *, remember: int = WORDS,
                     ) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` of every row: token ids and the bytes decoded from them.

    Null texts count as empty and give no ids. One output row per input row, repeated or not,
    without a shuffle; other columns are not read. ``path`` must be readable on every executor.
    Each Python worker remembers the tokens of at most ``remember`` pieces and words.
    """
    return (_run(docs, path, pattern, False, remember)
            .withColumnsRenamed({"_first": "ids", "_second": "decoded"}))


def encode_digests(docs: DataFrame, path: str, pattern: str, *, remember: int = WORDS,
                   ) -> DataFrame:
    """As :func:`encode_documents`, with SHA-256 digests in place of ids and bytes.

    ``ids_sha256`` is taken of the decimal ids joined by one space.
    """
    return (_run(docs, path, pattern, True, remember)
            .withColumnsRenamed({"_first": "ids_sha256", "_second": "decoded_sha256"}))
