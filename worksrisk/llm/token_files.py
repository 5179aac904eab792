"""Token-id files: documents in ascending doc_id order, ids in Simple-8b blocks.

A file holds blocks of whole documents and ends with the blocks' offsets, so a reader can
start at any block. All numbers are little-endian.

    file    "S8TOKENS", blocks, offset of each block (u64), number of blocks (u64), "S8TOKENS"
    block   documents, ids, words, escapes (u64 each); doc_ids (i64); null flags (u8);
            ids per document (u64); words (u64); escape places (u64); escape values (u64)
"""

from __future__ import annotations

import json
import os
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from worksrisk.llm import files, simple8b
from worksrisk.llm.common import small_batches
from worksrisk.llm.units import Remembered, cuts_are_safe, kept, units
from worksrisk.session import Staging

MAGIC = b"S8TOKENS"
BLOCK_IDS = 1 << 17
PIECES, MATCHES = 1_000_000, 500_000   # that a Python worker remembers
JOINED = 20               # words that the library gets as one text
CHARACTERS = 8_000_000    # of texts that are cut and looked up at a time


# ----------------------------------------------------------------------- tokens
SIGNS, LAST_LETTER = ".,;:!?*$&%#|()", "\u052f"


def _is_word(text: str) -> bool:
    """Letters only, none of a younger script."""
    return text.isalpha() and (text.isascii() or max(text) <= LAST_LETTER)


def plain_matches(rest: str) -> list[str] | None:
    """The pre-tokeniser's matches of a space and ``rest``, or None for all but plain forms.

    Plain are lines of letters with signs after them. A run of letters is one match, together
    with the space before it; so is a run of signs, and a line break before a letter. Letters of
    younger scripts are not plain: libraries may not agree on them.
    """
    found, blank = [], " "
    for line in rest.split("\n"):
        word = line.rstrip(SIGNS)
        if not _is_word(word):
            return None
        found.append(blank + word)
        if len(word) < len(line):
            found.append(line[len(word):])
        found.append("\n")
        blank = ""
    found.pop()
    return found


class Encoder:
    """Ids of whole texts by a tokenizer file of the tokenizers library.

    For plain byte-level tokenizers a text is cut where the pre-tokeniser cuts in any case, and
    the ids of pieces seen before are remembered; equal pieces of a call are looked up once, and
    ids are dealt to the texts by numpy. Of the others, those of a plain form are cut
    into words, signs and line breaks, which recur more often than whole pieces; the library
    encodes what is then still unknown, several words in one text. Texts that hold an added token's
    string, and other kinds of tokenizers, are encoded whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"   # the cores are Spark's
        from tokenizers import Tokenizer
        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as text:
            parts = json.load(text)
        first = parts.get("pre_tokenizer") or {}
        self.plain = (first.get("type") == "ByteLevel" and not first.get("add_prefix_space")
                      and first.get("use_regex", True) and not parts.get("normalizer"))
        self.added = [t["content"] for t in parts.get("added_tokens", [])]
        self.known, self.matches = Remembered(None, PIECES), Remembered(None, MATCHES)
        vocabulary = self.tokenizer.get_vocab() if self.plain else {}
        self.bytes_of = np.zeros(max(vocabulary.values(), default=0) + 1, np.int64)
        for token, i in vocabulary.items():
            self.bytes_of[i] = len(token)   # byte-level tokens have a character for each byte

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes()
                for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _ids_of_words(self, words: list[str]) -> list[bytes]:
        """Ids of words with the space before them, or a line break after them, which are cut
        there in a longer text as well.

        No id reaches over a cut, so the lengths of words and ids in bytes tell whose they are.
        """
        joined = ["".join(words[i:i + JOINED]) for i in range(0, len(words), JOINED)]
        if any(a in text for text in joined for a in self.added):
            return self._ids(words)
        ids = np.frombuffer(b"".join(self._ids(joined)), np.uint32)
        ends = np.cumsum(self.bytes_of[ids])
        wanted = np.cumsum([len(w) if w.isascii() else len(w.encode()) for w in words])
        cuts = np.searchsorted(ends, wanted)
        if not len(ends) or ends[-1] != wanted[-1] or not np.array_equal(ends[cuts], wanted):
            return self._ids(words)
        raw, last = ids.tobytes(), (4 * (cuts + 1)).tolist()
        return [raw[lo:hi] for lo, hi in zip([0, *last], last)]

    def _cut(self, texts: list[str]) -> tuple[list[int], list[str], pa.Array, np.ndarray]:
        """Texts in an order of their own: their places, what stands before the first cut, all
        pieces after it without their space, and the number of these in each text.
        """
        easy, hard, lists = [], [], []
        for i, text in enumerate(texts):
            if not self.plain or any(a in text for a in self.added):
                hard.append(i)
                lists.append([text])
            elif cuts_are_safe(text):
                easy.append(i)
            else:
                pieces = units(text)
                hard.append(i)
                lists.append([*([""] if text.startswith(" ") else [pieces.pop(0)]),
                              *(p[1:] for p in pieces)])
        split = pc.split_pattern(pa.array([texts[i] for i in easy], pa.large_string()), " ")
        both = pa.concat_arrays([split, pa.array(lists, split.type)])
        starts, flat = both.offsets.to_numpy(), both.flatten()
        later = np.ones(len(flat), bool)
        later[starts[:-1]] = False
        return (easy + hard, flat.take(pa.array(starts[:-1])).to_pylist(),
                flat.filter(pa.array(later)), np.diff(starts) - 1)

    def _known(self, rests: list[str]) -> list[bytes]:
        """Ids of distinct pieces, given without the space before them."""
        pieces, unseen = self.known.found(rests)
        parts = []
        for rest in unseen:
            word = rest.rstrip(SIGNS)
            if not _is_word(word):
                parts.append(plain_matches(rest) or (" " + rest,))
            elif len(word) == len(rest):
                parts.append((" " + rest,))
            else:
                parts.append((" " + word, rest[len(word):]))
        matches, new = self.matches.found(set().union(*parts))
        kinds: tuple = [], [], []
        for match in new:
            spaced = match[0] == " "
            kinds[2 if not _is_word(match[spaced:]) else 0 if spaced else 1].append(match)
        for some, encode in zip(kinds, (self._ids_of_words, self._ids_of_lines, self._ids)):
            for i in range(0, len(some), 10_000):
                now = some[i:i + 10_000]
                ids = dict(zip(now, encode(now)))
                matches |= ids
                self.matches.keep_all(ids)
        of_match = matches.__getitem__
        fresh = {rest: of_match(part[0]) if len(part) == 1 else b"".join(map(of_match, part))
                 for rest, part in zip(unseen, parts)}
        self.known.keep_all(fresh)
        pieces |= fresh
        return [pieces[rest] for rest in rests]

    def _ids_of_lines(self, words: list[str]) -> list[bytes]:
        """Ids of words without a space before them: a line break after each is an id of its own."""
        return [found[:-4] for found in self._ids_of_words([word + "\n" for word in words])]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text; texts of some million characters are worked on at a time."""
        found, run, held = [], [], 0
        for text in texts:
            run.append(text)
            held += len(text)
            if held >= CHARACTERS:
                found += self._encode(run)
                run, held = [], 0
        return found + self._encode(run) if run else found

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        order, firsts, rests, counts = self._cut(texts)
        coded = rests.dictionary_encode()
        known = self._known(coded.dictionary.to_numpy(zero_copy_only=False).tolist())
        sizes = np.fromiter(map(len, known), np.int64, len(known)) // 4
        ids, which = np.frombuffer(b"".join(known), np.uint32), coded.indices.to_numpy()
        taken = sizes[which]
        ends = np.concatenate([[0], np.cumsum(taken)])
        shift = (np.cumsum(sizes) - sizes)[which] - ends[:-1]
        dealt = ids[np.repeat(shift, taken) + np.arange(ends[-1])]
        heads = self._ids(firsts)
        upto = ends[np.concatenate([[0], np.cumsum(counts)])].tolist()
        out: list = [None] * len(texts)
        for place, head, lo, hi in zip(order, heads, upto, upto[1:]):
            out[place] = np.concatenate([np.frombuffer(head, np.uint32), dealt[lo:hi]])
        return out


# ----------------------------------------------------------------------- format
def block_bytes(doc_ids: list[int | None], ids: list[np.ndarray]) -> bytes:
    counts = np.array([len(i) for i in ids], "<u8")
    words, at, escaped = simple8b.encode(np.concatenate(ids))
    head = np.array([len(ids), counts.sum(), len(words), len(at)], "<u8")
    known = np.array([0 if d is None else d for d in doc_ids], "<i8")
    missing = np.array([d is None for d in doc_ids], "u1")
    return b"".join(a.tobytes() for a in (
        head, known, missing, counts, words.astype("<u8"), at.astype("<u8"),
        escaped.astype("<u8")))


def read_block(data: bytes) -> tuple[list[int | None], list[np.ndarray]]:
    n_docs, n_ids, n_words, n_escapes = (int(x) for x in np.frombuffer(data, "<u8", 4))
    place = 32

    def take(kind: str, n: int) -> np.ndarray:
        nonlocal place
        found = np.frombuffer(data, kind, n, place)
        place += found.nbytes
        return found

    known, missing, counts = take("<i8", n_docs), take("u1", n_docs), take("<u8", n_docs)
    words, at, escaped = take("<u8", n_words), take("<u8", n_escapes), take("<u8", n_escapes)
    ids = simple8b.decode(words, n_ids, at, escaped)
    doc_ids = [None if m else int(d) for d, m in zip(known, missing)]
    return doc_ids, np.split(ids, np.cumsum(counts[:-1]).astype(np.int64))


def read_offsets(source) -> list[int]:
    """Offsets of the blocks and of their end."""
    size = source.size()
    source.seek(size - 16)
    tail = source.read(16)
    if tail[8:] != MAGIC:
        raise ValueError("not a token file, or cut short")
    n = int.from_bytes(tail[:8], "little")
    source.seek(size - 16 - 8 * n)
    return [*np.frombuffer(source.read(8 * n), "<u8").tolist(), size - 16 - 8 * n]


# ------------------------------------------------------------------------ tasks
_MANIFEST = "part long, file string, n_ids long, n_docs long"


def _write(batches: Iterator[pa.RecordBatch], path: str, end_id: int, folder: str):
    encoder = kept(("encoder", path), lambda: Encoder(path))
    end = np.array([end_id], np.uint32)
    name, out, offsets, n_ids, n_docs = files.new_file(folder, ".s8"), None, [], 0, 0
    doc_ids: list = []
    ids: list = []

    def flush():
        offsets.append(out.tell())
        out.write(block_bytes(doc_ids, ids))
        doc_ids.clear()
        ids.clear()

    held = 0
    for batch in batches:
        for lo in range(0, batch.num_rows, 1000):
            rows = batch.slice(lo, 1000)
            if out is None:
                out = files.open_new(name)
                out.write(MAGIC)
            texts = rows.column("text").to_pylist()
            for doc_id, found in zip(rows.column("doc_id").to_pylist(), encoder.encode(texts)):
                doc_ids.append(doc_id)
                ids.append(np.concatenate([found, end]))
                held += len(found) + 1
                n_ids, n_docs = n_ids + len(found) + 1, n_docs + 1
                if held >= BLOCK_IDS:
                    flush()
                    held = 0
    if out is None:
        return
    if ids:
        flush()
    out.write(np.array(offsets, "<u8").tobytes())
    out.write(len(offsets).to_bytes(8, "little") + MAGIC)
    out.close()
    yield pa.RecordBatch.from_pydict({
        "part": [TaskContext.get().partitionId()], "file": [name], "n_ids": [n_ids],
        "n_docs": [n_docs]})


def _read(batches: Iterator[pa.RecordBatch]):
    for batch in batches:
        for name, start in zip(batch.column("file").to_pylist(),
                               batch.column("start").to_pylist()):
            with files.open_random(name) as source:
                offsets = read_offsets(source)
                for lo, hi in zip(offsets, offsets[1:]):
                    source.seek(lo)
                    doc_ids, ids = read_block(source.read(hi - lo))
                    counts = np.array([len(i) for i in ids], np.int64)
                    yield pa.RecordBatch.from_arrays([
                        pa.array(doc_ids, pa.int64()),
                        pa.array(start + np.cumsum(counts) - counts, pa.int64()),
                        pa.array(counts),
                        pa.array([zlib.crc32(i.astype("<u4").tobytes()) for i in ids], pa.int64()),
                    ], names=["doc_id", "start", "n_tokens", "ids_crc32"])
                    start += int(counts.sum())


def write_tokens(docs: DataFrame, tokenizer: str, stage: Staging, end_id: int = 2) -> DataFrame:
    """Write the ids of every text, each followed by ``end_id``; the manifest of the files.

    Rows are sorted by doc_id (nulls first, equal ids by text) in ranges, one range to a file.
    The manifest has ``part, file, n_ids, n_docs, start`` with ``start`` the number of ids in
    the files before. Null texts count as empty. An empty table gives no file. ``tokenizer``
    must be readable on every executor; ids fit in 32 bits.
    """
    small_batches(docs.sparkSession)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"),
                       F.coalesce("text", F.lit("")).alias("text"))
    ordered = rows.repartitionByRange("doc_id").sortWithinPartitions("doc_id", "text")
    target = files.folder(stage, "tokens")
    manifest = stage.table("manifest", ordered.mapInArrow(
        lambda it: _write(it, tokenizer, end_id, target), _MANIFEST))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    return manifest.withColumn("start", F.coalesce(F.sum("n_ids").over(before), F.lit(0)))


def read_tokens(manifest: DataFrame) -> DataFrame:
    """``doc_id, start, n_tokens, ids_crc32`` of every document in the manifest's files."""
    manifest = manifest.select("file", "start")
    return files.one_task_each(manifest, manifest.count()).mapInArrow(
        _read, "doc_id long, start long, n_tokens long, ids_crc32 long")
