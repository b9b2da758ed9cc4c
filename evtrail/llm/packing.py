"""Harmonic packing of tokenised documents into training sequences.

Piece lengths fall into reciprocal-capacity classes: class k holds lengths in
(capacity / (k + 1), capacity / k], and each of its bins takes exactly k
pieces.  Documents may be cut, so a remainder that would waste room in its
class gives its head to class k + 1 (which it fills exactly) and goes on with
the short rest.  Every worker fills its own bins as its rows stream by; what
is open when its rows end (less than one bin a class) is laid end to end, and
the last stretch is cut into powers of two, which need no padding.

Plan.  One scan, no shuffle, no state beyond less than one bin a class and
the word cache.  Sequence ids are the partition's number and a counter, so a
task that runs again gives the same rows.
"""

from __future__ import annotations

import re
import zlib
from functools import lru_cache
from itertools import chain

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.llm.common import in_arrow, read_table, text_bytes
from evtrail.llm.registry import query

CAPACITY = 2048
CLASSES = 64          # pieces of at most capacity / CLASSES ids are laid end to end
SLACK = 128           # a piece stays whole if it wastes at most 1/SLACK of itself
END_ID = 1
CACHE_WORDS = 600_000
CACHE_PIECES = 150_000
DRAIN_IDS = 500_000   # ids a worker packs before it hands its rows on


class _Index(dict):
    """Word -> place; a word that is not known gets the next place and waits
    in ``pending``."""

    def __init__(self):
        super().__init__()
        self.pending: list[bytes] = []

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        self.pending.append(word)
        return place


class WordEncoder:
    """Ids of whole texts under a lower-casing word BPE of the tokenizers
    library.  Its normaliser and splitter never look across white space, so
    ids are cached by the text between ASCII spaces; the library's own model
    encodes each new word, and its whole pipeline any that is not Latin.  A
    full cache keeps the words used most and forgets the others."""

    def __init__(self, path: str, cache_words: int = CACHE_WORDS):
        import regex
        from tokenizers import Tokenizer
        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tokenize = self.tok.model.tokenize
        self.split = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+")
        self.other = re.compile(rb"[\x00-\x20\x7f\xc9-\xff]|<\|").search
        # byte -> printable character, as byte-level vocabularies spell bytes
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        other = [b for b in range(256) if b not in printable]
        self.spell = {b: chr(b) for b in printable} | {b: chr(256 + i) for i, b in enumerate(other)}
        self.limit = cache_words
        self.words = _Index()
        self.pieces: dict[bytes, tuple] = {}
        self.flat = np.zeros(1 << 16, np.int32)      # the ids of all known words
        self.bounds = np.zeros(1 << 14, np.int64)    # where each word's ids begin; the next one's end
        self.uses = np.zeros(1 << 14, np.int64)
        self.n = 0

    def _piece(self, piece: bytes) -> tuple:
        """Ids of one lower-case piece of the splitter."""
        ids = self.pieces.get(piece)
        if ids is None:
            spelt = piece.decode() if piece.isascii() else piece.decode("latin-1").translate(self.spell)
            ids = self.pieces[piece] = tuple([t.id for t in self.tokenize(spelt)])
        return ids

    def _word(self, word: bytes):
        if word.isalpha():                   # ASCII letters
            return self._piece(word.lower())
        if self.other(word):
            return self.tok.encode(word.decode(), add_special_tokens=False).ids
        low = word.decode().lower()
        if low.isalpha():
            return self._piece(low.encode())
        if low[-1] in ".," and low[:-1].isalpha():
            return self._piece(low[:-1].encode()) + self._piece(low[-1].encode())
        return [i for p in self.split.findall(low) for i in self._piece(p.encode())]

    def _learn(self):
        """Ids of the pending words, whose places follow the known ones."""
        runs = list(map(self._word, self.words.pending))
        self.words.pending = []
        ends = self.bounds[self.n] + np.cumsum(np.fromiter(map(len, runs), np.int64, len(runs)))
        while ends[-1] > len(self.flat):
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while self.n + len(runs) >= len(self.bounds):
            self.bounds = np.concatenate([self.bounds, np.zeros_like(self.bounds)])
            self.uses = np.concatenate([self.uses, np.zeros_like(self.uses)])
        self.flat[self.bounds[self.n]:ends[-1]] = list(chain.from_iterable(runs))
        self.bounds[self.n + 1:self.n + 1 + len(runs)] = ends
        self.n += len(runs)
        if len(self.pieces) > CACHE_PIECES:
            self.pieces = {}

    def _forget(self):
        """Keep the half of a full cache that was used most, at least twice."""
        uses = self.uses[:self.n]
        keep = np.flatnonzero(uses > 1)
        keep = keep[np.argsort(-uses[keep], kind="stable")][:self.limit // 2]
        place = np.full(self.n, -1)
        place[keep] = np.arange(len(keep))
        flat = self._gather(keep)
        size = self.bounds[keep + 1] - self.bounds[keep]
        words = _Index()
        old = np.array(list(self.words), object)     # in the order of their places
        words.update(zip(old[keep].tolist(), range(len(keep))))
        self.words, self.n = words, len(keep)
        self.flat[:len(flat)] = flat
        self.bounds[1:len(keep) + 1] = np.cumsum(size)
        self.uses[:] = 0

    def _gather(self, which: np.ndarray) -> np.ndarray:
        begin = self.bounds[which]
        size = self.bounds[which + 1] - begin
        ends = np.cumsum(size)
        if not len(ends):
            return np.zeros(0, np.int32)
        return self.flat[np.repeat(begin - (ends - size), size) + np.arange(ends[-1])]

    def encode(self, text: bytes) -> np.ndarray:
        if len(self.words) > self.limit:
            self._forget()
        words = text.split()                 # the six ASCII spaces
        which = np.fromiter(map(self.words.__getitem__, words), np.int64, len(words))
        if self.words.pending:
            self._learn()
        np.add.at(self.uses, which, 1)
        return self._gather(which)


@lru_cache(maxsize=1)
def _encoder(path: str) -> WordEncoder:
    """One encoder a worker process, kept from task to task."""
    return WordEncoder(path)


class HarmonicPacker:
    """Streams documents of one worker into sequences; ``rows`` collects one
    tuple a piece: (doc, start, ids, doc_tokens, sequence, offset)."""

    def __init__(self, capacity: int, classes: int, slack: int, first_sequence: int):
        self.capacity, self.classes, self.slack = capacity, classes, slack
        self.next = first_sequence
        self.open: dict[int, list] = {k: [] for k in range(2, classes + 1)}
        self.laid: list = []
        self.laid_ids = 0
        self.rows: list[tuple] = []

    def _close(self, pieces: list):
        offset = 0
        for doc, start, ids, total in pieces:
            self.rows.append((doc, start, ids, total, self.next, offset))
            offset += len(ids)
        self.next += 1

    def _lay(self, piece: tuple):
        """End to end; whatever passes the capacity is cut there."""
        doc, start, ids, total = piece
        while self.laid_ids + len(ids) >= self.capacity:
            room = self.capacity - self.laid_ids
            self._close([*self.laid, (doc, start, ids[:room], total)])
            start, ids = start + room, ids[room:]
            self.laid, self.laid_ids = [], 0
        if len(ids):
            self.laid.append((doc, start, ids, total))
            self.laid_ids += len(ids)

    def add(self, doc, ids: np.ndarray):
        c, total, at = self.capacity, len(ids), 0
        while total - at >= c:               # class 1: whole sequences
            self._close([(doc, at, ids[at:at + c], total)])
            at += c
        while at < total:
            rest = total - at
            if rest <= c // self.classes:
                self._lay((doc, at, ids[at:], total))
                return
            k = c // rest                    # capacity / (k + 1) < rest <= capacity / k
            if k == 1 and (c - rest) * self.slack <= rest:
                self._close([(doc, at, ids[at:], total)])
                return
            if k == 1 or (c // k - rest) * self.slack > rest:
                k += 1                       # the head fills a place of the next class exactly
            take = min(rest, c // k)
            bin_ = self.open[k]
            bin_.append((doc, at, ids[at:at + take], total))
            if len(bin_) == k:
                self._close(bin_)
                self.open[k] = []
            at += take

    def finish(self):
        for bin_ in self.open.values():
            for piece in bin_:
                self._lay(piece)
        self.open = {k: [] for k in self.open}
        stretch, self.laid, left = self.laid, [], self.laid_ids
        self.laid_ids = 0
        while left:                          # powers of two: no padding
            room = part = 1 << (left.bit_length() - 1)
            taken = []
            while room:
                doc, start, ids, total = stretch.pop(0)
                if len(ids) > room:
                    stretch.insert(0, (doc, start + room, ids[room:], total))
                    ids = ids[:room]
                taken.append((doc, start, ids, total))
                room -= len(ids)
            self._close(taken)
            left -= part


_SCHEMA = ("id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long")


def _pack_batches(path: str, capacity: int, classes: int, slack: int, end_id: int, with_ids: bool):
    def run(batches):
        import pyarrow as pa
        from pyspark import TaskContext
        encoder = _encoder(path)
        packer = HarmonicPacker(capacity, classes, slack, TaskContext.get().partitionId() << 33)

        def drain():
            rows, packer.rows = packer.rows, []
            doc, start, ids, total, sequence, offset = zip(*rows) if rows else [()] * 6
            crc = [zlib.crc32(x.astype("<u4").tobytes()) for x in ids]
            cols = [pa.array(x, pa.int64()) for x in (doc, start, list(map(len, ids)), crc, total, sequence, offset)]
            names = ["id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]
            if with_ids:
                bounds = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                flat = np.concatenate(ids) if ids else np.zeros(0, np.int32)
                cols.append(pa.ListArray.from_arrays(pa.array(bounds), pa.array(flat, pa.int32())))
                names.append("ids")
            return pa.RecordBatch.from_arrays(cols, names)

        end, held = np.array([end_id], np.int32), 0
        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), b.column(1)):
                ids = np.concatenate([encoder.encode(text.as_py()), end])
                packer.add(doc, ids)
                held += len(ids)
                if held > DRAIN_IDS:
                    yield drain()
                    held = 0
        packer.finish()
        yield drain()
    return run


def harmonic_pack(docs: DataFrame, tokenizer_path: str, id_col: str = "doc_id", text_col: str = "text",
                  capacity: int = CAPACITY, classes: int = CLASSES, slack: int = SLACK, end_id: int = END_ID,
                  with_ids: bool = True) -> DataFrame:
    """One row per piece: ``<id>``, ``start``, ``length``, ``ids_crc32``,
    ``doc_tokens``, ``sequence_id``, ``offset`` and (``with_ids``) ``ids``.

    Every id of every document, its end id included, lies in exactly one
    piece; a sequence's pieces follow each other without a gap and hold at
    most ``capacity`` ids.  ``capacity`` is a power of two.

    Defined cases: a null or empty text is one piece, its end id; a null id
    stays null; rows that repeat an id are packed as often as they occur; an
    empty table gives no pieces; other columns are not read.
    """
    schema = _SCHEMA + (", ids array<int>" if with_ids else "")
    own = docs.select(F.col(id_col).cast("long").alias("id"), text_bytes(text_col).alias("t"))
    out = in_arrow(own, _pack_batches(tokenizer_path, capacity, classes, slack, end_id, with_ids), schema)
    return out.withColumnRenamed("id", id_col)


def word_vocabulary() -> str:
    import public_tokenizers
    return public_tokenizers.path("word_bpe_49k.json")


@query("op3_harmonic_pack")
def op3_harmonic_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return harmonic_pack(read_table(spark, sf_dir, "documents"), word_vocabulary(), with_ids=False)
