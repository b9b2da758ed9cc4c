"""Byte-level BPE encoding and decoding with a pair occurrence index.

A worker gathers the distinct words of its rows, lays their bytes end to end
and maps every adjacent pair that a merge rule names to all its positions.
The active rule of lowest rank is then applied at all its positions at once
and the lists of the pairs this makes are extended, until no list is left.
Ranks only rise that way, since the symbol a rule makes occurs in later rules
alone, so each word gets the merges it would get by itself.

Plan.  One scan, no shuffle.  A worker's state is its word cache (emptied
when it holds ``CACHE_WORDS`` words) and the index of the words new in a
block of ``BLOCK_CHARS`` characters.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evtrail.llm.common import in_arrow, read_table, text_or_empty
from evtrail.llm.registry import query

CACHE_WORDS = 250_000
BLOCK_CHARS = 16_000_000
_NONE = 1 << 60


def byte_alphabet() -> list[str]:
    """The character that stands for each byte in byte-level vocabularies:
    printable Latin-1 for itself, the others from U+0100 on, in order."""
    printable = {*range(33, 127), *range(161, 173), *range(174, 256)}
    spare = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(spare)) for b in range(256)]


class PairIndexBPE:
    """Merges of a byte-level BPE vocabulary (tokenizers JSON)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, merges = spec["model"]["vocab"], spec["model"]["merges"]
        self.size = max(vocab.values()) + 1
        alphabet = byte_alphabet()
        self.byte_id = np.array([vocab[c] for c in alphabet], np.int64)
        pairs = [m.split(" ") if isinstance(m, str) else m for m in merges]
        left = np.array([vocab[a] for a, _ in pairs], np.int64)
        right = np.array([vocab[b] for _, b in pairs], np.int64)
        self.left, self.right = left, right
        self.made = np.array([vocab[a + b] for a, b in pairs], np.int64)
        code = left * self.size + right
        self.order = np.argsort(code, kind="stable")
        self.codes = code[self.order]
        value = {c: b for b, c in enumerate(alphabet)}
        self.token_bytes = [b""] * self.size
        for token, i in vocab.items():
            self.token_bytes[i] = bytes(value[c] for c in token)
        self.special = {}
        for t in spec["added_tokens"]:
            self.special[t["content"]] = t["id"]
            self.token_bytes.extend([b""] * (t["id"] + 1 - len(self.token_bytes)))
            self.token_bytes[t["id"]] = t["content"].encode()

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        code = left * self.size + right
        at = np.minimum(np.searchsorted(self.codes, code), len(self.codes) - 1)
        return np.where(self.codes[at] == code, self.order[at], _NONE)

    def encode_words(self, words: list[bytes]) -> list[list[int]]:
        """Ids of each word (non-empty bytes, merged each by itself)."""
        if not words:
            return []
        flat = self.byte_id[np.frombuffer(b"".join(words), np.uint8)]
        n = len(flat)
        ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        sym = np.append(flat, -1)                       # position n stands for "no neighbour"
        nxt = np.arange(1, n + 2)
        prv = np.arange(-1, n)
        nxt[ends - 1] = n
        nxt[n] = n
        prv[np.concatenate(([0], ends[:-1]))] = n

        index: dict[int, list[np.ndarray]] = {}
        active: list[int] = []

        def add(at: np.ndarray, rank: np.ndarray):
            keep = rank < _NONE
            at, rank = at[keep], rank[keep]
            if not len(at):
                return
            by = np.argsort(rank, kind="stable")
            at, rank = at[by], rank[by]
            cut = np.flatnonzero(rank[1:] != rank[:-1]) + 1
            bounds = [0, *cut.tolist(), len(rank)]
            for r, i, j in zip(rank[bounds[:-1]].tolist(), bounds, bounds[1:]):
                if r in index:
                    index[r].append(at[i:j])
                else:
                    index[r] = [at[i:j]]
                    heapq.heappush(active, r)

        first = np.flatnonzero(nxt[:n] != n)
        add(first, self._ranks(sym[first], sym[first + 1]))
        while active:
            r = heapq.heappop(active)
            lists = index.pop(r)
            at = lists[0] if len(lists) == 1 else np.concatenate(lists)
            a, b, new = self.left[r], self.right[r], self.made[r]
            at = at[(sym[at] == a) & (sym[nxt[at]] == b)]   # positions that earlier merges left alone
            if a == b and len(at) > 1:                  # overlapping runs: every other one, from the left
                at = np.sort(at)
                head = np.append(True, nxt[at[:-1]] != at[1:])
                begin = np.flatnonzero(head)
                offset = np.arange(len(at)) - begin[np.cumsum(head) - 1]
                at = at[offset % 2 == 0]
            if not len(at):
                continue
            gone = nxt[at]
            after = nxt[gone]
            sym[at], sym[gone] = new, -2
            nxt[at], prv[after] = after, at
            before = prv[at]
            ok = (before < n) & (sym[before] != new)    # a merged left neighbour adds the pair itself
            lefts, mid = before[ok], at[ok]
            ok = after < n
            rights, follow = at[ok], after[ok]
            pos = np.concatenate([lefts, rights])
            if len(pos):
                add(pos, self._ranks(np.concatenate([sym[lefts], sym[rights]]),
                                     np.concatenate([sym[mid], sym[follow]])))
        alive = sym[:n] >= 0
        ids = sym[:n][alive].tolist()
        upto = np.concatenate(([0], np.cumsum(alive)[ends - 1])).tolist()
        return [ids[i:j] for i, j in zip(upto, upto[1:])]

    def decode(self, ids) -> str:
        return b"".join(map(self.token_bytes.__getitem__, ids)).decode("utf-8", "replace")


class TextEncoder:
    """Whole texts to ids.  Text is cut where a space starts a word: what
    stands between two such cuts is split by the vocabulary's pattern alone
    wherever it occurs, so its ids are cached.  A text in which white space
    precedes a space is split by the pattern as a whole.

    A piece is known by its place in ``digits`` (its ids, decimal, joined by
    commas) and ``raw`` (their bytes); ``spaced`` has the place of a space
    and the key, ``plain`` of the key itself.
    """

    def __init__(self, bpe: PairIndexBPE, pattern: str, cache_words: int = CACHE_WORDS):
        import regex
        self.bpe, self.limit = bpe, cache_words
        self.split = regex.compile(pattern)
        self.special = re.compile("(" + "|".join(map(re.escape, bpe.special)) + ")") if bpe.special else None
        self.wide = regex.compile(r"[^\S\x00-\x7f] ")
        self._reset()

    def _reset(self):
        self.spaced: dict[str, int] = {}
        self.plain: dict[str, int] = {}
        self.digits: list[str] = []
        self.raw: list[bytes] = []
        self.words: dict[str, int] = {}

    def cuts(self, text: str) -> tuple[list[str], list[str]]:
        """Plain pieces, then spaced ones; joined they are the text."""
        if any(x in text for x in ("  ", "\n ", "\t ", "\r ", "\x0b ", "\x0c ")) or (
                not text.isascii() and self.wide.search(text)):
            return self.split.findall(text), []
        first, *rest = text.split(" ")
        return ([first] if first else []), rest

    def segments(self, text: str) -> list[tuple[list[str], list[str]]]:
        """The cuts of what stands between special tokens, and those tokens."""
        if self.special is None or not any(s in text for s in self.bpe.special):
            return [self.cuts(text)]
        return [([part], []) if part in self.bpe.special else self.cuts(part)
                for part in self.special.split(text) if part]

    def _words_of(self, piece: str) -> list[str]:
        if piece.isascii():
            body = piece[1:] if piece[0] == " " else piece
            if body.isalpha():
                return [piece]
            if body[-1:] in (".", ",") and body[:-1].isalpha():
                return [piece[:-1], piece[-1]]
        return self.split.findall(piece)

    def learn(self, texts: list[str]):
        """Index the pieces that are new in a block of texts."""
        if len(self.digits) > self.limit:
            self._reset()
        new_plain, new_spaced = set(), set()
        for text in texts:
            for plain, spaced in self.segments(text):
                new_plain.update([p for p in plain if p not in self.plain])
                new_spaced.update([p for p in spaced if p not in self.spaced])
        pending = [(self.plain, p, p) for p in new_plain] + [(self.spaced, p, " " + p) for p in new_spaced]
        split = [None if piece in self.bpe.special else self._words_of(piece) for _, _, piece in pending]
        fresh = list({w for ws in split if ws for w in ws if w not in self.words})
        token, digits, raw = self.bpe.token_bytes, self.digits, self.raw
        decimal = list(map(str, range(len(token))))
        for w, ids in zip(fresh, self.bpe.encode_words([w.encode() for w in fresh])):
            self.words[w] = len(digits)
            digits.append(",".join([decimal[i] for i in ids]))
            raw.append(b"".join([token[i] for i in ids]))
        for (table, key, piece), ws in zip(pending, split):
            if ws is not None and len(ws) == 1:
                table[key] = self.words[ws[0]]
                continue
            table[key] = len(digits)
            if ws is None:
                digits.append(decimal[self.bpe.special[piece]])
                raw.append(token[self.bpe.special[piece]])
            else:
                parts = [self.words[w] for w in ws]
                digits.append(",".join([digits[i] for i in parts]))
                raw.append(b"".join([raw[i] for i in parts]))

    def encode(self, text: str) -> tuple[str, str]:
        """The ids of a learnt text, decimal and joined by commas, and the
        text they decode to."""
        which: list[int] = []
        for plain, spaced in self.segments(text):
            which.extend([self.plain[p] for p in plain])
            which.extend(map(self.spaced.__getitem__, spaced))
        return (",".join(map(self.digits.__getitem__, which)),
                b"".join(map(self.raw.__getitem__, which)).decode("utf-8", "replace"))


def _blocks(texts: list[str], limit: int):
    lo = total = 0
    for i, t in enumerate(texts):
        total += len(t)
        if total >= limit:
            yield lo, i + 1
            lo, total = i + 1, 0
    if lo < len(texts):
        yield lo, len(texts)


def _encode_batches(path: str, pattern: str, digests: bool):
    def run(batches):
        import pyarrow as pa
        encoder = TextEncoder(PairIndexBPE(path), pattern)
        for b in batches:
            texts = b.column(1).to_pylist()
            for lo, hi in _blocks(texts, BLOCK_CHARS):
                encoder.learn(texts[lo:hi])
                rows: list[list] = [[], [], []]
                for text in texts[lo:hi]:
                    line, decoded = encoder.encode(text)
                    rows[0].append(line.count(",") + 1 if line else 0)
                    if digests:
                        rows[1].append(hashlib.sha256(line.encode()).hexdigest())
                        rows[2].append(hashlib.sha256(decoded.encode()).hexdigest())
                    else:
                        rows[1].append(list(map(int, line.split(","))) if line else [])
                        rows[2].append(decoded)
                kinds = ((pa.int64(), pa.string(), pa.string()) if digests
                         else (pa.int64(), pa.list_(pa.int32()), pa.string()))
                cols = [b.column(0).slice(lo, hi - lo), *[pa.array(x, k) for x, k in zip(rows, kinds)]]
                yield pa.RecordBatch.from_arrays(cols, ["id", "n_tokens", "x", "y"])
    return run


def bpe_round_trip(docs: DataFrame, tokenizer_path: str, pattern: str, id_col: str = "doc_id",
                   text_col: str = "text", digests: bool = False) -> DataFrame:
    """One row per input row: ``<id>``, ``n_tokens`` and either ``ids``
    (array<int>) and ``decoded`` (string), or with ``digests`` their SHA-256:
    ``ids_sha256`` of the decimal ids joined by commas and ``decoded_sha256``
    of the decoded text in UTF-8.  Special tokens in a text are encoded as
    their ids, and decoded as their text.

    Defined cases: a null or empty text has no ids and decodes to the empty
    text; a null id stays null; rows that repeat are encoded each; an empty
    table gives an empty result; other columns are not read.
    """
    own = docs.select(F.col(id_col).alias("id"), text_or_empty(text_col).alias("t"))
    kind = own.schema["id"].dataType.simpleString()
    schema = f"id {kind}, n_tokens long, " + ("x string, y string" if digests else "x array<int>, y string")
    out = in_arrow(own, _encode_batches(tokenizer_path, pattern, digests), schema)
    names = ("ids_sha256", "decoded_sha256") if digests else ("ids", "decoded")
    return out.toDF(id_col, "n_tokens", *names)


@query("op2_bpe_pair_index")
def op2_bpe_pair_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers as P
    return bpe_round_trip(read_table(spark, sf_dir, "documents"), P.path("byte_bpe_50k.json"), P.PATTERN,
                          digests=True)
