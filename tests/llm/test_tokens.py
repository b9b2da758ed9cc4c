import hashlib
import zlib
from collections import defaultdict

import numpy as np
import pytest

from evtrail.llm.bpe import PairIndexBPE, TextEncoder, bpe_round_trip
from evtrail.llm.packing import HarmonicPacker, WordEncoder, harmonic_pack
from tests.llm.helpers import docs, frame, odd_texts

P = pytest.importorskip("public_tokenizers")
BYTE, WORD = P.path("byte_bpe_50k.json"), P.path("word_bpe_49k.json")

TRICKY = ["", "  a  b\n\n c \n", "x<|endoftext|>y z", "don't it's WE'LL  3.14 ΣΑΣ İstanbul é", "aaaaaaa aaaa aaa",
          "\n \n x", "tab\tx \t y", "a\x1cb \x85 c d e", "日本語 テスト 123 ½ ²", "   ", "​﻿ x", "A.B,C. d,",
          "ẞ ǅ K", "..... !!!! ??", "a \nb", "a\n \nb", " lead", "trail ", "\t", "🙂🙂 🙂", "naïve café’s", "a  b", "x  y"]


def library(path):
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(path)
    t.no_truncation()
    t.no_padding()
    return t


def test_pair_index_equals_the_library(spark):
    tok = library(BYTE)
    texts = TRICKY + [t or "" for _, t in odd_texts()]
    bpe = PairIndexBPE(BYTE)
    for cache in (500_000, 3):                     # with and without emptied caches
        enc = TextEncoder(bpe, P.PATTERN, cache)
        for part in (texts[:10], texts[10:]):
            enc.learn(part)
            for t in part:
                line, decoded = enc.encode(t)
                want = tok.encode(t, add_special_tokens=False).ids
                assert line == ",".join(map(str, want)), repr(t[:60])
                assert decoded == tok.decode(want, skip_special_tokens=False)
                assert bpe.decode(want) == decoded


def test_pair_index_on_runs_of_one_symbol():
    tok, bpe = library(BYTE), PairIndexBPE(BYTE)
    words = ["a" * n for n in range(1, 40)] + ["=" * n for n in range(1, 70)] + ["ab" * n for n in range(1, 20)]
    assert bpe.encode_words([w.encode() for w in words]) == [tok.encode(w, add_special_tokens=False).ids for w in words]
    assert bpe.encode_words([]) == []


def test_bpe_frame(spark):
    tok = library(BYTE)
    rows = bpe_round_trip(docs(spark), BYTE, P.PATTERN, digests=True).collect()
    assert len(rows) == len(odd_texts())
    want = sorted((str(i), hashlib.sha256(",".join(map(str, tok.encode(t or "", add_special_tokens=False).ids)).encode())
                   .hexdigest(), hashlib.sha256((t or "").encode()).hexdigest()) for i, t in odd_texts())
    assert sorted((str(r.doc_id), r.ids_sha256, r.decoded_sha256) for r in rows) == want
    full = {r.doc_id: r for r in bpe_round_trip(frame(spark, [(1, "two words"), (2, None)]), BYTE, P.PATTERN).collect()}
    assert full[1].decoded == "two words" and full[1].ids == tok.encode("two words").ids
    assert (full[2].n_tokens, full[2].ids, full[2].decoded) == (0, [], "")
    assert bpe_round_trip(frame(spark, []), BYTE, P.PATTERN).count() == 0


def test_word_encoder_equals_the_library():
    tok = library(WORD)
    for cache in (600_000, 2, 40):                 # with and without forgetting
        enc = WordEncoder(WORD, cache)
        for t in 2 * (TRICKY + [t or "" for _, t in odd_texts()]):
            assert enc.encode(t.encode()).tolist() == tok.encode(t, add_special_tokens=False).ids, repr(t[:60])


def check_sequences(pieces, capacity):
    """pieces: (doc, start, length, total, sequence, offset)."""
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for doc, start, length, total, seq, offset in pieces:
        by_doc[doc].append((start, length, total))
        by_seq[seq].append((offset, length))
    for got in by_doc.values():
        at = 0
        for start, length, total in sorted(got):
            assert start == at and length > 0
            at += length
        assert at == total
    used = []
    for got in by_seq.values():
        at = 0
        for offset, length in sorted(got):
            assert offset == at
            at += length
        assert at <= capacity
        used.append(at)
    return used


def test_harmonic_packer_keeps_every_id_with_little_padding():
    rng = np.random.default_rng(1)
    sizes = [*rng.lognormal(6, 1.3, 3000).astype(int) + 1, 2048, 2047, 2049, 1, 1024, 4096, 100_000]
    p = HarmonicPacker(2048, 64, 128, 5)
    for i, n in enumerate(sizes):
        p.add(i, np.arange(n, dtype=np.int32))
    p.finish()
    for doc, start, ids, total, _, _ in p.rows:
        assert ids[0] == start and total == sizes[doc]
    used = check_sequences([(d, s, len(x), t, q, o) for d, s, x, t, q, o in p.rows], 2048)
    padding = sum(0 if n & (n - 1) == 0 else 2048 - n for n in used)
    assert padding < 0.005 * sum(sizes)


@pytest.mark.parametrize("sizes", [[], [1], [3, 5, 7], [2048], [2047, 1], [1000] * 5])
def test_harmonic_packer_of_few_documents(sizes):
    p = HarmonicPacker(2048, 64, 128, 0)
    for i, n in enumerate(sizes):
        p.add(i, np.zeros(n, np.int32))
    p.finish()
    check_sequences([(d, s, len(x), t, q, o) for d, s, x, t, q, o in p.rows], 2048)


def test_pack_frame(spark):
    tok = library(WORD)
    rows = [(i, t) for i, t in odd_texts() if i is not None][:-4]
    rows = list({i: (i, t) for i, t in rows}.values())
    got = harmonic_pack(docs(spark, rows), WORD).collect()
    check_sequences([(r.doc_id, r.start, r.length, r.doc_tokens, r.sequence_id, r.offset) for r in got], 2048)
    ids = {i: [*tok.encode(t or "", add_special_tokens=False).ids, 1] for i, t in rows}
    assert {r.doc_id for r in got} == set(ids)
    for r in got:
        part = ids[r.doc_id][r.start:r.start + r.length]
        assert r.ids == part and r.doc_tokens == len(ids[r.doc_id])
        assert r.ids_crc32 == zlib.crc32(np.array(part, "<u4").tobytes())
    assert harmonic_pack(frame(spark, []), WORD).count() == 0
    odd = harmonic_pack(docs(spark), WORD, with_ids=False).collect()            # null and repeated ids
    assert sum(r.length for r in odd if r.doc_id is None) == sum(
        len(tok.encode(t, add_special_tokens=False).ids) + 1 for i, t in odd_texts() if i is None)
