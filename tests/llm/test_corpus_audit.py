"""Run-length index, tokenizer alignment and source divergence against plain readings of their rules."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from evtrail.llm import align, divergence, run_index
from tests.llm.helpers import PROSE, SCHEMA, docs, frame, odd_texts


# ---- op11 ----------------------------------------------------------------

def plain_removal(rows):
    """Expected (id, n_bytes, n_removed, n_spans, sha) rows; ties of ids by the order given."""
    out, seen = [], set()
    for key, text in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0)):
        data = (text or "").encode()
        gone = np.zeros(len(data), bool)
        for p in range(len(data) - 99):
            window = data[p:p + 100]
            if window in seen:
                gone[p:p + 100] = True
            seen.add(window)
        spans = int(np.diff(np.r_[0, gone.astype(int)]).clip(0).sum())
        rest = np.frombuffer(data, np.uint8)[~gone].tobytes()
        out.append((key, len(data), int(gone.sum()), spans, hashlib.sha256(rest).hexdigest()))
    return Counter(out)


def passages():
    rng = random.Random(5)
    word = lambda: "".join(rng.choices("abcdefghij", k=rng.randint(2, 9)))
    prose = lambda n: " ".join(word() for _ in range(n))
    shared, short, exact = prose(40), prose(10)[:99], prose(18)[:100]
    rows = [(i, f"{prose(30)} {shared} {prose(25)}") for i in range(12)]
    rows += [(20 + i, prose(20) + exact + prose(20)) for i in range(4)]
    rows += [(30 + i, prose(20) + short + prose(20)) for i in range(3)]
    rows += [(40, shared * 4), (41, "x" * 5000), (42, "x" * 99), (43, "x" * 100), (44, "ab" * 400)]
    rows += [(50 + i, rows[0][1]) for i in range(5)]
    rows += [(60, "日本語テキスト" * 60), (61, "前" + "日本語テキスト" * 20), (70, None), (71, "")]
    return rows


@pytest.mark.parametrize("hot", [run_index.HOT, 2])
def test_repeats_equal_brute_force(spark, hot):
    rows = passages() + [(i, t) for i, t in odd_texts() if i != 1 or t != PROSE] + [(1, PROSE)]
    rows = [(None if i is None else i * 3, t) for i, t in rows]
    got = run_index.remove_repeats(docs(spark, rows), hot=hot)
    assert got.columns == ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"]
    distinct_ids = [r for r in rows if sum(x[0] == r[0] for x in rows) == 1]
    assert Counter(map(tuple, run_index.remove_repeats(docs(spark, distinct_ids), hot=hot).collect())) == \
        plain_removal(distinct_ids)
    assert got.count() == len(rows)


def test_repeats_same_id_and_text(spark):
    long = "the same row stands here many times " * 10
    got = run_index.remove_repeats(frame(spark, [(7, long)] * 6 + [(None, long)] * 3))
    kept = [r for r in got.collect() if r.n_removed < len(long)]
    assert len(kept) == 1 and kept[0].doc_id == 7
    assert run_index.remove_repeats(spark.createDataFrame([], SCHEMA)).count() == 0


def test_repeats_with_text_ids(spark):
    a = PROSE + " and more"
    got = run_index.remove_repeats(spark.createDataFrame([("b", a), ("a", PROSE), ("c", "short")], "doc_id string, text string"))
    assert {r.doc_id: r.n_removed for r in got.collect()} == {"a": 0, "b": len(PROSE), "c": 0}


def test_every_window_has_one_anchor_and_equal_windows_the_same():
    rng = np.random.default_rng(3)
    shared = rng.integers(97, 101, 300).astype(np.uint8)
    names = []
    for _ in range(3):
        data = np.r_[rng.integers(97, 101, 57), shared, rng.integers(97, 101, 41)].astype(np.uint8)
        starts, counts, hashes = run_index.anchors(data)
        assert counts.sum() == len(data) - 99 and (starts == np.cumsum(counts) - counts).all()
        assert counts.max() <= run_index.WINDOW - run_index.GRAM + 1
        names.append(np.repeat(hashes, counts)[57:57 + 201])
    assert (names[0] == names[1]).all() and (names[1] == names[2]).all()


def test_long_texts_are_cut_without_losing_windows(monkeypatch):
    monkeypatch.setattr(run_index, "CHUNK", 64)
    data = bytes(np.random.default_rng(1).integers(97, 123, 1000).astype(np.uint8))
    windows = [(lo + s, lo + s + c) for lo, part in run_index._chunks(data)
               for s, c, _ in zip(*run_index.anchors(part))]
    assert [w for lo, hi in windows for w in range(lo, hi)] == list(range(901))


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab", min_size=1, max_size=30), min_size=1, max_size=12), st.integers(2, 9))
def test_run_index_rows_and_first_matches(segments, window):
    data = [s.encode() for s in segments]
    index = run_index.RunIndex(data, window)
    places = [(k, i) for k, s in enumerate(data) for i in range(len(s) + 1)]
    # suffixes with their own marks: (0, k) ends segment k and sorts before bytes
    suffix = [[*((1, b) for b in data[k][i:]), (0, k)] for k, i in places]
    rows = np.empty(len(places), int)
    rows[sorted(range(len(places)), key=suffix.__getitem__)] = np.arange(len(places))
    assert (index.rows() == rows).all()
    first = index.first_of_match()
    for at, (k, i) in enumerate(places):
        if i + window <= len(data[k]):
            same = [q for q, (m, j) in enumerate(places) if data[m][j:j + window] == data[k][i:i + window]]
            assert first[at] == same[0]


# ---- op12 ----------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(1, 3), min_size=1, max_size=120), st.lists(st.integers(1, 3), min_size=1, max_size=120),
       st.integers(0, 80))
def test_run_skips_finds_every_common_end(a, b, same):
    a, b = [1] * same + a, [1] * same + b
    ends_a, ends_b = np.cumsum(a), np.cumsum(b)
    last = max(ends_a[-1], ends_b[-1]) + 1
    ends_a, ends_b = (np.r_[e, last].astype(np.int32) for e in (ends_a, ends_b))
    at_a, at_b = align.run_skips(ends_a, ends_b)
    common = np.intersect1d(ends_a, ends_b)
    assert (ends_a[at_a] == common).all() and (ends_b[at_b] == common).all()


def plain_alignment(rows):
    import public_tokenizers as P
    import sentencepiece
    from tokenizers import Tokenizer
    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    t.encode_special_tokens = True
    sp = sentencepiece.SentencePieceProcessor(model_file=P.path("piece_bpe_32k.model"))
    vocab = align.tokenizers(P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN).bytes_a
    found = []
    for key, text in rows:
        a = t.encode(" " + text, add_special_tokens=False).ids if text else []
        b = sp.encode(text) if text else []
        spell_b = [bytes([int(p[3:5], 16)]) if re.fullmatch("<0x..>", p) else p.replace("▁", " ").encode()
                   for p in map(sp.id_to_piece, b)]
        if b"".join(vocab[i] for i in a) != b"".join(spell_b) or b"".join(spell_b) != (" " + (text or "")).encode():
            a, b, spell_b = [], [], []
        ends_a = np.cumsum([len(vocab[i]) for i in a]).tolist()
        ends_b = np.cumsum(list(map(len, spell_b))).tolist()
        groups, links, p, q = [], [], 0, 0
        for end in sorted(set(ends_a) & set(ends_b)):
            i, j = ends_a.index(end) + 1, ends_b.index(end) + 1
            groups.append(",".join(map(str, a[p:i])) + "|" + ",".join(map(str, b[q:j])))
            links.append((a[i - 1], b[j - 1]))
            p, q = i, j
        found.append((key, len(a), len(b), ";".join(groups), links))
    counts = Counter(x for f in found for x in f[4])
    most = Counter()
    for (_, y), c in counts.items():
        most[y] = max(most[y], c)
    return Counter((key, na, nb, len(links), len(links), sum(counts[x] == most[x[1]] for x in links),
                    sum(counts[x] for x in links), hashlib.sha256(g.encode()).hexdigest() if na else "")
                   for key, na, nb, g, links in found)


def test_alignment_equals_the_libraries(spark):
    import public_tokenizers as P
    rows = [(i, t if i != 8 else t[:20_000]) for i, t in odd_texts()]
    rows += [(90, "a ▁ b"), (91, " lead"), (92, "trail  \n\n"), (93, "</s> <s> <unk> <0x41>"), (94, "ﬁ Ａ é́")]
    got = align.align_tokenizers(docs(spark, rows), P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN)
    assert got.columns == ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert Counter(map(tuple, got.collect())) == plain_alignment(rows)
    empty = spark.createDataFrame([], SCHEMA)
    assert align.align_tokenizers(empty, P.path("byte_bpe_50k.json"), P.path("piece_bpe_32k.model"), P.PATTERN).count() == 0


# ---- op13 ----------------------------------------------------------------

@settings(max_examples=200, deadline=None)
@given(st.sets(st.integers(0, 3000), max_size=400), st.sets(st.integers(0, 3000), max_size=400))
def test_gallop(a, b):
    a, b = (np.array(sorted(x), np.int64) for x in (a, b))
    where = {v: i for i, v in enumerate(b.tolist())}
    assert divergence.gallop(a, b).tolist() == [where.get(v, -1) for v in a.tolist()]


def test_shares_are_exact_for_large_counts():
    big = np.array([0, 7, 10**12], np.int64)
    assert divergence.shares(big, 10**13, 3).tolist() == [1 + 10**9 * (int(c) + 5) // (10**13 + 15) for c in big]


def plain_divergence(rows, min_docs, top):
    pattern = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
    groups, held = {}, {}
    for lang, source, text in rows:
        lang, source = lang or "", source or ""
        words = pattern.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        groups.setdefault((lang, source), Counter()).update(words)
        held.setdefault(lang, Counter()).update(set(words))
    out = set()
    for lang in held:
        kept = sorted(t for t, d in held[lang].items() if d >= min_docs)
        own = {s: {t: c[t] for t in kept} for (g, s), c in groups.items() if g == lang}
        whole = {t: sum(c[t] for c in own.values()) for t in kept}
        price = lambda c: {t: 1 + 10**9 * (n + 5) // (sum(c.values()) + 5 * len(kept)) for t, n in c.items()}
        p, q = {s: price(c) for s, c in own.items()}, price(whole)
        for s in own:
            pairs = [(-sum(abs(p[s][t] - p[o][t]) for t in kept), o.encode()) for o in own if o != s]
            terms = [(q[t] - p[s][t], t.encode()) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found in (("pair", sorted(pairs)), ("term", sorted(terms)[:top])):
                out |= {(lang, s, part, item.decode(), -v, i) for i, (v, item) in enumerate(found, 1)}
    return out


def test_divergence_equals_brute_force(spark):
    rng = random.Random(9)
    words = [f"{a}{b}" for a in "abcdefgh" for b in "xyzÄé"] + ["THE", "the", "日本"]
    rows = [(rng.choice(["en", "fr", None]), rng.choice(["s1", "s2", "s3", None]),
             " ".join(rng.choices(words, k=rng.randint(0, 30)))) for _ in range(200)]
    rows += [("en", "none", "only seen once"), ("en", "void", None), ("de", "s1", "ein"), ("de", "s2", "zwei"), ("xx", "s", "x")]
    rows += [("en", "s1", PROSE)] * 60
    df = spark.createDataFrame([(a, b, c, "x", "y", 1, 2, 3) for a, b, c in rows],
                               "lang string, source string, text string, term string, part string, n long, value long, rank long")
    for min_docs, top in ((5, 4), (1, 50), (10_000, 50)):
        got = divergence.source_divergence(df.repartition(3), min_docs, top)
        assert got.columns == ["lang", "source", "part", "item", "value", "rank"]
        assert set(map(tuple, got.collect())) == plain_divergence(rows, min_docs, top)
    assert divergence.source_divergence(df.limit(0)).count() == 0


def test_divergence_over_blocks_of_ids(spark, monkeypatch):
    monkeypatch.setattr(divergence, "BLOCK_TERMS", 6)
    rows = [("en", f"s{i % 3}", f"w{chr(97 + i % 20)} v{chr(97 + i % 7)} common") for i in range(120)]
    df = spark.createDataFrame(rows, "lang string, source string, text string")
    assert set(map(tuple, divergence.source_divergence(df, 2).collect())) == plain_divergence(rows, 2, 50)
