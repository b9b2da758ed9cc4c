import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

import corpus_pipeline
from evtrail.llm import simhash
from evtrail.llm.common import connected_components
from evtrail.llm.exact_dedup import drop_exact_copies, progressive_exact_dedup
from tests.llm.helpers import PROSE, SPACE, docs, frame, odd_texts, words_of


def test_exact_dedup_against_brute_force(spark):
    got = progressive_exact_dedup(docs(spark), digest_all=True).collect()
    rows = odd_texts()
    assert len(got) == len(rows)
    groups = defaultdict(list)
    for i, t in rows:
        groups[hashlib.sha256(SPACE.sub("", t or "").encode()).hexdigest()].append((i, len(t or "")))
    for r in got:
        g = groups[r.text_sha256]
        assert r.group_size == len(g)
        top = max(g, key=lambda x: (x[1], x[0] is not None, -(x[0] or 0)))
        assert r.keep_id == top[0]
    for sha, g in groups.items():
        assert sum(r.kept for r in got if r.text_sha256 == sha) == 1
    assert [r.doc_id for r in got if r.kept and r.group_size == 5] == [3]      # the longest original stays


@pytest.mark.parametrize("kind,least,other", [("long", -(2 ** 63), 5), ("string", "a1", "b"), ("double", -1.5, 0.0)])
def test_exact_dedup_of_any_ids(spark, kind, least, other):
    rows = [(other, "same text"), (least, "sametext "), (None, "same text"), (other, "same text"), (least, "else")]
    got = progressive_exact_dedup(spark.createDataFrame(rows, f"doc_id {kind}, text string").repartition(2)).collect()
    same = [r for r in got if r.group_size == 4]
    assert {r.keep_id for r in same} == {min(least, other)} and sum(r.kept for r in same) == 1
    assert [(r.doc_id, r.keep_id, r.kept) for r in got if r.group_size == 1] == [(least, least, True)]


def test_exact_dedup_refines_only_what_collides(spark):
    rows = [(1, "alpha"), (2, "alphb"), (3, "a l p h a"), (4, "longer text")]
    got = {r.doc_id: r for r in progressive_exact_dedup(frame(spark, rows)).collect()}
    assert got[4].text_sha256 is None and got[1].text_sha256 == got[3].text_sha256 is not None
    assert (got[1].keep_id, got[1].kept, got[3].kept, got[2].kept) == (3, False, True, True)


def test_exact_dedup_long_common_prefix(spark):
    stem = "same " * 200
    rows = [(i, stem + str(i % 3)) for i in range(9)]
    got = {r.doc_id: r.keep_id for r in progressive_exact_dedup(frame(spark, rows)).collect()}
    assert got == {i: i % 3 for i in range(9)}


def test_dedup_of_empty_tables(spark):
    empty = frame(spark, [])
    assert progressive_exact_dedup(empty).count() == 0
    assert simhash.simhash_components(empty).count() == 0
    assert drop_exact_copies(empty).columns == empty.columns
    assert simhash.drop_near_copies(empty).count() == 0


def test_dropping_keeps_columns_null_ids_and_one_of_each(spark):
    d = docs(spark)
    out = drop_exact_copies(d)
    assert out.columns == d.columns
    ids = sorted(r.doc_id for r in out.collect() if r.doc_id is not None)
    assert 3 in ids and 1 not in ids and 2 not in ids and 6 not in ids and 5 not in ids and 7 in ids
    assert sum(r.doc_id is None for r in out.collect()) == 2
    near = simhash.drop_near_copies(d)
    assert near.columns == d.columns and 1 in {r.doc_id for r in near.collect()}


def test_pipeline_keeps_one_of_each_group_whatever_the_ids(spark):
    rows = [(1, PROSE), (1, PROSE), (2, PROSE + "  "), (2, "some other words entirely"), (None, PROSE),
            (None, "a text without id"), (None, "a text without id"), (3, "some other words entirely"),
            (None, PROSE.replace("quick", "swift"))]
    d = frame(spark, rows).repartition(3)
    out = corpus_pipeline.exact_dedup(spark, d, "")
    assert out.columns == d.columns
    assert sorted((str(r.doc_id), r.text) for r in out.collect()) == sorted(
        [("2", PROSE + "  "), ("2", "some other words entirely"), ("None", "a text without id"),
         ("None", PROSE.replace("quick", "swift"))])
    near = corpus_pipeline.simhash_dedup(spark, d, "")
    assert near.columns == d.columns
    groups = defaultdict(list)
    for label, (i, t) in zip(plain_labels([(i, plain_fingerprint(t)) for i, t in rows]), rows):
        groups[label].append((i is None, i or 0))
    assert Counter(str(r.doc_id) for r in near.collect()) == Counter(
        "None" if min(g)[0] else str(min(g)[1]) for g in groups.values())
    for stage in (corpus_pipeline.exact_dedup, corpus_pipeline.simhash_dedup):
        assert stage(spark, frame(spark, []), "").count() == 0


def plain_labels(prints):
    """Position of the first member of each one's component."""
    up = list(range(len(prints)))
    for i, (_, a) in enumerate(prints):
        for j, (_, b) in enumerate(prints):
            if (a ^ b).bit_count() <= 4:
                x, y = up[i], up[j]
                up = [min(x, y) if u in (x, y) else u for u in up]
    return up


def plain_fingerprint(text):
    from xxhash import xxh64_intdigest
    w = words_of(text)
    shingles = [" ".join(w[i:i + 4]) for i in range(max(1, len(w) - 3))] if w else []
    h = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def plain_components(prints):
    """{(position): least id} over pairs of at most four bits."""
    n = len(prints)
    up = list(range(n))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x
    for i in range(n):
        for j in range(i):
            if (prints[i][1] ^ prints[j][1]).bit_count() <= 4:
                up[find(i)] = find(j)
    least = defaultdict(list)
    for i, (doc, _) in enumerate(prints):
        least[find(i)].append(doc)
    return [min((x for x in least[find(i)] if x is not None), default=None) for i in range(n)]


def test_simhash_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(simhash, "_CHUNK", 1000)       # chunk borders inside a text
    rows = odd_texts()
    want = [(i, plain_fingerprint(t)) for i, t in rows]
    comp = plain_components(want)
    got = simhash.simhash_components(docs(spark)).collect()
    assert sorted((str(r.doc_id), r.fingerprint, str(r.component_id)) for r in got) == sorted(
        (str(i), f"{f:016x}", str(c)) for (i, f), c in zip(want, comp))


def test_golay_keys_find_every_pair_within_four_bits():
    rng = random.Random(5)
    base = np.array([rng.getrandbits(64) for _ in range(400)], np.uint64)
    for bits in range(5):
        flip = np.array([sum(1 << b for b in rng.sample(range(64), bits)) for _ in base], np.uint64)
        keys = []
        for fp in (base, base ^ flip):
            who, key = simhash.fuzzy_keys(fp)
            own = defaultdict(set)
            for w, k in zip(who.tolist(), key.tolist()):
                own[w].add(k)
            keys.append(own)
        assert all(keys[0][i] & keys[1][i] for i in range(len(base)))


def test_golay_code_is_perfect():
    _, leader, near = simhash._tables()
    assert (leader >= 0).all()
    assert sorted(set((near >= 0).sum(1).tolist())) == [0, 5]


def test_bucket_links_span_the_exact_components():
    rng = random.Random(7)
    fp = set()
    for _ in range(12):
        x = rng.getrandbits(64)
        for _ in range(25):
            fp.add(x)
            x ^= sum(1 << b for b in rng.sample(range(64), 3))
    fp = sorted(fp)
    links = simhash.bucket_links(np.array(fp, np.uint64))
    assert len(links) < len(fp)
    want = plain_components(list(enumerate(fp)))
    up = list(range(len(fp)))
    for a, b in links:
        assert (fp[a] ^ fp[b]).bit_count() <= 4
        a, b = up[a], up[b]
        up = [min(a, b) if x in (a, b) else x for x in up]
    assert up == want


def test_hot_keys_are_split_without_losing_links(spark):
    rng = random.Random(3)
    prints = sorted({rng.getrandbits(20) for _ in range(300)})          # two segments equal everywhere
    df = spark.createDataFrame([(p,) for p in prints], "fp long")
    found = []
    for limit in (10_000, 20):
        keys = simhash._split_hot(df.mapInArrow(simhash._key_batches, "key long, fp long"), limit)
        links = (keys.repartition("key").sortWithinPartitions("key")
                 .mapInArrow(simhash._link_batches(4), "a long, b long").distinct())
        comp = {r.node: r.root for r in connected_components(links).collect()}
        found.append([comp.get(p, p) for p in prints])
    want = plain_components([(p, p) for p in prints])
    by = lambda labels: sorted(sorted(i for i, x in enumerate(labels) if x == y) for y in set(labels))
    assert by(found[0]) == by(found[1]) == by(want)


def test_connected_components_of_chains_stars_and_nothing(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 60)] + [(7, 7)]
    df = spark.createDataFrame(edges, "a long, b long")
    got = {r.node: r.root for r in connected_components(df).collect()}
    assert got == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(60)}}
    assert connected_components(spark.createDataFrame([], "a long, b long")).count() == 0
