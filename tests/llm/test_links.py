"""Near-duplicate operators beside all pairs: thresholds, crowds of near copies, repeated and null ids."""

import random
from collections import defaultdict

import numpy as np
import pytest


from tests.llm.brute import jaccard_components, shingle_set
from tests.llm.test_operators import awkward, frame  # noqa: F401
from vigilgrid.llm import jaccard, links, minhash


@pytest.fixture(scope="module")
def crowd(awkward):  # noqa: F811
    """Families whose members lie on both sides of the thresholds, and many texts around one passage."""
    rng = random.Random(11)
    rows = [(i, t) for i, t in awkward if i is not None]
    for g in range(5):
        base = [f"w{rng.randint(0, 300)}" for _ in range(rng.choice([30, 90, 400]))]
        for c in range(16):
            now = list(base)
            for _ in range(rng.randint(0, max(1, len(base) // 40))):
                now[rng.randrange(len(now))] = f"e{rng.random()}"
            rows.append((100 + 20 * g + c, " ".join(now)))
    passage = [f"p{i}" for i in range(60)]
    for i in range(60):
        own = [f"o{i}_{k}" for k in range(rng.randint(3, 30))]
        rows.append((400 + i, " ".join(own[:2] + passage + own[2:])))
    return rows


@pytest.mark.parametrize("rounds", [1, 3])
def test_minhash_components(spark, crowd, monkeypatch, rounds):
    monkeypatch.setattr(links, "ROUNDS", rounds)
    got = {r.id: (r.n_shingles, r.component_id, r.kept) for r in minhash.linked(frame(spark, crowd)).collect()}
    assert got == {i: (n, c, i == c) for i, (n, c) in jaccard_components(crowd, 85).items()}


def test_jaccard_components_of_a_crowd(spark, crowd):
    got = {r.id: (r.n_shingles, r.component_id) for r in jaccard.linked(frame(spark, crowd)).collect()}
    assert got == jaccard_components(crowd)


def test_collections_meet_as_promised():
    rng = np.random.default_rng(0)
    missed = 0
    for _ in range(300):
        shared, own = rng.integers(0, 1 << 63, 920, dtype=np.uint64), rng.integers(0, 1 << 63, (2, 80), dtype=np.uint64)
        a, b = (np.concatenate([shared, o]) for o in own)
        keys = minhash.collection_keys(np.concatenate([a, b]), np.array([len(a), len(b)]))
        same = keys[0] == keys[1]
        missed += not (same[0::2].any() and same[1::2].any())
    assert missed == 0


def test_bitmaps_never_exclude_a_link():
    rng = np.random.default_rng(1)
    for _ in range(200):
        a = np.unique(rng.integers(0, 400, rng.integers(1, 300)).astype(np.uint64))
        b = np.unique(np.concatenate([a[:rng.integers(0, len(a) + 1)], rng.integers(0, 400, rng.integers(1, 40)).astype(np.uint64)]))
        bits = links.parities(np.concatenate([a, b]), np.array([len(a), len(b)])).view(np.uint64)
        assert np.bitwise_count(bits[0] ^ bits[1]).sum() <= len(np.setxor1d(a, b))


def test_nothing_to_link(spark):
    for rows in ([], [(1, None)], [(1, "a b"), (2, "c d e f g h i")]):
        got = {r.id: (r.component_id, r.kept) for r in minhash.linked(frame(spark, rows)).collect()}
        assert got == {i: (i, True) for i, _ in rows}


def test_representatives_with_repeated_and_null_ids(spark):
    rng = random.Random(2)
    texts = [" ".join(f"{k}{rng.randint(0, 500)}" for _ in range(60)) for k in "abcdefgh"]
    near = [t + " tail" for t in texts]
    rows = [(1, texts[0]), (2, near[0]), (2, texts[1]), (2, texts[1]),  # id 2 goes for one text and stays for the other
            (3, texts[2]), (3, near[2]),  # similar texts under one id: one stays
            (None, texts[3]), (4, near[3]), (None, texts[4]), (None, near[4]), (None, texts[5]),  # null ids link as others do
            (5, None), (5, None), (None, ""), (6, " ")]
    kept = [(r.doc_id, r.text) for r in jaccard.representatives(frame(spark, rows)).collect()]
    parts = defaultdict(list)
    for group, (i, t) in zip([0, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5], rows):
        parts[group].append((i, t))
    assert jaccard.representatives(frame(spark, rows)).columns == frame(spark, []).columns
    assert sorted(map(str, kept[:0] + [k for k in kept if not shingle_set(k[1])])) == sorted(map(str, rows[11:]))
    rest = [k for k in kept if shingle_set(k[1])]
    assert len(rest) == len(parts)
    for members in parts.values():
        (own,) = [k for k in rest if k in members]
        ids = [i for i, _ in members if i is not None]
        assert own[0] == (min(ids) if ids else None)
    ids = {(r.id, r.n_shingles): r.component_id for r in jaccard.linked(frame(spark, rows)).collect()}
    assert ids[(None, 56)] in (4, None)
