"""Near copies against brute force over five-word Jaccard similarity."""

import random
from itertools import combinations

import numpy as np
import pytest

import corpus_pipeline
from attesta.llm import near, simhash


def words(n, seed):
    r = random.Random(seed)
    return [f"w{r.randint(0, 3000)}" for _ in range(n)]


def edited(base, places):
    return [f"new{i}" if i in places else w for i, w in enumerate(base)]


def planted():
    """Copies with words replaced, cut and added, around and beyond the least similarity, and a
    chain and a crowd whose members are close to some of the others alone."""
    texts = []
    for i, n in enumerate((60, 100, 150, 400)):
        base = words(n, i)
        texts.append(base)
        for k in range(1, 8):
            texts.append(edited(base, random.Random(10 * i + k).sample(range(n), k)))
        texts += [base[6:], base + words(8, 90 + i), base[:n // 2]]
    chain = words(200, 50)
    for k in range(6):
        texts.append(chain)
        chain = edited(chain, {30 * k + 10, 30 * k + 20})
    crowd = words(150, 60)
    texts += [edited(crowd, random.Random(k).sample(range(150), 2)) for k in range(40)]
    texts += [words(80, 1000 + i) for i in range(10)]
    return [" ".join(t) for t in texts] + ["a b", "A  b", "a c", "", None, " "]


def brute_roots(texts):
    def shingles(t):
        own = (t or "").lower().split()
        return {tuple(own[i:i + 5]) for i in range(max(1, len(own) - 4))} if own else set()

    sets = [shingles(t) for t in texts]
    top = list(range(len(texts)))
    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 5 * len(a & sets[j]) >= 4 * len(a | sets[j]):
                old, new = max(top[i], top[j]), min(top[i], top[j])
                top = [new if t == old else t for t in top]
    return top


@pytest.mark.parametrize("rows, few", [(512, 6), (16, 0)])
def test_near_copies_equal_brute_force(spark, monkeypatch, rows, few):
    monkeypatch.setattr(near, "CELL_ROWS", rows)
    monkeypatch.setattr(near, "FEW", few)
    texts = planted()
    rows = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)],
                                 "doc_id long, text string, node string")
    got = {r["doc_id"]: r["root"] for r in near.near_copies(rows).collect()}
    first = {}
    for i in range(len(texts)):
        first.setdefault(got[i], i)
    expected = brute_roots(texts)
    assert [first[got[i]] for i in range(len(texts))] == expected
    assert 20 < len(set(expected)) < len(texts) - 60
    assert near.near_copies(rows.limit(0)).count() == 0


@pytest.mark.parametrize("few", [0, 100])
def test_cells_join_the_classes_that_alike_members_join(monkeypatch, few):
    monkeypatch.setattr(near, "FEW", few)
    r = random.Random(4)
    for trial in range(40):
        base = r.sample(range(1000), 40)
        sets = [np.array(sorted({x if r.random() < 0.94 else r.randint(2000, 9000) for x in base}), dtype=np.uint64)
                for _ in range(r.randint(1, 14))]
        roots = [f"r{r.randint(0, 9)}" for _ in sets]
        blocks = [r.randint(0, trial % 2) for _ in sets]
        cell = near.Cell()
        for b, root, s in zip(blocks, roots, sets):
            cell.add(b, root, s)
        two = len(set(blocks)) > 1
        top = {x: x for x in roots}
        for i in range(len(sets)):
            for j in range(i):
                a, b = set(sets[i].tolist()), set(sets[j].tolist())
                if 5 * len(a & b) >= 4 * len(a | b) and not (two and blocks[i] == blocks[j]):
                    old, new = sorted((top[roots[i]], top[roots[j]]))[::-1]
                    top = {k: new if v == old else v for k, v in top.items()}
        got = {x: x for x in roots}
        links = cell.links()
        for a, b in links:
            old, new = sorted((got[a], got[b]))[::-1]
            got = {k: new if v == old else v for k, v in got.items()}
        assert got == top and len(links) < max(1, len(got))


def test_pipeline_drops_edited_copies(spark):
    """Two words of a hundred replaced: ten shingles of five, and more than two bits of op4's
    digest."""
    base = words(100, 9)
    copies = [edited(base, {k, k + 30}) for k in (20, 40, 60)]
    texts = [" ".join(t) for t in (base, *copies, words(100, 8))]
    prints = [simhash.fingerprint(t) for t in texts[:4]]
    assert all((a ^ b).bit_count() > simhash.MOST_BITS for a, b in combinations(prints, 2))
    rows = spark.createDataFrame([(i, t, i) for i, t in enumerate(texts)],
                                 "doc_id long, text string, root int")
    left = corpus_pipeline.drop_near_duplicates(spark, rows, "")
    assert left.columns == rows.columns
    assert sorted(r["doc_id"] for r in left.collect()) == [0, 4]


def test_candidates_come_from_simhash_fingerprints(spark, monkeypatch):
    """Near copies at the least similarity differ in few bits, others in many, and what differs
    in more bits than allowed is not linked whatever its sets are."""
    r = np.random.default_rng(5)
    for n, alike in ((9, 8), (90, 80), (900, 800), (3 * near._PART, 3 * near._PART - 600)):
        a = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        b = np.unique(np.concatenate([a[:alike], r.integers(0, 1 << 63, n - alike, dtype=np.uint64)]))
        c = np.unique(r.integers(0, 1 << 63, n, dtype=np.uint64))
        x, y, z = (near.fingerprint(s) for s in (a, b, c))
        assert len(x) * 64 == near.PIECES * near.BITS
        assert np.bitwise_count(x ^ y).sum() <= near.MOST_BITS < np.bitwise_count(x ^ z).sum()
        # The weighted vote, added up without any shortcut.
        total = np.zeros((near.PIECES, near.BITS))
        for votes, weights in zip(*(v.T for v in near._drawn(a, near._FACTORS))):
            signs = np.unpackbits(votes[:, None], axis=1, bitorder="little") * 2.0 - 1
            total += weights[:, None].astype(float) * signs
        assert (np.packbits(total > 0, axis=1, bitorder="little").ravel().view("<i8") == x).all()
    base = words(100, 9)
    texts = [" ".join(t) for t in (base, edited(base, {20, 50}), edited(base, {40, 70}))]
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    classes = lambda: len({x["root"] for x in near.near_copies(rows).collect()})
    assert classes() == 1
    monkeypatch.setattr(near, "MOST_BITS", -1)
    assert classes() == 3


def test_pipeline_moves_texts_once_to_the_decisions(spark):
    rows = spark.createDataFrame([(1, "a b c d e f"), (1, "a b c d e f"), (2, "a b c d e f"), (None, "x y"),
                                  (None, "x y")], "doc_id long, text string")
    left = corpus_pipeline.drop_near_duplicates(spark, rows, "")
    assert sorted(map(tuple, left.collect()), key=str) == [(1, "a b c d e f"), (None, "x y")]
    plan = left._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Join") == 1 and "Union" not in plan
