"""Order MinHash classes against all pairs on small tables."""
import random
from collections import defaultdict

import numpy as np
import pytest

from tidewright.llm import order_minhash as om


def edited(rng, words, changes):
    words = list(words)
    for _ in range(changes):
        at = rng.randrange(len(words))
        words[at : at + 1] = rng.choice([[f"new{rng.randrange(10**6)}"], [], [words[at], f"put{rng.randrange(10**6)}"]])
    return " ".join(words)


def corpus(seed=3):
    rng = random.Random(seed)
    fresh = lambda n: [f"w{rng.randrange(10**5)}" for _ in range(n)]
    passage = fresh(60)
    texts = []
    for _ in range(12):  # groups of near copies with more and more edits
        base = fresh(rng.randint(30, 200))
        texts += [" ".join(base)] * rng.randint(1, 3) + [edited(rng, base, k) for k in range(1, 9)]
    big = fresh(150)
    texts += [edited(rng, big, rng.randint(0, 6)) for _ in range(60)]
    texts += [" ".join(passage + fresh(rng.randint(20, 90))) for _ in range(50)]  # a shared passage alone makes no near copy
    texts += ["a b", "a b", "A, b!", "a b c d e", "a b c d e f", "same same same same same same same same", "", "", "...", "...", None, None, "x " * 30_000, "x " * 30_001]
    return texts


def by_hand(texts, k=5, threshold=0.8):
    known = [t for t in dict.fromkeys(texts) if t is not None]
    run, label, at = om.word_runs(known, k)
    holders = defaultdict(list)
    for n in range(len(known)):
        for x in label[at[n] : at[n + 1]].tolist():
            holders[x].append(n)
    pairs = {(a, b) for v in holders.values() for a in v for b in v if a < b}
    pairs = sorted(pairs)
    root = list(range(len(known)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    if pairs:
        sim = om.aligned([known[a] for a, _ in pairs], [known[b] for _, b in pairs], k, threshold)
        for (a, b), s in zip(pairs, sim):
            if s >= threshold:
                root[find(a)] = find(b)
    least = {}
    number = {t: n for n, t in enumerate(known)}
    for i, t in enumerate(texts):
        if t is not None:
            least.setdefault(find(number[t]), i)
    return {i: i if t is None else least[find(number[t])] for i, t in enumerate(texts)}


@pytest.mark.parametrize("small", [16, 2])
def test_classes_like_all_pairs(spark, monkeypatch, small):
    monkeypatch.setattr(om, "SMALL", small)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "n", 1, "b") for i, t in enumerate(texts)], "doc_id long, text string, node string, id int, body string")
    got = {r["id"]: r["class_id"] for r in om.classes(docs).collect()}
    assert got == by_hand(texts)


def family(singles, pairs, seed=11):
    """Texts of 500 words with 8 of 100 places changed; any two differ in 12 places or more (at most 0.79), the first ``pairs`` couples in 10 (0.81).

    Each change is found in many texts, so that the couples hardly meet in a small bucket."""
    rng = random.Random(seed)
    base = [f"w{i}" for i in range(500)]
    sets = []

    def fits(new, but=None):
        return all(len(new ^ s) >= 12 for s in sets if s is not but)
    while len(sets) < 2 * pairs:
        one = frozenset(rng.sample(range(100), 8))
        two = frozenset([*rng.sample(sorted(one), 3), *rng.sample(sorted(set(range(100)) - one), 5)])
        if fits(one) and fits(two):
            sets += [one, two]
    while len(sets) < 2 * pairs + singles:
        one = frozenset(rng.sample(range(100), 8))
        if fits(one):
            sets.append(one)
    return [" ".join(f"x{i}" if i % 5 == 2 and i // 5 in s else w for i, w in enumerate(base)) for s in sets]


@pytest.mark.parametrize("small, block", [(16, 1024), (2, 90)])
def test_couples_in_a_large_family(spark, monkeypatch, small, block):
    monkeypatch.setattr(om, "SMALL", small)
    monkeypatch.setattr(om, "BLOCK", block)
    texts = family(120, 80)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["id"]: r["class_id"] for r in om.classes(docs).collect()}
    assert got == {i: i - i % 2 if i < 160 else i for i in range(len(texts))}


def test_work_doubles_with_the_family(spark):
    """Texts that move for the comparison in full: at most one for each sketch of a member of a family below the threshold, whatever its pairs."""
    rng = random.Random(7)
    base = [f"w{i}" for i in range(300)]
    rows = []
    for size in (200, 400, 800):
        texts = [" ".join(f"x{i}" if i in s else w for i, w in enumerate(base)) for s in ({*rng.sample(range(300), 11)} for _ in range(size))]
        docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(3)
        named = docs.select("doc_id", om.node_of(om.F.col("text")).alias("node"), om.F.col("text").alias("body"))
        sketched = om.stored(om.sketch_rows(named.select("node", "body"), om.LEVEL, 5), "sketches")
        _, big = om.candidate_pairs(sketched, om.SMALL, om.SHARED, 0.8)
        none = spark.createDataFrame([], "node binary, root binary")
        rows.append(om.with_mates(om.open_blocks(big, none), sketched, om.SHARED, 0.8).count())
    assert all(size < n < om.LEVEL[0][1] * size for n, size in zip(rows, (200, 400, 800)))


def test_class_roots_and_links(spark):
    """Classes whose least ids are equal or null stay apart by root; the links of a class join its texts."""
    words = [f"w{i}" for i in range(60)]
    near = " ".join(words[:-1] + ["z"])
    rows = [(None, "one two three four five six"), (None, "alpha beta gamma delta epsilon"), (7, " ".join(words)), (7, near), (7, "other text of its own entirely"), (8, None)]
    got = om.classes(spark.createDataFrame(rows, "doc_id int, text string")).collect()
    assert len({r.root for r in got if r.root}) == 4 and len(got) == 6
    assert {(r.id, r.n_rows, r.n_links) for r in got} == {(None, 1, 0), (7, 2, 1), (7, 1, 0), (8, 1, 0)}


def test_alignment_is_a_longest_chain():
    rng = random.Random(8)
    for _ in range(60):
        base = [rng.choice("abcdefgh") for _ in range(rng.randint(5, 40))]
        other = edited(rng, base, rng.randint(0, 4))
        a, b = " ".join(base), other
        _, label, at = om.word_runs([a, b], 5)
        x, y = label[: at[1]].tolist(), label[at[1] :].tolist()
        best = np.zeros((len(x) + 1, len(y) + 1), int)
        for i, p in enumerate(x):
            for j, q in enumerate(y):
                best[i + 1, j + 1] = best[i, j] + 1 if p == q else max(best[i, j + 1], best[i + 1, j])
        m = int(best[-1, -1])
        want = m / (len(x) + len(y) - m) if x and y else 0
        got = om.aligned([a], [b], 5, 0.8)[0]
        assert (got >= 0.8) == (want >= 0.8) and (want < 0.8 or abs(got - want) < 1e-12)


def test_first_of_each(spark):
    rows = [(3, "one two three four five six"), (1, "one two three four five six"), (1, "one two three four five six"), (2, "else"), (4, None), (5, None), (None, "only here"), (6, ""), (7, "")]
    docs = spark.createDataFrame([(i, t, "k") for i, t in rows], "doc_id long, text string, row string")
    got = om.first_of_each(docs)
    assert got.columns == docs.columns
    assert sorted((r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "") for r in got.collect()) == sorted(
        [(False, 1, "one two three four five six"), (False, 2, "else"), (False, 4, ""), (False, 5, ""), (True, 0, "only here"), (False, 6, "")])
    assert om.first_of_each(docs.limit(0)).count() == 0


def test_first_of_each_with_null_and_shared_ids(spark):
    """Classes without an id, or with one id for several texts, stay apart."""
    words = lambda tag: " ".join(f"{tag}{i}" for i in range(40))
    rows = [(None, words(f"n{j}")) for j in range(6)] + [(7, words(f"s{j}")) for j in range(6)]
    rows += [(None, words("n0")), (7, words("s0")), (None, words("n1") + " more"), (3, words("n2")), (None, words("s1"))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted((r["doc_id"] or 0, r["text"].split()[0]) for r in om.first_of_each(docs).collect())
    assert got == sorted([(0, f"n{j}0") for j in (0, 1, 3, 4, 5)] + [(3, "n20")] + [(7, f"s{j}0") for j in range(6)])
    found = om.classes(docs)
    assert found.select("root").distinct().count() == 12


def test_components_of_chains_and_stars(spark):
    edges = [(k, k + 1) for k in range(1, 20)] + [(100, k) for k in range(101, 140)] + [(200, 200)]
    df = spark.createDataFrame([(bytes([a]), bytes([b])) for a, b in edges], "a binary, b binary")
    got = {r["node"][0]: r["root"][0] for r in om.components(df).collect()}
    assert got == {k: 1 for k in range(1, 21)} | {k: 100 for k in range(100, 140)}
