import random
import re

import numpy as np
import pytest

from tesserae.llm import jaccard as J


def sets_of(texts, width):
    out = []
    for t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", "".join(c.lower() if c.isascii() else c for c in t or ""))
        n = len(words)
        out.append({tuple(words[i : i + width]) for i in range(n - width + 1)} if n >= width else ({tuple(words)} if n else set()))
    return out


def brute(texts, width, percent):
    sets = sets_of(texts, width)
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] and sets[j] and 100 * both >= percent * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [(i, len(s), find(i)) for i, s in enumerate(sets)]


def corpus(seed=2):
    r = random.Random(seed)
    vocab = ["".join(r.choices("abcdefgÄéx", k=r.randint(1, 6))) for _ in range(800)]
    make = lambda k: r.choices(vocab, k=k)
    texts = [None, "", " \n\t ", "one", "ONE", "one two three", "One  two\nthree", "a b c d"]
    passage = make(40)
    families = [make(r.choice([30, 60, 120])) for _ in range(12)]
    chain = make(100)
    for k in range(20):  # each step a few words further from the first
        chain = list(chain)
        chain[5 * k : 5 * k + 1] = ["step"]
        texts.append(" ".join(chain))
    for _ in range(260):
        base = list(r.choice(families))
        for _ in range(r.choice([0, 1, 1, 2, 3, 6])):
            base[r.randrange(len(base))] = r.choice(vocab)
        texts.append(" ".join(base))
    texts += [" ".join(make(r.randint(5, 60)) + passage) for _ in range(60)]
    return texts


@pytest.mark.parametrize("width,percent,block,exact", [(4, 85, 256, False), (5, 80, 8, False), (4, 85, 8, True)])
def test_against_brute_force(spark, monkeypatch, width, percent, block, exact):
    monkeypatch.setattr(J, "BLOCK", block)
    texts = corpus()
    docs = spark.createDataFrame([(i, t, "k") for i, t in enumerate(texts)], "doc_id long, text string, node string")
    conf = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(conf)
    got = sorted(tuple(r) for r in J.near_duplicates(docs, width, percent, exact).collect())
    assert got == brute(texts, width, percent)
    assert spark.conf.get(conf) == before


def test_first_shingles_of_similar_sets_meet():
    r = np.random.default_rng(6)
    levels = r.integers(0, 9, 1 << J.SKETCH_BITS).astype(np.uint16)
    for _ in range(300):
        pool = r.integers(0, 1 << 63, int(r.integers(1, 60)), np.uint64) * np.uint64(2)
        a, b = (np.unique(pool[r.random(len(pool)) < 0.93]) for _ in range(2))
        both = len(np.intersect1d(a, b))
        if both and 100 * both >= 85 * (len(a) + len(b) - both):
            assert len(np.intersect1d(J.first_shingles(a, levels, 85), J.first_shingles(b, levels, 85)))


def test_repeated_and_null_ids(spark):
    r = random.Random(9)
    a, b = (" ".join("".join(r.choices("abcdef", k=5)) for _ in range(60)) for _ in range(2))
    more = "one more word in a text of its own without a twin".split()
    rows = [(1, a), (1, b), (6, b + " more"), (9, a.upper() + " end"), (None, a + " last"), (None, " ".join(more)), (7, None), (7, ""), (4, "x y"), (4, "x y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(map(tuple, J.near_duplicates(docs).collect()), key=str)
    n = [len(s) for s in sets_of([t for _, t in rows], 4)]
    want = [1, 1, 1, 1, 1, None, 7, 7, 4, 4]
    assert got == sorted([(i, n[k], want[k]) for k, (i, _) in enumerate(rows)], key=str)


def test_one_of_each(spark):
    r = random.Random(10)
    a, b, c = (" ".join("".join(r.choices("abcdef", k=5)) for _ in range(80)) for _ in range(3))
    rows = [(1, a, "k", 0), (1, b, "k", 1), (6, b + " more", "k", 2), (None, a + " last", "k", 3), (None, c, "k", 4), (None, c, "k", 5),
            (7, None, "k", 6), (7, None, "k", 6), (8, "", "k", 7), (4, "x y", "k", 8), (4, "x y", "k", 8), (3, "x y", "k", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, node string, th int")
    out = J.one_of_each(docs)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)
    assert got == sorted([(1, a), (1, b), (None, c), (7, None), (7, None), (8, ""), (3, "x y")], key=str)


def test_common_shingles_keep_links(spark):
    """A passage in most documents, one family of many copies with small changes, texts of common words only."""
    r = random.Random(11)
    words = ["".join(r.choices("abcdefgh", k=4)) for _ in range(500)]
    passage = r.choices(words, k=50)
    base = r.choices(words, k=90)
    texts = [" ".join(passage), " ".join(passage[:49] + ["end"]), " ".join(passage[1:])]
    for _ in range(150):
        w = list(base)
        for _ in range(r.randrange(4)):
            w[r.randrange(90)] = r.choice(words)
        texts.append(" ".join(w))
    texts += [" ".join(r.choices(words, k=r.randint(5, 40)) + passage + r.choices(words, k=r.randint(0, 9))) for _ in range(120)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for exact in (False, True):
        assert sorted(tuple(r) for r in J.near_duplicates(docs, exact=exact).collect()) == brute(texts, 4, 85)


def test_trees_lose_no_pair():
    r = np.random.default_rng(4)
    base = r.integers(0, 1 << 62, 200, np.uint64)
    sets = []
    for _ in range(70):
        s = base.copy() if r.random() < 0.5 else r.integers(0, 1 << 62, int(r.integers(20, 300)), np.uint64)
        n = int(r.integers(0, 40))
        s[:n] = r.integers(0, 1 << 62, min(n, len(s)), np.uint64) if n <= len(s) else s[:n]
        sets.append(np.unique(s))
    tree = J.SignatureTree(
        np.array([len(s) for s in sets]), np.stack([np.frombuffer(J.bitmap(s), np.uint8) for s in sets])
    )
    found = set(zip(*(x.tolist() for x in J.traverse(tree, tree, 85)), strict=True))
    for i, a in enumerate(sets):
        for j, b in enumerate(sets):
            both = len(np.intersect1d(a, b))
            if 185 * both >= 85 * (len(a) + len(b)):
                assert (i, j) in found


def test_empty_table(spark):
    assert J.near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_groups_of_one_leader_are_compared_once(spark):
    """Twelve keys over nearly the same sixty nodes; the pairs of a node's groups stay together."""
    from tesserae.llm.common import Scratch

    rows = [(key, node, 0) for key in range(12) for node in range(60) if node == 0 or (node + key) % 20]
    rows += [(100 + key, node, 1000) for key in range(2) for node in [1000, *range(1001 + 50 * key, 1051 + 50 * key)]]  # apart but for the leader
    members = spark.createDataFrame(rows, "key long, node long, leader long")
    nodes = sorted({r[1] for r in rows})
    labels = spark.createDataFrame([(n, n) for n in nodes], "node long, component long")
    sets = spark.createDataFrame([(n, 100) for n in nodes], "node long, n_shingles long")
    scratch = Scratch(spark)
    found = J._blocks(members, labels, sets, scratch).select("key", "node").distinct().collect()
    scratch.drop()
    groups: dict[int, set[int]] = {}
    for r in found:
        groups.setdefault(r["key"], set()).add(r["node"])
    assert len(found) == 60 + 2 * 51  # was 12 keys of 57 or 58 nodes
    before: dict[int, set[int]] = {}
    for key, node, _ in rows:
        before.setdefault(key, set()).add(node)
    assert all(any(one <= other for other in groups.values()) for one in before.values())


def test_near_copies_make_no_row_for_each_pair(spark, monkeypatch):
    """One text with a few words changed in each copy: the rows dealt into blocks follow the copies, not their pairs."""
    monkeypatch.setattr(J, "BLOCK", 16)
    r = random.Random(12)
    base = [f"w{k}" for k in range(100)]
    texts = []
    for _ in range(480):
        w = list(base)
        for k in r.sample(range(100), r.choice([0, 1, 1, 2, 3, 4])):
            w[k] = f"x{r.randrange(10**9)}"
        texts.append(" ".join(w))
    texts += [t + " and these few more words at its end" for t in texts[:6]]
    dealt, by_trees = [], J._by_trees

    def counting(rows, *args):
        dealt.append(rows.count())
        return by_trees(rows, *args)

    monkeypatch.setattr(J, "_by_trees", counting)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(tuple(x) for x in J.near_duplicates(docs).collect()) == brute(texts, 4, 85)
    assert dealt[1] < 8 * len(texts), dealt  # was 48 times
