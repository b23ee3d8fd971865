import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from tesserae.llm import suffix_dedup as S


def brute(texts, length):
    where = Counter()
    for t in texts:
        where.update(t[i : i + length] for i in range(len(t) - length + 1))
    out = []
    for t in texts:
        gone = np.zeros(len(t), bool)
        for i in range(len(t) - length + 1):
            if where[t[i : i + length]] > 1:
                gone[i : i + length] = True
        runs = int(np.count_nonzero(np.diff(gone.astype(int), prepend=0) == 1))
        out.append((len(t), int(gone.sum()), runs, hashlib.sha256(np.frombuffer(t, np.uint8)[~gone].tobytes()).hexdigest()))
    return out


def corpus(seed=1, n=120):
    r = random.Random(seed)
    words = ["".join(r.choices("abcdeéß\0 ", k=r.randint(1, 9))) for _ in range(300)]
    make = lambda k: " ".join(r.choices(words, k=k))
    passages = [make(25) for _ in range(5)]
    base = make(80)
    texts = [None, "", "short", "und " * 200, "und " * 150, base]
    for _ in range(n):
        kind = r.random()
        if kind < 0.3:
            texts.append(make(r.randint(5, 60)) + r.choice(passages) + make(r.randint(5, 60)))
        elif kind < 0.5:
            i = r.randrange(len(base))
            texts.append(base[:i] + r.choice("xyz") + base[i + 1 :])
        elif kind < 0.6:
            texts.append(texts[r.randrange(3, len(texts))])
        else:
            texts.append(make(r.randint(1, 120)))
    return texts


def test_suffix_array_and_prefixes():
    r = random.Random(3)
    texts = [bytes(r.choices(b"ab", k=r.randint(1, 60))) for _ in range(20)]
    data = np.frombuffer(b"".join(texts), np.uint8)
    stops = np.cumsum([len(t) for t in texts])
    sizes = np.array([len(t) for t in texts])
    ends = np.repeat(stops, sizes)
    order = S.suffix_array(data, ends, 64)
    suffixes = [bytes(data[i : ends[i]]) for i in order]
    assert suffixes == sorted(suffixes)
    prefix = S.common_prefixes(data, ends, order)
    for k in range(1, len(order)):
        a, b = suffixes[k - 1], suffixes[k]
        n = next((i for i, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
        assert prefix[k] == n


@pytest.mark.parametrize("block", [256, 3])
def test_against_brute_force(spark, monkeypatch, block):
    monkeypatch.setattr(S, "BLOCK_PIECES", block)
    monkeypatch.setattr(S, "SHARD_BYTES", 2000)
    monkeypatch.setattr(S, "LONG_BYTES", 150 if block == 3 else 10_000)
    texts = corpus()
    length = 60
    rows = [(i, t, "x", "clash") for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, tk string, place string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in S.digest(docs, length).collect()}
    want = brute([(t or "").encode() for t in texts], length)
    assert [got[i] for i in range(len(texts))] == want
    assert sum(w[1] for w in want) > 1000


@pytest.mark.parametrize("length", [60, 400])
def test_repeats_within_one_piece(spark, length):
    r = random.Random(8)
    line = "".join(r.choices("abcdefgh ", k=length // 7))
    plain = ["".join(r.choices("klmnop ", k=3 * length)) for _ in range(3)]
    texts = ["a" * (length + 1), line * 9, f"{plain[0]}{'Rech. ' * (length // 4)}{plain[1]}", plain[2], "b" * length]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: tuple(r)[1:5] for r in S.digest(docs, length).collect()}
    want = brute([t.encode() for t in texts], length)
    assert [got[i] for i in range(len(texts))] == want
    assert [w[1] > 0 for w in want] == [True, True, True, False, False]


def test_pieces_that_repeat_within_themselves_are_flagged():
    r = random.Random(5)
    for _ in range(60):
        texts = [bytes(r.choices(b"ab", k=r.randint(20, 40)) * r.randint(1, 30))[:900].ljust(20, b"c") for _ in range(4)]
        data = np.frombuffer(b"".join(texts), np.uint8)
        stops = np.cumsum([len(t) for t in texts])
        grams = S.gram_hashes(data, S.gram_of(20))
        for _, a, n, h, twice in zip(*S.find_pieces(data, stops, 20), strict=True):
            assert twice == (np.count_nonzero(grams[a : a + n + 20 - S.gram_of(20)] == h) > 1)


def test_clashing_columns_and_repeated_ids(spark):
    r = random.Random(2)
    long = "".join(r.choices("abcdef é", k=300))
    names = ["tk", "spans", "kept", "n_removed", "n_bytes", "n_spans", "row", "h", "copies", "asked"]
    rows = [(None, long + "x" * 9, *names), (None, "other " + long, *names), (1, "plain", *names), (1, long[:90] + "q", *names), (2, None, *names)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, " + ", ".join(f"`{n}` string" for n in names))
    out = S.clean_texts(docs, 60)
    assert out.columns == docs.columns
    got = sorted(((r["doc_id"], r["text"], r["kept"]) for r in out.collect()), key=str)
    assert got == sorted([(None, "x" * 9, "kept"), (None, "other ", "kept"), (1, "plain", "kept"), (1, "q", "kept"), (2, None, "kept")], key=str)


def test_empty_table(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert S.digest(docs).count() == 0
