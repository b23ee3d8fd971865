"""Every stage of the pipeline against a plain version of it, on what the stage before kept."""

import random
import re

import numpy as np
import pytest
from test_jaccard import brute as components
from test_small_operators import BLANK

import corpus_pipeline as P
from tesserae.llm import quality_lm


def corpus():
    r = random.Random(12)
    syllables = ["the", "of", "an", "er", "on", "ti", "re", "nd"]
    word = lambda: "".join(r.choices(syllables, k=r.randint(1, 4)))
    make = lambda k: " ".join(word() for _ in range(k)) + "."
    passage = make(70)
    clean = [make(r.randint(40, 120)) for _ in range(120)]
    near = [re.sub(r"\S+", "changed", clean[k], count=1) for k in range(10)]
    shared = [f"{make(40)} {passage} {make(40)}" for _ in range(6)]
    noise = ["".join(chr(r.randint(33, 126)) for _ in range(400)) for _ in range(8)]
    return [*clean, *near, clean[3], *shared, *noise, None, "", "é" * 600, "é" * 600]


@pytest.fixture(scope="module")
def sf_dir(spark, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("sf"))
    rows = [(i, t, ["en", "fr"][i % 2], f"src{i % 4}", len(t or "")) for i, t in enumerate(corpus())]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{path}/documents.parquet")
    labels = [(i, 1, 0) for i in range(0, 120, 2)] + [(i, 1, 0) for i in range(1, 60, 2)]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{path}/labels.parquet")
    return path


def test_stages(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    columns, kept, seen = docs.columns, {}, {}
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, sf_dir), name)
        seen[name] = docs
        if name != "best_fit_packing":
            assert docs.columns == columns
            kept[name] = {r["doc_id"]: r["text"] for r in docs.collect()}
    texts = corpus()
    n = len(texts)
    noise = set(range(137, 145))
    first = kept["quality_classifier"]
    assert not noise & set(first) and len(set(range(137)) - set(first)) <= 2

    ids = sorted(first)
    groups = components([first[i] for i in ids], 5, 80)
    want = {ids[k] for k, _, c in groups if k == c}
    assert set(kept["near_duplicates"]) == want and len(want) < len(ids)

    before = kept["near_duplicates"]
    raw = {i: (t or "").encode() for i, t in before.items()}
    where = {}
    for t in raw.values():
        for a in range(len(t) - P.PASSAGE_BYTES + 1):
            key = t[a : a + P.PASSAGE_BYTES]
            where[key] = where.get(key, 0) + 1
    after = {}
    for i, t in raw.items():
        gone = np.zeros(len(t), bool)
        for a in range(len(t) - P.PASSAGE_BYTES + 1):
            if where[t[a : a + P.PASSAGE_BYTES]] > 1:
                gone[a : a + P.PASSAGE_BYTES] = True
        rest = np.frombuffer(t, np.uint8)[~gone].tobytes()
        if not gone.any():
            after[i] = t
        elif rest:
            after[i] = rest.decode("utf-8", "ignore").encode()
    assert {i: (t or "").encode() for i, t in kept["suffix_array_dedup"].items()} == after
    assert after != raw

    words = {i: len(re.findall(BLANK, t or "")) for i, t in kept["suffix_array_dedup"].items()}
    mixed = kept["mixing"]
    assert set(mixed) <= set(words) and mixed.items() <= kept["suffix_array_dedup"].items()
    assert 0.8 * sum(words.values()) <= sum(words[i] for i in mixed) <= 0.9 * sum(words.values())
    packed = seen["best_fit_packing"].collect()
    assert {r["doc_id"] for r in packed} == set(mixed)
    assert n == 149


def test_passages_of_short_words(spark):
    r = random.Random(4)
    make = lambda k: " ".join("".join(r.choices("abcdefg", k=r.randint(1, 4))) for _ in range(k))
    fit = lambda k: next(t for t in iter(lambda: make(k), "") if len(t) < 200)
    over, under, twin = fit(51), fit(50), fit(52)
    texts = [
        *(f"{make(30)}\n{p} {make(30)}" for p in (over, over, under, under)),
        twin, twin, "é " + over, "x" + under + " end", "i " * 52, "i " * 51, "q " * 50, None, "",
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in P.repeated_passages(spark, docs, "").collect()}
    raw = [(t or "").encode() for t in texts]
    words = [[m.span() for m in re.finditer(BLANK.encode(), t)] for t in raw]
    spans = [[(w[k][0], w[k + 50][1]) for k in range(len(w) - 50)] for w in words]
    seen = [t[a:b] for t, s in zip(raw, spans, strict=True) for a, b in s]
    want = {}
    for i, (t, s) in enumerate(zip(raw, spans, strict=True)):
        gone = np.zeros(len(t), bool)
        for a, b in s:
            gone[a:b] |= seen.count(t[a:b]) > 1
        rest = np.frombuffer(t, np.uint8)[~gone].tobytes().decode()
        if rest or not gone.any():
            want[i] = rest
    assert {i: t or "" for i, t in got.items()} == want
    assert over not in "".join(want.values()) and want[2] == texts[2] and want[10] == texts[10] and 4 not in want


def test_run(spark, sf_dir):
    assert P.run(spark, sf_dir).count() > 50


def test_empty_documents(spark, sf_dir, tmp_path):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").limit(0)
    for name, stage in P.STAGES:
        docs = P.materialize(stage(spark, docs, sf_dir), name)
        assert docs.count() == 0


def test_model_counts_all_trusted_text(spark, sf_dir):
    docs, labels = spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet")
    n = quality_lm.trusted_counts(quality_lm.slabs(docs), labels).groupBy().sum("n").first()[0]
    trusted = {r["doc_id"] for r in labels.collect()}
    assert n == sum(len(t.encode()) for i, t in enumerate(corpus()) if i in trusted)


def test_stages_with_nulls_repeats_and_clashing_names(spark, sf_dir):
    r = random.Random(7)
    make = lambda: " ".join("".join(r.choices("abcdefghi", k=5)) for _ in range(60))
    a, b, c = make(), make(), make()
    names = ["th", "tk", "node", "kept", "step", "spans", "n_tokens", "epoch", "text_md5", "sid", "row"]
    rows = [(None, a), (None, b), (5, b + " end"), (5, c), (5, c), (6, None), (7, "")]
    docs = spark.createDataFrame(
        [(i, t, None, None, len(t or ""), *names) for i, t in rows],
        "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names),
    )
    columns = docs.columns
    for name, stage in P.STAGES[:4]:
        docs = P.materialize(stage(spark, docs, sf_dir), name)
        assert docs.columns == columns
        if name == "near_duplicates":
            got = sorted(((r["doc_id"], r["text"], r["row"]) for r in docs.collect()), key=str)
            assert got == sorted([(None, a, "row"), (5, b + " end", "row"), (5, c, "row"), (6, None, "row"), (7, "", "row")], key=str)
    assert P.STAGES[4][1](spark, docs, sf_dir).count() >= 3
