"""Similar texts against all pairs, groups against union-find."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from docloom.llm import near_duplicates as nd


def grams(text, width=nd.WIDTH):
    x = text.translate(str.maketrans("", "", nd.BLANKS))
    return {x[i : i + width] for i in range(len(x) - width + 1)}


def brute(docs, threshold=0.6):
    sets = {k: grams(v) for k, v in docs.items() if v}
    out = set()
    for a, b in itertools.combinations(sorted(k for k in sets if sets[k]), 2):
        both = len(sets[a] & sets[b])
        if both and both >= threshold * (len(sets[a]) + len(sets[b]) - both):
            out.add((a, b))
    return out


def corpus(rng, n, families):
    words = ["".join(rng.choice("abcdefgh漢字") for _ in range(rng.randint(2, 6))) for _ in range(300)]
    docs = {}
    for f in range(families):
        base = [rng.choice(words) for _ in range(rng.randint(20, 120))]
        for i in range(n):
            own = list(base)
            for _ in range(int(len(own) * rng.choice([0, 0.02, 0.05, 0.1]))):
                own[rng.randrange(len(own))] = rng.choice(words)
            cut = rng.randrange(len(own))
            docs[f"{f:03}-{i:03}"] = rng.choice([" ", "\n", "  "]).join(own[cut:] + own[:cut] if rng.random() < 0.3 else own)
    return docs


def frame(spark, docs):
    return spark.createDataFrame([(k, v, 1) for k, v in docs.items()], "doc_id string, raw_markdown string, ingested_at int")


def test_shingles_and_sketches():
    rng = random.Random(1)
    for width in (1, 3, 5, 16):
        text = "".join(rng.choice("abc") for _ in range(60))
        assert len(nd.shingles(text, width)) == len({text[i : i + width] for i in range(61 - width)})
    a = "".join(rng.choice("abcdefghij") for _ in range(3000))
    b = a[:2600] + "".join(rng.choice("abcdefghij") for _ in range(400))
    x, y = nd.sketch(nd.shingles(a)), nd.sketch(nd.shingles(b))
    true = len(grams(a) & grams(b)) / len(grams(a) | grams(b))
    assert abs((x == y).mean() - true) < 0.12
    one, other = nd.sketch(np.array([5], np.uint64)), nd.sketch(np.array([6], np.uint64))  # empty ranges borrow the same way in every set
    assert (one == nd.sketch(np.array([5], np.uint64))).all() and not (one == other).any()


def test_all_pairs_are_found(spark):
    docs = corpus(random.Random(7), 6, 25) | {"null": None, "empty": "", "blank": " \n", "short": "abc"}
    docs["000-copy"] = docs["000-000"].replace(" ", "\n")
    df = frame(spark, docs)
    members, links = nd.similar_texts(df.unionByName(df.limit(20)).selectExpr("*", "1 AS rep", "2 AS id"))
    want = brute(docs)
    got = {tuple(r) for r in nd.all_pairs(members, links).collect()}
    assert not got - want
    assert len(got & want) >= 0.98 * len(want) and len(want) > 60


def test_dense_regions_keep_every_pair(spark, monkeypatch):
    """A region too dense at every depth is compared in blocks."""
    monkeypatch.setattr(nd, "REGION", 8)
    rng = random.Random(3)
    base = "".join(rng.choice("abcdefghijklmnop") for _ in range(4000))
    docs = {f"d{i:02}": base[:3900] + f"{i:02}" * 8 + base[3900:] for i in range(40)}
    members, links = nd.similar_texts(frame(spark, docs))
    assert {tuple(r) for r in nd.all_pairs(members, links).collect()} == brute(docs) and len(brute(docs)) == 780


def test_large_family_of_revisions(spark):
    """Several hundred texts, most pairs of similarity 0.6 to 0.7: being many must not cost recall."""
    rng = random.Random(4)
    letters = "abcdefghijklmnopqrstuvwxyz"
    base = [rng.choice(letters) for _ in range(1500)]
    docs = {}
    for i in range(300):
        own = list(base)
        for at in rng.sample(range(0, 1500, 50), 3):
            own[at : at + 40] = [rng.choice(letters) for _ in range(40)]
        docs[f"r{i:03}"] = "".join(own)
    want = brute(docs)
    members, links = nd.similar_texts(frame(spark, docs))
    got = {tuple(r) for r in nd.all_pairs(members, links).collect()}
    assert len(want) > 20_000 and not got - want
    assert len(got) >= 0.99 * len(want), (len(got), len(want))


def test_groups(spark):
    rng = random.Random(2)
    ids = [f"k{i:03}" for i in range(120)]
    links = {tuple(sorted(rng.sample(ids, 2))) for _ in range(70)} | {(a, b) for a, b in zip(ids[60:], ids[61:])}
    root = {i: i for i in ids}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    m = spark.createDataFrame([(i, i, 1) for i in ids], "doc_id string, rep string, n int")
    out = nd.groups(m, spark.createDataFrame([(a, b, 1.0) for a, b in links], "a string, b string, similarity double")).collect()
    assert {r.doc_id: r.group_id for r in out} == {i: find(i) for i in ids}
    assert sum(r.n_links for r in out) == 2 * len(links)


def test_empty(spark):
    members, links = nd.similar_texts(frame(spark, {"a": None}))
    assert members.count() == 0 and links.count() == 0
    assert nd.groups(members, links).count() == 0


@pytest.mark.parametrize("threshold", [0.8])
def test_other_threshold(spark, threshold):
    docs = corpus(random.Random(9), 5, 8)
    members, links = nd.similar_texts(frame(spark, docs), threshold=threshold)
    want = brute(docs, threshold)
    got = {tuple(r) for r in nd.all_pairs(members, links).collect()}
    assert not got - want and len(got) >= 0.98 * len(want)


def test_last_delivery_counts_whatever_it_is(spark):
    """A document last delivered short or null takes part in nothing, though an earlier delivery was a copy."""
    long = "the quick brown fox jumps over the lazy dog and runs away"
    rows = [("a", long, 1), ("b", long, 1), ("b", "short", 2), ("c", long, 1), ("c", None, 2), ("d", "short", 1), ("d", long, 2)]
    df = spark.createDataFrame(rows, "doc_id string, raw_markdown string, ingested_at int")
    got = nd.all_pairs(*nd.similar_texts(df)).collect()
    assert [tuple(r) for r in got] == [("a", "d")]


def test_trees_meet_the_threshold():
    """A pair at similarity 0.6 shares a region of some tree but once in ten thousand times, however dense the region."""
    assert (1 - 0.6**nd.DEPTH) ** nd.TREES < 1e-4 and nd.TREES * nd.DEPTH <= nd.VALUES
