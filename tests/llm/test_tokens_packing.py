"""Encoding against the library on whole texts; packing by its rules and bounds."""

from __future__ import annotations

import collections
import os
import random

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from docloom.llm import packing, tokens

HERE = os.path.dirname(tokens.VOCABULARY)
PATHS = [os.path.join(HERE, f) for f in ("byte_bpe_50k.tiktoken", "byte_bpe_multi_50k.tiktoken")]
ALPHABET = "aé中。'’!?  \n\t　  s1２ñ…tredllvm,.[]😀​́\x85ſ<|>end"


@pytest.mark.parametrize("path", PATHS)
@given(st.text(alphabet=ALPHABET, max_size=30) | st.text(max_size=30))
@settings(max_examples=400, deadline=None)
def test_fragments_encode_alike(path, text):
    e = tokens.encoder(path)
    assert e.encode(text) == e._encode(text)
    assert b"".join(e.fragments(text)) == text.encode("utf-8", "surrogatepass")


def test_equals_other_library(sf, spark):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(HERE, "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    texts = [r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect() if r.text] + ["<|endoftext|> x", "a" * 3000, "漢" * 3000, " \n" * 500]
    e = tokens.encoder()
    for x, want in zip(texts, t.encode_batch(texts, add_special_tokens=False)):
        assert e.encode(x) == want.ids


def test_corpus_edges(spark):
    df = spark.createDataFrame([(1, None, [9]), (2, "", [9]), (3, "hi", [9]), (3, "hi", [9]), (None, "x", None)], "doc_id long, text string, ids array<int>")
    got = sorted(((r.doc_id, r.ids) for r in tokens.encode_corpus(df).collect()), key=str)
    assert got == sorted([(1, []), (2, []), (3, [5303]), (3, [5303]), (None, [87])], key=str)
    assert tokens.encode_corpus(df.filter("false")).count() == 0


@given(st.dictionaries(st.integers(1, 60), st.integers(1, 12), max_size=40), st.sampled_from([60, 75, 100]))
@settings(max_examples=300, deadline=None)
def test_plan_places_everything(histogram, capacity):
    patterns = packing.plan(histogram, capacity)
    placed = collections.Counter()
    for pattern, n in patterns:
        assert sum(pattern) <= capacity and n > 0
        assert sum(3 * s > capacity for s in pattern) <= 2
        for s in pattern:
            placed[s] += n
    assert placed == collections.Counter(histogram)
    total = sum(s * n for s, n in histogram.items())
    bins = sum(n for _, n in patterns)
    least = max(-(-total // capacity), sum(n for s, n in histogram.items() if 2 * s > capacity))  # two items above half never share
    assert least <= bins <= 1.5 * least + 1
    with pytest.raises(ValueError):
        packing.plan({capacity + 1: 1}, capacity)


def test_pack(spark):
    rng = random.Random(4)
    sizes = [(i, rng.choice([None, 0, 5, rng.randint(1, 100), 700, 1024, 2048, 2049, 5000])) for i in range(600)] + [(10_000 + i, 700) for i in range(400)]
    df = spark.createDataFrame(sizes, "doc_id long, n_ids int").selectExpr("*", "7 AS part", "8 AS bin_id").repartition(5)
    got = packing.pack(df).collect()
    by_doc, by_bin = collections.defaultdict(list), collections.Counter()
    for r in got:
        by_doc[r.doc_id].append((r.part, r.first_id, r.n_ids))
        by_bin[r.bin_id] += r.n_ids
    assert max(by_bin.values()) <= 2048 and sorted(by_bin) == list(range(len(by_bin)))
    for doc, n in sizes:
        parts = sorted(by_doc[doc])
        assert sum(p[2] for p in parts) == (n or 0)
        assert len(parts) == -(-(n or 0) // 2048) and all(p[1] == 2048 * p[0] for p in parts)
    assert {tuple(r) for r in packing.pack(df.repartition(2)).collect()} == {tuple(r) for r in got}
    assert packing.pack(df.filter("false")).count() == 0


def test_fill_is_tight(spark, sf):
    one = packing.fill(packing.pack_texts(spark.read.parquet(f"{sf}/documents.parquet"))).first()
    assert one.fullest <= 2048 and one.bins <= one.least + 1
