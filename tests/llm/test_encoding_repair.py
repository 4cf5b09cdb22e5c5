"""Texts damaged on purpose must be found and, where no byte was lost, restored; sound texts must stay."""

from __future__ import annotations

import random

import numpy as np
import pyarrow as pa
import pytest

from docloom.llm import encoding_repair as er


@pytest.fixture(scope="module")
def clean(spark):
    rows = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect()
    return sorted({r.text for r in rows if r.text and 20 < len(r.text) < 600})


@pytest.fixture(scope="module")
def model(clean):
    import numpy as np

    pairs, chars, docs = np.zeros(2 * er.PAIRS, np.int64), np.zeros(er.CHARS, np.int64), 0
    for b in er._tally(iter([pa.RecordBatch.from_arrays([pa.array(clean)], names=["t"])])):
        for i, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if i >= 0:
                pairs[i] = n
            elif i >= -er.CHARS:
                chars[-1 - i] = n
            else:
                docs = n
    return er.Model(pairs, chars, docs)


@pytest.fixture(scope="module")
def sound(model, clean):
    return [x for x in clean if not er.repair(model, x)[0] and not x.isascii()]


def damage(text, read, written):
    if read == "cp1252":
        table = {b: ch for ch, b in er._single_map("cp1252").items()}
        return "".join(table[b] for b in text.encode(written))
    return text.encode(written).decode(read)


@pytest.mark.parametrize(("read", "written", "least"), [("cp1252", "utf-8", 0.97), ("mac_roman", "utf-8", 0.97), ("koi8_r", "utf-8", 0.95), ("cp437", "utf-8", 0.97), ("cp1252", "gb18030", 0.9), ("cp950", "gb18030", 0.85), ("utf-16-be", "utf-16-le", 0.9)])
def test_restores(model, sound, read, written, least):
    rng = random.Random(5)
    han = [x for x in sound if sum("一" <= ch <= "鿿" for ch in x) > 20]
    found = right = total = 0
    for x in rng.sample(han, min(40, len(han))):
        try:
            bad = damage(x, read, written)
        except UnicodeError:
            continue
        if any(0xD800 <= ord(ch) < 0xE000 for ch in bad):
            continue
        total += 1
        damaged, restored, _, _ = er.repair(model, bad)
        found += damaged
        right += restored == x
    if total >= 5:
        assert found >= least * total
        assert right >= 0.6 * total, (right, total)


def test_twice_and_in_part(model, sound):
    x = next(t for t in sound if "±" in t)
    twice = damage(damage(x, "cp1252", "utf-8"), "cp1252", "utf-8")
    assert er.repair(model, twice)[1] == x
    half = x[: len(x) // 2] + damage(x[len(x) // 2 :], "cp1252", "utf-8")
    assert er.repair(model, half)[:2] == (True, x)


def test_lost_bytes(model, sound):
    assert er.repair(model, "ok ��� ok")[0]
    assert er.repair(model, "锟斤拷锟斤拷")[0]


@pytest.mark.parametrize("text", ["", "plain ascii", "Größe 12 µm ±½°", "ÅÄÖ ÇÃO Ñ", "¥ 300 / £ 40 / § 7", "😀 👨‍🔧", "é è à ç", "مفتاح ด้าม", "┌──┬──┐ │ № │ ══╗"])
def test_intended_characters_stay(model, text):
    assert er.repair(model, text)[:2] == (False, text)


def test_operator_edges(spark):
    df = spark.createDataFrame([(1, None), (2, ""), (3, " "), (4, "x � y"), (4, "x � y"), (None, "锟斤拷"), (5, "clean é")], "doc_id long, text string").selectExpr("*", "1 AS restored", "2 AS bits")
    got = sorted((str(r.doc_id) for r in er.restore(df).collect()))
    assert got == ["4", "4", "None"]
    assert er.restore(df.filter("false")).count() == 0


@pytest.mark.parametrize("long", ["ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอน" * 6, "اللغة العربية هي أكثر اللغات السامية تحدثا" * 6, "한국어는대한민국과조선민주주의인민공화국의공용어이다" * 6])
def test_short_damage_inside_long_rare_text(model, long):
    half = len(long) // 2
    bad = long[:half] + " caf" + "Ã©" + " itâ€™s " + long[half:]
    pairs, chars = model.pairs.copy(), model.chars.copy()  # counts are over all texts, these included
    for x in (long, bad):
        pairs[np.unique(er._buckets(er._codes(x)))] += 1
        chars[np.unique(er._codes(x))] += 1
    own = er.Model(pairs, chars, model.docs + 2)
    damaged, restored, _, _ = er.repair(own, bad)
    assert damaged and restored == long[:half] + " café it’s " + long[half:]
    assert er.repair(own, long)[:2] == (False, long)


@pytest.mark.parametrize(("read", "written"), [("cp1252", "utf-8"), ("koi8_r", "utf-8")])
def test_long_damage_is_restored_without_borders(model, sound, read, written):
    han = [x for x in sound if sum("一" <= ch <= "鿿" for ch in x) > 20]
    text = "".join(han)[:3000]
    assert er.repair(model, damage(text, read, written))[1] == text


def test_every_character_that_fits_is_kept(model):
    """A rare trail byte at a GBK lead with many commoner characters is decided by its neighbours."""
    lead = max(range(0xB0, 0xD8), key=lambda b: len(model.fits("gb18030", (b, er.ANY))))
    fits = model.fits("gb18030", (lead, er.ANY))
    assert len(fits) > 12 and {ch.encode("gb18030")[0] for ch in fits} == {lead}
    chars, pairs = model.chars.copy(), model.pairs.copy()
    last = fits[-1]
    word = "轴" + last + "承"
    for i in np.unique(er._buckets(er._codes(word))):
        pairs[i] = chars[er._codes(word)].max()
    chars[er._codes(word)] = np.maximum(chars[er._codes(word)], 1)
    own = er.Model(pairs, chars, model.docs)
    bad = "轴".encode("gb18030").decode("cp1252", "ignore")
    assert last in own.fits("gb18030", (lead, er.ANY)) and bad is not None
    table = {b: ch for ch, b in er._single_map("cp1252").items()}
    read = "".join(table[b] for b in "轴".encode("gb18030")) + table[lead] + "�" + "".join(table[b] for b in "承".encode("gb18030"))
    assert er.search(own, read, "cp1252", "gb18030")[1] == word


def test_damage_of_a_third_of_the_corpus(clean):
    """What many documents share does not count as usual: each is found, and sound texts stay."""
    texts = [x for x in clean if not x.isascii() and "\ufffd" not in x]
    bad = [damage(x, "cp1252", "utf-8") for x in texts[::3]] + [x.encode().decode("gb18030", "replace") for x in texts[1::9]]
    assert len(bad) > 60
    corpus = clean + bad
    pairs, chars, docs = np.zeros(2 * er.PAIRS, np.int64), np.zeros(er.CHARS, np.int64), 0
    for b in er._tally(iter([pa.RecordBatch.from_arrays([pa.array(corpus)], names=["t"])])):
        ids, n = b.column(0).to_numpy(), b.column(1).to_numpy()
        pairs[ids[ids >= 0]] = n[ids >= 0]
        one = (ids < 0) & (ids >= -er.CHARS)
        chars[-1 - ids[one]] = n[one]
        docs += int(n[ids == -1 - er.CHARS].sum())
    own = er.Model(pairs, chars, docs)
    found = er.repair_all(own, bad)
    assert sum(f[0] for f in found) >= 0.95 * len(bad)  # the rest hold one or two garbled characters that are usual now
    usual = er.repair_all(own, texts)
    assert sum(f[0] for f in usual) <= 0.12 * len(texts)  # the fixture's own damaged texts


def test_pruning_changes_nothing(model, sound):
    """The search that drops states finds what the full search finds."""
    pairs = [("cp1252", "utf-8"), ("gb18030", "utf-8"), ("cp1252", "gb18030"), ("utf-8", "gb18030")]
    for read, written in pairs:
        for x in [x for x in sound if len(x) < 80][:12]:
            try:
                bad = x.encode(written).decode(read, "replace")
            except UnicodeEncodeError:
                continue
            for bound, r, w, rest in er.bounds(model, [bad])[0]:
                if (r, w) == (read, written):
                    gain, text = er.search(model, bad, r, w)
                    assert gain <= bound + 1e-6
                    assert er.search(model, bad, r, w, rest, gain)[0] == pytest.approx(gain)
