"""Garbled text from wrong character encodings, found and restored by noisy-channel decoding.

A channel is a pair of encodings: the text was written in one and read in the
other. A suspicious stretch is turned back into the bytes that were read (with
wildcards for bytes that were lost), these span a lattice of the characters
they can mean under the channel's right encoding, beside edges that keep the
text as it stands, and a Viterbi search finds the path that the corpus makes
most likely. The language model counts, over all documents, in how many a
character and a pair of neighbouring characters occur; pairs serve as words,
since most of the scripts here do not space words. Its tables have a fixed size however large the
corpus is. A text is damaged if some path beats leaving it alone by a margin,
or if it holds what only a failed decoding leaves behind.
"""

from __future__ import annotations

import codecs
import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docloom.runtime import portions

#: Buckets of each of the two pair tables; the size of the model, whatever the corpus.
PAIRS = 1 << 21
CHARS = 0x110000
#: Characters in fewer than this share of the documents count as rare.
RARE = 0.01
#: Bits by which a path must beat the text as it stands; more where the bytes prove little by themselves.
MARGIN_UTF8, MARGIN = 8.0, 16.0
#: Bits for beginning a decoded stretch.
ENTER = 3.0
#: Bits for a last byte that was dropped without a trace.
DROPPED = 5.0

#: Encodings that were wrongly assumed, and those in which the text was written.
READ_SINGLE = ("cp1252", "mac_roman", "cp437", "cp850", "cp1251", "koi8_r", "cp1250", "cp866", "iso8859_15", "cp1254")
READ_DOUBLE = ("gb18030", "cp950", "cp932", "cp949", "euc_jp")
WRITTEN = ("gb18030", "cp950", "cp932", "euc_jp", "cp949", "cp1251", "koi8_r", "cp1252")
CHANNELS = (
    *((r, "utf-8") for r in (*READ_SINGLE, *READ_DOUBLE)),
    *(("cp1252", w) for w in WRITTEN if w != "cp1252"),
    *((r, w) for r in ("cp1251", "mac_roman", "cp437", "koi8_r") for w in ("gb18030", "cp1251", "koi8_r") if r != w),
    *((r, w) for r in READ_DOUBLE for w in ("gb18030", "cp950", "cp932", "euc_jp") if r != w),
    ("utf-8", "gb18030"), ("utf-8", "cp950"), ("utf-8", "cp932"), ("utf-8", "euc_jp"), ("utf-8", "cp1252"), ("utf-8", "cp1251"),
    ("utf-16", "swapped"),
)

_BY_READ: dict[str, list[str]] = {}
for _r, _w in CHANNELS:
    _BY_READ.setdefault(_r, []).append(_w)

#: What the replacement character itself becomes when it is read wrongly once more.
TRACES = re.compile("�|锟斤拷|锟斤|斤拷|ï¿½|嚙踝蕭|嚙|[\u0080-\u0084\u0086-\u009f]|[\U000e1000-\U000effff]")

_HASH, _HASH2 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93)


def _codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)


def _buckets(codes: np.ndarray) -> np.ndarray:
    """Two buckets of each pair of neighbours, in rows; a pair is counted by the smaller of the two."""
    x = codes[:-1].astype(np.uint64) << np.uint64(21) | codes[1:].astype(np.uint64)
    return np.stack([((x * h) >> np.uint64(43)).astype(np.int64) + i * PAIRS for i, h in enumerate((_HASH, _HASH2))])


# -- corpus counts ---------------------------------------------------------------------------------


#: Characters that are looked at together.
TOGETHER = 200_000


def _portions(batches: Iterator[pa.RecordBatch]) -> Iterator[list[str]]:
    for batch in batches:
        texts = [x for x in batch.column(0).to_pylist() if x]
        for i, j in portions([len(x) for x in texts], 5 * TOGETHER):
            yield texts[i:j]


def _tally(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Documents by character (negative ids) and by pair bucket, summed over the partition.

    What by its bytes alone looks wrongly decoded is left out, so that a
    damage that many documents share does not come to count as usual.
    """
    pairs, chars, docs = np.zeros(2 * PAIRS, np.int32), np.zeros(CHARS, np.int32), 0
    for texts in _portions(batches):
        docs += len(texts)
        whole = "\n".join(texts)
        codes = _codes(whole)
        sound = np.ones(len(codes), bool)
        for a, b in marked(whole, codes, CERTAIN):
            sound[a:b] = False
        ends = np.cumsum([len(x) + 1 for x in texts])
        for a, b in zip([0, *ends.tolist()], (ends - 1).tolist()):
            mine, good = codes[a:b], sound[a:b]
            chars[np.unique(mine if good.all() else mine[good])] += 1
            if len(mine) > 1:
                both = _buckets(mine)
                pairs[np.unique(both if good.all() else both[:, good[:-1] & good[1:]])] += 1
    at, ch = np.flatnonzero(pairs), np.flatnonzero(chars)
    ids = np.concatenate([at, -1 - ch, [-1 - CHARS]])
    n = np.concatenate([pairs[at], chars[ch], [docs]])
    for i in range(0, len(ids), 50_000):
        yield pa.RecordBatch.from_arrays([pa.array(ids[i : i + 50_000], pa.int64()), pa.array(n[i : i + 50_000], pa.int64())], names=["id", "n"])


def corpus_counts(df: DataFrame, text: str) -> tuple[np.ndarray, np.ndarray, int]:
    """(pairs, characters, documents) counted over all texts; at most 2 * PAIRS + CHARS numbers reach the driver."""
    counts = df.select(F.col(f"`{text}`")).mapInArrow(_tally, "id long, n long").groupBy("id").agg(F.sum("n").alias("n")).toArrow()
    ids, n = counts.column("id").to_numpy(), counts.column("n").to_numpy()
    pairs, chars = np.zeros(2 * PAIRS, np.int64), np.zeros(CHARS, np.int64)
    own = ids >= 0
    pairs[ids[own]] = n[own]
    one = (ids < 0) & (ids >= -CHARS)
    chars[-1 - ids[one]] = n[one]
    total = int(n[ids == -1 - CHARS].sum())
    return pairs, chars, total


# -- bytes and characters of the channels ----------------------------------------------------------


@lru_cache(maxsize=None)
def _single_map(codec: str) -> dict[str, int]:
    out = {}
    for b in range(256):
        try:
            out[bytes([b]).decode(codec)] = b
        except UnicodeDecodeError:
            pass
    for b in range(0x80, 0xA0):  # undefined bytes commonly pass through as controls
        out.setdefault(chr(b), b)
    return out


#: A lost byte.
ANY = -1


def as_bytes(text: str, codec: str) -> list[list[int]]:
    """For each character the bytes it was read from; [] where it cannot have been read in ``codec``."""
    if codec in READ_SINGLE:
        table = _single_map(codec)
        lost = [ANY] if codec in ("cp1252", "cp1250", "cp1254", "cp1251") else []
        return [[table[ch]] if ch in table else lost if ch == "�" else [] for ch in text]
    if codec == "utf-16":
        return [[ord(ch) >> 8, ord(ch) & 255] if ord(ch) < 0x10000 else [] for ch in text]
    out = []
    for ch in text:
        if ch == "�":
            out.append([ANY])
            continue
        try:
            out.append(list(ch.encode(codec)))
        except UnicodeEncodeError:
            out.append([])
    return out


#: A place without a byte: its character cannot have been read in the encoding.
NONE = -9


@lru_cache(maxsize=None)
def _table(codec: str) -> np.ndarray:
    """The bytes of each character of the basic plane, as by ``as_bytes``, filled up with NONE."""
    out = np.full((0x10000, 4), NONE, np.int16)
    for at, data in enumerate(as_bytes("".join(map(chr, range(0x10000))), codec)):
        out[at, : len(data)] = data
    return out


def _read_as(codes: np.ndarray, codec: str) -> np.ndarray:
    """The same of a text, one row per character."""
    rows = _table(codec)[np.minimum(codes, 0xFFFF)]
    for i in np.flatnonzero(codes > 0xFFFF).tolist():
        data = as_bytes(chr(codes[i]), codec)[0]
        rows[i] = [*data, *[NONE] * (4 - len(data))]
    return rows


#: What the two bytes of a character may be in UTF-8: a lead of three or a later byte.
_LEAD1, _REST1, _LEAD2, _REST2 = 1, 2, 4, 8


@lru_cache(maxsize=None)
def _roles(codec: str) -> np.ndarray:
    """By character of the basic plane; all roles for those of another number of bytes."""
    rows = _table(codec)
    lead, rest = (rows >= 0xE0) & (rows < 0xF0), (rows >= 0x80) & (rows < 0xC0)
    out = lead[:, 0] * _LEAD1 + rest[:, 0] * _REST1 + lead[:, 1] * _LEAD2 + rest[:, 1] * _REST2
    size = (rows != NONE).sum(axis=1)
    return np.where(size == 2, out, np.where(size == 0, 0, 15)).astype(np.uint8)


@lru_cache(maxsize=None)
def _starts(codec: str) -> np.ndarray:
    """Whether a character may have so many bytes (row) if it starts with this one (column; the last for a lost one)."""
    out = np.zeros((5, 257), bool)
    for lead in range(256):
        out[list(_lengths(codec, lead)), lead] = True
    out[list(_lengths(codec, ANY)), 256] = True
    return out


def _lengths(codec: str, lead: int) -> tuple[int, ...]:
    """Possible lengths of a character that starts with byte ``lead``."""
    if codec == "utf-8":
        return (1,) if 0 <= lead < 0x80 else (2,) if 0xC2 <= lead < 0xE0 else (3,) if 0xE0 <= lead < 0xF0 else (4,) if 0xF0 <= lead < 0xF5 else (2, 3) if lead == ANY else ()
    if codec == "swapped":
        return (2,)
    if codec in ("cp1251", "koi8_r", "cp1252"):
        return (1,)
    if codec == "gb18030":
        return (1,) if 0 <= lead < 0x80 else (2, 4)
    return (1,) if 0 <= lead < 0x80 else (1, 2) if codec in ("cp932",) else (2, 3) if codec == "euc_jp" and lead in (0x8F, ANY) else (2,)


@lru_cache(maxsize=400_000)
def _char(codec: str, data: tuple[int, ...]) -> str | None:
    if codec == "swapped":
        code = data[1] << 8 | data[0]
        return None if 0xD800 <= code < 0xE000 else chr(code)
    try:
        out = bytes(data).decode(codec)
    except UnicodeDecodeError:
        return None
    return out if len(out) == 1 else None


class Model:
    """Costs in bits of neighbouring characters, from the corpus counts."""

    def __init__(self, pairs: np.ndarray, chars: np.ndarray, docs: int) -> None:
        self.docs = max(docs, 1)
        self.pairs, self.chars = pairs, chars
        self.rare = chars < max(RARE * self.docs, 2)
        self.rare[:0x80] = False
        self._log = np.log2(self.docs + 1)
        self._cost: dict[tuple[str, str], float] = {}
        common = [chr(c) for c in np.flatnonzero(chars) if c >= 0x80 and not 0xD800 <= c < 0xE000 and c != 0xFFFD]
        common.sort(key=lambda ch: -chars[ord(ch)])
        self.common = common
        self._fits: dict[tuple[str, tuple[int, ...]], list[str]] = {}
        #: The least bits of a character, whatever stands before it.
        self.least = self._log - np.log2(chars + 0.46)
        self.floor = float(self.least.min())

    def cost(self, a: str, b: str) -> float:
        """Bits of the pair: how rarely documents hold it."""
        got = self._cost.get((a, b))
        if got is None:
            x, y = ord(a), ord(b)
            pair = x << 21 | y
            n = min(float(self.pairs[((pair * int(h) & (1 << 64) - 1) >> 43) + i * PAIRS]) for i, h in enumerate((_HASH, _HASH2)))
            chance = min(1.0, float(self.chars[x]) * float(self.chars[y]) / self.docs / 50)
            got = self._log - float(np.log2(min(n, float(self.chars[x]), float(self.chars[y])) + 0.4 * chance + 0.05 * (self.chars[y] > 0) + 0.01))
            if len(self._cost) > 500_000:
                self._cost.clear()
            self._cost[a, b] = got
        return got

    def matrix(self, before: list[str], after: list[str]) -> np.ndarray:
        """The same of each character after each."""
        x, y = (np.array([ord(ch) for ch in z]) for z in (before, after))
        pair = np.stack([np.repeat(x, len(y)), np.tile(y, len(x))], axis=1).ravel()
        n = self.pairs[_buckets(pair)[:, ::2]].min(axis=0).reshape(len(x), len(y))
        a, b = self.chars[x][:, None], self.chars[y][None]
        return self._log - np.log2(np.minimum(np.minimum(a, b), n) + 0.4 * np.minimum(1.0, a * (b / self.docs) / 50) + 0.05 * (b > 0) + 0.01)

    def costs(self, text: str) -> np.ndarray:
        codes = _codes(text)
        x, y = self.chars[codes[:-1]], self.chars[codes[1:]]
        n = np.minimum(np.minimum(x, y), self.pairs[_buckets(codes)].min(axis=0))
        return self._log - np.log2(n + 0.4 * np.minimum(1.0, x * (y / self.docs) / 50) + 0.05 * (y > 0) + 0.01)

    def fits(self, codec: str, pattern: tuple[int, ...]) -> list[str]:
        """All characters of the corpus whose bytes in ``codec`` match a pattern with lost bytes."""
        got = self._fits.get((codec, pattern))
        if got is None:
            chars, table = self._spelled(codec, len(pattern))
            ok = np.ones(len(chars), bool)
            for at, p in enumerate(pattern):
                if p != ANY:
                    ok &= table[:, at] == p
            got = [chars[k] for k in np.flatnonzero(ok)]
            if len(self._fits) > 100_000:
                self._fits.clear()
            self._fits[codec, pattern] = got
        return got

    @lru_cache(maxsize=64)  # noqa: B019  (one model per worker)
    def least_of_two(self, codec: str) -> np.ndarray:
        """The least bits of the character of each two bytes (lead * 256 + trail); infinite where there is none."""
        out = np.full(65536, np.inf)
        for lead in range(256):
            if 2 in _lengths(codec, lead):
                for trail in range(256):
                    ch = _char(codec, (lead, trail))
                    if ch is not None:
                        out[lead << 8 | trail] = self.least[ord(ch)]
        return out

    @lru_cache(maxsize=64)  # noqa: B019
    def least_of_one(self, codec: str) -> np.ndarray:
        """The same of single bytes."""
        chars = [_char(codec, (b,)) if 1 in _lengths(codec, b) else None for b in range(256)]
        return np.array([np.inf if ch is None else self.least[ord(ch)] for ch in chars])

    @lru_cache(maxsize=4)  # noqa: B019
    def least_of_lead(self) -> np.ndarray:
        """The least bits of any character by its first byte in UTF-8."""
        out = np.full(256, np.inf)
        codes = np.arange(0x80, CHARS)
        lead = np.where(codes < 0x800, 0xC0 | codes >> 6, np.where(codes < 0x10000, 0xE0 | codes >> 12, 0xF0 | codes >> 18))
        np.minimum.at(out, lead, self.least[codes])
        return out

    @lru_cache(maxsize=64)  # noqa: B019
    def _spelled(self, codec: str, length: int) -> tuple[list[str], np.ndarray]:
        """The corpus' characters of ``length`` bytes in an encoding, the most common first, and their bytes."""
        chars, rows = [], []
        for ch in self.common:
            try:
                data = ch.encode("utf-16-le" if codec == "swapped" else codec)
            except UnicodeEncodeError:
                continue
            if len(data) == length:
                chars.append(ch)
                rows.append(list(data))
        return chars, np.array(rows, np.uint8).reshape(-1, length)


# -- search ----------------------------------------------------------------------------------------


def search(model: Model, text: str, read: str, written: str, rest: tuple[list[float], list[float], list[float]] | None = None, least: float = 0.0, beam: int = 0) -> tuple[float, str] | None:
    """(bits gained over leaving the text alone, best text) for one channel; none where ``least`` cannot be gained.

    With ``rest``, from ``_rest``, states that cannot reach ``least`` any more
    are dropped, which changes no result. ``beam`` keeps so many states at a
    place, for a first bound that is a real path.
    """
    units = as_bytes(text, read)
    starts, flat = {}, []
    for i, data in enumerate(units):
        starts[len(flat)] = i
        flat += data or [None]
    n = len(flat)
    saved, kept, inside_ = rest or (None, None, None)
    # states[p]: (last character, decoded?) -> (cost, path so far as linked pairs)
    states: list[dict | None] = [{} for _ in range(n + 1)]
    states[0] = {("\n", False): (0.0, None)}
    lengths, drops = _lengths, written == "utf-8" and read in READ_DOUBLE
    for p in range(n):
        here, states[p] = states[p], None
        if not here:
            continue
        if rest:
            a, b = saved[p] + kept[p] - least + 1e-6, saved[p] + inside_[p] - least + 1e-6
            here = {k: v for k, v in here.items() if v[0] <= (b if k[1] else a)}
        if beam and len(here) > beam:
            here = dict(sorted(here.items(), key=lambda x: x[1][0])[:beam])
        i = starts.get(p)
        edges: list[tuple[int, list[str], bool, float]] = []
        if i is not None:
            edges.append((p + max(1, len(units[i])), [text[i]], False, 0.0))
        lead = flat[p]
        if lead is not None and here:
            for k in lengths(written, lead):
                piece = flat[p : p + k]
                if len(piece) < k or None in piece:
                    continue
                pattern = tuple(piece)
                if ANY in pattern:
                    if pattern.count(ANY) == 1 or (written == "utf-8" and pattern[0] != ANY):
                        edges.append((p + k, model.fits(written, pattern), True, 0.0))
                else:
                    ch = _char(written, pattern)
                    if ch is not None and (ch != text[i] if i is not None and k == len(units[i]) else True):
                        edges.append((p + k, [ch], True, 0.0))
                if drops and k > 1 and ANY not in pattern and not 0x80 <= pattern[-1] < 0xC0 and all(0x80 <= b < 0xC0 for b in pattern[1:-1]):
                    edges.append((p + k - 1, model.fits(written, (*pattern[:-1], ANY)), True, DROPPED))
        for q, chars, decoded, extra in edges:
            there = states[q]
            if beam:
                chars = chars[: 4 * beam]
            most = saved[q] + (inside_[q] if decoded else kept[q]) - least + 1e-6 - extra if rest else float("inf")
            if len(here) * len(chars) > 32:  # many at once
                lasts = list(here)
                before = np.array([here[k][0] + (ENTER if decoded and not k[1] else 0.0) for k in lasts])
                steps = before[:, None] + model.matrix([k[0] for k in lasts], chars)
                low, by = steps.min(axis=0), steps.argmin(axis=0)
                good = np.flatnonzero(low <= most)
                if beam and len(good) > beam:
                    good = good[np.argpartition(low[good], beam)[:beam]]
                for at in good.tolist():
                    ch, k, step = chars[at], int(by[at]), float(low[at]) + extra
                    old = there.get((ch, decoded))
                    if old is None or step < old[0]:
                        there[ch, decoded] = (step, (here[lasts[k]][1], ch))
                continue
            for (last, inside), (cost, path) in here.items():
                for ch in chars:
                    step = cost + model.cost(last, ch) + (ENTER if decoded and not inside else 0.0)
                    if step > most:
                        continue
                    step += extra
                    old = there.get((ch, decoded))
                    if old is None or step < old[0]:
                        there[ch, decoded] = (step, (path, ch))
    if not states[n]:
        return None
    plain = sum(model.cost(a, b) for a, b in zip("\n" + text, text))
    cost, path = min(states[n].values(), key=lambda v: v[0])
    out = []
    while path is not None:
        path, ch = path
        out.append(ch)
    return plain - cost, "".join(reversed(out))


def _pieces(model: Model, data: np.ndarray, written: str, drops: bool) -> list[tuple[int, np.ndarray]]:
    """(length, least bits of the character that so many bytes can mean, by first byte; infinite where none)."""
    n = len(data) - 3  # three places behind the end
    a, b, c, d = data[:n], data[1 : n + 1], data[2 : n + 2], data[3:]
    known = lambda *x: np.logical_and.reduce([v >= 0 for v in x])
    if written == "utf-8":
        rest = lambda x: (x >= 0x80) & (x < 0xC0)
        of = lambda ok, code: np.where(ok, model.least[np.where(ok, code, 0)], np.inf)
        code4 = (a & 7) << 18 | (b & 63) << 12 | (c & 63) << 6 | d & 63
        out = [
            (2, of((a >= 0xC2) & (a < 0xE0) & rest(b), (a & 31) << 6 | b & 63)),
            (3, of((a >= 0xE0) & (a < 0xF0) & rest(b) & rest(c), (a & 15) << 12 | (b & 63) << 6 | c & 63)),
            (4, of((a >= 0xF0) & (a < 0xF5) & rest(b) & rest(c) & rest(d) & (code4 < CHARS), code4)),
        ]
        if drops:
            least = np.where(a >= 0xC2, model.least_of_lead()[np.maximum(a, 0)], np.inf) + DROPPED
            out += [(1, np.where(a < 0xE0, least, np.inf)), (2, np.where((a >= 0xE0) & (a < 0xF0) & rest(b), least, np.inf)), (3, np.where((a >= 0xF0) & rest(b) & rest(c), least, np.inf))]
        return out + _lost(model, data, written)
    one = np.where(known(a), model.least_of_one(written)[np.maximum(a, 0)], np.inf) if written != "swapped" else None
    out = [] if one is None else [(1, np.where(a >= 0x80, one, np.inf))]
    if written not in ("cp1251", "koi8_r", "cp1252"):
        out.append((2, np.where(known(a, b), model.least_of_two(written)[np.maximum(a, 0) << 8 | np.maximum(b, 0)], np.inf)))
    if written == "gb18030":
        out.append((4, np.where((a >= 0x81) & (b >= 0x30) & (b < 0x3A) & (c >= 0x81) & (d >= 0x30) & (d < 0x3A), model.floor, np.inf)))
    if written == "euc_jp":
        out.append((3, np.where((a == 0x8F) & known(b, c), model.floor, np.inf)))
    return out + _lost(model, data, written)


def _lost(model: Model, data: np.ndarray, written: str) -> list[tuple[int, np.ndarray]]:
    """The same of characters with lost bytes, as far as ``search`` fills them."""
    if not (data == ANY).any():
        return []
    out, n = [], len(data) - 3
    lead = np.where(data[:n] == ANY, 256, np.maximum(data[:n], 0))
    two = model.least_of_two(written).reshape(256, 256) if written not in ("utf-8", "cp1251", "koi8_r", "cp1252") else None
    for k in (1, 2, 3, 4):
        window = np.stack([data[i : n + i] for i in range(k)])
        lost = (window == ANY).sum(axis=0)
        ok = (lost > 0) & (window != NONE).all(axis=0) & _starts(written)[k][lead]
        ok &= (lost == 1) | (lead < 256) if written == "utf-8" else lost == 1
        least = np.full(n, model.floor)
        if written == "utf-8":
            least = np.where(lead < 256, model.least_of_lead()[np.minimum(lead, 255)], least)
        elif k == 1:
            least[:] = model.least_of_one(written).min()
        elif k == 2 and two is not None:
            least = np.where(lead < 256, two.min(axis=1)[np.minimum(lead, 255)], two.min(axis=0)[np.maximum(window[1], 0)])
        out.append((k, np.where(ok, least, np.inf)))
    return out


Bound = tuple[float, str, str, tuple[list[float], list[float], list[float]]]

#: Bits that a decoded character costs above its least, by experience; only the order of the channels depends on it.
USUAL = 3.0


def bounds(model: Model, texts: list[str]) -> list[list[Bound]]:
    """For each text its channels with the bits that no path of theirs can gain more than.

    Each character that bytes can mean is taken at its least cost after any
    other, and so is the text's next character after what is decoded. Channels
    that cannot gain the margin are left out; the others come with what
    ``search`` prunes by, the most likely first. All texts are judged at once.
    """
    whole = "\n" + "\n".join(texts)
    codes = _codes(whole)
    sizes = np.array([len(x) + 1 for x in texts])
    heads = np.cumsum(sizes) - sizes
    owner = np.repeat(np.arange(len(texts)), sizes)
    plain = np.concatenate([[0.0], model.costs(whole)])
    plain[heads] = 0
    fall = np.maximum(plain - model.least[codes], 0)
    fall[heads] = 0
    found: list[list[tuple[float, Bound]]] = [[] for _ in texts]
    for read, ways in _BY_READ.items():
        rows = _read_as(codes, read)
        rows[heads] = NONE
        size = np.maximum((rows != NONE).sum(axis=1), 1)
        first = np.cumsum(size) - size
        data = np.full(int(size.sum()) + 3, NONE, np.int64)
        for k in range(4):
            has = rows[:, k] != NONE
            data[first[has] + k] = rows[has, k]
        n = len(data) - 3
        if not (data[:n] != NONE).any():
            continue
        wide = np.repeat(size, size)
        own = np.repeat(owner, size)
        saved = np.concatenate([[0.0], np.cumsum(np.repeat(plain / size, size))])
        after, step = np.zeros(n + 1), np.zeros(n, int)
        after[first], step[first] = fall, size
        single = np.flatnonzero((data[:n] >= 0) & (data[:n] < 0x80) & (wide > 1))
        edge = np.append(first[heads], n)
        for written in ways:
            margin = MARGIN_UTF8 if written == "utf-8" else MARGIN
            at, ends, gains = [], [], []
            for k, least in _pieces(model, data, written, written == "utf-8" and read in READ_DOUBLE):
                where = np.flatnonzero(np.isfinite(least[: max(0, n - k + 1)]))
                if len(where):
                    at.append(where)
                    ends.append(where + k)
                    gains.append(saved[where + k] - saved[where] - least[where])
            if not at:
                continue
            if len(single) and written != "swapped":
                at.append(single)
                ends.append(single + 1)
                gains.append(saved[single + 1] - saved[single] - model.least[data[single]])
            p, q, g = np.concatenate(at), np.concatenate(ends), np.concatenate(gains)
            # no disjoint pieces save more than all places at the best rate of a piece on them
            rate = np.zeros(n)
            for where, end, gain in zip(at, ends, gains):
                each = np.maximum(gain + after[end], 0) / (end - where)
                for k in range(int(end[0] - where[0])):
                    rate[where + k] = np.maximum(rate[where + k], each)
            most = np.bincount(own, rate, len(texts)) - ENTER
            pieces_of = np.bincount(own[p], minlength=len(texts))
            good = np.flatnonzero(most >= margin)
            if not len(good):
                continue
            order = np.argsort(own[p], kind="stable")
            cuts = np.searchsorted(own[p][order], np.append(good, len(texts))).tolist()
            for t, c in zip(good.tolist(), cuts):
                lo, hi = int(edge[t]) + 1, int(edge[t + 1])
                mine = order[c : c + int(pieces_of[t])]
                kept, inside = _rest(hi - lo, p[mine] - lo, q[mine] - lo, g[mine], after[lo : hi + 1].tolist(), step[lo:hi].tolist())
                if kept[0] >= margin:
                    likely = kept[0] - USUAL * float(np.count_nonzero(g[mine] > 0) * kept[0] / (np.maximum(g[mine], 0).sum() + 1e-9))
                    found[t].append((likely, (kept[0], read, written, ((saved[lo : hi + 1] - saved[lo]).tolist(), kept, inside))))
    return [[x for _, x in sorted(each, key=lambda x: -x[0])] for each in found]


def _rest(n: int, p: np.ndarray, q: np.ndarray, gain: np.ndarray, after: list[float], step: list[int]) -> tuple[list[float], list[float]]:
    """From each place to the end, the most that disjoint pieces (from p to q) and the characters after them can save:
    where the text is as it stands, and behind a piece."""
    edges: dict[int, list[tuple[int, float]]] = {}
    for a, b, g in zip(p.tolist(), q.tolist(), gain.tolist()):
        edges.setdefault(a, []).append((b, g))
    low = -1e18
    kept, inside = [low] * (n + 1), [low] * (n + 1)
    kept[n] = inside[n] = 0.0
    for at in range(n - 1, -1, -1):
        best = max([g + inside[to] for to, g in edges[at]]) if at in edges else low
        on = kept[at + step[at]] if step[at] else low
        kept[at] = max(on, best - ENTER)
        inside[at] = max(on + after[at] if step[at] else low, best)
    return kept, inside


#: Sequences in a row that make a place suspicious, or certain enough to be left out of the counts.
SUSPICIOUS, CERTAIN = 1, 3

_TRIGGER = re.compile("[¡-ÿŒ-Ÿ–-™]{3,}|" + TRACES.pattern)

#: Characters between two suspicious ones that still belong to one stretch, and around it.
GAP, AROUND = 10, 4


def marked(text: str, codes: np.ndarray, how: int = SUSPICIOUS) -> list[tuple[int, int]]:
    """Places that by their bytes alone look wrongly decoded, however common their characters are.

    These are sequences of UTF-8 read in single bytes, traces of lost
    characters, one sequence of UTF-8 more read in two bytes, and runs that
    with their bytes swapped are all of one kind.
    """
    out = [m.span() for m in _TRIGGER.finditer(text)] if how == SUSPICIOUS else []
    place = np.flatnonzero(codes >= 0x80)
    if len(place) < 2:
        return out
    kind = codes[place]
    few = place[(kind < 0x2600) | (kind >= 0xF000)]  # no others are in a single-byte encoding
    for codec in READ_SINGLE if len(few) > 1 else ():
        data = np.append(_read_as(codes[few], codec)[:, 0], [NONE] * 4)
        at, rest = np.append(few, [-9] * 4), (data >= 0x80) & (data < 0xC0)
        size = np.where(data < 0xC2, 0, np.where(data < 0xE0, 2, np.where(data < 0xF0, 3, np.where(data < 0xF5, 4, 0))))[:-4]
        n = len(size)
        for k in (1, 2, 3):
            size[(size > k) & ~(rest[k : n + k] & (at[k : n + k] - few == k))] = 0
        start = np.flatnonzero(size)
        end = start + size[start]
        for _ in range(how - 1):  # another sequence right behind
            more = (size[np.minimum(end, n - 1)] > 0) & (end < n) & (at[end] - at[end - 1] == 1)
            start, end = start[more], end[more]
            end = end + size[end]
        out += zip(few[start].tolist(), (few[end - 1] + 1).tolist())
    high, low = codes[place] >> 8, codes[place] & 255
    out += _runs(place, (low == 0) & (high < 0x80), 3 * how + 1)
    out += _runs(place, (low >= 0x4E) & (low < 0xA0) & (high < 0x100), 6 + 6 * how)
    short = np.minimum(kind, 0xFFFF)
    for codec in READ_DOUBLE:
        role = _roles(codec)[short]
        is_ = lambda i, one, two: (role[i : len(role) - 3 + i] & one > 0) & (role[i : len(role) - 3 + i] & two > 0)  # noqa: B023, E731
        maybe = np.flatnonzero((is_(0, _LEAD1, _REST2) & is_(1, _REST1, _LEAD2) & is_(2, _REST1, _REST2)) | (is_(0, _LEAD2, _LEAD2) & is_(1, _REST1, _REST2) & is_(2, _LEAD1, _REST2)))
        if not len(maybe):
            continue
        some = place[np.unique(np.clip(maybe[:, None] + np.arange(-4, 9 * how), 0, len(place) - 1))]
        rows = _read_as(codes[some], codec)
        has = rows != NONE
        data, own = rows[has], np.repeat(some, has.sum(axis=1))
        n = len(data) - 3 * how - 3
        if n <= 0:
            continue
        rest = (data >= 0x80) & (data < 0xC0)
        seq = (data[:-2] >= 0xE0) & (data[:-2] < 0xF0) & rest[1:-1] & rest[2:] & (own[2:] - own[:-2] <= 2)
        all_of = np.logical_and.reduce([seq[3 * i : 3 * i + n] for i in range(how + 1)] + [own[3 * i + 3 : 3 * i + 3 + n] - own[3 * i : 3 * i + n] <= 2 for i in range(how)])
        at = np.flatnonzero(all_of)
        out += zip(own[at].tolist(), (own[at + 3 * how + 2] + 1).tolist())
    return out


def _runs(place: np.ndarray, kind: np.ndarray, least: int) -> list[tuple[int, int]]:
    """Runs of neighbouring places of one kind, of at least so many."""
    at = place[kind]
    if len(at) < least:
        return []
    cut = np.flatnonzero(np.diff(at) != 1) + 1
    return [(int(r[0]), int(r[-1]) + 1) for r in np.split(at, cut) if len(r) >= least]


def stretches(model: Model, texts: list[str]) -> list[list[tuple[int, int]]]:
    """Suspicious stretches of each text: around rare characters and byte patterns of wrong decodings."""
    whole = "\n".join(texts)
    codes = _codes(whole)
    spots = [(i, i + 1) for i in np.flatnonzero(model.rare[codes]).tolist()] + marked(whole, codes)
    spots.sort()
    sizes = np.array([len(x) + 1 for x in texts])
    heads = np.cumsum(sizes) - sizes
    owner = np.searchsorted(heads, [a for a, _ in spots], "right") - 1
    out: list[list[tuple[int, int]]] = [[] for _ in texts]
    for t, (a, b) in zip(owner.tolist(), spots):
        a, b, mine = a - int(heads[t]), b - int(heads[t]), out[t]
        a0, b0 = max(0, a - AROUND), min(len(texts[t]), b + AROUND)
        if mine and a - (mine[-1][1] - AROUND) <= GAP:
            mine[-1] = (mine[-1][0], max(mine[-1][1], b0))
        else:
            mine.append((a0, b0))
    return out


#: States kept in the first, bounding pass of a search.
BEAM = 4


#: Swapped bytes always make some character, so that a few (such as an ideographic space among digits) prove nothing.
LEAST_SWAPPED = 4


def _proves(text: str, got: tuple[float, str] | None, written: str) -> bool:
    return got is not None and (written != "swapped" or sum(a != b for a, b in zip(text, got[1])) >= LEAST_SWAPPED)


#: Times a text may have been decoded wrongly, one upon the other.
ROUNDS = 3


def decode_once(model: Model, text: str, known: list[Bound]) -> tuple[float, str, str | None]:
    """(bits gained, restored text, channel) of one stretch.

    All channels are searched, but those that provably cannot gain the margin
    or more than the best so far; a quick pass over each gives the bound below
    which the search proper drops states.
    """
    best, sure, firsts = (0.0, text, None), 0.0, {}
    for bound, read, written, rest in known:
        goal = max(sure, MARGIN_UTF8 if written == "utf-8" else MARGIN)
        if bound >= goal - 1e-6:
            quick = search(model, text, read, written, rest, goal, BEAM)
            if _proves(text, quick, written) and quick[0] >= goal:
                sure = firsts[read, written] = quick[0]
    for bound, read, written, rest in sorted(known, key=lambda x: -firsts.get((x[1], x[2]), 0.0)):
        goal = max(best[0], sure, MARGIN_UTF8 if written == "utf-8" else MARGIN)
        if bound >= goal - 1e-6:
            got = search(model, text, read, written, rest, goal)
            if _proves(text, got, written) and got[0] >= goal - 1e-6 and got[0] > best[0]:
                best = (got[0], got[1], f"{written} read as {read}")
    return best


def repair_all(model: Model, texts: list[str]) -> list[tuple[bool, str, list[str], float]]:
    """(damaged, restored text, channels, bits gained) of each whole text; about ``TOGETHER`` characters are judged at once."""
    spots = stretches(model, texts)
    parts = [[texts[t][a:b], 0.0, None] for t, spot in enumerate(spots) for a, b in spot]
    todo = list(range(len(parts)))
    for _ in range(ROUNDS):
        changed = []
        for lo, hi in portions([len(parts[i][0]) for i in todo], TOGETHER):
            some = todo[lo:hi]
            for i, known in zip(some, bounds(model, [parts[i][0] for i in some])):
                gain, better, channel = decode_once(model, parts[i][0], known) if known else (0.0, "", None)
                if channel:
                    parts[i] = [better, parts[i][1] + gain, parts[i][2] or channel]
                    changed.append(i)
        if not changed:
            break
        todo = [i for i, left in zip(changed, stretches(model, [parts[i][0] for i in changed])) if left]
        if not todo:
            break
    fixed = iter(parts)
    out = []
    for text, spot in zip(texts, spots):
        pieces, at, channels, gained = [], 0, [], 0.0
        for (a, b), (better, gain, channel) in zip(spot, fixed):
            if channel:
                pieces += [text[at:a], better]
                at = b
                gained += float(gain)
                if channel not in channels:
                    channels.append(channel)
        out.append((bool(channels) or bool(TRACES.search(text)), "".join([*pieces, text[at:]]), channels, gained))
    return out


def repair(model: Model, text: str) -> tuple[bool, str, list[str], float]:
    """The same of one text."""
    return repair_all(model, [text])[0]


_models: dict[int, Model] = {}


def _worker(shared: object) -> Model:
    if id(shared) not in _models:
        _models.clear()
        _models[id(shared)] = Model(*shared.value)
    return _models[id(shared)]


def share_model(spark: SparkSession, counts: tuple[np.ndarray, np.ndarray, int]) -> object:
    pairs, chars, docs = counts
    return spark.sparkContext.broadcast((pairs.astype(np.int32), chars.astype(np.int32), docs))


def restore(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Every damaged text: key, ``text``, ``restored``, ``channels`` and ``bits``.

    ``restored`` is the most likely original; where nothing can be regained it
    equals the text, with no channels. Null, empty and blank texts, and texts
    without damage, give no row; repeated keys are texts of their own. Other
    columns are ignored, whatever their names. The counts are taken over all
    texts of the table, the damaged ones included.
    """
    spark = df.sparkSession
    rows = df.select(F.col(f"`{key}`").alias("__key"), F.col(f"`{text}`").alias("__text")).filter(F.col("__text").rlike(r"[^\x00-\x7F]"))
    shared = share_model(spark, corpus_counts(df, text))

    kind = dict(rows.dtypes)["__key"]

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = _worker(shared)
        for batch in batches:
            texts = batch.column(1).to_pylist()
            results = (zip(range(lo, hi), repair_all(model, texts[lo:hi])) for lo, hi in portions([len(x) for x in texts], 5 * TOGETHER))
            found = [(i, *result) for portion in results for i, result in portion if result[0]]
            at = [f[0] for f in found]
            columns = [pa.array([texts[i] for i in at], pa.string()), pa.array([f[2] for f in found], pa.string()), pa.array([f[3] for f in found], pa.list_(pa.string())), pa.array([f[4] for f in found], pa.float64())]
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), *columns], names=[key, "text", "restored", "channels", "bits"])

    #: The search costs far more than moving the text, so it is spread evenly, whatever the layout of the files
    #: (and as a map over batches, which the optimizer cannot move below the exchange).
    tasks = 2 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = rows.repartition(tasks, F.xxhash64("__key", "__text"))
    return spread.mapInArrow(judge, f"`{key}` {kind}, text string, restored string, channels array<string>, bits double")


def normal_form(text: str) -> str:
    """NFC, for comparing restorations."""
    return unicodedata.normalize("NFC", text)
