"""Benchmark decontamination: CGK embedding of windows, repeated bit sampling, exact edit verification."""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .work import written

U = np.uint64
#: Independent walks, each with its own bit sample; steps of a walk that a sample draws from, and bits that it keeps (the first among them).
WALKS, STEPS, KEPT = 12, 24, 11
#: Steps over which the two item-sized windows of a hit are compared by Hamming distance, in three parts. After each, more than a quarter of the
#: steps must agree by this many roots of their number: of unrelated windows about one step in six agrees, of windows with 20 % edits two in five.
COMPARED, SPREAD = (14, 32, 96), (0.0, 0.6, 1.05)
#: Agreements from which one hit alone is verified; with fewer, two windows of the item must point to the same place.
ALONE = 60
#: Largest total size of benchmark items that one pass holds; more items take more passes over the documents.
BLOCK_BYTES = 4_000_000
#: Items reduced to fewer bytes have no room for windows and are looked up whole, between word ends.
LEAST_BYTES = 24
#: Hits that are compared, and pairs that are verified, at once; starts that are walked at once, so that their arrays stay in the processor's cache.
AT_ONCE, PAIRS_AT_ONCE, STARTS_AT_ONCE = 16_000, 2000, 16_000

_rng = np.random.default_rng(1729)
#: One random bit for each walk, step and byte: whether the walk moves on in the input after this byte. A walk stays at a text's end.
MOVES = _rng.integers(0, 2, (WALKS, COMPARED[-1], 256)).astype(np.int32)
MOVES[:, :, 10] = 0
#: For each kept step of a walk the value of each byte; None for steps that the sample leaves out.
SAMPLES: list[list] = []
for _w in range(WALKS):
    _kept = {0, *(1 + _rng.permutation(STEPS - 1)[: KEPT - 1]).tolist()}
    SAMPLES.append([_rng.integers(1, 2**63, 256, dtype=np.uint64) if k in _kept else None for k in range(STEPS)])
#: Numbers of the bytes that reduced texts are made of.
BYTES = np.flatnonzero(np.isin(flat.LOWER, np.flatnonzero(flat.ALNUM)) & (np.arange(256) == flat.LOWER) | np.isin(np.arange(256), (10, 32)))
CLASS = np.zeros(256, np.intp)
CLASS[BYTES] = np.arange(len(BYTES))


def normalised(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Lowered letters and digits with single blanks between words, a newline after each text; starts of the texts."""
    buf, at = flat.joined(texts)
    low = flat.lowered(buf)
    keep = flat.ALNUM[low]
    ends = np.zeros(len(buf), bool)
    ends[at[1:] - 1] = True
    out = np.where(keep, low, 32).astype(np.uint8)
    out[ends] = 10
    blank = ~keep
    drop = blank & ~ends & np.concatenate([[True], blank[:-1]])
    out, ends = out[~drop], ends[~drop]
    return out, np.concatenate([[0], np.flatnonzero(ends) + 1])


def windows(buf: np.ndarray) -> np.ndarray:
    """Starts of words, where windows begin."""
    word = buf > 32
    return np.flatnonzero(word & ~np.concatenate([[False], word[:-1]]))


@cache
def _strides(walk: int) -> list[np.ndarray]:
    """For every two steps of a walk, by the numbers of the byte it stands on and of the next: the sum of the steps' values, with their moves in the two lowest bits."""
    here, after = np.repeat(BYTES, len(BYTES)), np.tile(BYTES, len(BYTES))
    out = []
    for step in range(0, STEPS, 2):
        one, two = SAMPLES[walk][step : step + 2]
        moved = MOVES[walk, step][here]
        second = np.where(moved == 1, after, here)
        value = (0 if one is None else one[here]) + (0 if two is None else two[second]) + np.zeros(len(here), np.uint64)
        out.append(value & ~U(3) | (moved + MOVES[walk, step + 1][second]).astype(np.uint64))
    return out


def strided(buf: np.ndarray) -> np.ndarray:
    """The number of each byte and the next together."""
    kind = CLASS[buf]
    pair = kind * len(BYTES)
    pair[:-1] += kind[1:]
    return pair


def sampled_bits(pair: np.ndarray, starts: np.ndarray, walk: int) -> np.ndarray:
    """Hash of the sampled positions of the CGK embedding of the window at each start of a buffer given by :func:`strided`.

    The walk copies the current byte to the output at every step and moves on in the input by a random bit of step and byte; after an edit
    two walks fall into step again, so edit distance becomes Hamming distance. At the end of a text it stays."""
    out = np.zeros(len(starts), np.uint64)
    for k in range(0, len(starts), STARTS_AT_ONCE):
        begin = starts[k : k + STARTS_AT_ONCE].astype(np.intp)
        at, key = begin.copy(), np.zeros(len(begin), np.uint64)
        for table in _strides(walk):
            got = table.take(pair.take(at))
            key += got
            got &= U(3)
            at += got.view(np.int64)
        at -= begin
        key -= at.view(np.uint64)
        out[k : k + STARTS_AT_ONCE] = flat.mixed(key)
    return out


def embedded(buf: np.ndarray, starts: np.ndarray, steps: int, rest: int) -> np.ndarray:
    """The first ``steps`` bytes of walk 0 from each start, eight in a word, as rows of words; the last word is filled up with bytes ``rest``."""
    out = np.zeros((-(-steps // 8), len(starts)), np.uint64)
    for begin in range(0, len(starts), STARTS_AT_ONCE):
        at = starts[begin : begin + STARTS_AT_ONCE].astype(np.intp)
        part = np.full((len(at), 8 * len(out)), rest, np.uint8)
        for k in range(steps):
            c = buf.take(at)
            part[:, k] = c
            at += MOVES[0, k].take(c)
        out[:, begin : begin + STARTS_AT_ONCE] = part.view(np.uint64).T
    return out


LOW = U(0x7F7F7F7F7F7F7F7F)


def agreements(items: Items, window: np.ndarray, first: np.ndarray, buf: np.ndarray, starts: np.ndarray, place: np.ndarray) -> np.ndarray:
    """Steps in which the CGK embeddings of items' windows and of those at starts[place] of buf agree; 0 for pairs with too few.

    ``first`` holds the starts' embeddings for the first part of COMPARED. An item's last windows end before the walk does: its bytes are 0 from there on and agree with none."""
    out = np.zeros(len(window), np.int32)
    live, two, row = np.arange(len(window)), first, place
    for part, stop in enumerate(COMPARED):
        if part:
            each, row = np.unique(place[live], return_inverse=True)
            two = embedded(buf, starts[each], stop, 1)
        w = window[live] if part else window
        same = np.zeros(len(w), np.uint8)
        for one, other in zip(items.embedded[part], two, strict=True):
            x = one.take(w)
            x ^= other.take(row)
            y = x & LOW
            y += LOW
            y |= x
            y |= LOW  # each byte of x that is 0 now lacks its highest bit
            same += 64 - np.bitwise_count(y)
        ok = np.flatnonzero(same >= items.least[part].take(w))
        live, same = live[ok], same[ok]
    out[live] = same
    return out


class Items:
    """The benchmark's side: for each walk the sorted bit samples of its windows, and short items by their whole hash."""

    def __init__(self, ids: list[int], texts: list[bytes], percent: int):
        self.ids, self.percent = ids, percent
        self.buf, self.at = normalised(texts)
        self.texts = [self.buf[s : e - 1].tobytes().strip() for s, e in zip(self.at[:-1], self.at[1:], strict=True)]
        size = np.array([len(t) for t in self.texts], np.int64)
        self.starts = windows(self.buf)
        self.item = np.searchsorted(self.at, self.starts, "right") - 1
        # a window needs room for the sampled steps inside the item, but for an item's first one
        room = (self.at[self.item + 1] - self.starts > STEPS // 2 + 8) | (self.starts - self.at[self.item] < 2)
        ok = room & (size >= LEAST_BYTES)[self.item] if len(self.item) else room
        self.starts, self.item = self.starts[ok], self.item[ok]
        self.offset = self.starts - self.at[self.item]
        every = embedded(self.buf, self.starts, COMPARED[-1], 0)
        every = every.T.copy().view(np.uint8)
        every[every == 10] = 0
        self.embedded, self.least = [], []
        for stop, spread in zip(COMPARED, SPREAD, strict=True):
            part = every[:, : -(-stop // 8) * 8].copy()
            part[:, stop:] = 0
            taken = (part > 0).sum(axis=1)
            self.embedded.append(part.view(np.uint64).T.copy())
            self.least.append(np.ceil(taken / 4 + spread * np.sqrt(taken)).astype(np.uint8))
        self.tables = []
        pair = strided(self.buf)
        for w in range(WALKS):
            key = sampled_bits(pair, self.starts, w)
            order = np.argsort(key, kind="stable")
            seen = np.zeros(1 << 22, bool)
            seen[(key >> U(42)).astype(np.int64)] = True
            self.tables.append((seen, key[order], order))
        self.short: dict[int, dict[bytes, list[int]]] = {}
        for k in np.flatnonzero((size > 0) & (size < LEAST_BYTES)):
            self.short.setdefault(int(size[k]), {}).setdefault(self.texts[k], []).append(int(k))

    def most(self, item: int) -> int:
        """Edits that an occurrence of the item may have."""
        return len(self.texts[item]) * (100 - self.percent) // 100

    def hits(self, buf: np.ndarray, starts: np.ndarray):
        """(window of an item, number of a start in buf) pairs that share a bit sample, in bounded parts."""
        pair = strided(buf)
        for w, (seen, key, order) in enumerate(self.tables):
            got = sampled_bits(pair, starts, w)
            maybe = np.flatnonzero(seen[(got >> U(42)).astype(np.int64)])
            lo, hi = np.searchsorted(key, got[maybe], "left"), np.searchsorted(key, got[maybe], "right")
            total = np.cumsum(hi - lo)
            begin = 0
            while begin < len(maybe):
                end = max(begin + 1, int(np.searchsorted(total, (total[begin - 1] if begin else 0) + AT_ONCE, "right")))
                n = (hi - lo)[begin:end]
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(lo[begin:end], n)
                yield order[place], np.repeat(maybe[begin:end], n)
                begin = end

    def candidates(self, buf: np.ndarray) -> list[tuple[int, int]]:
        """(item, where it would start in buf): item-sized windows whose embeddings are near by Hamming distance."""
        parts = []
        starts = windows(buf)
        first = embedded(buf, starts, COMPARED[0], 1)
        for window, place in self.hits(buf, starts):
            same = agreements(self, window, first, buf, starts, place)
            ok = same > 0
            parts.append((window[ok], starts[place[ok]] - self.offset[window[ok]], same[ok]))
        if not parts:
            return []
        window, begin, same = (np.concatenate([x[k] for x in parts]) for k in range(3))
        out: set[tuple[int, int]] = set()
        for shift in (0, 32):  # places near the end of one stretch of 64 bytes are near the start of the next
            key = self.item[window].astype(np.int64) << 40 | (begin + shift + (1 << 20)) >> 6
            order = np.lexsort((window, key))
            k, w, s, b = key[order], window[order], same[order], begin[order]
            if not len(k):
                continue
            head = np.flatnonzero(np.concatenate([[True], k[1:] != k[:-1]]))
            tail = np.concatenate([head[1:], [len(k)]]) - 1
            good = (w[tail] != w[head]) | (np.maximum.reduceat(s, head) >= ALONE)
            out.update(zip(self.item[w[head[good]]].tolist(), b[head[good]].tolist(), strict=True))
        kept: list[tuple[int, int]] = []
        for item, start in sorted(out):  # what is verified reaches 64 bytes beyond either end, so places this near are one
            if not kept or kept[-1][0] != item or start - kept[-1][1] > 48:
                kept.append((item, start))
        return kept

    def whole(self, buf: np.ndarray) -> list[tuple[int, int]]:
        """(item, start in buf) of every short item that stands in buf as whole words."""
        out, starts = [], windows(buf)
        for size, named in self.short.items():
            at = starts[starts + size < len(buf)]
            at = at[buf[at + size] <= 32]
            first = {t[0] for t in named}
            at = at[np.isin(buf[at], list(first))]
            for p in at.tolist():
                out.extend((k, p) for k in named.get(buf[p : p + size].tobytes(), ()))
        return out


def nearest(goals: list[bytes], texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """For each pair the fewest edits that turn the goal into some piece of the text, and where the first such piece ends.

    Bit-parallel columns of the edit table, for all pairs together: words of 64 rows carry their lowest row's step into the next word."""
    size, length = np.array([len(g) for g in goals]), np.array([len(t) for t in texts])
    words = max(1, -(-int(size.max()) // 64))
    kinds = {g: k for k, g in enumerate(dict.fromkeys(goals))}
    match = np.zeros((words, len(kinds), 256), np.uint64)
    for g, k in kinds.items():
        for at, c in enumerate(g):
            match[at >> 6, k, c] |= U(1 << (at & 63))
    match = match.reshape(words, -1)
    kind = np.array([kinds[g] for g in goals], np.intp) << 8
    text = np.full((len(texts), int(length.max(initial=0))), 10, np.uint8)
    for k, t in enumerate(texts):
        text[k, : len(t)] = np.frombuffer(t, np.uint8)
    text = text.T.copy()
    up, down = np.full((words, len(goals)), U(2**64 - 1)), np.zeros((words, len(goals)), np.uint64)
    last, bit = (size - 1) >> 6, ((size - 1) & 63).astype(np.uint64)
    one, score = U(1), size.copy()
    ends_in = [np.flatnonzero(last == w) for w in range(words)]
    ends_in = [here if len(here) < len(goals) else slice(None) for here in ends_in]
    bits = [bit[here] for here in ends_in]
    best, end = size.copy(), np.zeros(len(goals), np.int64)  # the empty piece
    for col in range(len(text)):
        c = text[col] + kind
        more, less = np.zeros(len(goals), np.uint64), np.zeros(len(goals), np.uint64)
        for w in range(words):
            eq = match[w].take(c)
            pv, mv = up[w], down[w]
            xv = eq | mv
            eq |= less
            xh = eq & pv
            xh += pv
            xh ^= pv
            xh |= eq
            ph, mh = mv | ~(xh | pv), pv & xh
            here = ends_in[w]
            if len(bits[w]):
                score[here] += ((ph[here] >> bits[w]) & one).view(np.int64) - ((mh[here] >> bits[w]) & one).view(np.int64)
            out_more, out_less = ph >> U(63), mh >> U(63)
            ph <<= one
            ph |= more
            mh <<= one
            mh |= less
            more, less = out_more, out_less
            up[w], down[w] = mh | ~(xv | ph), ph & xv
        better = np.flatnonzero((score < best) & (col < length))
        best[better], end[better] = score[better], col + 1
    return best, end


def infix_edits(item: bytes, text: bytes, most: int) -> tuple[int, int]:
    """:func:`nearest` of one pair; (most + 1, -1) if more than ``most`` edits are needed."""
    best, end = nearest([item], [text])
    return (int(best[0]), int(end[0])) if best[0] <= most else (most + 1, -1)


def _found(items: Items):
    def verified(pending: list[tuple], done: dict) -> None:
        pending.sort(key=lambda p: len(items.texts[p[0]]))  # goals of about one size together
        for k in range(0, len(pending), PAIRS_AT_ONCE):
            part = pending[k : k + PAIRS_AT_ONCE]
            edits, ends = nearest([items.texts[p[0]] for p in part], [p[3] for p in part])
            for (item, row, lo, _), e, end in zip(part, edits.tolist(), ends.tolist(), strict=True):
                most = items.most(item)
                if e <= most:
                    done[row, item] = min(done.get((row, item), (most + 1, 0)), (e, lo + end))
        pending.clear()

    def run(batches):
        for batch in batches:
            ids, done, pending = batch.column(0), {}, []
            for i, _, texts in flat.chunks(batch):
                buf, at = normalised(texts)
                for item, start in items.candidates(buf):
                    size, most = len(items.texts[item]), items.most(item)
                    for d in {int(np.searchsorted(at, min(max(x, 0), len(buf) - 1), "right")) - 1 for x in (start, start + most, start + size)}:
                        lo, hi = max(int(at[d]), start - most - 64), min(int(at[d + 1]) - 1, start + size + most + 64)
                        if hi - lo >= size - most:
                            pending.append((item, i + d, lo - int(at[d]), buf[lo:hi].tobytes()))
                for item, start in items.whole(buf):
                    d = int(np.searchsorted(at, start, "right")) - 1
                    done[i + d, item] = min(done.get((i + d, item), (1, 0)), (0, start + len(items.texts[item]) - int(at[d])))
                if len(pending) >= PAIRS_AT_ONCE:
                    verified(pending, done)
            verified(pending, done)
            found = sorted(done.items())
            out = [ids.take(pa.array([r for (r, _), _ in found], pa.int64())), *(pa.array(v, pa.int64()) for v in (
                [items.ids[k] for (_, k), _ in found], [e for _, (e, _) in found], [len(items.texts[k]) for (_, k), _ in found], [end for _, (_, end) in found]))]
            yield pa.RecordBatch.from_arrays(out, ["doc_id", "item_id", "edits", "item_length", "match_end"])

    return run


def contaminated(docs: DataFrame, benchmark: DataFrame, percent: int = 80, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """Documents that hold a benchmark item, edits included: doc_id, item_id, edits, item_length, match_end.

    Texts and items are reduced to lowered letters and digits with single blanks. An item-sized window of a text is looked up at each of its words:
    there CGK walks begin, and WALKS repeated samples of their bits are compared with those of the item's window from each of its words on, so that edits
    before a word do not count against it. Windows that share a sample are compared by Hamming distance over COMPARED steps of the embedding; a place to
    which two windows of an item point (or one that agrees nearly everywhere) is verified: the piece counts if at most (100 - percent) % of the item's
    bytes must be edited. Items reduced to fewer than LEAST_BYTES bytes are found where they stand unedited as whole words.
    match_end counts bytes of the reduced text. An item found several times in a text gives the closest, then first match.

    Items go to the executors in blocks of at most BLOCK_BYTES, one block after another, each with its own pass. Null and empty texts hold nothing; null,
    empty and letterless items are never found. Null item ids are left out; null document ids are ids like others. Rows that repeat an id give a row each.
    Empty tables give no rows. Other columns are ignored.
    """
    rows = benchmark.select(F.col(item_col).cast("long").alias("i"), F.col(item_text).alias("t")).where("i IS NOT NULL AND t IS NOT NULL")
    texts = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text"))
    schema = f"doc_id {dict(docs.dtypes)[id_col]}, item_id long, edits long, item_length long, match_end long"
    total = rows.agg(F.sum(F.octet_length("t"))).first()[0] or 0
    blocks = -(-total // BLOCK_BYTES) or 1
    found = None
    for b in range(blocks):
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("i"), F.lit(blocks)) == b)
        got = sorted((r["i"], r["t"]) for r in part.collect())
        one = texts.mapInArrow(_found(Items([i for i, _ in got], [t.encode() for _, t in got], percent)), schema)
        one = one if blocks == 1 else written(one)  # one block's tables are held at a time
        found = one if found is None else found.unionByName(one)
    return found
