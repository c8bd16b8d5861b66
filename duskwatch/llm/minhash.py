"""MinHash near-duplicates with HyperMinHash registers: leading-zero counts plus mantissa bits for each bucket."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .linking import linked_groups
from .work import dropped, keeping, written

U = np.uint64
BUCKETS, ZERO_BITS, MANTISSA_BITS = 128, 6, 10
#: 25 bands of 5 registers: a pair at similarity 0.85 shares no band with a chance of 5e-7, at 0.8 of 5e-5.
BANDS, ROWS = 25, 5
#: Estimates this far (5 standard deviations of 128 registers) below the threshold are not verified.
SLACK = 5


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """(text index, shingle hash), distinct, sorted by both. A text with 1 to n - 1 words is one shingle."""
    buf, at = flat.joined(texts)
    starts, ends = flat.bounds(~flat.SPACE[buf])
    doc = np.searchsorted(at, starts, "right") - 1
    words = flat.hashes(flat.LOWER[buf], starts, ends)
    h, first = flat.grams(words, doc, n)
    count = np.bincount(doc, minlength=len(texts))
    short = np.flatnonzero((count > 0) & (count < n))
    where = np.searchsorted(doc, short)
    one = np.full(len(short), U(0x51ED27), np.uint64)
    for k in range(n - 1):
        has = count[short] > k
        one[has] = flat.mixed((one[has] ^ words[where[has] + k]) * U(flat.P) + U(k + 1))
    owner, h = np.concatenate([doc[first], short]), np.concatenate([h, one])
    order = np.lexsort((h, owner))
    owner, h = owner[order], h[order]
    new = np.ones(len(h), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (h[1:] != h[:-1])
    return owner[new], h[new]


def registers(owner: np.ndarray, h: np.ndarray, count: int) -> np.ndarray:
    """HyperMinHash of each set: (count, BUCKETS) uint32, all 0 for an empty set.

    A bucket keeps the leading zeros and the next mantissa bits of the smallest hash dealt to it. Buckets that stay empty
    take theirs from a further dealing with another seed, whose number the register also holds; so a register of two
    sets agrees with the chance of their Jaccard similarity at every set size, but for collisions of the compressed values.
    """
    out = np.zeros((count, BUCKETS), np.uint32)
    empty = np.zeros(count, bool)
    empty[owner] = True
    rounds = 0
    while len(owner):
        x = flat.mixed(h + U(rounds * flat.P_INV % 2**64)) if rounds else flat.mixed(h)
        value = np.full(count * BUCKETS, U(2**64 - 1), np.uint64)
        slot = owner * BUCKETS + (x >> U(57)).astype(np.int64)
        np.minimum.at(value, slot, (x << U(7)) | U(1))
        got = np.flatnonzero((value != U(2**64 - 1)) & (out.ravel() == 0))
        v = value[got]
        zeros = 63 - np.floor(np.log2(v.astype(np.float64))).astype(np.int64).clip(0, 63)
        zeros += (v >> (U(63) - np.minimum(zeros, 63).astype(np.uint64))) == 0  # float rounding at powers of two
        zeros = np.minimum(zeros, 57)
        mantissa = (v << (zeros.astype(np.uint64) + U(1))) >> U(64 - MANTISSA_BITS)
        out.ravel()[got] = (min(rounds, 65534) + 1) << (ZERO_BITS + MANTISSA_BITS) | zeros << MANTISSA_BITS | mantissa.astype(np.int64)
        open_ = (out == 0).any(axis=1) & empty
        if rounds >= 65000:
            break
        rest = open_[owner]
        owner, h, rounds = owner[rest], h[rest], rounds + 1
    return out


def estimate(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Jaccard similarity from the share of equal registers, less what compressed values agree by chance.

    Two different minima share zero count and mantissa with a chance near 1 / (3 * 2**MANTISSA_BITS): geometric zeros agree
    with 1/3, mantissas with 2**-MANTISSA_BITS."""
    chance = 1 / (3 * 2**MANTISSA_BITS)
    return ((a == b).mean(axis=1) - chance) / (1 - chance)


def _signed(texts_n: int):
    n = texts_n

    def run(batches):
        for batch in batches:
            ids = batch.column(0)
            for i, j, texts in flat.chunks(batch):
                owner, h = shingle_sets(texts, n)
                regs = registers(owner, h, j - i)
                size = np.bincount(owner, minlength=j - i)
                print_a, print_b = np.zeros(j - i, np.uint64), np.zeros(j - i, np.uint64)
                np.add.at(print_a, owner, flat.mixed(h))
                np.add.at(print_b, owner, flat.mixed(h ^ U(flat.P)))
                packed = regs.astype("<u4").tobytes()
                yield pa.RecordBatch.from_arrays(
                    [ids.slice(i, j - i), pa.array(size, pa.int64()), pa.array(print_a.view(np.int64)), pa.array(print_b.view(np.int64)),
                     pa.array([packed[k * BUCKETS * 4 : (k + 1) * BUCKETS * 4] for k in range(j - i)], pa.binary())],
                    ["doc_id", "n_shingles", "print_a", "print_b", "regs"])

    return run


def _matrix(col) -> np.ndarray:
    return np.frombuffer(b"".join(col.to_pylist()), "<u4").reshape(-1, BUCKETS)


def _banded(batches):
    for batch in batches:
        if not batch.num_rows:
            continue
        regs = _matrix(batch.column(1)).astype(np.uint64)
        key = np.empty((len(regs), BANDS), np.uint64)
        for b in range(BANDS):
            h = np.full(len(regs), U(b + 1), np.uint64)
            for k in range(b * ROWS, b * ROWS + ROWS):
                h = flat.mixed(h * U(flat.P) + regs[:, k])
            key[:, b] = h
        ids = np.repeat(batch.column(0).to_numpy(zero_copy_only=False), BANDS)
        yield pa.RecordBatch.from_arrays([pa.array(key.ravel().view(np.int64)), pa.array(ids, pa.int64())], ["key", "id"])


def _likely(least: float):
    def run(batches):
        for batch in batches:
            if batch.num_rows:
                ok = estimate(_matrix(batch.column(2)), _matrix(batch.column(3))) >= least
                yield batch.select([0, 1]).filter(pa.array(ok))

    return run


def _as_sets(n: int):
    def run(batches):
        for batch in batches:
            for i, j, texts in flat.chunks(batch):
                owner, h = shingle_sets(texts, n)
                cut = np.searchsorted(owner, np.arange(j - i + 1)) * 8
                raw = h.tobytes()
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(i, j - i), pa.array([raw[cut[k] : cut[k + 1]] for k in range(j - i)], pa.binary())], ["id", "hashes"])

    return run


def _as_items(n: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, texts in flat.chunks(batch):
                owner, h = shingle_sets(texts, n)
                yield pa.RecordBatch.from_arrays([pa.array(ids[i:j][owner], pa.int64()), pa.array(h.view(np.int64)), pa.array(np.bincount(owner, minlength=j - i)[owner], pa.int64())], ["id", "item", "n"])

    return run


def _verified(percent: int):
    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = 0
                if len(x) and len(y):
                    place = np.searchsorted(x, y).clip(0, len(x) - 1)
                    both = int((x[place] == y).sum())
                ok.append(both > 0 and 100 * both >= percent * (len(x) + len(y) - both))
            yield batch.select([0, 1]).filter(pa.array(ok, pa.bool_()))

    return run


def near_duplicates(docs: DataFrame, words: int = 5, percent: int = 80, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Near-duplicate groups of whole texts: doc_id, n_shingles, component_id, kept.

    A text's set holds its distinct shingles of ``words`` words (A-Z lowered, split at blanks); a shorter text is one shingle.
    Texts are linked if 100 * intersection >= percent * union on the full sets; component_id is the smallest doc_id reachable.
    Equal sets collapse to one representative before signatures are banded, and their members take its component.
    Null and blank texts have an empty set, no links and stay. Null ids are left out: a row without an id cannot be named.
    Rows that repeat an id give one result row each; if their texts differ, one of them stands for the id when links are confirmed.
    An empty table gives no rows.
    Other columns are ignored, whatever their names.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    signed = written(texts.mapInArrow(_signed(words), "doc_id long, n_shingles long, print_a long, print_b long, regs binary"))
    full = signed.where("n_shingles > 0")
    # written first, so that the join shuffles both sides and a large group of copies can be split over tasks
    reps = written(full.groupBy("print_a", "print_b", "n_shingles").agg(F.min("doc_id").alias("rep")))
    member = written(full.join(reps, ["print_a", "print_b", "n_shingles"]).select("doc_id", "n_shingles", "rep"))
    alone = written(full.select(F.col("doc_id").alias("id"), "regs").join(member.select(F.col("rep").alias("id")).distinct(), "id", "left_semi").dropDuplicates(["id"]))
    buckets = written(alone.select("id", "regs").mapInArrow(_banded, "key long, id long"))
    least = percent / 100 - SLACK * (percent / 100 * (1 - percent / 100) / BUCKETS) ** 0.5

    def confirm(pairs: DataFrame) -> DataFrame:
        both = pairs.join(alone.select(F.col("id").alias("a"), F.col("regs").alias("ra")), "a").join(alone.select(F.col("id").alias("b"), F.col("regs").alias("rb")), "b")
        likely = written(both.select("a", "b", "ra", "rb").mapInArrow(_likely(least), "a long, b long"))
        ends = written(likely.select(F.col("a").alias("id")).union(likely.select("b")).distinct())
        some = keeping(texts.withColumnRenamed("doc_id", "id"), ends, "id", ends.count()).dropDuplicates(["id"])
        sets = written(some.mapInArrow(_as_sets(words), "id long, hashes binary"))
        both = likely.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
        sure = written(both.select("a", "b", "ha", "hb").mapInArrow(_verified(percent), "a long, b long"))
        dropped(sets, likely, ends)
        return sure

    def items(ids: DataFrame, count: int) -> DataFrame:
        return keeping(texts.withColumnRenamed("doc_id", "id"), ids, "id", count).dropDuplicates(["id"]).mapInArrow(_as_items(words), "id long, item long, n long")

    labels = linked_groups(buckets, confirm, items, percent)
    group = member.join(labels.withColumnRenamed("id", "rep"), "rep", "left").select("doc_id", "n_shingles", F.coalesce("component", "rep").alias("component_id"))
    alone_rows = signed.where("n_shingles = 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id"))
    return group.unionByName(alone_rows).withColumn("kept", F.col("doc_id") == F.col("component_id"))
