"""Exact repeats of long byte strings, by blockwise sorting of suffix buckets with cover samples."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .work import BROADCAST_ROWS, dropped, keeping, written

U = np.uint64
TOP = U(2**64 - 1)
#: Bytes of a cover string; every string of ``length`` bytes holds the start of at least one sampled one.
GRAM = 64
#: Contexts that are sorted together; a bucket with more distinct contexts than BUCKET is counted by its strings' hashes instead.
BLOCK, BUCKET = 20_000, 100_000


def _running(x: np.ndarray, n: int, pick) -> np.ndarray:
    """pick over x[i : i + n] for each i, by doubling."""
    width, out = 1, x
    while width * 2 <= n:
        out = pick(out[:-width], out[width:])
        width *= 2
    return pick(out[: len(x) - n + 1], out[n - width : n - width + len(x) - n + 1])


def sampled(buf: np.ndarray, at: np.ndarray, length: int):
    """Cover sample of texts laid end to end: positions whose GRAM-byte hash is the smallest of some ``length``-byte string.

    The choice depends on the string's bytes alone, so two equal strings have sampled positions at the same offset."""
    n, reach = len(buf), length - GRAM + 1
    if n < length + 1:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    start = np.arange(n - GRAM + 1)
    h = flat.hashes(buf, start, start + GRAM)
    whole = np.zeros(n, bool)  # starts of strings inside one text
    for s, e in zip(at[:-1], at[1:] - 1, strict=True):
        whole[s : max(s, e - length + 1)] = True
    low = _running(h, reach, np.minimum)
    low = np.where(whole[: len(low)], low, U(0))
    padded = np.concatenate([np.zeros(reach - 1, np.uint64), low, np.zeros(reach - 1, np.uint64)])
    best = _running(padded, reach, np.maximum)[: len(h)]
    chosen = np.flatnonzero((best == h) & (best > 0))
    return chosen, h[chosen]


def _clip(pos, at, doc, length):
    """Bounds of a position's context inside its text: ``length - GRAM`` bytes before it, ``length`` from it on."""
    return np.maximum(at[doc], pos - (length - GRAM)), np.minimum(at[doc + 1] - 1, pos + length)


def _samples(length: int):
    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, texts in flat.chunks(batch):
                buf, at = flat.joined(texts)
                pos, gram = sampled(buf, at, length)
                doc = np.searchsorted(at, pos, "right") - 1
                lo, hi = _clip(pos, at, doc, length)
                context = flat.mixed(flat.hashes(buf, lo, hi) + U(1000) * (pos - lo).astype(np.uint64) + (hi - pos).astype(np.uint64))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(gram.view(np.int64)), pa.array(context.view(np.int64)), pa.array(ids[i:j][doc], pa.int64()), pa.array((pos - at[doc]).astype(np.int32))],
                    ["gram", "context", "doc_id", "pos"])

    return run


def _contexts(length: int):
    """(gram, context, lo, hi, bytes) for the asked positions of each text; bytes beyond the text are 0xFF, which UTF-8 never holds."""
    before = length - GRAM

    def run(batches):
        for batch in batches:
            out = [[], [], [], [], []]
            for text, asked in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                raw = text.encode() if text else b""
                padded = b"\xff" * before + raw + b"\xff" * length
                for x in asked:
                    p = x["pos"]
                    if p + GRAM > len(raw):
                        continue
                    for k, v in enumerate((x["gram"], x["context"], max(0, p + length - len(raw)), min(before, p), padded[p : p + before + length])):
                        out[k].append(v)
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.binary()), strict=True)], ["gram", "context", "lo", "hi", "bytes"])

    return run


def _classes(keys: np.ndarray, rows: np.ndarray):
    """Sort ``rows`` (bytes) within ``keys``: the order, and how many leading bytes each shares with its neighbour before (-1: another key)."""
    words = np.ascontiguousarray(rows).view(">u8").astype(np.uint64)
    order = np.lexsort((*words.T[::-1], keys))
    same = rows[order[1:]] == rows[order[:-1]]
    shared = np.where(same.all(axis=1), rows.shape[1], same.argmin(axis=1))
    return order, np.concatenate([[-1], np.where(keys[order[1:]] == keys[order[:-1]], shared, -1)])


def repeated_offsets(gram: np.ndarray, lo: np.ndarray, hi: np.ndarray, rows: np.ndarray, length: int) -> np.ndarray:
    """For each context and offset o: does the string that starts o bytes before the sampled position occur in another context?

    The suffixes of a block are sorted once from the sampled position on and once backwards. The cover sample gives strings that start
    elsewhere their rank: two are equal if they agree on the o bytes before the position and on the length - o bytes from it on."""
    before = length - GRAM
    m = len(gram)
    right, r = _classes(gram, rows[:, before:])
    pad = -before % 8
    back = np.concatenate([rows[:, before - 1 :: -1] if before else rows[:, :0], np.zeros((m, pad), np.uint8)], axis=1)
    left, q = _classes(gram, back)
    out = np.zeros((m, before + 1), bool)
    for o in range(before + 1):
        a, b = np.empty(m, np.int64), np.empty(m, np.int64)
        a[right] = np.cumsum(r < length - o)
        b[left] = np.cumsum(q < o)
        fits = np.flatnonzero((lo <= o) & (o <= hi))
        key = a[fits] * (m + 1) + b[fits]
        order = np.argsort(key)
        equal = key[order[1:]] == key[order[:-1]]
        twice = np.concatenate([[False], equal]) | np.concatenate([equal, [False]])
        out[fits[order[twice[: len(fits)]]], o] = True
    return out


def _runs(out: np.ndarray):
    """Runs of True in each row: row, first and last column."""
    edge = np.diff(np.pad(out, ((0, 0), (1, 1))).astype(np.int8), axis=1)
    row, first = np.nonzero(edge == 1)
    return row, first, np.nonzero(edge == -1)[1] - 1


def _sorted_blocks(length: int):
    def settle(part):
        t = pa.Table.from_batches(part).combine_chunks()
        gram, lo, hi = (t.column(k).to_numpy() for k in ("gram", "lo", "hi"))
        rows = np.frombuffer(b"".join(t.column("bytes").to_pylist()), np.uint8).reshape(len(gram), -1)
        row, first, last = _runs(repeated_offsets(gram, lo, hi, rows, length))
        return pa.RecordBatch.from_arrays([pa.array(gram[row]), pa.array(t.column("context").to_numpy()[row]), pa.array(first.astype(np.int32)), pa.array(last.astype(np.int32))], ["gram", "context", "first", "last"])

    def run(batches):
        part, size, latest = [], 0, None
        for batch in batches:
            if not batch.num_rows:
                continue
            gram = batch.column(0).to_numpy(zero_copy_only=False)
            cut = np.concatenate([[0], np.flatnonzero(gram[1:] != gram[:-1]) + 1, [len(gram)]])
            for s, e in zip(cut[:-1], cut[1:], strict=True):
                if size >= BLOCK and gram[s] != latest:
                    yield settle(part)
                    part, size = [], 0
                part.append(batch.slice(s, e - s))
                size, latest = size + e - s, gram[s]
        if part:
            yield settle(part)

    return run


def _strings(length: int):
    """(gram, context, o, string hash pair) of every string around a context's position, for buckets too large to sort in one task."""
    before = length - GRAM

    def run(batches):
        for batch in batches:
            for k in range(0, batch.num_rows, 2000):
                t = batch.slice(k, 2000)
                buf = np.frombuffer(b"".join(t.column(4).to_pylist()), np.uint8)
                lo, hi = t.column(2).to_numpy(zero_copy_only=False), t.column(3).to_numpy(zero_copy_only=False)
                o = np.arange(before + 1)
                row, o = np.nonzero((o >= lo[:, None]) & (o <= hi[:, None]))
                s = row * (before + length) + before - o
                yield pa.RecordBatch.from_arrays([t.column(0).take(pa.array(row)), t.column(1).take(pa.array(row)), pa.array(o.astype(np.int32)), pa.array(flat.hashes(buf, s, s + length).view(np.int64))], ["gram", "context", "o", "string"])

    return run


def _cut(batches):
    """Digest of each text without its spans."""
    for batch in batches:
        out = [[], [], [], []]
        for text, spans in zip(batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            raw = text.encode() if text else b""
            gone = kept_to = runs = 0
            digest = hashlib.sha256()
            for s, e in sorted((x["s"], min(x["e"], len(raw))) for x in spans or ()):
                if e <= kept_to and (runs or e <= 0):
                    continue
                if s > kept_to or not runs:
                    digest.update(raw[kept_to:s])
                    runs += 1
                    kept_to = s
                gone += e - kept_to
                kept_to = e
            digest.update(raw[kept_to:])
            for k, v in enumerate((len(raw), gone, runs, digest.hexdigest())):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(v, t) for v, t in zip(out, (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True))], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def repeat_spans(docs: DataFrame, length: int = 200) -> DataFrame:
    """(doc_id, s, e): byte ranges of ``docs`` (doc_id, text) covered by strings of ``length`` bytes that start anywhere else too."""
    samples = written(docs.mapInArrow(_samples(length), "gram long, context long, doc_id long, pos int"))
    # written first, so that the join shuffles both sides and a very common string's samples can be split over tasks
    several = written(samples.groupBy("gram").agg(F.count("*").alias("n")).where("n > 1").select("gram"))
    shared = written(keeping(samples, several, "gram", several.count()))
    dropped(samples, several)
    kinds = written(shared.groupBy("gram", "context").agg(F.count("*").alias("n"), F.min(F.struct("doc_id", "pos")).alias("one")))
    buckets = written(kinds.groupBy("gram").agg(F.count("*").alias("k")).where("k > 1"))
    asked = kinds.join(buckets, "gram").select("one.doc_id", F.struct("gram", "context", "one.pos").alias("x")).groupBy("doc_id").agg(F.collect_list("x").alias("asked"))
    asked = written(asked)
    texts = keeping(docs, asked.select("doc_id"), "doc_id", asked.count()).dropDuplicates(["doc_id"])
    contexts = texts.join(asked, "doc_id").select("doc_id", "text", "asked").mapInArrow(_contexts(length), "gram long, context long, lo int, hi int, bytes binary")
    large = buckets.where(F.col("k") > BUCKET)
    many = large.count()
    contexts = written(contexts) if many else contexts
    small = contexts.join(F.broadcast(large) if many <= BROADCAST_ROWS else large, "gram", "left_anti") if many else contexts
    small = small.repartition("gram").sortWithinPartitions("gram")
    found = small.mapInArrow(_sorted_blocks(length), "gram long, context long, first int, last int")
    if many:
        strings = written(contexts.join(large.select("gram"), "gram", "left_semi").mapInArrow(_strings(length), "gram long, context long, o int, string long"))
        twice = strings.groupBy("gram", "o", "string").agg(F.count("*").alias("n")).where("n > 1")
        found = found.unionByName(strings.join(twice, ["gram", "o", "string"]).select("gram", "context", F.col("o").alias("first"), F.col("o").alias("last")))
    whole = kinds.where("n > 1").select("gram", "context", F.lit(0).alias("first"), F.lit(length - GRAM).alias("last"))
    spans = shared.join(found.unionByName(whole), ["gram", "context"])
    return spans.select("doc_id", F.greatest(F.col("pos") - F.col("last"), F.lit(0)).alias("s"), (F.col("pos") - F.col("first") + length).alias("e"))


def remove_repeats(docs: DataFrame, length: int = 200, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Whole texts without their repeated strings: doc_id, n_bytes, n_removed, n_spans, kept_sha256.

    Every byte goes that a string of ``length`` UTF-8 bytes covers which also starts anywhere else, in the same text or another;
    overlapping occurrences count, and strings are judged on the input. Null texts are empty and lose nothing, as do texts shorter than
    ``length``. Equal texts are repeats of each other. Rows that repeat an id share their spans, cut at each text's end.
    Null ids are left out. An empty table gives no rows. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    spans = written(repeat_spans(texts, length).groupBy("doc_id").agg(F.collect_set(F.struct("s", "e")).alias("spans")))
    count = spans.count()
    out = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"
    none = F.lit(None).cast("array<struct<s:int,e:int>>").alias("spans")
    if count > BROADCAST_ROWS:
        return texts.join(spans, "doc_id", "left").select("doc_id", "text", "spans").mapInArrow(_cut, out)
    ids = F.broadcast(spans.select("doc_id"))
    hit = texts.join(ids, "doc_id", "left_semi").join(spans, "doc_id").select("doc_id", "text", "spans")
    return hit.mapInArrow(_cut, out).unionByName(texts.join(ids, "doc_id", "left_anti").select("doc_id", "text", none).mapInArrow(_cut, out))
