"""Substring dedup: MinHash banding of paragraphs, exact verification, removals by component."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import flat
from .linking import linked_groups
from .minhash import _verified
from .work import BROADCAST_ROWS, dropped, keeping, written

U = np.uint64
SHINGLE = 5
#: Bands of one minimum each: two paragraphs at similarity 0.8 share none with a chance of 0.2 ** BANDS; a shared shingle of five words is rare
#: enough that wider bands are not needed.
BANDS = 3
#: Paragraphs with fewer words are only compared whole: one shingle more or less already takes them below 0.8.
LEAST_FUZZY = 8
#: Words on either side of a break inside a long paragraph.
APART = 8
#: Numbers of words beside a run that are compared with those beside others.
REACH = (3, 6, 9, 12, 16, 20, 26)


def _inner_breaks(words: np.ndarray, new: np.ndarray) -> np.ndarray:
    """Breaks in long paragraphs: words whose hash is the least among APART words on either side, where no paragraph begins that near. They follow from those words alone."""
    n = len(words)
    least = np.zeros(n, bool)
    if n > 2 * APART:
        begun = np.concatenate([[0], np.cumsum(new)])
        mid = words[APART : n - APART]
        here = begun[2 * APART + 1 :] == begun[: n - 2 * APART]
        for k in range(1, APART + 1):
            here &= (mid < words[APART - k : n - APART - k]) & (mid < words[APART + k : n - APART + k])
        least[APART : n - APART] = here
    return least


def paragraphs(texts: list[bytes]):
    """Words and paragraphs of texts: word hashes, and for each paragraph its first word, number of words, text and bytes.

    A paragraph ends at a line's end, and before a word with a capital or after a . ! or ? unless one of the four words before it in the line is
    such a word too (a line's first word is after none), and at :func:`_inner_breaks`; so a passage set into another text keeps its paragraphs, and shouted or titled words do not fall apart. Words are compared by their lowered letters and digits; others are no words."""
    buf, at = flat.joined(texts)
    low = flat.lowered(buf)
    starts, ends = flat.bounds(~flat.SPACE[buf])
    alnum = flat.ALNUM[low]
    full = np.concatenate([[0], np.cumsum(alnum)])
    real = full[ends] > full[starts]
    lines = np.concatenate([[0], np.cumsum(buf == 10)])
    stop = np.isin(buf[ends - 1], (0x2E, 0x21, 0x3F)) if len(ends) else np.zeros(0, bool)
    lead = np.concatenate([[True], lines[starts[1:]] > lines[starts[:-1]]]) if len(starts) else stop
    group, after = np.cumsum(lead)[real], (np.concatenate([[False], stop[:-1]]) & ~lead)[real] if len(stop) else stop
    starts, ends = starts[real], ends[real]
    words = flat.hashes(low[alnum], full[starts], full[ends])
    doc = np.searchsorted(at, starts, "right") - 1
    first, second = buf[starts], buf[np.minimum(starts + 1, len(buf) - 1)]
    mark = after | ((first >= 0x41) & (first <= 0x5A)) | ((first == 0xC3) & (second >= 0x80) & (second <= 0x9E))
    near = np.zeros(len(mark), bool)
    for k in range(1, 5):
        near[k:] |= mark[:-k] & (group[k:] == group[:-k]) & (doc[k:] == doc[:-k])
    new = mark & ~near
    new[1:] |= (group[1:] != group[:-1]) | (doc[1:] != doc[:-1])
    new[:1] = True
    new |= _inner_breaks(words, new)
    head = np.flatnonzero(new)
    size = np.diff(np.concatenate([head, [len(words)]]))
    last = head + size - 1
    return words, doc, head, size, (starts[head] - at[doc[head]]) if len(head) else head, (ends[last] - at[doc[head]]) if len(head) else head


def _listed(least: int):
    """One row for each paragraph of at least SHINGLE words, numbered within its text."""

    def run(batches):
        for batch in batches:
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            for i, j, texts in flat.chunks(batch):
                words, doc, head, size, _, _ = paragraphs(texts)
                owner = np.repeat(np.arange(len(head)), size)
                content = _contents(words, head, size)
                h, first = flat.grams(words, owner, SHINGLE)
                po = owner[first]
                begin = np.flatnonzero(np.concatenate([[True], po[1:] != po[:-1]])) if len(po) else np.zeros(0, np.int64)
                keep = po[begin]
                mins = np.stack([np.minimum.reduceat(flat.mixed(h + U(b * 7919)), begin) if len(begin) else np.zeros(0, np.uint64) for b in range(BANDS)], axis=1)
                fuzzy = size[keep] >= LEAST_FUZZY
                counts = np.where(fuzzy, BANDS, 0)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]).astype(np.int32)), pa.array(mins[fuzzy].ravel().view(np.int64)))
                d = doc[head[keep]]
                number = np.arange(len(keep)) - np.searchsorted(d, d)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(ids[i:j][d], pa.int64()), pa.array(number.astype(np.int32)), pa.array(size[keep].astype(np.int32)), pa.array(content[keep].view(np.int64)), lists],
                    ["doc_id", "paragraph", "n_words", "content", "mins"])

    return run


def _places(lists: pa.ListArray, words: np.ndarray, doc: np.ndarray, head: np.ndarray, size: np.ndarray, count: int):
    """For the asked paragraphs of texts: the number of the text, the paragraph among all of them, and the rows asked as columns; those that a text does not have with that content are left out."""
    fit = np.flatnonzero(size >= SHINGLE)
    content, owner = _contents(words, head, size)[fit].view(np.int64), doc[head[fit]]
    begin, end = np.searchsorted(owner, np.arange(count), "left"), np.searchsorted(owner, np.arange(count), "right")
    rows = lists.flatten()
    asked = {rows.type.field(k).name: pc.struct_field(rows, [k]).to_numpy(zero_copy_only=False) for k in range(rows.type.num_fields)}
    text = np.repeat(np.arange(count), pc.list_value_length(lists).to_numpy(zero_copy_only=False))
    place = begin[text] + asked["paragraph"]
    ok = np.flatnonzero(place < end[text])
    ok = ok[content[place[ok]] == asked["content"][ok]]
    return text[ok], fit[place[ok]], {k: v[ok] for k, v in asked.items()}


def _shingles(as_items: bool):
    """Shingle sets of the asked paragraphs (paragraph, content) of each text."""

    def run(batches):
        for batch in batches:
            for i, j, texts in flat.chunks(batch, 0):
                words, doc, head, size, _, _ = paragraphs(texts)
                _, place, asked = _places(batch.column(1).slice(i, j - i), words, doc, head, size, j - i)
                h, first = flat.grams(words, np.repeat(np.arange(len(head)), size), SHINGLE)
                n = size[place] - SHINGLE + 1
                row = np.repeat(np.arange(len(place)), n)
                h = h[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n) + np.repeat(np.searchsorted(first, head[place]), n)]
                order = np.lexsort((h, row))
                h, row = h[order], row[order]
                new = np.ones(len(h), bool)
                new[1:] = (h[1:] != h[:-1]) | (row[1:] != row[:-1])
                h, row = h[new], row[new]
                if as_items:
                    count = np.bincount(row, minlength=len(place))
                    yield pa.RecordBatch.from_arrays([pa.array(asked["content"][row], pa.int64()), pa.array(h.view(np.int64)), pa.array(count[row], pa.int64())], ["id", "item", "n"])
                else:
                    raw, cut = h.tobytes(), np.searchsorted(row, np.arange(len(place) + 1)) * 8
                    sets = [raw[cut[k] : cut[k + 1]] for k in range(len(place))]
                    yield pa.RecordBatch.from_arrays([pa.array(asked["content"], pa.int64()), pa.array(sets, pa.binary())], ["id", "hashes"])

    return run


def _contents(words: np.ndarray, head: np.ndarray, size: np.ndarray) -> np.ndarray:
    """A hash of each paragraph's words."""
    owner = np.repeat(np.arange(len(head)), size)
    place = np.arange(len(words)) - head[owner] if len(head) else np.zeros(0, np.int64)
    up = np.cumprod(np.full(int(size.max(initial=1)) + 1, U(flat.P)))
    total = np.add.reduceat(words * up[place], head) if len(head) else np.zeros(0, np.uint64)
    return flat.mixed(total + size.astype(np.uint64)) >> U(1)


def _beside(batches):
    """Rows (doc_id, paragraph, side, component, reach, h): for each asked paragraph of a text the hash of the REACH words before it (side 0) or after it (side 1).

    Paragraphs are asked by (paragraph, side, component, content); by the content another text under the same id is told apart."""
    names = ["doc_id", "paragraph", "side", "component", "reach", "h"]
    for batch in batches:
        ids = batch.column(0).to_numpy(zero_copy_only=False)
        for i, j, texts in flat.chunks(batch):
            words, doc, head, size, _, _ = paragraphs(texts)
            text, place, asked = _places(batch.column(2).slice(i, j - i), words, doc, head, size, j - i)
            up, down = flat.powers(len(words))
            total = np.concatenate([[U(0)], np.cumsum(words * up[: len(words)])])
            low, high = np.searchsorted(doc, text, "left"), np.searchsorted(doc, text, "right")
            for reach in REACH:
                a = np.where(asked["side"] == 1, head[place] + size[place], head[place] - reach)
                ok = np.flatnonzero((a >= low) & (a + reach <= high))
                a = a[ok]
                h = flat.mixed((total[a + reach] - total[a]) * down[a]).view(np.int64)
                out = [ids[i + text[ok]], *(asked[c][ok] for c in names[1:4]), np.full(len(ok), reach), h]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], names)


def _with_asked(texts: DataFrame, lists: DataFrame) -> DataFrame:
    """Texts with the paragraphs asked of them. Texts are shuffled only where those are too many for a broadcast, and then only texts that are asked for."""
    rows = texts.where("text IS NOT NULL")
    count, numbers = lists.agg(F.count("*"), F.sum(F.size("asked"))).first()
    if count + (numbers or 0) <= BROADCAST_ROWS:
        return rows.join(F.broadcast(lists), "doc_id")
    return keeping(rows, lists.select("doc_id"), "doc_id", count).join(lists, "doc_id")


def _reaching(rows: DataFrame, texts: DataFrame, least_words: int) -> DataFrame:
    """(doc_id, run) of the runs that are too short by their paragraphs alone, but not with the words beside them that stand beside another paragraph of the same component too.

    A passage cut in mid-sentence begins and ends inside a paragraph of its host; those paragraphs differ, the words up to the passage's ends don't."""
    ends = rows.where(F.col("words") < least_words).groupBy("doc_id", "run", "words").agg(
        F.min("paragraph").alias("first"), F.max("paragraph").alias("last"), F.min_by("component", "paragraph").alias("low"), F.max_by("component", "paragraph").alias("high"))
    ends = written(ends)
    edges = ends.select(F.inline(F.array(F.struct(F.col("low").alias("component"), F.lit(0).alias("side")), F.struct(F.col("high").alias("component"), F.lit(1).alias("side"))))).distinct()
    edges = written(edges)
    asked = rows.join(edges, "component").groupBy("doc_id").agg(F.collect_list(F.struct("paragraph", "side", "component", "content")).alias("asked"))  # paragraphs of one text
    asked = written(asked)
    beside = written(_with_asked(texts, asked).select("doc_id", "text", "asked").mapInArrow(_beside, "doc_id long, paragraph long, side long, component long, reach long, h long"))
    shared = written(beside.groupBy("side", "component", "reach", "h").agg(F.count("*").alias("n")).where("n > 1").drop("n"))
    far = written(beside.join(shared, ["side", "component", "reach", "h"]).groupBy("doc_id", "paragraph", "side").agg(F.max("reach").alias("reach")))
    before, after = (far.where(F.col("side") == k).select("doc_id", F.col("paragraph").alias(c), F.col("reach").alias(f"of_{c}")) for k, c in ((0, "first"), (1, "last")))
    whole = F.col("words") + F.coalesce("of_first", F.lit(0)) + F.coalesce("of_last", F.lit(0))
    out = written(ends.join(before, ["doc_id", "first"], "left").join(after, ["doc_id", "last"], "left").where(whole >= least_words).select("doc_id", "run"))
    dropped(ends, edges, asked, beside, shared, far)
    return out


def repeated_paragraphs(docs: DataFrame, percent: int = 80, least_words: int = 30, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Passages that repeat: one row for each repeated paragraph, doc_id, paragraph, n_words, component_id, kept.

    Paragraphs of whole texts are linked if their sets of five-word shingles reach 100 * both >= percent * union, or if their words are equal.
    component_id is the smallest doc_id in a component of links. A paragraph is reported if its component has another occurrence and it stands in
    an unbroken run of such paragraphs with at least ``least_words`` words, so that stock phrases alone mark no text; words beside the run count
    up to REACH on either side where another paragraph of the same component has them beside it too, so that a passage cut in mid-sentence counts whole. Of each component the
    first occurrence (doc_id, then paragraph) is kept; the others are to be removed. Numbers count the paragraphs of five or more words.

    Null, empty and blank texts and shorter paragraphs are never reported. Null ids are left out. Texts that share an id
    are numbered apart, so equal rows are copies of each other. Empty tables give no rows. Other columns are ignored.
    """
    texts = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).where("doc_id IS NOT NULL")
    every = written(texts.mapInArrow(_listed(SHINGLE), "doc_id long, paragraph int, n_words int, content long, mins array<long>"))
    bands = every.select(F.explode("mins").alias("key"), F.col("content").alias("id"))
    several = written(bands.groupBy("key").agg(F.min("id").alias("lo"), F.max("id").alias("hi")).where("lo <> hi").select("key"))
    buckets = written(keeping(bands, several, "key", several.count()).distinct())

    def asked(ids: DataFrame, count: int, as_items: bool) -> DataFrame:
        one = keeping(every.withColumnRenamed("content", "id"), ids, "id", count).groupBy("id").agg(F.min(F.struct("doc_id", "paragraph")).alias("at"))
        lists = written(one.groupBy("at.doc_id").agg(F.collect_list(F.struct(F.col("at.paragraph").alias("paragraph"), F.col("id").alias("content"))).alias("asked")))
        some = _with_asked(texts, lists).select("text", "asked")
        # texts that share an id may hold the same paragraph under the same number
        sets = some.mapInArrow(_shingles(as_items), "id long, item long, n long" if as_items else "id long, hashes binary")
        return sets.dropDuplicates(["id", "item"] if as_items else ["id"])

    def confirm(pairs: DataFrame) -> DataFrame:
        ends = written(pairs.select(F.col("a").alias("id")).union(pairs.select("b")).distinct())
        sets = written(asked(ends, ends.count(), False))
        both = pairs.join(sets.select(F.col("id").alias("a"), F.col("hashes").alias("ha")), "a").join(sets.select(F.col("id").alias("b"), F.col("hashes").alias("hb")), "b")
        return written(both.select("a", "b", "ha", "hb").mapInArrow(_verified(percent), "a long, b long"))

    labels = linked_groups(buckets, confirm, lambda ids, count: asked(ids, count, True), percent)
    exact = every.groupBy("content").agg(F.count("*").alias("n")).where("n > 1").select("content")
    names = written(exact.join(labels.withColumnRenamed("id", "content"), "content", "full").select("content", F.coalesce("component", "content").alias("component")))
    count = names.count()
    rows = every.select("doc_id", "paragraph", "n_words", "content").join(F.broadcast(names) if count <= BROADCAST_ROWS else names, "content")
    at = W.partitionBy("doc_id").orderBy("paragraph")
    rows = rows.withColumn("new", F.when(F.col("paragraph") - F.lag("paragraph").over(at) <= 1, 0).otherwise(1)).withColumn("run", F.sum("new").over(at))
    rows = written(rows.withColumn("words", F.sum("n_words").over(W.partitionBy("doc_id", "run"))))
    reaching = _reaching(rows, texts, least_words)
    short = rows.where(F.col("words") < least_words).join(reaching, ["doc_id", "run"], "left_semi")
    rows = written(rows.where(F.col("words") >= least_words).unionByName(short.select(*rows.columns)))
    first = rows.groupBy("component").agg(F.min(F.struct("doc_id", "paragraph")).alias("first"), F.count("*").alias("n")).where("n > 1")
    first = written(first)  # so that the join shuffles both sides and a large component can be split over tasks
    kept = (F.col("doc_id") == F.col("first.doc_id")) & (F.col("paragraph") == F.col("first.paragraph"))
    return rows.join(first, "component").select("doc_id", "paragraph", "n_words", F.col("first.doc_id").alias("component_id"), kept.alias("kept"))
