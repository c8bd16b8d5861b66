"""How the sources of a language differ in their words: dense tiles of sources by terms, pair matrices and heaps of the most telling terms."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .flat import bounds
from .work import dropped, written

#: Documents of a language that must hold a term, what is added to every count, and the whole that shares are parts of.
LEAST_DOCS, ADDED, WHOLE = 30, 5, 1_000_000_000
#: Terms that a source's report names.
TOP = 50
#: Terms and sources of a tile.
TERMS, SOURCES = 256, 128
#: Bytes of text whose terms are cut at once; a longer text is cut alone.
AT_ONCE = 4_000_000
#: Different (language, source, term) rows that a task adds up before it hands them on.
HELD = 400_000
INSIDE = np.ones(256, bool)
INSIDE[[*range(0x00, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
SMALL = np.arange(256, dtype=np.uint8)
SMALL[0x41:0x5B] += 32


def term_counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of batches of (lang, source, text): occurrences and documents, added up in the task.

    A run of texts is cut at once: the bytes inside terms, without those between, are the data of one string array, whose dictionary numbers the different terms.
    """
    names = ["lang", "source", "term", "n", "docs"]
    held: list[pa.Table] = []

    def added() -> pa.Table:
        return pa.concat_tables(held).group_by(names[:3]).aggregate([("n", "sum"), ("docs", "sum")]).select([*names[:3], "n_sum", "docs_sum"]).rename_columns(names)

    for batch in batches:
        group = pa.Table.from_batches([batch.select(["lang", "source"])])
        size = pc.fill_null(pc.binary_length(batch.column("text")), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        start = 0
        while start < len(size):
            stop = max(start + 1, start + int(np.searchsorted(np.cumsum(size[start : start + AT_ONCE] + 1), AT_ONCE, "right")))
            texts = batch.column("text").slice(start, stop - start)
            held.append(_counted(b"\n".join(x.encode() if x else b"" for x in texts.to_pylist()) + b"\n", size[start:stop], group.slice(start, stop - start)))
            start = stop
            if sum(len(t) for t in held) > HELD:
                held = [added()]
                if len(held[0]) > HELD // 2:
                    yield from held.pop().to_batches()
    if held:
        yield from added().to_batches()


def _counted(joined: bytes, size: np.ndarray, group: pa.Table) -> pa.Table:
    """Counts of the terms of texts that stand end to end with a newline after each."""
    low = SMALL[np.frombuffer(joined, np.uint8)]
    inside = INSIDE[low]
    starts, ends = bounds(inside)
    offsets = np.concatenate([[0], np.cumsum(ends - starts)])
    terms = pa.LargeStringArray.from_buffers(len(starts), pa.py_buffer(offsets.astype(np.int64)), pa.py_buffer(low[inside])).dictionary_encode()
    code = terms.indices.to_numpy().astype(np.int64)
    doc = np.searchsorted(np.cumsum(size + 1), starts, "right")
    many = max(len(terms.dictionary), 1)
    lang, source = (pc.dictionary_encode(pc.fill_null(group[c].combine_chunks().cast(pa.string()), "")) for c in ("lang", "source"))
    pair = lang.indices.to_numpy().astype(np.int64) * len(source.dictionary) + source.indices.to_numpy()
    key, n = np.unique(pair[doc] * many + code, return_counts=True)
    seen = np.unique(doc * many + code)
    docs = np.bincount(np.searchsorted(key, pair[seen // many] * many + seen % many), minlength=len(key))
    at = key // many
    columns = [lang.dictionary.take(pa.array(at // max(len(source.dictionary), 1))), source.dictionary.take(pa.array(at % max(len(source.dictionary), 1))), terms.dictionary.cast(pa.string()).take(pa.array(key % many))]
    return pa.table([*columns, pa.array(n, pa.int64()), pa.array(docs, pa.int64())], ["lang", "source", "term", "n", "docs"])


def shares(counts: np.ndarray, totals: np.ndarray, terms: np.ndarray) -> np.ndarray:
    """1 + floor(WHOLE * (count + ADDED) / (total + ADDED * terms)), exact in int64 while counts stay under 9 * 10**15: the quotient comes in three steps of a thousand."""
    rest, by = counts + ADDED, totals + ADDED * terms
    out = np.zeros(np.broadcast(rest, by).shape, np.int64)
    for _ in range(3):
        more, rest = np.divmod(rest * 1000, by)
        out = out * 1000 + more
    return out + 1


def tile_parts(rows: pa.Table) -> pa.Table:
    """What one tile gives: (lang, source, item, part, value) of pairs of its sources, summed over its terms, and each source's most telling terms.

    ``rows`` (lang, block, a, b, side, source, total, kept, width, term, n, lang_n, lang_total): a source of side 0 stands in the tile's rows, one of side 1 in its columns where the tile
    compares two blocks of sources (a < b). Rows without a term name the sources, so that those without any of the block's terms take part, and
    give the number of the block's terms (width): those that none of the tile's sources has add the difference of two empty counts each.
    """
    lang = rows["lang"][0].as_py()
    side, total, n = (rows[c].to_numpy() for c in ("side", "total", "n"))
    kept, lang_total = rows["kept"][0].as_py(), rows["lang_total"][0].as_py()
    same = rows["a"][0].as_py() == rows["b"][0].as_py()
    source = rows["source"].combine_chunks().dictionary_encode()
    term = rows["term"].combine_chunks().dictionary_encode()
    at, names = source.indices.to_numpy(), source.dictionary
    has = pc.is_valid(rows["term"].combine_chunks()).to_numpy(zero_copy_only=False)
    col = pc.fill_null(term.indices, 0).to_numpy()[has].astype(np.int64)
    counts = np.zeros((len(names), len(term.dictionary)), np.int64)
    counts[at[has], col] = n[has]
    totals, sides = np.zeros(len(names), np.int64), np.zeros(len(names), np.int64)
    totals[at[~has]], sides[at[~has]] = total[~has], side[~has]
    p = shares(counts, totals[:, None], np.int64(kept)) if kept else np.zeros(counts.shape, np.int64)
    rows_of = np.flatnonzero(sides == 0)
    others = rows_of if same else np.flatnonzero(sides == 1)
    apart = np.zeros((len(rows_of), len(others)), np.int64)
    if kept:
        absent = shares(np.zeros(len(names), np.int64), totals, np.int64(kept))
        apart += (pc.max(rows["width"]).as_py() - counts.shape[1]) * np.abs(absent[others] - absent[rows_of][:, None])
    for k, i in enumerate(rows_of):
        apart[k] += np.abs(p[others] - p[i]).sum(axis=1)
    i, j = (x.ravel() for x in np.meshgrid(rows_of, others, indexing="ij"))
    value, differ = apart.ravel(), i != j
    first, second, value = i[differ], j[differ], value[differ]
    if not same:
        first, second, value = np.concatenate([first, second]), np.concatenate([second, first]), np.concatenate([value, value])
    out = [pa.table([names.take(pa.array(first)), names.take(pa.array(second)), pa.array(["pair"] * len(first), pa.string()), pa.array(value)], ["source", "item", "part", "value"])]
    if same and kept and counts.shape[1]:
        of_lang = np.zeros(counts.shape[1], np.int64)
        of_lang[col] = rows["lang_n"].to_numpy()[has]
        more = np.where(counts > 0, p - shares(of_lang, np.int64(lang_total), np.int64(kept)), 0)
        order = pc.sort_indices(term.dictionary).to_numpy()  # terms in the order of their bytes
        best = np.argsort(-more[:, order], axis=1, kind="stable")[:, :TOP]
        r, c = np.repeat(np.arange(len(names)), best.shape[1]), order[best.ravel()]
        told = more[r, c] > 0
        out.append(pa.table([names.take(pa.array(r[told])), term.dictionary.take(pa.array(c[told])), pa.array(["term"] * int(told.sum()), pa.string()), pa.array(more[r, c][told])], ["source", "item", "part", "value"]))
    found = pa.concat_tables(out)
    return found.add_column(0, "lang", pa.array([lang] * len(found), pa.string()))


def audit_sources(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): each source of ``docs`` (text, lang, source) against the others of its language, and its most telling terms.

    Null text, language and source count as empty. Terms are runs of letters A-Z, a-z and characters beyond ASCII, A-Z in lower case. A language keeps the terms of at least
    LEAST_DOCS of its documents. A source, and the language as a whole, gives each kept term the share of :func:`shares`. Part ``pair`` has, for each other
    source (item), the sum of the absolute differences of shares over all kept terms; part ``term`` the TOP kept terms that occur in the source with a share above the
    language's, by the difference. Ranks count from 1 by value, largest first, then by item in the order of its bytes. A language without kept terms gives pairs of value 0, one
    with a single source no pair. Every row is a document, repeated ones too; other columns are ignored.

    Tasks add up counts before the one shuffle by (language, source, term). Kept terms are dealt to blocks of about TERMS terms, sources to blocks of SOURCES; a
    tile is a dense int64 matrix of two blocks of sources by one of terms, of bounded size, whatever the number of documents. Tiles give partial pair matrices, which are
    summed, and the TOP terms of each source, of which the TOP are taken.
    """
    rows = docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), "text")
    counts = rows.mapInArrow(term_counts, "lang string, source string, term string, n long, docs long")
    counts = written(counts.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")))
    terms = written(counts.groupBy("lang", "term").agg(F.sum("n").alias("lang_n"), F.sum("docs").alias("docs")).where(F.col("docs") >= LEAST_DOCS).drop("docs"))
    kept = written(counts.drop("docs").join(terms, ["lang", "term"]))
    every = rows.groupBy("lang", "source").count().drop("count")
    totals = every.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left")
    langs = written(every.select("lang").distinct().join(terms.groupBy("lang").agg(F.count("*").alias("kept"), F.sum("lang_n").alias("lang_total")), "lang", "left").na.fill(0, ["kept", "lang_total"]))
    of = F.row_number().over(W.partitionBy("lang").orderBy("source")) - 1  # one row for each source
    groups = totals.na.fill(0, ["total"]).withColumn("g", F.floor(of / SOURCES).cast("int"))
    groups = written(groups.join(langs, "lang").withColumn("blocks", F.ceil(F.greatest("kept", F.lit(1)) / TERMS).cast("int")))
    cells = F.transform(F.sequence(F.lit(0), F.col("last")), lambda x: F.struct(F.least("g", x).alias("a"), F.greatest("g", x).alias("b"), F.when(F.col("g") > x, 1).otherwise(0).alias("side")))
    placed = groups.join(groups.groupBy("lang").agg(F.max("g").alias("last")), "lang").select("lang", "source", "total", "kept", "lang_total", "blocks", F.explode(cells).alias("cell")).select("*", "cell.*").drop("cell")
    none = F.lit(0).cast("long")
    block = F.pmod(F.xxhash64("term"), F.col("blocks")).cast("int")
    widths = terms.join(groups.select("lang", "blocks").distinct(), "lang").groupBy("lang", block.alias("block")).agg(F.count("*").alias("width"))
    heads = placed.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).join(widths, ["lang", "block"], "left").select(
        "lang", "block", "a", "b", "side", "source", "total", "kept", F.coalesce("width", none).alias("width"), F.lit(None).cast("string").alias("term"), none.alias("n"), none.alias("lang_n"), "lang_total")
    body = kept.join(placed, ["lang", "source"]).withColumn("block", block).withColumn("width", none)
    tiles = heads.unionByName(body.select(*heads.columns)).groupBy("lang", "block", "a", "b").applyInArrow(tile_parts, "lang string, source string, item string, part string, value long")
    parts = written(tiles)
    dropped(counts, terms, kept, langs, groups)
    first = W.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    pairs = parts.where("part = 'pair'").groupBy("lang", "source", "part", "item").agg(F.sum("value").alias("value"))
    told = parts.where("part = 'term'").withColumn("rank", F.row_number().over(first)).where(F.col("rank") <= TOP)
    return pairs.withColumn("rank", F.row_number().over(first)).unionByName(told.select(*pairs.columns, "rank")).select("lang", "source", "part", "item", "value", "rank")
