"""Groups of tokens of two tokenizers that cover the same bytes, the pairs that they link, and how telling each pair is."""

from __future__ import annotations

import hashlib
import json
import re
from collections.abc import Callable, Iterator
from itertools import chain
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import sentencepiece
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .flat import chunks
from .work import dropped, written

#: Folder of the vocabulary files; only the driver reads it.
TOKENIZERS = "/opt/tokenizers"
#: Bytes of text that are worked on at once; a longer text is worked on alone.
AT_ONCE = 4_000_000
#: Different pairs that a task adds up before it hands them on.
HELD = 1_000_000
#: Pairs whose counts go to every executor at once (17 bytes each); more of them are read in slices, each with its own pass over the texts.
SLICE = 2_000_000
#: Fixed value: the pattern that cuts text for a byte-level vocabulary.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Bytes up to a label that both tokenizers end at.
SPAN = re.compile(rb"[.AB]*\*")
LABELS = np.frombuffer(b".AB*", np.uint8)
BLANK = "▁"


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in a byte-level vocabulary: printable bytes stand for themselves, the others follow from 256 on."""
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    others = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(others)}


class Pair(NamedTuple):
    """Two tokenizers: what each gives for a list of words that begin with a space, each one's bytes by id, and whether words can be encoded one by one."""

    encode_a: Callable[[list[str]], list[list[int]]]
    encode_b: Callable[[list[str]], list[list[int]]]
    bytes_a: list[bytes]
    bytes_b: list[bytes]
    by_word: bool


_built: dict[tuple[bytes, bytes], Pair] = {}


def tokenizers_of(a_file: bytes, b_file: bytes) -> Pair:
    """The pair of the contents of a byte-level BPE's JSON file (A) and a sentence-piece model (B), kept for the process.

    A is cut by PATTERN and merged by rank, which is right where every merge makes a higher id than the one before; else, and for another way of cutting, ValueError.
    No token of either crosses from another character to a following single space, if B has no such piece; then a text can be encoded word by word.
    """
    key = (hashlib.sha256(a_file).digest(), hashlib.sha256(b_file).digest())
    if key not in _built:
        spec = json.loads(a_file)
        letters, vocabulary = byte_letters(), spec["model"]["vocab"]
        made = [vocabulary["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in spec["model"]["merges"]]
        cut = spec["pre_tokenizer"] or {}
        if cut.get("type") != "ByteLevel" or cut.get("add_prefix_space") or not cut.get("use_regex", True) or spec["normalizer"] or any(x >= y for x, y in zip(made, made[1:])):
            raise ValueError("the first tokenizer must be a byte-level BPE whose ids follow its merges, without a normalizer or a space of its own")
        special = {t["content"] for t in spec["added_tokens"] if t["special"]}
        ranks = {bytes(letters[c] for c in token): i for token, i in vocabulary.items() if token not in special}
        own = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in ranks.items():
            bytes_a[i] = token
        pieces = sentencepiece.SentencePieceProcessor(model_proto=b_file)
        names = [pieces.id_to_piece(i) for i in range(pieces.get_piece_size())]
        bytes_b = [bytes([int(p[3:5], 16)]) if pieces.is_byte(i) else p.replace(BLANK, " ").encode() for i, p in enumerate(names)]
        _built[key] = Pair(
            lambda words: [own.encode_ordinary(w) for w in words], lambda words: pieces.encode([w[1:] for w in words], num_threads=1),
            bytes_a, bytes_b, not any(BLANK in p.lstrip(BLANK) for p in names),
        )
    return _built[key]


def cuts(buf: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Where the words of texts laid end to end begin: at each text's start, and at a single space between two characters that are no white space."""
    at = np.flatnonzero(buf[:-1] == 0x20)
    at = at[(at >= 3) & (buf[at + 1] > 0x20)]
    before = buf[at - 1]
    wide = (before >= 0x80) & ((buf[at - 3] - np.uint8(0xE1) < 3) | ((buf[at - 2] == 0xC2) & ((before == 0x85) | (before == 0xA0))))  # may be white space beyond ASCII
    begins = np.zeros(len(buf), bool)
    begins[at[(before > 0x20) & ~wide]] = True
    begins[starts] = True
    return np.flatnonzero(begins)


def ragged(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Indices starts[i] ... starts[i] + counts[i] - 1 of every i, end to end."""
    ends = np.cumsum(counts)
    return np.arange(ends[-1] if len(ends) else 0) + np.repeat(starts - ends + counts, counts)


def tallied(keys: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Different keys in order, and the sum of each one's counts."""
    if not len(keys):
        return keys, counts
    order = np.argsort(keys, kind="stable")
    keys, counts = keys[order], counts[order]
    first = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]]))
    return keys[first], np.add.reduceat(counts, first)


def distinct(keys: np.ndarray) -> np.ndarray:
    """Different keys in order; sorting beats hashing here."""
    keys = np.sort(keys)
    return keys[np.concatenate([[True], keys[1:] != keys[:-1]])] if len(keys) else keys


def flat_ids(each: list[list[int]], known: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of all words end to end, how many each word has, and where each token ends in the words' bytes end to end."""
    many = np.fromiter(map(len, each), np.int64, len(each))
    ids = np.fromiter(chain.from_iterable(each), np.int64, int(many.sum()))
    return ids, many, np.cumsum(np.fromiter(map(len, known), np.int64, len(known))[ids])


def given_back(ids: np.ndarray, known: list[bytes], many: np.ndarray, ends: np.ndarray, raw: list[bytes], sizes: np.ndarray) -> bool:
    """Whether every word's tokens give back its bytes: all bytes are the same and each word's tokens end where it ends."""
    to = np.concatenate([[0], ends])[np.cumsum(many)]
    return bool((to == np.cumsum(sizes)).all()) and b"".join(map(known.__getitem__, ids.tolist())) == b"".join(raw)


class Aligned(NamedTuple):
    """Different words of a run: counts of tokens, groups and links, the groups as text (each with a ``;`` at its end), and links as (pair, times) from link_at[w]."""

    valid: np.ndarray
    n: np.ndarray
    text: pa.Array
    pair: np.ndarray
    times: np.ndarray
    link_at: np.ndarray


def aligned(words: list[str], two: Pair) -> Aligned:
    """Words that begin with a space, aligned. A word that either tokenizer doesn't give back byte for byte is not valid and has no tokens.

    Every byte is labelled ``.``, ``A``, ``B`` or ``*`` for no end, an end of an A token, of a B token, or of both; a regular expression takes the bytes up to
    each ``*``, and the labels counted up to there say which tokens a group holds.
    """
    a, b = two.encode_a(words), two.encode_b(words)
    raw = [w.encode() for w in words]
    (ids_a, len_a, ends_a), (ids_b, len_b, ends_b), len_w = flat_ids(a, two.bytes_a), flat_ids(b, two.bytes_b), np.fromiter(map(len, raw), np.int64, len(raw))
    valid = np.ones(len(words), bool)
    if not given_back(ids_a, two.bytes_a, len_a, ends_a, raw, len_w) or not given_back(ids_b, two.bytes_b, len_b, ends_b, raw, len_w):
        same = (b"".join(map(two.bytes_a.__getitem__, x)) == w == b"".join(map(two.bytes_b.__getitem__, y)) for x, y, w in zip(a, b, raw))
        valid = np.fromiter(same, bool, len(words))
        (ids_a, len_a, ends_a), (ids_b, len_b, ends_b) = (flat_ids([x if ok else [] for x, ok in zip(each, valid)], known) for each, known in ((a, two.bytes_a), (b, two.bytes_b)))
        len_w = len_w * valid
    size = len(two.bytes_b)
    label = np.zeros(int(len_w.sum()), np.uint8)
    label[ends_a - 1] |= 1
    label[ends_b - 1] |= 2
    ends = np.cumsum(np.fromiter(map(len, SPAN.findall(LABELS[label].tobytes())), np.int64))
    to_a, to_b = (np.concatenate([[0], np.cumsum((label & bit) > 0)])[ends] for bit in (1, 2))
    in_a, in_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
    word = np.searchsorted(np.cumsum(len_w), ends, "left")
    group_a, group_b = np.repeat(np.arange(len(ends)), in_a), np.repeat(np.arange(len(ends)), in_b)

    # The groups as text: ids with what follows each, taken from a list of all such strings in one step.
    most = max(len(two.bytes_a), size)
    shown = pa.array([f"{i}{s}" for s in ",|;" for i in range(most)], pa.large_string())
    code = np.empty(len(ids_a) + len(ids_b), np.int64)
    last_a, last_b = np.arange(len(ids_a)) + 1 == to_a[group_a], np.arange(len(ids_b)) + 1 == to_b[group_b]
    code[np.arange(len(ids_a)) + (to_b - in_b)[group_a]] = ids_a + most * last_a
    code[np.arange(len(ids_b)) + to_a[group_b]] = ids_b + 2 * most * last_b
    parts = shown.take(pa.array(code))
    at = np.frombuffer(parts.buffers()[1], np.int64)[np.concatenate([[0], np.cumsum(len_a + len_b)])] if len(code) else np.zeros(len(words) + 1, np.int64)
    text = pa.LargeStringArray.from_buffers(len(words), pa.py_buffer(at.copy()), parts.buffers()[2] or pa.py_buffer(b""))

    # Links: different ids of a group with their numbers, and every A id with every B id.
    one, times_a = tallied(group_a * most + ids_a, np.ones(len(ids_a), np.int64))
    two_, times_b = tallied(group_b * most + ids_b, np.ones(len(ids_b), np.int64))
    many_b = np.bincount(two_ // most, minlength=len(ends))
    with_b = many_b[one // most]
    left, right = np.repeat(np.arange(len(one)), with_b), ragged((np.cumsum(many_b) - many_b)[one // most], with_b)
    both = (one[left] % most) * size + two_[right] % most
    span = len(two.bytes_a) * size
    key, times = tallied(word[one[left] // most] * span + both, times_a[left] * times_b[right])
    link_at = np.searchsorted(key // span, np.arange(len(words) + 1))
    n_links = np.zeros(len(words), np.int64)
    np.add.at(n_links, word, in_a * in_b)
    return Aligned(valid, np.stack([len_a, len_b, np.bincount(word, minlength=len(words)), n_links]), text, key % span, times, link_at)


class Run(NamedTuple):
    """Texts of a batch from row ``first`` on, cut into words: codes into the different words, and each text's first word (one more at the end)."""

    first: int
    codes: np.ndarray
    at: np.ndarray
    words: Aligned
    valid: np.ndarray


def runs(batch: pa.RecordBatch, two: Pair) -> Iterator[Run]:
    for first, _, texts in chunks(batch, 1, AT_ONCE):
        sizes = np.fromiter((len(t) + 1 if t else 0 for t in texts), np.int64, len(texts))
        starts = np.cumsum(sizes) - sizes
        joined = b"".join(b" " + t for t in texts if t)
        begins = starts[sizes > 0]
        heads = (cuts(np.frombuffer(joined + b" ", np.uint8), begins) if two.by_word else begins) if len(begins) else begins
        offsets = np.append(heads, len(joined)).astype(np.int32)
        found = pa.StringArray.from_buffers(len(heads), pa.py_buffer(offsets), pa.py_buffer(joined)).dictionary_encode()
        codes = found.indices.to_numpy().astype(np.int64)
        words = aligned(found.dictionary.to_pylist(), two)
        at = np.searchsorted(heads, np.append(starts, len(joined)))
        bad = np.concatenate([[0], np.cumsum(~words.valid[codes])])
        yield Run(first, codes, at, words, (bad[at[1:]] == bad[at[:-1]]) & (sizes > 0))


def by_text(run: Run, values: np.ndarray) -> np.ndarray:
    """Sums over each text's words of ``values`` of the different words; 0 for texts without tokens."""
    total = np.concatenate([[0], np.cumsum(values[run.codes])])
    return np.where(run.valid, total[run.at[1:]] - total[run.at[:-1]], 0)


def linked_texts(run: Run, span: int) -> tuple[np.ndarray, np.ndarray]:
    """Different pairs of a run and the number of its texts that hold each."""
    text = np.repeat(np.arange(len(run.valid)), np.diff(run.at))
    keep = run.valid[text]
    held = distinct(text[keep] * len(run.words.valid) + run.codes[keep])
    word = held % max(len(run.words.valid), 1)
    many = np.diff(run.words.link_at)[word]
    pair = run.words.pair[ragged(run.words.link_at[word], many)]
    once = distinct(np.repeat(held // max(len(run.words.valid), 1), many) * span + pair) % span
    return tallied(once, np.ones(len(once), np.int64))


def align(docs: DataFrame, a_file: str = f"{TOKENIZERS}/byte_bpe_50k.json", b_file: str = f"{TOKENIZERS}/piece_bpe_32k.model") -> DataFrame:
    """One row for each row of ``docs`` (doc_id, text): doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum, groups_sha256.

    A reads a space and the text, B the text, to which it adds a space; special tokens' strings are plain text. Tokens whose ends meet at the same byte close a group, and
    every A token of a group is linked with every B token of it. A pair of ids counts the documents that hold it linked; ``n_best`` are a text's links whose pair is its A id's
    most frequent one (ties included), ``count_sum`` adds up the counts over links. A null or empty text, and one that either tokenizer doesn't give back byte
    for byte, has zeros and an empty digest. Repeated rows and ids are documents of their own; other columns are ignored.

    Texts are cut into words, and the different words of a run of texts are encoded and aligned once. Tasks add up counts of pairs before the shuffle. The counts, at most one for
    each pair of ids of the two vocabularies, come back to the tasks as a broadcast of at most SLICE pairs; where there are more, A ids are dealt
    to slices, each with a pass of its own over the texts, and the sums are added up by document. Texts themselves never shuffle.
    """
    spark = docs.sparkSession
    files = []
    for name in (a_file, b_file):
        with open(name, "rb") as f:
            files.append(f.read())
    known = spark.sparkContext.broadcast(tuple(files))  # two vocabulary files, some megabytes whatever the input
    two = tokenizers_of(*files)
    size = len(two.bytes_b)
    span = len(two.bytes_a) * size
    rows = docs.select("doc_id", "text")

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        two, held, counts = tokenizers_of(*known.value), np.zeros(0, np.int64), np.zeros(0, np.int64)
        new: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            for run in runs(batch, two):
                new.append(linked_texts(run, span))
                if sum(len(k) for k, _ in new) > HELD:
                    held, counts = tallied(np.concatenate([held, *(k for k, _ in new)]), np.concatenate([counts, *(c for _, c in new)]))
                    new = []
                    if len(held) > HELD:
                        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "docs"])
                        held, counts = np.zeros(0, np.int64), np.zeros(0, np.int64)
        held, counts = tallied(np.concatenate([held, *(k for k, _ in new)]), np.concatenate([counts, *(c for _, c in new)]))
        yield pa.RecordBatch.from_arrays([pa.array(held), pa.array(counts)], ["pair", "docs"])

    found = rows.mapInArrow(counted, "pair long, docs long").groupBy("pair").agg(F.sum("docs").alias("docs"))
    pairs = written(found.withColumn("a", F.expr(f"pair div {size}")))
    best = pairs.groupBy("a").agg(F.max("docs").alias("most"), F.count("*").alias("pairs"))
    told = written(pairs.join(best.select("a", "most"), "a").select("a", "pair", "docs", (F.col("docs") == F.col("most")).alias("best")))
    sizes = np.zeros(len(two.bytes_a), np.int64)
    for r in best.select("a", "pairs").toLocalIterator():  # at most one row for each id of A
        sizes[r["a"]] = r["pairs"]
    stops = slices(sizes, SLICE)
    fields = "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"

    def told_of(low: int, high: int) -> DataFrame:
        part = told.where(F.col("a").between(low, high - 1)).select("pair", "docs", "best").toArrow()
        order = np.argsort(part["pair"].to_numpy())
        held = spark.sparkContext.broadcast(tuple(part[c].to_numpy()[order] for c in ("pair", "docs", "best")))  # at most SLICE pairs, or those of one A id

        def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            two = tokenizers_of(*known.value)
            for batch in batches:
                for run in runs(batch, two):
                    yield scores(batch, run, *held.value)

        return rows.mapInArrow(scored, fields)

    passes = [told_of(low, high) for low, high in zip([0, *stops[:-1]], stops)]
    dropped(pairs, told)
    return passes[0] if len(passes) == 1 else added(passes)


def slices(sizes: np.ndarray, most: int) -> list[int]:
    """Ends of runs of ids with at most ``most`` pairs each, or of a single id; the last end is the number of ids."""
    stops, held = [], 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            stops, held = [*stops, k], 0
        held += int(n)
    return [*stops, len(sizes)]


def added(passes: list[DataFrame]) -> DataFrame:
    """One row for each document of sums over passes. Rows that agree in all else have the same groups, so equal ones share their sums and stand as often as in the first pass."""
    keys = [c for c in passes[0].columns if c not in ("n_best", "count_sum")]
    every = passes[0].withColumn("turn", F.lit(0))
    for k, part in enumerate(passes[1:], 1):
        every = every.unionByName(part.withColumn("turn", F.lit(k)))
    copies = F.count(F.when(F.col("turn") == 0, 1))
    total = every.groupBy(*keys).agg(copies.alias("copies"), F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    total = total.withColumn("n_best", F.expr("n_best div copies")).withColumn("count_sum", F.expr("count_sum div copies"))
    return total.withColumn("copy", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int")))).select(*passes[0].columns)


def scores(batch: pa.RecordBatch, run: Run, pair: np.ndarray, docs: np.ndarray, best: np.ndarray) -> pa.RecordBatch:
    """The result's rows of a run, with counts of the pairs given; other pairs add nothing."""
    spot = np.minimum(np.searchsorted(pair, run.words.pair), max(len(pair) - 1, 0))
    hit = pair[spot] == run.words.pair if len(pair) else np.zeros(len(run.words.pair), bool)
    times = np.where(hit, run.words.times, 0)

    def by_word(values: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(values)])
        return total[run.words.link_at[1:]] - total[run.words.link_at[:-1]]

    n_best = by_word(times * best[spot]) if len(pair) else np.zeros(len(run.words.valid), np.int64)
    total = by_word(times * docs[spot]) if len(pair) else n_best
    text = run.words.text.take(pa.array(run.codes))
    at = np.frombuffer(text.buffers()[1], np.int64)[run.at] if len(run.codes) else np.zeros(len(run.at), np.int64)
    data = memoryview(text.buffers()[2] or b"")
    digest = [hashlib.sha256(data[s : e - 1]).hexdigest() if ok else "" for s, e, ok in zip(at[:-1], at[1:], run.valid)]
    ids = pc.cast(batch.column(0).slice(run.first, len(run.valid)), pa.int64())
    columns = [by_text(run, x) for x in (*run.words.n, n_best, total)]
    return pa.RecordBatch.from_arrays([ids, *map(pa.array, columns), pa.array(digest, pa.string())], ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"])
