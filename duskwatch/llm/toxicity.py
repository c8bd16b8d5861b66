"""Toxic spans by a linear-chain conditional random field, with document scores from its marginals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import flat
from .work import BROADCAST_ROWS

U = np.uint64
#: Bounds of the labelled sample that the model is fitted on: documents of each class, and the longest that is taken.
SAMPLE_EACH, SAMPLE_CHARS = 1500, 12_000
#: Fewest toxic training documents that a feature must occur in before it can mark a token as toxic.
SUPPORT = 4
#: Least likelihood ratio of such a feature: with 2 ** HASH_BITS features one reaches it by chance in about ten fits.
EVIDENCE = 26.0
HASH_BITS = 20
#: Tokens of a chain that run together; a chunk reads this many tokens of its neighbours first, beyond which messages have faded.
CHUNK, HALO = 256, 24
#: The same for training, and the most chains of each kind that it takes.
TRAIN_CHUNK, TRAIN_CHAINS = 64, 4000
#: Lengths in bytes of the prefixes and suffixes that serve as features beside the whole word.
PREFIXES, SUFFIXES = (3, 4, 5, 6), (4,)


def tokens(texts: list[bytes]):
    """Runs of letters of texts laid end to end: lowered bytes, text starts, token starts, ends and text index."""
    buf, at = flat.joined(texts)
    low = flat.lowered(buf)
    letter = flat.ALNUM[low] & ~((low >= 0x30) & (low <= 0x39))
    starts, ends = flat.bounds(letter)
    return low, at, starts, ends, np.searchsorted(at, starts, "right") - 1


def features(low: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hashed features of each token, one column for each kind: word, prefixes, suffixes. Affixes longer than the token are the word."""
    word = flat.hashes(low, starts, ends)
    cols = [word]
    for k, n in enumerate(PREFIXES):
        cut = np.where(ends - starts > n, starts + n, starts)
        cols.append(np.where(cut > starts, flat.hashes(low, starts, cut) + U(k + 1), word))
    for k, n in enumerate(SUFFIXES):
        cut = np.where(ends - starts > n, ends - n, ends)
        cols.append(np.where(cut < ends, flat.hashes(low, cut, ends) + U(k + 11), word))
    return np.stack([(flat.mixed(c + U(100 + i)) >> U(64 - HASH_BITS)).astype(np.int32) for i, c in enumerate(cols)], axis=1)


def marginals(unary: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """P(state 1) of each token and P(state, next state) summed, for chains laid out as rows of ``unary`` (log odds of state 1).

    Forward-backward in log odds of two states; padding has a unary of -inf."""
    rows, n = unary.shape
    a, b = np.zeros((n, rows)), np.zeros((n, rows))
    t = trans
    for i in range(n):
        if i:
            x = a[i - 1]
            a[i] = np.logaddexp(t[0, 1], x + t[1, 1]) - np.logaddexp(t[0, 0], x + t[1, 0])
        a[i] += unary[:, i]
    for i in range(n - 2, -1, -1):
        y = b[i + 1] + unary[:, i + 1]
        b[i] = np.logaddexp(t[1, 0], y + t[1, 1]) - np.logaddexp(t[0, 0], y + t[0, 1])
    p = 1 / (1 + np.exp(-np.clip(a + b, -60, 60)))
    # pair marginals: forward of i, transition, backward of i + 1
    x, y = a[:-1], b[1:] + unary[:, 1:].T
    cells = [[np.zeros_like(x) + t[0, 0], t[0, 1] + y], [x + t[1, 0], x + y + t[1, 1]]]
    top = np.maximum(np.maximum(cells[0][0], cells[0][1]), np.maximum(cells[1][0], cells[1][1]))
    e = [[np.exp(c - top) for c in r] for r in cells]
    total = e[0][0] + e[0][1] + e[1][0] + e[1][1]
    real = np.isfinite(unary[:, 1:].T)
    pairs = np.array([[(e[i][j] / total)[real].sum() for j in (0, 1)] for i in (0, 1)])
    return p.T, pairs


def _parts(texts: list[bytes]):
    """Ranges of texts that are read together: memory follows a part and not the sample."""
    start, size = 0, 0
    for i, text in enumerate(texts):
        if size and size + len(text) > flat.BYTES_AT_ONCE:
            yield start, i
            start, size = i, 0
        size += len(text)
    yield start, len(texts)


class Crf:
    """Weights of hashed token features, 2 x 2 transitions, and the document layer over the marginals."""

    def __init__(self):
        self.weight, self.bias, self.trans = np.zeros(1 << HASH_BITS, np.float32), -4.0, np.array([[1.0, -1.0], [0.0, 0.0]])
        self.doc = np.array([-3.0, 0, 0, 0])  # without a token that marks toxic texts every text counts as clean

    def fit(self, texts: list[bytes], toxic: np.ndarray, steps: int = 60):
        """Token labels come from document labels: a token of a toxic text is toxic if one of its features is common among toxic
        training texts and nearly absent from the others. The chain is then fitted by gradient ascent on those labels."""
        size = 1 << HASH_BITS
        pos, neg = np.zeros(size, np.int32), np.zeros(size, np.int32)
        for a, b in _parts(texts):
            low, _, starts, ends, doc = tokens(texts[a:b])
            for column in features(low, starts, ends).T:
                seen = np.unique(doc * size + column)
                y = toxic[a + seen // size] > 0
                pos += np.bincount(seen[y] % size, minlength=size).astype(np.int32)
                neg += np.bincount(seen[~y] % size, minlength=size).astype(np.int32)
        some = max(1.0, toxic.sum()), max(1.0, (1 - toxic).sum())
        share = some[0] / (some[0] + some[1])
        seen = np.maximum(pos + neg, 1)
        # likelihood ratio against chance: among so many features some are common in a few toxic texts without meaning anything
        ratio = 2 * (pos * np.log(np.maximum(pos / seen / share, 1e-9)) + neg * np.log(np.maximum(neg / seen / (1 - share), 1e-9)))
        marks = (pos >= SUPPORT) & (np.log((pos + 0.1) / some[0]) - np.log((neg + 0.1) / some[1]) > 2.5) & (ratio >= EVIDENCE)
        # chains: runs of TRAIN_CHUNK tokens of one text; those that hold a toxic token and as many others
        hot, cold = [], []
        for a, b in _parts(texts):
            low, _, starts, ends, doc = tokens(texts[a:b])
            f = features(low, starts, ends)
            label = marks[f].any(axis=1) & (toxic[a + doc] > 0)
            if not len(doc):
                continue
            edge = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
            for s, e in zip(edge, [*edge[1:], len(doc)], strict=True):
                for k in range(s, e, TRAIN_CHUNK):
                    stop = min(k + TRAIN_CHUNK, e)
                    if not label[k:stop].any():
                        cold.append((a + int(doc[s]), int(k - s)))
                    elif len(hot) < TRAIN_CHAINS:
                        hot.append((f[k:stop].copy(), label[k:stop].astype(float)))
        wanted: dict[int, list[int]] = {}
        for i in np.random.default_rng(7).permutation(len(cold))[: max(400, len(hot))]:
            wanted.setdefault(cold[i][0], []).append(cold[i][1])
        if not hot or not cold:
            return self
        chains = hot
        for i, places in sorted(wanted.items()):
            low, _, starts, ends, _ = tokens(texts[i : i + 1])
            for k in sorted(places):
                f = features(low, starts[k : k + TRAIN_CHUNK], ends[k : k + TRAIN_CHUNK])
                chains.append((f, np.zeros(len(f))))
        lengths = np.array([len(y) for _, y in chains])
        place = np.arange(lengths.max()) < lengths[:, None]
        real = place
        fs, y = np.concatenate([f for f, _ in chains]), np.concatenate([y for _, y in chains])
        columns = fs.shape[1]
        used, fs = np.unique(fs, return_inverse=True)
        fs = fs.reshape(-1, columns)
        y2 = np.zeros(place.shape)
        y2[real] = y
        both = real[:, 1:]
        want = np.array([[((y2[:, :-1] == i) & (y2[:, 1:] == j) & both).sum() for j in (0, 1)] for i in (0, 1)], float)
        par = np.concatenate([np.zeros(len(used)), [self.bias], self.trans.ravel()])
        m, v = np.zeros_like(par), np.zeros_like(par)
        for step in range(1, steps + 1):
            unary = np.full(place.shape, -np.inf)
            unary[real] = par[: len(used)][fs].sum(axis=1) + par[len(used)]
            p, pairs = marginals(unary, par[-4:].reshape(2, 2))
            miss = y - p[real]
            g = np.concatenate([np.bincount(fs.ravel(), np.repeat(miss, fs.shape[1]), len(used)), [miss.sum()], (want - pairs).ravel()]) / 50
            g -= 0.02 * par
            m, v = 0.9 * m + 0.1 * g, 0.98 * v + 0.02 * g * g
            par += 0.3 * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.98**step)) + 1e-6)
        self.weight[used], self.bias, self.trans = par[: len(used)], float(par[len(used)]), par[-4:].reshape(2, 2)
        x = np.concatenate([self.summary(texts[a:b])[0] for a, b in _parts(texts)])
        rate = len(toxic) / 2 / np.maximum(1, np.array([(1 - toxic).sum(), toxic.sum()]))[toxic.astype(int)]
        self.doc = np.zeros(4)
        for _ in range(400):
            p = 1 / (1 + np.exp(-np.clip(x @ self.doc, -30, 30)))
            h = (x * (rate * p * (1 - p))[:, None]).T @ x + 0.05 * np.eye(4)
            step = np.linalg.solve(h, x.T @ (rate * (toxic - p)) - 0.05 * self.doc)
            self.doc += np.clip(step, -2, 2)
            if np.abs(step).max() < 1e-8:
                break
        return self

    def chain(self, texts: list[bytes]):
        """Tokens of the texts with their marginals: starts within the text, ends, text index, P(toxic)."""
        low, at, starts, ends, doc = tokens(texts)
        if not len(starts):
            return starts, ends, doc, np.zeros(0)
        unary = self.weight[features(low, starts, ends)].sum(axis=1, dtype=np.float64) + self.bias
        first = np.flatnonzero(np.concatenate([[True], doc[1:] != doc[:-1]]))
        begin = first[np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]]))]
        stop = np.concatenate([first[1:], [len(doc)]])[np.cumsum(np.concatenate([[False], doc[1:] != doc[:-1]]))]
        head = np.flatnonzero((np.arange(len(doc)) - begin) % CHUNK == 0)
        span = np.arange(-HALO, CHUNK + HALO)
        p = np.zeros(len(doc))
        for k in range(0, len(head), 2048):
            h = head[k : k + 2048]
            index = h[:, None] + span
            ok = (index >= begin[h][:, None]) & (index < stop[h][:, None])
            u = np.where(ok, unary[np.clip(index, 0, len(doc) - 1)], -np.inf)
            u = np.where(ok | (index >= stop[h][:, None]), u, -1e3)  # before the start: surely clean
            q = marginals(np.where(np.isfinite(u), u, -1e3), self.trans)[0]
            mine = ok & (span >= 0) & (span < CHUNK)
            p[index[mine]] = q[mine]
        return starts - at[doc], ends - at[doc], doc, p

    def summary(self, texts: list[bytes]):
        """Aggregates of the marginals for each text (bias, log odds of the highest, log of their sum, share), with the tokens."""
        starts, ends, doc, p = self.chain(texts)
        x = np.zeros((len(texts), 4))
        x[:, 0] = 1
        top = np.full(len(texts), 1e-4)
        np.maximum.at(top, doc, p)
        top = np.minimum(top, 1 - 1e-4)
        total = np.bincount(doc, np.where(p > 0.01, p, 0), len(texts))
        x[:, 1] = np.log(top / (1 - top)) / 4
        x[:, 2] = np.log1p(total)
        x[:, 3] = total / np.maximum(1, np.bincount(doc, minlength=len(texts))) * 10
        return x, (starts, ends, doc, p)


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Crf:
    """Fit on at most SAMPLE_EACH labelled texts of each class, of at most SAMPLE_CHARS characters, taken by hash of the id."""
    marks = labels.select(F.col(id_col).alias("id"), F.col(label_col).cast("int").alias("y")).where("id IS NOT NULL AND y IN (0, 1)")
    pick = None
    for y in (0, 1):
        some = marks.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_EACH * 2)
        pick = some if pick is None else pick.unionByName(some)
    assert SAMPLE_EACH * 4 <= BROADCAST_ROWS
    rows = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("t")).where(F.length("t") <= SAMPLE_CHARS).join(F.broadcast(pick), "id").select("id", "t", "y")
    got = [r for y in (0, 1) for r in rows.where(F.col("y") == y).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_EACH).collect()]
    return Crf().fit([r["t"].encode() for r in got], np.array([r["y"] for r in got], float))


def _scored(model: Crf):
    def run(batches):
        for batch in batches:
            for i, j, texts in flat.chunks(batch):
                x, (starts, ends, doc, p) = model.summary(texts)
                score = 1 / (1 + np.exp(-np.clip(x @ model.doc, -30, 30)))
                hit = np.flatnonzero(p >= 0.5)
                spans: list[list] = [[] for _ in range(j - i)]
                for k in hit:
                    spans[doc[k]].append({"start": int(starts[k]), "end": int(ends[k]), "probability": float(p[k])})
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(i, j - i), pa.array(score), pa.array((score >= 0.5).astype(np.int32)), pa.array(spans, pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("probability", pa.float64())])))],
                    ["doc_id", "score", "predicted", "spans"])

    return run


def score_toxicity(docs: DataFrame, model: Crf, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Toxicity of whole texts: doc_id, score (0 to 1), predicted (score >= 0.5), spans of offending tokens.

    Spans are offsets into the text's UTF-8 bytes, with the token's marginal. Scores depend on the text alone. Null, empty and
    letterless texts get the score of a text without any toxic token. Repeated rows are scored alike; an empty table gives no rows;
    null ids are kept. Other columns are ignored.
    """
    return docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(
        _scored(model), f"doc_id {dict(docs.dtypes)[id_col]}, score double, predicted int, spans array<struct<start:int,end:int,probability:double>>"
    )
