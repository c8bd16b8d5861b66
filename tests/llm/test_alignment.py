"""Token groups against whole texts encoded and cut byte by byte."""

import hashlib
import random
from collections import Counter

import pytest
import sentencepiece
from tokenizers import Tokenizer

from duskwatch.llm import alignment, queries

SF = "/root/testdata/sf0.001"
A, B = f"{alignment.TOKENIZERS}/byte_bpe_50k.json", f"{alignment.TOKENIZERS}/piece_bpe_32k.model"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "   "), (5, "a"), (6, " a  b   c "), (7, "\n\n x\t y \r\n"), (8, "x▁y z"), (9, "<|endoftext|> <s> </s> plain"), (10, "Ünïcödé é ﬁ ½"),
    (11, "日本語のテキスト、漢字。 한국어 עברית"), (12, "a b c　d e"), (13, "\x00\x01 \x1c x\x7f"), (14, "🙂🙂 👩‍👩‍👧 flags 🇩🇪"), (15, "abab" * 700), (16, "it's we'll DON'T 12345,678.9"),
    (5, "a"), (5, "b a b a"), (None, "no id"), (17, "a   b\u0085 c"), (18, " ▁ "), (19, "word  \n  word"), (20, "x" * 5000 + " " + "éà" * 900),
]


def plain(rows):
    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    out, linked = [], []
    for i, text in rows:
        ids_a, ids_b, groups = [], [], []
        if text:
            ids_a, ids_b = a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)
            one = [bytes(letters[c] for c in a.id_to_token(k)) for k in ids_a]
            two = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in ids_b]
            if not b"".join(one) == b"".join(two) == (" " + text).encode():
                ids_a, ids_b = [], []
            at_a = at_b = x = y = 0
            while x < len(ids_a):
                group = ([ids_a[x]], [ids_b[y]])
                at_a, at_b, x, y = at_a + len(one[x]), at_b + len(two[y]), x + 1, y + 1
                while at_a != at_b:
                    if at_a < at_b:
                        group[0].append(ids_a[x])
                        at_a, x = at_a + len(one[x]), x + 1
                    else:
                        group[1].append(ids_b[y])
                        at_b, y = at_b + len(two[y]), y + 1
                groups.append(group)
        out.append((i, ids_a, ids_b, groups))
        linked.append(Counter((p, q) for g in groups for p in g[0] for q in g[1]))
    docs = Counter(pair for c in linked for pair in c)
    most = {}
    for (p, _), n in docs.items():
        most[p] = max(most.get(p, 0), n)
    done = []
    for (i, ids_a, ids_b, groups), links in zip(out, linked):
        text = ";".join(",".join(map(str, g[0])) + "|" + ",".join(map(str, g[1])) for g in groups)
        sums = sum(m for pair, m in links.items() if docs[pair] == most[pair[0]]), sum(m * docs[pair] for pair, m in links.items())
        done.append((i, len(ids_a), len(ids_b), len(groups), sum(links.values()), *sums, hashlib.sha256(text.encode()).hexdigest() if text else ""))
    return done


def order(rows):
    return sorted(rows, key=lambda r: tuple((x is None, x if x is not None else 0) for x in r[:-1]) + (r[-1],))


def noise(n, seed=5):
    rng = random.Random(seed)
    pool = ["a", "b", " ", "  ", "\n", "é", "▁", " ", " ", "語", "🙂", "'s", "12", "the", " the", ",", "Ġ", "\x85", "<0x0A>", "\t", "ing"]
    return [(1000 + k, "".join(rng.choice(pool) for _ in range(rng.randrange(1, 60)))) for k in range(n)]


@pytest.mark.parametrize("most", [alignment.SLICE, 300])
def test_alignment_equals_whole_texts(spark, monkeypatch, most):
    monkeypatch.setattr(alignment, "SLICE", most)
    monkeypatch.setattr(alignment, "AT_ONCE", 3000)  # several runs in a batch
    monkeypatch.setattr(alignment, "HELD", 500)
    rows = ODD + noise(150)
    docs = spark.createDataFrame([(i, t, -1, "x", "en") for i, t in rows], "doc_id long, text string, n_a int, pair string, docs string").repartition(3)
    assert order(tuple(r) for r in alignment.align(docs).collect()) == order(plain(rows))


def test_alignment_of_the_standard_table(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]
    assert order(tuple(r) for r in queries.op13_cross_tokenizer_alignment(spark, SF).collect()) == order(plain(rows))


def test_alignment_of_an_empty_table(spark):
    assert alignment.align(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_groups_without_common_ends_keep_their_links():
    two = alignment.tokenizers_of(open(A, "rb").read(), open(B, "rb").read())
    got = alignment.aligned([" " + "xyz" * 2000, " plain"], two)
    n_a, n_b, n_groups, n_links = got.n
    assert got.valid.all() and n_groups[0] >= 1 and got.times[: got.link_at[1]].sum() == n_links[0] and n_a[0] > 1000 and n_b[0] > 1000


def test_slices_hold_every_id():
    import numpy as np

    assert alignment.slices(np.array([3, 0, 4, 9, 1, 1]), 5) == [2, 3, 4, 6]
    assert alignment.slices(np.zeros(4, int), 5) == [4]


def test_runs_of_a_batch_count_like_one(monkeypatch):
    import numpy as np
    import pyarrow as pa

    two = alignment.tokenizers_of(open(A, "rb").read(), open(B, "rb").read())
    rows = ODD + noise(80)
    batch = pa.RecordBatch.from_pydict({"doc_id": pa.array([i for i, _ in rows], pa.int64()), "text": [t for _, t in rows]})
    span, found = len(two.bytes_a) * len(two.bytes_b), []
    for most in (10**7, 400):
        monkeypatch.setattr(alignment, "AT_ONCE", most)
        each = [(run, *alignment.linked_texts(run, span)) for run in alignment.runs(batch, two)]
        pair, docs = alignment.tallied(np.concatenate([k for _, k, _ in each]), np.concatenate([n for _, _, n in each]))
        scores = pa.Table.from_batches([alignment.scores(batch, run, pair, docs, docs > 2) for run, _, _ in each])
        found.append((pair.tolist(), docs.tolist(), scores.to_pylist()))
    assert len(each) > 10 and found[0] == found[1]
