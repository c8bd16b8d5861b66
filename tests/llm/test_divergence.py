"""Sources' differences against plain sums of whole numbers."""

import random
import re
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest

from duskwatch.llm import divergence, queries

from ..compare import differences, duck

SF = "/root/testdata/sf0.001"
SCHEMA = "n long, text string, term string, lang string, source string"


def plain(docs, least):
    terms, held = {}, {}
    for text, lang, source in docs:
        lang, source = lang or "", source or ""
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        terms.setdefault(lang, {}).setdefault(source, Counter()).update(found)
        held.setdefault(lang, Counter()).update(set(found))
    out = []
    for lang, sources in terms.items():
        kept = sorted(t for t, n in held[lang].items() if n >= least)
        v = len(kept)

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 10**9 * (c[t] + 5) // (total + 5 * v) for t in kept}

        p, q = {s: shares(c) for s, c in sources.items()}, shares(sum(sources.values(), Counter()))
        for s in sources:
            pairs = [(sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in sources if o != s]
            told = [(p[s][t] - q[t], t) for t in kept if sources[s][t] and p[s][t] > q[t]]
            for part, rows, most in (("pair", pairs, len(pairs)), ("term", told, 50)):
                ranked = sorted(rows, key=lambda x: (-x[0], x[1].encode()))[:most]
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(ranked, 1)]
    return sorted(out)


def varied(seed=4):
    rng = random.Random(seed)
    vocabulary = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(90)] + ["É", "é", "ß", "語", "A", "a", "Zz", "zZ"]
    docs = [(None, None, None), ("", "en", "x"), ("123 --- 456", "none", "lone"), ("a", "none", "other"), ("x" * 300_000 + " wa", "en", "x"), ("wab\x00wab\x7fwab WAB", None, "s1")]
    for k in range(500):
        source = f"s{min(rng.randrange(12), rng.randrange(12))}"
        docs.append((rng.choice([" ", "\n", "-"]).join(rng.choice(vocabulary[: 20 + 8 * int(source[1:])]) for _ in range(rng.randrange(12))), rng.choice(["en", "en", "de"]), source))
    return docs + docs[-3:]


@pytest.mark.parametrize(("tile_terms", "tile_sources"), [(256, 128), (7, 2), (1, 5)])
def test_audit_equals_plain_sums(spark, monkeypatch, tile_terms, tile_sources):
    monkeypatch.setattr(divergence, "TERMS", tile_terms)
    monkeypatch.setattr(divergence, "SOURCES", tile_sources)
    docs = varied()
    df = spark.createDataFrame([(-1, t, "clash", lang, s) for t, lang, s in docs], SCHEMA).repartition(5)
    assert sorted(tuple(r) for r in divergence.audit_sources(df).collect()) == plain(docs, 30)


def test_audit_equals_sql(spark):
    assert differences(queries.op11_source_divergence(spark, SF), duck(SF), queries.OP11_SQL) == ""


def test_audit_of_an_empty_table(spark):
    assert divergence.audit_sources(spark.createDataFrame([], SCHEMA)).collect() == []


def test_shares_are_exact_at_any_size():
    rng = random.Random(1)
    for total in (10, 10**6, 10**12, 8 * 10**15):
        counts = np.array([rng.randrange(total) for _ in range(50)] + [0, total])
        assert divergence.shares(counts, np.int64(total), np.int64(17)).tolist() == [1 + 10**9 * (int(c) + 5) // (total + 85) for c in counts]


def test_counts_are_added_up_over_runs(monkeypatch):
    monkeypatch.setattr(divergence, "AT_ONCE", 50)
    monkeypatch.setattr(divergence, "HELD", 20)
    docs = varied()
    batches = [pa.RecordBatch.from_pydict({"lang": [x[1] for x in part], "source": [x[2] for x in part], "text": [x[0] for x in part]}) for part in (docs[:200], docs[200:])]
    got, seen = Counter(), Counter()
    for out in divergence.term_counts(iter(batches)):
        for r in out.to_pylist():
            got[r["lang"], r["source"], r["term"]] += r["n"]
            seen[r["lang"], r["source"], r["term"]] += r["docs"]
    want, docs_with = Counter(), Counter()
    for text, lang, source in docs:
        found = re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        want.update((lang or "", source or "", t) for t in found)
        docs_with.update((lang or "", source or "", t) for t in set(found))
    assert got == want and seen == docs_with
