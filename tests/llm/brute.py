"""Plain versions of the operators, written apart from them, for small tables."""

import hashlib
import re
from collections import defaultdict

SPACE = re.compile(r"[^\x20\x09-\x0D]+")


def reach(ids, links):
    """The smallest id that each id reaches over links."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b), near[b].add(a)
    out = {}
    for i in sorted(ids):
        if i in out:
            continue
        out[i], todo = i, [i]
        while todo:
            for j in near[todo.pop()]:
                if j not in out:
                    out[j] = i
                    todo.append(j)
    return out


def lowered(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text)


def word_set(text, n):
    words = SPACE.findall(lowered(text or ""))
    if not words:
        return frozenset()
    if len(words) < n:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1))


def near_texts(docs, n, percent):
    """doc_id -> (set size, component) by all pairs."""
    sets = {i: word_set(t, n) for i, t in docs}
    ids = sorted(i for i in sets if sets[i])
    links = []
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                links.append((a, b))
    comp = reach(sets, links)
    return {i: (len(sets[i]), comp[i]) for i in sets}


def long_repeats(docs, length):
    """doc_id -> (bytes, removed, runs, digest of the rest) for every text."""
    seen = defaultdict(list)
    raw = {i: (t or "").encode() for i, t in docs}
    for i, b in raw.items():
        for s in range(len(b) - length + 1):
            seen[b[s : s + length]].append((i, s))
    gone = {i: bytearray(len(b)) for i, b in raw.items()}
    for places in seen.values():
        if len(places) > 1:
            for i, s in places:
                gone[i][s : s + length] = b"\x01" * length
    out = {}
    for i, b in raw.items():
        runs = sum(1 for k in range(len(b)) if gone[i][k] and (not k or not gone[i][k - 1]))
        rest = bytes(c for c, g in zip(b, gone[i]) if not g)
        out[i] = (len(b), sum(gone[i]), runs, hashlib.sha256(rest).hexdigest())
    return out


def infix_edits(item, text):
    """Fewest edits that turn item into some piece of text, by the full table."""
    row = [0] * (len(text) + 1)
    for x, c in enumerate(item):
        new = [x + 1]
        for y, d in enumerate(text):
            new.append(min(row[y] + (c != d), row[y + 1] + 1, new[y] + 1))
        row = new
    return min(row)


def char_set(line, n=5):
    """All overlapping shingles of n characters; a shorter line is its own."""
    return {line[i : i + n] for i in range(len(line) - n + 1)} or {line}


def near_lines(docs, percent):
    """(doc_id, line) -> first (doc_id, line) of its component, for components of several lines: all pairs that share a shingle."""
    rows = []
    for i, t in docs:
        if i is None or t is None:
            continue
        for k, raw in enumerate(t.split("\n")):
            if raw.strip(" \t\r"):
                rows.append(((i, k), raw.lower().strip(" \t\r")))
    sets = {x: char_set(x) for _, x in rows}
    holders, links = defaultdict(list), []
    for x, a in sets.items():
        shared = defaultdict(int)
        for s in a:
            for y in holders[s]:
                shared[y] += 1
            holders[s].append(x)
        links += [(x, y) for y, both in shared.items() if 100 * both >= percent * (len(a) + len(sets[y]) - both)]
    comp = reach(sets, links)
    groups = defaultdict(list)
    for at, x in rows:
        groups[comp[x]].append(at)
    return {at: min(g) for g in groups.values() if len(g) > 1 for at in g}
