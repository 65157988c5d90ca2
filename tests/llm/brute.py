"""Plain versions of the operators, to hold their results against."""

import re
from collections import defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingle_set(text, n=5):
    words = WORD.findall((text or "").translate(LOWER))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1)))


def near_duplicates(docs, n=5, percent=80):
    """(doc_id, n_shingles, component_id, n_links) of (doc_id, text) rows, by comparing all that share a shingle."""
    sets = [(d, shingle_set(t, n)) for d, t in docs]
    parent = list(range(len(sets)))

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    holders = defaultdict(list)
    for i, (_, s) in enumerate(sets):
        for x in s:
            holders[x].append(i)
    common = defaultdict(int)
    for h in holders.values():
        for a in range(len(h)):
            for b in range(a):
                common[h[b], h[a]] += 1
    links = [0] * len(sets)
    for (i, j), c in common.items():
        if 100 * c >= percent * (len(sets[i][1]) + len(sets[j][1]) - c):
            parent[root(i)] = root(j)
            links[i] += 1
            links[j] += 1
    least = defaultdict(lambda: float("inf"))
    for i, (d, _) in enumerate(sets):
        least[root(i)] = min(least[root(i)], d)
    return sorted((d, len(s), least[root(i)], links[i]) for i, (d, s) in enumerate(sets))


def quality_counts(text):
    """Words, their characters, symbols, lines with a word, those seen before, and words in runs of three that recur."""
    text = text or ""
    words = WORD.findall(text)
    seen, lines, dup = set(), 0, 0
    for line in text.split("\n"):
        if WORD.search(line):
            lines += 1
            dup += line in seen
            seen.add(line)
    runs = defaultdict(list)
    for i in range(len(words) - 2):
        runs[tuple(words[i : i + 3])].append(i)
    covered = {i + k for at in runs.values() if len(at) > 1 for i in at for k in range(3)}
    return len(words), sum(map(len, words)), sum(text.count(c) for c in "#*$%&|<>"), lines, dup, len(covered)


KINDS = [
    ("assign", re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""), lambda m: len(m[2]) >= 6),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 20),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 24),
]


def base_spans(text):
    found = [(m.start(), k, m.end(), name) for k, (name, p, ok) in enumerate(KINDS) for m in p.finditer(text or "") if ok(m)]
    return ",".join(f"{name}:{a}:{b}" for a, _, b, name in sorted(found))
