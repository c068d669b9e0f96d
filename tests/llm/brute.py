"""Plain Python restatements that the tests hold the corpus operators against."""

import re
from collections import Counter, defaultdict

WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def shingles(text, k):
    words = WORD.findall((text or "").encode().lower())
    if not words:
        return frozenset()
    return frozenset(tuple(words[i:i + k]) for i in range(len(words) - k + 1)) if len(words) >= k else frozenset([tuple(words)])


def components(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for a, b in links:
        root[find(a)] = find(b)
    return [find(x) for x in range(n)]


def near_duplicates(rows, k, above, below):
    """rows: (doc_id, text). (doc_id, n_shingles, component_id, kept), by counting the shared shingles of all pairs."""
    sets = [shingles(text, k) for _, text in rows]
    holders = defaultdict(list)
    for i, s in enumerate(sets):
        for x in s:
            holders[x].append(i)
    links = set()
    for i, s in enumerate(sets):
        for j, shared in Counter(j for x in s for j in holders[x] if j > i).items():
            if below * shared >= above * (len(s) + len(sets[j]) - shared):
                links.add((i, j))
    roots, least = components(len(rows), links), {}
    for i, root in enumerate(roots):
        least[root] = min(least.get(root, rows[i][0]), rows[i][0], key=lambda x: (x is None, x))
    return [(rows[i][0], len(sets[i]), least[root], rows[i][0] == least[root]) for i, root in enumerate(roots)]
