"""Small inputs and slow, plain versions to hold the operators against."""

from __future__ import annotations

import re

import numpy as np
import regex

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def groups(n, linked):
    """Smallest index reachable from each of ``n`` nodes over pairs (i, j)."""
    up = list(range(n))

    def find(x):
        while up[x] != x:
            up[x] = up[up[x]]
            x = up[x]
        return x

    for i, j in linked:
        a, b = find(i), find(j)
        up[max(a, b)] = min(a, b)
    return [find(i) for i in range(n)]


def plain_fingerprint(text, words=4):
    import xxhash

    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    own = re.findall(r"[^\x20\x09-\x0D]+", low)
    if not own:
        return 0
    shingles = [" ".join(own[i:i + words]) for i in range(max(1, len(own) - words + 1))]
    hashes = [xxhash.xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def plain_words(text):
    low = re.sub("[A-Z]", lambda m: m.group().lower(), text or "")
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", low)


def plain_hits(text, items, size=10):
    """(words, hit words, sorted item ids) of a text by comparing every window with every window."""
    words = plain_words(text)
    hit, found = np.zeros(len(words), bool), set()
    for item, other in items:
        own = plain_words(other)
        n = min(size, len(own))
        for at in range(len(own) - n + 1 if n else 0):
            for i in range(len(words) - n + 1):
                if words[i:i + n] == own[at:at + n]:
                    hit[i:i + n] = True
                    found.add(str(item))
    return words, hit, sorted(found)


def plain_merge(word, ranks):
    parts = [word[i:i + 1] for i in range(len(word))]
    while len(parts) > 1:
        low = min(range(len(parts) - 1), key=lambda i: ranks.get(parts[i] + parts[i + 1], 1 << 60))
        if parts[low] + parts[low + 1] not in ranks:
            break
        parts[low:low + 2] = [parts[low] + parts[low + 1]]
    return [ranks[p] for p in parts]


def plain_ids(text, ranks, pattern):
    return [i for w in regex.findall(pattern, text or "") for i in plain_merge(w.encode(), ranks)]
