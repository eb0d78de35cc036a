"""Plain Python versions of the corpus operators."""

from __future__ import annotations

import hashlib
import re
from collections import defaultdict

WORD = re.compile("[^\x20\x09-\x0d]+")
_FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fold(text):
    return (text or "").translate(_FOLD)


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def components(ids, links):
    """The smallest identifier reachable from each."""
    near = defaultdict(set)
    for a, b in links:
        near[a].add(b)
        near[b].add(a)
    least = {}
    for i in sorted(set(ids)):
        todo = [i]
        while todo:
            k = todo.pop()
            if k not in least:
                least[k] = i
                todo.extend(near[k])
    return least


def shingles(text):
    w = WORD.findall(fold(text))
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def ngram_join(docs):
    """(doc_id, n_shingles, component_id) of (doc_id, text)."""
    sets = [(i, shingles(t)) for i, t in docs]
    links = [(a, b) for k, (a, x) in enumerate(sets) for b, y in sets[:k] if x and y and 100 * len(x & y) >= 75 * len(x | y)]
    least = components([i for i, _ in docs], links)
    return sorted((i, len(x), least[i]) for i, x in sets)


def substring_dedup(docs):
    """(doc_id, n_words, n_removed, kept_sha256) of (doc_id, text)."""
    lists = [(i, WORD.findall(t or "")) for i, t in docs]
    first = {}
    for i, w in lists:
        for k in range(len(w) - 12):
            key = tuple(w[k : k + 13])
            first[key] = min(first.get(key, i), i)
    out = []
    for i, w in lists:
        gone = {k + j for k in range(len(w) - 12) if first[tuple(w[k : k + 13])] < i for j in range(13)}
        out.append((i, len(w), len(gone), sha(" ".join(x for k, x in enumerate(w) if k not in gone))))
    return sorted(out)


def exact_dedup(docs, best=max):
    """(doc_id, keep_id, group_size, kept, sha) of (doc_id, text)."""
    groups = defaultdict(list)
    for i, t in docs:
        groups[fold(t)].append(i)
    return sorted((i, best(groups[fold(t)]), len(groups[fold(t)]), i == best(groups[fold(t)]), sha(fold(t))) for i, t in docs)


def cosine(x, y):
    dot = sum(a * b for a, b in zip(x, y, strict=True))
    return dot / (sum(a * a for a in x) ** 0.5 * sum(b * b for b in y) ** 0.5)


def segment(word, pieces, rate_limit, draw):
    """Pieces of one word with its spaces, by an agenda that is gone through anew for every candidate.

    ``pieces``: score by piece; ``draw(k)``: what the k-th candidate draws. Also returns (candidate, skipped) in order.
    """
    s = list(word.replace(" ", "\u2581"))
    off, log = set(), []
    while True:
        open_ = [(-pieces[s[k] + s[k + 1]], k) for k in range(len(s) - 1) if s[k] + s[k + 1] in pieces and (sum(map(len, s[:k])), s[k], s[k + 1]) not in off]
        if not open_:
            return s, log
        k = min(open_)[1]
        skip = draw(len(log)) < rate_limit
        log.append((s[k] + s[k + 1], skip))
        if skip:
            off.add((sum(map(len, s[:k])), s[k], s[k + 1]))
        else:
            s[k : k + 2] = [s[k] + s[k + 1]]
