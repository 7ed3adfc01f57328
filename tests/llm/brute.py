"""Brute-force versions of what the operators compute, written from their contracts and not from their code."""

from __future__ import annotations

import math
import re
from collections import Counter


def normal(text):
    return re.sub(r"[\x20\x09-\x0D]", "", text or "")


def components_of(texts):
    """(number of shingles, smallest id of the component) by id; sets with no common shingle are never compared."""
    sets = {}
    for i, t in texts:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set()
    holders: dict = {}
    for i, s in sets.items():
        for x in s:
            holders.setdefault(x, []).append(i)
    pairs = {(a, b) for h in holders.values() for k, a in enumerate(h) for b in h[k + 1 :]}
    root = {i: i for i in sets}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            x, y = find(a), find(b)
            root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in sets}


def leaks_of(texts, items, overlap=0.5, k1=1.2, b=0.75):
    """Every window of one and a half times an item's words in every text: (id, item) to passage, score, question, answer."""
    clean = lambda t: [w for w in (re.sub(r"^[\W_]+|[\W_]+$", "", w.lower()) for w in t.split()) if w]

    def parts(text):
        marks = list(re.finditer(r"(?:^|\n)\s*(?:answer|a)\s*[:.]\s+", text, re.IGNORECASE))
        if marks:
            return clean(text[: marks[-1].start()]), clean(text[marks[-1].end() :])
        sentences = [s for s in re.split(r"(?<=[.?!])\s+", text.strip()) if clean(s)]
        return (clean(" ".join(sentences[:-1])), clean(sentences[-1])) if len(sentences) > 1 else (clean(text), [])

    def share(part, words):
        n = min(5, len(part))
        runs = lambda ws: {tuple(ws[i : i + n]) for i in range(len(ws) - n + 1)}
        return len(runs(part) & runs(words)) / len(runs(part)) if part else 1.0

    told = [(item, clean(t), *parts(t)) for item, t in items if t and clean(t)]
    assert all(q or a for _, _, q, a in told)
    df = Counter(w for _, words, _, _ in told for w in set(words))
    mean = sum(len(words) for _, words, _, _ in told) / max(1, len(told))
    found: dict = {}
    weights = []
    for item, words, question, answer in told:
        norm = k1 * (1 - b + b * len(words) / mean)
        weight = {w: math.log(1 + (len(told) - df[w] + 0.5) / (df[w] + 0.5)) * tf * (k1 + 1) / (tf + norm) for w, tf in Counter(words).items()}
        weights.append((item, (3 * max(5, len(words)) + 1) // 2, weight, sum(weight.values()), question, answer))
    for i, text in texts:
        words = clean(text or "")
        for item, size, weight, whole, question, answer in weights:
            if share(question, words) < overlap or share(answer, words) < overlap:
                continue
            for start in range(len(words)):
                passage = words[start : start + size]
                if passage[0] in weight:
                    q, a = share(question, passage), share(answer, passage)
                    if q >= overlap and a >= overlap and ((i, item) not in found or q + a > sum(found[i, item][2:])):
                        held = weight.keys() & set(passage)
                        found[i, item] = (start, min(1.0, sum(weight[w] for w in held) / whole), q, a)
    return {k: (p, round(s, 6), q, a) for k, (p, s, q, a) in found.items()}
