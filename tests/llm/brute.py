"""Plain versions of the training-data operators, for small inputs."""

import hashlib
import math
import re
from collections import Counter, defaultdict


def words(text):
    return (text or "").encode().split()


def substring_dedup(docs, length=50):
    """{doc_id: (n_words, n_removed, sha)} of {doc_id: text}."""
    first, out = {}, {}
    for d in sorted(docs):
        w = words(docs[d])
        gone, own = [False] * len(w), []
        for i in range(len(w) - length + 1):
            key = tuple(w[i : i + length])
            if first.get(key, d) < d:
                gone[i : i + length] = [True] * length
            else:
                own.append(key)
        for key in own:
            first.setdefault(key, d)
        out[d] = (len(w), sum(gone), hashlib.sha256(b" ".join(x for x, g in zip(w, gone, strict=True) if not g)).hexdigest())
    return out


def shingles(text, n=5):
    w = [x.lower() for x in words(text)]
    if not w:
        return frozenset()
    return frozenset(tuple(w[i : i + n]) for i in range(len(w) - n + 1)) if len(w) >= n else frozenset([tuple(w)])


class Union:
    def __init__(self, nodes):
        self.up = {n: n for n in nodes}

    def find(self, x):
        while self.up[x] != x:
            self.up[x] = self.up[self.up[x]]
            x = self.up[x]
        return x

    def join(self, a, b):
        a, b = self.find(a), self.find(b)
        self.up[max(a, b)] = min(a, b)


def jaccard(docs, percent=80):
    """{doc_id: (n_shingles, component_id)}."""
    s = {d: shingles(t) for d, t in docs.items()}
    u, lists, classes = Union(docs), defaultdict(list), defaultdict(list)
    for d in sorted(s):
        if s[d]:
            classes[s[d]].append(d)
    for c, members in classes.items():
        for m in members[1:]:
            u.join(members[0], m)
        for g in c:
            lists[g].append(members[0])
    shared = defaultdict(int)
    for members in lists.values():
        for i, b in enumerate(members):
            for a in members[:i]:
                shared[a, b] += 1
    for (a, b), n in shared.items():
        if 100 * n >= percent * (len(s[a]) + len(s[b]) - n):
            u.join(a, b)
    return {d: (len(s[d]), u.find(d)) for d in docs}


def leaks(docs, items, question_answer, threshold=0.5, overlap=0.6, n=4, k1=1.2, b=0.75):
    """{(doc_id, item_id): score} of {doc_id: text} and {item_id: text}: every window against every item."""
    rx = re.compile(r"\w+")
    bag = {i: Counter(rx.findall(t.lower())) for i, t in items.items() if t and rx.findall(t.lower())}
    df = Counter(t for x in bag.values() for t in x)
    length = {i: sum(x.values()) for i, x in bag.items()}
    mean = sum(length.values()) / max(1, len(length))
    idf = {t: math.log(1 + (len(bag) - c + 0.5) / (c + 0.5)) for t, c in df.items()}
    weight = {i: {t: idf[t] * c * (k1 + 1) / (c + k1 * (1 - b + b * length[i] / mean)) for t, c in x.items()} for i, x in bag.items()}
    own = {i: sum(x.values()) for i, x in weight.items()}
    step, out = max(16, max(length.values(), default=1)), {}
    for d, text in docs.items():
        w = rx.findall((text or "").lower())
        for lo in range(0, max(1, len(w) - step), step):
            window = w[lo : lo + 2 * step]
            have = set(window)
            for i, x in weight.items():
                score = sum(v for t, v in x.items() if t in have) / own[i]
                if score < threshold - 1e-9:
                    continue
                shares = []
                for part in question_answer(items[i]):
                    m = min(n, len(part))
                    grams = {tuple(window[j : j + m]) for j in range(len(window) - m + 1)} if m else set()
                    hit = {j + k for j in range(len(part) - m + 1) if tuple(part[j : j + m]) in grams for k in range(m)} if m else set()
                    shares.append(len(hit) / len(part) if part else 1.0)
                if min(shares) >= overlap:
                    out[d, i] = max(score, out.get((d, i), 0.0))
    return out


def grams(text):
    """Counter of the 1- to 3-grams of the padded words, as triples that sort like the codes."""
    out, word = Counter(), []
    for ch in (text or "").lower() + " ":
        if ch.isalpha():
            word.append(ord(ch) + 2)
            continue
        if word:
            p = [1, *word, 1]
            out.update((0, 0, c) for c in word)
            out.update((0, x, y) for x, y in zip(p, p[1:], strict=False))
            out.update(zip(p, p[1:], p[2:], strict=False))
        word = []
    return out


def languages(learned, docs, size=400, most=300):
    """{doc_id: (lang, score)} by out-of-place distance, from [(text, lang)] and {doc_id: text}."""
    by = {}
    for text, lang in learned:
        if text is not None and lang is not None:
            by.setdefault(lang, Counter()).update(grams(text))
    ranks = {lang: {g: i for i, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], x[0]))[:size])} for lang, c in by.items()}
    out = {}
    for d, text in docs.items():
        top = [g for g, _ in sorted(grams(text).items(), key=lambda x: (-x[1], x[0]))[:most]]
        far = {lang: sum(min(abs(r[g] - i), size) if g in r else size for i, g in enumerate(top)) for lang, r in ranks.items()}
        best = min(sorted(far), key=far.get) if top and far else None
        out[d] = (best, 1 - far[best] / (size * len(top))) if best else ("und", 0.0)
    return out


def byte_values():
    """Character -> byte of a byte-level BPE's names."""
    out, extra = {}, 0
    for b in range(256):
        if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255:
            out[chr(b)] = b
        else:
            out[chr(256 + extra)] = b
            extra += 1
    return out
