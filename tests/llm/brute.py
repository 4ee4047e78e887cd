"""Brute-force versions that several tests of the corpus operators share."""

import hashlib
import math
import re
import unicodedata

import numpy as np
import xxhash


def brute_groups(texts):
    groups = {}
    for i, t in enumerate(texts):
        groups.setdefault(re.sub(r"[\x20\x09-\x0D]+", "", t or ""), []).append(i)
    out = {}
    for norm, ids in groups.items():
        keep = min(ids, key=lambda i: (-len(texts[i] or ""), i))
        for i in ids:
            out[i] = (keep, len(ids), i == keep, hashlib.sha256(norm.encode()).hexdigest())
    return out


def brute_print(text, width):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[i:i + width]) for i in range(max(1, len(words) - width + 1))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_components(prints, bits):
    root = list(range(len(prints)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for i, a in enumerate(prints):
        for j in range(i):
            if (a ^ prints[j]).bit_count() <= bits:
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [find(i) for i in range(len(prints))]


def brute_cover(texts, length):
    seen = {}
    for i, t in enumerate(texts):
        for j in range(len(t) - length + 1):
            seen.setdefault(t[j:j + length], []).append((i, j))
    out = [bytearray(len(t)) for t in texts]
    for places in seen.values():
        if len(places) > 1:
            for i, j in places:
                out[i][j:j + length] = b"\1" * length
    return out


def brute_cut(texts, length):
    rows = {}
    for i, (t, c) in enumerate(zip(texts, brute_cover(texts, length))):
        spans = sum(1 for k in range(len(c)) if c[k] and not (k and c[k - 1]))
        left = bytes(b for b, x in zip(t, c) if not x)
        rows[i] = (len(t), sum(c), spans, hashlib.sha256(left).hexdigest(), left)
    return rows


def brute_ngrams(text):
    inside = "".join(c if unicodedata.category(c)[0] in "LM" else " " for c in text.lower())
    out = {}
    for w in inside.split():
        padded = [None, *w, None]
        for n in (1, 2, 3):
            for i in range(len(padded) - n + 1):
                g = tuple(padded[i:i + n])
                if not all(c is None for c in g):
                    out[g] = out.get(g, 0) + 1
    return out


def brute_targets(sizes):
    names = sorted((s for s in sizes if s is not None)) + ([None] if None in sizes else [])
    w = {s: 1 + i % 3 for i, s in enumerate(names)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[s] for s in capped)
        ws = sum(w[s] for s in names if s not in capped)
        t = {s: 3 * sizes[s] if s in capped else left * w[s] / ws for s in names}
        over = {s for s in names if s not in capped and t[s] > 3 * sizes[s]}
        if not over:
            return t
        capped |= over


def brute_identify(train, texts, size):
    """(language, score) of each text, learned from (language, text): the least out-of-place distance."""
    def code(g):
        return sum((0x1FFFFF if c is None else ord(c)) << 21 * (len(g) - 1 - i) for i, c in enumerate(g))

    def profile(counts):
        return sorted(counts, key=lambda c: (-counts[c], c))[:size]

    def counted(text):
        if not any(unicodedata.category(c)[0] == "L" for c in (text or "").lower()):
            return {}
        return {code(g): n for g, n in brute_ngrams(text).items()}
    sums = {}
    for lang, text in train:
        for c, n in counted(text).items():
            sums.setdefault(lang, {})[c] = sums.setdefault(lang, {}).get(c, 0) + n
    ranks = {lang: {c: i for i, c in enumerate(profile(counts))} for lang, counts in sorted(sums.items())}
    for text in texts:
        top = profile(counted(text))
        far = {lang: sum(min(size, abs(r[c] - i)) if c in r else size for i, c in enumerate(top)) for lang, r in ranks.items()}
        if not top or not far:
            yield "und", 0.0
            continue
        best = min(far, key=lambda lang: (far[lang], lang))
        yield best, 1 - far[best] / (size * len(top))


def brute_copies(rows, quality):
    """How often each (doc_id, text, source) is taken, by sorting every source whole."""
    size = [len(re.findall(r"[^\x20\x09-\x0D]+", t or "")) for _, t, _ in rows]
    sums = {}
    for n, (_, _, source) in zip(size, rows):
        sums[source] = sums.get(source, 0) + n
    targets, copies = brute_targets(sums), [0] * len(rows)
    for source, target in targets.items():
        epochs = min(3, int(target // sums[source])) if sums[source] else 1
        keyed = []
        for i, (doc, _, s) in enumerate(rows):
            if s == source:
                u = (int(hashlib.md5(f"mix:{'null' if doc is None else doc}".encode()).hexdigest()[:13], 16) + .5) / 2 ** 52
                keyed.append((-math.log(u) / {1: 2.0, 0: .5}.get(quality.get(doc), 1.0), -2 ** 63 if doc is None else doc, size[i], i))
        before = 0
        for _, _, n, i in sorted(keyed):
            copies[i] = min(3, epochs + (2 * before + n <= 2 * (target - epochs * sums[source])))
            before += n
    return copies
