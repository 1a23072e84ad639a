"""Brute-force versions, by the definitions, in plain Python."""

import re

import xxhash

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def ids_of(rows):
    return [(i if i is not None else 1 << 62) for i, _ in rows]


def covered(symbols, ids, width):
    """Per document a list of flags: covered by a window that also starts in a document with a smaller id."""
    first = {}
    for s, i in zip(symbols, ids):
        for k in range(len(s) - width + 1):
            w = tuple(s[k : k + width])
            first[w] = min(first.get(w, i), i)
    out = []
    for s, i in zip(symbols, ids):
        flags = [False] * len(s)
        for k in range(len(s) - width + 1):
            if first[tuple(s[k : k + width])] < i:
                flags[k : k + width] = [True] * width
        out.append(flags)
    return out


def fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(len(words) - 2)] or ([b" ".join(words)] if words else [])
    count = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s, seed=42)
        for b in range(64):
            count[b] += h >> b & 1
    return sum(1 << b for b in range(64) if 2 * count[b] > len(shingles))


def components(ids, prints):
    parent = list(range(len(ids)))

    def find(a):
        while parent[a] != a:
            a = parent[a]
        return a

    for a in range(len(ids)):
        for b in range(a):
            if bin(prints[a] ^ prints[b]).count("1") <= 3:
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    low = {}
    for k, i in enumerate(ids):
        if i is not None:
            low[find(k)] = min(low.get(find(k), i), i)
    return [low.get(find(k)) for k in range(len(ids))]


def quality(text):
    text = text or ""
    words = WORD.findall(text)
    at, seen, again = {}, set(), 0
    for k in range(len(words) - 7):
        at.setdefault(tuple(words[k : k + 8]), []).append(k)
    repeat = {p for v in at.values() if len(v) > 1 for k in v for p in range(k, k + 8)}
    for line in text.split("\n"):
        if WORD.search(line):
            again += line in seen
            seen.add(line)
    failed = len(words) < 20 or 100 * len(repeat) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), again, len(repeat), failed


def dedup_lines(rows, min_words=8):
    """Kept text, number of removed lines and their runs of each (id, text) row; equal rows are one document.

    A line goes if it lies in a run of at least ``min_words`` words that starts earlier, too.
    """
    seen, out = set(), {}
    for key in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42) - (1 << 64) * (xxhash.xxh64_intdigest((r[1] or "").encode(), seed=42) >> 63))):
        raw = (key[1] or "").split("\n")
        at = [k for k, x in enumerate(raw) if WORD.search(x)]
        size = [len(WORD.findall(raw[k])) for k in at]
        gone = set()
        for p in range(len(at)):
            runs = [tuple(raw[k] for k in at[p:e]) for e in range(p + 1, len(at) + 1)]
            for r in runs:
                if r in seen and sum(size[p : p + len(r)]) >= min_words:
                    gone |= set(range(p, p + len(r)))
            seen.update(runs)
        starts = sorted(p for p in gone if p - 1 not in gone)
        runs = [(p, next(n for n in range(1, len(at) + 2) if p + n not in gone)) for p in starts]
        lines = {at[p] for p in gone}
        out[key] = (key[1] if not gone else "\n".join(x for k, x in enumerate(raw) if k not in lines), len(gone), runs)
    return [out[r] for r in rows]


def overlaps(text, item, window=13, substitutions=3, shortest=8):
    """Token positions of ``text`` that an overlap with ``item`` covers, both as lists of tokens: all alignments."""
    out = set()
    if len(item) < window:
        if len(item) >= shortest:
            for d in range(len(text) - len(item) + 1):
                equal = [d + q for q in range(len(item)) if text[d + q] == item[q]]
                if len(item) - len(equal) <= substitutions * len(item) // window:
                    out |= set(range(equal[0], equal[-1] + 1))
        return out
    for d in range(1 - len(item), len(text)):
        lo, hi = max(0, d), min(len(text), d + len(item))
        same = [text[p] == item[p - d] for p in range(lo, hi)]
        covered = set()
        for k in range(len(same) - window + 1):
            if window - sum(same[k : k + window]) <= substitutions:
                covered |= set(range(k, k + window))
        for p in sorted(covered):  # each stretch from its first to its last equal token
            if p - 1 not in covered:
                stretch = [q for q in range(p, len(same) + 1) if set(range(p, q + 1)) <= covered]
                equal = [q for q in stretch if same[q]]
                out |= set(range(lo + equal[0], lo + equal[-1] + 1))
    return out
