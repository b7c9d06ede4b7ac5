"""Plain versions of the operators' contracts, for comparison on small tables."""

from __future__ import annotations

import collections
import hashlib
import re
import zlib

import numpy as np

WORDS = re.compile("[^\x20\x09-\x0D]+")


def sha(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def nearest(rows, every=50, k=5):
    """rows: (id, vector), ids unique."""
    kept = [(i, np.floor(256 * np.array(v, float)).astype(np.int64)) for i, v in rows
            if i is not None and v is not None and all(x is not None and np.isfinite(x) for x in v)]
    out = []
    for q, a in kept:
        if q % every == 0:
            scores = sorted((-int(a @ b), i) for i, b in kept if i != q and len(a) == len(b))
            out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scores[:k])]
    return sorted(out)


def fingerprint(text) -> int:
    import xxhash

    words = WORDS.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))
    shingles = [" ".join(words[i:i + 4]) for i in range(max(1, len(words) - 3))] if words else []
    counts = [0] * 64
    for s in shingles:
        h = xxhash.xxh64_intdigest(s.encode(), seed=42)
        for b in range(64):
            counts[b] += h >> b & 1
    return sum(1 << b for b in range(64) if counts[b] * 2 > len(shingles))


def near_copies(rows, limit=4):
    prints = [(i, fingerprint(t)) for i, t in rows]
    parent = list(range(len(prints)))

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    values = np.array([p for _, p in prints], np.uint64)
    for i in range(len(prints)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1:] ^ values[i]) <= limit) + i + 1:
            parent[find(i)] = find(int(j))
    least = {}
    for n, (i, _) in enumerate(prints):
        root = find(n)
        if i is not None and (root not in least or i < least[root]):
            least[root] = i
    return sorted(((i, f"{p:016x}", least.get(find(n))) for n, (i, p) in enumerate(prints)), key=repr)


def repeated_words(rows, window=20):
    """rows: (id, text), ids unique, in any order."""
    seen, out = set(), []
    for i, text in sorted(rows, key=lambda r: r[0]):
        words = WORDS.findall(text or "")
        gone = [False] * len(words)
        for s in range(len(words) - window + 1):
            key = tuple(words[s:s + window])
            if key in seen:
                gone[s:s + window] = [True] * window
            seen.add(key)
        kept = " ".join(w for w, g in zip(words, gone) if not g)
        out.append((i, len(words), sum(gone), sha(kept.encode())))
    return sorted(out)


def repeated_bytes(rows, window=200):
    counts = collections.Counter()
    bodies = [(i, (t or "").encode()) for i, t in rows]
    for _, b in bodies:
        for s in range(len(b) - window + 1):
            counts[hashlib.blake2b(b[s:s + window], digest_size=12).digest()] += 1
    out = []
    for i, b in bodies:
        gone = np.zeros(len(b), bool)
        for s in range(len(b) - window + 1):
            if counts[hashlib.blake2b(b[s:s + window], digest_size=12).digest()] > 1:
                gone[s:s + window] = True
        edges = np.diff(np.concatenate([[False], gone]).astype(int))
        kept = np.frombuffer(b, np.uint8)[~gone].tobytes()
        out.append((i, len(b), int(gone.sum()), int((edges == 1).sum()), sha(kept)))
    return sorted(out, key=repr)


KINDS = [
    ("assign", re.compile("(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.I | re.A),
     lambda m: len(m[2]) >= 12),
    ("access", re.compile("AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 18),
    ("hex", re.compile("[0-9a-f]+"), lambda m: len(m[0]) >= 16),
]


def secrets(rows):
    out = []
    for i, text in rows:
        spans, counts = [], []
        for order, (kind, pattern, good) in enumerate(KINDS):
            found = [m.span() for m in pattern.finditer(text or "") if good(m)]
            counts.append(len(found))
            spans += [(a, order, f"{kind}:{a}:{b}") for a, b in found]
        out.append((i, *counts, sha(",".join(s for *_, s in sorted(spans)).encode())))
    return sorted(out, key=repr)


def pieces(rows, tokenizer, size=2048):
    out = []
    for i, text in rows:
        ids = [*tokenizer.encode(text or "", add_special_tokens=False).ids, 0]
        for p, at in enumerate(range(0, len(ids), size)):
            part = ids[at:at + size]
            out.append((i, p, at, len(part), zlib.crc32(np.array(part, "<u4").tobytes())))
    return sorted(out, key=repr)


def exact(rows):
    body = {n: re.sub("[\x20\x09-\x0D]+", " ", t or "") for n, (_, t) in enumerate(rows)}
    groups = collections.defaultdict(list)
    for n, (i, _) in enumerate(rows):
        groups[body[n]].append(i)
    out = []
    for n, (i, _) in enumerate(rows):
        ids = groups[body[n]]
        keep = min((x for x in ids if x is not None), default=None)
        out.append((i, keep, len(ids), i == keep, sha(body[n].encode())))
    return sorted(out, key=repr)


def coded(rows, encoding):
    out = []
    for i, text in rows:
        ids = encoding.encode_ordinary(text or "")
        out.append((i, len(ids), sha(",".join(map(str, ids)).encode()), sha(encoding.decode_bytes(ids))))
    return sorted(out, key=repr)
