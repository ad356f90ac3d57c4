"""Plain single-machine versions of the operators' contracts."""

import hashlib
import re
import zlib

import numpy as np
import xxhash

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORDS.findall(text or "")


def repeated_bytes(docs, width=100):
    """{doc_id: (n_bytes, n_removed, n_spans, sha)}; docs: [(doc_id, text)]."""
    seen, out = set(), {}
    for doc_id, text in sorted(docs, key=lambda d: d[0]):
        b = (text or "").encode()
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - width + 1):
            w = b[i : i + width]
            if w in seen:
                gone[i : i + width] = True
            else:
                seen.add(w)
        runs = int(np.sum(gone & ~np.concatenate([[False], gone[:-1]]))) if len(b) else 0
        kept = bytes(np.frombuffer(b, np.uint8)[~gone])
        out[doc_id] = (len(b), int(gone.sum()), runs, hashlib.sha256(kept).hexdigest())
    return out


def repeated_windows(docs, width=35):
    count, out = {}, {}
    for _, text in docs:
        w = words(text)
        for i in range(len(w) - width + 1):
            k = tuple(w[i : i + width])
            count[k] = count.get(k, 0) + 1
    for doc_id, text in docs:
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - width + 1):
            if count[tuple(w[i : i + width])] > 1:
                gone[i : i + width] = [True] * width
        kept = " ".join(x for x, g in zip(w, gone, strict=True) if not g)
        out[doc_id] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def simhash(text):
    w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    grams = [" ".join(w[i : i + 3]) for i in range(max(1, len(w) - 2))] if w else []
    bits = [0] * 64
    for g in grams:
        h = xxhash.xxh64_intdigest(g.encode(), 42)
        for k in range(64):
            bits[k] += h >> k & 1
    return sum(1 << k for k in range(64) if 2 * bits[k] > len(grams))


def components(prints, most=3):
    """{doc_id: (hex, smallest doc_id reachable)}; prints: [(doc_id, fingerprint)]."""
    parent = {}

    def find(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    distinct = sorted({f for _, f in prints})
    parent = {f: f for f in distinct}
    a = np.array(distinct, np.uint64)
    for i, f in enumerate(distinct):
        near = np.flatnonzero(np.bitwise_count(a[i + 1 :] ^ np.uint64(f)) <= most)
        for j in near:
            parent[find(distinct[i + 1 + j])] = find(f)
    least = {}
    for d, f in prints:
        r = find(f)
        least[r] = min(least.get(r, d), d)
    return {d: (f"{f:016x}", least[find(f)]) for d, f in prints}


def near_dedup(docs, width=5, least=0.8):
    """The smallest doc_id of each component of texts whose shingle sets have a Jaccard similarity of least; docs: [(doc_id, text)]."""
    docs = sorted(docs)
    sets = []
    for _, text in docs:
        w = words(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
        sets.append({tuple(w[i : i + width]) for i in range(max(1, len(w) - width + 1))})
    label = list(range(len(docs)))
    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if both / (len(a) + len(sets[j]) - both) >= least and label[i] != label[j]:
                old, new = max(label[i], label[j]), min(label[i], label[j])
                label = [new if x == old else x for x in label]
    return {docs[i][0] for i in set(label)}


def signals(text):
    text = text or ""
    w = words(text)
    lines = [x for x in text.split("\n") if words(x)]
    grams = {}
    for i in range(len(w) - 4):
        grams.setdefault(tuple(w[i : i + 5]), []).append(i)
    hit = {i + k for at in grams.values() if len(at) > 1 for i in at for k in range(5)}
    failed = len(w) < 10 or 100 * len(hit) > 20 * len(w)
    return len(w), sum(map(len, w)), sum(text.count(c) for c in "#*$%&|<>"), len(lines) - len(set(lines)), len(hit), failed


def topk(vectors, k=20, scale=64):
    """[(query, rank, vec_id, score)]; vectors: [(vec_id, list)]."""
    fine = [(i, np.floor(scale * np.array(v, float)).astype(np.int64)) for i, v in vectors if v is not None and all(x is not None and np.isfinite(x) for x in v)]
    ids = np.array([i for i, _ in fine])
    m = np.array([v for _, v in fine])
    out = []
    for i, v in fine:
        if i % 20 == 0:
            s = m @ v
            order = [j for j in np.lexsort((ids, -s)) if ids[j] != i][:k]
            out += [(int(i), r + 1, int(ids[j]), int(s[j])) for r, j in enumerate(order)]
    return sorted(out)


def targets(sizes):
    """{source: target}; sizes: {source: words}."""
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: 1 + i % 3 for i, s in enumerate(order)}
    goal, capped = sum(sizes.values()), set()
    while True:
        rest = goal - sum(3 * sizes[s] for s in capped)
        total = sum(weight[s] for s in order if s not in capped)
        out = {s: 3.0 * sizes[s] if s in capped else rest * weight[s] / total for s in order}
        over = {s for s in order if s not in capped and out[s] > 3 * sizes[s]}
        if not over:
            return out
        capped |= over


def crc(ids):
    return zlib.crc32(np.array(ids, "<u4").tobytes())
