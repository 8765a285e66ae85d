"""Plain-Python versions of the operators' contracts, for small inputs."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import xxhash


def lower_ascii(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text)


def contamination(docs, items, ngram=10):
    """docs, items: (id, text). Rows (id, n_words, n_hit, n_items, items_sha256, contaminated)."""
    pattern = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
    windows = defaultdict(set)
    for item, text in items:
        words = pattern.findall(lower_ascii(text or ""))
        if words and item is not None:
            n = min(ngram, len(words))
            for k in range(len(words) - n + 1):
                windows[tuple(words[k : k + n])].add(str(item))
    sizes = sorted({len(w) for w in windows})
    out = []
    for doc, text in docs:
        words, hit, found = pattern.findall(lower_ascii(text or "")), set(), set()
        for n in sizes:
            for k in range(len(words) - n + 1):
                names = windows.get(tuple(words[k : k + n]))
                if names:
                    hit.update(range(k, k + n))
                    found |= names
        digest = hashlib.sha256(",".join(sorted(found)).encode()).hexdigest()
        out.append((doc, len(words), len(hit), len(found), digest, bool(hit)))
    return out


def simhash(text, seed=42):
    words = re.findall("[^\x20\x09-\x0d]+", lower_ascii(text or ""))
    if not words:
        return 0
    n = min(4, len(words))
    hashes = [xxhash.xxh64_intdigest(" ".join(words[k : k + n]).encode(), seed) for k in range(len(words) - n + 1)]
    return sum(1 << b for b in range(64) if sum(h >> b & 1 for h in hashes) * 2 > len(hashes))


def components(ids, prints, radius=4):
    values = np.array(prints, np.uint64)
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in np.flatnonzero(np.bitwise_count(values[i + 1 :] ^ values[i]) <= radius):
            parent[root(i)] = root(i + 1 + int(j))
    low = {}
    for i, x in enumerate(ids):
        r = root(i)
        low[r] = min(low.get(r, x), x)
    return {x: low[root(i)] for i, x in enumerate(ids)}


def repeats(texts, width=200):
    """(n_bytes, n_removed, n_spans, kept_sha256) of each text, in order."""
    raw = [(t or "").encode() for t in texts]
    seen = Counter(r[p : p + width] for r in raw for p in range(len(r) - width + 1))
    out = []
    for r in raw:
        gone = np.zeros(len(r), bool)
        for p in range(len(r) - width + 1):
            if seen[r[p : p + width]] > 1:
                gone[p : p + width] = True
        edges = np.diff(np.concatenate([[0], gone.astype(np.int8)]))
        kept = np.frombuffer(r, np.uint8)[~gone].tobytes()
        out.append((len(r), int(gone.sum()), int((edges == 1).sum()), hashlib.sha256(kept).hexdigest()))
    return out


def base_statistics(text):
    """(n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words)."""
    text = text or ""
    words = re.findall("[^\x20\x09-\x0d]+", text)
    lines = [x for x in text.split("\n") if re.search("[^\x20\x09-\x0d]", x)]
    windows = Counter(tuple(words[k : k + 3]) for k in range(len(words) - 2))
    covered = {k + d for k in range(len(words) - 2) if windows[tuple(words[k : k + 3])] > 1 for d in range(3)}
    return (
        len(words),
        sum(map(len, words)),
        len(re.findall("[#*$%&|<>]", text)),
        len(lines) - len(set(lines)),
        len(covered),
    )


def shards(rows, n=24):
    """rows: (id, text). {id: (size, crc, shard, slot)}."""
    rows = sorted((i, len((t or "").encode()) + 8, zlib.crc32((t or "").encode())) for i, t in rows)
    total, before, out, seen = sum(r[1] for r in rows), 0, {}, Counter()
    for i, size, crc in rows:
        shard = min(n - 1, (2 * before + size) * n // (2 * total))
        out[i] = (size, crc, shard, seen[shard])
        seen[shard] += 1
        before += size
    return out


def judge(url, rules):
    """(host, path, rule, verdict) with the default allow."""
    host = path = ""
    if url and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match("[^/?#]*", rest)[0]
        path = re.match("[^?#]*", rest[len(host) :])[0]
        host = lower_ascii(host)
    best = None
    for verdict, rule in rules:
        own, _, tail = rule.partition("/")
        if (host == own or host.endswith("." + own)) and path.startswith("/" + tail) and (best is None or len(rule) > len(best[1])):
            best = (verdict, rule)
    return (host, path, best[1] if best else None, best[0] if best else "allow")


def word_shingles(text):
    w = (text or "").lower().split()
    return {tuple(w[k : k + 5]) for k in range(max(1, len(w) - 4))} if w else set()


def near_survivors(rows):
    """Smallest key of each group that a similarity of 0.8 between sets of 5-word shingles links, by comparing all pairs."""
    sets, root = [word_shingles(t) for _, t in rows], list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            common, either = len(sets[i] & sets[j]), len(sets[i] | sets[j])
            if sets[i] == sets[j] or 5 * common >= 4 * either:
                a, b = find(i), find(j)
                root[max(a, b)] = min(a, b)
    groups = {}
    for i, (k, _) in enumerate(rows):
        groups.setdefault(find(i), []).append(k)
    return sorted(min(g) for g in groups.values())
