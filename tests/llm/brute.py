"""Plain versions of the operators, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

WORD = re.compile(r"[^\x20\x09-\x0D]+")
BLANKS = " \t\n\x0b\x0c\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def measures(text):
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 8]) for i in range(len(words) - 7)]
    often, hit = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            hit.update(range(i, i + 8))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(hit), len(lines)


def fingerprint(text, width=4):
    from xxhash import xxh64_intdigest

    words = WORD.findall((text or "").translate(LOWER))
    shingles = [" ".join(words[i:i + width]) for i in range(len(words) - width + 1)] or ([" ".join(words)] if words else [])
    hashes = [xxh64_intdigest(s.encode(), 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(prints, radius=4):
    """Fingerprint -> representative, over all pairs."""
    root = {p: p for p in prints}

    def find(p):
        while root[p] != p:
            p = root[p]
        return p
    known = sorted(root)
    for i, a in enumerate(known):
        for b in known[i + 1:]:
            if bin(a ^ b).count("1") <= radius:
                root[find(b)] = find(a)
    return {p: find(p) for p in known}


def near_duplicates(rows, radius=4, width=4):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    own = [(i, fingerprint(t, width)) for i, t in rows]
    root = components({p for _, p in own}, radius)
    least = defaultdict(list)
    for i, p in own:
        if i is not None:
            least[root[p]].append(i)
    return [(i, p, min(least[root[p]], default=None)) for i, p in own]


def key(line):
    return line.strip(BLANKS).translate(LOWER)


def dedup_lines(rows, chars=40, docs=5):
    """(doc_id, text, n_lines, n_dropped) of (doc_id, text) rows."""
    held, keeper = Counter(), {}
    for i, t in rows:
        for k in {key(x) for x in (t or "").split("\n")}:
            if len(k) >= chars:
                held[k] += 1
                if i is not None:
                    keeper[k] = max(i, keeper.get(k, i))
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        stay = [x for x in lines if not (held[key(x)] >= docs and key(x) in keeper and keeper[key(x)] != i)]
        out.append((i, "\n".join(stay), len(lines), len(lines) - len(stay)))
    return out


def sha(text):
    return hashlib.sha256(text.encode()).hexdigest()


def top_k(vectors, queries, k):
    """Ranked (query_id, rank, vec_id, score) of integer vectors [(id, list)]."""
    out = []
    for q, x in queries:
        scored = sorted((-sum(a * b for a, b in zip(x, y)), i) for i, y in vectors if i != q)
        out += [(q, r + 1, i, -s) for r, (s, i) in enumerate(scored[:k])]
    return out
