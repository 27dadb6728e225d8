"""Plain statements of what the operators compute, for small tables."""

from __future__ import annotations

import hashlib
import re
from collections import Counter, defaultdict

import numpy as np

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def words(text):
    return WORD.findall(text or "")


def lower(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def roots(ids, links):
    up = {i: i for i in ids}

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    for a, b in links:
        a, b = find(a), find(b)
        up[max(a, b)] = min(a, b)
    return {i: find(i) for i in ids}


def embeddings(rows, least=0.9):
    """{id: (n_links, component, kept)} of (id, vector) rows with ids of their own."""
    sound = {i: np.asarray(v, float) for i, v in rows if i is not None and v is not None and len(v) and None not in list(v)}
    sound = {i: v / np.linalg.norm(v) for i, v in sound.items() if np.isfinite(v).all() and np.linalg.norm(v) > 0}
    ids = sorted(sound)
    links = [(a, b) for n, a in enumerate(ids) for b in ids[n + 1 :] if len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] >= least]
    count = Counter(i for link in links for i in link)
    root = roots([i for i, _ in rows if i is not None], links)
    return {i: (count[i], root.get(i), i is not None and root[i] == i) for i, _ in rows}


def shingles(text, width):
    own = words(lower(text))
    if not own:
        return set()
    return {tuple(own[k : k + width]) for k in range(max(1, len(own) - width + 1))}


def shingle_join(rows, width, num, den):
    """{id: (n_shingles, component)} of (id, text) rows with ids of their own."""
    sets = {i: shingles(t, width) for i, t in rows}
    where = defaultdict(set)
    for i, own in sets.items():
        for s in own:
            where[s].add(i)
    links = []
    for i, own in sets.items():
        common = Counter(j for s in own for j in where[s] if j < i)
        links += [(i, j) for j, n in common.items() if den * n >= num * (len(own) + len(sets[j]) - n)]
    root = roots(sets, links)
    return {i: (len(own), root[i]) for i, own in sets.items()}


def quality_counts(text):
    own = words(text)
    lines = [x for x in (text or "").split("\n") if words(x)]
    windows = Counter(zip(own, own[1:], own[2:]))
    covered = {k + d for k in range(len(own) - 2) if windows[tuple(own[k : k + 3])] > 1 for d in range(3)}
    failed = len(own) < 50 or 100 * len(covered) > 50 * len(own)
    return len(own), sum(map(len, own)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered), failed


def repeated_bytes(rows, size):
    """{id: (n_bytes, n_removed, n_spans, sha)}"""
    data = {i: (t or "").encode() for i, t in rows}
    seen = Counter(b[k : k + size] for b in data.values() for k in range(len(b) - size + 1))
    out = {}
    for i, b in data.items():
        gone = bytearray(len(b))
        for k in range(len(b) - size + 1):
            if seen[b[k : k + size]] > 1:
                gone[k : k + size] = b"\1" * size
        spans = len(re.findall(b"\1+", bytes(gone)))
        kept = bytes(x for x, g in zip(b, gone) if not g)
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(kept).hexdigest())
    return out


def repeated_windows(rows, size):
    """{id: (n_words, n_removed, sha)}"""
    own = {i: words(t) for i, t in rows}
    first: dict = {}
    out = {}
    for i in sorted(own):
        w = own[i]
        gone = [False] * len(w)
        for k in range(len(w) - size + 1):
            window = tuple(w[k : k + size])
            if window in first:
                gone[k : k + size] = [True] * size
            else:
                first[window] = (i, k)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        out[i] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    return out


def packed(rows, encode, end_id, size, pieces):
    """Check pieces (id, start, length, crc, doc_tokens, sequence, offset); returns the
    padding and the number of ids."""
    import zlib

    ids = {i: encode(t or "") + [end_id] for i, t in rows}
    by_doc, by_seq = defaultdict(list), defaultdict(list)
    for i, start, length, crc, n, seq, offset in pieces:
        assert n == len(ids[i]) and length > 0
        assert crc == zlib.crc32(np.asarray(ids[i][start : start + length], "<u4").tobytes())
        by_doc[i].append((start, length))
        by_seq[seq].append((offset, length))
    assert set(by_doc) == set(ids)
    for i, parts in by_doc.items():
        at = 0
        for start, length in sorted(parts):
            assert start == at
            at += length
        assert at == len(ids[i])
    padding = 0
    for parts in by_seq.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= size
        padding += 0 if at & (at - 1) == 0 else size - at
    return padding, sum(map(len, ids.values()))


def similar_lines(rows, num, den, least):
    """{id: [numbers of lines that go]} of (id, text) rows with ids of their own."""
    lines = [(i, k, frozenset(words(x))) for i, t in sorted(rows, key=lambda r: r[0]) if t is not None for k, x in enumerate(t.split("\n"))]
    where, sizes, out, seen = defaultdict(list), {}, defaultdict(list), {}
    for i, k, own in lines:
        if len(own) < least:
            continue
        if own not in seen:
            common = Counter(c for w in own for c in where[w])
            seen[own] = None if not any(den * n >= num * (len(own) + sizes[c] - n) for c, n in common.items()) else True
            first = len(sizes)
            sizes[first] = len(own)
            for w in own:
                where[w].append(first)
            if seen[own]:
                out[i].append(k)
        else:
            out[i].append(k)
    return dict(out)
