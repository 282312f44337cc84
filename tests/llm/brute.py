"""Plain Python versions of the operators, for small tables."""

import collections
import hashlib
import re


def lower(s):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)


def space_words(s):
    return re.findall(r"[^\x20\x09-\x0D]+", s or "")


def alnum_words(s):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(s or ""))


def shingles(s, n):
    w = space_words(lower(s or ""))
    k = min(n, len(w))
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set()


def classes(rows, n, percent):
    """doc_id -> (size, smallest id of the class)."""
    sets = collections.defaultdict(set)
    for i, t in rows:
        sets[i] |= shingles(t, n)
    parent = {i: i for i in sets}

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    ids = sorted(sets)
    for a in ids:
        for b in ids:
            if a < b and sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b]):
                x, y = find(a), find(b)
                parent[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def lines_of(text):
    """(words, start, end) of the lines with words."""
    out, at = [], 0
    for line in (text or "").split("\n"):
        w = tuple(re.findall(r"[^\x20\x09-\x0D]+", line))
        if w:
            out.append((w, at, at + len(line)))
        at += len(line) + 1
    return out


def repeated_runs(rows, min_words):
    """doc_id -> line numbers inside a run of enough words that has an earlier copy."""
    first = {}
    docs = {i: lines_of(t) for i, t in rows if i is not None}
    for i in sorted(docs):
        lines = docs[i]
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                first.setdefault(tuple(x[0] for x in lines[s:e]), (i, s))
    out = {}
    for i, lines in docs.items():
        hit = set()
        for s in range(len(lines)):
            for e in range(s + 1, len(lines) + 1):
                if sum(len(x[0]) for x in lines[s:e]) >= min_words and first[tuple(x[0] for x in lines[s:e])] < (i, s):
                    hit |= set(range(s, e))
        if hit:
            out[i] = hit
    return out


def windows(items):
    out = collections.defaultdict(set)
    for i, t in items:
        w = alnum_words(t)
        for k in range(max(1, len(w) - 12) if w else 0):
            out[tuple(w[k : k + 13])].add(i)
    return out


def contamination(text, found):
    """(n_words, n_hit, items, contaminated)."""
    w = alnum_words(text)
    hit, items = set(), set()
    for n in {len(x) for x in found}:
        for k in range(len(w) - n + 1):
            owners = found.get(tuple(w[k : k + n]))
            if owners:
                hit |= set(range(k, k + n))
                items |= owners
    return len(w), hit, items, bool(hit) and 20 * len(hit) >= len(w)


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def codec():
    from bidlake.llm import piece_codec, queries

    with open(queries.vocabulary(queries.MODEL), "rb") as f:
        return piece_codec.PieceCodec(f.read())
