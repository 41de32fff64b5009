"""Plain versions of the operators for small tables."""

from __future__ import annotations

import hashlib
import math
import re
import zlib
from collections import Counter, defaultdict

import xxhash

BIG = 1 << 62


def words(text):
    return (text or "").encode().split()


def sha(text):
    return hashlib.sha256(text if isinstance(text, bytes) else text.encode()).hexdigest()


def fingerprint(text):
    found = [w.lower() for w in words(text)]
    if not found:
        return 0
    size = min(3, len(found))
    shingles = [b" ".join(found[i:i + size]) for i in range(len(found) - size + 1)]
    hashes = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def components(rows):
    """(doc_id, fingerprint, component_id) of (doc_id, text) rows."""
    prints = [fingerprint(t) for _, t in rows]
    group = list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3 and group[i] != group[j]:
                old, new = group[i], group[j]
                group = [new if g == old else g for g in group]
    least = defaultdict(list)
    for (i, _), g in zip(rows, group):
        least[g] += [] if i is None else [i]
    return [(i, f"{p:016x}", min(least[g], default=None)) for (i, _), p, g in zip(rows, prints, group)]


def without_repeats(rows, window=13):
    """(doc_id, n_words, n_removed, kept) of (doc_id, text) rows."""
    first = {}
    for i, text in rows:
        found = words(text)
        for k in range(len(found) - window + 1):
            key = tuple(found[k:k + window])
            first[key] = min(first.get(key, BIG), BIG if i is None else i)
    out = []
    for i, text in rows:
        found = words(text)
        gone = [False] * len(found)
        for k in range(len(found) - window + 1):
            if first[tuple(found[k:k + window])] < (BIG if i is None else i):
                gone[k:k + window] = [True] * window
        out.append((i, len(found), sum(gone), b" ".join(w for w, g in zip(found, gone) if not g).decode()))
    return out


def counts(text):
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    found = words(text)
    grams = [tuple(found[i:i + 5]) for i in range(len(found) - 4)]
    often = Counter(grams)
    covered = {k for i, g in enumerate(grams) if often[g] > 1 for k in range(i, i + 5)}
    lines = [x for x in (text or "").split("\n") if x.encode().split()]
    return (len(found), sum(len(w.decode()) for w in found), len(re.findall(r"[#*$%&|<>]", text or "")),
            len(lines) - len(set(lines)), len(covered))


def held_out(doc_id):
    return zlib.crc32(("" if doc_id is None else str(doc_id)).encode()) % 7 == 2


def unigrams(rows):
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score)."""
    low = lambda t: [w.lower() for w in words(t)]
    seen, ends = Counter(), 0
    for i, text in rows:
        if not held_out(i):
            seen.update(low(text))
            ends += 1
    total, kinds = sum(seen.values()) + ends, len(seen) + (ends > 0)
    log = lambda c: math.log10((c + 1) / (total + kinds + 1))
    return [
        (i, held_out(i), len(words(t)) + 1, sum(seen[w] > 0 for w in low(t)) + (ends > 0), total,
         sum(log(seen[w]) for w in low(t)) + log(ends))
        for i, t in rows
    ]


def copies(rows, weights, domain, share, epochs, seed):
    """How often the mix takes each (doc_id, text, lang, source) row."""
    none = lambda x: "(none)" if x is None else x
    leaves, placed = defaultdict(int), defaultdict(lambda: defaultdict(int))
    for i, text, lang, source in rows:
        leaves[domain(source), none(lang), none(source)] += len(words(text))
    supply = defaultdict(int)
    for leaf, n in leaves.items():
        for depth in (1, 2, 3):
            supply[leaf[:depth]] += n * epochs
    given = {(): sum(leaves.values()) * share[0] // share[1]}
    for depth, level in enumerate(("domain", "lang", "source")):
        nodes = {leaf[:depth + 1] for leaf in leaves}
        for parent in {n[:-1] for n in nodes}:
            weight = {n: weights[level].get(n[-1], 1) for n in nodes if n[:-1] == parent}
            waiting = sorted(weight, key=lambda n: (supply[n] / weight[n], n[-1]))
            left, together = given[parent], sum(weight.values())
            while waiting and supply[waiting[0]] * together <= left * weight[waiting[0]]:
                node = waiting.pop(0)
                given[node] = supply[node]
                left, together = left - supply[node], together - weight[node]
            for node in waiting:
                given[node] = left * weight[node] // together
            for node in waiting[:left - sum(given[n] for n in waiting)]:
                given[node] += 1
    whole = {leaf: given[leaf] // n if n else 0 for leaf, n in leaves.items()}
    place = lambda leaf, i: hashlib.md5(f"{seed}:{whole[leaf]}:{'' if i is None else i}".encode()).hexdigest()
    leaf_of = lambda row: (domain(row[3]), none(row[2]), none(row[3]))
    for row in rows:
        placed[leaf_of(row)][place(leaf_of(row), row[0])] += len(words(row[1]))
    inside = defaultdict(set)
    for leaf, tokens in placed.items():
        rest, end = given[leaf] - whole[leaf] * leaves[leaf], 0
        for key in sorted(tokens) if rest else []:
            if end + tokens[key] > rest and end + tokens[key] - rest >= rest - end:
                break
            end += tokens[key]
            inside[leaf].add(key)
            if end > rest:
                break
    return [whole[leaf_of(r)] + (place(leaf_of(r), r[0]) in inside[leaf_of(r)]) for r in rows]
