"""Plain versions of the operators, over lists, for small inputs."""

from __future__ import annotations

import hashlib
from collections import Counter, defaultdict
from itertools import combinations

import regex
import xxhash

WORDS = regex.compile(r"[\p{L}\p{N}]+")
LINES = regex.compile(r"[^.!?\n]+[.!?\n ]*|[.!?\n ]+")


def fingerprint(text, width):
    words = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode()).split()
    if not words:
        return 0
    width = min(width, len(words))
    hashes = [xxhash.xxh64_intdigest(b" ".join(words[k : k + width]), 42) for k in range(len(words) - width + 1)]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def groups(nodes, links):
    """Smallest member of each node's group."""
    root = {n: n for n in nodes}

    def find(n):
        while root[n] != n:
            n = root[n]
        return n

    for a, b in links:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    return {n: find(n) for n in nodes}


def simhash_components(docs, width):
    """{id: smallest id of its group} for distinct ids."""
    prints = {i: fingerprint(t, width) for i, t in docs}
    owners = defaultdict(list)
    for i, f in prints.items():
        owners[f].append(i)
    links = [(min(x), y) for x in owners.values() for y in x if y != min(x)]
    links += [(min(owners[a]), min(owners[b])) for a, b in combinations(owners, 2) if (a ^ b).bit_count() <= 2]
    return groups(prints, links), prints


def chunks(text):
    lines = LINES.findall(text or "")
    hashes = [hashlib.md5(x.encode()).hexdigest() for x in lines]
    rolls = [hashlib.md5(((hashes[k - 1] if k else "") + h).encode()).hexdigest() for k, h in enumerate(hashes)]
    out = []
    for k, line in enumerate(lines):
        if k == 0 or (k >= 2 and rolls[k - 1] < rolls[k - 2] and rolls[k - 1] <= rolls[k]):
            out.append([])
        out[-1].append(line)
    return [("".join(x), len(x)) for x in out]


def without_repeated_chunks(docs, least=40):
    """{id: text} for distinct ids in ascending order."""
    seen, out = set(), {}
    for i, text in sorted(docs):
        rest = []
        for chunk, lines in chunks(text):
            if lines > 1 and len(chunk) >= least:
                if chunk in seen:
                    continue
                seen.add(chunk)
            rest.append(chunk)
        out[i] = None if text is None else "".join(rest)
    return out


def shingles(text, width):
    words = WORDS.findall((text or "").lower())
    return [tuple(words[k : k + width]) for k in range(len(words) - width + 1)]


def leaks(docs, items, least=0.8):
    """{(id, item): (similarity, start, words)} of the best windows."""
    out = {}
    for item, text in items:
        width = min(5, len(WORDS.findall((text or "").lower())))
        if not width:
            continue
        own = Counter(shingles(text, width))
        size = own.total()
        for i, body in docs:
            runs = shingles(body, width)
            if not own.keys() & set(runs):
                continue
            for start in range(len(runs) - size + 1):
                shared = (Counter(runs[start : start + size]) & own).total()
                value = shared / (2 * size - shared)
                if value >= least and value > out.get((i, item), (0,))[0]:
                    out[i, item] = (value, start, size + width - 1)
    return out
