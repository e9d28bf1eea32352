"""Plain Python versions of what the operators do, for small inputs."""

from __future__ import annotations

import hashlib
import re
from collections import Counter

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def quality(text: str | None) -> tuple[int, int, int, int, int]:
    text = text or ""
    words = WORD.findall(text)
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    often, covered = Counter(windows), set()
    for i, w in enumerate(windows):
        if often[w] > 1:
            covered.update(range(i, i + 5))
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)),
            len(covered))


def shingles(text: str | None) -> set:
    words = WORD.findall((text or "").translate(LOWER))
    return set(zip(words, words[1:])) if len(words) > 1 else {tuple(words)} if words else set()


def near(docs: list[tuple[int, str | None]]) -> dict[int, tuple[int, int, bool]]:
    """n_shingles, component_id, kept by id, from all pairs."""
    sets = {d: shingles(t) for d, t in docs}
    root = {d: d for d in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for i, a in enumerate(ids):
        for b in ids[:i]:
            n = len(sets[a] & sets[b])
            if n and 100 * n >= 80 * (len(sets[a]) + len(sets[b]) - n):
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {d: (len(sets[d]), find(d), find(d) == d) for d in ids}


def repeats(docs: list[tuple[int, str | None]], length: int = 50) -> dict[int, tuple[int, int, str]]:
    """n_words, n_removed, kept_sha256 by id."""
    first, out = {}, {}
    for d, text in sorted(docs):
        words = WORD.findall(text or "")
        gone = set()
        for i in range(len(words) - length + 1):
            if first.setdefault(tuple(words[i:i + length]), d) < d:
                gone.update(range(i, i + length))
        out[d] = (len(words), len(gone), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))
    return out


def license_base(text: str | None, phrases: dict[str, str]) -> tuple:
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = [(i, label) for phrase, label in phrases.items() for p in [phrase.split()]
             for i in range(len(words) - len(p) + 1) if words[i:i + len(p)] == p]
    at = [i for i, _ in found]
    return (len(words), len(at), min(at, default=None), max(at, default=None),
            ",".join(sorted({x for _, x in found})))


def best_pieces(word: bytes, pieces: dict[bytes, tuple[int, float]], unknown: float) -> list[int]:
    """Ids of the best path; bytes of characters without a piece count as ids 3 to 258."""
    best, back = [0.0] + [float("-inf")] * len(word), [None] * (len(word) + 1)
    for i in range(len(word)):
        if (word[i] & 0xC0) == 0x80:
            continue
        width, single = 1 + (word[i] >= 0xC0) + (word[i] >= 0xE0) + (word[i] >= 0xF0), False
        for j in range(i + 1, len(word) + 1):
            if word[i:j] in pieces:
                number, score = pieces[word[i:j]]
                single |= j - i == width
                if best[i] + score > best[j]:
                    best[j], back[j] = best[i] + score, (i, [number])
        if not single and best[i] + unknown > best[i + width]:
            best[i + width], back[i + width] = best[i] + unknown, (i, [3 + b for b in word[i:i + width]])
    out, j = [], len(word)
    while j:
        j, ids = back[j]
        out = ids + out
    return out
