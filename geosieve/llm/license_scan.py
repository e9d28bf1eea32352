"""Finds licence phrases exactly and short licence notices with a bounded number of edits.

A text is lower-cased (A-Z) and cut into words of digits, letters and non-ASCII characters; everything else is a gap.
A notice of L characters may differ by k = L // 12 edits. It is cut into parts of five characters; every edit spoils one,
so all but k parts of any occurrence are intact (pigeonhole), shifted against each other by k at most. One pass finds
all parts, places where enough of them agree are candidates, and the ``regex`` library's bounded-error matching decides
there, with the span and the number of edits.

Where notices overlap, a longer one that covers most of a shorter one replaces it: a non-commercial licence is not also
its freer relation. Short identifiers behind ``SPDX-License-Identifier:`` must be intact. The phrases and their labels
are given (they are the base) and stay whatever the notices say.

Rows are scanned one by one and time grows with a text's length, so very long texts, repeated rows and texts full of
notices need nothing special. A null text has no words; no rows give no rows; only the key and the text are read. The score is 1 for a phrase or an intact notice, less one L-th per edit, 0 without any.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from geosieve.llm.common import as_bytes, small_batches

PHRASES = {
    "gnu general public license": "gpl",
    "apache license": "apache",
    "cc by": "cc-by",
    "mit license": "mit",
}
NOTICES = {
    "licensed under the gnu general public license": "gpl",
    "this program is free software you can redistribute it and or modify it": "gpl",
    "gnu lesser general public license": "lgpl",
    "gnu affero general public license": "agpl",
    "licensed under the apache license version 2 0": "apache",
    "released under the mit license": "mit",
    "permission is hereby granted free of charge to any person obtaining a copy": "mit",
    "creative commons attribution": "cc-by",
    "creative commons attribution sharealike": "cc-by-sa",
    "creative commons attribution noncommercial": "cc-by-nc",
    "creative commons attribution noderivatives": "cc-by-nd",
    "creative commons attribution noncommercial sharealike": "cc-by-nc-sa",
    "creative commons attribution noncommercial noderivatives": "cc-by-nc-nd",
    "redistribution and use in source and binary forms": "bsd",
    "mozilla public license": "mpl",
    "permission to use copy modify and or distribute this software": "isc",
    "this is free and unencumbered software released into the public domain": "unlicense",
}
SPDX = {
    "mit": "mit", "isc": "isc", "unlicense": "unlicense", "apache 2 0": "apache", "mpl 2 0": "mpl",
    "bsd 2 clause": "bsd", "bsd 3 clause": "bsd", "gpl 2 0": "gpl", "gpl 3 0": "gpl", "lgpl 2 1": "lgpl",
    "lgpl 3 0": "lgpl", "agpl 3 0": "agpl", "cc0 1 0": "cc0", "cc by 4 0": "cc-by", "cc by sa 4 0": "cc-by-sa",
    "cc by nc 4 0": "cc-by-nc", "cc by nd 4 0": "cc-by-nd", "cc by nc sa 4 0": "cc-by-nc-sa",
    "cc by nc nd 4 0": "cc-by-nc-nd",
}
SPDX_TAG = "spdx license identifier"
CHARS_PER_EDIT = 12
PART = 5

_WORD_BYTES = b"0123456789abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256))
_NORMAL = bytes(b if b in _WORD_BYTES else 0x20 for b in bytes(range(256)).lower())


def normal(text: bytes) -> str:
    """The words, joined by single spaces."""
    return b" ".join(text.translate(_NORMAL).split()).decode()


def edits_of(notice: str) -> int:
    return len(notice) // CHARS_PER_EDIT


def parts_of(notice: str) -> int:
    return max(edits_of(notice) + 1, len(notice) // PART)


@lru_cache(maxsize=4)
def _searcher(notices: tuple[tuple[str, str], ...]):
    """The automaton of all parts (each with its notices and its place in them) and the notices' patterns."""
    import ahocorasick
    import regex

    parts: dict[str, list[tuple[int, int]]] = {}
    patterns = []
    for i, (notice, _) in enumerate(notices):
        k = edits_of(notice)
        n = parts_of(notice)
        cuts = [len(notice) * j // n for j in range(n + 1)]
        for a, b in zip(cuts, cuts[1:]):
            parts.setdefault(notice[a:b], []).append((i, a))
        patterns.append(regex.compile(f"(?b)(?:{regex.escape(notice)}){{e<={k}}}"))
    automaton = ahocorasick.Automaton()
    for part, where in parts.items():
        automaton.add_word(part, (len(part), where))
    automaton.make_automaton()
    return automaton, patterns


def find_notices(text: str, notices: tuple[tuple[str, str], ...]) -> list[tuple[int, int, int, int]]:
    """(notice, begin, end, edits) of each occurrence in a normal text, without repeats."""
    automaton, patterns = _searcher(notices)
    seeds: list[list[tuple[int, int]]] = [[] for _ in notices]  # by notice: where it would begin, and the part found
    for end, (size, where) in automaton.iter(text):
        for i, offset in where:
            seeds[i].append((end + 1 - size - offset, offset))
    found, places = set(), []
    for i, own in enumerate(seeds):
        own.sort()
        need, k, begin, seen = parts_of(notices[i][0]) - edits_of(notices[i][0]), edits_of(notices[i][0]), 0, {}
        for at, offset in own:
            seen[offset] = seen.get(offset, 0) + 1
            while own[begin][0] < at - k:
                gone = own[begin][1]
                seen[gone] -= 1
                if not seen[gone]:
                    del seen[gone]
                begin += 1
            if len(seen) >= need:
                places.append((i, own[begin][0]))
    last: dict[int, int] = {}  # per notice, where its last occurrence ends
    for i, at in dict.fromkeys(places):
        notice, k = notices[i][0], edits_of(notices[i][0])
        if at >= 0 and text.startswith(notice, at):
            found.add((i, at, at + len(notice), 0))
            last[i] = at + len(notice)
        elif at >= last.get(i, 0) - k:
            begin = max(0, at - k, last.get(i, 0))
            m = patterns[i].search(text, begin, min(len(text), at + len(notice) + 2 * k))
            if m:
                found.add((i, m.start(), m.end(), sum(m.fuzzy_counts)))
                last[i] = m.end()
    return sorted(found)


def _overlapping(phrase: str, text: str) -> Iterator[int]:
    """All places of a phrase between blanks in a padded text, as places in the text without padding."""
    at = text.find(phrase)
    while at >= 0:
        yield at
        at = text.find(phrase, at + 1)


def longest(found: list[tuple[int, int, int, int]]) -> list[tuple[int, int, int, int]]:
    """Without those of which more than half lies in a longer one; equal spans: the fewer edits, then the first notice."""
    order = sorted(found, key=lambda f: (f[1], f[2]))
    near: list[tuple[int, int, int, int]] = []  # spans that may reach one that begins later
    beaten = set()
    for f in order:
        near = [g for g in near if g[2] > f[1]]
        for g in near:
            long, short = sorted((f, g), key=lambda x: (x[1] - x[2], x[3], x[0]))
            if 2 * (min(f[2], g[2]) - max(f[1], g[1])) > short[2] - short[1]:
                beaten.add(short)
        near.append(f)
    return [f for f in found if f not in beaten]


def scan_licenses(docs: DataFrame, phrases: dict[str, str] | None = None, notices: dict[str, str] | None = None,
                  key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per row of ``docs``: the key, n_words, n_base, first_word, last_word, base_labels, labels, score, spans.

    ``spans``: label, first and last word, and edits of each notice found.
    """
    small_batches(docs.sparkSession)
    patterns = [(f" {phrase} ", label) for phrase, label in (PHRASES if phrases is None else phrases).items()]
    notices = tuple((NOTICES if notices is None else notices).items())
    names = "|".join(sorted(SPDX, key=len, reverse=True))
    tag = re.compile(f"(?<= ){SPDX_TAG} ({names}) ")
    rows = docs.select(F.col(key), F.col(text).alias("_text"))
    kind = rows.schema[0].dataType
    span = pa.struct([("label", pa.string()), ("first_word", pa.int64()), ("last_word", pa.int64()),
                      ("edits", pa.int32())])
    fields = [(key, to_arrow_type(kind)), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()),
              ("last_word", pa.int64()), ("base_labels", pa.string()), ("labels", pa.string()), ("score", pa.float64()),
              ("spans", pa.list_(span))]

    def scan(k, raw: bytes) -> tuple:
        words = normal(raw)
        padded = f" {words} "
        hits = [(m, label) for pattern, label in patterns for m in _overlapping(pattern, padded)]
        found = longest(find_notices(words, notices))
        tags = list(tag.finditer(padded)) if SPDX_TAG in words else []
        blanks = np.flatnonzero(np.frombuffer(words.encode("utf-32-le"), np.uint32) == 32) if hits or found or tags else None

        def word_at(place: int) -> int:
            return int(np.searchsorted(blanks, place))

        starts, base = [word_at(at) for at, _ in hits], {label for _, label in hits}
        spans, labels, score = [], set(base), float(bool(base or tags))
        for i, begin, end, edits in found:
            notice, label = notices[i]
            spans.append({"label": label, "first_word": word_at(begin), "last_word": word_at(end - 1), "edits": edits})
            score = max(score, 1 - edits / len(notice))
        spans += [{"label": SPDX[m[1]], "first_word": word_at(m.start(0)), "last_word": word_at(m.end(0) - 2), "edits": 0}
                  for m in tags]
        labels.update(x["label"] for x in spans)
        spans.sort(key=lambda x: (x["first_word"], x["last_word"], x["label"]))
        return (k, words.count(" ") + 1 if words else 0, len(starts), min(starts, default=None),
                max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score, spans)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [scan(k, t) for k, t in zip(batch.column(0).to_pylist(), as_bytes(batch.column(1)))]
            columns = zip(*out) if out else [[]] * len(fields)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, (_, t) in zip(columns, fields)],
                                             names=[n for n, _ in fields])

    return rows.mapInArrow(run, (
        f"`{key}` {kind.simpleString()}, n_words long, n_base long, first_word long, last_word long, "
        "base_labels string, labels string, score double, "
        "spans array<struct<label: string, first_word: long, last_word: long, edits: int>>"))
