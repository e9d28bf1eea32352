"""Document fingerprints by locally consistent parsing.

A text's bytes are cut into phrases by deterministic coin tossing, phrases get names (hashes), the names are cut into
phrases again, and so on until one name is left. Where a phrase ends depends on a few neighbours only, so equal
substrings get the same phrases inside, wherever they stand. The fingerprint holds the last name and, of a lower
level, the smallest phrase names; likeness is the share of phrases two texts have in common, estimated from those.

A null text is an empty one. Very long texts are parsed whole, in memory that grows with one text. Repeated rows are
documents of their own; rows of equal or null id follow each other in any order. No rows give no rows, and columns but the
key and the text are not read. Equal texts have equal fingerprints; a fingerprint is like itself with 1, and an empty
text is unlike all others (0).
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from geosieve.llm.common import as_bytes, mix, slices, small_batches, span_hashes, span_sums

LEVEL = 3  # phrases of about 20 bytes
KEPT = 64  # names kept of a level
ENOUGH = 16  # with fewer names than this, the lower levels are kept too

_LOWEST_BIT = np.array([0] + [(x & -x).bit_length() - 1 for x in range(1, 256)], np.uint8)
_FIRST_ID = -(1 << 63)


def _toss(symbols: np.ndarray, first: np.ndarray) -> np.ndarray:
    """A round of deterministic coin tossing: where each symbol differs first from the one before it, and its bit."""
    differ = symbols.copy()
    differ[1:] ^= symbols[:-1]
    if symbols.dtype == np.uint8:
        place = _LOWEST_BIT[differ]
    else:
        lowest = differ & (~differ + np.uint64(1))
        place = ((lowest.astype(np.float64).view(np.uint64) >> np.uint64(52)) - np.uint64(1023)) & np.uint64(63)
    labels = (place * 2 + ((symbols >> place) & symbols.dtype.type(1))).astype(np.uint8)
    labels[first] = (symbols[first] & symbols.dtype.type(1)).astype(np.uint8)
    return labels


def _phrases(symbols: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Names of the phrases, and the place of each one's first symbol. ``first``: where texts begin."""
    begins = first.copy()
    begins[1:] |= symbols[1:] != symbols[:-1]
    at = np.flatnonzero(begins)  # runs of one symbol count as one
    run, head = symbols[at], first[at]
    length = np.diff(at, append=len(symbols)).astype(np.uint64)
    labels = run
    for _ in range(3 if run.dtype == np.uint8 else 4):  # down to six labels
        labels = _toss(labels, head)
    higher = np.empty(len(run), bool)
    higher[0] = True
    higher[1:] = labels[1:] > labels[:-1]
    falls = np.zeros(len(run), bool)
    falls[:-1] = (labels[:-1] > labels[1:]) & ~head[1:]
    begin = np.flatnonzero(head | (higher & falls))
    sums = span_sums(mix(run.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) + length))
    return span_hashes(sums, begin, np.append(begin[1:], len(run))), at[begin]


def _smallest(names: np.ndarray, owner: np.ndarray, n: int, wanted: np.ndarray) -> list[list[int] | None]:
    """For each wanted text the smallest distinct names, shortened to 32 bits."""
    own = wanted[owner]
    short, owner = (names[own] >> np.uint64(32)).astype(np.int64), owner[own]
    code = np.unique(owner.astype(np.int64) << 32 | short)
    bounds = np.searchsorted(code, np.arange(n + 1, dtype=np.int64) << 32)
    low = code & 0xFFFFFFFF
    return [low[bounds[i]:min(bounds[i] + KEPT, bounds[i + 1])].tolist() if wanted[i] else None for i in range(n)]


class Fingerprint:
    """The last name and, by level, the smallest names (None: not kept)."""

    __slots__ = ("levels", "name")

    def __init__(self, name: int, levels: list[list[int] | None]):
        self.name, self.levels = name, levels

    def __str__(self) -> str:
        kept = ("" if x is None else "".join(f"{y:08x}" for y in x) for x in self.levels)
        return f"{self.name:016x}" + "".join(f".{x}" for x in kept)

    @classmethod
    def read(cls, text: str) -> Fingerprint:
        name, *levels = text.split(".")
        return cls(int(name, 16), [[int(x[i:i + 8], 16) for i in range(0, len(x), 8)] or None for x in levels])


def likeness(a: Fingerprint, b: Fingerprint) -> float:
    """Share of their phrases that both texts have, of the highest level with enough of them."""
    if a.name == b.name:
        return 1.0
    both = [(x, y) for x, y in zip(a.levels, b.levels) if x and y]
    x, y = next((p for p in both if min(map(len, p)) >= ENOUGH), both[-1] if both else ([], []))
    if not x:
        return 0.0
    # beyond the last kept name of either, names are unknown
    last = min([p[-1] for p in (x, y) if len(p) >= KEPT], default=1 << 32)
    x, y = {p for p in x if p <= last}, {p for p in y if p <= last}
    return 2 * len(x & y) / max(1, len(x) + len(y))


def parse(texts: list[bytes]) -> list[Fingerprint]:
    """Fingerprints of the texts, all parsed together level by level."""
    n = len(texts)
    names, level_names = np.zeros(n, np.uint64), []
    size = np.array([len(x) for x in texts])
    symbols = np.frombuffer(b"".join(texts), np.uint8)
    owner = np.repeat(np.arange(n), size)
    while len(symbols):
        first = np.empty(len(owner), bool)
        first[0] = True
        first[1:] = owner[1:] != owner[:-1]
        symbols, at = _phrases(symbols, first)
        owner = owner[at]
        if len(level_names) < LEVEL:
            level_names.append((symbols, owner))
        alone = np.bincount(owner, minlength=n)[owner] == 1
        names[owner[alone]] = symbols[alone]
        symbols, owner = symbols[~alone], owner[~alone]
    levels, wanted = [], np.ones(n, bool)
    for i in range(LEVEL - 1, -1, -1):
        found = _smallest(*level_names[i], n, wanted) if i < len(level_names) else [None] * n
        levels.append(found)
        if i == LEVEL - 1:
            wanted = np.array([x is None or len(x) < ENOUGH for x in found], bool)
    return [Fingerprint(int(names[i]), [x[i] for x in levels]) for i in range(n)]


def fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key and the ``fingerprint`` of each row, without a shuffle."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = as_bytes(batch.column(1))
            out = [str(f) for part in slices(texts) for f in parse(texts[part])]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(out, pa.string())], names=[key, "fingerprint"])

    return rows.mapInArrow(run, f"`{key}` {rows.schema[0].dataType.simpleString()}, fingerprint string")


def in_order(docs: DataFrame, key: str = "doc_id", text: str = "text", buckets: int | None = None) -> DataFrame:
    """Rows (_bucket, _guest, _at, _text) dealt out by ranges of an integer key and sorted inside each partition.

    The first row of the next range (after the last: of the first) is added to each range as a guest, so every row's
    successor follows it. Ranges are bounded by keys of the data, so only those bounds reach the driver.
    """
    spark = docs.sparkSession
    buckets = buckets or max(1024, 8 * int(spark.conf.get("spark.sql.shuffle.partitions")))
    at = F.coalesce(F.col(key).cast("long"), F.lit(_FIRST_ID))
    quantiles = F.percentile_approx(at, [i / buckets for i in range(1, buckets)], F.lit(10 * buckets))
    least, rest = docs.agg(F.min(at), quantiles).first()
    bounds = np.array(sorted({_FIRST_ID if least is None else least, *(rest or [])}), np.int64)

    @F.pandas_udf("array<int>")
    def ranges_of(ids: pd.Series) -> pd.Series:
        ids = ids.to_numpy(np.int64)
        own = np.searchsorted(bounds, ids, "right") - 1
        heads = bounds[own] == ids
        return pd.Series([[int(b), int((b - 1) % len(bounds))] if h else [int(b)] for b, h in zip(own, heads)])

    rows = docs.select(at.alias("_at"), F.col(key).alias("_key"), F.col(text).alias("_text"))
    rows = rows.select("_at", "_key", "_text", F.posexplode(ranges_of("_at")).alias("_guest", "_bucket"))
    return (rows.repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "_bucket")
            .sortWithinPartitions("_bucket", "_guest", "_at", "_text")
            .select("_guest", "_key", "_text"))


EDITED = ("n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, "
          "near_next double")


def edited_fingerprints(docs: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Fingerprints of each text and of the text whose second half the next document's beginning replaces.

    Next is by ascending key, null first, rows with one key by text; after the last comes the first.
    """
    small_batches(docs.sparkSession)
    rows = in_order(docs, key, text)
    kind = rows.schema["_key"].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last = None  # guest, key, text and fingerprint of the row before
        for batch in batches:
            guests, keys, texts = batch.column(0).to_pylist(), batch.column(1).to_pylist(), as_bytes(batch.column(2))
            for part in slices(texts):
                own = list(zip(guests[part], keys[part], texts[part], parse(texts[part])))
                own = own if last is None else [last, *own]
                last, out, edited = own[-1], [], []
                for (guest, k, t, print_), (_, _, after, after_print) in zip(own, own[1:]):
                    if not guest:
                        chars = t.decode()
                        half = len(chars) // 2
                        edited.append((chars[: len(chars) - half] + after.decode()[:half]).encode())
                        out.append((k, len(chars), print_, likeness(print_, after_print)))
                prints = [f for s in slices(edited) for f in parse(edited[s])]
                columns = [[k for k, *_ in out], [n for _, n, *_ in out],
                           [hashlib.sha256(x).hexdigest() for x in edited], [str(f) for _, _, f, _ in out],
                           [str(f) for f in prints], [likeness(o[2], f) for o, f in zip(out, prints)],
                           [x for *_, x in out]]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = f"`{key}` {kind.simpleString()}, {EDITED}"
    names = [key, *(x.split()[0] for x in EDITED.split(", "))]
    types = [to_arrow_type(kind), pa.int64(), *[pa.string()] * 3, *[pa.float64()] * 2]
    return rows.mapInArrow(run, schema)

