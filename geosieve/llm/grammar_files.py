"""Token ids in compressed binary shards: Re-Pair grammars with random access.

Documents are sorted through ranges of their ids, encoded, and cut into shards of about ``SHARD_IDS`` ids. In a shard,
frequent pairs of neighbouring symbols are replaced by new symbols, again and again; a round replaces all frequent pairs
at once, where occurrences overlap the more frequent one, and the first of equal ones. Pairs never reach over two
documents, so each document is a span of symbols of its own. A shard stores its rules and the length of each rule's
expansion: any stretch of a document is found by summing lengths, and only the symbols that cover it are expanded.

A shard's bytes, little-endian: ``RPG1``; unsigned 32-bit numbers of terminals, rules, entries and symbols; the rules'
left and right symbols and lengths; per entry the document's id and row (signed 64-bit), its part, ids, symbols and flags
(unsigned 32-bit); the symbols (unsigned 32-bit). An entry is a document, or a part of one that is longer than a
shard (flags: 1 has an id, 2 is the last part). Shards are rows of a Parquet table, whose commit survives lost tasks and
which works on any store; ``first_doc`` and ``last_doc`` beside the bytes let a reader skip shards.

A null text is an empty one (the end id alone). Null ids come first; repeated rows are written each. No rows give no
shards.
"""

from __future__ import annotations

import json
import os
import re
import struct
import zlib
from collections.abc import Iterator, Sequence
from functools import reduce
from itertools import chain
from operator import or_

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geosieve.llm.common import small_batches, written
from geosieve.llm.ordered import in_ranges
from geosieve.llm.packing import byte_of_character

END_ID = 1
SHARD_IDS = 1 << 20
LEAST_COUNT = 8  # a rule takes 12 bytes and saves 4 with each use
KEPT_CHARACTERS = 6_000_000  # of words, up to about 150 MB a worker
BUCKET_BITS = 21
LEAST_GAIN = 0.03  # a round that shortens the shard by less is the last
HAS_ID, IS_LAST = 1, 2

_HEAD = "<4sIIII"
_ENTRY = np.dtype([("doc", "<i8"), ("row", "<i8"), ("part", "<u4"), ("ids", "<u4"), ("symbols", "<u4"), ("flags", "<u4")])
# what is not Latin text and its punctuation, whose normal form is itself; the first four are spaces for str.split() only
_NOT_PLAIN = "[\x1c-\x1f\u0250-\u200f\u2028-\u202f\u205f-\u209f\u20c0-\U0010ffff]"
_PLAIN = [c for c in range(0x20C0) if not 0x250 <= c < 0x2010]
_WORD_END = "\x1c"  # which no plain text has
_LETTER, _NUMBER, _OTHER = 1, 2, 3  # kinds of characters; 0: white space
_CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
_PIECES = "|".join([*_CONTRACTIONS, r"[\p{L}]+", r"[\p{N}]", r"[^\s\p{L}\p{N}]+"])
_ENCODERS: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of the ``tokenizers`` library (little-endian, 32-bit) for a byte-level BPE file with word ends, lower case.

    As no token reaches over white space, each word is encoded once per worker; words have numbers, under which their
    ids are kept until they take too much room. Words of letters and signs that normalisation leaves alone are cut here,
    all new ones of a list of texts at once, and encoded by a faster encoder that takes the mark of a word's end for a
    character that such texts do not have, whose merges come first. Texts with an added token, other characters, or what
    only Python takes for white space go to the library whole.
    """

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # Spark runs a worker per core
        import regex
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.added = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.odd = re.compile(_NOT_PLAIN).search
        self.terminals = self.library.get_vocab_size()
        with open(path, encoding="utf-8") as f:
            file = json.load(f)
        if file["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"] != _PIECES:
            raise ValueError(f"{path} cuts words in another way")
        end, byte = file["model"]["end_of_word_suffix"], byte_of_character()
        ranks, self.is_last = {}, np.zeros(self.terminals, bool)
        for token, i in file["model"]["vocab"].items():
            if token not in self.added:
                last = token.endswith(end)
                body = bytes(byte[c] for c in (token[:-len(end)] if last else token))
                ranks[body + _WORD_END.encode() * last] = i
                self.is_last[i] = last
        self.fast = tiktoken.Encoding("words", pat_str=f"[^{_WORD_END}]*{_WORD_END}", mergeable_ranks=ranks, special_tokens={})
        lower = "".join(map(chr, _PLAIN)).lower()
        self.kind = np.full(max(map(ord, lower)) + 1, _OTHER, np.uint8)
        for kind, pattern in ((_LETTER, r"\p{L}"), (_NUMBER, r"\p{N}"), (0, r"\s")):
            self.kind[list(map(ord, regex.findall(pattern, lower)))] = kind
        self.forget()

    def forget(self) -> None:
        self.words, self.kept = pa.array([], pa.string()), 0
        self.ids, self.ends = np.empty(0, "<u4"), np.zeros(1, np.int64)  # ends: one before the first word too

    def encode(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def cut(self, words: pa.Array) -> tuple[str, np.ndarray]:
        """The words' pieces, each with the mark of an end behind it, and how many pieces each word has."""
        joined = pc.binary_join(pa.ListArray.from_arrays([0, len(words)], words), " ")[0].as_py() + " "
        chars = np.frombuffer(joined.encode("utf-32-le"), "<u4")
        kind = self.kind[chars]
        begins = np.ones(len(chars), bool)
        begins[1:] = (kind[1:] != kind[:-1]) | (kind[1:] == _NUMBER)
        for at in np.flatnonzero(begins & (chars == ord("'"))).tolist():
            if found := next((c for c in _CONTRACTIONS if joined.startswith(c, at)), None):
                begins[at + 1:at + len(found)] = False
                begins[at + len(found)] = True
        space = np.flatnonzero(chars == ord(" "))
        first = np.flatnonzero(begins & (kind > 0))
        stop = np.flatnonzero(begins)  # a piece ends where the next piece or white space begins
        stop = stop[np.searchsorted(stop, first, "right")]
        marked = np.insert(chars, stop, ord(_WORD_END))
        marked = marked[np.insert(kind > 0, stop, True)]
        return marked.tobytes().decode("utf-32-le"), np.diff(np.searchsorted(first, space), prepend=0)

    def learn(self, words: pa.Array) -> None:
        marked, pieces = self.cut(words)
        ids = self.fast.encode_to_numpy(marked)
        ends = np.append(0, np.flatnonzero(self.is_last[ids]) + 1)  # of pieces
        self.ends = np.append(self.ends, len(self.ids) + ends[np.cumsum(pieces)])
        self.ids = np.append(self.ids, ids)
        self.words = pa.concat_arrays([self.words, words])
        self.kept += len(marked)

    def __call__(self, texts: list[str]) -> list[bytes]:
        if self.kept > KEPT_CHARACTERS:
            self.forget()
        plain = [not self.odd(t) and not any(a in t for a in self.added) for t in texts]
        lower = pa.array([t.lower().strip() if yes else "" for t, yes in zip(texts, plain)], pa.string())
        split = pc.utf8_split_whitespace(lower)  # an empty text has an empty word
        own = split.flatten().dictionary_encode()
        found = pc.index_in(own.dictionary, self.words)
        number, new = found.fill_null(0).to_numpy(), np.flatnonzero(found.is_null())
        if len(new):
            number = number.copy()
            number[new] = len(self.words) + np.arange(len(new))
            self.learn(own.dictionary.take(pa.array(new)))
        words = number[own.indices.to_numpy()]
        begin = self.ends[words]
        size = self.ends[words + 1] - begin
        last = np.append(0, np.cumsum(size))
        flat = self.ids[np.arange(last[-1]) + np.repeat(begin - last[:-1], size)].tobytes()
        ends = (4 * last[split.offsets.to_numpy()]).tolist()
        return [flat[a:b] if yes else self.encode(t) for t, yes, a, b in zip(texts, plain, ends, ends[1:])]


def encoder(path: str) -> WordEncoder:
    if path not in _ENCODERS:
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]


def _buckets(pairs: np.ndarray) -> np.ndarray:
    return ((pairs.view(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - BUCKET_BITS)).view(np.int64)


def _counted(values: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """Values that are there at least so often, ascending, and how often."""
    values = np.sort(values)
    first = np.flatnonzero(np.append(True, values[1:] != values[:-1])[:len(values)])
    count = np.diff(np.append(first, len(values)))
    return values[first[count >= least]], count[count >= least]


def _places(pairs: np.ndarray, bucket: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which pairs are among ``found`` (ascending), and their places in it: by their bucket, if one alone has it."""
    n = len(found)
    place = np.full(1 << BUCKET_BITS, n, np.int32)
    own = _buckets(found)
    place[own] = np.arange(n)
    which = place[bucket]
    shared = np.zeros(1 << BUCKET_BITS, bool)
    shared[own[place[own] != np.arange(n)]] = True
    again = np.flatnonzero(shared[bucket])
    which[again] = np.searchsorted(found, pairs[again])
    same = np.append(found, -1)[which] == pairs
    return same, which[same]


def re_pair(ids: np.ndarray, begins: np.ndarray, terminals: int, least_count: int = LEAST_COUNT,
            least_gain: float = LEAST_GAIN) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Symbols, where documents begin among them (flags), and rules (n, 2). Rule i is symbol ``terminals`` + i."""
    symbols, begins, rules = ids.astype(np.int64), begins.copy(), np.empty((0, 2), np.int64)
    while len(symbols) > 1:
        pairs = symbols[:-1] << 32 | symbols[1:]
        pairs[begins[1:]] = -1
        # pairs whose bucket is rare are rare, so only the others are sorted
        bucket = _buckets(pairs)
        often = np.bincount(bucket, minlength=1 << BUCKET_BITS) >= least_count
        at = np.flatnonzero(often[bucket] & (pairs >= 0))
        pairs, bucket = pairs[at], bucket[at]
        found, count = _counted(pairs, least_count)
        order = np.argsort(-count, kind="stable")
        rank = np.empty(len(found), np.int64)
        rank[order] = np.arange(len(found))
        frequent, which = _places(pairs, bucket, found)
        at, place = at[frequent], rank[which]
        ranks = np.full(len(symbols) + 1, len(found), np.int32)  # by the pair's first symbol, one further on
        ranks[at + 1] = place
        taken = (place < ranks[at]) & (place <= ranks[at + 2])
        at, place = at[taken], place[taken]
        used = np.bincount(place, minlength=len(found))
        enough = used >= least_count
        chosen = enough[place]
        at, place = at[chosen], place[chosen]
        if len(at) == 0:
            break
        name = terminals + len(rules) + np.cumsum(enough) - 1
        made = found[order][enough]
        rules = np.concatenate([rules, np.stack([made >> 32, made & 0xFFFFFFFF], 1)])
        symbols[at] = name[place]
        keep = np.ones(len(symbols), bool)
        keep[at + 1] = False
        small = len(at) < least_gain * len(symbols)
        symbols, begins = symbols[keep], begins[keep]
        if small:
            break
    return symbols, begins, rules


def rule_lengths(rules: np.ndarray, terminals: int) -> np.ndarray:
    """How many ids each rule stands for; rules only use earlier ones."""
    known = np.concatenate([np.ones(terminals, np.int64), np.zeros(len(rules), np.int64)])
    left = np.arange(len(rules))
    while len(left):
        size = known[rules[left]]
        ready = size.all(1)
        known[terminals + left[ready]] = size[ready].sum(1)
        left = left[~ready]
    return known[terminals:]


class Shard:
    """A written shard: entries, and ids of whole entries or stretches of them."""

    def __init__(self, data: bytes):
        magic, self.terminals, n_rules, n_entries, n_symbols = struct.unpack_from(_HEAD, data)
        if magic != b"RPG1":
            raise ValueError("not a shard of token ids")
        at = struct.calcsize(_HEAD)
        self.rules = np.frombuffer(data, "<u4", 2 * n_rules, at).reshape(-1, 2).astype(np.int64)
        at += 8 * n_rules
        self.lengths = np.concatenate([np.ones(self.terminals, np.int64), np.frombuffer(data, "<u4", n_rules, at)])
        at += 4 * n_rules
        self.entries = np.frombuffer(data, _ENTRY, n_entries, at)
        at += _ENTRY.itemsize * n_entries
        self.symbols = np.frombuffer(data, "<u4", n_symbols, at)
        self.first = np.concatenate([[0], np.cumsum(self.entries["symbols"], dtype=np.int64)])
        self._expansions: tuple[np.ndarray, np.ndarray] | None = None

    @staticmethod
    def bytes_of(ids: np.ndarray, entries: np.ndarray, terminals: int) -> bytes:
        """``entries`` without their numbers of symbols; each has at least one id."""
        begins = np.zeros(len(ids), bool)
        begins[np.cumsum(entries["ids"]) - entries["ids"]] = True
        symbols, begins, rules = re_pair(ids, begins, terminals)
        entries["symbols"] = np.diff(np.append(np.flatnonzero(begins), len(symbols)))
        head = struct.pack(_HEAD, b"RPG1", terminals, len(rules), len(entries), len(symbols))
        return b"".join([head, rules.astype("<u4").tobytes(), rule_lengths(rules, terminals).astype("<u4").tobytes(),
                         entries.tobytes(), symbols.astype("<u4").tobytes()])

    def _expanded_rules(self) -> tuple[np.ndarray, np.ndarray]:
        """The expansions of all symbols, one after the other, and where each begins."""
        if self._expansions is None:
            flat = np.arange(self.terminals + len(self.rules))
            while (flat >= self.terminals).any():
                rule = flat >= self.terminals
                place = np.cumsum(1 + rule) - 1 - rule
                out = np.empty(len(flat) + int(rule.sum()), np.int64)
                out[place] = np.where(rule, self.rules[np.where(rule, flat - self.terminals, 0), 0], flat) \
                    if len(self.rules) else flat
                out[place[rule] + 1] = self.rules[flat[rule] - self.terminals, 1]
                flat = out
            self._expansions = flat, np.cumsum(self.lengths) - self.lengths
        return self._expansions

    def expand(self, symbols: np.ndarray) -> np.ndarray:
        flat, begin = self._expanded_rules()
        size = self.lengths[symbols]
        shift = begin[symbols] - (np.cumsum(size) - size)
        return flat[np.arange(int(size.sum())) + np.repeat(shift, size)].astype("<u4")

    def ids(self, entry: int, start: int = 0, stop: int | None = None) -> np.ndarray:
        """Ids ``start`` to ``stop`` of an entry; only symbols that cover them are expanded."""
        symbols = self.symbols[self.first[entry]:self.first[entry + 1]]
        stop = int(self.entries["ids"][entry]) if stop is None else min(stop, int(self.entries["ids"][entry]))
        if stop <= start:
            return np.empty(0, "<u4")
        ends = np.cumsum(self.lengths[symbols])
        a, b = np.searchsorted(ends, start, "right"), np.searchsorted(ends, stop)
        before = int(ends[a - 1]) if a else 0
        return self.expand(symbols[a:b + 1])[start - before:stop - before]


SHARDS = "shard long, first_doc long, last_doc long, n_ids long, n_symbols long, data binary"


def write_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, shard_ids: int = SHARD_IDS, key: str = "doc_id",
                 text: str = "text") -> DataFrame:
    """The written table of shards, in ascending order of the documents' ids."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key).cast("long").alias("doc"), F.monotonically_increasing_id().alias("row"),
                       F.coalesce(F.col(text), F.lit("")).alias("text"))
    end = np.array([end_id], "<u4").tobytes()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder(tokenizer)
        number = TaskContext.get().partitionId() << 32
        parts: list[bytes] = []
        entries: list[tuple] = []
        size = 0

        def shard() -> pa.RecordBatch:
            nonlocal number, size
            ids = np.frombuffer(b"".join(parts), "<u4")
            known = [e[0] for e in entries if e[5] & HAS_ID]
            data = Shard.bytes_of(ids, np.array(entries, _ENTRY), max(encode.terminals, int(ids.max()) + 1))
            n_symbols = struct.unpack_from(_HEAD, data)[4]
            columns = [[number], [min(known, default=None)], [max(known, default=None)], [size], [n_symbols]]
            number, size = number + 1, 0
            parts.clear()
            entries.clear()
            return pa.RecordBatch.from_arrays([*[pa.array(c, pa.int64()) for c in columns], pa.array([data], pa.binary())],
                                              names=[x.split()[0] for x in SHARDS.split(", ")])

        for batch in batches:
            docs, rows, texts = (c.to_pylist() for c in batch.columns)
            for doc, row, ids in zip(docs, rows, encode(texts)):
                left, part = ids + end, 0
                while left:
                    taken, left = left[:4 * (shard_ids - size)], left[4 * (shard_ids - size):]
                    flags = HAS_ID * (doc is not None) + IS_LAST * (not left)
                    parts.append(taken)
                    entries.append((doc or 0, row, part, len(taken) // 4, 0, flags))
                    size, part = size + len(taken) // 4, part + 1
                    if size >= shard_ids:
                        yield shard()
        if entries:
            yield shard()

    return written(in_ranges(rows, ["doc", "row"]).mapInArrow(run, SHARDS))


def shard_starts(shards: DataFrame) -> DataFrame:
    """(shard, base): how many ids all earlier shards hold. Reads no shard's bytes.

    Sums run within the parts of the range exchange, then over one row per part.
    """
    sizes = shards.select("shard", "n_ids", F.shiftright("shard", 32).alias("part"))
    own = Window.partitionBy("part").orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)
    parts = sizes.groupBy("part").agg(F.sum("n_ids").alias("n")).select(
        "part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("before"))
    inside = sizes.withColumn("inside", F.coalesce(F.sum("n_ids").over(own), F.lit(0)))
    return inside.join(parts, "part").select("shard", (F.col("before") + F.col("inside")).alias("base"))


def _times(matrix: list[int], vector: int) -> int:
    return reduce(lambda a, b: a ^ b, (row for i, row in enumerate(matrix) if vector >> i & 1), 0)


def joined_crc(first: int, second: int, size: int) -> int:
    """CRC-32 of two byte strings put together, from theirs and the second's size: ``first`` moves on over zeros."""
    step = [0xEDB88320, *(1 << i for i in range(31))]  # one zero bit, as a matrix over bits
    n = 8 * size
    while n:
        if n & 1:
            first = _times(step, first)
        step, n = [_times(step, row) for row in step], n >> 1
    return first ^ second


ENTRIES = "shard long, doc_id long, row long, part long, at long, n_tokens long, crc long, last boolean"


def read_documents(shards: DataFrame) -> DataFrame:
    """doc_id, start (ids of all documents before it), n_tokens and ids_crc32 of every document, from the shards' bytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for number, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                shard = Shard(data.as_py())
                ids, e = shard.expand(shard.symbols), shard.entries
                size = e["ids"].astype(np.int64)
                at = np.cumsum(size) - size
                raw = memoryview(ids.tobytes())
                crc = [zlib.crc32(raw[4 * a:4 * (a + n)]) for a, n in zip(at.tolist(), size.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(len(e), number)), pa.array(e["doc"], mask=e["flags"] & HAS_ID == 0),
                     pa.array(e["row"]), pa.array(e["part"].astype(np.int64)), pa.array(at), pa.array(size),
                     pa.array(crc, pa.int64()), pa.array(e["flags"] & IS_LAST > 0)],
                    names=[x.split()[0] for x in ENTRIES.split(", ")])

    @F.pandas_udf("long")
    def whole_crc(parts: pd.Series) -> pd.Series:
        def fold(rows) -> int:
            return reduce(lambda a, r: (joined_crc(a[0], r["crc"], 4 * r["n_tokens"]),), rows, (0,))[0]

        return parts.map(fold)

    c = F.col
    entries = written(shards.select("shard", "data").mapInArrow(run, ENTRIES))  # read once for both kinds below
    entries = entries.join(shard_starts(shards), "shard").withColumn("start", c("base") + c("at"))
    whole = (c("part") == 0) & c("last")
    alone = entries.where(whole).select("doc_id", "start", "n_tokens", c("crc").alias("ids_crc32"))
    # a document's parts: one per ``shard_ids`` ids of it
    cut = entries.where(~whole).groupBy("row").agg(
        F.max("doc_id").alias("doc_id"), F.min("start").alias("start"), F.sum("n_tokens").alias("n_tokens"),
        F.sort_array(F.collect_list(F.struct("part", "crc", "n_tokens"))).alias("parts"))
    return alone.union(cut.select("doc_id", "start", "n_tokens", whole_crc("parts").alias("ids_crc32")))


def read_ids(shards: DataFrame, wanted: Sequence[int], start: int = 0, stop: int | None = None) -> DataFrame:
    """(doc_id, part, ids) of the documents named, or of ids ``start`` to ``stop`` of each part; other shards are skipped."""
    wanted = sorted(set(wanted))
    near = reduce(or_, [(F.col("first_doc") <= i) & (F.col("last_doc") >= i) for i in wanted], F.lit(False))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for data in batch.column(0):
                shard = Shard(data.as_py())
                e = shard.entries
                at = np.flatnonzero(np.isin(e["doc"], wanted) & (e["flags"] & HAS_ID > 0))
                yield pa.RecordBatch.from_arrays(
                    [pa.array(e["doc"][at]), pa.array(e["part"][at].astype(np.int64)),
                     pa.array([shard.ids(i, start, stop).astype(np.int64) for i in at.tolist()], pa.list_(pa.int64()))],
                    names=["doc_id", "part", "ids"])

    return shards.where(near).select("data").mapInArrow(run, "doc_id long, part long, ids array<long>")
