"""SentencePiece-style encoding and decoding: unigram Viterbi over a double-array trie of pieces with log scores.

White space is written as the marker, and one marker is put in front of the text. Characters that no piece covers
become byte pieces. No piece holds a marker behind another character, nor a line break, so the best path of a text is
the best paths of its words one after the other; each distinct word is decoded once per worker, a batch of words at a
time. Decoding joins the pieces, turns markers into spaces and byte pieces into text.

A null text has no ids. Very long texts and words are encoded whole; equal rows get equal ids, no rows give no rows, and
columns but the key and the text are not read. Decoding gives the text back except for the marker character itself, which becomes a space.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from geosieve.llm.common import small_batches

MARKER = "▁"
UNKNOWN_PENALTY = 10.0
KEPT_WORDS = 200_000
_RUN = re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+")


class DoubleArray:
    """A trie over byte strings: the child of state s by byte c is base[s] + c, if check there is s."""

    def __init__(self, words: dict[bytes, int]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for word, i in words.items():
            node = 0
            for c in word:
                node = children[node].setdefault(c, len(children))
                if node == len(children):
                    children.append({})
                    value.append(-1)
            value[node] = i
        size = 4 * len(children) + 1024
        self.base, self.check, self.value = (np.full(size, x, np.int32) for x in (0, -1, -1))
        used = bytearray(size)
        used[0] = 1
        place, free, roomy, todo = {0: 0}, 256, 256, [0]
        while todo:
            node = todo.pop()
            own = sorted(children[node])
            if not own:
                continue
            while used[free]:
                free += 1
            at = free if len(own) == 1 else roomy
            tries = 0
            while used[at] or any(used[at - own[0] + c] for c in own):
                at, tries = at + 1, tries + 1
            if tries > 100:  # it is crowded up to here
                roomy = at
            begin = at - own[0]
            s = place[node]
            self.base[s] = begin
            for c in own:
                child = children[node][c]
                t = begin + c
                used[t] = 1
                self.check[t], self.value[t], place[child] = s, value[child], t
                todo.append(child)

    def matches(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray
                ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """All (start, end, value) of words that begin at a start and end by its limit, longer ones later."""
        found, state, at, begin, end = [], np.zeros(len(starts), np.int32), starts, starts, ends
        while len(begin):
            inside = at < end
            state, at, begin, end = state[inside], at[inside], begin[inside], end[inside]
            child = self.base[state] + data[at]
            ok = (self.base[state] > 0) & (self.check[child] == state)
            state, at, begin, end = child[ok], at[ok] + 1, begin[ok], end[ok]
            hit = self.value[state] >= 0
            found.append((begin[hit], at[hit], self.value[state[hit]]))
        return tuple(np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64),) * 3


class Pieces:
    """Pieces and log scores of a model file."""

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        ids = range(len(model))
        normal = [i for i in ids if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i))]
        names = {i: model.id_to_piece(i) for i in normal}
        if any(MARKER in x.lstrip(MARKER) or "\n" in x for x in names.values()):
            raise ValueError("pieces that go on over a white-space marker or a line break are not supported")
        self.scores = np.array([model.get_score(i) for i in ids])
        self.unknown = self.scores[normal].min() - UNKNOWN_PENALTY
        self.trie = DoubleArray({x.encode(): i for i, x in names.items()})
        self.byte_ids = np.array([model.piece_to_id(f"<0x{b:02X}>") for b in range(256)], np.int32)
        self.bytes_of = [names[i].replace(MARKER, " ").encode() if i in names else b"" for i in ids]
        for b, i in enumerate(self.byte_ids.tolist()):
            self.bytes_of[i] = bytes([b])

    def best(self, words: list[bytes]) -> list[bytes]:
        """The ids of each word's best path as little-endian unsigned 32-bit numbers."""
        size = np.array([len(x) for x in words])
        begin = np.concatenate(([0], np.cumsum(size + 1)[:-1]))  # one more place in each word for its end
        data = np.frombuffer(b"\0".join([*words, b""]), np.uint8)
        word_of = np.repeat(np.arange(len(words)), size + 1)
        last = (begin + size)[word_of]
        place = np.arange(len(data))
        letters = np.flatnonzero(((data & 0xC0) != 0x80) & (place != last))
        start, end, piece = self.trie.matches(data, letters, last[letters])
        score = self.scores[piece]
        lead = data[letters]
        width = 1 + (lead >= 0xC0).astype(np.int64) + (lead >= 0xE0) + (lead >= 0xF0)
        single = np.zeros(len(data), np.int64)
        single[letters] = width
        covered = np.zeros(len(data), bool)
        covered[start[end - start == single[start]]] = True
        bare = ~covered[letters]
        start, end = np.append(start, letters[bare]), np.append(end, letters[bare] + width[bare])
        piece, score = np.append(piece, np.full(bare.sum(), -1)), np.append(score, np.full(bare.sum(), self.unknown))
        # all words at once: by place in the word, then by length, no two edges end at one place
        order = np.lexsort((end - start, start - begin[word_of[start]]))
        start, end, piece, score = start[order], end[order], piece[order], score[order]
        step = np.flatnonzero(np.diff(start - begin[word_of[start]]) | np.diff(end - start)) + 1
        best, came = np.full(len(data), -np.inf), np.full(len(data), -1)
        best[begin] = 0
        for a, b in zip([0, *step.tolist()], [*step.tolist(), len(start)]):
            total, to = best[start[a:b]] + score[a:b], end[a:b]
            better = total > best[to]
            best[to[better]] = total[better]
            came[to[better]] = np.arange(a, b)[better]
        at, edges = (begin + size)[size > 0], []
        while len(at):
            edge = came[at]
            edges.append(edge)
            at = start[edge]
            at = at[at != begin[word_of[at]]]
        edges = np.concatenate(edges) if edges else np.zeros(0, np.int64)
        edges = edges[np.argsort(start[edges])]
        spread = np.where(piece[edges] < 0, end[edges] - start[edges], 1)
        each = np.repeat(edges, spread)
        nth = np.arange(len(each)) - np.repeat(np.cumsum(spread) - spread, spread)
        ids = np.where(piece[each] < 0, self.byte_ids[data[start[each] + nth]], piece[each]).astype("<u4")
        bounds = np.searchsorted(start[each], begin)
        raw, bounds = ids.tobytes(), [*(4 * bounds).tolist(), 4 * len(ids)]
        return [raw[a:b] for a, b in zip(bounds, bounds[1:])]

    def decode(self, ids: bytes) -> str:
        raw = b"".join([self.bytes_of[i] for i in np.frombuffer(ids, "<u4").tolist()])
        return raw.decode(errors="replace").removeprefix(" ")


def words_of(text: str) -> list[str]:
    """The text's words with their markers; line breaks are words of their own."""
    out = []
    for i, line in enumerate(text.split("\n")):
        if i:
            out.append("\n")
        head, *rest = line.split(" ")
        if MARKER in line or "" in rest or not head:
            marked = line.replace(" ", MARKER)
            out += _RUN.findall(marked if i else MARKER + marked)
        else:
            out.append(head if i else MARKER + head)
            out += [MARKER + x for x in rest]
    return out


def encode(docs: DataFrame, model: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The key, the text, ``ids`` (little-endian unsigned 32-bit), n_tokens, n_byte_tokens and ids_crc32 of each row."""
    small_batches(docs.sparkSession)
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    kind = rows.schema[0].dataType
    pieces = Pieces(model)
    fields = [(key, to_arrow_type(kind)), ("text", pa.string()), ("ids", pa.binary()), ("n_tokens", pa.int64()),
              ("n_byte_tokens", pa.int64()), ("ids_crc32", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, bytes] = {}
        is_byte = np.zeros(len(pieces.scores), bool)
        is_byte[pieces.byte_ids] = True
        for batch in batches:
            if len(known) > KEPT_WORDS:
                known = {}
            texts = [words_of(x) if x else [] for x in batch.column(1).to_pylist()]
            new = list(set().union(*texts) - known.keys()) if texts else []
            for i in range(0, len(new), 20_000):
                part = new[i:i + 20_000]
                known.update(zip(part, pieces.best([x.encode() for x in part])))
            ids = [b"".join([known[w] for w in x]) for x in texts]
            numbers = [np.frombuffer(x, "<u4") for x in ids]
            columns = [batch.column(0), batch.column(1), pa.array(ids, pa.binary()), [len(x) for x in numbers],
                       [int(is_byte[x].sum()) for x in numbers], [zlib.crc32(x) for x in ids]]
            yield pa.RecordBatch.from_arrays(
                [c if isinstance(c, pa.Array) else pa.array(c, t) for c, (_, t) in zip(columns, fields)],
                names=[n for n, _ in fields])

    return rows.mapInArrow(run, f"`{key}` {kind.simpleString()}, text string, ids binary, n_tokens long, "
                                "n_byte_tokens long, ids_crc32 long")


def decode(tokens: DataFrame, model: str, ids: str = "ids") -> DataFrame:
    """``tokens`` with the column ``decoded``."""
    pieces = Pieces(model)

    @F.pandas_udf("string")
    def text_of(column):
        return column.map(pieces.decode)

    return tokens.withColumn("decoded", text_of(F.coalesce(F.col(ids), F.lit(b""))))
