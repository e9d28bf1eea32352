"""Repairs the structure of conversations by the cheapest edits, ties broken by the least audit.

A repaired conversation's role initials match ``(s?(ua)+)?``. Each row is kept (K), given the role user or assistant
(R, 2) or deleted (D, 3, the only choice for blank rows and repeats); turns with an empty text are inserted (I, 2).
Truncated rows that stay add 1. The audit is the string of the edits' initials in order.

Nodes are (place, state of the pattern), arcs are edits. A dynamic programme from the end gives each node its cost; the
arcs that attain it are optimal, and every path of optimal arcs is a cheapest repair. Nodes are ranked by the first
letter of their least audit, then by the first two, four, eight, ...: a rank of doubled length is the rank of the pair
of a node's rank and that of the node where its pointer leads, and the pointer is doubled as well. The ranks choose
the least of a node's optimal arcs, and the doubled pointers then mark the path from the entry in as many steps.

Rows are sorted through ranges and cut into blocks of at most a batch, each of one conversation. A block acts on costs
as a matrix (minimum, plus) and on states as a map. Conversations of several blocks carry both over their blocks by a
tree of compositions, so a conversation may hold a third of all rows; all others are solved within their block.

Null roles and texts are one space. A null conversation is one of its own. Rows of equal turn are taken by role, then
by the SHA-256 of the text; equal rows are repeats, of which the first stays. An empty table has no conversations.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from geosieve.llm.common import small_batches, written
from geosieve.llm.ordered import exclusive_scan, in_ranges

SPACES = " \t\n\x0b\x0c\r"
NAMES = ("", "", "user", "assistant")  # by state, of rows that are inserted or renamed
START, SYSTEM, USER, ASSISTANT = range(4)
EXPECTED = np.array([USER, USER, ASSISTANT, USER])  # what R and I lead to
KEEP, RENAME, DELETE, INSERT, TRUNCATED = 0, 2, 3, 2, 1
FAR = 1 << 40

# a row's code: its initial (s, u, a, other), must it go, is it truncated; or the end of the conversation
MUST_GO, CUT_OFF, END = 4, 8, 16
LETTERS = "DIKR"  # in ASCII order
_D, _I, _K, _R = range(4)


def _arcs() -> tuple[np.ndarray, np.ndarray]:
    """Weight and target state of each (code, state, letter); insertions stay at their place."""
    weight, target = np.full((END + 1, 4, 4), FAR), np.zeros((END + 1, 4, 4), np.int64)
    after = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}, 3: {}}
    weight[:, :, _I], target[:, :, _I] = INSERT, EXPECTED
    for code in range(END):
        extra = TRUNCATED if code & CUT_OFF else 0
        weight[code, :, _D], target[code, :, _D] = DELETE, range(4)
        if not code & MUST_GO:
            weight[code, :, _R], target[code, :, _R] = RENAME + extra, EXPECTED
            for state, to in after[code & 3].items():
                weight[code, state, _K], target[code, state, _K] = KEEP + extra, to
    for state in (START, ASSISTANT):
        weight[END, state, _K], target[END, state, _K] = 0, state
    return weight, target


_WEIGHT, _TARGET = _arcs()


class Blocks:
    """The nodes of some blocks: a layer of four states before each row, and one behind the last."""

    def __init__(self, codes: list[bytes]):
        self.size = np.array([len(x) for x in codes], np.int64)
        self.first = np.cumsum(self.size + 1) - self.size - 1
        self.exit = self.first + self.size
        self.code = np.full(int(self.size.sum() + len(codes)), END, np.int64)
        self.is_exit = np.zeros(len(self.code), bool)
        self.is_exit[self.exit] = True
        self.code[~self.is_exit] = np.frombuffer(b"".join(codes), np.uint8)

    def costs(self, ends: np.ndarray) -> np.ndarray:
        """Cost (layer, state, k) to the block's end, given the costs (block, state, k) behind it."""
        cost = np.full((len(self.code), *ends.shape[1:]), FAR)
        cost[self.exit] = ends
        order = np.argsort(-self.size, kind="stable")
        tops, sizes = self.exit[order], -self.size[order]
        for back in range(1, int(self.size.max(initial=0)) + 1):
            layer = tops[: np.searchsorted(sizes, -back, "right")] - back
            code, after = self.code[layer], cost[layer + 1]
            best = np.full(after.shape, FAR)
            for letter in (_D, _K, _R):
                to = np.take_along_axis(after, _TARGET[code, :, letter][:, :, None], 1)
                best = np.minimum(best, to + _WEIGHT[code, :, letter][:, :, None])
            user, assistant = best[:, USER], best[:, ASSISTANT]
            best[:, USER], best[:, ASSISTANT] = (np.minimum(user, INSERT + assistant),
                                                 np.minimum(assistant, INSERT + user))
            best[:, :USER] = np.minimum(best[:, :USER], INSERT + best[:, USER, None])
            cost[layer] = np.minimum(best, FAR)
        return cost

    def rank(self, ends: np.ndarray) -> None:
        """Ranks, pointers and lengths of the least audits from all nodes, given the costs (block, state) behind."""
        cost = self.costs(ends[:, :, None])[:, :, 0]
        layers = np.arange(len(self.code))
        below = np.minimum(layers + 1, len(self.code) - 1)
        node = 4 * np.where(np.arange(4) == _I, layers[:, None], below[:, None])[:, None, :] + _TARGET[self.code]
        self.weight = _WEIGHT[self.code].reshape(-1, 4)
        cost, node = cost.ravel(), node.reshape(-1, 4)
        dead = np.repeat(self.is_exit, 4) | (cost >= FAR)
        optimal = (self.weight + cost[node] == cost[:, None]) & ~dead[:, None]
        self.dead = dead

        own = np.arange(len(cost))
        letter = np.where(dead, 0, optimal.argmax(1) + 1)  # no two arcs of a node have the same letter
        pointer = np.where(dead, own, node[own, optimal.argmax(1)])
        rank, length = np.unique(letter, return_inverse=True)[1], (~dead).astype(np.int64)
        while not dead[pointer].all():
            rank = np.unique(rank * len(own) + rank[pointer], return_inverse=True)[1]
            length, pointer = length + length[pointer], pointer[pointer]
        least = np.where(optimal, np.arange(4) * len(own) + rank[node], 4 * len(own)).argmin(1)
        self.letter, self.length, self.leaves = least, length, pointer
        self.pointers = [np.where(dead, own, node[own, least])]
        for _ in range(int(length.max(initial=0)).bit_length()):
            self.pointers.append(self.pointers[-1][self.pointers[-1]])

    def exits(self) -> np.ndarray:
        """The state (block, state) in which the least path from each entry leaves the block."""
        return self.leaves[4 * self.first[:, None] + np.arange(4)] % 4

    def path(self, entry: np.ndarray) -> list[list[tuple[int, int, int, int]]]:
        """Letter, row, state before and weight of each step of the least path of each block."""
        on = np.zeros(len(self.dead), bool)
        on[4 * self.first + entry] = True
        for pointer in reversed(self.pointers):
            on[pointer[on]] = True
        nodes = np.flatnonzero(on & ~self.dead)
        block = np.searchsorted(self.first, nodes // 4, "right") - 1
        order = np.lexsort((-self.length[nodes], block))
        nodes, block = nodes[order], block[order]
        letter = self.letter[nodes]
        steps = list(zip(letter.tolist(), (nodes // 4 - self.first[block]).tolist(), (nodes % 4).tolist(),
                         self.weight[nodes, letter].tolist()))
        cuts = np.searchsorted(block, np.arange(len(self.first) + 1))
        return [steps[a:b] for a, b in zip(cuts, cuts[1:])]


FACTS = "n_rows, n_blank, n_duplicate, n_truncated, n_illegal, n_turns, first_turn, last_turn"
BLOCKS = ("block long, conversation long, codes binary, roles array<string>, texts array<string>, "
          + ", ".join(f"{x} long" for x in FACTS.split(", ")) + ", first_role string, last_role string")
STRINGS = pa.list_(pa.string())


def _batch(kinds: str, rows: list[tuple]) -> pa.RecordBatch:
    arrow = {"long": pa.int64(), "binary": pa.binary(), "string": pa.string(), "array<string>": STRINGS,
             "array<long>": pa.list_(pa.int64())}
    fields = [x.split() for x in kinds.split(", ")]
    columns = zip(*rows) if rows else [[]] * len(fields)
    return pa.RecordBatch.from_arrays([pa.array(c, arrow[k]) for c, (_, k) in zip(columns, fields)],
                                      names=[n for n, _ in fields])


def _block_rows(rows: DataFrame) -> DataFrame:
    """One row per block of the rows (conversation, turn, role, text, gone, again), which are in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = TaskContext.get().partitionId() << 32
        for batch in batches:
            chats, turns, roles, texts, gone, again = [batch.column(i).to_pylist() for i in range(6)]
            blank = pc.invert(pc.match_substring_regex(batch.column(3), "[^ \\t-\\r]")).to_pylist()
            ends = [x.rstrip(SPACES)[-1:] for x in texts]
            out, begin = [], 0
            for i in range(1, len(chats) + 1):
                if i < len(chats) and chats[i] == chats[begin]:
                    continue
                own = [j for j in range(begin, i) if not gone[j]]
                initials = [roles[j][:1] for j in own]
                dup = [again[j] and not blank[j] for j in own]
                cut = [not blank[j] and not d and ends[j] not in (".", "!", "?") for j, d in zip(own, dup)]
                codes = bytes(("sua".find(x) if x else -1) % 4 | MUST_GO * (blank[j] or d) | CUT_OFF * c
                              for x, j, d, c in zip(initials, own, dup, cut))
                known = [turns[j] for j in own if turns[j] is not None]
                illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
                out.append((number, chats[begin], codes, [roles[j] for j in own], [texts[j] for j in own], len(own),
                            sum(blank[j] for j in own), sum(dup), sum(cut), illegal, len(set(known)),
                            known[0] if known else None, known[-1] if known else None,
                            initials[0] if own else None, initials[-1] if own else None))
                number, begin = number + 1, i
            yield _batch(BLOCKS, out)

    return rows.mapInArrow(run, BLOCKS)


def _over_codes(rows: DataFrame, name: str, make) -> DataFrame:
    """(group, idx, value): ``make`` gets the blocks and the costs behind them."""
    kinds = f"group long, idx long, {name} array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(3).to_pylist() if batch.num_columns > 3 else None
            values = make(Blocks(batch.column(2).to_pylist()), ends).reshape(batch.num_rows, -1)
            yield _batch(kinds, list(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), values.tolist())))

    return rows.mapInArrow(run, kinds)


def _matrices(blocks: Blocks, _) -> np.ndarray:
    unit = np.where(np.eye(4, dtype=bool), 0, FAR)
    return blocks.costs(np.broadcast_to(unit, (len(blocks.size), 4, 4)))[blocks.first]


def _maps(blocks: Blocks, ends: list[list[int]]) -> np.ndarray:
    blocks.rank(np.array(ends, np.int64).reshape(-1, 4))
    return blocks.exits()


def _then(done: np.ndarray, value: np.ndarray) -> np.ndarray:
    """The block ``value`` before the blocks ``done``."""
    value, done = value.reshape(4, 4, 1), done.reshape(1, 4, 4)
    return np.minimum((value + done).min(1), FAR).ravel()


def _before(state: np.ndarray, value: np.ndarray) -> np.ndarray:
    return np.minimum((value.reshape(4, 4) + state).min(1), FAR)


REPAIRED = ("conversation long, block long, audit string, cost long, new_roles array<string>, new_texts array<string>, "
            + ", ".join(f"{x} long" for x in FACTS.split(", ")) + ", first_role string, last_role string")


def _solved(rows: DataFrame) -> DataFrame:
    facts = [*FACTS.split(", "), "first_role", "last_role"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            of = {n: batch.column(i).to_pylist() for i, n in enumerate(batch.schema.names)}
            blocks = Blocks(of["codes"])
            blocks.rank(np.array([x or [0] * 4 for x in of["ends"]], np.int64).reshape(-1, 4))
            entry = np.array([x[0] if x else START for x in of["entry"]], np.int64)
            out = []
            for i, steps in enumerate(blocks.path(entry)):
                roles, texts, audit, cost = [], [], [], 0
                for letter, row, state, weight in steps:
                    cost += weight
                    if row == len(of["roles"][i]) and letter == _K:  # the end
                        continue
                    audit.append(LETTERS[letter])
                    if letter == _K:
                        roles.append(of["roles"][i][row])
                    elif letter != _D:
                        roles.append(NAMES[EXPECTED[state]])
                    if letter != _D:
                        texts.append("" if letter == _I else of["texts"][i][row])
                out.append((of["conversation"][i], of["block"][i], "".join(audit), cost, roles, texts,
                            *[of[f][i] for f in facts]))
            yield _batch(REPAIRED, out)

    return rows.mapInArrow(run, REPAIRED)


def repair(rows: DataFrame, conversation: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
           gone: str | None = None) -> DataFrame:
    """The repaired conversations in blocks: audit, cost, new_roles and new_texts of each, and counts of the faults.

    A conversation's blocks, in the order of ``block``, one after the other are the whole. Rows for which the boolean
    column ``gone`` holds only name their conversation.
    """
    c, space = F.col, F.lit(" ")
    small_batches(rows.sparkSession)
    rows = written(rows.select(
        c(conversation).cast("long").alias("conversation"), c(turn).cast("long").alias("turn"),
        F.coalesce(c(role), space).alias("role"), F.coalesce(c(text), space).alias("text"),
        (c(gone) if gone else F.lit(False)).alias("gone")).withColumns(
        {"digest": F.unhex(F.sha2("text", 256)), "row": F.monotonically_increasing_id()}))
    place = F.struct("turn", "row")  # a null turn is the least
    first = written(rows.where(~c("gone")).groupBy("conversation", "role", "digest").agg(
        F.min(place).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").drop("n"))
    test = (c("r.conversation").eqNullSafe(c("f.conversation")) & (c("r.role") == c("f.role"))
            & (c("r.digest") == c("f.digest")))
    rows = rows.alias("r").join(first.alias("f"), test, "left").select(
        "r.*", F.coalesce(F.struct("r.turn", "r.row") != c("f.first"), F.lit(False)).alias("again"))
    order = ["conversation", "turn", "role", "digest", "row"]
    rows = in_ranges(rows, order).select("conversation", "turn", "role", "text", "gone", "again")
    blocks = written(_block_rows(rows))

    chat = Window.partitionBy("conversation")
    places = blocks.select("block", F.row_number().over(chat.orderBy("block")).alias("idx"),
                           F.count(F.lit(1)).over(chat).alias("n"), F.min("block").over(chat).alias("group"))
    places = written(places.select("block", (c("idx") - 1).cast("long").alias("idx"), "n", "group"))
    end = F.when(c("idx") == c("n") - 1, F.concat("codes", F.lit(bytes([END])))).otherwise(c("codes"))
    blocks = blocks.join(places, "block").withColumn("codes", end)
    long = blocks.where("n > 1").select("group", "idx", "codes")
    ends = exclusive_scan(_over_codes(long, "value", _matrices), _then, _before, [0] * 4, reverse=True)
    ends = ends.withColumnRenamed("state", "ends")
    maps = _over_codes(long.join(ends, ["group", "idx"]).select("group", "idx", "codes", "ends"), "value", _maps)
    entries = exclusive_scan(maps, lambda done, v: v[done], lambda state, v: v[state], [START])
    carried = ends.join(entries.withColumnRenamed("state", "entry"), ["group", "idx"])
    return _solved(blocks.join(carried, ["group", "idx"], "left"))


SUMMARY = ("conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, "
           "repaired_sha256 string")


def summary(repaired: DataFrame) -> DataFrame:
    """Faults, cost, audit and a digest of each conversation.

    SHA-256 takes its bytes in order, so a conversation's blocks meet in one task; they pass through it one by one.
    """
    small_batches(repaired.sparkSession)
    rows = repaired.repartition("conversation").sortWithinPartitions("conversation", "block")

    def digest(chat, parts: Iterator[dict]) -> tuple:
        sha, audit, sums, seen, last_turn, last_role, low, n = hashlib.sha256(), [], [0] * 5, 0, None, None, None, 0
        for r in parts:
            for role, text in zip(r["new_roles"], r["new_texts"]):
                sha.update(f"{chr(10) if n else ''}{role}:{text}".encode())
                n += 1
            audit.append(r["audit"])
            faults = ("n_blank", "n_duplicate", "n_truncated", "n_illegal", "cost")
            sums = [s + r[f] for s, f in zip(sums, faults)]
            if r["first_turn"] is not None:
                seen += r["n_turns"] - (r["first_turn"] == last_turn)
                low, last_turn = r["first_turn"] if low is None else low, r["last_turn"]
            if r["n_rows"]:
                sums[3] += last_role is not None and last_role + r["first_role"] not in ("su", "ua", "au")
                last_role = r["last_role"]
        gaps = 0 if low is None else last_turn - low + 1 - seen
        return (chat, gaps, *sums, "".join(audit), sha.hexdigest())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from itertools import groupby

        parts = (r for batch in batches for r in batch.to_pylist())
        out = []
        for chat, own in groupby(parts, lambda r: r["conversation"]):
            out.append(digest(chat, own))
            if len(out) == 1000:
                yield _batch(SUMMARY, out)
                out = []
        yield _batch(SUMMARY, out)

    return rows.mapInArrow(run, SUMMARY)


def damaged(rows: DataFrame) -> DataFrame:
    """Damages rows (conv_id, turn, role, text) by a hash of conversation and turn; ``gone`` marks those it drops."""
    c, space = F.col, F.lit(" ")
    key = F.concat(F.coalesce(c("conv_id").cast("string"), space), F.lit(":"),
                   F.coalesce(c("turn").cast("string"), space))
    rows = rows.select("conv_id", "turn", F.coalesce("role", space).alias("role"),
                       F.coalesce("text", space).alias("text"), (F.crc32(key.cast("binary")) % 20).alias("fault"))
    text = F.when(c("fault") == 1, "").when(c("fault") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(c("text"))
    copies = F.explode(F.sequence(F.lit(1), F.when(c("fault") == 3, 2).otherwise(1))).alias("copy")
    return rows.select("conv_id", "turn", F.when(c("fault") == 4, "user").otherwise(c("role")).alias("role"),
                       text.alias("text"), (c("fault") == 0).alias("gone"), copies)
