"""Conversation repair, token alignment and compressed shards against plain versions, on awkward and random rows."""

from __future__ import annotations

import hashlib
import heapq
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from geosieve.llm import conversation_repair, grammar_files, token_alignment
from geosieve.llm.conversation_repair import repair, summary
from geosieve.llm.grammar_files import Shard, joined_crc, read_documents, read_ids, re_pair, write_shards
from geosieve.llm.ordered import exclusive_scan
from geosieve.llm.token_alignment import align_documents
from tests.llm.reference import sha
from tests.llm.test_operators import awkward, by_id, docs, none  # noqa: F401

BPE, PIECES, WORDS = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model",
                                                          "word_bpe_49k.json"))
SPACE = " \t\n\x0b\x0c\r"


def repaired(rows: list[tuple]) -> tuple:
    """Faults, cost, audit and digest of one conversation's rows (turn, role, text), by a search for the cheapest path."""
    rows = [(t, r or " " if r is None else r, " " if x is None else x) for t, r, x in rows]
    rows.sort(key=lambda r: ((0, 0) if r[0] is None else (1, r[0]), r[1], hashlib.sha256(r[2].encode()).digest()))
    seen, kinds = set(), []
    for _, role, text in rows:
        kinds.append("blank" if not text.strip(SPACE) else "duplicate" if (role, text) in seen else
                     "truncated" if text.rstrip(SPACE)[-1] not in ".!?" else "")
        seen.add((role, text))
    step = {("", "s"): "s", ("", "u"): "u", ("s", "u"): "u", ("u", "a"): "a", ("a", "u"): "u"}
    queue, done = [(0, "", 0, "", ())], set()
    while queue:
        cost, audit, i, state, out = heapq.heappop(queue)
        if i == len(rows) and state in ("", "a"):
            break
        if (i, state) in done:
            continue
        done.add((i, state))
        for name in ("user", "assistant"):
            if (state, name[0]) in step:
                heapq.heappush(queue, (cost + 2, audit + "I", i, name[0], (*out, f"{name}:")))
        if i == len(rows):
            continue
        _, role, text = rows[i]
        heapq.heappush(queue, (cost + 3, audit + "D", i + 1, state, out))
        if kinds[i] in ("", "truncated"):
            extra = kinds[i] == "truncated"
            if (state, role[:1]) in step:
                heapq.heappush(queue, (cost + extra, audit + "K", i + 1, role[:1], (*out, f"{role}:{text}")))
            for name in ("user", "assistant"):
                if (state, name[0]) in step:
                    heapq.heappush(queue, (cost + 2 + extra, audit + "R", i + 1, name[0], (*out, f"{name}:{text}")))
    turns = {t for t, *_ in rows if t is not None}
    gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
    first = [r[1][:1] for r in rows]
    illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(first, first[1:]))
    return (gaps, *[kinds.count(k) for k in ("blank", "duplicate", "truncated")], illegal, cost, audit,
            sha("\n".join(out)))


def conversations() -> list[tuple]:
    r, rows = random.Random(3), []
    texts = ["Yes.", "No", "", " \t", "Why?", "well ", None, "é!", "So.\n"]
    roles = ["user", "assistant", "system", "user", "assistant", None, "tool", "", "umpire", "User"]
    for chat in [*range(60), None]:
        for turn in range(r.randrange(1, 14)):
            rows.append((chat, r.choice([turn, turn, turn, None, turn * 3]), r.choice(roles), r.choice(texts)))
    rows += [(100, i, r.choice(roles), r.choice(texts) if i % 3 else f"{i}.") for i in range(2700)]
    rows += [(101, 5, "user", "Same.")] * 1500 + [(102, i, "assistant", "x" * 5000 + f" {i}.") for i in range(300)]
    return rows


def expected_repairs(rows: list[tuple]) -> dict:
    chats = defaultdict(list)
    for chat, *row in rows:
        chats[chat].append(tuple(row))
    return {chat: repaired(own) for chat, own in chats.items()}


ROWS = "conv_id long, turn long, role string, text string"


def test_conversation_repair(spark):
    rows = conversations()
    random.Random(1).shuffle(rows)
    frame = spark.createDataFrame([(*r, "x", "y", 1) for r in rows], ROWS + ", conversation string, block string, gone int")
    got = {r.conv_id: tuple(r)[1:] for r in summary(repair(frame.repartition(5))).collect()}
    want = expected_repairs(rows)
    assert got.keys() == want.keys()
    assert [c for c in want if got[c] != want[c]] == []


def test_conversation_repair_keeps_conversations_without_rows(spark):
    frame = spark.createDataFrame([(1, 0, "user", "a.", True), (2, 0, "user", "a.", False), (2, 1, "user", "b.", True)],
                                  ROWS + ", gone boolean")
    got = {r.conv_id: tuple(r)[1:] for r in summary(repair(frame, gone="gone")).collect()}
    assert got == {1: (0, 0, 0, 0, 0, 0, "", sha("")), 2: (0, 0, 0, 0, 0, 2, "KI", sha("user:a.\nassistant:"))}
    assert summary(repair(spark.createDataFrame([], ROWS))).count() == 0


def test_repaired_texts(spark):
    rows = [(1, 0, "system", "S."), (1, 1, "assistant", "A."), (1, 2, "assistant", "A."), (1, 3, "user", "U.")]
    row = repair(spark.createDataFrame(rows, ROWS)).first()
    assert (row.audit, row.cost) == ("KIKDKI", 7)
    assert list(zip(row.new_roles, row.new_texts)) == [("system", "S."), ("user", ""), ("assistant", "A."), ("user", "U."),
                                                       ("assistant", "")]


def test_ranks_follow_the_audits():
    """Ranks of all nodes sort like their least audits, read by following the arcs."""
    r = random.Random(8)
    blocks = conversation_repair.Blocks([bytes([*(r.choice([0, 1, 2, 3, 5, 9, 10]) for _ in range(n)), 16])
                                         for n in (0, 1, 5, 30)])
    blocks.rank(np.zeros((4, 4), np.int64))

    def audit(node: int) -> str:
        out = ""
        while not blocks.dead[node]:
            out, node = out + "DIKR"[blocks.letter[node]], blocks.pointers[0][node]
        return out

    for path, first in zip(blocks.path(np.zeros(4, int)), blocks.first):
        assert "".join("DIKR"[step[0]] for step in path) == audit(4 * first)
        assert blocks.length[4 * first] == len(path)


@pytest.mark.parametrize("reverse", [False, True])
def test_scan(spark, reverse):
    r = random.Random(5)
    sizes = {7: 30, 8: 1, 9: 4}
    values = {(g, i): [r.randrange(2, 9), r.randrange(9)] for g, n in sizes.items() for i in range(n)}
    frame = spark.createDataFrame([(*k, v) for k, v in values.items()], "group long, idx long, value array<long>")
    mod = 10_007
    found = exclusive_scan(frame, lambda d, v: np.array([d[0] * v[0] % mod, (d[1] * v[0] + v[1]) % mod]),
                           lambda s, v: (s * v[0] + v[1]) % mod, [5], reverse, fan=3)
    want = {}
    for g, n in sizes.items():
        state = 5
        for i in sorted(range(n), reverse=reverse):
            want[g, i] = state
            state = (state * values[g, i][0] + values[g, i][1]) % mod
    assert {(x.group, x.idx): x.state[0] for x in found.collect()} == want


def alignments(texts: dict[int, str | None]) -> dict[int, tuple]:
    """The measures of all documents, token by token."""
    a, b = Tokenizer.from_file(BPE), sentencepiece.SentencePieceProcessor(model_file=PIECES)
    a.encode_special_tokens = True
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    byte = {chr(x): x for x in plain} | {chr(256 + i): x for i, x in enumerate(x for x in range(256) if x not in plain)}
    links, shown = {}, {}
    for d, text in texts.items():
        links[d], shown[d] = [], (0, 0, 0, "")
        if not text:
            continue
        one = [(i, bytes(byte[c] for c in a.id_to_token(i))) for i in a.encode(" " + text, add_special_tokens=False).ids]
        two = [(i, bytes([int(p[3:5], 16)]) if b.is_byte(i) else p.replace("▁", " ").encode())
               for i in b.encode(text) for p in [b.id_to_piece(i)]]
        whole = (" " + text).encode()
        if any(b"".join(x for _, x in side) != whole for side in (one, two)):
            continue
        place, groups, group, i, j, x, y = 0, [], ([], []), 0, 0, len(one[0][1]), len(two[0][1])
        while place < len(whole):
            links[d].append((one[i][0], two[j][0]))
            place = min(x, y)
            ended = place == x, place == y
            if ended[0]:
                group[0].append(str(one[i][0]))
                i += 1
                x += len(one[i][1]) if i < len(one) else 0
            if ended[1]:
                group[1].append(str(two[j][0]))
                j += 1
                y += len(two[j][1]) if j < len(two) else 0
            if all(ended):
                groups.append("|".join(",".join(g) for g in group))
                group = ([], [])
        shown[d] = (len(one), len(two), len(groups), sha(";".join(groups)))
    count = Counter(p for own in links.values() for p in set(own))
    top: dict[int, int] = {}
    for (x, _), n in count.items():
        top[x] = max(top.get(x, 0), n)
    return {d: (*shown[d][:3], len(own), sum(count[p] == top[p[0]] for p in own), sum(count[p] for p in own), shown[d][3])
            for d, own in links.items()}


@pytest.mark.parametrize("broadcast_rows", [0, 1_000_000])
def test_alignment(docs, none, broadcast_rows):  # noqa: F811
    texts = dict(awkward())
    assert by_id(align_documents(docs, BPE, PIECES, broadcast_rows=broadcast_rows)) == alignments(texts)
    assert align_documents(none, BPE, PIECES).count() == 0


def test_alignment_of_repeated_rows(spark):
    texts = ["the same text", "the same text", None, "other  text <s> <|endoftext|>", "the  ▁ sign", "ﬁ\x00\r\n", "x"]
    frame = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "the same text")] + [(1, texts[1])] * 2,
                                  "doc_id long, text string")
    got = align_documents(frame, BPE, PIECES).collect()
    want = alignments(dict(enumerate(texts)) | {-1: texts[0], -2: texts[0], -3: texts[0]})
    assert sorted((-1 if r[0] is None else r[0], *tuple(r)[1:]) for r in got) == sorted(
        (i if i >= -1 else 1, *x) for i, x in want.items())


def test_alignment_of_a_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    assert by_id(align_documents(frame, BPE, PIECES)) == alignments({r.doc_id: r.text for r in frame.collect()})


def expected_ids(rows: list[tuple[int | None, str | None]]) -> list[tuple]:
    library, out, start = Tokenizer.from_file(WORDS), [], 0
    for d, text in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        ids = np.array([*library.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        out.append((d, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    return out


def test_shards(docs, none):  # noqa: F811
    got = read_documents(write_shards(docs, WORDS))
    assert sorted(map(tuple, got.collect())) == expected_ids(awkward())
    assert read_documents(write_shards(none, WORDS)).count() == 0


def test_shards_smaller_than_documents(docs):  # noqa: F811
    shards = write_shards(docs, WORDS, shard_ids=997)
    assert sorted(map(tuple, read_documents(shards).collect())) == expected_ids(awkward())
    assert shards.agg({"n_ids": "max"}).first()[0] == 997


def test_shards_of_a_table(spark, sf):
    frame = spark.read.parquet(f"{sf}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in frame.select("doc_id", "text").collect()]
    shards = write_shards(frame, WORDS)
    assert sorted(map(tuple, read_documents(shards).collect())) == expected_ids(rows)
    library, texts = Tokenizer.from_file(WORDS), dict(rows)
    some = [r[0] for r in rows[5:9]]
    for row in read_ids(shards, some).collect():
        assert row.ids == [*library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids, 1]
    for row in read_ids(shards, some, 3, 20).collect():
        assert row.ids == [*library.encode(texts[row.doc_id] or "", add_special_tokens=False).ids, 1][3:20]
    assert read_ids(shards, []).count() == 0


def test_shards_of_repeated_rows_and_null_ids(spark):
    rows = [(None, "a b"), (None, None), (4, "same text"), (4, "same text"), (-3, "low"), (7, "x" * 3000)] + [(9, "r")] * 50
    got = read_documents(write_shards(spark.createDataFrame(rows, "doc_id long, text string"), WORDS, shard_ids=40))
    got = sorted(map(tuple, got.collect()), key=lambda r: r[1])
    assert Counter((d, n, crc) for d, _, n, crc in got) == Counter((d, n, crc) for d, _, n, crc in expected_ids(rows))
    assert [r[0] for r in got] == [None, None, -3, 4, 4, 7] + [9] * 50
    assert [r[1] for r in got] == [0, *np.cumsum([r[2] for r in got])[:-1].tolist()]


def test_word_encoder_is_the_library():
    r = random.Random(6)
    library, encode = Tokenizer.from_file(WORDS), grammar_files.encoder(WORDS)
    alphabet = "aB1'st é́ \u0085 　\x1c\x1f\t\n İΣσß日<|>_-.​\U0001F600ﬁ"
    texts = ["".join(r.choice(alphabet) for _ in range(r.randrange(60))) for _ in range(3000)]
    latin = [chr(c) for c in [*range(1, 0x250), *range(0x2010, 0x2060), *range(0x20A0, 0x20C0)]]
    texts += ["".join(r.choice(latin) for _ in range(30)) for _ in range(3000)] + latin
    texts += ["a<|endoftext|>b", "<|startoftext|>", "don't WE'LL 'S", ""]
    for text, ids in zip(texts, encode(texts)):
        assert ids == np.array(library.encode(text, add_special_tokens=False).ids, "<u4").tobytes(), repr(text)


def test_word_encoder_is_the_library_on_a_table(spark):
    texts = [r.text for r in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("text").collect() if r.text]
    library, encode = Tokenizer.from_file(WORDS), grammar_files.encoder(WORDS)
    assert encode(texts) == [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]


def test_word_encoder_takes_all_new_words_at_once(monkeypatch):
    r = random.Random(8)
    word = lambda: "".join(r.choice("abcdeéß'st,.-17ÅÉȺ") for _ in range(r.randrange(1, 9)))
    words = [word() for _ in range(2000)] + ["don't", "'re", "x''s", "it'll've", "'d1'm", "<|ENDOFTEXT|>"]
    texts = [" \n".join(r.choices(words, k=r.randrange(40))) + r.choice(["", " "]) for _ in range(400)] + ["", "  ", "日 a"]
    library, encode, calls = Tokenizer.from_file(WORDS), grammar_files.WordEncoder(WORDS), []
    fast = encode.fast

    class Fast:
        def encode_to_numpy(self, text):
            calls.append(text)
            return fast.encode_to_numpy(text)

    encode.fast = Fast()
    expected = [np.array(library.encode(t, add_special_tokens=False).ids, "<u4").tobytes() for t in texts]
    assert encode(texts) == expected and len(calls) == 1
    assert encode(texts[::-1]) == expected[::-1] and len(calls) == 1
    monkeypatch.setattr(grammar_files, "KEPT_CHARACTERS", 10)
    assert encode(texts[7:]) == expected[7:] and len(calls) == 2
    assert encode([]) == []


def test_re_pair_when_pairs_share_buckets(monkeypatch):
    r = np.random.default_rng(5)
    ids, begins = (r.zipf(1.3, 30_000) % 700).astype(np.uint32), r.random(30_000) < 0.01
    apart = re_pair(ids, begins, 700)
    monkeypatch.setattr(grammar_files, "BUCKET_BITS", 5)
    assert all((a == b).all() for a, b in zip(apart, re_pair(ids, begins, 700), strict=True))


def test_re_pair_round_trip():
    r = np.random.default_rng(2)
    for n, kinds in ((1, 3), (50, 1), (5000, 2), (40_000, 300), (3000, 2900)):
        ids = (r.zipf(1.4, n) % kinds).astype(np.uint32)
        sizes = np.diff(np.unique(np.concatenate([[0, n], r.integers(0, n + 1, 20)])))
        entries = np.zeros(len(sizes), grammar_files._ENTRY)
        entries["ids"] = sizes
        shard = Shard(Shard.bytes_of(ids, entries, 3000))
        assert (shard.expand(shard.symbols) == ids).all()
        at = np.cumsum(sizes) - sizes
        for i in range(0, len(sizes), 3):
            a, b = sorted(r.integers(0, sizes[i] + 1, 2))
            assert (shard.ids(i, a, b) == ids[at[i] + a:at[i] + b]).all()
            assert (shard.ids(i) == ids[at[i]:at[i] + sizes[i]]).all()
    begins = np.zeros(4000, bool)
    begins[::100] = True
    symbols, first, rules = re_pair(np.tile(np.arange(4), 1000), begins, 4)
    assert len(symbols) <= 400 and first.sum() == 40 and len(rules) >= 2


def test_joined_crc():
    for a, b in ((b"", b"x"), (b"abc", b""), (b"hello ", b"world" * 999)):
        assert joined_crc(zlib.crc32(a), zlib.crc32(b), len(b)) == zlib.crc32(a + b)
