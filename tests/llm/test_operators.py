"""Each operator on nulls, empty and long texts, ties, repeated rows, no rows and clashing columns, by brute force."""

from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from geosieve.llm import chat, language_id, license_scan, sentence_pieces, substring_dedup, toxicity
from geosieve.llm.components import components
from geosieve.llm.fingerprints import Fingerprint, edited_fingerprints, fingerprints, likeness, parse
from geosieve.llm.near_dedup import near_duplicates
from geosieve.llm.packing import pack, sum_of_squares, token_pieces
from geosieve.llm.quality import quality_rules
from geosieve.llm.substring_dedup import remove_repeats
from tests.llm import reference

BPE, PIECES = (public_tokenizers.path(x) for x in ("byte_bpe_50k.json", "piece_bpe_32k.model"))
CLASHING = ("_text, lang, source, n_chars, _words, n_words, key, id, score, label, words, _key, _at, h, hot, component, "
            "piece, length, ids, _guest, text_, signature, n").split(", ")
SCHEMA = "doc_id long, text string, " + ", ".join(f"`{c}` string" for c in CLASHING)


def awkward() -> list[tuple[int, str | None]]:
    r = random.Random(4)
    words = [f"w{i}" for i in range(400)]
    prose = " ".join(r.choice(words) for _ in range(300)) + "."
    edited = prose.split(" ")
    edited[7] = edited[150] = "other"
    passage = " ".join(f"p{i}" for i in range(70))
    long = " ".join(f"{r.choice(words)}{i % 977}" for i in range(60_000))
    texts = [None, "", " \t\n", "one", "ONE", "one two", "a a a a a a a a a a a a", prose, prose, prose.upper(),
             " ".join(edited), passage + " tail one", "head " + passage, passage.replace("p35", "q"), long, long + " x",
             "é" * 30 + " ß 日本 \U0001F600 <|endoftext|> \x00 \x1c \u00a0 \u2028 end", "line\n\nline\nline \n\n",
             "Licensed under the MIT License. Licenced under the Apache Licence, Version 2.0", passage, "\\</turn> <turn"]
    return list(enumerate(texts, 3))


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, *["x"] * len(CLASHING)) for i, t in awkward()]
    return spark.createDataFrame(rows, SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def by_id(df):
    return {r.doc_id: tuple(r)[1:] for r in df.collect()}


def test_fingerprints(docs, none):
    got, rows = by_id(edited_fingerprints(docs)), awkward()
    plain = by_id(fingerprints(docs))
    for (i, t), (_, after) in zip(rows, rows[1:] + rows[:1]):
        t, after = t or "", after or ""
        edited = t[:len(t) - len(t) // 2] + after[:len(t) // 2]
        own, other = parse([t.encode()])[0], parse([edited.encode()])[0]
        assert got[i] == (len(t), reference.sha(edited), str(own), str(other), likeness(own, other),
                          likeness(own, parse([after.encode()])[0]))
        assert plain[i] == (str(own),) and str(Fingerprint.read(str(own))) == str(own)
    assert edited_fingerprints(none).count() == fingerprints(none).count() == 0


def test_fingerprints_of_equal_substrings():
    r = random.Random(2)
    text = bytes(r.choice(b"abcdefgh ") for _ in range(4000))
    a, b, c = parse([b"xyz" + text, text + b"12345" * 7, bytes(r.choice(b"abcdefgh ") for _ in range(4000))])
    assert likeness(a, b) > 0.9 and likeness(a, c) < 0.05 and likeness(parse([b""])[0], a) == 0


def test_one_document_is_its_own_next(spark):
    row = edited_fingerprints(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert row.edited_sha256 == reference.sha("abcabc") and row.near_next == 1


def turns_of(df):
    return {(r.conversation, r.message, r.nth): (r.role, r.text) for r in df.collect()}


LOG = "conversation long, message long, seq long, kind string, role string, text string"


def test_chat_events(spark):
    events = [(1, 0, 0, "message", "user", "hi"), (1, 1, 0, "message", "assistant", "dra"), (1, 1, 1, "delta", None, "ft"),
              (1, 1, 2, "regenerate", None, None), (1, 1, 3, "delta", None, "fin"), (1, 1, 4, "delta", None, "al"),
              (1, 2, 0, "message", "user", None), (1, 2, 1, "edit", None, "edited"), (2, 0, 5, "delta", None, "lone"),
              (None, 0, 0, "message", None, "x")]
    random.Random(1).shuffle(events)
    got = turns_of(chat.format_chats(spark.createDataFrame(events, LOG).repartition(4)))
    assert got == {(1, 0, 0): ("user", "hi"), (1, 1, 0): ("assistant", "final"), (1, 2, 0): ("user", "edited"),
                   (2, 0, 0): ("assistant", "lone"), (None, 0, 0): ("", "x")}


def test_chat_round_trip():
    r = random.Random(1)
    parts = ["\\", "<turn", "</turn", "\n", ">", "a", "</turn>\n", "<turn user>\n", "### Assistant: "]
    for _ in range(3000):
        text, role = ("".join(r.choice(parts) for _ in range(r.randint(0, 8))) for _ in range(2))
        formatted, start, size = chat.render(role, text)
        both = formatted + chat.render("assistant", text)[0]
        cut, reader = r.randint(0, len(both)), chat.Reader()
        assert reader.feed(both[:cut]) + reader.feed(both[cut:]) == [(role, text), ("assistant", text)]
        piece, start, size = chat.render("assistant", text)
        assert chat.unescape(piece[start:start + size]) == text


def test_chat_digests(spark):
    rows = [(1, 0, "user", None), (1, 1, "assistant", "é" * 900), (1, 1, "assistant", "é" * 900), (1, 2, "system", ""),
            (None, 0, "user", "x"), (2, None, None, "y")]
    rows = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    got = {r.conv_id: r for r in chat.read_back(chat.format_chats(chat.streamed(rows))).collect()}
    one = "user\n\n" + f"assistant\n{'é' * 900}\n" * 2 + "system\n\n"
    assert got[1].turns_sha256 == reference.sha(one) and got[1].n_turns == 4 and got[1].loss_chars == 1800
    assert got[1].loss_sha256 == reference.sha("é" * 1800) and got[2].turns_sha256 == reference.sha("\ny\n")
    assert len(got) == 3 and chat.read_back(chat.format_chats(chat.streamed(rows.limit(0)))).count() == 0


def test_cover():
    assert {(a - b) % substring_dedup.PERIOD for a in substring_dedup.COVER for b in substring_dedup.COVER} == set(
        range(substring_dedup.PERIOD))


@pytest.mark.parametrize("floor", [1, 20_000])
def test_substring_dedup(docs, none, floor):
    got, expected = by_id(remove_repeats(docs, floor=floor)), reference.repeats(awkward())
    assert {i: x[:3] for i, x in got.items()} == expected
    assert all(reference.sha(x[3]) == x[2] for x in got.values() if x[3] is not None)
    assert remove_repeats(none).count() == 0


def test_substring_dedup_random(spark):
    r = random.Random(8)
    base = [[f"{k}_{r.randint(0, 9)}" for _ in range(400)] for k in range(3)]
    texts = []
    for _ in range(60):
        words = []
        for _ in range(r.randint(1, 4)):
            b = r.choice(base)
            at, n = r.randint(0, 330), r.randint(30, 70)
            words += b[at:at + n] + ["z"] * r.randint(0, 2)
        texts.append(" ".join(words))
    rows = list(enumerate(texts)) + [(0, texts[0])]
    got = remove_repeats(spark.createDataFrame(rows, "doc_id long, text string").repartition(5)).collect()
    expected = reference.repeats(rows[:-1])
    assert len(got) == 61 and all(tuple(r)[1:4] == expected[r.doc_id] for r in got)


def test_license_scan(docs, none):
    got = by_id(license_scan.scan_licenses(docs))
    for i, text in awkward():
        assert got[i][:5] == reference.license_base(text, license_scan.PHRASES)
    assert [r for r in got.values() if r[5]] == [got[21]] and got[21][5] == "apache,mit" and got[21][4] == "mit"
    assert license_scan.scan_licenses(none).count() == 0


def test_license_edits():
    r, notices = random.Random(1), tuple(license_scan.NOTICES.items())
    for _ in range(300):
        i = r.randrange(len(notices))
        text, edits = list(notices[i][0]), r.randint(0, license_scan.edits_of(notices[i][0]))
        for _ in range(edits):
            at = r.randrange(1, len(text) - 1)
            text[at:at + r.randint(0, 1)] = r.choice(["q", "", "z"])
        found = license_scan.find_notices("ab " * r.randint(0, 5) + "".join(text) + " cd" * r.randint(0, 3), notices)
        assert any(f[0] == i and f[3] <= 2 * edits for f in found)


def test_language_id(spark, docs, none):
    model = language_id.fit(none.select("doc_id", "text", "lang"), ~language_id.held_out())
    assert model.predict("some text") == ("und", 0.0)
    rows = docs.select("doc_id", language_id.predicted(model, docs.text).alias("p")).collect()
    assert len(rows) == len(awkward()) and all(r.p.lang_pred == "und" for r in rows)


def test_language_id_accuracy(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text", "lang")
    model = language_id.fit(docs, ~language_id.held_out())
    rows = docs.where(language_id.held_out()).select(
        "lang", language_id.predicted(model, docs.text).alias("p")).collect()
    assert np.mean([r.lang == r.p.lang_pred for r in rows]) > 0.95
    assert all(0 <= r.p.score <= 1 for r in rows)
    assert [model.predict(t)[0] for t in (None, "", " 12 ... ")] == ["und"] * 3


def test_temperature_and_sparsity():
    logits, truth = np.array([[4.0, 0], [4, 0], [0, 4], [4, 0]]), np.array([0, 0, 1, 1])
    assert language_id.temperature(logits, truth) > 2
    rows = [(np.array([y, 3]), np.ones(2), y) for y in (0, 1)] * 50
    weights = language_id.follow_the_leader(rows, 2, 5)
    assert (weights[2] == 0).all() and weights[0, 0] > 0 > weights[0, 1]


@pytest.fixture(scope="module")
def toxic_model(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    labels = spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    return toxicity.fit(docs, labels, ~language_id.held_out("doc_id", 4, 2))


def test_toxicity_restores(toxic_model):
    for disguised, plain in (("1d1ot", "idiot"), ("i d i o t", "idiot"), ("stuuupid", "stupid"), ("tr4sh", "trash"),
                             ("l-o-s-e-r", "loser"), ("st.up.id", "stupid"), ("w0rthl3ss", "worthless")):
        assert toxic_model.restore(f"the {disguised} of".encode()).decode() == f"the {plain} of"


def test_toxicity_searches_suspicious_parts_only(toxic_model):
    r = random.Random(6)
    parts = ["the", "a", " ", " ", "1", "$", "x", "aaa", ".", "-", "\n", "é", "!", "_", "i d i o t", "word" * 30]
    for _ in range(2000):
        text = "".join(r.choice(parts) for _ in range(r.randint(0, 40)))
        whole = toxicity.DISGUISED.sub(toxic_model._restored, text.encode().lower().decode())
        assert toxic_model.restore(text.encode()).decode() == whole, text


def test_toxicity_accuracy(spark, toxic_model):
    docs, labels = (spark.read.parquet(f"/root/testdata/sf0.1/{t}.parquet") for t in ("documents", "labels"))
    held = language_id.held_out("doc_id", 4, 2)
    model = toxicity.fit(docs, labels, ~held)
    rows = docs.join(labels, "doc_id").where(held).select("toxic", toxicity.scored(model, docs.text).alias("s")).collect()
    high, low = ([r.s for r in rows if r.toxic == y] for y in (1, 0))
    assert np.mean([s >= toxicity.THRESHOLD for s in high]) > 0.85
    assert np.mean([s < toxicity.THRESHOLD for s in low]) > 0.95
    assert toxic_model.score(None) == toxic_model.score("") < toxicity.THRESHOLD


def test_toxicity_learns_rare_words(spark):
    # in 14 of 3000 rows, which are all the toxic ones
    rows = [(i, f"plain words number {i} of many" + " zorgle" * (i % 214 == 1), int(i % 214 == 1)) for i in range(2996)]
    rows = spark.createDataFrame(rows, "doc_id long, text string, toxic int")
    model = toxicity.fit(rows.select("doc_id", "text"), rows.select("doc_id", "toxic"), rows.doc_id >= 0)
    assert model.score("such a zorgle") >= toxicity.THRESHOLD > model.score("plain words")


def test_toxicity_without_labels(spark, docs, none):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    for rows in (docs, none):
        model = toxicity.fit(rows, labels, ~language_id.held_out("doc_id", 4, 2))
        assert {r[0] for r in rows.select(toxicity.scored(model, rows.text)).collect()} <= {0.0}


def test_viterbi_is_the_best_path(toxic_model):
    restorer = toxic_model.restorer

    def cost(read: list[tuple[str, float]]) -> float:
        total, x, y = 0.0, 0, 0
        for text, extra in [*read, (" ", 0.0)]:
            total += extra
            for ch in text:
                z = ord(ch) - 96 if ch != " " else 0
                if z or y:
                    total += restorer.cost[x][y][z]
                    x, y = y, z
        return total

    from itertools import product
    for place in ("1d1ot", "m0r0n", "a.b", "h3ll0", "xxxx"):
        best = min(product(*restorer.arcs(place)), key=cost)
        assert restorer.restore(place) == "".join(x for x, _ in best).strip()


def test_near_duplicates(docs, none):
    assert by_id(near_duplicates(docs)) == reference.near(awkward())
    assert near_duplicates(none).count() == 0


def test_near_duplicates_in_chains(spark):
    r = random.Random(3)
    words = [f"v{i}" for i in range(2000)]
    rows, group = [], [r.choice(words) for _ in range(150)]
    for i in range(120):  # each a little away from one before it, so groups are chains and bushes
        group = list(r.choice([group, [r.choice(words) for _ in range(150)]]) if i % 10 == 0 else group)
        for _ in range(r.randint(0, 5)):
            group[r.randrange(len(group))] = r.choice(words)
        rows.append((1000 - i, " ".join(group)))
    rows.append(rows[5])
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string").repartition(6)).collect()
    expected = reference.near(rows)
    assert len(got) == len(rows) and all(tuple(x)[1:] == expected[x.doc_id] for x in got)


def test_pipeline_keeps_scattered_edits(spark):
    import corpus_pipeline

    words = [f"w{i}" for i in range(200)]
    edited = ["other" + w if i % 30 == 15 else w for i, w in enumerate(words)]  # alike by two words, not by five
    late = [*words[:-2], "x", "y"]  # alike by five as well
    rows = [(1, " ".join(words)), (2, " ".join(edited)), (3, " ".join(late)), (4, "a b c"), (5, "A b c"), (6, "a b d")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = corpus_pipeline.drop_near_duplicates(spark, docs, "").collect()
    assert sorted(r.doc_id for r in got) == [1, 2, 4, 6]
    assert {r.doc_id for r in near_duplicates(docs).where("kept").collect()} == {1, 4, 6}


def test_components(spark):
    r = random.Random(5)
    links = [(i, i + 1) for i in range(60)] + [(r.randrange(100, 300), r.randrange(100, 300)) for _ in range(110)]
    links += [(7, 7), (None, 3), (500, 400)]
    root = {x: x for p in links for x in p if None not in p and p[0] != p[1]}
    for _ in range(400):
        for a, b in links:
            if a in root and b in root and a != b:
                root[a] = root[b] = min(root[a], root[b])
    got = components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted((x.id, x.component) for x in got) == sorted(root.items())


def test_quality(docs, none):
    got = by_id(quality_rules(docs))
    for i, text in awkward():
        assert got[i][:5] == reference.quality(text)
        n, repeat = got[i][0], got[i][4]
        assert got[i][8] == (n < 10 or 100 * repeat > 20 * n) and not (got[i][8] and got[i][9])
    assert quality_rules(none).count() == 0


def test_quality_lines(spark):
    good = "Here is a whole sentence with enough words in it, and one more.\n"
    menu = "Home | About | Contact | Help\nwe use a cookie\nALL THE WORDS ARE LOUD\n"
    rows = [(1, good * 3 + menu + "second good line of words ends here."), (2, good + menu * 4)]
    got = by_id(quality_rules(spark.createDataFrame(rows, "doc_id long, text string")))
    assert got[1][10] == good * 3 + "second good line of words ends here." and not got[2][9]


def test_sentence_pieces():
    model = sentence_pieces.Pieces(PIECES)
    names = {w: (i, s) for i, (w, s) in enumerate(zip(model.bytes_of, model.scores)) if i > 258}
    names = {w.replace(b" ", "▁".encode()): x for w, x in names.items()}
    r = random.Random(3)
    parts = ["a", "the", " ", "é", "日", "\U0001F600", "ß", "er", "\n", "\t", "   ", "ing", "▁"]
    for _ in range(400):
        text = "".join(r.choice(parts) for _ in range(r.randint(1, 12)))
        ids = b"".join(model.best([w.encode() for w in sentence_pieces.words_of(text)]))
        whole = reference.best_pieces(("▁" + text.replace(" ", "▁")).encode(), names, model.unknown)
        assert np.frombuffer(ids, "<u4").tolist() == whole
        assert model.decode(ids) == text.replace("▁", " ")


def test_sentence_pieces_rows(docs, none):
    rows = sentence_pieces.decode(sentence_pieces.encode(docs, PIECES), PIECES).collect()
    assert all(r.decoded == (r.text or "") for r in rows) and len(rows) == len(awkward())
    assert sentence_pieces.encode(none, PIECES).count() == 0


def test_packing(docs, none):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    tokenizer.encode_special_tokens = True
    pieces = pack(token_pieces(docs, BPE), group_pieces=40).toPandas()
    for i, text in awkward():
        ids = np.array([*tokenizer.encode(text or "", add_special_tokens=False).ids, 0], "<u4")
        own = pieces[pieces.doc_id == i].sort_values("piece")
        assert own.length.sum() == len(ids) and (own.length.iloc[1:] == 2048).all()
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32
    for _, own in pieces.groupby("sequence_id"):
        own = own.sort_values("offset")
        assert own.offset.tolist() == [0, *own.length.cumsum().tolist()[:-1]] and own.length.sum() <= 2048
    assert pack(token_pieces(none, BPE)).count() == 0


def test_packing_ids_are_the_tokenizers(spark, sf):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(BPE)
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    texts = {r.doc_id: r.text for r in docs.collect()}
    got = {}
    for r in token_pieces(docs, BPE).orderBy("doc_id", "piece").collect():
        got[r.doc_id] = got.get(r.doc_id, b"") + bytes(r.ids)
    for i, text in texts.items():
        ids = tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(got[i], "<u4").tolist() == [*ids, 0]


def test_packing_ids_of_added_tokens_and_long_gaps(spark, tmp_path):
    from tokenizers import Tokenizer

    from geosieve.llm.queries import op10

    tokenizer = Tokenizer.from_file(BPE)
    texts = ["a <|endoftext|> b", "<|endoftext|>", " <|endoftext|><|endoftext|>x", "x  <|endoftext|>\n y", "<|endoftext|",
             " " * 1_000_000 + "x", "a" + "\n" * 1_000_000 + "b c"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    got = op10(spark, str(tmp_path)).toPandas()
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        own = got[got.doc_id == i]
        assert own.length.sum() == len(ids)
        for p in own.itertuples():
            assert zlib.crc32(ids[p.start:p.start + p.length].tobytes()) == p.ids_crc32


def test_packing_groups_of_repeated_rows(spark):
    rows = spark.createDataFrame([(None, "one two")] * 2000 + [(7, "x")] * 1000, "doc_id long, text string").repartition(4)
    got = pack(token_pieces(rows, BPE), group_pieces=100).toPandas()
    assert len(got) == 3000
    assert np.bincount(got.sequence_id.to_numpy() >> 32).max() < 200


def test_sum_of_squares():
    lengths = np.sort(np.random.default_rng(1).integers(1, 101, 3000))[::-1]
    sequence, offset = sum_of_squares(lengths, 100)
    used = np.bincount(sequence, lengths)
    assert used.max() <= 100 and len(used) <= -(-lengths.sum() // 100) * 1.01 + 1
    assert all(offset[sequence == s].min() == 0 for s in range(5))


def test_equal_rows_and_null_ids(spark):
    text = "one two three four five six seven eight nine ten."
    rows = spark.createDataFrame([(1, text), (1, text), (2, text), (None, text), (None, None)],
                                 "doc_id long, text string")
    got = sorted(((r.doc_id, r.component_id, r.kept) for r in near_duplicates(rows).collect()), key=repr)
    assert got == sorted([(1, 1, True), (1, 1, True), (2, 1, False), (None, 1, False), (None, None, True)], key=repr)
    for count in (remove_repeats(rows).count(), quality_rules(rows).count(), edited_fingerprints(rows).count(),
                  pack(token_pieces(rows, BPE)).count()):
        assert count == 5
    assert hashlib.sha256(b"").hexdigest() == reference.sha("")
