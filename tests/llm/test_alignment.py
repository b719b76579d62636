"""Cross-tokenizer alignment against a brute-force version."""

import collections
import hashlib
import random

import public_tokenizers
import pytest
import sentencepiece
from tokenizers import Tokenizer

from attesta.llm import alignment
from attesta.llm.pieces import read_model

A = read_model(public_tokenizers.path("byte_bpe_50k.json"))
B = read_model(public_tokenizers.path("piece_bpe_32k.model"))
DOCS = "doc_id long, text string, PAIRS_ string, `a.b` int"


def brute(texts):
    """Rows in order, from the libraries and plain loops."""
    first = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    first.encode_special_tokens = True
    second = sentencepiece.SentencePieceProcessor(model_proto=B)
    letter = alignment.byte_level_letters()

    def bytes_a(i):
        return bytes(letter[c] for c in first.id_to_token(i))

    def bytes_b(i):
        piece = second.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if second.is_byte(i) else piece.replace("▁", " ").encode()

    rows = []
    for text in texts:
        a = [(i, bytes_a(i)) for i in first.encode(" " + (text or ""), add_special_tokens=False).ids]
        b = [(i, bytes_b(i)) for i in second.encode(text or "")]
        want = b" " + (text or "").encode()
        if not text or b"".join(x for _, x in a) != want or b"".join(x for _, x in b) != want:
            rows.append(None)
            continue
        spans = []
        for side in (a, b):
            at, out = 0, []
            for i, x in side:
                out.append((i, at, at + len(x)))
                at += len(x)
            spans.append(out)
        links = [(x[0], y[0]) for x in spans[0] for y in spans[1] if x[1] < y[2] and y[1] < x[2]]
        ends = sorted({x[2] for x in spans[0]} & {y[2] for y in spans[1]})
        groups, begin = [], 0
        for end in ends:
            groups.append("|".join(",".join(str(i) for i, s, e in side if begin <= s and e <= end)
                                   for side in spans))
            begin = end
        rows.append((len(a), len(b), len(groups), links, ";".join(groups)))
    counts = collections.Counter(p for r in rows if r for p in set(r[3]))
    top = collections.defaultdict(int)
    for (a, _), n in counts.items():
        top[a] = max(top[a], n)
    return [(0, 0, 0, 0, 0, 0, "") if r is None else (
        *r[:3], len(r[3]), sum(counts[p] == top[p[0]] for p in r[3]),
        sum(counts[p] for p in r[3]), hashlib.sha256(r[4].encode()).hexdigest()) for r in rows]


def texts():
    r = random.Random(8)
    odd = [None, "", " ", "\n\n  \t", "▁", "x ▁ y", "<|endoftext|> a", "<s></s><unk>", "🙂🙃 née",
           "a" * 400, "日本語 テキスト", "same text", "same text", "\x00 \x01", "  two  spaces ", "é"]
    words = "aa a ab the Der été naïve 12 3456 don't. <0x41> ()[] Straße über".split()
    return odd + [" ".join(r.choice(words) for _ in range(r.randint(1, 30))) for _ in range(30)]


@pytest.mark.parametrize("frequent", [0, 40, 1 << 18])
def test_equals_brute_force(spark, frequent):
    given = texts()
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(given)], DOCS)
    got = {r["doc_id"]: tuple(r)[1:] for r in
           alignment.align(docs.repartition(3), A, B, frequent=frequent).collect()}
    want = brute(given)
    assert [got[i] for i in range(len(given))] == want
    assert want[4][0] == 0 and want[6][0] > 0  # a mark in the text; special strings are text


def test_chunks_and_flushes_change_nothing(spark, monkeypatch):
    given = texts() + [" ".join(str(i) for i in range(4000))]
    docs = spark.createDataFrame([(i, t, "clash", i) for i, t in enumerate(given)], DOCS)
    whole = sorted(map(tuple, alignment.align(docs, A, B, keep=("doc_id", "a.b")).collect()))
    monkeypatch.setattr(alignment, "CHUNK_BYTES", 5)
    monkeypatch.setattr(alignment, "HELD_PAIRS", 3)
    small = alignment.align(docs.repartition(4), A, B, keep=("doc_id", "a.b"), frequent=5).collect()
    assert sorted(map(tuple, small)) == whole


def test_identity_prefers_whole_pieces():
    own = alignment.Aligner(A, B)
    for a, b in enumerate(own.identity):
        assert b < 0 or own.a.bytes[a] == own.b.bytes[b]
    letter = next(i for i, x in enumerate(own.a.bytes) if x == b"A")
    assert own.b.plain[own.identity[letter]]


def test_empty_tables_and_clashes(spark):
    docs = spark.createDataFrame([(None, "a text"), (1, None), (1, None)], "doc_id long, text string")
    assert alignment.align(docs.limit(0), A, B).count() == 0
    got = sorted(map(tuple, alignment.align(docs, A, B).collect()), key=str)
    assert len(got) == 3 and got[0][1:] == (0, 0, 0, 0, 0, 0, "") and got[2][0] is None
    with pytest.raises(ValueError):
        alignment.align(docs.withColumnRenamed("doc_id", "N_best"), A, B, keep=("N_best",))


def test_rank_form_and_file_form_agree():
    own = alignment.ByteLevel(A)
    assert own.ranked is not None
    r = random.Random(2)
    letters = "ab'tsdlmrev  \n\t.,;0123456789éüß×÷ª²½—“”…  ​́Ω日🙂\x00\x7f\x85"
    given = ["".join(r.choice(letters) for _ in range(r.randint(0, 40))) for _ in range(400)]
    given += ["a" * 399, "a" * 401, " " * 399, " " * 500, "I'll we'VE don't", "\n\n\nx", "x   \n y"]
    direct = [e.ids for e in own.tokenizer.encode_batch([" " + t for t in given],
                                                        add_special_tokens=False)]
    assert own.encode(given) == direct
    assert any(map(own._plain, given)) and not all(map(own._plain, given))
