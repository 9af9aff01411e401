"""Token counts, token files and chunked BPE against the libraries over whole texts."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pytest

from cellweave.llm import bpe, packing, tokens
from cellweave.llm.words import WordEncoder

WORD = public_tokenizers.path("word_bpe_49k.json")
PIECE = public_tokenizers.path("piece_bpe_32k.model")
SF = "/root/testdata/sf0.001"


def texts(spark):
    rng = random.Random(3)
    odd = [None, "", " ", "  ", "\n", "a", " a", "a ", "a  b", "▁x ▁", "x\0y z", "<s> </s> <unk>", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c", "tab\tx\r\ny\x0bz\x0c", "\x1c\x1d a\x85b\xa0c　d e", "é ́a İ ſß", "你好世界 \U0001f600\U0001f600", "it's we'll I'M 'S", "x" * 5000, "ab" * 3000 + " " + "é" * 4000, "    many     blanks   ", "a\nb\n\n c"]
    alphabet = "ab'  \n\t.,!1éÉ́世\U0001f600<|>\x1c\x85\xa0"
    odd += ["".join(rng.choice(alphabet) for _ in range(rng.randrange(200))) for _ in range(300)]
    real = [r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("text").collect()]
    odd += ["  ".join(real[:40]), "\n".join(real[:60] * 3)] + real + real[:5]
    return odd


@pytest.fixture(scope="module")
def docs(spark):
    rows = list(enumerate(texts(spark)))
    random.Random(1).shuffle(rows)
    return spark.createDataFrame([(i, t, "clash", 1) for i, t in rows], "doc_id long, text string, n_tokens string, start int")


def whole_ids(text):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(WORD)
    t.no_truncation()
    t.no_padding()
    return [t.encode(x or "", add_special_tokens=False).ids for x in text], t


def test_counts(spark, docs):
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECE)
    got = {r.doc_id: (r.n_bytes, r.n_tokens) for r in tokens.count_tokens(docs, PIECE).collect()}
    for r in docs.collect():
        assert got[r.doc_id] == (len((r.text or "").encode()), len(sp.encode(r.text or ""))), repr(r.text)[:80]
    assert tokens.count_tokens(docs.limit(0), PIECE).count() == 0


def test_counter_forgets(monkeypatch):
    monkeypatch.setattr(tokens, "REMEMBER", 3)
    c = tokens.PieceCounter(PIECE)
    want = [len(c.sp.encode(t)) for t in ["a b c d e f", "g h i", "a b"]]
    assert c.counts(["a b c d e f"]) + c.counts(["g h i"]) + c.counts(["a b"]) == want


def test_words_are_exact(spark):
    t = texts(spark)
    want, _ = whole_ids(t)
    enc = WordEncoder.at(WORD)
    assert enc.safe
    assert [enc.ids(x).tolist() for x in enc.encode([x or "" for x in t])] == want


def test_other_tokenizer_goes_whole(spark):
    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = WordEncoder.at(path)
    assert not enc.safe
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(path)
    x = "Hello world  again\n\nx"
    assert enc.ids(enc.encode([x])[0]).tolist() == t.encode(x, add_special_tokens=False).ids
    assert bpe.repaired(enc, [b"Hello wor", b"ld  again"], enc.encode(["Hello wor", "ld  again"])) == enc.encode(["Hello world  again"])[0]


@pytest.mark.parametrize("bits", [1, 5, 8, 13, 16, 17, 20, 24, 31, 32])
def test_packing(bits):
    ids = np.random.default_rng(bits).integers(0, 1 << bits, 1003, dtype=np.uint64).astype(np.uint32)
    data = packing.pack(ids, bits)
    assert len(data) == -(-len(ids) * bits // 8)
    assert (packing.unpack(data, bits, len(ids)) == ids).all()
    assert (packing.unpack(data, bits, 17, 111 if bits not in (1, 5) else 40) == ids[(111 if bits not in (1, 5) else 40) :][:17]).all()


def test_random_access(monkeypatch):
    monkeypatch.setattr(packing, "BLOCK", 64)
    rng = np.random.default_rng(0)
    docs = [rng.integers(0, 5000, n).astype(np.uint32) for n in (3, 0, 200, 64, 1, 500)]
    t = packing.TokenFile(packing.TokenFile.build([1, None, 3, 4, 5, 9], docs, 5000))
    assert t.bits == 13
    for i, d in enumerate(docs):
        assert (t.document(i) == d).all()
    with pytest.raises(ValueError):
        packing.TokenFile(t.data[5:])


def test_token_file(spark, docs):
    folder, manifest = packing.write_tokens(docs, WORD, 1)
    got = sorted(packing.read_tokens(spark, folder, manifest).collect(), key=lambda r: r.doc_id)
    rows = sorted(docs.collect(), key=lambda r: r.doc_id)
    want, _ = whole_ids([r.text for r in rows])
    start = 0
    assert len(got) == len(rows)
    for r, g, ids in zip(rows, got, want):
        ids = [*ids, 1]
        assert tuple(g) == (r.doc_id, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_file_nulls(spark):
    d = spark.createDataFrame([(None, "b"), (2, None), (2, None)], "doc_id long, text string")
    folder, manifest = packing.write_tokens(d, WORD, 1)
    assert sorted((r.start, r.n_tokens) for r in packing.read_tokens(spark, folder, manifest).collect()) == [(0, 2), (2, 1), (3, 1)]
    with open(f"{folder.removeprefix('file://')}/files/000000-00000-lost.tok", "wb") as f:
        f.write(packing.MAGIC + b"a task attempt that never ended")
    assert packing.read_tokens(spark, folder, manifest).count() == 3
    folder, manifest = packing.write_tokens(d.limit(0), WORD, 1)
    assert packing.read_tokens(spark, folder, manifest).count() == 0


def test_chunks(spark, docs):
    got = {r.doc_id: tuple(r)[1:] for r in bpe.encode_decode(docs, WORD).collect()}
    rows = docs.collect()
    want, t = whole_ids([r.text for r in rows])
    for r, ids in zip(rows, want):
        dec = t.decode(ids, skip_special_tokens=False)
        assert got[r.doc_id] == (len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(dec.encode()).hexdigest()), repr(r.text)[:80]
    real = bpe.encode_decode(docs.where("doc_id < 9"), WORD, digests=False).collect()
    assert {r.doc_id: list(r.ids) for r in real} == {r.doc_id: ids for r, ids in zip(rows, want) if r.doc_id < 9}


def test_chunks_are_content_defined_and_reused():
    rng = random.Random(5)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(6))
    passage = " ".join(word() for _ in range(900))
    a, b = " ".join(word() for _ in range(300)) + "\n" + passage, " ".join(word() for _ in range(77)) + " " + passage
    ca, cb = bpe.chunk(a), bpe.chunk(b)
    assert b"".join(ca) == a.encode() and b"".join(cb) == b.encode()
    assert len(set(ca) & set(cb)) >= 5
    coder = bpe.ChunkCoder(WordEncoder.at(WORD))
    coder.code([a, b, a, a])
    assert coder.encoded == len(set(ca) | set(cb))


def test_repair_of_bad_cuts():
    enc = WordEncoder.at(WORD)
    text = "The quick brown fox, it's jumping over the lazy dog 1234 times"
    raw = text.encode()
    for n in (3, 5, 11):
        pieces = [raw[i : i + n] for i in range(0, len(raw), n)]
        assert bpe.repaired(enc, pieces, enc.encode([p.decode() for p in pieces])) == enc.encode([text])[0]


def test_repair_acts_for_other_tokenizers():
    """A byte-level tokenizer looks at runs of blanks as a whole; cuts inside them must be repaired, and long texts take linear time."""
    import time

    path = public_tokenizers.path("byte_bpe_50k.json")
    enc = WordEncoder.at(path)
    rng = random.Random(8)
    word = lambda: "".join(rng.choice("abcdefgh\u00e9\u4e16") for _ in range(rng.randrange(1, 9)))
    texts = ["".join(word() + rng.choice([" ", " ", "  ", "\n\n\n", " \t \n", "   "]) for _ in range(n)) for n in (0, 1, 5, 40, 400)] + ["x" * 3000, " " * 500, "<|endoftext|> a  <|endoftext|>" * 30]
    want = [enc.tok.encode(t, add_special_tokens=False).ids for t in texts]
    for one_in in (1, 4, 64):
        coder = bpe.ChunkCoder(enc, one_in=one_in)
        got = coder.code(texts)
        assert [enc.ids(i).tolist() for i, _ in got] == want
        assert [d for _, d in got] == [enc.tok.decode(i, skip_special_tokens=False) for i in want]
    cuts = [b"a  ", b"  b c\n", b"\n\nd e"]
    plain = b"".join(enc.encode([c.decode() for c in cuts]))
    assert bpe.repaired(enc, cuts, enc.encode([c.decode() for c in cuts])) == enc.encode(["a    b c\n\n\nd e"])[0] != plain
    took = []
    for n in (30_000, 240_000):
        text = " ".join(word() for _ in range(n))
        began = time.time()
        (ids, _), = bpe.ChunkCoder(enc).code([text])
        took.append(time.time() - began)
        assert ids == enc.encode([text])[0]
    assert took[1] < 30 * max(took[0], 0.05)  # eight times the text; the square would be 64


def test_long_parts_are_split_between_safe_characters(monkeypatch):
    c = tokens.PieceCounter(PIECE)
    assert c.apart
    rng = random.Random(9)
    alphabets = ["abcdefghijklmnopqrstuvwxyz", "\u4e16\u754c\u4f60\u597d\u6211\u4eec\u662f\u7684", "aA1,.-_/\u00e9\u0301\ufb01\U0001f600\u00df\t\n", "xyz0123456789", "\ud55c\uad6d\uc5b4\u1100\u1161", "=-"]
    texts = ["".join(rng.choice(a) for _ in range(n)) for a in alphabets for n in (1, 7, 400, 3000)]
    texts += [t + " " + u for t in texts[-6:] for u in texts[:3]] + ["\n" * 900, "=" * 900, "\U0001f600" * 900]
    want = [len(c.sp.encode(t)) for t in texts]
    for long in (1, 2, 50, 2000):
        monkeypatch.setattr(tokens, "LONG", long)
        assert tokens.PieceCounter(PIECE).counts(texts) == want
    monkeypatch.setattr(tokens, "LONG", 50)
    assert len(c.cuts(texts[3])) > 5
    huge = "".join(rng.choice(alphabets[1] + alphabets[2]) for _ in range(3_000_000))
    monkeypatch.setattr(tokens, "LONG", 2000)
    assert c.counts([huge]) == [len(c.sp.encode(huge))]


def test_words_in_letters_and_marks():
    """Ids through letters and marks are the library's, for words of all kinds and after the memory was emptied."""
    import random

    from cellweave.llm import words

    enc = words.WordEncoder(public_tokenizers.path("word_bpe_49k.json"))
    assert enc.safe and enc.apart
    rng = random.Random(3)
    odd = ["don't", "DON'T", "it's,", "x1,", "A", "ÉTÉ!", "İstanbul", "ΣΣ", "가", "é", "ª", "ǅx", "Ⅰ", "中文.", "a,b", "'s", "''", "...", "a_b", "_", "ab_", "́a", "<|endoftext|>", "ﬁn.", "ß", "ẞ", "K", "ſ", "\U00010400\U00010428", "กำ", "क्ष", "क़", "क़.", "יִ,", "İ'", "ǰ.", "ŉ!", "ﬃ-"]
    alphabet = "abcXYZéÉß1.,'!-_́Σİ"
    texts = [" ".join(rng.choice(odd) if rng.random() < 0.3 else "".join(rng.choice(alphabet) for _ in range(rng.randint(1, 7))) for _ in range(60)) for _ in range(120)]
    want = [np.array(e.ids, enc.type).tobytes() for e in enc.tok.encode_batch(texts, add_special_tokens=False)]
    assert enc.encode(texts) == want
    keep, words.REMEMBER = words.REMEMBER, 50
    try:
        assert [x for t in texts for x in enc.encode([t])] == want
    finally:
        words.REMEMBER = keep
