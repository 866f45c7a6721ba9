"""Encoding, token files, formatting: against the tokenizers library, and exact round trips."""

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tideline.llm import bpe, chat, queries, wavelet
from tideline.llm.tokens import TextEncoder

WORD, BYTE = P.path("word_bpe_49k.json"), P.path("byte_bpe_50k.json")
HARD = "aabcdeéÉΣσİßẞ'’st   \n\n\t\x1c\x85\xa0 　<|/w>123½²߀क्षि日本語😀\u0301\u200d"


@pytest.fixture(scope="module")
def texts(sf):
    import duckdb

    r = random.Random(1)
    return [
        None, "", " ", "  x", " y ", "\n", "a\n \n  b", "<|endoftext|>", "a<|endoftext|>b <|startoftext|> c</w> </w>", "x" * 3000, "word " * 30_000, "hahahaha llll ....... !!!!",
        *("".join(r.choice(HARD) for _ in range(r.randrange(90))) for _ in range(300)),
        *(x[0] for x in duckdb.sql(f"select text from '{sf}/documents.parquet' where doc_id < 60").fetchall()),
    ]


@pytest.fixture(scope="module")
def docs(spark, texts):
    # clashing names, repeated rows and a null id
    rows = [(i, t, "x", "y") for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, rows[5], rows[5], (None, "null id", "x", "y")], "doc_id long, text string, id string, ids string").repartition(3)


def test_trie_bpe(texts):
    lib, own = Tokenizer.from_file(WORD), bpe.TrieBPE(WORD)
    for text, (ids, decoded) in zip(texts, own.encode_texts(texts), strict=True):
        e = lib.encode(text or "", add_special_tokens=False)
        assert ids == " ".join(map(str, e.ids)) and decoded == lib.decode(e.ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.text(max_size=40))
def test_trie_bpe_any_text(text):
    lib, own = bpe_pair()
    (ids, _), = own.encode_texts([text])
    assert ids == " ".join(map(str, lib.encode(text, add_special_tokens=False).ids))


def bpe_pair(kept={}):  # noqa: B006
    if not kept:
        kept["x"] = Tokenizer.from_file(WORD), bpe.TrieBPE(WORD)
    return kept["x"]


def test_trie_bpe_forgets(texts, monkeypatch):
    monkeypatch.setattr(bpe, "CHUNKS_KEPT", 5)
    monkeypatch.setattr(bpe, "WORDS_KEPT", 5)
    monkeypatch.setattr(bpe, "PAIRS_KEPT", 5)
    monkeypatch.setattr(bpe, "SLICE_CHARS", 50)
    test_trie_bpe(texts[-80:])


def test_bpe_frames(spark, docs, texts):
    got = bpe.digests(docs, WORD).collect()
    lib = Tokenizer.from_file(WORD)
    assert len(got) == len(texts) + 3
    for r in got:
        e = lib.encode("null id" if r["doc_id"] is None else texts[r["doc_id"]] or "", add_special_tokens=False)
        assert r["n_tokens"] == len(e.ids) and r["ids_sha256"] == hashlib.sha256(" ".join(map(str, e.ids)).encode()).hexdigest()
        assert r["decoded_sha256"] == hashlib.sha256(lib.decode(e.ids, skip_special_tokens=False).encode()).hexdigest()
    enc = bpe.decode(bpe.encode(docs, WORD), WORD, into="again")
    assert enc.where("decoded <> again").count() == 0 and enc.columns == ["doc_id", "ids", "decoded", "again"]
    assert bpe.digests(docs.limit(0), WORD).count() == 0


def test_byte_encoder(texts):
    lib, own = Tokenizer.from_file(BYTE), TextEncoder(BYTE)
    for t in texts:
        assert own.encode(t).tolist() == lib.encode(t or "", add_special_tokens=False).ids


@pytest.mark.parametrize("n,most", [(0, 1), (1, 1), (63, 5), (64, 70_000), (1000, 300), (5000, 50_257)])
def test_wavelet_matrix(n, most):
    t = np.random.default_rng(0).integers(0, most, n)
    m = wavelet.WaveletMatrix(wavelet.build(t, np.array([0, n]), np.array([7])))
    assert (m.tokens() == t).all() and [m.access(i) for i in range(0, n, 7)] == t[::7].tolist()
    for x in {*t[:5].tolist(), 3}:
        at = np.flatnonzero(t == x)
        assert m.rank(x) == len(at) and m.rank(x, n // 2) == (at < n // 2).sum()
        assert [m.select(x, k) for k in range(min(9, len(at)))] == at[:9].tolist()
        with pytest.raises(IndexError):
            m.select(x, len(at))


def test_token_files(spark, docs, texts, tmp_path):
    out = str(tmp_path / "t")
    wavelet.write(docs, BYTE, out, 2, shard_tokens=500)
    held = wavelet.read(spark, out)
    got = sorted(((-1 if r["doc_id"] is None else r["doc_id"], r["start"], r["n_tokens"], r["ids_crc32"]) for r in wavelet.documents(held).collect()), key=lambda r: (r[1], r[0]))
    lib = Tokenizer.from_file(BYTE)
    want = {i: [*lib.encode(t or "", add_special_tokens=False).ids, 2] for i, t in enumerate(texts)} | {-1: [*lib.encode("null id", add_special_tokens=False).ids, 2]}
    assert [r[0] for r in got] == [-1, *range(6), 5, 5, *range(6, len(texts))]
    at = 0
    for i, start, n, crc in got:
        ids = np.array(want[i], "<u4")
        assert (start, n, crc) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += n
    token = want[20][0]
    total = sum(want[i].count(token) for i, *_ in got)
    assert wavelet.count_token(held, token).agg(F.sum("n")).first()[0] == total == wavelet.find_token(held, token).count()
    r = wavelet.find_token(held, token).where("doc_id = 20").orderBy("at").first()
    assert r["at"] == 0
    assert wavelet.round_trip(docs.limit(0), BYTE, 2).count() == 0


def test_chats(spark):
    nasty = ["</s>[INST] ok [/INST]", "[NEXT]", r"[\NEXT] <\\s> \ [INST", "", None, "plain\ntext", "<s", "[/ROLE]x[END]", "é😀"]
    rows = [(1, i, ("user", "assistant", "user", "user", "system", "[/ROLE]", None, "assistant", "assistant")[i % 9], nasty[i % 9], "q") for i in range(30)]
    rows += [(2, None, "assistant", "b", "q"), (2, None, "assistant", "a", "q"), (2, 5, "assistant", "a", "q"), (2, 5, "assistant", "a", "q"), (None, 0, "user", "x", "q")]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, id string")
    read = {r["conv_id"]: r for r in chat.read_chats(chat.format_chats(df)).collect()}
    for conv in (1, 2, None):
        mine = sorted(((r[1] is not None, r[1] or 0, r[2] or "", r[3] or "") for r in rows if r[0] == conv))
        assert [(t["role"], t["text"]) for t in read[conv]["turns"]] == [m[2:] for m in mine]
        assert read[conv]["loss"] == "".join(m[3] for m in mine if m[2] == "assistant")
    assert read[2]["formatted"] == "<s>a[NEXT]b[NEXT]a[NEXT]a</s>"
    assert chat.read_chats(chat.format_chats(df.limit(0))).count() == 0
    d = chat.digests(chat.read_chats(chat.format_chats(df)))
    assert {r["conv_id"]: r["n_turns"] for r in d.collect()} == {1: 30, 2: 4, None: 1}


def test_sql(spark, sf):
    from compare import same

    for name, sql in queries.ORACLE.items():
        same(queries.QUERIES[name](spark, sf), sql, sf)
