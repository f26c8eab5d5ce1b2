"""Packed token files: exact round trips, and the ids against the tokenizer on whole texts."""

import zlib

import numpy as np
import pytest

from rollcall.llm import token_files

public_tokenizers, tokenizers = pytest.importorskip("public_tokenizers"), pytest.importorskip("tokenizers")
PATH = public_tokenizers.path("byte_bpe_50k.json")

TEXTS = [
    "", " ", "  a  b ", "a\n b", "x \n y", "  ", "it's a\tb  c", "<|endoftext|> hi <|endoftext|>", "don.t don!\nt can.\n\nx a.\n", "x² y².3 z²3, we.\n²3",
    "日本 語 🙂 x", "word " * 3000, "plain words, and.\nMore words; (here) don't", "a" * 500 + " b", "\u00a0 x", "y\u2003 z", "end ",
]


PLAIN = tokenizers.Tokenizer.from_file(PATH)  # not the one that the operator holds


def whole(text):
    return np.array(PLAIN.encode(text, add_special_tokens=False).ids, dtype="<u4")


def test_added_tokens_are_those_of_the_plain_call():
    assert len(whole("a <|endoftext|> b")) == 4
    for text in ("a <|endoftext|> b", "x<|endoftext|>", "<|endoftext|>", "one two<|endoftext|><|endoftext|> three", "a <|endof text|>"):
        for _ in range(2):
            assert token_files.encode_texts(["a b two", text], PATH)[1] == whole(text).tobytes()


def test_rows_of_one_id_are_dealt_to_many_tasks(spark, docs, monkeypatch):
    # Spark would put small partitions together again.
    monkeypatch.setattr(token_files, "CHUNK_IDS", 100)
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    rows = [(7 if i % 3 else None, f"text {i} " * 30) for i in range(4000)]
    try:
        chunks = token_files.write(docs(*rows).repartition(8), PATH)
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "true")
    sizes = [r.n for r in chunks.selectExpr("part", "size(doc_ids) AS n").groupBy("part").agg({"n": "sum"}).toDF("part", "n").collect()]
    assert len(sizes) > 4 and max(sizes) < 2000 and sum(sizes) == 4000
    got = token_files.read(chunks).orderBy("start").collect()
    assert [r.doc_id for r in got] == sorted([r[0] for r in rows], key=lambda x: (x is not None, x))


def test_ids_are_those_of_whole_texts():
    for _ in range(2):  # the second time from the memo
        for text, got in zip(TEXTS, token_files.encode_texts(TEXTS, PATH)):
            assert got == whole(text).tobytes(), text


@pytest.mark.parametrize("vocabulary", [2, 3, 300, 50257, 1 << 20, 1 << 32])
def test_packing_round_trips_and_random_access(vocabulary):
    rng = np.random.default_rng(1)
    for n in (0, 1, 7, 8, 1023, 1024, 1025, 5000):
        ids = rng.integers(0, vocabulary, n).astype(np.uint32)
        chunk = token_files.pack_ids(ids, vocabulary)
        assert (token_files.unpack_ids(chunk) == ids).all()
        for _ in range(8):
            a, b = sorted(rng.integers(0, n + 1, 2))
            assert (token_files.unpack_ids(chunk, a, b) == ids[a:b]).all()
    assert len(token_files.pack_ids(np.zeros(8000, np.uint32), 50257)) < 16000 + 200


def test_foreign_bytes_are_refused():
    with pytest.raises(ValueError):
        token_files.unpack_ids(b"x" * 64)


def test_documents_come_back_in_order(docs, clashing, monkeypatch):
    monkeypatch.setattr(token_files, "CHUNK_IDS", 50)
    rows = [(i * 7 % 17, t) for i, t in enumerate(TEXTS)] + [(100, None), (None, "no id"), (5, "twice"), (5, "twice")]
    got = token_files.read(token_files.write(clashing(docs(*rows)), PATH)).collect()
    key = lambda r: (r[0] is not None, r[0] or 0, r[1] or "")
    at, want = 0, []
    for doc_id, text in sorted(rows, key=lambda r: (*key(r)[:2], (r[1] or "").encode())):
        ids = np.append(whole(text or ""), token_files.END_ID).astype("<u4")
        want.append((doc_id, at, len(ids), zlib.crc32(ids.tobytes())))
        at += len(ids)
    assert sorted(map(tuple, got), key=lambda r: r[1]) == want


def test_empty_table(docs):
    assert token_files.read(token_files.write(docs((1, "x")).where("false"), PATH)).count() == 0
