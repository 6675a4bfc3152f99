from __future__ import annotations

import functools
import json
import os
import struct
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from plumbline.llm import queries
from plumbline.llm.token_files import WordEncoder, decode_ranks, encode_ranks, new_folder, ranked_ids, read_token_files, token_ids, write_token_files

WORDS = public_tokenizers.path("word_bpe_49k.json")


@functools.cache
def tokenizer(path):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@functools.cache
def word_encoder():
    return WordEncoder(WORDS)


def plain_ids(texts, path=WORDS):
    t = tokenizer(path)
    return [t.encode(x or "", add_special_tokens=False).ids for x in texts]


@settings(max_examples=200, deadline=None)
@given(st.lists(st.lists(st.sampled_from([0, 1, 255, 256, 65535, 65536, 2**24 - 1, 2**24, 2**32 - 1]), max_size=9), max_size=6))
def test_variable_length_codes_come_back(docs):
    flat, counts = np.array([r for d in docs for r in d], dtype=np.uint32), np.array([len(d) for d in docs], dtype=np.int64)
    control, data = encode_ranks(flat, counts)
    assert len(control) == sum(-(-len(d) // 4) for d in docs)
    assert len(data) == sum(1 + (r > 255) + (r > 65535) + (r > 2**24 - 1) for r in flat.tolist())
    assert decode_ranks(control, data, counts).tolist() == flat.tolist()


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.one_of(st.sampled_from(list("aAbzZ09 .,;:!?'\"-_\n\t\r\x0b  ́éÉßΣσ漢😀<|>")), st.sampled_from(list("sltredm'")), st.characters(exclude_categories=["Cs"])), max_size=30), max_size=4))
def test_words_give_the_ids_of_the_text(texts):
    ids, counts = word_encoder()(texts)
    want = plain_ids(texts)
    assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]


def test_special_strings_and_other_tokenizers():
    texts = ["a<|endoftext|>b <|EndOfText|> c.", "x.<|startoftext|>,y can't I'LL", None, "", " ", "word." * 5, "a" * 3000, "ab.cd,ef!?"]
    for name in ("word_bpe_49k.json", "byte_bpe_50k.json"):
        encode = WordEncoder(public_tokenizers.path(name))
        assert encode.apart == name.startswith("word")
        for _ in range(2):  # the second time from memory
            ids, counts = encode(texts)
            want = plain_ids(texts, public_tokenizers.path(name))
            assert counts.tolist() == [len(w) for w in want] and ids.tolist() == [i for w in want for i in w]
    encode = WordEncoder(WORDS)
    encode._learn([str(i) for i in range(500_000)][:10])
    assert encode.slot[""] == 0 and encode.size[0] == 0


def brute(rows):
    """Documents in order with start, count and CRC, by one loop."""
    ids = [[*w, 1] for w in plain_ids([t for _, t in rows])]
    at, out = 0, []
    for (i, _), w in sorted(zip(rows, ids, strict=True), key=lambda x: (x[0][0] is not None, x[0][0] or 0)):
        out.append((i, at, len(w), zlib.crc32(struct.pack(f"<{len(w)}I", *w))))
        at += len(w)
    return out


def test_whole_query_against_one_loop(spark, sf):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = [tuple(r) for r in queries.op11_token_files(spark, sf).orderBy("start").collect()]
    assert got == brute(rows)


def test_odd_rows_and_files(spark, odd_docs):
    folder = new_folder(spark, "test-tokens")
    write_token_files(odd_docs, folder, WORDS)
    got = read_token_files(spark, folder).orderBy("start").collect()
    rows = [(r["doc_id"], r["text"]) for r in odd_docs.collect()]
    want = brute(rows)
    assert [(r["doc_id"], r["start"], r["n_tokens"], zlib.crc32(r["ids"])) for r in got] == want
    manifest = json.load(open(f"{folder}/manifest.json"))
    assert sorted(f["name"] for f in manifest) == sorted(f for f in os.listdir(folder) if f.endswith(".tok"))
    # The most frequent ids take the first ranks, and most ids take one byte.
    ranks = np.fromfile(f"{folder}/ranks.bin", dtype="<u4").tolist()
    seen = np.bincount([i for w in plain_ids([t for _, t in rows]) for i in [*w, 1]])
    assert ranks == sorted(np.flatnonzero(seen).tolist(), key=lambda i: (-seen[i], i))
    # A damaged block is found out.
    name = f"{folder}/{manifest[0]['name']}"
    raw = bytearray(open(name, "rb").read())
    raw[-1] ^= 1
    open(name, "wb").write(raw)
    with pytest.raises(Exception, match="damaged"):
        read_token_files(spark, folder).collect()


def test_empty_table(spark, no_docs):
    folder = new_folder(spark, "test-tokens")
    write_token_files(no_docs, folder, WORDS)
    assert read_token_files(spark, folder).count() == 0
    assert len(ranked_ids(token_ids(no_docs, WORDS))) == 0


def test_one_id_for_many_rows(spark):
    """A third of all rows share an id: they are spread over files and reruns agree."""
    docs = spark.range(3000).selectExpr("if(id % 3 = 0, 5L, id) AS doc_id", "concat('text number ', id) AS text").repartition(7)
    out = []
    for _ in range(2):
        folder = new_folder(spark, "test-tokens")
        write_token_files(docs, folder, WORDS)
        out.append([tuple(r) for r in read_token_files(spark, folder).orderBy("start").collect()])
    assert out[0] == out[1] and len(out[0]) == 3000
    assert [r[0] for r in out[0]] == sorted(r[0] for r in out[0])
    assert all(a[1] + a[2] == b[1] for a, b in zip(out[0], out[0][1:], strict=False))
