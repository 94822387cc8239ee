"""Word-level BPE against the tokenizers library: random Unicode, special strings, long texts, odd rows."""

import random

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id bigint, text string, ids int, n_tokens string, decoded_text int"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def random_texts(n, seed=1):
    r = random.Random(seed)
    pool = ["hello", "World", " ", "  ", "\n", "<|endoftext|>", "<|startoftext|>", "<|", "|>", "<|endoftext", "it's", "DON'T", "'LL", "İ", "Σ", "ΣΑΣ", "é", "é", "ﬁ",
            " ", "\xa0", "\x1c", "\x1f", "\x85", "123", "٣", "²", "👩‍👩‍👧", "한국어", "한", "\x00", "​", "﻿", "ß", "ẞ", "K", "Å", "́", "'", "'s", "!!!", "a" * 90]
    blocks = [(32, 127), (0xA0, 0x600), (0x1000, 0xD7FF), (0xE000, 0x2FFFF)]
    return ["".join(r.choice(pool) if r.random() < 0.7 else chr(r.randrange(*r.choice(blocks))) for _ in range(r.randint(0, 25))) for _ in range(n)]


def test_codec_equals_the_library_on_random_unicode(library, monkeypatch):
    from hearth.llm import word_bpe as W

    monkeypatch.setattr(W, "TABLE_BYTES", 20_000)  # the table starts anew many times
    codec = W.WordBpe(PATH)
    for text in random_texts(2500):
        want = library.encode(text, add_special_tokens=False).ids
        ids = codec.encode(text)
        assert np.frombuffer(ids, "<u4").tolist() == want, text
        assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_merges_skip_stale_pairs(library):
    """Runs of equal letters put many overlapping pairs on the heap."""
    from hearth.llm.word_bpe import word_bpe

    codec = word_bpe(PATH)
    for word in ["a" * n for n in range(1, 40)] + ["lll" * 7, "nananana", "ababababab", "sssssssssst", "0" * 9, "!?" * 30, "x" * 5000]:
        assert np.frombuffer(codec.encode(word), "<u4").tolist() == library.encode(word, add_special_tokens=False).ids


def test_frames(spark, library, monkeypatch):
    from hearth.llm import word_bpe as W

    r = random.Random(2)
    long = " ".join(r.choice(["Tale", "of", "gö", "worlds,", "x9"]) + str(r.randrange(50)) for _ in range(400_000))  # some MB in one text
    texts = [None, "", " \n\t ", "plain words here", "plain words here", "<|endoftext|>", long, *random_texts(60, 5)]
    rows = [(k, t, 1, "n", 2) for k, t in enumerate(texts)] + [(None, "no id", 1, "n", 2), (3, "plain words here", None, None, None)]
    d = spark.createDataFrame(rows, SCHEMA).repartition(3)
    out = W.word_bpe_decode(W.word_bpe_encode(d, PATH), PATH)
    assert dict(out.dtypes) == {"doc_id": "bigint", "text": "string", "ids": "binary", "n_tokens": "bigint", "decoded_text": "string"}
    got = out.collect()
    assert sorted((x.doc_id, x.text) for x in got if x.doc_id is not None and x.text) == sorted((i, t) for i, t, *_ in rows if i is not None and t)
    for x in got:
        want = library.encode(x.text or "", add_special_tokens=False).ids
        assert np.frombuffer(x.ids, "<u4").tolist() == want and x.n_tokens == len(want)
        assert x.decoded_text == library.decode(want, skip_special_tokens=False)
    none = spark.createDataFrame([], SCHEMA)
    assert W.word_bpe_decode(W.word_bpe_encode(none, PATH), PATH).collect() == []
    assert W.word_bpe_decode(spark.createDataFrame([(None,), (b"",)], "ids binary"), PATH).collect() == [(None, None), (b"", "")]


def test_query_over_the_table(spark, library):
    import hashlib

    from hearth.llm.queries import QUERIES

    docs = {r.doc_id: r.text or "" for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").collect()}
    sha = lambda b: hashlib.sha256(b).hexdigest()
    got = QUERIES["op12_word_bpe"](spark, "/root/testdata/sf0.001").collect()
    assert len(got) == len(docs)
    for r in got:
        ids = library.encode(docs[r.doc_id], add_special_tokens=False).ids
        assert (r.n_tokens, r.ids_sha256) == (len(ids), sha(np.array(ids, "<u4").tobytes()))
        assert r.decoded_sha256 == sha(library.decode(ids, skip_special_tokens=False).encode())


def test_other_vocabularies_are_refused():
    from hearth.llm.word_bpe import WordBpe

    with pytest.raises(ValueError):
        WordBpe(public_tokenizers.path("byte_bpe_50k.json"))
