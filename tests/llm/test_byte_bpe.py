"""Byte-level BPE's tables: a piece goes through the library once, and a full table keeps what was met lately."""

import random

import public_tokenizers
import pytest


class Counting:
    def __init__(self, tokenizer):
        self.tokenizer, self.asked = tokenizer, []

    def encode_batch_fast(self, pieces, **kw):
        self.asked += pieces
        return self.tokenizer.encode_batch_fast(pieces, **kw)


def codec():
    from hearth.llm.bpe import Codec

    c = Codec(public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)
    c.tokenizer = Counting(c.tokenizer)
    return c


def plain(c, text):
    return b"".join(b"".join(i.to_bytes(4, "little") for i in e.ids) for e in c.tokenizer.tokenizer.encode_batch_fast(c.split.findall(text), add_special_tokens=False))


def test_pieces_go_through_the_library_once():
    c = codec()
    texts = ["tree, tree. (tree) tree! its tree's", " tree; tree: tree"]
    assert c.encode(texts) == [plain(c, t) for t in texts]
    assert c.tokenizer.asked.count(" tree") == 1 and len(c.tokenizer.asked) == len(set(c.tokenizer.asked))


@pytest.mark.parametrize("limit", [0, 30_000])
def test_full_tables_keep_ids_and_what_was_met_lately(monkeypatch, limit):
    from hearth.llm import bpe

    monkeypatch.setattr(bpe, "TABLE_BYTES", limit)
    c, r = codec(), random.Random(3)
    for _ in range(40):
        text = "always here " + " ".join("".join(r.choices("abcdé'9.,", k=r.randint(1, 9))) for _ in range(30)) + " " + "long" * 40
        assert c.encode([text, "", text]) == [plain(c, text), b"", plain(c, text)]
    assert c.tokenizer.asked.count("always") == 1
    assert not any(len(s) > bpe._LONG_WORD for t in (c.known, c.pieces) for s in [*t.young, *t.old])
