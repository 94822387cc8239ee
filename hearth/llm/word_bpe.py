"""BPE encoding and decoding with a priority queue of merge ranks.

A piece of text is a doubly linked list of symbols, at first one a byte (the
last one carries the end-of-word mark). A heap holds the rank and the place of
every pair that the vocabulary can merge; the lowest rank, leftmost first, is
taken, joins its pair and puts the two pairs beside it on the heap. Entries
whose pair has changed meanwhile are stale and skipped. Decoding looks up the
ids' vocabulary strings and puts them together.

The vocabulary's normaliser and splitter never look across white space, so a
text is handled word by word; a word met before in the worker comes from a table
of packed ids that is bounded in bytes and then starts anew. Nothing is shuffled
and a batch gives out its rows in slices of bounded size.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from functools import cache
from heapq import heapify, heappop, heappush
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hearth.llm.bpe import _schema, _slices, _with, byte_alphabet

Batches = Iterator[pa.RecordBatch]
TABLE_BYTES = 96 << 20  # words and packed ids in a worker's table, with an entry's own cost
_ENTRY = 150
_LONG_WORD = 64
_LONG_TEXT, _WORDS_AT_ONCE = 1 << 20, 1 << 17
_WORD = re.compile(rb"[^\x20\x09-\x0D]+")
_PLACE = (1 << 32) - 1
# The vocabulary's splitting pattern, as it reads on lower-case ASCII without white space.
_ASCII_PIECES = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z]+|[0-9]|[^a-z0-9]+")
_ASCII_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordBpe:
    """Encoder and decoder of one vocabulary file, held once per Python worker."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        if model["type"] != "BPE" or any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "byte_fallback", "ignore_merges", "unk_token")):
            raise ValueError(f"{path}: not a plain BPE vocabulary")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] for t in spec["added_tokens"]) or spec["decoder"]:
            raise ValueError(f"{path}: added tokens with conditions or a decoder")
        vocab, mark = model["vocab"], model.get("end_of_word_suffix") or ""
        self.text = [""] * (max([*vocab.values(), *(t["id"] for t in spec["added_tokens"])]) + 1)
        for token, i in vocab.items():
            self.text[i] = token
        self.special = {}
        for t in spec["added_tokens"]:
            self.special[t["content"]] = t["id"]
            self.text[t["id"]] = t["content"]
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        alphabet = byte_alphabet()
        self.inner = {c: vocab[c] for c in alphabet}
        self.final = {c: vocab[c + mark] for c in alphabet}
        self.inner_byte = [self.inner[c] for c in alphabet]
        self.final_byte = [self.final[c] for c in alphabet]
        self.bits = len(self.text).bit_length()
        self.rank: dict[int, int] = {}
        self.made: list[int] = []
        for r, pair in enumerate(model["merges"]):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            self.rank[vocab[a] << self.bits | vocab[b]] = r
            self.made.append(vocab[a + b])
        library = Tokenizer.from_file(path)
        self.normalizer, self.splitter = library.normalizer, library.pre_tokenizer
        self.plain = self._plain(spec)
        self.known: dict[bytes, bytes] = {}
        self.held = 0

    @staticmethod
    def _plain(spec: dict) -> bool:
        """Whether ASCII can be lower-cased and split here, as the file asks for nothing else."""
        steps = [n["type"] for n in (spec["normalizer"] or {}).get("normalizers", [])]
        splits = (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        return steps == ["NFC", "Replace", "Lowercase"] and len(splits) == 2 and splits[0].get("pattern") == {"Regex": _ASCII_PATTERN}

    def merge(self, symbols: list[int]) -> list[int]:
        """The ids of one piece; ``symbols`` (its bytes' ids) is used up."""
        n, bits, rank, made = len(symbols), self.bits, self.rank.get, self.made
        if n < 2:
            return symbols
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [r << 32 | i for i in range(n - 1) if (r := rank(symbols[i] << bits | symbols[i + 1])) is not None]
        heapify(heap)
        while heap:
            top = heappop(heap)
            i, r = top & _PLACE, top >> 32
            j = after[i]
            if j == n or symbols[i] < 0 or rank(symbols[i] << bits | symbols[j]) != r:
                continue  # stale
            symbols[i], symbols[j] = made[r], -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (q := rank(symbols[i] << bits | symbols[k])) is not None:
                    heappush(heap, q << 32 | i)
            h = before[i]
            if h >= 0 and (q := rank(symbols[h] << bits | symbols[i])) is not None:
                heappush(heap, q << 32 | h)
        return [s for s in symbols if s >= 0]

    def _word(self, word: bytes) -> bytes:
        """Packed ids of a word, that is of text without ASCII white space."""
        if self.cut and b"<" in word or not self.plain or not word.isascii():
            return self._any(word.decode())
        out: list[int] = []
        for piece in _ASCII_PIECES.findall(word.lower()):
            out += self.merge([*map(self.inner_byte.__getitem__, piece[:-1]), self.final_byte[piece[-1]]])
        return array("I", out).tobytes()

    def _any(self, text: str) -> bytes:
        """Packed ids of any text: special strings first, then the vocabulary's normaliser and splitter."""
        out: list[int] = []
        for part in self.cut.split(text) if self.cut else [text]:
            if part in self.special:
                out.append(self.special[part])
            elif part:
                clean = self.normalizer.normalize_str(part) if self.normalizer else part
                for piece, _ in self.splitter.pre_tokenize_str(clean):
                    if piece:
                        out += self.merge([*map(self.inner.__getitem__, piece[:-1]), self.final[piece[-1]]])
        return array("I", out).tobytes()

    def _pack(self, words: list[bytes]) -> bytes:
        try:
            return b"".join(map(self.known.__getitem__, words))
        except KeyError:
            pass
        out, known = [], self.known
        for w in words:
            ids = known.get(w)
            if ids is None:
                ids = self._word(w)
                if len(w) <= _LONG_WORD:
                    known[w] = ids
                    self.held += _ENTRY + len(w) + len(ids)
            out.append(ids)
        if self.held > TABLE_BYTES:
            self.known, self.held = {}, 0
        return b"".join(out)

    def encode(self, text: str) -> bytes:
        """Packed ids of a text; a long one goes through in parts, so its words are never all held."""
        raw = text.encode()
        if len(raw) < _LONG_TEXT:
            return self._pack(raw.split())
        found, parts = _WORD.finditer(raw), []
        while words := [m.group() for m in islice(found, _WORDS_AT_ONCE)]:
            parts.append(self._pack(words))
        return b"".join(parts)

    def decode(self, ids: bytes) -> str:
        return " ".join(map(self.text.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@cache
def word_bpe(path: str) -> WordBpe:
    return WordBpe(path)


def word_bpe_encode(df: DataFrame, vocabulary: str, text_col: str = "text") -> DataFrame:
    """``df`` with ``ids`` (little-endian unsigned 32-bit integers, packed) and ``n_tokens``.

    ``vocabulary`` is a BPE file of the ``tokenizers`` library with end-of-word
    marks, there on every worker. The strings of its special tokens are those
    tokens, as the library reads them; none is added. A null text counts as
    empty; empty texts and texts of white space have no ids. Repeated rows and
    null columns are passed on; columns named like the new ones are replaced.
    """
    new = {"ids": "binary", "n_tokens": "bigint"}

    def run(batches: Batches) -> Batches:
        c = word_bpe(vocabulary)
        for whole in batches:
            for batch in _slices(whole, text_col):
                ids = [c.encode(t or "") for t in batch.column(text_col).to_pylist()]
                yield _with(batch, {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())})

    return df.mapInArrow(run, _schema(df, new))


def word_bpe_decode(df: DataFrame, vocabulary: str, ids_col: str = "ids") -> DataFrame:
    """``df`` with ``decoded_text``: the ids' vocabulary strings, special ones too, one space between them.

    The file names no decoder, and that is how the library decodes then: marks
    and the byte alphabet stay. Null ids give null, no ids the empty text; an id
    outside the vocabulary fails the task. A column of that name is replaced.
    """

    def run(batches: Batches) -> Batches:
        c = word_bpe(vocabulary)
        for whole in batches:
            for batch in _slices(whole, ids_col):
                yield _with(batch, {"decoded_text": pa.array([None if x is None else c.decode(x) for x in batch.column(ids_col).to_pylist()], pa.string())})

    return df.mapInArrow(run, _schema(df, {"decoded_text": "string"}))
