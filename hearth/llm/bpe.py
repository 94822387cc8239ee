"""Byte-level BPE encoding and decoding over Arrow batches.

Texts are split by the tokenizer's pattern; each piece is encoded on its own by
the ``tokenizers`` library, whose byte-level alphabet maps every byte to one
visible character. The pattern's pieces hold no white space but one leading
space, or nothing else, so texts are first cut into words with their space; a
word that was met lately in the worker comes from a bounded table of its packed
ids. Only new ones go through the pattern, and only pieces that were not met
lately go through the library. Nothing is shuffled, and a batch gives out its rows in
slices of bounded size.

Ids are packed as little-endian unsigned 32-bit integers in one binary value.
Decoding looks up each id's bytes. A character split over several ids comes out
whole because bytes are joined before they are read as UTF-8; what is no UTF-8
even then (ids cut inside a character) becomes U+FFFD in the decoded text.
"""

from __future__ import annotations

import base64
import json
import os
import re
from array import array
from collections.abc import Callable, Iterator
from functools import cache
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from hearth.llm import words as W

Batches = Iterator[pa.RecordBatch]
TABLE_BYTES = 40 << 20  # strings and packed ids in one generation of a worker's tables, with an entry's own cost
_ENTRY = 190
_LONG_WORD = 64
_LONG_TEXT, _WORDS_AT_ONCE = 1 << 20, 1 << 17
# The characters with Unicode's White_Space property.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
# White space up to the last one before a word; a word with the space before it; that last one if it is no space.
_WORDS = re.compile(f"[{_SPACE}]+(?![^{_SPACE}])| ?[^{_SPACE}]+|[{_SPACE}]")


def byte_alphabet() -> list[str]:
    """The character that stands for each byte: printable Latin-1 for itself, the rest from U+0100 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in shown]
    chars = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}
    return [chars[b] for b in range(256)]


class _Table:
    """Packed ids of strings met lately. What a full generation holds stays until the next one is full."""

    def __init__(self):
        self.young: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}
        self.long: list[str] = []
        self.held = 0

    def missing(self, strings: set[str]) -> set[str]:
        """Those that are not there; the others are in ``young`` from now on."""
        if self.held > TABLE_BYTES:
            self.young, self.old, self.held = {}, self.young, 0
        new = strings.difference(self.young)
        met = [s for s in new if s in self.old]
        for s in met:
            self.put(s, self.old[s])
        return new.difference(met)

    def put(self, string: str, ids: bytes) -> None:
        self.young[string] = ids
        if len(string) > _LONG_WORD:
            self.long.append(string)
        else:
            self.held += _ENTRY + len(string) + len(ids)

    def forget_long(self) -> None:
        for s in self.long:
            del self.young[s]
        self.long = []


class Codec:
    """Encoder and decoder of one vocabulary, held once per Python worker."""

    def __init__(self, vocabulary: str, ranks: str, pattern: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import regex
        from tokenizers import Tokenizer, pre_tokenizers

        self.split = regex.compile(pattern)
        with open(ranks, "rb") as f:
            by_bytes = {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in f if line.strip())}
        self.token = [b""] * (max(by_bytes.values()) + 1)
        for token, rank in by_bytes.items():
            self.token[rank] = token
        self.size = np.array([len(t) for t in self.token], dtype=np.int64)
        self._check(vocabulary, by_bytes)
        self.tokenizer = Tokenizer.from_file(vocabulary)
        self.tokenizer.encode_special_tokens = True
        self.tokenizer.pre_tokenizer = pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.known, self.pieces = _Table(), _Table()

    @staticmethod
    def _check(vocabulary: str, by_bytes: dict[bytes, int]) -> None:
        """The library's vocabulary must give every token the id of its rank."""
        alphabet = byte_alphabet()
        with open(vocabulary, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        if any(vocab.get("".join(alphabet[b] for b in token)) != rank for token, rank in by_bytes.items()):
            raise ValueError(f"{vocabulary} and the rank file differ")

    def _learn(self, words: list[str]) -> list[bytes]:
        split = [self.split.findall(w) for w in words]
        pieces = self.pieces
        new = list(pieces.missing(set().union(*split)))
        for p, e in zip(new, self.tokenizer.encode_batch_fast(new, add_special_tokens=False)):
            pieces.put(p, array("I", e.ids).tobytes())
        ids = pieces.young
        out = [ids[of[0]] if len(of) == 1 else b"".join([ids[p] for p in of]) for of in split]
        pieces.forget_long()
        return out

    def _pack(self, lists: list[list[str]]) -> list[bytes]:
        known = self.known
        words = list(known.missing(set().union(*lists)))
        for i in range(0, len(words), 4096):
            some = words[i:i + 4096]
            for w, ids in zip(some, self._learn(some)):
                known.put(w, ids)
        out = [b"".join(map(known.young.__getitem__, words)) for words in lists]
        known.forget_long()
        return out

    def encode(self, texts: list[str]) -> list[bytes]:
        """Packed ids of each text; a long text goes through in parts, so its words are never all held."""
        out: list[bytes] = [b""] * len(texts)
        short = [i for i, t in enumerate(texts) if len(t) < _LONG_TEXT]
        for i, ids in zip(short, self._pack([_WORDS.findall(texts[i]) for i in short])):
            out[i] = ids
        for i, t in enumerate(texts):
            if len(t) >= _LONG_TEXT:
                found, parts = _WORDS.finditer(t), []
                while words := [m.group() for m in islice(found, _WORDS_AT_ONCE)]:
                    parts += self._pack([words])
                out[i] = b"".join(parts)
        return out

    def offsets(self, text: str, ids: bytes) -> tuple[np.ndarray, np.ndarray]:
        """First and end character of each id's bytes; ids that share a character both cover it."""
        raw = np.frombuffer(text.encode(), dtype=np.uint8)
        char = np.cumsum((raw & 0xC0) != 0x80) - 1
        end = np.cumsum(self.size[np.frombuffer(ids, dtype="<u4")])
        start = np.concatenate([np.zeros(1, np.int64), end[:-1]]) if len(end) else end
        return char[start], char[end - 1] + 1

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, dtype="<u4").tolist()))


@cache
def codec(vocabulary: str, ranks: str, pattern: str) -> Codec:
    return Codec(vocabulary, ranks, pattern)


def _with(batch: pa.RecordBatch, new: dict[str, pa.Array]) -> pa.RecordBatch:
    names = [n for n in batch.schema.names if n not in new]
    return pa.RecordBatch.from_arrays([*(batch.column(n) for n in names), *new.values()], names=[*names, *new])


def _schema(df: DataFrame, new: dict[str, str]) -> str:
    return ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes if n not in new), *(f"`{n}` {t}" for n, t in new.items())])


def _slices(batch: pa.RecordBatch, column: str) -> Iterator[pa.RecordBatch]:
    bounds = W.byte_offsets(batch.column(column))
    for a, b in W.chunks(bounds):
        yield batch.slice(a, b - a)


def bpe_encode(df: DataFrame, vocabulary: str, ranks: str, pattern: str, text_col: str = "text", offsets: bool = False) -> DataFrame:
    """``df`` with ``ids`` (packed), ``n_tokens`` and, if asked, ``starts`` and ``ends`` in characters.

    ``vocabulary`` is the library's file, ``ranks`` the rank file of the same
    vocabulary and ``pattern`` its splitting pattern; both files must be there on
    every worker. Special tokens' strings are ordinary text. A null text counts
    as empty and has no ids. Columns named like the new ones are replaced.
    """
    new = {"ids": "binary", "n_tokens": "bigint"} | ({"starts": "array<bigint>", "ends": "array<bigint>"} if offsets else {})

    def run(batches: Batches) -> Batches:
        c = codec(vocabulary, ranks, pattern)
        for whole in batches:
            for batch in _slices(whole, text_col):
                texts = [t or "" for t in batch.column(text_col).to_pylist()]
                ids = c.encode(texts)
                made = {"ids": pa.array(ids, pa.binary()), "n_tokens": pa.array([len(x) // 4 for x in ids], pa.int64())}
                if offsets:
                    spans = [c.offsets(t, x) for t, x in zip(texts, ids)]
                    made |= {n: pa.array([s[i] for s in spans], pa.list_(pa.int64())) for i, n in enumerate(("starts", "ends"))}
                yield _with(batch, made)

    return df.mapInArrow(run, _schema(df, new))


def bpe_decode(df: DataFrame, vocabulary: str, ranks: str, pattern: str, ids_col: str = "ids", text: bool = True) -> DataFrame:
    """``df`` with ``decoded`` (bytes) and, unless told not to, ``decoded_text``.

    Null ids give null; an id outside the vocabulary fails the task. Columns
    named like the new ones are replaced.
    """
    new = {"decoded": "binary"} | ({"decoded_text": "string"} if text else {})

    def run(batches: Batches) -> Batches:
        c = codec(vocabulary, ranks, pattern)
        for whole in batches:
            for batch in _slices(whole, ids_col):
                raw = [None if x is None else c.decode(x) for x in batch.column(ids_col).to_pylist()]
                made = {"decoded": pa.array(raw, pa.binary())}
                if text:
                    made["decoded_text"] = pa.array([None if x is None else x.decode("utf-8", "replace") for x in raw], pa.string())
                yield _with(batch, made)

    return df.mapInArrow(run, _schema(df, new))
