"""Licence scans by sentence rules.

A text is normalised as a whole (lower case, everything but a-z and 0-9 as one
space) and known licence sentences are found in it wherever they stand, across
line ends and punctuation. The sequence of a document's sentence identifiers is
then matched, left to right, against the ordered
licence rules: the first rule whose identifiers come next names a licence and
uses them up; an identifier that no rule takes is reported as unmatched. Where a
sentence states a version, the identifier and the licence carry it, and only there.
The tables are in ``licenses.json``: references (patterns that follow "licensed
under" and the like), sentences, and rules.
Everything happens within a document's row; nothing is shuffled.
"""

from __future__ import annotations

import json
import pkgutil
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

Batches = Iterator[pa.RecordBatch]

_TABLES = json.loads(pkgutil.get_data(__package__, "licenses.json"))
# (licence, its sentence identifiers in order; "?" marks one that may be missing). Earlier rules win.
RULES = [(licence, tuple(rule)) for licence, rule in _TABLES["rules"]]

_UNDER = re.compile(r" under (?:the )?(?:terms (?:and conditions )?of )?(?:the |an? )?")
_VERBS = ("licensed", "licenced", "released", "distributed", "available", "published")
_OTHER = re.compile(r"[^a-z0-9]+")


def _literal(pattern: str) -> str:
    """The longest run of plain characters that every match of ``pattern`` (no choice outside of groups) contains."""
    last = None
    while last != pattern:
        last, pattern = pattern, re.sub(r"\((?:[^()])*\)[?*+]*", "\n", pattern)
    return max(re.sub(r"\\.|\[[^]]*\][?*+]*|.[?*]", "\n", pattern).split("\n"), key=len)


_KNOWN = [(name, _literal(p), re.compile(rf"\b{p}\b")) for name, p in _TABLES["sentences"]]
_NAMED = [(name, re.compile(rf"{p}\b")) for name, p in _TABLES["references"]]
# A word of every pattern's literal: a text with none of them holds no sentence.
_HINTS = sorted({*_VERBS} | {max(literal.split(), key=len) for _, literal, _ in _KNOWN})


def _stated(name: str, m: re.Match) -> str:
    """The identifier with the version that the match states: ``GplRef:3.0``, ``GplRef:3.0-or-later``."""
    said = m.groupdict()
    version = (said.get("v") or said.get("w") or "").replace(" ", ".")
    if not version:
        return name
    return f"{name}:{version}{'' if '.' in version else '.0'}{'-or-later' if said.get('plus') else ''}"


def sentence_ids(text: str) -> list[str]:
    """Identifiers of a whole text's licence sentences, in the order of the text."""
    text = text.lower()
    if not any(w in text for w in _HINTS):
        return []
    norm = _OTHER.sub(" ", text).strip()
    found = [(m.start(), i, _stated(name, m)) for i, (name, literal, p) in enumerate(_KNOWN) if literal in norm for m in p.finditer(norm)]
    for under in _UNDER.finditer(norm):
        if norm.endswith(_VERBS, 0, under.start()):
            found += [(under.start(), len(_KNOWN) + i, _stated(name, m)) for i, (name, p) in enumerate(_NAMED) if (m := p.match(norm, under.end()))]
    return [name for _, _, name in sorted(found)]


def match_rules(ids: list[str]) -> tuple[list[str], list[str]]:
    """(licences named, identifiers left over) of a sequence of sentence identifiers."""
    licences, left, i = [], [], 0
    while i < len(ids):
        for licence, rule in RULES:
            at = i
            for part in rule:
                name = part.removesuffix("?")
                if at < len(ids) and ids[at].partition(":")[0] == name:
                    at += 1
                elif name == part:
                    at = -1
                    break
            if at > i:
                version = next((v for x in ids[i:at] if (v := x.partition(":")[2])), "")
                licences.append(licence.replace("{v}", version and f"-{version}"))
                i = at
                break
        else:
            left.append(ids[i])
            i += 1
    return licences, left


def scan_licenses(df: DataFrame, text_col: str = "text") -> DataFrame:
    """``df`` with ``licenses`` (distinct, in order of first mention), ``sentences`` and ``unmatched``.

    ``sentences`` are all identifiers found, ``unmatched`` those that no rule
    took; each is an array, empty for a null, empty or licence-free text.
    Columns named like the new ones are replaced.
    """
    new = ("licenses", "sentences", "unmatched")
    kept = [c for c in df.columns if c not in new]
    schema = ", ".join([*(f"`{n}` {t}" for n, t in df.dtypes if n in kept), *(f"{n} array<string>" for n in new)])
    kind = pa.list_(pa.string())

    def run(batches: Batches) -> Batches:
        for batch in batches:
            ids = [sentence_ids(t.as_py() or "") for t in batch.column(text_col)]
            got = [match_rules(x) for x in ids]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array([list(dict.fromkeys(g[0])) for g in got], kind),
                                              pa.array(ids, kind), pa.array([g[1] for g in got], kind)], names=[*kept, *new])

    return df.mapInArrow(run, schema)
