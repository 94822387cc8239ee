"""Document operators against brute force, with nulls, empty and long texts, ties, repeated rows and clashing names."""

import random
import zlib

import brute
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id bigint, text string, lang string, source string, id bigint, size int, cls string, kept string, row string"


def rows_of(seed=3):
    r = random.Random(seed)
    vocab = ["".join(r.choice("abcdeéñ") for _ in range(r.randint(1, 6))) for _ in range(400)]
    say = lambda n: " ".join(r.choice(vocab) for _ in range(n))
    passage, base, long = say(60), say(90), say(20_000)
    texts = [None, "", "  \n\t ", "one two", "One  TWO", "one two three four five", base, base, base.upper().replace("É", "é").replace("Ñ", "ñ"), long,
             "a " * 70, "b b b " * 30, "!!! ... 123", passage, say(40) + "\n" + passage + " " + say(30), say(50) + " " + passage]
    for k in range(24):  # near copies: a word or two changed
        w = base.split()
        for _ in range(k % 3 + 1):
            w[r.randrange(len(w))] = f"x{k}"
        texts.append(" ".join(w))
    texts += [say(r.randint(1, 120)) for _ in range(30)]
    texts += [f"header of page {k} of 90\nuser u{k} logged in from host alpha today\n{say(20)}\nuser {vocab[k]} logged in from host alpha today" for k in range(8)]
    texts.append(" ".join(long.split()[5000:5300]))
    langs, sources = ["en", "fr", None], ["b", "a", None, "ü", "c"]
    return [(k, t, langs[k % 3], sources[k % 5], 7, 1, "c", "k", None) for k, t in enumerate(texts)]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(rows_of(), SCHEMA).repartition(3)


@pytest.fixture(scope="module")
def odd(spark):
    """Repeated rows and null ids beside a few plain ones."""
    t = "some words that are here for the test and a few more of them to make windows of twenty words in all here"
    rows = [(5, t), (5, t), (None, t), (None, None), (3, "other text"), (None, "lonely text of five words"), (9, None), (4, t + " plus")]
    return spark.createDataFrame([(i, x, None, None, None, None, None, None, None) for i, x in rows], SCHEMA).repartition(2)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


def pairs(*cols):
    return [(r[0], r[1]) for r in rows_of()] if not cols else [tuple(r[c] for c in cols) for r in rows_of()]


def got(df):
    return sorted((tuple(r) for r in df.collect()), key=repr)


def same(a, b):
    assert got(a) == sorted(b, key=repr)


def test_ngram_join(docs, odd, none):
    from hearth.llm.ngram_join import ngram_jaccard_components as f

    same(f(docs, counters=1 << 10), brute.ngram_components(pairs()))
    n = len(brute.words(odd.where("doc_id = 5").first().text)) - 4
    assert got(f(odd, counters=4)) == sorted([(5, n, 4), (5, n, 4), (None, n, 4), (None, 0, None), (3, 1, 3), (None, 1, None), (9, 0, 9), (4, n + 1, 4)], key=repr)
    assert f(none).collect() == []


def test_mixing(docs, odd, none):
    from hearth.llm.mixing import mix_sources, mixed_documents

    want = brute.mix(pairs(0, 1, 3))
    have = {r[0]: tuple(r) for r in mix_sources(docs).collect()}
    for w in want:
        h = have[w[0]]
        assert (h[1], h[2], h[4]) == (w[1], w[2], w[4]) and h[3] == pytest.approx(w[3]) and h[4] <= 3 * h[1]
    assert got(mix_sources(docs)) == got(mix_sources(docs.repartition(5)))
    mixed = mixed_documents(docs)
    assert mixed.columns == docs.columns
    words = {r.doc_id: r.n for r in mixed.groupBy("doc_id").agg(F.sum(F.regexp_count("text", F.lit(r"[^\x20\x09-\x0D]+"))).alias("n")).collect()}
    assert words == {w[0]: w[4] for w in want if w[4]}
    assert mix_sources(odd).agg(F.sum("taken")).first()[0] == mix_sources(odd).agg(F.sum("size")).first()[0]
    assert mix_sources(none).collect() == [] and mixed_documents(none).collect() == []


def test_mixing_reshares_what_a_small_source_cannot_take(spark):
    from hearth.llm.mixing import mix_sources

    d = spark.createDataFrame([(1, "w " * 10, "a"), (2, "w " * 1000, "b"), (3, "w", "c"), (4, "", "d")], "doc_id int, text string, source string")
    assert got(mix_sources(d).select("doc_id", "target", "taken")) == [(1, 30.0, 30), (2, 978.0, 978), (3, 3.0, 3), (4, 0.0, 0)]


def test_bpe(docs, odd, none, spark):
    import base64

    import numpy as np
    import public_tokenizers as P
    import tiktoken
    from hearth.llm.bpe import bpe_decode, bpe_encode
    from hearth.llm.queries import vocabulary

    with open(P.path("byte_bpe_50k.tiktoken"), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in (x.split() for x in f)}
    lib = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})
    r = random.Random(1)
    pool = [chr(x) for x in (*range(0, 0x180), 0x85, 0xA0, 0x1680, 0x2003, 0x2028, 0x3000, 0x200B, 0xFEFF, 0x1F600, 0x4E00, 0x10FFFF)]
    wild = ["".join(r.choice(pool) if r.random() < 0.6 else r.choice(["  ", " ", "\n", "'s", "'ll", "the", "12", "\r\n", "<|endoftext|>"])
                    for _ in range(r.randint(0, 40))) for _ in range(300)]
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(wild)], "doc_id bigint, text string")
    both = docs.select("doc_id", "text").union(more)
    e = bpe_encode(both, **vocabulary(), offsets=True)
    for row in bpe_decode(e, **vocabulary()).collect():
        text = row.text or ""
        ids = np.frombuffer(row.ids, "<u4").tolist()
        assert ids == lib.encode_ordinary(text) and row.n_tokens == len(ids)
        assert bytes(row.decoded) == text.encode() and row.decoded_text == text
        assert len(row.starts) == len(ids) and (not ids or (row.starts[0] == 0 and row.ends[-1] == len(text)))
        assert all(a < b for a, b in zip(row.starts, row.ends)) and all(b - 1 <= c <= b for b, c in zip(row.ends, row.starts[1:]))
    half = spark.createDataFrame([(bytearray(np.array(lib.encode_ordinary("😀"), "<u4")[:1].tobytes()),), (None,)], "ids binary")
    assert [x.decoded_text for x in bpe_decode(half, **vocabulary()).collect()] == ["�", None]
    assert bpe_encode(none, **vocabulary()).collect() == []
    assert bpe_encode(odd, **vocabulary()).where("text IS NULL").select("n_tokens").distinct().collect() == [(0,)]


def test_exact_dedup(docs, odd, none):
    from hearth.llm.exact_dedup import drop_exact_copies, exact_groups

    same(exact_groups(docs).drop("kept"), brute.exact(pairs()))
    kept = {w[1] for w in brute.exact(pairs())}
    assert {r.doc_id for r in exact_groups(docs).where("kept").collect()} == kept
    left = drop_exact_copies(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted(kept)
    flags = exact_groups(odd).collect()
    assert [r.kept for r in flags].count(True) == 5 and drop_exact_copies(odd).count() == 5
    assert {(r.keep_id, r.group_size) for r in flags} == {(5, 3), (9, 2), (3, 1), (None, 1), (4, 1)}
    assert exact_groups(none).collect() == [] and drop_exact_copies(none).collect() == []


def test_exact_dedup_with_a_full_bloom_filter(docs, monkeypatch):
    from hearth.llm import exact_dedup as X

    monkeypatch.setattr(X, "MIN_BITS", 8)
    monkeypatch.setattr(X, "MAX_BITS", 8)
    same(X.exact_groups(docs).drop("kept"), brute.exact(pairs()))


def test_hot_groups_are_broadcast(docs, monkeypatch):
    from hearth.llm import graph
    from hearth.llm.exact_dedup import exact_groups

    monkeypatch.setattr(graph, "BROADCAST_BYTES", 0)
    same(exact_groups(docs).drop("kept"), brute.exact(pairs()))


def test_line_dedup(docs, odd, none):
    from hearth.llm.line_dedup import drop_recurring_lines

    out = drop_recurring_lines(docs)
    want = brute.line_templates(pairs())
    same(out.select("doc_id", "n_lines", "n_dropped", "kept_text"), want)
    assert sum(w[2] for w in want) >= 16
    assert out.where("n_dropped > 0").count() >= 8
    odd_out = drop_recurring_lines(odd)
    assert odd_out.count() == 8 and odd_out.where("text IS NULL").select("n_lines").distinct().collect() == [(0,)]
    assert drop_recurring_lines(none).collect() == []


def test_language_id(docs, odd, none, spark):
    from hearth.llm.langid import fit_profiles, identify_language

    profiles = fit_profiles(docs)
    want = dict(zip([r[0] for r in rows_of()], brute.languages([(r[1], r[2]) for r in rows_of()], [r[1] for r in rows_of()])))
    for r in identify_language(docs, profiles).collect():
        assert r.lang_pred == want[r.doc_id][0] and r.score == pytest.approx(want[r.doc_id][1])
    assert {r.lang_pred for r in identify_language(odd, profiles).where("text IS NULL").collect()} == {"und"}
    assert identify_language(none, profiles).collect() == [] and fit_profiles(none) == {}
    assert {(r.lang_pred, r.score) for r in identify_language(odd, {}).collect()} == {("und", 0.0)}


def test_language_id_in_blocks(monkeypatch):
    from hearth.llm import langid

    text = "aé b'c 12 ddd " * 300
    whole = langid.count_ngrams(text)
    monkeypatch.setattr(langid, "_BLOCK", 100)
    parts = langid.count_ngrams(text)
    assert all((a == b).all() for a, b in zip(whole, parts))


def test_language_id_held_out_accuracy(spark):
    from hearth.llm.queries import QUERIES

    truth = {r.doc_id: r.lang for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "lang").collect()}
    out = QUERIES["op6_language_id"](spark, SF).collect()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0) and 0 <= r.score <= 1 for r in out) and len(out) == len(truth)
    held = [r for r in out if r.held_out]
    assert sum(r.lang_pred == truth[r.doc_id] for r in held) >= 0.95 * len(held)


def test_token_counts(docs, odd, none):
    import public_tokenizers as P
    from hearth.llm.token_counts import Counter, count_tokens, read_vocabulary
    from tokenizers import Tokenizer, models

    model = P.path("piece_bpe_32k.model")
    pieces, prefix = read_vocabulary(model)
    low = min(pieces.values()) - 1e6
    fallback = [(f"<0x{b:02X}>", low) for b in range(256)]
    lib = Tokenizer(models.Unigram([("<unk>", 0.0), *fallback, *pieces.items()], unk_id=0, byte_fallback=True))
    for r in count_tokens(docs, model).select("text", "n_tokens").collect():
        w = brute.words(r.text)
        if r.text and r.text == " ".join(w):
            assert r.n_tokens == sum(len(lib.encode("▁" + x).ids) for x in w)
    c = Counter({"▁": -1.0, "a": -3.0, "b": -3.0, "ab": -6.0, "▁a": -4.0, "bb": -5.0})
    assert c.count("ab") == (-7.0, 2)  # ▁a b, ▁ ab and ▁ a b are equally good: the longest last piece wins
    assert c.viterbi("▁ab") == (-7.0, 2) and c.count("abb") == (-9.0, 2) and c.count("é")[1] == 3 and c.count("") == (0.0, 0)
    assert {r.n_tokens for r in count_tokens(odd, model).where("text IS NULL").collect()} == {0}
    assert count_tokens(none, model).collect() == []


def test_substring_dedup(docs, odd, none, spark, monkeypatch):
    from hearth.llm import graph, substring_dedup
    from hearth.llm.substring_dedup import remove_repeated_windows as f

    want = brute.windows(pairs())
    assert sum(w[2] for w in want) > 1000
    same(f(docs), want)
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 0)
    monkeypatch.setattr(substring_dedup, "_SEGMENT", 64)
    same(f(docs, counters=4), want)
    out = got(f(odd).drop("kept_sha256"))
    n = len(brute.words(odd.where("doc_id = 5").first().text))
    assert out == sorted([(5, n, n), (5, n, n), (None, n, 0), (None, 0, 0), (3, 2, 0), (None, 5, 0), (9, 0, 0), (4, n + 1, n)], key=repr)
    assert f(none).collect() == []


def test_license_scan(spark, none):
    from hearth.llm.license_scan import match_rules, scan_licenses

    mit = ("Permission is hereby granted, free of charge, to any person obtaining a copy of this software. "
           "The above copyright notice and this permission notice shall be included in all copies. "
           'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND.')
    bsd = ("Redistribution and use in source and binary forms, with or without modification, are permitted provided that: "
           "1. Redistributions of source code must retain the above copyright notice. 2. Redistributions in binary form must reproduce the above copyright notice. {}"
           "This software is provided by the copyright holders and contributors \"as is\".")
    texts = {1: None, 2: "", 3: "plain prose about a license to fish.", 4: "x y.\nLicensed under the Apache License, Version 2.0.\nmore",
             5: "This work is licensed under the GNU General Public License, version 3.", 6: "Released under the MIT License.", 7: "Licensed under CC BY-NC 4.0.",
             8: mit, 9: bsd.format(""), 10: bsd.format("Neither the name of X nor its contributors may be used to endorse or promote products. "),
             11: "w " * 50_000 + ". Licensed under CC BY 4.0. " + "Released under the MIT License. Released under the MIT License.", 12: "All rights reserved."}
    d = spark.createDataFrame([(k, t, "x") for k, t in texts.items()], "doc_id int, text string, licenses string")
    out = {r.doc_id: r for r in scan_licenses(d).collect()}
    want = {1: [], 2: [], 3: [], 4: ["Apache-2.0"], 5: ["GPL-3.0"], 6: ["MIT"], 7: ["CC-BY-NC-4.0"], 8: ["MIT"], 9: ["BSD-2-Clause"], 10: ["BSD-3-Clause"],
            11: ["CC-BY-4.0", "MIT"], 12: []}
    assert {k: r.licenses for k, r in out.items()} == want and out[12].unmatched == ["AllRights"]
    assert match_rules(["BsdGrant", "MitRef", "BsdSource"]) == (["MIT"], ["BsdGrant", "BsdSource"])
    assert scan_licenses(none).collect() == []


def test_license_scan_over_the_table(spark):
    from hearth.llm.queries import QUERIES

    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()}
    lines = {"Licensed under CC BY-NC 4.0.": "CC-BY-NC-4.0", "This work is licensed under the GNU General Public License, version 3.": "GPL-3.0",
             "Licensed under the Apache License, Version 2.0.": "Apache-2.0", "Released under the MIT License.": "MIT"}
    for r in QUERIES["op10_license_scan"](spark, SF).collect():
        assert set(r.licenses.split(",")) - {""} == {x for line, x in lines.items() if line in texts[r.doc_id]}


GPL = ("This program is free software; you can redistribute it and/or modify\n * it under the terms of the GNU {0}General Public License as published by\n"
       " * the Free Software Foundation; either version {1} of the License, or\n * (at your option) any later version.\n *\n"
       " * This program is distributed in the hope that it will be useful,\n * but WITHOUT ANY WARRANTY; without even the implied warranty of\n * MERCHANTABILITY.\n"
       " * You should have received a copy of the GNU {0}General Public License along\n * with this program. If not, see <https://www.gnu.org/licenses/>.")
MPL = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."


def test_license_notices_across_punctuation_and_lines():
    from hearth.llm.license_scan import _HINTS, _KNOWN, match_rules, sentence_ids

    want = {GPL.format("", 2): "GPL-2.0-or-later", GPL.format("", 3): "GPL-3.0-or-later", MPL: "MPL-2.0", "This data is released under CC0.": "CC0-1.0",
            "Licensed under CC BY 4.0.\n\nShare this page.": "CC-BY-4.0", "Licensed under the\nApache License, Version 2.0": "Apache-2.0"}
    for text, licence in want.items():
        assert match_rules(sentence_ids(text)) == ([licence], [])
    both = GPL.format("", 2) + " words " * 50 + GPL.format("", 3)
    assert match_rules(sentence_ids(both)) == (["GPL-2.0-or-later", "GPL-3.0-or-later"], [])
    assert sentence_ids("Neither the name of Foo Inc. nor its staff may be used to endorse or promote products") == ["BsdEndorse"]
    assert all(literal and any(w in literal for w in _HINTS) for _, literal, _ in _KNOWN)


def test_line_dedup_with_several_templates_in_a_leaf(spark):
    from hearth.llm.line_dedup import drop_recurring_lines

    r = random.Random(5)
    word = lambda: "".join(r.choice("abcdefgh") for _ in range(9))
    say = lambda n: " ".join(word() for _ in range(n))
    first = [f"this is a note that {word()} has joined our {word()} channel again" for _ in range(30)]
    second = [f"this is a list of every {word()} which they {word()} sold yesterday" for _ in range(30)]
    third = [f"this is a {word()} for members only so {word()} must wait outside" for _ in range(12)]
    other = [f"this is a {say(9)}" for _ in range(90)]
    rows = [(k, f"{x}\n{say(6)}") for k, x in enumerate(first + second + third + other)]
    out = {x.doc_id: x for x in drop_recurring_lines(spark.createDataFrame(rows, "doc_id int, text string").repartition(3)).collect()}
    for k, text in rows:
        gone = k < 72
        assert (out[k].n_lines, out[k].n_dropped, out[k].kept_text) == (2, int(gone), text.split("\n")[1] if gone else text)


def test_license_names_and_versions():
    from hearth.llm.license_scan import match_rules, sentence_ids

    isc = ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted{} "
           'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE')
    zlib_ = ("This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable for any damages.\n"
             "Permission is granted to anyone to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to:\n"
             "1. The origin of this software must not be misrepresented;\n2. Altered source versions must be plainly marked as such.\n3. This notice may not be removed or altered from any source distribution.")
    bsd = ("Redistribution and use in source and binary forms, with or without\nmodification, are permitted. 1. Redistributions of source code must retain the above copyright notice. "
           "2. Redistributions in binary form must reproduce the above copyright notice. 3. Neither the name of the University nor the names of its contributors\nmay be used to endorse or promote products. "
           "THIS SOFTWARE IS PROVIDED BY THE REGENTS AND CONTRIBUTORS ``AS IS''. IN NO EVENT SHALL THE REGENTS OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT")
    want = {isc.format(", provided that the above copyright notice and this permission notice appear in all copies."): "ISC", isc.format("."): "0BSD", zlib_: "Zlib", bsd: "BSD-3-Clause",
            'This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND': "Unlicense",
            GPL.format("Lesser ", 2.1): "LGPL-2.1-or-later", GPL.format("Affero ", 3): "AGPL-3.0-or-later", GPL.format("", 2): "GPL-2.0-or-later",
            "This program and the accompanying materials are made available under the terms of the Eclipse Public License v2.0": "EPL-2.0",
            "Licensed under GPL v3.": "GPL-3.0", "Released under the GPLv2 or later.": "GPL-2.0-or-later", "Licensed under the GNU GPL.": "GPL",
            "Distributed under version 2 of the GNU General Public License.": "GPL-2.0", "Licensed under CC BY-SA 3.0": "CC-BY-SA-3.0", "licensed under CC BY-SA": "CC-BY-SA",
            "you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.": "GPL-2.0",
            "This work is licensed under a Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License.": "CC-BY-NC-SA-4.0", "Licensed under CC BY-ND 2.5": "CC-BY-ND-2.5",
            "Licensed under CC BY-NC-ND 4.0": "CC-BY-NC-ND-4.0", "Licensed under the Apache License, Version 1.1": "Apache-1.1", "Released under the 3-clause BSD license": "BSD-3-Clause", MPL: "MPL-2.0"}
    for text, licence in want.items():
        assert match_rules(sentence_ids(text)) == ([licence], []), text
    assert sentence_ids("In no event shall the copyright owner or contributors be liable.") == ["BsdLiable"]
    assert sentence_ids("The ship came under the Apache hills and was distributed under a tree.") == []


def test_line_dedup_of_literal_lines(spark):
    from hearth.llm.line_dedup import LITERAL_TEXTS, drop_recurring_lines

    rows = [(1, "shared line\nown one"), (2, "shared line\nown two"), (3, "call 555 now\nown three"), (4, "call 555 now\nown four"), (5, "call 556 now\nown five"), (6, "copied\nwhole"), (7, "copied\nwhole")]
    d = spark.createDataFrame(rows, "doc_id int, text string").repartition(3)
    dropped = {x.doc_id: x.n_dropped for x in drop_recurring_lines(d, literal_texts=LITERAL_TEXTS).collect()}
    assert dropped == {1: 1, 2: 1, 3: 1, 4: 1, 5: 0, 6: 0, 7: 0}


def test_line_dedup_never_broadcasts_line_numbers_beyond_the_bound(spark, monkeypatch):
    from hearth.llm import graph
    from hearth.llm.line_dedup import drop_recurring_lines

    seen, broadcast = [], F.broadcast
    monkeypatch.setattr(F, "broadcast", lambda df: seen.append(df.columns) or broadcast(df))
    monkeypatch.setattr(graph, "BROADCAST_BYTES", 1000)
    same_lines = "\n".join(f"{a}{b} line" for a in "abcdefghijklmnop" for b in "abcdefghijklmnop")
    rows = [(k, f"{same_lines}\nown {'xyz'[k % 3]}") for k in range(9)] + [(9, None), (10, "lonely")]
    out = {x.doc_id: x for x in drop_recurring_lines(spark.createDataFrame(rows, "doc_id int, text string").repartition(3), literal_texts=2).collect()}
    assert [out[k].n_dropped for k in range(11)] == [256] * 9 + [0, 0] and out[4].kept_text == "own y" and out[10].kept_text == "lonely"
    assert len(out) == 11 and seen and not any("dropped" in c for c in seen)


def test_a_common_passage_meets_nothing_in_the_pair_join(spark, monkeypatch):
    """Ten own words and one passage of sixty words in every text: no link, and no row pairs that grow with the square."""
    from hearth.llm import ngram_join as N

    met, by_role = [], N._by_role

    def spy(x):
        large, small = by_role(x)
        met.append(large.select("token").join(small.select("token"), "token").count())
        return large, small

    monkeypatch.setattr(N, "_by_role", spy)
    r = random.Random(12)
    passage = " ".join(f"p{i}" for i in range(60))
    rows = [(k, " ".join(f"w{r.randrange(10**9)}" for _ in range(10)) + " " + passage) for k in range(600)]
    rows += [(10_000 + k, rows[k][1][:-1]) for k in range(5)]  # one word changed: these do link
    out = N.ngram_jaccard_components(spark.createDataFrame(rows, "doc_id bigint, text string").repartition(3)).collect()
    assert all(x.component_id == x.doc_id % 10_000 for x in out)
    assert len(met) == 1 and met[0] < 20 * len(rows)


def test_shortened_texts(spark):
    from hearth.llm.substring_dedup import shortened_texts

    say = lambda w, n: " ".join(f"{w}{k}" for k in range(n))
    rows = [(1, say("a", 30)), (2, "own  start " + say("a", 30) + "\nown end"), (3, say("a", 30)), (4, None)]
    out = shortened_texts(spark.createDataFrame(rows, "doc_id bigint, text string")).collect()
    assert [tuple(r) for r in out] == [(2, "own start own end")]


def test_line_dedup_of_a_text_of_many_lines(spark):
    """A text of 60,000 lines, a third of them in another text as well, in its order."""
    from hearth.llm.line_dedup import drop_recurring_lines

    lines = [f"own line {k} {k * 7919 % 104729}" if k % 3 else f"shared {k} words of both texts" for k in range(60_000)]
    rows = [(1, "\n".join(lines)), (2, "\n".join(x for x in lines if x.startswith("shared"))), (3, "a\n\nb")]
    out = {r.doc_id: r for r in drop_recurring_lines(spark.createDataFrame(rows, "doc_id bigint, text string"), literal_texts=2, min_texts=10**9).collect()}
    assert (out[1].n_lines, out[1].n_dropped, out[1].kept_text) == (60_000, 20_000, "\n".join(x for x in lines if x.startswith("own")))
    assert (out[2].n_dropped, out[2].kept_text, out[3].kept_text) == (20_000, "", "a\n\nb")


def test_line_dedup_splits_a_text_once_not_once_a_line(spark):
    from hearth.llm.line_dedup import drop_recurring_lines

    rows = [(1, "own first line\nsame words here now\nown last line"), (2, "same words here now\n\nother \t words 7\n"), (3, None)]
    out = drop_recurring_lines(spark.createDataFrame(rows, "doc_id int, text string"), literal_texts=2)
    plan = out._jdf.queryExecution().optimizedPlan().toString().lower()
    assert "lambdafunction(" in plan and "lambdafunction(split(" not in plan
    assert {r.doc_id: r.kept_text for r in out.collect()} == {1: "own first line\nown last line", 2: "\nother \t words 7\n", 3: None}
