"""BPE, PII, language ID, licences, sharding and chats."""

import hashlib
import random
import zlib

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from chromaloom.llm import bpe, chat, language_id, licenses, pii, sharding

ODD = ["<|endoftext|> a<|endoftext|>", "  \n\t x   y\n\n", "naïve café — 你好 🙂🙂 \u200d\u0301", "a" * 3000, " " * 500 + "x", "1234567890" * 50, "-" * 40, "I'll we've don't 'S", "\x00\x01\ufffd", ""]


@pytest.fixture(scope="module")
def reference_tokenizer():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(bpe.default_path())


@pytest.fixture(scope="module")
def trie():
    with open(bpe.default_path(), "rb") as f:
        return bpe.TrieBpe(f.read())


@settings(max_examples=120, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("abcdefghi ABCéßñ .,\n\t'0123-–😀漢\xa0the<|>")), max_size=20))
def test_encode_matches_the_library(reference_tokenizer, trie, texts):
    for text, ids in zip(texts + ODD, trie.encode(texts + ODD)):
        want = reference_tokenizer.encode(text, add_special_tokens=False).ids
        assert np.frombuffer(ids, "<u4").tolist() == want
        assert trie.decode(ids) == reference_tokenizer.decode(want, skip_special_tokens=False) == text


def test_forgetting_words_changes_nothing(trie, reference_tokenizer, monkeypatch):
    monkeypatch.setattr(bpe, "MAX_WORDS", 20)
    monkeypatch.setattr(bpe, "MAX_PAIRS", 30)
    rng = random.Random(3)
    texts = [" ".join("".join(rng.choice("thersiona") for _ in range(rng.randrange(1, 9))) for _ in range(40)) for _ in range(50)]
    for i in range(0, 50, 5):
        for text, ids in zip(texts[i : i + 5], trie.encode(texts[i : i + 5])):
            assert np.frombuffer(ids, "<u4").tolist() == reference_tokenizer.encode(text, add_special_tokens=False).ids


def test_bpe_rows(spark, documents, reference_tokenizer):
    rows = [(1, "hello world"), (1, "hello world"), (None, None), (2, ""), (3, "x " * 50_000)]
    got = bpe.token_digests(bpe.decode(spark, bpe.encode(spark, documents(rows))), "ids").collect()
    assert sorted(map(str, got)) == sorted(map(str, bpe.token_digests(bpe.round_trip(spark, documents(rows)), "ids").collect()))
    assert sorted((r.doc_id or 0, r.n_tokens) for r in got) == [(0, 0), (1, 2), (1, 2), (2, 0), (3, 50_001)]
    one = next(r for r in got if r.doc_id == 1)
    ids = reference_tokenizer.encode("hello world", add_special_tokens=False).ids
    assert np.frombuffer(one.ids, "<u4").tolist() == ids and one.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
    assert one.decoded_sha256 == hashlib.sha256(b"hello world").hexdigest()
    assert bpe.encode(spark, documents([])).count() == 0


def base(text):
    return pii._joined([s for s in pii.spans(text) if s[2] in pii.BASE])


@settings(max_examples=400, deadline=None)
@given(st.text(alphabet=st.sampled_from("ab@.-+%_ 0123456789()\n:/é"), max_size=60))
def test_base_spans_match_the_patterns(text):
    assert base(text) == pii.base_by_regex(text)


RUNS = ["1", "a@", "@", "1.", "+1 ", "a.b@", "a://", "://", "a://b@", "a://b@c/", "a://@c", "iban ", "iban gb82", "ssn ", "account no. ", "a/c 12345", "social security "]


def test_long_runs_are_linear():
    """Runs of a megabyte of whatever an anchor may be."""
    import time

    for run in [*RUNS, "a"]:
        text = run * (1_000_000 // len(run)) + ("@" if run == "a" else "")
        start = time.time()
        pii.spans(text)
        assert time.time() - start < 10, run


def test_cues_in_any_spelling():
    for cue in ("iBan", "IBAN", "iban", "IbAn"):
        assert [k for _, _, k in pii.spans(f"İ {cue}: GB82WEST12345698765432")] == ["iban"]
    assert [k for _, _, k in pii.spans("SOCIAL Security no 123-45-6789; ACCount 1234567")] == ["ssn", "account"]
    assert pii.spans("İİ aCCT 1234567") == [(8, 15, "account")]


def test_cued_spans():
    text = "IBAN: GB82 WEST 1234 5698 7654 32 ok; see https://bob:pw@h.example.com/x. SSN 123-45-6789, account no. 1234567890"
    assert [(k, text[s:e]) for s, e, k in pii.spans(text)] == [
        ("iban", "GB82 WEST 1234 5698 7654 32"), ("login", "https://bob:pw@h.example.com/x"), ("email", "pw@h.example.com"), ("ssn", "123-45-6789"), ("account", "1234567890"),
    ]
    assert pii.spans("IBAN GB82 WEST 1234 5698 7654 33") == [] and pii.spans("ssn 000-12-3456") == []
    assert pii.redact("mail a@b.co or 10.0.0.1") == "mail [email] or [ip]"


def test_pii_rows(spark, documents, write_tables):
    rows = [(1, "a@b.co 10.0.0.1"), (None, None), (2, ""), (1, "a@b.co 10.0.0.1"), (3, "4111 1111 1111 1111 +49 (30) 123456")]
    to = write_tables(documents=documents(rows))
    got = {(r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.spans): r.base_sha256 for r in pii.op6_pii(spark, to).collect()}
    assert set(got) == {(1, 1, 1, 0, 0, "email:0:6,ip:7:15"), (None, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, ""), (3, 0, 0, 1, 1, "card:0:19,phone:20:35")}
    assert got[2, 0, 0, 0, 0, ""] == hashlib.sha256(b"").hexdigest()
    assert pii.find_pii(documents([])).count() == 0


SAID = {"en": "the quick brown fox and the lazy dog were there with them", "de": "der schnelle braune fuchs und der faule hund waren nicht hier", "ru": "быстрая лиса и ленивая собака были там вместе"}


def test_language_spans(spark, documents):
    train = documents([(i, SAID[lang], lang) for i, lang in enumerate(["en", "de", "ru"] * 20)] + [(900, None, "en"), (901, "x", None)])
    model = language_id.fit(spark, train)
    assert model.langs == ["de", "en", "ru"]
    rows = [(1, SAID["en"]), (2, f"{SAID['de']}. {SAID['en']}. {SAID['de']}"), (3, None), (4, "12 ² !"), (5, SAID["ru"] + " the"), (None, ""), (6, "λόγος"), (7, SAID["de"] * 2000)]
    got = {r.doc_id: r for r in language_id.identify(spark, documents(rows), model).collect()}
    assert {k: v.lang_pred for k, v in got.items()} == {1: "en", 2: "de", 3: "und", 4: "und", 5: "ru", None: "und", 6: "de", 7: "de"}
    assert [s.lang for s in got[2].spans] == ["de", "en", "de"] and 0.5 < got[2].score < 1
    first = len(SAID["de"])
    assert abs(got[2].spans[0].end - first) <= 12 and got[2].spans[-1].end == len(rows[1][1])
    assert got[3].score == 0 and got[3].spans == []
    assert language_id.identify(spark, documents([]), model).count() == 0


def test_spans_start_where_words_start():
    """Also where lower-casing makes one letter two."""
    text = "İstanbul İİ and the İ end"
    path = np.array([0, 0, 1, 1, 0, 1])
    assert len(language_id.words(text)) == 6
    got = language_id._spans(text, path, ["tr", "en"])
    assert [(text[s["start"] : s["end"]], s["lang"]) for s in got] == [("İstanbul İİ ", "tr"), ("and the ", "en"), ("İ ", "tr"), ("end", "en")]


def test_more_than_256_languages(spark, documents):
    m = language_id.Model.__new__(language_id.Model)
    m.langs, m.scores = [f"l{i:03}" for i in range(400)], np.zeros((400, 400), np.float32)
    np.fill_diagonal(m.scores, 50)
    assert m.paths([np.repeat([399, 7, 300], 3)])[0].tolist() == [399] * 3 + [7] * 3 + [300] * 3
    with pytest.raises(ValueError, match="languages"):
        language_id.fit(spark, documents([(i, "text", f"l{i}") for i in range(language_id.MAX_LANGS + 1)]))


def test_very_long_texts_keep_their_scores():
    """A switch late in a long text is seen as early ones are."""
    m = language_id.Model.__new__(language_id.Model)
    m.langs, m.scores = ["a", "b"], np.array([[0, -0.4], [-0.4, 0]], np.float32)
    n = 100_000
    path = m.paths([np.concatenate([np.zeros(n, np.int64), np.ones(40, np.int64)])])[0]
    assert (path[:n] == 0).all() and (path[n:] == 1).all()


def test_language_without_training(spark, documents):
    model = language_id.fit(spark, documents([]))
    assert language_id.identify(spark, documents([(1, "text")]), model).first().lang_pred == "und"


def test_viterbi_is_optimal():
    import itertools

    rng = np.random.default_rng(4)
    m = language_id.Model.__new__(language_id.Model)
    m.langs, m.scores = ["a", "b", "c"], rng.normal(0, 9, (12, 3)).astype(np.float32)
    rows = [np.array(rng.integers(0, 12, n)) for n in (1, 5, 0, 7, 3)]
    for r, path in zip(rows, m.paths(rows)):
        cost = lambda p: sum(m.scores[w, l] for w, l in zip(r, p)) - language_id.SWITCH * sum(x != y for x, y in zip(p, p[1:]))  # noqa: E731,B023
        if len(r):
            assert cost(path) == pytest.approx(max(map(cost, itertools.product(range(3), repeat=len(r)))), abs=1e-3)


def test_held_out_accuracy(spark, sf_dir):
    got = language_id.op1_language_id(spark, sf_dir).toPandas()
    true = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "lang").toPandas()
    both = got.merge(true, on="doc_id")
    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 4 == 2)).all()
    held = both[both.held_out]
    assert (held.lang_pred == held.lang).mean() >= 0.95


MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software. The above copyright notice and this permission notice shall be included in all copies. The Software is provided \"as is\", without warranty of any kind."


def test_licences(spark, documents):
    rows = [
        (1, "// " + MIT.replace(". ", ".\n// ")), (2, "Intro text.\nReleased under the MIT License.\nMore"), (3, "No licence here."), (4, None), (5, ""),
        (6, "Licensed under the Apache License,\nVersion 2.0 (the \"License\"). You may not use this file except in compliance with the License. You may obtain a copy of the License at x"),
        (7, "This work is licensed under the GNU General Public License, version 3.\nLicensed under CC BY-NC 4.0."), (None, "All rights reserved."), (8, "ab " * 40_000 + ". SPDX-License-Identifier: BSD-2-Clause"),
        (1, "// " + MIT.replace(". ", ".\n// ")),
    ]
    got = licenses.scan_licenses(documents(rows)).collect()
    found = {r.doc_id: r.licenses for r in got}
    assert found == {1: "MIT", 2: "MIT", 3: "", 4: "", 5: "", 6: "Apache-2.0", 7: "GPL-3.0,CC-BY-NC-4.0", None: "all-rights-reserved", 8: "BSD-2-Clause"}
    assert len(got) == len(rows) and next(r for r in got if r.doc_id == 1).sentences == "<MIT_GRANT><MIT_NOTICE><ASIS_MIT>"
    assert licenses.scan_licenses(documents([])).count() == 0


def test_licences_before_further_text(spark, documents):
    """A sentence goes on over line ends; what it names ends before that."""
    rows = [
        (1, "// SPDX-License-Identifier: MIT\n#include <x.h>\nint x;", "MIT", "<SPDX_MIT>"),
        (2, "# SPDX-License-Identifier: Apache-2.0\n# Copyright 2020 X", "Apache-2.0", "<SPDX_Apache-2.0><COPYRIGHT>"),
        (3, "/* SPDX-License-Identifier: GPL-2.0-only */\r\n#include <x.h>", "GPL-2.0-only", "<SPDX_GPL-2.0-only>"),
        (4, "This project is licensed under the MIT License - see the LICENSE file for details.", "MIT", "<MIT_NAME>"),
        (5, "Licensed under the Apache License, Version 2.0 (the \"License\")\nsee NOTICE", "Apache-2.0", "<APACHE2_NAME>"),
        (6, "SPDX-License-Identifier: MIT-0\nx", "", ""), (7, "SPDX-License-Identifier: MPL-2.0-no-copyleft-exception\nx", "", ""),
        (8, "SPDX-License-Identifier: MIT.\nMore", "MIT", "<SPDX_MIT>"),
    ]
    got = licenses.scan_licenses(documents([r[:2] for r in rows])).collect()
    assert {r.doc_id: (r.licenses, r.sentences) for r in got} == {i: (n, s) for i, _, n, s in rows}


def test_licence_screen_loses_nothing(spark, documents, sf_dir, monkeypatch):
    rows = [
        (1, "All rights\nreserved.", "all-rights-reserved"), (2, "# This is free and unencumbered software released into the public\n# domain.", "Unlicense"),
        (3, "Creative\nCommons Attribution 4.0", "CC-BY-4.0"), (4, "'CC'\n// BY-SA 4.0", "CC-BY-SA-4.0"), (5, "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND", ""),
        (6, "The name of X may be used to endorse or promote products derived from this software.", ""), (7, "No word of it.", ""),
    ]
    got = {r.doc_id: r for r in licenses.scan_licenses(documents([r[:2] for r in rows])).collect()}
    assert {i: r.licenses for i, r in got.items()} == {i: n for i, _, n in rows}
    assert (got[5].sentences, got[6].sentences, got[7].sentences) == ("<ASIS_MIT>", "<BSD_ENDORSE>", "")


def test_broken_lines_quotes_and_marks(spark, documents):
    rows = [
        (1, "All rights\nreserved.", "<RESERVED>"), (2, "// All rights\n// reserved.", "<RESERVED>"), (3, "IT IS PROVIDED. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND", "<ASIS_MIT>"),
        (4, "This is free and unencumbered software released into the public\ndomain.", "<UNLICENSE>"), (5, "Creative\nCommons Zero", "<CC0_NAME>"), (6, "CC\nBY 4.0", "<CC_BY_4.0>"),
        (7, "a\x1eall rights reserved\x1eb", ""), (8, "x.\x1eAll rights\x1ereserved", "<RESERVED>"), (9, "'All' \"rights\" `reserved`", "<RESERVED>"),
    ]
    got = {r.doc_id: r.sentences for r in licenses.scan_licenses(documents([r[:2] for r in rows])).collect()}
    want = {i: s for i, _, s in rows}
    want[7] = ""  # no sentence starts there, and the word after it goes on
    assert got | {7: ""} == want


def test_versions_and_options(spark, documents):
    gnu = "under the terms of the GNU {} as published by the Free Software Foundation{} version {} of the License{}"
    later = ", or (at your option) any later version."
    rows = [
        (1, gnu.format("General Public License", ", either", "3", later), "GPL-3.0-or-later"), (2, gnu.format("General Public License", "; either", "2", later), "GPL-2.0-or-later"),
        (3, gnu.format("General Public License", ",", "2", "."), "GPL-2.0-only"), (4, gnu.format("Lesser General Public License", "; either", "2.1", later), "LGPL-2.1-or-later"),
        (5, gnu.format("Affero General Public License", ", either", "3", later), "AGPL-3.0-or-later"), (6, "GNU GPL. Licensed under the GNU General Public License v2 only.", "GPL-2.0-only"),
        (7, "GNU Lesser General Public License version 2.1", "LGPL-2.1"), (8, "the GNU General Public License", "GPL"), (9, "SPDX-License-Identifier: (MIT OR Apache-2.0) AND LGPL-2.1+\nx", "MIT,Apache-2.0,LGPL-2.1-or-later"),
        (10, "SPDX-License-Identifier: GPL-2.0-only WITH Classpath-exception-2.0", "GPL-2.0-only"), (11, "Eclipse Public License - v 2.0", "EPL-2.0"), (12, "under the Boost Software License, Version 1.0. (See x)", "BSL-1.0"),
        (13, "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.\n\nPermission is granted to anyone to use this software for any purpose, including commercial applications, x", "Zlib"),
        (14, "The Artistic License 2.0", "Artistic-2.0"), (15, "Licensed under CC BY-SA 3.0.", "CC-BY-SA-3.0"), (16, gnu.format("General Public License", "; ", "2", "."), "GPL-2.0-only"),
    ]
    got = {r.doc_id: r.licenses for r in licenses.scan_licenses(documents([r[:2] for r in rows])).collect()}
    assert got == {i: n for i, _, n in rows}


def test_every_pattern_needs_a_cue():
    """Each way through a pattern's alternatives says a cue."""
    plain = lambda p: p.replace("licen[sc]e", "license").replace("cc[ -]by", "cc by").replace("\\.", ".")
    for name, pattern in licenses.SENTENCES:
        alternatives = [plain(pattern)]
        if pattern.startswith("(cc") and "|" in pattern:
            alternatives = plain(pattern).split("|")[:2]
        for p in alternatives:
            while "(" in p and "?" in p and (q := __import__("re").sub(r"\([^()]*\)\?", "", p)) != p:
                p = q
            assert any(cue in p for cue in licenses.CUES), (name, p)


def test_op4_sql_agrees_on_odd_texts(spark, documents, write_tables):
    import duckdb
    from compare import assert_same

    odd = ["All rights\nreserved.", "// All rights\n// reserved.", "\"CC\nBY 4.0\"", "x.\x1eAll rights\x1ereserved", "# SPDX-License-Identifier: (MIT OR 0BSD)\r\n# y", "GNU Lesser General Public License, version 2.1 or any later version",
           "Licensed under the MIT Licenses", "GNU General Public License v2.0.1", "GNU General Public License; version 3 of the license", MIT, None, "", "All rights reserved.5", "all rights reserved-", "© Copyright (c) 1999 x"]
    to = write_tables(documents=documents(list(enumerate(odd))))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{to}/documents.parquet/*.parquet'")
    assert_same(licenses.op4_licenses(spark, to).toPandas(), con.sql(licenses.OP4_SQL).df())


def test_op4_sql(spark, sf_dir, duck):
    from compare import assert_same

    assert_same(licenses.op4_licenses(spark, sf_dir).toPandas(), duck.sql(licenses.OP4_SQL).df())


def test_shards(spark, documents, tmp_path):
    rows = [(i, "same" if i % 3 == 0 else f"text {i}" * (i % 50)) for i in range(2000)] + [(None, None), (None, None), (7, "again"), (7, "again"), (3000, "y" * 100_000)]
    docs = documents(rows)
    sharding.write_shards(spark, docs, str(tmp_path / "s"), shards=5, bucket_bytes=4096)
    got = sharding.read_shards(spark, str(tmp_path / "s"), docs)
    assert got.select("record.*").columns == docs.columns
    pdf = got.select("shard", "slot", "record.doc_id", "record.text").toPandas()
    assert len(pdf) == len(rows) and sorted(map(str, pdf.text)) == sorted(str(t) for _, t in rows)
    for _, g in pdf.groupby("shard"):
        assert sorted(g.slot) == list(range(len(g)))
    assert pdf.groupby(pdf.doc_id.fillna(-1)).shard.nunique().max() == 1
    counts = pdf.shard.value_counts()
    assert counts.min() > 300 and counts.max() < 520
    one = pdf[(pdf.shard == 0) & pdf.doc_id.notna()]
    assert abs(np.corrcoef(one.doc_id, one.slot)[0, 1]) < 0.2
    hot = pdf[pdf.text == "same"].shard.value_counts()
    assert hot.min() > 90


def test_slots_do_not_depend_on_partitions_and_files(spark, documents, tmp_path):
    """Nor does the place of each of many copies, which no bucket gathers."""
    rows = [(i, f"text {i}" * (i % 9)) for i in range(600)] + [(7, "copy " * 20)] * 500 + [(None, "free " * 20)] * 300 + [(3, None)] * 9 + [(5000, "long" * 9000)]
    found = []
    for n, (parts, files) in enumerate([(8, 1), (3, 7), (20, 4)]):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        docs = documents(rows, extra=False).repartition(files, "n_chars") if n else documents(rows, extra=False).orderBy("text")
        sharding.write_shards(spark, docs, str(tmp_path / f"s{n}"), shards=3, bucket_bytes=4096)
        got = sharding.read_shards(spark, str(tmp_path / f"s{n}"), docs)
        found.append(sorted(map(str, got.select("shard", "slot", "record.doc_id", "record.text").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1] == found[2] and len(found[0]) == len(rows)
    parts = spark.read.parquet(str(tmp_path / "s0" / "rows")).groupBy("shard", "bucket", "part").count().toPandas()
    assert parts["count"].max() < 150 and parts.part.max() > 2


def test_slots_without_copies(spark, documents, tmp_path):
    """Nothing is split, and rows shuffle once, into as many partitions as buckets."""
    docs = documents([(i, f"text {i}" * (i % 9)) for i in range(900)], extra=False)
    found = []
    for n, (parts, files) in enumerate([(8, 1), (3, 7)]):
        spark.conf.set("spark.sql.shuffle.partitions", str(parts))
        sharding.write_shards(spark, docs.repartition(files, "text"), str(tmp_path / f"s{n}"), shards=3, bucket_bytes=4096)
        found.append(sorted(map(str, sharding.read_shards(spark, str(tmp_path / f"s{n}"), docs).select("shard", "slot", "record.doc_id").collect())))
    spark.conf.set("spark.sql.shuffle.partitions", "4")
    assert found[0] == found[1]


def test_shuffles_are_uniform(spark, documents, tmp_path):
    """In one bucket, pairs of rows come in either order and rows at any slot."""
    docs = documents([(1, str(i)) for i in range(300)], extra=False)
    slots = np.zeros((4, 300))
    for seed in range(4):
        sharding.write_shards(spark, docs, str(tmp_path / f"u{seed}"), shards=1, seed=seed)
        for r in sharding.read_shards(spark, str(tmp_path / f"u{seed}"), docs).collect():
            slots[seed, int(r.record.text)] = r.slot
    assert all(sorted(x) == list(range(300)) for x in slots)
    assert all(0.42 < np.mean(x[1:] > x[:-1]) < 0.58 for x in slots)
    assert abs(np.corrcoef(slots) - np.eye(4)).max() < 0.25 and 100 < slots[:, :30].mean() < 200


def test_one_more_shard_only_takes_rows(spark):
    from pyspark.sql import functions as F

    got = spark.range(5000).select(sharding.shard_of(F.col("id"), 24).alias("a"), sharding.shard_of(F.col("id"), 25).alias("b")).toPandas()
    moved = got[got.a != got.b]
    assert (moved.b == 24).all() and 120 < len(moved) < 290


def test_no_rows_no_shards(spark, documents, tmp_path):
    docs = documents([])
    sharding.write_shards(spark, docs, str(tmp_path / "s"))
    assert sharding.read_shards(spark, str(tmp_path / "s"), docs).count() == 0


def test_op5_digests(spark, sf_dir):
    got = sharding.op5_sharding(spark, sf_dir).toPandas().set_index("doc_id")
    for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect():
        raw = (r.text or "").encode()
        assert (got.loc[r.doc_id, "size"], got.loc[r.doc_id, "text_crc32"]) == (len(raw) + 8, zlib.crc32(raw))


@settings(max_examples=200, deadline=None)
@given(st.text(alphabet=st.sampled_from("<>[]\\/s|ROLE INST\nä")), st.text(alphabet=st.sampled_from("<s>[ROLE]/\\ab")))
def test_escape_round_trip(text, role):
    made, _ = chat.format_turn(role, text)
    assert chat.read_turns(made) == [(role, text)]
    inner = chat.escape(text)
    assert not any(c in inner for c in (chat.OPEN, chat.MID, chat.CLOSE, "<s>", "</s>"))


def conversations(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as tree", "'x' as pack", "'x' as node")


def slow_digests(rows):
    out = {}
    for conv in {r[0] for r in rows}:
        turns = sorted((t if t is not None else -1, r or "", x or "") for c, t, r, x in rows if c == conv)
        sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
        loss = "".join(x for _, r, x in turns if r == "assistant")
        out[conv] = (len(turns), sha("".join(f"{r}\n{x}\n" for _, r, x in turns)), len(loss), sha(loss), sum(len(chat.format_turn(r, x)[0]) for _, r, x in turns))
    return out


def test_chats_round_trip(spark):
    rng = random.Random(2)
    rows = []
    for c in range(150):
        for t in range(rng.randrange(1, 7)):
            rows.append((c, t, ["user", "assistant"][t % 2], f"common {t}" if rng.random() < 0.7 else f"</s>[ROLE] {c}\\"))
    for c in range(200, 260):
        rows += [(c, 0, "user", "hot"), (c, 1, "assistant", "same")]
    rows += [(300, 0, None, None), (301, None, "user", "x"), (301, 0, "assistant", "long " * 20_000), (302, 0, "user", "a"), (302, 0, "user", "a"), (None, 0, "user", "q")]
    packs, members = chat.format_chats(spark, conversations(spark, rows), pack=8)
    got = {r.conv_id: (r.n_turns, r.turns_sha256, r.loss_chars, r.loss_sha256, r.formatted_chars) for r in chat.chat_digests(packs, members).collect()}
    assert got == slow_digests(rows)
    made = packs.collect()
    assert max(len(p.leaves) for p in made) < 40
    for p in made:
        for n in p.nodes:
            parent = p.nodes[n.parent] if n.parent >= 0 else None
            assert n.position == (parent.position + parent.end - parent.start if parent else 0)
            assert sum(i.end - i.start for i in n.attends) == n.position + n.end - n.start and n.attends[-1].end == n.end
            assert len(chat.position_ids(n.asDict())) == n.end - n.start
    total = sum(len(p.text) for p in made)
    assert total < sum(g[4] for g in got.values())


def test_no_chats(spark):
    packs, members = chat.format_chats(spark, conversations(spark, []))
    assert packs.count() == 0 and chat.chat_digests(packs, members).count() == 0


def test_op8_sql(spark, sf_dir, duck):
    from compare import assert_same

    got = chat.op8_chat_format(spark, sf_dir).toPandas()
    assert_same(got, duck.sql(chat.OP8_SQL).df())
    assert (got.conv_id == -1).sum() == 1
