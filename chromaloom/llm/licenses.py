"""License scans by sentence rules, in DataFrame operations alone.

A text is normalised and split into sentences, and each sentence mapped to the
identifier of a known licence sentence (an SPDX tag to one identifier for each
licence it names); the sequence of identifiers is then matched against ordered
licence rules, the most specific first. What a rule matches is consumed, so that
a general rule doesn't report it again.

Every known sentence holds one of the words in CUES, in its normalised form.
Whole texts are normalised; only sentences with a cue meet the patterns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from chromaloom.llm.common import id_and_text, table

# Identifiers of the SPDX list that tags are searched for.
SPDX = [
    "0BSD", "AFL-3.0", "AGPL-3.0", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-1.1", "Apache-2.0", "Artistic-1.0", "Artistic-2.0", "BSD-2-Clause", "BSD-3-Clause",
    "BSD-4-Clause", "BSL-1.0", "BUSL-1.1", "CC-BY-2.0", "CC-BY-3.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-NC-ND-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC-BY-SA-3.0",
    "CC-BY-SA-4.0", "CC0-1.0", "CDDL-1.0", "CDDL-1.1", "CECILL-2.1", "CPL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "GFDL-1.3", "GPL-1.0-or-later",
    "GPL-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.0-only", "LGPL-2.0-or-later", "LGPL-2.1", "LGPL-2.1-only",
    "LGPL-2.1-or-later", "LGPL-3.0", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MPL-1.1", "MPL-2.0", "MS-PL", "NCSA", "ODbL-1.0", "OFL-1.1", "OSL-3.0", "PostgreSQL",
    "Python-2.0", "SSPL-1.0", "Unicode-3.0", "Unlicense", "UPL-1.0", "WTFPL", "Zlib",
]
# Names and versions of the GNU and Creative Commons licences.
GNU = [
    ("AGPL", r"gnu affero general public licen[sc]e", ["3"]),
    ("LGPL", r"gnu (lesser|library) general public licen[sc]e", ["3", "2.1", "2"]),
    ("GPL", r"gnu general public licen[sc]e", ["3", "2", "1"]),
]
CC = [
    ("BY-NC-ND", r"(cc[ -]by-nc-nd|creative commons attribution-noncommercial-noderiv(ative)?s?)"),
    ("BY-NC-SA", r"(cc[ -]by-nc-sa|creative commons attribution-noncommercial-sharealike)"),
    ("BY-NC", r"(cc[ -]by-nc|creative commons attribution-noncommercial)"),
    ("BY-ND", r"(cc[ -]by-nd|creative commons attribution-noderiv(ative)?s?)"),
    ("BY-SA", r"(cc[ -]by-sa|creative commons attribution-sharealike)"),
    ("BY", r"(cc[ -]by|creative commons attribution)"),
]
CC_VERSIONS = ["4.0", "3.0", "2.5", "2.0", "1.0"]


def _gnu() -> list[tuple[str, str]]:
    """For each licence and version: with later ones, it alone, neither said."""
    out = []
    for name, words, versions in GNU:
        for v in versions:
            plain = rf"(version|v\.?) ?{v.replace('.', chr(92) + '.')}"
            number = plain + "~"
            full = f"{name}_{v if '.' in v else v + '.0'}"
            out.append((f"{full}_LATER", rf"{words}.*{number}.*any later version"))
            out.append((f"{full}_ONLY", rf"{words}.*(foundation,? {number}|{plain}(\.0)?( of the licen[sc]e)? only)"))
            out.append((full, rf"{words},? (as published by the free software foundation,? )?(either )?{number}"))
        out.append((f"{name}_NAME", words))
    # the notice whose first sentence ends with "Foundation;"
    for v in ("3", "2.1", "2", "1"):
        plain = rf"version {v.replace('.', chr(92) + '.')}"
        out.append((f"LATER_{v if '.' in v else v + '.0'}", rf"^(either )?{plain}~.*any later version"))
        out.append((f"ONLY_{v if '.' in v else v + '.0'}", rf"^{plain}(\.0)? of the licen[sc]e"))
    return out


# Wording of public licences, as patterns over normalised
# sentences (lower case, one space, no quotes or comment marks). In order; the
# first that fits names the sentence. "$" stands for the end of a word and "~"
# for that of a version: a sentence may go on, since line ends are spaces.
SENTENCES = [
    ("MIT_NAME", r"(released|licensed|distributed|available) under the (terms of the )?(mit|expat) licen[sc]e$"),
    ("MIT_GRANT", r"permission is hereby granted, free of charge, to any person obtaining a copy of this software"),
    ("MIT_NOTICE", r"the above copyright notice and this permission notice shall be included in all copies"),
    ("ISC_GRANT", r"permission to use, copy, modify, and(/or| or)? ?distribute this software for any purpose with or without fee is hereby granted"),
    ("ASIS_MIT", r"the software is provided as is, without warranty of any kind"),
    ("ASIS_ISC", r"the software is provided as is and the author disclaims all warranties"),
    ("APACHE2_NAME", r"licensed under the apache licen[sc]e,? version 2\.0( \(the license ?\))?$"),
    ("APACHE2_USE", r"you may not use this file except in compliance with the license$"),
    ("APACHE2_COPY", r"you may obtain a copy of the license at"),
    ("APACHE2_ASIS", r"distributed under the license is distributed on an as is basis"),
    ("BSD_GRANT", r"redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD_SOURCE", r"redistributions of source code must retain the above copyright notice"),
    ("BSD_BINARY", r"redistributions in binary form must reproduce the above copyright notice"),
    ("BSD_ENDORSE", r"may be used to endorse or promote products derived from this software"),
    ("ASIS_BSD", r"this software is provided by .* as is and any express or implied warranties"),
    ("ZLIB_ASIS", r"this software is provided as-is, without any express or implied warranty"),
    ("ZLIB_LIABLE", r"in no event will the authors? be held liable for any damages arising from the use of this software"),
    ("ZLIB_GRANT", r"permission is granted to anyone to use this software for any purpose, including commercial applications"),
    ("BOOST_NAME", r"boost software licen[sc]e,? ?-? ?version 1\.0~"),
    ("BOOST_GRANT", r"permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software"),
    *_gnu(),
    ("MPL2_NAME", r"(subject to the terms of|under) the mozilla public licen[sc]e,? (v\.?|version) ?2\.0$"),
    ("MPL1_NAME", r"mozilla public licen[sc]e,? (v\.?|version) ?1\.1$"),
    ("EPL2_NAME", r"eclipse public licen[sc]e,? ?-? ?(v\.?|version)? ?2\.0$"),
    ("EPL1_NAME", r"eclipse public licen[sc]e,? ?-? ?(v\.?|version)? ?1\.0$"),
    ("ARTISTIC2_NAME", r"artistic licen[sc]e,? ?(v\.?|version)? ?2\.0$"),
    ("OFL_NAME", r"sil open font licen[sc]e,? (v\.?|version) ?1\.1$"),
    ("EUPL12_NAME", r"european union public licen[sc]e,? ?(v\.?|version)? ?1\.2$"),
    ("WTFPL_NAME", r"do what the fuck you want to public licen[sc]e"),
    *((f"CC_{name}_{v}", rf"{words},? {v.replace('.', chr(92) + '.')}~") for name, words in CC for v in CC_VERSIONS),
    ("CC0_NAME", r"(cc0 1\.0|creative commons zero)"),
    ("UNLICENSE", r"this is free and unencumbered software released into the public domain$"),
    ("RESERVED", r"all rights reserved$"),
    ("COPYRIGHT", r"^(portions )?copyright (\(c\) |© )?[0-9]{4}"),
    ("LICENSE_OTHER", r"(licensed|released|distributed) under (the |a )?.*licen[sc]e"),
]
#: Each pattern needs one of these words; a test takes them from the patterns.
CUES = ["licen", "copy", "permission", "software", "redistribution", "this file", "all rights reserved", "creative commons", "cc by", "cc-by", "cc0 1.0", "version"]
# Ordered rules over sequences of identifiers, each identifier in
# angle brackets. A rule may skip nothing but copyright lines. $1 is the name in
# the identifier.
_C = "(?:<COPYRIGHT>|<RESERVED>)*"
RULES = [
    ("Apache-2.0", f"<APACHE2_NAME>{_C}<APACHE2_USE>{_C}<APACHE2_COPY>(?:{_C}<APACHE2_ASIS>)?"),
    ("BSD-3-Clause", f"<BSD_GRANT>{_C}<BSD_SOURCE>{_C}<BSD_BINARY>{_C}<BSD_ENDORSE>(?:{_C}<ASIS_BSD>)?"),
    ("BSD-2-Clause", f"<BSD_GRANT>{_C}<BSD_SOURCE>{_C}<BSD_BINARY>(?:{_C}<ASIS_BSD>)?"),
    ("MIT", f"(?:<MIT_NAME>{_C})?<MIT_GRANT>{_C}<MIT_NOTICE>(?:{_C}<ASIS_MIT>)?"),
    ("ISC", f"<ISC_GRANT>{_C}<ASIS_ISC>"),
    ("Zlib", f"<ZLIB_ASIS>{_C}(?:<ZLIB_LIABLE>)?{_C}<ZLIB_GRANT>"),
    ("MIT", "<MIT_NAME>|<MIT_GRANT>"),
    ("Apache-2.0", "<APACHE2_NAME>"),
    ("$1", "<SPDX_([^>]+)>"),
    *((f"{name}-{v}-{end.lower()}", f"<{name}_NAME><{said}_{v}>") for name in ("LGPL", "GPL", "AGPL") for v in ("3.0", "2.1", "2.0", "1.0") for said, end in (("LATER", "or-later"), ("ONLY", "only"))),
    *((f"{name}-{v}-{end}", f"<{name}_{v}_{said}>") for name in ("AGPL", "LGPL", "GPL") for v in ("3.0", "2.1", "2.0", "1.0") for said, end in (("LATER", "or-later"), ("ONLY", "only"))),
    *((f"{name}-{v}", f"<{name}_{v}>(?:<{name}_NAME>)*") for name in ("AGPL", "LGPL", "GPL") for v in ("3.0", "2.1", "2.0", "1.0")),
    ("$1", "<(AGPL|LGPL|GPL)_NAME>"),
    ("MPL-2.0", "<MPL2_NAME>"),
    ("MPL-1.1", "<MPL1_NAME>"),
    ("EPL-2.0", "<EPL2_NAME>"),
    ("EPL-1.0", "<EPL1_NAME>"),
    ("Artistic-2.0", "<ARTISTIC2_NAME>"),
    ("BSL-1.0", f"<BOOST_NAME>(?:{_C}<BOOST_GRANT>)?|<BOOST_GRANT>"),
    ("OFL-1.1", "<OFL_NAME>"),
    ("EUPL-1.2", "<EUPL12_NAME>"),
    ("WTFPL", "<WTFPL_NAME>"),
    *((f"CC-{name}-{v}", f"<CC_{name}_{v}>") for name, _ in CC for v in CC_VERSIONS),
    ("CC0-1.0", "<CC0_NAME>"),
    ("Unlicense", "<UNLICENSE>"),
    ("Zlib", "<ZLIB_GRANT>"),
    ("ISC", "<ISC_GRANT>"),
    ("other", "<LICENSE_OTHER>"),
    ("all-rights-reserved", "<RESERVED>"),
]

_MARK = "\x1e"
# Comment marks become spaces, and so does a U+001E of the text; quotes go.
_FROM, _TO = "*#/|" + _MARK + "\"'`", " " * 5
_TAG = "spdx-license-identifier:"
# A tag ends with its line, whatever follows. Blank lines and sentence ends part
# sentences, other line ends are spaces; a line end after a sentence end parts too.
_STEPS = [
    (r"(spdx-license-identifier:[^\n]*)\n", "$1.\n"),
    (r"[.!?;]+[\x20\x09-\x0D]+", _MARK),
    (r"[\x20\x09]*\n[\x20\x09]*\n[\x20\x09-\x0D]*", _MARK),
    (r"[\x20\x09-\x0D]+", " "),
    (r" ?[.!?;]* ?$", ""),
]
_WORD_END, _VERSION_END = r"(?![a-z0-9+-]|\.[a-z0-9])", r"(?:\.0)?(?![0-9]|\.[0-9])"
_TOKEN = r"[a-z0-9]+(?:[.-]+[a-z0-9]+)*\+?"
_EXPRESSION = rf"spdx-license-identifier: ?(\(*{_TOKEN}\)*(?: (?:or|and|with) \(*{_TOKEN}\)*)*)"
_SPDX_NAMES = {k: v for n in SPDX for k, v in [(n.lower(), n), *([(n.lower().removesuffix("-or-later") + "+", n)] if n.endswith("-or-later") else [])]}


def _pattern(p: str, word_end: str = _WORD_END, version_end: str = _VERSION_END) -> str:
    return (p[:-1] + word_end if p.endswith("$") else p).replace("~", version_end)


def _any(text: Column, words: list[str]) -> Column:
    return reduce(lambda a, b: a | b, [text.contains(w) for w in words])


def _normalised(text: Column) -> Column:
    """The sentences of a text, between marks."""
    return reduce(lambda t, step: F.regexp_replace(t, *step), _STEPS, F.translate(F.lower(text), _FROM, _TO))


def _identified(sentence: Column) -> Column:
    """The identifiers of a sentence: none, one, or those of an SPDX tag."""
    out = F.lit(None).cast("string")
    for name, pattern in reversed(SENTENCES):
        out = F.when(sentence.rlike(_pattern(pattern)), F.lit(name)).otherwise(out)
    names = F.create_map(*(F.lit(x) for pair in _SPDX_NAMES.items() for x in pair))
    tokens = F.regexp_extract_all(F.regexp_extract(sentence, _EXPRESSION, 1), F.lit(_TOKEN), F.lit(0))
    tagged = F.transform(tokens, lambda t: F.concat(F.lit("SPDX_"), F.element_at(names, t)))
    return F.filter(F.when(sentence.contains(_TAG), tagged).otherwise(F.array(out)), lambda x: x.isNotNull())


def scan_licenses(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (identifiers in order, in angle brackets), licenses
    (names in the order of the rules, joined by commas) and n_sentences.

    Null and empty texts, and texts without a known sentence, have empty
    strings and 0; a null doc_id stays null; repeated rows return as often; an
    empty table gives an empty result; further columns are not read.
    """
    # the cue test looks at what the patterns will see
    split = id_and_text(docs).select("doc_id", _normalised(F.col("text")).alias("text"))
    sentences = F.filter(F.split("text", _MARK), lambda s: _any(s, CUES))
    named = F.flatten(F.transform(sentences, _identified))
    ids = split.select("doc_id", F.when(_any(F.col("text"), CUES), named).otherwise(F.array().cast("array<string>")).alias("ids"))
    out = ids.select("doc_id", F.concat_ws("", F.transform("ids", lambda s: F.concat(F.lit("<"), s, F.lit(">")))).alias("sentences"), F.size("ids").cast("long").alias("n_sentences"))
    # each rule looks at what the earlier ones have left
    state = F.struct(F.col("sentences").alias("rest"), F.array().cast("array<string>").alias("found"))
    rules = F.array(*(F.struct(F.lit(name).alias("name"), F.lit(rule).alias("rule")) for name, rule in RULES))
    left = F.aggregate(rules, state, _applied)["found"]
    return out.select("doc_id", "sentences", F.when(F.col("sentences") == "", "").otherwise(F.concat_ws(",", left)).alias("licenses"), "n_sentences")


def _applied(state: Column, rule: Column) -> Column:
    names = F.when(rule["name"] == "$1", F.regexp_extract_all(state["rest"], rule["rule"], F.lit(1))).otherwise(F.array(rule["name"]))
    after = F.struct(F.regexp_replace(state["rest"], rule["rule"], F.lit("")).alias("rest"), F.array_union(state["found"], names).alias("found"))
    return F.when(F.regexp_like(state["rest"], rule["rule"]), after).otherwise(state)


def op4_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _quoted(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _op4_sql() -> str:
    """Every sentence meets every pattern: no cue decides. Ends of words are
    characters that follow, since this engine's patterns can't look ahead."""
    ends = (r"(?:$|[^a-z0-9+.-]|\.(?:$|[^a-z0-9]))", r"(?:\.0)?(?:$|[^0-9.]|\.(?:$|[^0-9]))")
    case = " ".join(f"when regexp_matches(s, {_quoted(_pattern(p, *ends))}) then {_quoted(n)}" for n, p in SENTENCES)
    tags = " ".join(f"when {_quoted(k)} then {_quoted(v)}" for k, v in _SPDX_NAMES.items())
    text = "lower(coalesce(text, ''))"
    for old, new in ((chr(34), ""), ("'", ""), ("`", ""), ("*", " "), ("#", " "), ("/", " "), ("|", " ")):
        text = f"replace({text}, {_quoted(old)}, {_quoted(new)})"
    steps, last = [], "t0"
    for i, (name, rule) in enumerate(RULES):
        r, q = _quoted(rule), _quoted(name)
        more = f"case when list_contains(found, {q}) then [] else [{q}] end"
        if name == "$1":  # in order of the first mention
            more = f"list_filter(list_reduce(list_transform(regexp_extract_all(rest, {r}, 1), lambda x: [x]), lambda a, b: case when list_contains(a, b[1]) then a else a || b end), lambda x: not list_contains(found, x))"
        steps.append(
            f"t{i + 1} as (select doc_id, sentences, n_sentences, regexp_replace(rest, {r}, '', 'g') as rest, "
            f"case when regexp_matches(rest, {r}) then found || {more} else found end as found from t{i})"
        )
        last = f"t{i + 1}"
    return (
        rf"""with n as (select doc_id, regexp_replace(replace({text}, chr(30), ' '), '(spdx-license-identifier:[^\n]*)\n', '\1.' || chr(10), 'g') as t from documents),
m as (select doc_id, regexp_replace(regexp_replace(t, '[.!?;]+[\x20\x09-\x0D]+', chr(30), 'g'), '[\x20\x09]*\n[\x20\x09]*\n[\x20\x09-\x0D]*', chr(30), 'g') as t from n),
w as (select doc_id, string_split(regexp_replace(regexp_replace(t, '[\x20\x09-\x0D]+', ' ', 'g'), ' ?[.!?;]* ?$', ''), chr(30)) as parts from m),
s as (select doc_id, list_filter(flatten(list_transform(parts, lambda s: case when contains(s, 'spdx-license-identifier:')
  then list_transform(regexp_extract_all(regexp_extract(s, {_quoted(_EXPRESSION)}, 1), {_quoted(_TOKEN)}), lambda x: 'SPDX_' || case x {tags} end)
  else [case {case} end] end)), lambda x: x is not null) as ids from w),
t0 as (select doc_id, array_to_string(list_transform(ids, lambda s: '<' || s || '>'), '') as sentences,
cast(len(ids) as bigint) as n_sentences, array_to_string(list_transform(ids, lambda s: '<' || s || '>'), '') as rest, cast([] as varchar[]) as found from s), """
        + ", ".join(steps)
        + f" select doc_id, sentences, array_to_string(found, ',') as licenses, n_sentences from {last}"
    )


OP4_SQL = _op4_sql()
