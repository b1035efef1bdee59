"""License scans by ordered signature rules.

Each rule is a regex with a label, a priority and a keyword gate: a document is searched for all
keywords at once, and only rules whose keyword occurs run. Where detections overlap, one contained
in another of a higher priority, or of the same priority and longer, is suppressed; base phrases are
never suppressed. A rule runs on the passages around its keywords, and one whose matches may be of any
length on the whole lines that hold its beginning, so a match is found however long it is; the time grows
as the text. Nulls are empty texts. Rows are scanned one by one, so repeated rows give repeated results; an
empty table gives no rows; other columns are not read.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections.abc import Iterator
from functools import cache
from itertools import accumulate, groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tidewire.llm.common import ship, sliced, table

#: Base phrases and labels.
BASE = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}

#: label | names as regexes | SPDX identifiers as regexes | URL parts as regexes
FAMILIES = r"""
apache-2.0 | apache (?:software )?license,? version 2(?:\.0)? ; apache license 2(?:\.0)? ; apache-2\.0 license | apache-2\.0 | apache\.org/licenses/license-2\.0 ; opensource\.org/licenses/apache-2\.0
apache-1.1 | apache software license,? version 1\.1 | apache-1\.1 | apache\.org/licenses/license-1\.1
mit | (?:the )?mit license ; (?:the )?mit/x11 license ; expat license | mit | opensource\.org/licenses/mit
mit-0 | mit no attribution | mit-0 | opensource\.org/licenses/mit-0
bsd-2-clause | (?:simplified|freebsd|2-clause) bsd license ; bsd 2-clause(?: license)? | bsd-2-clause | opensource\.org/licenses/bsd-2-clause
bsd-3-clause | (?:new|revised|modified|3-clause) bsd license ; bsd 3-clause(?: license)? | bsd-3-clause | opensource\.org/licenses/bsd-3-clause
bsd-4-clause | (?:original|old|4-clause) bsd license | bsd-4-clause | directory\.fsf\.org/wiki/license:bsd_4clause
0bsd | zero[- ]clause bsd(?: license)? ; bsd zero clause license | 0bsd | opensource\.org/licenses/0bsd
isc | isc license ; internet systems consortium license | isc | opensource\.org/licenses/isc
gpl-1.0 | gnu general public license,? (?:version|v\.?) ?1 ; gpl ?v1(?:\.0)? | gpl-1\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/old-licenses/gpl-1\.0
gpl-2.0 | gnu general public license,? (?:version|v\.?) ?2 ; gpl ?v2(?:\.0)? ; gnu gpl 2 | gpl-2\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-3.0 | gnu general public license,? (?:version|v\.?) ?3 ; gpl ?v3(?:\.0)? ; gnu gpl 3 | gpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/gpl-3\.0
lgpl-2.0 | gnu (?:library|lesser) general public license,? (?:version|v\.?) ?2(?:\.0)?(?!\.\d) ; lgpl ?v2(?:\.0)?(?!\.\d) | lgpl-2\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/old-licenses/lgpl-2\.0
lgpl-2.1 | gnu lesser general public license,? (?:version|v\.?) ?2\.1 ; lgpl ?v2\.1 | lgpl-2\.1(?:-only|-or-later|\+)? | gnu\.org/licenses/(?:old-licenses/)?lgpl-2\.1
lgpl-3.0 | gnu lesser general public license,? (?:version|v\.?) ?3 ; lgpl ?v3 | lgpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/lgpl-3\.0
agpl-3.0 | gnu affero general public license,? (?:version|v\.?) ?3 ; agpl ?v3 | agpl-3\.0(?:-only|-or-later|\+)? | gnu\.org/licenses/agpl-3\.0
gfdl | gnu free documentation license | gfdl-1\.[123](?:-only|-or-later)? | gnu\.org/licenses/fdl
mpl-1.1 | mozilla public license,? (?:version|v\.?) ?1\.1 | mpl-1\.1 | mozilla\.org/mpl/1\.1
mpl-2.0 | mozilla public license,? (?:version|v\.?) ?2(?:\.0)? ; mozilla public license 2\.0 | mpl-2\.0 | mozilla\.org/mpl/2\.0
epl-1.0 | eclipse public license,? (?:version|v\.?) ?1(?:\.0)? ; eclipse public license - v 1\.0 | epl-1\.0 | eclipse\.org/legal/epl-v10
epl-2.0 | eclipse public license,? (?:version|v\.?) ?2(?:\.0)? ; eclipse public license - v 2\.0 | epl-2\.0 | eclipse\.org/legal/epl-(?:v20|2\.0)
cddl-1.0 | common development and distribution license,? (?:version|v\.?) ?1\.0 ; common development and distribution license 1\.0 | cddl-1\.0 | opensource\.org/licenses/cddl-1\.0
cpl-1.0 | common public license,? (?:version|v\.?) ?1\.0 | cpl-1\.0 | opensource\.org/licenses/cpl1\.0
artistic-1.0 | artistic license 1\.0 | artistic-1\.0(?:-perl|-cl8)? | opensource\.org/licenses/artistic-1\.0
artistic-2.0 | artistic license,? (?:version )?2\.0 | artistic-2\.0 | opensource\.org/licenses/artistic-2\.0
bsl-1.0 | boost software license,? (?:version )?1\.0 | bsl-1\.0 | boost\.org/license_1_0
busl-1.1 | business source license,? (?:version )?1\.1 | busl-1\.1 | mariadb\.com/bsl11
sspl-1.0 | server side public license,? (?:version|v) ?1 | sspl-1\.0 | mongodb\.com/licensing/server-side-public-license
elastic-2.0 | elastic license,? (?:version )?2\.0 ; elastic license 2\.0 | elastic-2\.0 | elastic\.co/licensing/elastic-license
eupl-1.2 | european union public licen[cs]e,? (?:version|v\.?)? ?1\.2 | eupl-1\.2 | joinup\.ec\.europa\.eu/.{0,40}eupl
cecill-2.1 | cecill free software license agreement | cecill-2\.1 | cecill\.info/licences
unlicense | (?:the )?unlicense ; released into the public domain by its author | unlicense | unlicense\.org
cc0-1.0 | cc0 1\.0 universal ; creative commons zero ; cc0 public domain dedication | cc0-1\.0 | creativecommons\.org/publicdomain/zero
cc-by-4.0 | creative commons attribution 4\.0 ; cc[ -]by[ -]4\.0 | cc-by-4\.0 | creativecommons\.org/licenses/by/4\.0
cc-by-3.0 | creative commons attribution 3\.0 ; cc[ -]by[ -]3\.0 | cc-by-3\.0 | creativecommons\.org/licenses/by/3\.0
cc-by-2.0 | creative commons attribution 2\.[05] ; cc[ -]by[ -]2\.[05] | cc-by-2\.[05] | creativecommons\.org/licenses/by/2\.[05]
cc-by-sa | creative commons attribution[- ]share ?alike ; cc[ -]by-sa(?:[ -]\d\.\d)? | cc-by-sa-\d\.\d | creativecommons\.org/licenses/by-sa
cc-by-nc | creative commons attribution[- ]non-?commercial(?! [- ]?(?:share|no)) ; cc[ -]by-nc(?!-)(?:[ -]\d\.\d)? | cc-by-nc-\d\.\d | creativecommons\.org/licenses/by-nc/
cc-by-nd | creative commons attribution[- ]no ?deriv(?:ative)?s ; cc[ -]by-nd(?:[ -]\d\.\d)? | cc-by-nd-\d\.\d | creativecommons\.org/licenses/by-nd
cc-by-nc-sa | creative commons attribution[- ]non-?commercial[- ]share ?alike ; cc[ -]by-nc-sa(?:[ -]\d\.\d)? | cc-by-nc-sa-\d\.\d | creativecommons\.org/licenses/by-nc-sa
cc-by-nc-nd | creative commons attribution[- ]non-?commercial[- ]no ?deriv(?:ative)?s ; cc[ -]by-nc-nd(?:[ -]\d\.\d)? | cc-by-nc-nd-\d\.\d | creativecommons\.org/licenses/by-nc-nd
odbl-1.0 | open (?:data commons open )?database license | odbl-1\.0 | opendatacommons\.org/licenses/odbl
odc-by-1.0 | open data commons attribution license | odc-by-1\.0 | opendatacommons\.org/licenses/by
pddl-1.0 | (?:open data commons )?public domain dedication (?:and|&) license | pddl-1\.0 | opendatacommons\.org/licenses/pddl
ofl-1.1 | sil open font license ; open font license,? version 1\.1 | ofl-1\.1 | scripts\.sil\.org/ofl
zlib | zlib(?:/libpng)? license | zlib | opensource\.org/licenses/zlib
libpng | libpng license | libpng(?:-2\.0)? | libpng\.org/pub/png/src/libpng-license
openssl | openssl license ; dual openssl and ssleay license | openssl | openssl\.org/source/license
python-2.0 | python software foundation license ; psf license agreement | (?:python|psf)-2\.0 | docs\.python\.org/(?:\d/)?license
php-3.01 | php license,? version 3\.01 | php-3\.01 | php\.net/license/3_01
ruby | ruby license | ruby | ruby-lang\.org/en/about/license
postgresql | postgresql licen[cs]e | postgresql | postgresql\.org/about/licence
wtfpl | do what the fuck you want to public license | wtfpl | wtfpl\.net
beerware | beer-?ware license | beerware | people\.freebsd\.org/~phk
ncsa | university of illinois/ncsa open source license | ncsa | opensource\.org/licenses/ncsa
upl-1.0 | universal permissive license,? (?:version|v\.?)? ?1\.0 | upl-1\.0 | opensource\.org/licenses/upl
ms-pl | microsoft public license | ms-pl | opensource\.org/licenses/ms-pl
ms-rl | microsoft reciprocal license | ms-rl | opensource\.org/licenses/ms-rl
osl-3.0 | open software license,? (?:version|v\.?)? ?3\.0 | osl-3\.0 | opensource\.org/licenses/osl-3\.0
afl-3.0 | academic free license,? (?:version|v\.?)? ?3\.0 | afl-3\.0 | opensource\.org/licenses/afl-3\.0
w3c | w3c software (?:notice and )?license | w3c | w3\.org/consortium/legal/(?:2015/)?copyright-software
x11 | x11 license ; x consortium license | x11 | xfree86\.org/.{0,20}license
vim | vim license | vim | vimdoc\.sourceforge\.net/htmldoc/uganda
openrail | (?:creativeml|bigscience) open ?rail(?:-m|\+\+-m)?(?: license)? ; responsible ai license | openrail(?:\+\+)? | huggingface\.co/spaces/[^ ]{0,120}license
llama | llama \d(?:\.\d)? community license | llama\d | (?:ai|llama)\.meta\.com/.{0,20}license
"""

#: Templates around a name, an SPDX identifier or a URL, which @@ stands for: kind, regex, priority, confidence.
FORMS = (
    ("name", r"(?:(?:re)?licensed|released|distributed|published|made available|available|covered|provided)(?: \w{1,20}){0,3}? (?:under|by)(?: the)?(?: terms of)?(?: the)? (?:gnu )?@@(?: license)?", 40, 0.95),
    ("name", r"(?<![\w-])@@(?![\w-])", 20, 0.7),
    ("name", r"dual[- ]licensed under [^\n]{0,80}?@@", 38, 0.9),
    ("spdx", r"spdx-license-identifier: *\(?(?:[\w.+-]+ (?:or|and|with) )*@@(?![\w.+-])", 50, 1.0),
    ("spdx", r"\"?license\"? *[:=] *[\"']@@[\"']", 45, 0.9),
    ("spdx", r"licensed under(?: the)? @@(?![\w-]|\.\d)", 42, 0.95),
    ("url", r"https?://(?:www\.)?@@[\w./-]*", 44, 0.95),
)

#: label | regex | priority | confidence: what no family has.
NOTICES = (
    ("reserved", r"all rights reserved(?! except)", 30, 0.8),
    ("copyright-notice", r"copyright (?:\(c\)|©)? ?(?:19|20)\d\d(?:[-, ]{1,3}(?:19|20)?\d\d){0,20}(?: by)? [^\n.]{2,60}", 25, 0.6),
    ("copyright-notice", r"(?:\(c\)|©) ?(?:19|20)\d\d(?:[-, ]{1,3}(?:19|20)?\d\d){0,20} [^\n.]{2,60}", 24, 0.6),
    ("public-domain", r"(?:released|dedicated|placed)(?: \w{1,20})? (?:in|in ?to|to) the public domain", 35, 0.9),
    ("public-domain", r"this (?:work|file|text|code) is (?:in the )?public domain", 35, 0.9),
    ("proprietary", r"proprietary and confidential", 35, 0.9),
    ("proprietary", r"unauthorized (?:copying|reproduction|distribution) [^\n]{0,60}?prohibited", 35, 0.9),
    ("proprietary", r"no part of this (?:work|publication|book) may be (?:reproduced|copied)", 35, 0.9),
    ("proprietary", r"for internal use only", 15, 0.5),
    ("non-commercial", r"(?:for )?non-?commercial (?:use|purposes) only", 30, 0.8),
    ("mit", r"permission is hereby granted, free of charge, to any person obtaining a copy", 48, 1.0),
    ("bsd-3-clause", r"neither the name of [^\n]{1,80}? nor the names of its contributors", 47, 1.0),
    ("bsd-2-clause", r"redistribution and use in source and binary forms, with or without modification", 43, 0.9),
    ("isc", r"permission to use, copy, modify, and/or distribute this software for any purpose", 47, 1.0),
    ("apache-2.0", r"you may not use this file except in compliance with the license", 46, 0.9),
    ("gpl", r"you can redistribute it and/or modify it under the terms of the gnu general public license", 48, 1.0),
    ("lgpl", r"under the terms of the gnu lesser general public license", 48, 1.0),
    ("gpl", r"gnu general public license", 22, 0.8),
    ("lgpl", r"gnu lesser general public license", 23, 0.8),
    ("cc", r"(?:licensed under |under )(?:a |the )?creative commons", 18, 0.7),
    ("editorial", r"reprinted (?:with|by) permission", 20, 0.6),
    ("terms", r"subject to (?:the|our) (?:license|terms of (?:use|service))", 15, 0.5),
)

#: Every detection holds one of these; a rule is gated by the longest of them in its literal text.
KEYWORDS = ("licen", "license", "licens", "copyright", "reserved", "public domain", "proprietary", "prohibited", "commercial", "permission", "redistribut", "creative commons", "internal use", "no part of", "terms of", "contributors", "(c)", "©", "spdx", "spdx-license-identifier:", "no attribution", "://", "cc by", "cc-by", "cc0", "gpl", "bsd", "openrail", "open rail")


#: Matches are no longer than this on either side of a keyword that they hold, but for the run that ends a URL, which is found by
#: itself, and for wide rules (any number of spaces or of terms), whose matches stay within a line.
REACH = 240
#: What a URL's match runs on with.
RUN = r"[\w./-]*"
#: Stands among the keywords for what the wide rules of assignments begin with.
ASSIGNED = "license="
_ASSIGNED = re.compile(r"license\"? *[:=] *[\"']")
_RUN = re.compile(RUN)


@cache
def rules() -> list[tuple[str, re.Pattern, int, float, tuple[str, ...], bool, re.Pattern | None]]:
    """label, compiled regex, priority, confidence, keywords that must all occur, wide, what stands before a run that ends the match (or None); by falling priority."""
    out = []
    for line in FAMILIES.strip().splitlines():
        label, names, spdx, urls = (x.strip() for x in line.split(" | "))
        terms = {"name": names, "spdx": spdx, "url": urls}
        for kind, form, priority, confidence in FORMS:
            for term in terms[kind].split(" ; "):
                gates = _gates(form.replace("@@", "()")) + _gates(term) + (ASSIGNED,) * ("[:=]" in form)
                whole = form.replace("@@", f"(?:{term})")
                out.append((label, re.compile(whole), priority, confidence, gates, " *" in form, re.compile(whole.removesuffix(RUN)) if form.endswith(RUN) else None))
    out += [(label, re.compile(rule), priority, confidence, _gates(rule), False, None) for label, rule, priority, confidence in NOTICES]
    return sorted(out, key=lambda r: -r[2])


def _gates(rule: str) -> tuple[str, ...]:
    """The longest keyword in what is literal in every match of the rule: outside groups, classes, escapes and optional characters."""
    bare, last = re.sub(r"\\.|\[[^]]*\]", "|", rule.replace(r"\.", ".")), ""
    while bare != last:
        bare, last = re.sub(r"\([^()]*\)[?*]?", "|", bare), bare
    bare = re.sub(r".[?*]|.\{0", "|", bare)
    whole = [k for k in KEYWORDS if k in bare]
    return (max(whole, key=len),) if whole else ()


_WORD = np.zeros(256, bool)
_WORD[48:58] = _WORD[97:123] = _WORD[128:] = True
_EDGE = rb"[^0-9a-z\x80-\xff]"
_PHRASES = {p: re.compile(rb"(?<![0-9a-z\x80-\xff])" + (_EDGE + b"+").join(p.encode().split()) + rb"(?![0-9a-z\x80-\xff])") for p in BASE}


def _spots(text: str) -> list[tuple[int, str]]:
    """Where keywords stand, rising."""
    spots = []
    for k in KEYWORDS:
        at = text.find(k)
        while at >= 0:
            spots.append((at, k))
            at = text.find(k, at + 1)
    if spots:
        spots += [(m.start(), ASSIGNED) for m in _ASSIGNED.finditer(text)]
    return sorted(spots)


def _merged(stretches: Iterator[tuple[int, int, str]]) -> list[tuple[int, int, set[str]]]:
    """Stretches whose starts rise, joined where they touch, with their keywords."""
    out: list[tuple[int, int, set[str]]] = []
    for low, high, k in stretches:
        if out and low <= out[-1][1]:
            out[-1] = (out[-1][0], max(high, out[-1][1]), out[-1][2] | {k})
        else:
            out.append((low, high, {k}))
    return out


def passages(text: str) -> list[tuple[int, int, set[str]]]:
    """Disjoint stretches of REACH characters around keywords, and what a rule looks ahead at, with their keywords."""
    return _merged((max(0, at - REACH), min(len(text), at + REACH + 8), k) for at, k in _spots(text))


def _run_on(text: str, head: re.Pattern, low: int, high: int) -> Iterator[tuple[int, int]]:
    """Matches of head that begin from low on, each with the run after it, as far as that goes; none begins within another."""
    while m := head.search(text, low, high):
        low = _RUN.match(text, m.end()).end()
        yield m.start(), low


def lines(text: str) -> list[tuple[int, int, set[str]]]:
    """The whole lines that hold what wide rules begin with, with all their keywords."""
    begun = [(at, k) for at, k in _spots(text) if k in (ASSIGNED, "spdx-license-identifier:")]
    out, done = [], -1
    for at, _ in begun:
        if at >= done:
            low, done = text.rfind("\n", 0, at) + 1, text.find("\n", at) % (len(text) + 1)
            out.append((low, done, {k for k in (*KEYWORDS, ASSIGNED) if k == ASSIGNED and _ASSIGNED.search(text, low, done) or text.find(k, low, done) >= 0}))
    return out


def detections(text: str) -> list[tuple[int, int, str, int, float]]:
    """Surviving detections in lower-cased text: start, stop, label, priority, confidence."""
    found = []
    near = passages(text)
    done: dict[int, int] = {}  # where a rule's last run ended
    for wide, stretches in ((False, near), (True, lines(text) if near else [])):
        for low, high, seen in stretches:
            for i, (label, rule, priority, confidence, gates, whole_line, head) in enumerate(rules()):
                if whole_line != wide or not all(k in seen for k in gates):
                    continue
                if head is None:
                    found += [(m.start(), m.end(), label, priority, confidence) for m in rule.finditer(text, low, high)]
                else:
                    for start, stop in _run_on(text, head, max(low, done.get(i, 0)), high):
                        found.append((start, stop, label, priority, confidence))
                        done[i] = stop
    found.sort(key=lambda d: (-d[3], d[0], -d[1], d[2]))
    kept: list[tuple[int, int, str, int, float]] = []
    for _, group in groupby(found, key=lambda d: d[3]):
        kept.sort()
        starts, tops = [d[0] for d in kept], list(accumulate((d[1] for d in kept), max))
        reach = -1
        for d in group:  # contained in a kept span that starts no later: of a higher priority, or of its own
            i = bisect_right(starts, d[0])
            if not (i and tops[i - 1] >= d[1]) and reach < d[1]:
                kept.append(d)
                reach = d[1]
    return sorted(kept)


def scan(text: str | None) -> tuple[int, int, int | None, int | None, str, str, float, list]:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, detections of one whole text."""
    low = (text or "").encode("utf-8", "surrogatepass").lower()
    word = _WORD[np.frombuffer(low, np.uint8)]
    starts = word.copy()
    starts[1:] &= ~word[:-1]
    places, labels = [], set()
    for phrase, pattern in _PHRASES.items():
        if phrase.split()[-1].encode() in low:
            at = 0
            while m := pattern.search(low, at):  # all places, so the search goes on after the first byte
                places.append(m.start())
                labels.add(BASE[phrase])
                at = m.start() + 1
    order = [int(starts[:p].sum()) for p in (min(places), max(places))] if places else [None, None]
    found = detections(low.decode("utf-8", "surrogatepass"))
    score = max([d[4] for d in found] + [0.8] * bool(places), default=0.0)
    return int(starts.sum()), len(places), *order, ",".join(sorted(labels)), ",".join(sorted(labels | {d[2] for d in found})), score, found


def scan_licenses(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document with the digest columns and an array of detections (start, stop, label, priority, confidence)."""
    ship(docs.sparkSession)
    schema = f"{id_col} long, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, detections array<struct<start:long,stop:long,label:string,priority:long,confidence:double>>"
    kinds = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64()), ("label", pa.string()), ("priority", pa.int64()), ("confidence", pa.float64())]))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            rows = list(zip(*map(scan, batch.column(1).to_pylist()), strict=True)) or [[]] * 8
            rows[7] = [[dict(zip(("start", "stop", "label", "priority", "confidence"), d, strict=True)) for d in x] for x in rows[7]]
            yield pa.RecordBatch.from_arrays([batch.column(0).cast(pa.int64()), *(pa.array(c, k) for c, k in zip(rows, kinds, strict=True))], names=[x.split()[0] for x in schema.split(", ")])

    return docs.select(id_col, text_col).mapInArrow(run, schema)


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents")).drop("detections")
