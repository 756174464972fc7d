"""License scans (operator 4).

Rules are signatures written by hand, in order: a label, a priority, the strings that a text must hold (also within words, as
in "gplv3") before the pattern is tried, and the pattern, which begins no match within a word.  Comment signs around line breaks
(as in a header of source code) count as white space.  Detections that overlap are resolved: the higher priority wins, then the
longer, then the earlier rule; one that lies inside a kept interval goes, and so does one that overlaps it.  Labels of the base
phrases stay whatever the rules say.

Defined cases: null text is empty; null and repeated keys are kept, a row each; other columns are not read; an empty table
gives no rows.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from typing import NamedTuple

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches, map_arrow, read_table

#: Phrases that count whatever the rules say, and their labels.
BASE_PHRASES = ((("under", "the", "mit", "license"), "mit"), (("apache", "license", "version", "2"), "apache-2"), (("cc", "by", "nc"), "cc-by-nc"))

# label | strings that must occur, all of them, also within words | patterns, one a line, tried on lower-case text whose gaps are one space each.
# A pattern behind "+" is a strong signature (title and version, identifier or address), one behind "-" a weak mention.
_RULES = r"""
mit | mit
+ (?:the )?mit licen[cs]e
+ licen[cs]ed? under (?:the )?(?:terms of )?(?:the )?mit\b
+ spdx-license-identifier: ?mit(?![-\w])
+ opensource\.org/licenses?/mit(?![-\w])
- mit/x11
- \(mit\)
mit | deal, restriction
+ to deal in the software without restriction
mit-0 | mit
+ mit no attribution
+ spdx-license-identifier: ?mit-0
+ opensource\.org/licenses?/mit-0
x11 | x11
+ x11 licen[cs]e
+ spdx-license-identifier: ?x11(?![-\w])
x11 | x, consortium
- x consortium
apache-2 | apache
+ apache licen[cs]e,? ?\(?(?:version|ver\.?|v\.?)? ?2(?:\.0)?\b
+ licen[cs]ed? under (?:the )?apache[- ]?v?2(?:\.0)?\b
+ apache[- ]?v?2(?:\.0)? licen[cs]e
+ spdx-license-identifier: ?apache-2\.0
+ apache\.org/licenses/license-2\.0
+ apache software licen[cs]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
- apache[- ]?v?2\.0
apache-1.1 | apache
+ apache (?:software )?licen[cs]e,? ?(?:version|v\.?)? ?1\.1
+ spdx-license-identifier: ?apache-1\.1
apache-1 | apache
+ apache (?:software )?licen[cs]e,? ?(?:version|v\.?)? ?1\.0
+ spdx-license-identifier: ?apache-1\.0
apache | apache
- apache(?: software)? licen[cs]e
gpl-3 | general, public
+ gnu general public licen[cs]e,? ?\(?(?:version|ver\.?|v\.?) ?3(?:\.0)?\b
+ gnu general public licen[cs]e .{0,80}?version 3 of the licen[cs]e
+ general public licen[cs]e,? version 3
gpl-3 | gpl
+ \bgplv?-?3(?:\.0)?\b
+ gnu gpl,? ?(?:version|v\.?)? ?3(?:\.0)?\b
+ spdx-license-identifier: ?gpl-3\.0
gpl-3 | gnu, org
+ gnu\.org/licenses/gpl-3\.0
gpl-2 | general, public
+ gnu general public licen[cs]e,? ?\(?(?:version|ver\.?|v\.?) ?2(?:\.0)?\b
+ gnu general public licen[cs]e .{0,80}?version 2 of the licen[cs]e
+ general public licen[cs]e,? version 2
gpl-2 | gpl
+ \bgplv?-?2(?:\.0)?\b
+ gnu gpl,? ?(?:version|v\.?)? ?2(?:\.0)?\b
+ spdx-license-identifier: ?gpl-2\.0
gpl-2 | gnu, org
+ gnu\.org/licenses/(?:old-licenses/)?gpl-2\.0
gpl-1 | general, public
+ gnu general public licen[cs]e,? ?(?:version|ver\.?|v\.?) ?1(?:\.0)?\b
gpl-1 | gpl
+ spdx-license-identifier: ?gpl-1\.0
gpl | general, public
- gnu general public licen[cs]e
gpl | gpl
- \bgnu gpl\b
- licen[cs]ed? under (?:the )?gpl\b
lgpl-3 | lesser, general, public
+ gnu lesser general public licen[cs]e,? ?\(?(?:version|ver\.?|v\.?) ?3(?:\.0)?\b
lgpl-3 | lgpl
+ \blgplv?-?3(?:\.0)?\b
+ spdx-license-identifier: ?lgpl-3\.0
lgpl-2.1 | lesser, general, public
+ gnu lesser general public licen[cs]e,? ?\(?(?:version|ver\.?|v\.?) ?2\.1\b
lgpl-2.1 | lgpl
+ \blgplv?-?2\.1\b
+ spdx-license-identifier: ?lgpl-2\.1
lgpl-2 | library, general, public
+ gnu library general public licen[cs]e
lgpl-2 | lgpl
+ \blgplv?-?2(?:\.0)?(?![.\d])
+ spdx-license-identifier: ?lgpl-2\.0
lgpl | lesser, general, public
- gnu lesser general public licen[cs]e
lgpl | lgpl
- \bgnu lgpl\b
- licen[cs]ed? under (?:the )?lgpl\b
agpl-3 | affero
+ gnu affero general public licen[cs]e,? ?\(?(?:version|ver\.?|v\.?) ?3(?:\.0)?\b
+ affero general public licen[cs]e
agpl-3 | agpl
+ \bagplv?-?3(?:\.0)?\b
+ spdx-license-identifier: ?agpl-3\.0
agpl-1 | affero
+ affero general public licen[cs]e,? ?(?:version|v\.?) ?1(?:\.0)?\b
gfdl | documentation, free
+ gnu free documentation licen[cs]e
gfdl | gfdl
+ spdx-license-identifier: ?gfdl-1\.[123]
- \bgfdl\b
bsd-2 | bsd
+ (?:simplified|2-clause|two[- ]clause|freebsd) (?:\w+ )?bsd licen[cs]e
+ bsd[- ]2[- ]clause
+ bsd licen[cs]e \(2[- ]clause\)
+ opensource\.org/licenses?/bsd-2-clause
bsd-3 | bsd
+ (?:new|modified|revised|3-clause|three[- ]clause) bsd licen[cs]e
+ bsd[- ]3[- ]clause
+ bsd licen[cs]e \(3[- ]clause\)
+ opensource\.org/licenses?/bsd-3-clause
bsd-3 | neither, endorse
+ neither the name of .{1,120}? may be used to endorse
bsd-4 | bsd
+ (?:original|old|4-clause|four[- ]clause) bsd licen[cs]e
+ bsd[- ]4[- ]clause
bsd-4 | advertising, materials
+ all advertising materials mentioning features or use of this software
0bsd | 0bsd
+ \b0bsd\b
0bsd | bsd
+ zero[- ]clause bsd
bsd | bsd
- \bbsd(?:[- ]style)? licen[cs]e
- licen[cs]ed? under (?:the )?bsd\b
bsd | redistribution
- redistribution and use in source and binary forms
isc | isc
+ \bisc licen[cs]e
+ spdx-license-identifier: ?isc(?![-\w])
+ opensource\.org/licenses?/isc
mpl-2 | mozilla
+ mozilla public licen[cs]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
+ mozilla\.org/mpl/2\.0
mpl-2 | mpl
+ \bmpl[- ]?v?2(?:\.0)?\b
mpl-1.1 | mozilla
+ mozilla public licen[cs]e,? ?(?:version|v\.?)? ?1\.1\b
+ mozilla\.org/mpl/mpl-1\.1
mpl-1.1 | mpl
+ \bmpl[- ]?v?1\.1\b
mpl | mozilla
- mozilla public licen[cs]e
epl-2 | eclipse
+ eclipse public licen[cs]e,? ?-? ?(?:version|v\.?)? ?2(?:\.0)?\b
+ eclipse\.org/legal/epl-2\.0
epl-2 | epl
+ \bepl[- ]?v?2(?:\.0)?\b
epl-1 | eclipse
+ eclipse public licen[cs]e,? ?-? ?(?:version|v\.?)? ?1(?:\.0)?\b
+ eclipse\.org/legal/epl-v10
epl-1 | epl
+ \bepl[- ]?v?1(?:\.0)?\b
epl | eclipse
- eclipse public licen[cs]e
edl | eclipse
+ eclipse distribution licen[cs]e
cddl-1.1 | cddl
+ \bcddl[- ]?v?1\.1\b
cddl-1 | cddl
+ \bcddl[- ]?v?1\.0\b
- \bcddl\b
cddl-1 | common, development, distribution
+ common development and distribution licen[cs]e
cpl | common, public
+ common public licen[cs]e
ipl | ibm
+ ibm public licen[cs]e
eupl-1.2 | eupl
+ \beupl,? ?(?:version|v\.?)? ?-?1\.2\b
eupl-1.1 | eupl
+ \beupl,? ?(?:version|v\.?)? ?-?1\.1\b
eupl | european, union
+ european union public licen[cs]e
cecill | cecill
+ \bcecill(?:-[abc])?(?:-\d(?:\.\d)?)?\b
artistic-2 | artistic
+ artistic licen[cs]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
+ spdx-license-identifier: ?artistic-2\.0
artistic-1 | artistic
+ artistic licen[cs]e,? ?(?:version|v\.?)? ?1(?:\.0)?\b
artistic | artistic
- artistic licen[cs]e
- perl artistic
perl | perl
- same terms as perl itself
zlib | zlib
+ zlib(?:/libpng)? licen[cs]e
+ spdx-license-identifier: ?zlib(?![-\w])
zlib | misrepresented
+ origin of this software must not be misrepresented
libpng | libpng
+ libpng licen[cs]e
bsl-1 | boost
+ boost software licen[cs]e,? ?-? ?(?:version|v\.?)? ?1(?:\.0)?\b
+ boost\.org/license_1_0
- boost software licen[cs]e
bsl-1 | bsl
+ spdx-license-identifier: ?bsl-1\.0
busl-1.1 | business, source
+ business source licen[cs]e,? ?(?:version|v\.?)? ?1\.1\b
- business source licen[cs]e
busl-1.1 | busl
+ spdx-license-identifier: ?busl-1\.1
sspl-1 | sspl
+ \bsspl(?:[- ]v?1(?:\.0)?)?\b
sspl-1 | server, side
+ server side public licen[cs]e
elastic-2 | elastic
+ elastic licen[cs]e,? ?(?:version|v\.?)? ?2(?:\.0)?\b
- elastic licen[cs]e
commons-clause | commons, clause
+ commons clause licen[cs]e condition
- commons clause
polyform | polyform
+ polyform (?:noncommercial|small business|shield|strict|perimeter)
unlicense | unlicense
+ \bthe unlicense\b
+ unlicense\.org
+ spdx-license-identifier: ?unlicense
unlicense | unencumbered
+ free and unencumbered software released into the public domain
wtfpl | wtfpl
+ \bwtfpl\b
wtfpl | want, public
+ do what the f\S{3} you want to public licen[cs]e
beerware | beer
+ beer-?ware licen[cs]e
+ the beer-ware
python-2 | python
+ python software foundation licen[cs]e
+ spdx-license-identifier: ?python-2\.0
python-2 | psf
+ \bpsf licen[cs]e
ruby | ruby
+ ruby(?:'s)? licen[cs]e
php-3 | php
+ php licen[cs]e,? ?(?:version|v\.?)? ?3(?:\.0)?1?\b
- php licen[cs]e
postgresql | postgresql
+ postgresql licen[cs]e
openssl | openssl
+ openssl licen[cs]e
+ openssl project for use in the openssl toolkit
w3c | w3c
+ w3c(?:®)? software(?: notice)?(?: and)? (?:document )?licen[cs]e
ofl-1.1 | sil
+ sil open font licen[cs]e,? ?(?:version|v\.?)? ?1\.1\b
- sil open font licen[cs]e
ofl-1.1 | ofl
+ spdx-license-identifier: ?ofl-1\.1
+ scripts\.sil\.org/ofl
lppl | latex
+ latex project public licen[cs]e
lppl | lppl
+ \blppl(?:-1\.\d\w?)?\b
afl-3 | academic, free
+ academic free licen[cs]e
osl-3 | open, software
+ open software licen[cs]e,? ?(?:version|v\.?)? ?3(?:\.0)?\b
- open software licen[cs]e
ecl-2 | educational, community
+ educational community licen[cs]e
ncsa | ncsa
+ (?:university of illinois/)?ncsa open source licen[cs]e
upl-1 | universal, permissive
+ universal permissive licen[cs]e
ms-pl | microsoft, public
+ microsoft public licen[cs]e
ms-rl | microsoft, reciprocal
+ microsoft reciprocal licen[cs]e
apsl-2 | apple
+ apple public source licen[cs]e
sunpublic | sun, public
+ sun public licen[cs]e
qpl | q, public
+ \bq public licen[cs]e
intel | intel
+ intel open source licen[cs]e
mulan-2 | mulan
+ mulan (?:permissive software|psl) licen[cs]e,? ?(?:version|v\.?)? ?2?
+ mulan psl v2
blueoak | blue, oak
+ blue oak model licen[cs]e
odbl-1 | odbl
+ \bodbl(?:-1\.0)?\b
odbl-1 | database, open
+ open (?:data commons )?(?:open )?database licen[cs]e
odc-by | commons, attribution
+ open data commons attribution licen[cs]e
pddl | pddl
+ \bpddl\b
pddl | public, domain, dedication
+ open data commons public domain dedication
cdla | community, data
+ community data licen[cs]e agreement
openrail | openrail
+ \b(?:creativeml |bigscience |bigcode )?openrail(?:-?m)?\b
llama | llama
+ llama ?(?:2|3(?:\.\d)?)? community licen[cs]e
ogl-uk | ogl
+ \bogl-uk-\d\.\d
ogl-uk | open, government
+ open government licen[cs]e
cc0 | cc0
+ \bcc0(?:[- ]1\.0)?\b
cc0 | creativecommons
+ creativecommons\.org/publicdomain/zero/1\.0
cc0 | creative, zero
+ creative commons zero
cc-by-nc-nd | cc
+ \bcc[- ]by-?nc-?nd(?:[- ]\d(?:\.\d)?)?
+ \bcc by nc nd\b
cc-by-nc-nd | commercial, deriv
+ creative commons attribution[- ]non-?commercial[- ]no-?deriv(?:ative)?s
cc-by-nc-nd | creativecommons
+ creativecommons\.org/licenses/by-nc-nd/\d
cc-by-nc-sa | cc
+ \bcc[- ]by-?nc-?sa(?:[- ]\d(?:\.\d)?)?
+ \bcc by nc sa\b
cc-by-nc-sa | commercial, share, alike
+ creative commons attribution[- ]non-?commercial[- ]share-?alike
cc-by-nc-sa | creativecommons
+ creativecommons\.org/licenses/by-nc-sa/\d
cc-by-nc | cc
+ \bcc[- ]by-?nc(?:[- ]\d(?:\.\d)?)?(?![- ]?(?:sa|nd)\b)
+ \bcc by nc\b(?! (?:sa|nd)\b)
cc-by-nc | attribution, commercial
+ creative commons attribution[- ]non-?commercial(?![- ](?:share|no))
cc-by-nc | creativecommons
+ creativecommons\.org/licenses/by-nc/\d
cc-by-nd | cc
+ \bcc[- ]by-?nd(?:[- ]\d(?:\.\d)?)?
cc-by-nd | creativecommons
+ creativecommons\.org/licenses/by-nd/\d
cc-by-sa | cc
+ \bcc[- ]by-?sa(?:[- ]\d(?:\.\d)?)?
cc-by-sa | share, alike
+ creative commons attribution[- ]share-?alike
cc-by-sa | creativecommons
+ creativecommons\.org/licenses/by-sa/\d
cc-by | cc
+ \bcc[- ]by(?:[- ]\d(?:\.\d)?)?(?![- ]?(?:nc|sa|nd)\b)(?![-\w])
cc-by | creative, attribution
+ creative commons attribution(?: \d\.\d)?(?: international)? licen[cs]e
cc-by | creativecommons
+ creativecommons\.org/licenses/by/\d
cc | creative, commons
- creative commons licen[cs]e
public-domain | public, domain
- (?:released|placed|dedicated|is) (?:in|into|to) the public domain
- public domain
proprietary | rights, reserved
- all rights reserved
proprietary | proprietary, confidential
- proprietary and confidential
proprietary | confidential
- confidential and proprietary
"""


class Rule(NamedTuple):
    order: int
    label: str
    priority: int
    words: frozenset[str]
    pattern: re.Pattern


def rules(text: str = _RULES) -> list[Rule]:
    """The rules in their order.  A strong signature has priority 2, a weak mention 1."""
    out, label, words = [], "", frozenset()
    for line in text.strip().split("\n"):
        if line[0] in "+-" and line[1] == " ":
            pattern = line[2:] if line[2] == "\\" else f"(?<![a-z0-9])(?:{line[2:]})"
            out.append(Rule(len(out), label, 2 if line[0] == "+" else 1, words, re.compile(pattern)))
        else:
            label, needed = (x.strip() for x in line.split("|", 1))
            words = frozenset(x.strip() for x in needed.split(","))
    return out


_OTHER = bytes(c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in bytes(range(256)).lower())
#: Signs of comments at the starts and ends of lines; with the white space around they are one gap.
_SIGNS = r"(?:/\*+|\*+/?|//+[!/]?|\#+|;+|%+|--+|<!--+|>+|\|+|!+|\"{3}|'{3}|@?rem\b|dnl\b)"
_GAPS = re.compile(rf"(?:\s+{_SIGNS})?[^\S\n\r]*(?:[\n\r]\s*(?:{_SIGNS}\s*)?)+|\s+")
_COMMENTED = re.compile(rf"[\n\r][^\S\n\r]*+{_SIGNS}")
_WHITE = re.compile(r"\s++")


def one_line(text: str) -> str:
    """The text with one space for each gap.  White space is made short first, so that blank lines are read once."""
    if not _COMMENTED.search(text):
        return " ".join(text.split())
    return _GAPS.sub(" ", _WHITE.sub(lambda m: "\n" if "\n" in m[0] or "\r" in m[0] else " ", text))


def resolve(found: list[tuple[int, int, Rule]]) -> list[tuple[int, int, Rule]]:
    """Detections that stand: by priority, length and order of rule; others that lie inside or overlap them go.  Each looks at
    its own interval alone, so the cost is that of sorting and of the lengths together."""
    kept: list[tuple[int, int, Rule]] = []
    taken = bytearray(max((b for _, b, _ in found), default=0))
    for a, b, rule in sorted(found, key=lambda d: (-d[2].priority, d[0] - d[1], d[2].order, d[0])):
        if a < b and taken.find(1, a, b) < 0:
            taken[a:b] = b"\x01" * (b - a)
            kept.append((a, b, rule))
    return kept


class Scanner:
    def __init__(self, table: list[Rule] | None = None):
        self.rules = rules() if table is None else table
        self.gates = frozenset(w for r in self.rules for w in r.words)
        self.phrases = [(tuple(w.encode() for w in phrase), label) for phrase, label in BASE_PHRASES]
        self.rare = frozenset((b"license", b"mit", b"apache", b"cc"))

    def detections(self, text: str) -> list[tuple[int, int, Rule]]:
        lower = text.lower()
        held = {w for w in self.gates if w in lower}
        tried = [r for r in self.rules if r.words <= held]
        if not tried:
            return []
        plain = one_line(lower)
        return resolve([(*m.span(), r) for r in tried for m in r.pattern.finditer(plain)])

    def __call__(self, text: bytes) -> tuple[int, int, int | None, int | None, str, str, float]:
        words = text.translate(_OTHER).split(b" ")
        words = [w for w in words if w] if b"" in words else words
        present = self.rare.intersection(words)
        starts, base = [], set()
        if present:
            for phrase, label in self.phrases:
                if phrase[-2] in present or phrase[0] in present or phrase[-1] in present:
                    i = -1
                    while True:
                        try:
                            i = words.index(phrase[0], i + 1)
                        except ValueError:
                            break
                        if tuple(words[i : i + len(phrase)]) == phrase:
                            starts.append(i)
                            base.add(label)
        kept = self.detections(text.decode())
        labels = base | {r.label for *_, r in kept}
        strong = sum(r.priority == 2 for *_, r in kept) + len(starts)
        score = 1 - 0.5 ** (2 * strong + sum(r.priority == 1 for *_, r in kept)) if labels else 0.0
        return len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(labels)), score


LICENSES = "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", table: list[Rule] | None = None) -> DataFrame:
    """key and LICENSES of each document.  One pass, no shuffle."""

    def look(it: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanner = Scanner(table)
        types = (pa.int64(),) * 4 + (pa.string(), pa.string(), pa.float64())
        for batch, texts in batches(it):
            columns = zip(*map(scanner, texts), strict=True)
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(c, t) for c, t in zip(columns, types, strict=True))], ["doc_id", *(x.split()[0] for x in LICENSES.split(", "))])

    return map_arrow(docs.select(F.col(key).cast("long").alias("doc_id"), F.col(text).alias("text")), look, f"doc_id long, {LICENSES}")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    return scan(read_table(spark, sf_dir, "documents"))
