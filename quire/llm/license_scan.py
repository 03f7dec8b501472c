"""Operator 10: licence scans by sentence rules.

1. A text's words are normalised, with their places kept: lower case, one
   spelling of licence, comment marks and punctuation gone, version numbers
   replaced by a mark and kept.
2. Known sentences have identifiers (table `SENTENCES`).  The text is cut at
   sentence marks; a sentence, or several in a row (a notice cut at ':', ';' or
   'v.'), whose words are a known sentence gets its identifier first, unless
   longer known words begin at the same place.
3. In what is left, known sentences are found as word sequences anywhere, across
   line ends and punctuation, several in a sentence; where two overlap the
   longer one counts.
4. The sequence of identifiers is matched against `RULES` in order: a rule is
   an ordered list of identifiers that name one licence, some of them optional;
   identifiers taken by an earlier (longer) rule are not used again.
   Identifiers no rule takes are reported as `unknown`.  A finding begins with
   the sentence its known words stand in (or behind the finding before it) and
   ends with those words.

The tables are fixed and small; each row is scanned in the task that reads it,
texts without a cue word cost one search.  Rows: null and empty texts give no
findings; repeated rows are kept; an empty table gives no rows; extra columns
are not read.  Licences named in other words than the known ones are not found.  Offsets count code points of the whole text.
"""

from __future__ import annotations

import bisect
import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# fixed values: sentences of public licences, normalised (VER: a version number)
SENTENCES = {
    "licensed under the apache license VER": "apache-notice",
    "licensed under the apache license": "apache-notice",
    "you may not use this file except in compliance with the license": "apache-comply",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
    "without warranties or conditions of any kind either express or implied": "apache-as-is",
    "see the license for the specific language governing permissions and limitations under the license": "apache-see",
    "released under the mit license": "mit-notice",
    "licensed under the mit license": "mit-notice",
    "distributed under the mit license": "mit-notice",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
    "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject "
    "to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-keep",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
    "merchantability fitness for a particular purpose and noninfringement": "mit-as-is",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that "
    "the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "licensed under the gnu general public license VER": "gpl-notice",
    "licensed under the gnu general public license": "gpl-notice",
    "licensed under the gnu lesser general public license VER": "lgpl-notice",
    "licensed under the gnu affero general public license VER": "agpl-notice",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as "
    "published by the free software foundation either VER of the license or at your option any later version": "gpl-grant-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license VER as "
    "published by the free software foundation": "gpl-grant",
    "licensed under the mozilla public license VER": "mpl-notice",
    "this source code form is subject to the terms of the mozilla public license VER": "mpl-notice",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions "
    "are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
    "documentation and or other materials provided with the distribution": "bsd-binary",
    "licensed under the bsd license": "bsd-notice",
    "licensed under cc by VER": "cc-by", "licensed under cc by sa VER": "cc-by-sa", "licensed under cc by nc VER": "cc-by-nc",
    "licensed under cc by nd VER": "cc-by-nd", "licensed under cc by nc sa VER": "cc-by-nc-sa", "licensed under cc by nc nd VER": "cc-by-nc-nd",
    "licensed under a creative commons attribution VER international license": "cc-by",
    "this work is dedicated to the public domain": "public-domain",
    "all rights reserved": "reserved",
}

# the same notices in their usual forms
_UNDER = [f"{verb} under the {terms}" for verb in ("licensed", "released", "distributed", "available") for terms in ("", "terms of the ")]
for _u in _UNDER:
    for _k in ("apache license VER", "apache license", "apache VER license"):
        SENTENCES.setdefault(_u + _k, "apache-notice")
    for _k in ("bsd license", "bsd VER clause license", "new bsd license", "modified bsd license", "simplified bsd license"):
        SENTENCES.setdefault(_u + _k, "bsd-notice")
    SENTENCES.setdefault(_u + "mit license", "mit-notice")
    SENTENCES.setdefault(_u + "isc license", "isc-notice")
    SENTENCES.setdefault(_u + "mozilla public license", "mpl-notice")
    SENTENCES.setdefault(_u + "mozilla public license VER", "mpl-notice")
SENTENCES["the contents of this file are subject to the mozilla public license VER"] = "mpl-notice"
SENTENCES["neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
          "this software without specific prior written permission"] = "bsd-name"
for _name, _id in (("gnu general public license", "gpl"), ("gnu lesser general public license", "lgpl"),
                   ("gnu library general public license", "lgpl"), ("gnu affero general public license", "agpl")):
    for _u in _UNDER:
        SENTENCES.setdefault(_u + _name, f"{_id}-notice")
        SENTENCES.setdefault(f"{_u}{_name} VER", f"{_id}-notice")
        SENTENCES.setdefault(f"{_u}{_name} VER only", f"{_id}-grant")
        for _later in ("or later", "or any later version", "or at your option any later version"):
            SENTENCES.setdefault(f"{_u}{_name} VER {_later}", f"{_id}-grant-later")
    _fsf = "as published by the free software foundation"
    for _who in ("this program is ", "this library is ", "this software is ", "this file is ", ""):
        _g = f"{_who}free software you can redistribute it and or modify it under the terms of the {_name}"
        SENTENCES.setdefault(f"{_g} {_fsf}", f"{_id}-notice")
        for _k in (f"{_g} VER {_fsf}", f"{_g} {_fsf} VER", f"{_g} {_fsf} VER of the license", f"{_g} {_fsf} VER only"):
            SENTENCES.setdefault(_k, f"{_id}-grant")
        for _later in ("or later", "or any later version", "or at your option any later version"):
            for _k in (f"{_g} {_fsf} either VER of the license {_later}", f"{_g} {_fsf} VER of the license {_later}",
                       f"{_g} {_fsf} VER {_later}", f"{_g} VER {_later} {_fsf}", f"{_g} VER {_fsf} {_later}"):
                SENTENCES.setdefault(_k, f"{_id}-grant-later")
for _name, _id in (("", "cc-by"), ("sharealike ", "cc-by-sa"), ("share alike ", "cc-by-sa"), ("noderivatives ", "cc-by-nd"), ("noderivs ", "cc-by-nd"),
                   ("no derivatives ", "cc-by-nd")):
    for _nc in ("", "noncommercial ", "non commercial "):
        _cc = _id.replace("cc-by", "cc-by-nc") if _nc else _id
        for _art in ("a ", "the ", "", "the terms of the "):
            for _end in ("", " international", " international license", " unported", " unported license", " license", " generic license"):
                SENTENCES.setdefault(f"licensed under {_art}creative commons attribution {_nc}{_name}VER{_end}", _cc)

# fixed values: Unlicense, zlib, EPL, CC0 and notices that name two licences
SENTENCES |= {
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
    "for any purpose commercial or non commercial and by any means": "unlicense-use",
    "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages "
    "arising from the use of this software": "zlib-as-is",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and "
    "redistribute it freely subject to the following restrictions": "zlib-grant",
    "the origin of this software must not be misrepresented you must not claim that you wrote the original software": "zlib-origin",
    "altered source versions must be plainly marked as such and must not be misrepresented as being the original software": "zlib-altered",
    "this notice may not be removed or altered from any source distribution": "zlib-keep",
    "this program and the accompanying materials are made available under the terms of the eclipse public license VER": "epl-notice",
    "cc VER universal": "cc-zero", "creative commons zero VER universal": "cc-zero", "creative commons zero": "cc-zero",
    "governed by a bsd style license": "bsd-notice",
}
for _u in _UNDER:
    SENTENCES.setdefault(_u + "eclipse public license VER", "epl-notice")
    SENTENCES.setdefault(_u + "zlib license", "zlib-notice")
    SENTENCES.setdefault(_u + "unlicense", "unlicense-grant")
    SENTENCES.setdefault(_u + "unlicense license", "unlicense-grant")
_PAIR = {"apache": "apache license VER", "mit": "mit license"}
for _pre in ("licensed under either of ", "licensed under either ", "licensed under ", "dual licensed under ", "available under either "):
    for _a, _b in (("apache", "mit"), ("mit", "apache")):
        for _art in ("", "the ", "the terms of the "):
            for _and in ("or", "and"):
                for _art2 in ("", "the "):
                    SENTENCES.setdefault(f"{_pre}{_art}{_PAIR[_a]} {_and} {_art2}{_PAIR[_b]}", f"{_a}-or-{_b}")

# fixed values: further sentences of full licence texts
SENTENCES |= {
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
    "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
    "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
    "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so": "mit0-grant",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties "
    "of merchantability and fitness": "isc-as-is",
    "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting "
    "from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection "
    "with the use or performance of this software": "isc-liability",
    "all advertising materials mentioning features or use of this software must display the following acknowledgement": "bsd-advert",
    "nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written "
    "permission": "bsd-name",
    "in jurisdictions that recognize copyright laws the author or authors of this software dedicate any and all copyright interest in the "
    "software to the public domain": "unlicense-dedicate",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying "
    "documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to "
    "prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the "
    "following": "bsl-grant",
    "everyone is permitted to copy and distribute verbatim or modified copies of this license document and changing it is allowed as long "
    "as the name is changed": "wtfpl-copy",
    "this font software is licensed under the sil open font license VER": "ofl-notice",
    "apache license VER january VER": "apache-title",
    "terms and conditions for use reproduction and distribution": "apache-terms",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge "
    "royalty free irrevocable copyright license to reproduce prepare derivative works of publicly display publicly perform sublicense and "
    "distribute the work and such derivative works in source or object form": "apache-copyright",
    "subject to the terms and conditions of this license each contributor hereby grants to you a perpetual worldwide non exclusive no charge "
    "royalty free irrevocable except as stated in this section patent license to make have made use offer to sell sell import and otherwise "
    "transfer the work": "apache-patent",
    "you may reproduce and distribute copies of the work or derivative works thereof in any medium with or without modifications and in "
    "source or object form provided that you meet the following conditions": "apache-redistribute",
    "this license does not grant permission to use the trade names trademarks service marks or product names of the licensor": "apache-marks",
    "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gnu-verbatim",
    "gnu general public license VER june VER": "gpl-title", "gnu general public license VER VER june VER": "gpl-title",
    "gnu lesser general public license VER february VER": "lgpl-title", "gnu lesser general public license VER VER june VER": "lgpl-title",
    "gnu library general public license VER june VER": "lgpl-title", "gnu affero general public license VER VER november VER": "agpl-title",
}
for _who in ("the copyright holders and contributors", "the regents and contributors", "the author", "the author and contributors", "the authors"):
    SENTENCES.setdefault(f"this software is provided by {_who} as is and any express or implied warranties including but not limited to the "
                         "implied warranties of merchantability and fitness for a particular purpose are disclaimed", "bsd-as-is")
for _who in ("the copyright holder or contributors", "the copyright owner or contributors", "the copyright holders or contributors",
             "the regents or contributors", "the author", "the author or contributors", "the authors"):
    SENTENCES.setdefault(f"in no event shall {_who} be liable for any direct indirect incidental special exemplary or consequential damages "
                         "including but not limited to procurement of substitute goods or services loss of use data or profits or business "
                         "interruption however caused and on any theory of liability whether in contract strict liability or tort including "
                         "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such "
                         "damage", "bsd-liability")
for _u in _UNDER:
    for _name, _id in (("boost software license", "bsl"), ("artistic license", "artistic"), ("sil open font license", "ofl"),
                       ("european union public license", "eupl"), ("eupl", "eupl"), ("python software foundation license", "psf")):
        for _art in ("", "the "):
            SENTENCES.setdefault(f"{_u}{_art}{_name}", f"{_id}-notice")
            SENTENCES.setdefault(f"{_u}{_art}{_name} VER", f"{_id}-notice")

# fixed values: ordered rules, longer evidence first; "?" marks an identifier that may be missing; {} takes the version of the
# sequence's first sentence that has one
_BSD_END = ("bsd-as-is?", "bsd-liability?")
RULES = [
    ("Apache-{}", ("apache-title", "apache-terms?", "apache-copyright?", "apache-patent?", "apache-redistribute?", "apache-marks?")),
    ("Apache-{}", ("apache-notice", "apache-comply", "apache-copy", "apache-as-is?", "apache-see?")),
    ("GPL-{}", ("gpl-title", "gnu-verbatim?")), ("LGPL-{}", ("lgpl-title", "gnu-verbatim?")), ("AGPL-{}", ("agpl-title", "gnu-verbatim?")),
    ("MIT", ("mit-grant", "mit-keep?", "mit-as-is?", "mit-liability?")),
    ("MIT-0", ("mit0-grant", "mit-as-is?", "mit-liability?")),
    ("BSD-4-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-advert", "bsd-name?", *_BSD_END)),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-name", *_BSD_END)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary", *_BSD_END)),
    ("BSD", ("bsd-grant", "bsd-source?", *_BSD_END)), ("BSD", ("bsd-notice",)),
    ("Zlib", ("zlib-as-is?", "zlib-grant", "zlib-origin?", "zlib-altered?", "zlib-keep?")), ("Zlib", ("zlib-notice",)),
    ("Unlicense", ("unlicense-grant", "unlicense-use?", "unlicense-dedicate?")),
    ("Apache-{} OR MIT", ("apache-or-mit",)), ("MIT OR Apache-{}", ("mit-or-apache",)),
    ("EPL-{}", ("epl-notice",)), ("CC0-{}", ("cc-zero",)),
    ("ISC", ("isc-grant", "isc-as-is?", "isc-liability?")), ("ISC", ("isc-notice",)),
    ("0BSD", ("0bsd-grant", "isc-as-is?", "isc-liability?")),
    ("BSL-1.0", ("bsl-grant",)), ("BSL-{}", ("bsl-notice",)), ("WTFPL", ("wtfpl-copy",)), ("OFL-{}", ("ofl-notice",)),
    ("Artistic-{}", ("artistic-notice",)), ("EUPL-{}", ("eupl-notice",)), ("PSF-{}", ("psf-notice",)),
    ("GPL-{}-or-later", ("gpl-grant-later",)),
    ("LGPL-{}-or-later", ("lgpl-grant-later",)),
    ("AGPL-{}-or-later", ("agpl-grant-later",)),
    ("GPL-{}-only", ("gpl-grant",)),
    ("LGPL-{}-only", ("lgpl-grant",)),
    ("AGPL-{}-only", ("agpl-grant",)),
    ("GPL-{}", ("gpl-notice",)), ("LGPL-{}", ("lgpl-notice",)), ("AGPL-{}", ("agpl-notice",)), ("MPL-{}", ("mpl-notice",)),
    ("Apache-{}", ("apache-notice",)), ("MIT", ("mit-notice",)),
    ("CC-BY-{}", ("cc-by",)), ("CC-BY-SA-{}", ("cc-by-sa",)), ("CC-BY-NC-{}", ("cc-by-nc",)), ("CC-BY-ND-{}", ("cc-by-nd",)),
    ("CC-BY-NC-SA-{}", ("cc-by-nc-sa",)), ("CC-BY-NC-ND-{}", ("cc-by-nc-nd",)),
    ("Public-Domain", ("public-domain",)), ("All-Rights-Reserved", ("reserved",)),
]

#: Rules with the identifiers that may begin them.
_ORDERED = [(licence, ids, [x.rstrip("?") for i, x in enumerate(ids) if all(y.endswith("?") for y in ids[:i])]) for licence, ids in RULES]
#: Licences that findings name by their family (`license`); `spdx` names them in full.
FAMILY = {"BSD-2-Clause": "BSD", "BSD-3-Clause": "BSD", "BSD-4-Clause": "BSD"}

_CUE = re.compile(r"licen[cs]e|permission is|permission to use|redistribut|copyright notice|public domain|rights reserved"
                  r"|creative commons|\bcc0\b|may not be removed or altered", re.I)
_END = re.compile(r"[.!?:;](?=\s|$)|\n(?=\s*\n)|$")
#: What `normalise` reads: a definition in brackets (left out), a version, a word.
_TOKEN = re.compile(r"""(\((?:the|this)\s+["'\u201c]{0,2}licen[cs]e["'\u201d]{0,2}\))"""
                    r"|\b(?:(?:version|ver|v)\b[.:]?[\s#*/;]*|v)?(\d+(?:\.\d+)*)\b|([a-z]+)", re.I | re.A)
_CLOSING = re.compile(r"""["')\]]*[.!?:;](?=\s|$)""")
_SPDX = re.compile(r"SPDX-License-Identifier:[ \t]*([A-Za-z0-9.+-]+)")
_TREE: dict = {}  # the known sentences word by word, "" where one ends
for _k, _id in SENTENCES.items():
    _node = _TREE
    for _word in _k.split():
        _node = _node.setdefault(_word, {})
    _node[""] = _id


def normalise(text: str) -> tuple[list[str], list[re.Match]]:
    """Words of a text with versions as VER, and the matches they come from."""
    words, found = [], []
    for m in _TOKEN.finditer(text):
        if m.lastindex == 2:
            words.append("VER")
        elif m.lastindex == 3:
            words.append(m.group().lower().replace("licence", "license"))
        else:
            continue
        found.append(m)
    return words, found


def _known_from(words: list[str], i: int) -> list[tuple[int, str]]:
    """(word behind the last, identifier) of the known sentences that begin at word i, shortest first."""
    node, j, out = _TREE.get(words[i]), i + 1, []
    while node is not None:
        if "" in node:
            out.append((j, node[""]))
        node, j = node.get(words[j]) if j < len(words) else None, j + 1
    return out


def identify(words: list[str], marks: list[int] | None = None) -> list[tuple[int, int, str]]:
    """(first word, word behind the last, identifier) of the known sentences in
    text order.  `marks`: the words that begin a sentence; sentences between
    marks come first, then word sequences anywhere in the rest (of overlapping
    ones the longest, then the first)."""
    used, out, edges = bytearray(len(words)), [], {*(marks or ()), len(words)}
    for i in sorted(marks or ()):
        if i < len(words) and not used[i] and (known := _known_from(words, i)) and known[-1][0] in edges:
            j, name = known[-1]
            used[i:j] = b"\1" * (j - i)
            out.append((i, j, name))
    hits = [(i, j, name) for i in range(len(words)) if not used[i] for j, name in _known_from(words, i)]
    for i, j, name in sorted(hits, key=lambda h: (h[0] - h[1], h[0])):
        if not any(used[i:j]):
            used[i:j] = b"\1" * (j - i)
            out.append((i, j, name))
    return sorted(out)


def match_rule(names: list[str], ids: tuple[str, ...], i: int) -> int:
    """How many identifiers from place i on follow the rule `ids` (0: they do not)."""
    j = i
    for want in ids:
        if j < len(names) and names[j] == want.rstrip("?"):
            j += 1
        elif not want.endswith("?"):
            return 0
    return j - i


def scan(text: str | None) -> list[tuple[str, int, int]]:
    """(licence, start, end) in text order; licences by their family."""
    return [(FAMILY.get(name, name), start, end) for name, start, end in scan_full(text)]


def scan_full(text: str | None) -> list[tuple[str, int, int]]:
    """(licence, start, end) in text order; licences with their clauses."""
    if not text or not (_CUE.search(text) or "SPDX-" in text):
        return []
    seen: list[list] = []  # identifier, version, start, end
    words, places = normalise(text)
    ends = [m.end() for m in _END.finditer(text)]
    begins = [m.start() for m in places]
    marks = sorted({0, *(bisect.bisect_left(begins, e) for e in ends)})
    for i, j, name in identify(words, marks):
        first, end = places[i].start(), places[j - 1].end()
        k = bisect.bisect_right(ends, first)
        start = max(ends[k - 1] if k else 0, seen[-1][3] if seen else 0)
        start += len(text[start:first]) - len(text[start:first].lstrip())
        if (closing := _CLOSING.match(text, end)) is not None:
            end = closing.end()
        seen.append([name, next((m.group(2) for m in places[i:j] if m.lastindex == 2), None), start, end])
    found = [(m.group(1), m.start(), m.end()) for m in _SPDX.finditer(text)]
    names = [p[0] for p in seen]  # "" once a rule has taken it
    at: dict[str, list[int]] = {}
    for i, name in enumerate(names):
        at.setdefault(name, []).append(i)
    for licence, ids, heads in _ORDERED:
        for i in sorted(i for head in heads for i in at.get(head, ())):
            if n := match_rule(names, ids, i):
                names[i:i + n] = [""] * n
                version = next((p[1] for p in seen[i:i + n] if p[1]), None)
                found.append((licence.format(version) if version else licence.replace("-{}", ""), seen[i][2], seen[i + n - 1][3]))
    found += [("unknown:" + s[0], s[2], s[3]) for s, left in zip(seen, names) if left]
    return sorted(found, key=lambda x: (x[1], x[2], x[0]))


_DDL = "doc_id long, findings array<struct<license:string,start:int,end:int,spdx:string>>"
_FINDING = pa.list_(pa.struct([("license", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("spdx", pa.string())]))


def _scanned(batches):
    for batch in batches:
        rows = [[{"license": FAMILY.get(c, c), "start": a, "end": b, "spdx": c} for c, a, b in scan_full(t)]
                for t in batch.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(rows, _FINDING)], names=["doc_id", "findings"])


def scan_licenses(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, findings, licenses, n_findings) of every row; a finding's
    `license` is the family (BSD), its `spdx` the licence with its clauses
    (BSD-3-Clause)."""
    found = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(_scanned, _DDL)
    return found.select("doc_id", "findings", F.array_sort(F.array_distinct("findings.license")).alias("licenses"),
                        F.size("findings").alias("n_findings"))
