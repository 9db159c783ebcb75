"""License scans: ordered signature rules on the words of a text.

Some hundreds of regexes run over the normalised words (lower-cased, one space between): the
licences' own sentences, and the names with the statements that go round them.  A rule runs only
in texts that hold its keyword, which one Aho-Corasick pass finds.  Detections are taken by
priority; one that lies inside a taken one is suppressed, so "gnu lesser general public license"
does not also count as the plain one.  A tree of prefix maxima over the starts answers whether a
taken one holds a hit, so n hits cost n log n.
Denials ("not released under the ...", "rather than the ...") are rules of the highest priority
without a label of their own: they hold the name that they deny, which is thereby suppressed.
The base phrases are counted apart from that and always stay.

Plan: scan -> mapInArrow, no exchange.
"""

from __future__ import annotations

import bisect
import functools
import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import mapped, slices

# The base phrases and their labels.
BASE = {"mit license": "mit", "apache license": "apache", "general public license": "gpl"}

# Label, and the names it goes by (regexes on normalised words).
NAMES = {
    "mit": ["mit license", "mit licence", "expat license", "x11 license"],
    "apache-1.1": ["apache (?:software )?license version 1 1", "apache software license 1 1"],
    "apache-2.0": ["apache license (?:version |v)?2 0", "apache license 2", "apache software license 2 0", "apache 2 0"],
    "gpl-2.0": ["gnu general public license (?:version |v)2", "gnu gpl (?:version |v)?2", "gplv2", "gpl 2 0"],
    "gpl-3.0": ["gnu general public license (?:version |v)3", "gnu gpl (?:version |v)?3", "gplv3", "gpl 3 0"],
    "gpl": ["gnu general public license", "gnu gpl"],
    "lgpl-2.1": ["gnu lesser general public license (?:version |v)2 1", "lgpl (?:version |v)?2 1"],
    "lgpl-3.0": ["gnu lesser general public license (?:version |v)3", "lgpl (?:version |v)?3"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl"],
    "agpl-3.0": ["gnu affero general public license (?:version |v)?3?", "agpl (?:version |v)?3", "affero general public license"],
    "bsd-2-clause": ["bsd 2 clause", "simplified bsd license", "freebsd license"],
    "bsd-3-clause": ["bsd 3 clause", "new bsd license", "modified bsd license"],
    "bsd": ["bsd license", "berkeley software distribution license"],
    "mpl-2.0": ["mozilla public license (?:version |v)?2 0", "mpl 2 0"],
    "mpl-1.1": ["mozilla public license (?:version |v)?1 1", "mpl 1 1"],
    "epl-1.0": ["eclipse public license (?:version |v)?1 0", "epl 1 0"],
    "epl-2.0": ["eclipse public license (?:version |v)?2 0", "epl 2 0"],
    "cddl-1.0": ["common development and distribution license"],
    "isc": ["isc license", "internet systems consortium license"],
    "zlib": ["zlib license", "zlib libpng license"],
    "unlicense": ["unlicense"],
    "wtfpl": ["do what the fuck you want to public license", "wtfpl"],
    "cc0-1.0": ["creative commons zero", "cc0 1 0", "cc0"],
    "cc-by-4.0": ["creative commons attribution 4 0", "cc by 4 0"],
    "cc-by-3.0": ["creative commons attribution 3 0", "cc by 3 0"],
    "cc-by-sa-4.0": ["creative commons attribution sharealike 4 0", "cc by sa 4 0"],
    "cc-by-sa-3.0": ["creative commons attribution sharealike 3 0", "cc by sa 3 0"],
    "cc-by-nc-4.0": ["creative commons attribution noncommercial 4 0", "cc by nc 4 0"],
    "cc-by-nd-4.0": ["creative commons attribution noderivatives 4 0", "cc by nd 4 0"],
    "cc-by-nc-sa-4.0": ["creative commons attribution noncommercial sharealike 4 0", "cc by nc sa 4 0"],
    "cc-by-nc-nd-4.0": ["creative commons attribution noncommercial noderivatives 4 0", "cc by nc nd 4 0"],
    "artistic-2.0": ["artistic license (?:version |v)?2 0"],
    "artistic-1.0": ["artistic license (?:version |v)?1 0"],
    "artistic": ["artistic license"],
    "boost-1.0": ["boost software license"],
    "ofl-1.1": ["sil open font license"],
    "psf-2.0": ["python software foundation license", "psf license"],
    "eupl-1.2": ["european union public licence", "eupl"],
    "ecl-2.0": ["educational community license (?:version |v)?2 0"],
    "ms-pl": ["microsoft public license", "ms pl"],
    "odbl-1.0": ["open database license", "odbl"],
    "gfdl": ["gnu free documentation license", "gfdl"],
    "sspl-1.0": ["server side public license"],
    "busl-1.1": ["business source license"],
    "openrail": ["responsible ai license", "openrail"],
}
# Statements around a name, from the most to the least telling, with their priority.
STATEMENTS = [
    (90, "spdx license identifier {}"),
    (80, "(?:is |are |be )?(?:licensed|released|distributed|made available|published) under (?:the terms of )?(?:the |a |an )?{}"),
    (75, "(?:redistribute|modify|use) (?:it|them|this \\w+) under the terms of (?:the )?{}"),
    (70, "under (?:the terms of )?(?:the |a |an )?{}"),
    (65, "(?:subject|according) to (?:the terms of )?(?:the |a |an )?{}"),
    (60, "licen[cs]e (?:is )?(?:the )?{}"),
    (50, "see (?:the )?{}"),
    (40, "{}"),
]
#: Priority of denials, above every statement, and the label that stands for none.
DENIED, NO_LABEL = 99, ""
# Wordings around a name that say that the license does not apply ("or not" leaves it open).
DENIALS = [
    "(?<! or )(?:not|never|nor|neither|longer|isn t|aren t|wasn t|weren t|hasn t been|won t be) "
    "(?:be |been |being |to be |itself |yet |currently )?(?:licensed|released|distributed|made available|available|published|provided|offered|covered|governed) (?:under|by) (?:the terms of )?(?:the |a |an |any )?{}",
    "(?<! or )(?:not|neither|nor) (?:use |using |choose |accept |mean )?(?:under )?(?:the terms of )?(?:the |a |an )?{}",
    "(?:rather than|instead of|other than|unlike|incompatible with|not compatible with|not subject to|no longer) (?:under )?(?:the terms of )?(?:the |a |an )?{}",
]
# Sentences of the licences themselves and of their notices (label, priority, keyword, regex on normalised words).
GAP = "(?:\\S+ ){0,12}"
SENTENCES = [
    ("mit", 88, "sublicense", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:the )?software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software"),
    ("mit", 85, "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("mit", 60, "permission", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"),
    ("mit", 50, "noninfringement", "including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"),
    ("mit-0", 89, "hereby", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files (?:the )?software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so the software is provided"),
    ("boost-1.0", 87, "organization", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("boost-1.0", 55, "solely", "unless such copies or derivative works are solely in the form of machine executable object code generated by a source language processor"),
    ("isc", 86, "fee", "permission to use copy modify and (?:or )?distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies"),
    ("isc", 55, "disclaims", "the software is provided as is and the author disclaims all warranties with regard to this software"),
    ("0bsd", 84, "fee", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted the software is provided as is"),
    ("bsd", 80, "redistribution", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("bsd", 55, "redistributions", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"),
    ("bsd", 55, "redistributions", "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"),
    ("bsd-3-clause", 82, "endorse", f"neither the names? of {GAP}nor the names of (?:its|their) contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("bsd-4-clause", 83, "advertising", "all advertising materials mentioning features or use of this software must display the following acknowledge?ment this product includes software developed by"),
    ("bsd", 50, "merchantability", "any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"),
    ("apache-2.0", 88, "compliance", "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license"),
    ("apache-2.0", 70, "writing", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied"),
    ("apache-2.0", 65, "governing", "see the license for the specific language governing permissions and limitations under the license"),
    ("apache-2.0", 80, "reproduction", "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document"),
    ("apache-2.0", 75, "irrevocable", "each contributor hereby grants to you a perpetual worldwide non exclusive no charge royalty free irrevocable copyright license"),
    ("apache-1.1", 82, "acknowledgment", "the end user documentation included with the redistribution if any must include the following acknowledgment this product includes software developed by the apache software foundation"),
    ("gpl-2.0-or-later", 90, "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3.0-or-later", 90, "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("gpl-2.0", 89, "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 (?:only )?as published by the free software foundation"),
    ("gpl", 86, "redistribute", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("gpl", 60, "hope", "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the gnu general public license for more details"),
    ("gpl", 60, "received", "you should have received a copy of the gnu general public license along with this program"),
    ("gpl-3.0", 80, "copyleft", "the gnu general public license is a free copyleft license for software and other kinds of works"),
    ("gpl-2.0", 78, "intended", "the licenses for most software are designed to take away your freedom to share and change it by contrast the gnu general public license is intended to guarantee your freedom"),
    ("gpl", 60, "everyone", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"),
    ("lgpl-2.1-or-later", 90, "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version"),
    ("lgpl-3.0-or-later", 90, "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", 86, "redistribute", "this library is free software you can redistribute it and or modify it under the terms of the gnu (?:lesser|library) general public license"),
    ("lgpl", 60, "received", "you should have received a copy of the gnu (?:lesser|library) general public license along with this library"),
    ("lgpl-3.0", 70, "incorporates", "this version of the gnu lesser general public license incorporates the terms and conditions of version 3 of the gnu general public license"),
    ("agpl-3.0-or-later", 90, "affero", "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("agpl-3.0", 80, "affero", "the gnu affero general public license is a free copyleft license for software and other kinds of works specifically designed to ensure cooperation with the community in the case of network server software"),
    ("agpl-3.0", 60, "affero", "you should have received a copy of the gnu affero general public license along with this program"),
    ("mpl-2.0", 88, "mozilla", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("mpl-2.0", 70, "obtain", "if a copy of the mpl was not distributed with this file you can obtain one at"),
    ("mpl-1.1", 88, "mozilla", "the contents of this file are subject to the mozilla public license version 1 1 the license you may not use this file except in compliance with the license"),
    ("epl-1.0", 86, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license v1 0"),
    ("epl-2.0", 86, "eclipse", "this program and the accompanying materials are made available under the terms of the eclipse public license (?:v ?)?2 0"),
    ("epl-1.0", 70, "constitutes", "any use reproduction or distribution of the program constitutes recipient s acceptance of this agreement"),
    ("cddl-1.0", 86, "development", "the contents of this file are subject to the terms of the common development and distribution license"),
    ("zlib", 84, "liable", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("zlib", 70, "misrepresented", "the origin of this software must not be misrepresented you must not claim that you wrote the original software"),
    ("zlib", 65, "plainly", "altered source versions must be plainly marked as such and must not be misrepresented as being the original software"),
    ("unlicense", 88, "unencumbered", "this is free and unencumbered software released into the public domain"),
    ("unlicense", 70, "compile", "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose"),
    ("wtfpl", 88, "fuck", "you just do what the fuck you want to"),
    ("cc0-1.0", 86, "waived", f"to the extent possible under law {GAP}(?:has|have) waived all copyright and related or neighboring rights to"),
    ("cc0-1.0", 80, "dedicated", "the person who associated a work with this deed has dedicated the work to the public domain"),
    ("cc-by-4.0", 88, "commons", "this work is licensed under (?:a |the )?creative commons attribution 4 0 international license"),
    ("cc-by-sa-4.0", 88, "commons", "this work is licensed under (?:a |the )?creative commons attribution sharealike 4 0 international license"),
    ("cc-by-nc-4.0", 88, "commons", "this work is licensed under (?:a |the )?creative commons attribution noncommercial 4 0 international license"),
    ("cc-by-nc-sa-4.0", 88, "commons", "this work is licensed under (?:a |the )?creative commons attribution noncommercial sharealike 4 0 international license"),
    ("cc-by-nd-4.0", 88, "commons", "this work is licensed under (?:a |the )?creative commons attribution noderivatives 4 0 international license"),
    ("cc-by-sa-3.0", 88, "commons", "(?:text is|content is) available under the creative commons attribution sharealike license"),
    ("ofl-1.1", 88, "font", "this font software is licensed under the sil open font license version 1 1"),
    ("ofl-1.1", 75, "font", "permission is hereby granted free of charge to any person obtaining a copy of the font software"),
    ("psf-2.0", 80, "psf", "psf hereby grants licensee a nonexclusive royalty free world wide license to reproduce"),
    ("artistic-2.0", 78, "standard", "you are permitted to use the standard version and create and use modified versions for any purpose without restriction"),
    ("artistic-1.0", 78, "artistic", "the intent of this document is to state the conditions under which a package may be copied such that the copyright holder maintains some semblance of artistic control"),
    ("eupl-1.2", 82, "european", "licensed under the eupl (?:version 1 2 )?or as soon they will be approved by the european commission subsequent versions of the eupl"),
    ("ms-pl", 80, "governs", "this license governs use of the accompanying software if you use the software you accept this license"),
    ("gfdl", 86, "documentation", "permission is granted to copy distribute and or modify this document under the terms of the gnu free documentation license"),
    ("odbl-1.0", 84, "database", "this (?:database|data) is made available under the open database license"),
    ("postgresql", 84, "agreement", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ntp", 82, "fee", "permission to use copy modify and distribute this software and its documentation for any purpose with or without fee is hereby granted provided that the above copyright notice appears in all copies"),
    ("x11", 80, "dealings", f"except as contained in this notice the names? of {GAP}shall not be used in advertising or otherwise to promote the sale use or other dealings in this software without prior written authorization"),
    ("curl", 80, "fee", "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is without warranty of any kind"),
    ("openssl", 82, "openssl", "this product includes software developed by the openssl project for use in the openssl toolkit"),
    ("php-3.01", 82, "php", "products derived from this software may not be called php nor may php appear in their name"),
    ("json", 82, "evil", "the software shall be used for good not evil"),
    ("beerware", 82, "beer", "if we meet some day and you think this stuff is worth it you can buy me a beer in return"),
    ("sspl-1.0", 84, "service", "if you make the functionality of the program or a modified version available to third parties as a service you must make the service source code available"),
    ("busl-1.1", 84, "change", "effective on the change date or the fourth anniversary of the first publicly available distribution of a specific version of the licensed work under this license"),
    ("public-domain", 80, "domain", "this (?:file|work|software|code|program) (?:is|has been) (?:hereby )?(?:placed |released |dedicated )?(?:in|into|to) the public domain"),
    ("proprietary", 84, "unauthorized", "unauthorized copying of this file via any medium is strictly prohibited"),
    ("proprietary", 82, "confidential", "proprietary and confidential"),
    ("proprietary", 80, "proprietary", "this software is (?:the )?(?:confidential and )?proprietary (?:information )?of"),
]
#: Words of a name that do not tell licenses apart and so make poor keywords.
COMMON = {"by", "nc", "nd", "sa", "the", "and", "public", "version", "to", "do", "what", "you", "want"}

SCHEMA = (
    "doc_id long, n_words long, n_base long, first_word long, last_word long, base_labels array<string>, labels array<string>, score double, "
    "detections array<struct<label:string,priority:int,first:long,words:long>>"
)


@functools.lru_cache(maxsize=1)
def signatures() -> list[tuple[int, str, re.Pattern, str]]:
    """(priority, label, pattern, keyword) of every rule, highest priority first."""
    rules = [(1000 * priority + 10 * len(text.split()), label, re.compile(f"(?<= ){text}(?= )"), keyword) for label, priority, keyword, text in SENTENCES]
    for label, names in NAMES.items():
        for name in names:
            plain = re.sub(r"\(\?:.*?\)\??|\W\?", " ", name).split()
            keyword = max((w for w in plain if w not in COMMON), key=lambda w: (len(w), w))
            for priority, statement in [*STATEMENTS, *((DENIED, denial) for denial in DENIALS)]:
                # The longer name counts as the more specific rule.
                rules.append((1000 * priority + 10 * len(plain), NO_LABEL if priority == DENIED else label, re.compile(f"(?<= ){statement.format(f'(?:{name})')}(?= )"), keyword))
    return sorted(rules, key=lambda r: (-r[0], r[1], r[2].pattern))


@functools.lru_cache(maxsize=1)
def _keywords():
    import ahocorasick

    tree = ahocorasick.Automaton()
    for keyword in {r[3] for r in signatures()}:
        tree.add_word(f" {keyword} ", keyword)  # as a whole word: short ones stand inside many others
    tree.make_automaton()
    return tree


#: A-Z to a-z, other ASCII but digits and letters to a space; bytes of other characters stay.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def normalised(text: str) -> tuple[str, int]:
    """The words of a text, one space before and after each, and their number."""
    found = text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b" ")
    found = [w for w in found if w]
    return f" {b' '.join(found).decode('utf-8', 'surrogatepass')} ", len(found)


def places(flat: str, phrase: str) -> list[int]:
    """Word positions at which the phrase stands."""
    out, at, needle, words, done = [], 0, f" {phrase} ", 0, 0
    while (at := flat.find(needle, at)) >= 0:
        words += flat.count(" ", done, at)
        done = at
        out.append(words)
        at += 1
    return out


def detections(flat: str) -> list[tuple[str, int, int, int]]:
    """(label, priority, first word, words) of the rules' hits that no hit of higher priority contains; of equal places the first rule's.

    Denials are among them, with an empty label.
    """
    present = {k for _, k in _keywords().iter(flat)}
    if not present:
        return []
    hits = [(m.start(), m.end(), label, priority) for priority, label, pattern, keyword in signatures() if keyword in present for m in pattern.finditer(flat)]
    if not hits:
        return []
    starts = sorted({h[0] for h in hits})
    far = [0] * (len(starts) + 1)  # over the taken hits, a Fenwick tree of the largest end up to each start
    taken = []
    for hit in hits:
        place = at = bisect.bisect_right(starts, hit[0])
        reach = 0
        while at:
            reach = max(reach, far[at])
            at &= at - 1
        if reach >= hit[1]:
            continue
        taken.append(hit)
        while place < len(far):
            far[place] = max(far[place], hit[1])
            place += place & -place
    spaces = [m.start() for m in re.finditer(" ", flat)]
    before = lambda at: bisect.bisect_left(spaces, at)
    return [(label, priority, before(a) - 1, before(b) - before(a) + 1) for a, b, label, priority in sorted(taken)]


def _inside(place: int, firsts: list[int], reach: list[int]) -> bool:
    """Whether a word lies in a span; firsts: where the spans begin, sorted; reach: the largest end up to each."""
    at = bisect.bisect_right(firsts, place) - 1
    return at >= 0 and place < reach[at]


def scan_licenses(docs: DataFrame) -> DataFrame:
    """Word count, base places, labels, detections and a score for every row of docs (doc_id, text).

    ``score`` is the weight of the strongest detection (priority of its statement, 0 to 1), 0
    without any; a base phrase alone scores at least 0.4, or 0.1 if all its places are denied.  A
    name that the text denies gives no label, but base labels stay.  Null and empty texts have no words,
    places or labels; repeated rows are scanned each for itself; other columns are ignored; an
    empty table gives no rows.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in slices(batches):
            rows = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                flat, n = normalised(text or "")
                base = {label: places(flat, phrase) for phrase, label in BASE.items() if f" {phrase} " in flat}
                hits = detections(flat)
                starts = [p for ps in base.values() for p in ps]
                denials = [(a, a + k) for label, _, a, k in hits if label == NO_LABEL]
                firsts, reach = [a for a, _ in denials], [*itertools.accumulate((b for _, b in denials), max)]
                hits = [h for h in hits if h[0] != NO_LABEL]
                labels = sorted({*base, *(h[0] for h in hits)})
                meant = any(not _inside(p, firsts, reach) for p in starts)
                score = max([0.4 if meant else 0.1 * bool(base), *(h[1] // 1000 / 100 for h in hits)])
                rows.append(
                    {
                        "doc_id": doc_id, "n_words": n, "n_base": len(starts), "first_word": min(starts, default=None), "last_word": max(starts, default=None), "base_labels": sorted(base), "labels": labels,
                        "score": float(score), "detections": [{"label": label, "priority": p // 1000, "first": a, "words": k} for label, p, a, k in hits],
                    }
                )
            yield pa.RecordBatch.from_pylist(rows, schema=ARROW)

    return mapped(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), run, SCHEMA)


ARROW = pa.schema(
    [
        ("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_base", pa.int64()), ("first_word", pa.int64()), ("last_word", pa.int64()), ("base_labels", pa.list_(pa.string())), ("labels", pa.list_(pa.string())),
        ("score", pa.float64()), ("detections", pa.list_(pa.struct([("label", pa.string()), ("priority", pa.int32()), ("first", pa.int64()), ("words", pa.int64())]))),
    ]
)


def digest(scanned: DataFrame) -> DataFrame:
    """The columns of the registered query."""
    return scanned.select("doc_id", "n_words", "n_base", "first_word", "last_word", F.array_join("base_labels", ",").alias("base_labels"), F.array_join("labels", ",").alias("labels"), "score")
