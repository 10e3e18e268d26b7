"""Operator 5 (DataFrame functions only): licence scan by sentence rules.

A text is normalised (A-Z lower-cased, runs of other characters than a-z and 0-9 become one space, comment
marks with them). A known licence sentence is found where it begins at the start of a sentence or line and
ends at the end of one, or goes on if it has eight words or more (sentences end after ``.!?`` with white space and at empty
lines); in between it may run over any number of lines, or hold an abbreviation. Names that a licence leaves open (of a
holder or organisation) count as the usual ones. A notice, that something is licensed, released and so on under a
licence by its name, is found wherever it stands, and whatever follows; behind "not" it is none. SPDX tags are read as
expressions: each licence counts, exceptions after WITH are dropped, a + and the old names stand for the new ones. Where
several begin, the longest counts, and the search goes on behind it. The identifiers in text order form a sequence; the
ordered rules are matched against it, and each licence takes its first rule that occurs as consecutive identifiers.

Null and empty texts have no sentence, hence an empty sequence and no licence; an empty table gives no rows.
Repeated rows and repeated sentences keep their repeats. Columns named like a new one are replaced. Texts are
read whole.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Names of licences as notices give them, and SPDX identifiers.
NAMES = {
    "mit license": "MIT", "apache license version 2 0": "Apache-2.0", "apache license version 2 0 the license": "Apache-2.0", "apache license 2 0": "Apache-2.0", "apache 2 0 license": "Apache-2.0",
    "gnu general public license version 2": "GPL-2.0", "gnu general public license version 3": "GPL-3.0", "gnu general public license v3 0": "GPL-3.0", "gnu lesser general public license version 2 1": "LGPL-2.1",
    "gnu lesser general public license version 3": "LGPL-3.0", "gnu affero general public license version 3": "AGPL-3.0", "mozilla public license version 2 0": "MPL-2.0", "mozilla public license 2 0": "MPL-2.0", "mpl 2 0 license": "MPL-2.0",
    "bsd 2 clause license": "BSD-2-Clause", "bsd 3 clause license": "BSD-3-Clause", "isc license": "ISC", "eclipse public license 2 0": "EPL-2.0", "boost software license version 1 0": "BSL-1.0", "unlicense": "Unlicense", "zlib license": "Zlib",
}
SHORT = {
    "mit": "MIT", "isc": "ISC", "apache 2 0": "Apache-2.0", "apache license v2 0": "Apache-2.0", "gplv2": "GPL-2.0", "gpl v2": "GPL-2.0", "gnu gpl v2": "GPL-2.0", "gnu gpl version 2": "GPL-2.0", "gplv3": "GPL-3.0", "gpl v3": "GPL-3.0", "gnu gpl v3": "GPL-3.0",
    "gnu gpl version 3": "GPL-3.0", "lgplv3": "LGPL-3.0", "lgpl v3": "LGPL-3.0", "agplv3": "AGPL-3.0", "agpl v3": "AGPL-3.0", "mpl 2 0": "MPL-2.0", "bsd 2 clause": "BSD-2-Clause", "bsd 3 clause": "BSD-3-Clause", "simplified bsd license": "BSD-2-Clause",
    "new bsd license": "BSD-3-Clause", "modified bsd license": "BSD-3-Clause", "cc by 4 0": "CC-BY-4.0", "cc by sa 4 0": "CC-BY-SA-4.0", "cc by nc 4 0": "CC-BY-NC-4.0", "cc0": "CC0-1.0", "cc0 1 0": "CC0-1.0", "the unlicense": "Unlicense",
}
COMMONS = {"attribution": "CC-BY-4.0", "attribution sharealike": "CC-BY-SA-4.0", "attribution noncommercial": "CC-BY-NC-4.0"}
#: What begins a notice, before the licence's name.
NOTICE = "(?:licensed|licenced|released|distributed|published|provided|available|covered) (?:under|by) (?:the terms (?:and conditions )?of )?(?:the |a |an )?"
SPDX = (
    "MIT", "Apache-2.0", "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "AGPL-3.0-only", "AGPL-3.0-or-later",
    "MPL-2.0", "BSD-2-Clause", "BSD-3-Clause", "ISC", "EPL-2.0", "BSL-1.0", "Unlicense", "Zlib", "CC0-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0",
)
# Normalised sentences of public licence texts, with identifiers of our own.
TEXTS = {
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-condition",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "you may not use this file except in compliance with the license": "apache2-compliance",
    "you may obtain a copy of the license at": "apache2-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache2-warranty",
    "see the license for the specific language governing permissions and limitations under the license": "apache2-see",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation": "gpl2-only",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-later",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-later",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "see the gnu lesser general public license for more details": "lgpl-see",
    "see the gnu affero general public license for more details": "agpl-see",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-terms",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd3-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0": "epl2-terms",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "all rights reserved": "reserved",
}


# How the licences' own texts begin, with identifiers of our own.
BODIES = {
    "apache license version 2 0 january 2004": "apache2-title", "terms and conditions for use reproduction and distribution": "apache2-terms",
    "license shall mean the terms and conditions for use reproduction and distribution as defined by sections 1 through 9 of this document": "apache2-license", "licensor shall mean the copyright owner or entity authorized by the copyright owner that is granting the license": "apache2-licensor",
    "gnu general public license version 3 29 june 2007": "gpl3-title", "gnu general public license version 2 june 1991": "gpl2-title", "gnu lesser general public license version 3 29 june 2007": "lgpl3-title", "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title", "everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed": "gpl-verbatim",
    "the gnu general public license is a free copyleft license for software and other kinds of works": "gpl3-preamble", "the licenses for most software are designed to take away your freedom to share and change it": "gpl2-preamble", "mozilla public license version 2 0": "mpl2-title",
    "permission to use copy modify and distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
}
#: Old SPDX names and what they stand for.
OLD_SPDX = {x: f"{x}-only" for x in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0")}
TAG = "spdx license identifier "


def _spoken(x: str) -> str:
    return x.lower().replace("-", " ").replace(".", " ")


def _sentences() -> dict[str, str]:
    """TEXTS, BODIES and every SPDX tag."""
    tags = {x: x for x in SPDX} | OLD_SPDX
    return TEXTS | BODIES | {f"{TAG}{_spoken(x)}": f"{of}-tag" for x, of in tags.items()}


def _names() -> dict[str, str]:
    """Licences by the names that notices give them."""
    out = SHORT | NAMES
    for kind, of in COMMONS.items():
        out |= {f"creative commons {kind} 4 0{end}": of for end in ("", " license", " international", " international license", " international public license")}
    return {k: f"{of}-notice" for k, of in out.items()}


NOTICED = _names()
SENTENCES = _sentences()
#: (licence, rule, consecutive identifiers), in order: a licence takes its first rule that matches.
RULES = (
    ("Apache-2.0", "text", ("apache2-title", "apache2-terms")),
    ("Apache-2.0", "text", ("apache2-license", "apache2-licensor")),
    ("Apache-2.0", "header", ("Apache-2.0-notice", "apache2-compliance", "apache2-copy")),
    ("GPL-3.0", "text", ("gpl3-title", "gpl-verbatim")),
    ("GPL-3.0", "text", ("gpl3-preamble",)),
    ("GPL-2.0", "text", ("gpl2-title", "gpl-verbatim")),
    ("GPL-2.0", "text", ("gpl2-preamble",)),
    ("LGPL-3.0", "text", ("lgpl3-title", "gpl-verbatim")),
    ("LGPL-2.1", "text", ("lgpl21-title", "gpl-verbatim")),
    ("AGPL-3.0", "text", ("agpl3-title", "gpl-verbatim")),
    ("MPL-2.0", "text", ("mpl2-title",)),
    ("MIT", "text", ("mit-grant", "mit-condition")),
    ("GPL-2.0-or-later", "header", ("gpl2-later", "gpl-warranty")),
    ("GPL-2.0-or-later", "grant", ("gpl2-later",)),
    ("GPL-2.0-only", "grant", ("gpl2-only",)),
    ("GPL-3.0-or-later", "header", ("gpl3-later", "gpl-warranty")),
    ("GPL-3.0-or-later", "grant", ("gpl3-later",)),
    ("LGPL-2.1-or-later", "header", ("lgpl21-later", "gpl-warranty")),
    ("LGPL-2.1-or-later", "grant", ("lgpl21-later",)),
    ("LGPL-3.0-or-later", "header", ("lgpl3-later", "gpl-warranty")),
    ("LGPL-3.0-or-later", "grant", ("lgpl3-later",)),
    ("AGPL-3.0-or-later", "header", ("agpl3-later", "gpl-warranty")),
    ("AGPL-3.0-or-later", "grant", ("agpl3-later",)),
    ("MPL-2.0", "header", ("mpl2-terms",)),
    ("BSD-3-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd3-endorse")),
    ("BSD-3-Clause", "short", ("bsd-grant", "bsd3-endorse")),
    ("BSD-2-Clause", "text", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("BSD", "grant", ("bsd-grant",)),
    ("ISC", "text", ("isc-grant",)),
    ("EPL-2.0", "header", ("epl2-terms",)),
    ("Unlicense", "text", ("unlicense-grant",)),
    ("Zlib", "text", ("zlib-grant",)),
    *((x, "tag", (f"{x}-tag",)) for x in SPDX),
    *((x, "notice", (f"{x}-notice",)) for x in dict.fromkeys([*NAMES.values(), *COMMONS.values(), *SHORT.values()])),
)


def hints(sentences) -> list[str]:
    """A few words of which every sentence holds one, found greedily."""
    left, out = set(sentences), []
    words = sorted({w for s in sentences for w in s.split() if len(w) > 4})
    while left:
        best = max(words, key=lambda w: (sum(w in s for s in left), len(w)), default="")
        held = {s for s in left if best in s} if best else set()
        if not held:  # sentences of short words only: each is its own hint
            return out + sorted(min(s.split(), key=lambda w: (-len(w), w)) for s in left)
        out.append(best)
        left -= held
    return out


#: Words that stand between the others where a licence leaves a name open, and the usual ones.
HOLES = (
    (r"neither the name of (?:[a-z0-9NS]+ ){1,12}?nor the names of (?:its|the) contributors", "neither the name of the copyright holder nor the names of its contributors"),
    (r"this software is provided by (?:[a-z0-9NS]+ ){1,12}?as is and any express", "this software is provided by the copyright holders and contributors as is and any express"),
)
#: From so many words on a sentence may go on.
LONG_SENTENCE = 8


def pattern(sentences=SENTENCES, names=NOTICED) -> str:
    """What is searched for in a normalised text, in which the ends of lines and sentences are doubled marks, N and S: every
    sentence takes a mark of its own on either side.
    """
    over = " (?:N N |S S )?"
    longest_first = lambda xs: sorted(xs, key=lambda x: (-len(x.split()), x))
    some = lambda xs: "|".join(x.replace(" ", over) for x in longest_first(xs))
    long, short = [x for x in sentences if len(x.split()) >= LONG_SENTENCE], [x for x in sentences if len(x.split()) < LONG_SENTENCE]
    noticed = f"{NOTICE.replace(' ', over)}(?:{some(names)})"
    return rf"[SN] (?:{some(long)})\b|[SN] (?:{some(short)}) [SN]|\bnot (?:yet )?{noticed}\b|\b{noticed}\b"


def scan(docs: DataFrame, text: str = "text", sentences=SENTENCES, rules=RULES, names=NOTICED) -> DataFrame:
    """docs without the text, with ``sentence_ids`` and ``licenses`` (``licence:rule``) arrays; licences are in rule order."""
    upper, lower = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    low = F.translate(F.col(text), upper, lower)

    def licences(line):
        """A line with an SPDX tag as what precedes it and a line for each licence of its expression."""
        said = F.regexp_replace(F.regexp_extract(line, r"spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]*)", 1), r"(^|[ \t(])with[ \t]+[a-z0-9.+-]+", " ")
        each = F.filter(F.regexp_extract_all(said, F.lit(r"([a-z0-9][a-z0-9.+-]*)"), F.lit(1)), lambda x: ~x.isin("and", "or"))
        return F.array_join(F.concat(F.array(F.regexp_extract(line, r"^(.*?)spdx-license-identifier:", 1)), F.transform(each, lambda x: F.concat(F.lit(TAG), F.regexp_replace(x, r"\+$", "-or-later")))), "\n")

    tagged = F.array_join(F.transform(F.split(low, "\n"), lambda x: F.when(F.contains(x, F.lit("spdx-license-identifier:")), licences(x)).otherwise(x)), "\n")
    low = F.when(F.contains(low, F.lit("spdx-license-identifier:")), tagged).otherwise(low)
    # capitals are free once lower-cased: S marks the end of a sentence, N that of a line
    ends = F.regexp_replace(F.regexp_replace(low, r"([.!?])[ \t\x0B\f\r\n]+", "$1 S S "), "\n", " N N ")
    norm = F.concat(F.lit("N "), F.trim(F.regexp_replace(ends, "[^a-z0-9SN]+", " ")), F.lit(" N"))
    for hole, usual in HOLES:
        norm = F.regexp_replace(norm, hole, usual)
    found = F.transform(F.regexp_extract_all(norm, F.lit(pattern(sentences, names)), F.lit(0)), lambda x: F.trim(F.regexp_replace(F.regexp_replace(x, " (?:N N|S S) ", " "), "^[SN] | [SN]$", "")))
    name = lambda x: F.regexp_replace(x, f"^{NOTICE}", "")
    ids = F.array_compact(F.transform(found, lambda x: F.coalesce(F.try_element_at(table(sentences), x), F.try_element_at(table(names), name(x)))))
    # a text with none of these words has no sentence
    hint = "(?i)" + "|".join([*hints(sentences), "licen[sc]ed", "released", "distributed", "published", "provided", "available", "covered"])
    found = docs.withColumn("sentence_ids", F.when(F.col(text).rlike(hint), ids).otherwise(F.array().cast("array<string>")))
    line = F.concat(F.lit(","), F.array_join("sentence_ids", ","), F.lit(","))
    hit = lambda seq: F.contains(line, F.lit("," + ",".join(seq) + ","))
    taken = []
    for i, (licence, rule, seq) in enumerate(rules):
        ok = hit(seq)
        for n, _, earlier in rules[:i]:
            if n == licence:
                ok = ok & ~hit(earlier)
        taken.append(F.when(ok, F.lit(f"{licence}:{rule}")))
    return found.withColumn("licenses", F.array_compact(F.array(*taken))).drop(text)


def oracle() -> str:
    """DuckDB SQL of the columns of query op5, from the same fixed values."""
    listed = lambda d: f"map([{', '.join(repr(k) for k in d)}], [{', '.join(repr(v) for v in d.values())}])"
    cases = []
    for i, (licence, rule, seq) in enumerate(RULES):
        hit = lambda s: f"contains(line, ',{','.join(s)},')"
        no = "".join(f" and not {hit(s)}" for n, _, s in RULES[:i] if n == licence)
        cases.append(f"case when {hit(seq)}{no} then '{licence}:{rule}' end")
    holes = "t"
    for hole, usual in HOLES:
        holes = f"regexp_replace({holes}, '{hole}', '{usual}', 'g')"
    tag = r"""array_to_string(list_concat([regexp_extract(x, '^(.*?)spdx-license-identifier:', 1)], list_transform(list_filter(regexp_extract_all(regexp_replace(regexp_extract(x, 'spdx-license-identifier:[ \t]*([a-z0-9.+() \t-]*)', 1),
 '(^|[ \t(])with[ \t]+[a-z0-9.+-]+', ' ', 'g'), '[a-z0-9][a-z0-9.+-]*'), lambda y: y not in ('and', 'or')), lambda y: 'spdx license identifier ' || regexp_replace(y, '[+]$', '-or-later'))), chr(10))"""
    return f"""
with known as (select {listed(SENTENCES)} as m, {listed(NOTICED)} as nm),
low0 as (select doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as t from documents),
low as (select doc_id, case when contains(t, 'spdx-license-identifier:') then array_to_string(list_transform(string_split(t, chr(10)), lambda x: case when contains(x, 'spdx-license-identifier:') then {tag} else x end), chr(10)) else t end as t from low0),
marked as (select doc_id, replace(regexp_replace(t, '([.!?])[ \\t\\x0B\\f\\r\\n]+', '\\1 S S ', 'g'), chr(10), ' N N ') as t from low),
norm as (select doc_id, 'N ' || trim(regexp_replace(t, '[^a-z0-9SN]+', ' ', 'g')) || ' N' as t from marked),
filled as (select doc_id, {holes} as t from norm),
seen as (select doc_id, list_transform(regexp_extract_all(t, '{pattern()}'), lambda x: trim(regexp_replace(regexp_replace(x, ' (?:N N|S S) ', ' ', 'g'), '^[SN] | [SN]$', '', 'g'))) as f from filled),
ids as (select doc_id, list_filter(list_transform(f, lambda x: coalesce(m[x], nm[regexp_replace(x, '^{NOTICE}', '')])), lambda x: x is not null) as ids from seen, known),
lines as (select doc_id, len(ids) as n, coalesce(array_to_string(ids, ','), '') as joined, ',' || coalesce(array_to_string(ids, ','), '') || ',' as line from ids)
select doc_id, cast(n as bigint) as n_sentences, joined as sentence_ids,
       coalesce(array_to_string(list_filter([{", ".join(cases)}], lambda x: x is not null), ','), '') as licenses
from lines"""
