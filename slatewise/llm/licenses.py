"""Licence scans by sentence rules (DataFrame functions only).

A text is cut into sentences; each is normalised to plain lower-case words and
looked up among known licence sentences. A document is then the sequence of the
identifiers it holds, in text order, and a licence is found where all sentences of
one of its rules appear in the rule's order. A rule that says more takes the place
of the rules it contains, and "all rights reserved" counts only where nothing else does.

Everything is one projection over the documents: no join, no shuffle. Defined
cases: NULL and empty texts hold no sentences; repeated rows are scanned each; a
sentence may run over line ends and stand behind comment signs, and a line of its
own also counts as a sentence; an empty table gives an empty result.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known sentences of public licences and notices, normalised, by identifier.
SENTENCES = {
    "mit-title": "mit license",
    "mit-title-the": "the mit license",
    "mit-grant": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-permission": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    "mit-condition": "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    "mit-notice": "released under the mit license",
    "mit-notice-licensed": "licensed under the mit license",
    "mit-notice-this": "this project is licensed under the mit license",
    "as-is": "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    "isc-title": "isc license",
    "isc-grant": "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    "bsd-grant": "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    "bsd-source": "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    "bsd-binary": "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    "bsd-names": "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    "bsd-notice": "released under the bsd license",
    "bsd-notice-licensed": "licensed under the bsd license",
    "bsd-notice-3": "licensed under the bsd 3 clause license",
    "bsd-notice-2": "licensed under the bsd 2 clause license",
    "apache-notice": "licensed under the apache license version 2 0",
    "apache-notice-header": "licensed under the apache license version 2 0 the license",
    "apache-comply": "you may not use this file except in compliance with the license",
    "apache-as-is": "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    "gpl3-notice": "this work is licensed under the gnu general public license version 3",
    "gpl3-notice-short": "licensed under the gnu general public license version 3",
    "gpl2-notice": "this work is licensed under the gnu general public license version 2",
    "gpl2-notice-short": "licensed under the gnu general public license version 2",
    "gpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "gpl2-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    "lgpl-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-free": "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    "agpl-notice": "licensed under the gnu affero general public license version 3",
    "lgpl-notice": "licensed under the gnu lesser general public license version 3",
    "mpl-subject": "this source code form is subject to the terms of the mozilla public license v 2 0",
    "mpl-notice": "licensed under the mozilla public license version 2 0",
    "cc-by": "licensed under cc by 4 0",
    "cc-by-long": "this work is licensed under a creative commons attribution 4 0 international license",
    "cc-by-sa": "licensed under cc by sa 4 0",
    "cc-by-sa-long": "this work is licensed under a creative commons attribution sharealike 4 0 international license",
    "cc-by-nc": "licensed under cc by nc 4 0",
    "cc-by-nc-long": "this work is licensed under a creative commons attribution noncommercial 4 0 international license",
    "cc-by-nd": "licensed under cc by nd 4 0",
    "cc0": "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work",
    "cc0-notice": "licensed under cc0 1 0",
    "unlicense": "this is free and unencumbered software released into the public domain",
    "apache-title": "apache license version 2 0 january 2004",
    "apache-title-address": "apache license version 2 0 january 2004 http www apache org licenses",
    "gpl3-title": "gnu general public license version 3 29 june 2007",
    "gpl2-title": "gnu general public license version 2 june 1991",
    "lgpl3-title": "gnu lesser general public license version 3 29 june 2007",
    "lgpl21-title": "gnu lesser general public license version 2 1 february 1999",
    "agpl3-title": "gnu affero general public license version 3 19 november 2007",
    "lgpl21-free": "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version",
    "gpl-terms": "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation",
    "lgpl-terms": "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation",
    "version-2": "either version 2 of the license or at your option any later version",
    "version-2-1": "either version 2 1 of the license or at your option any later version",
    "version-3": "either version 3 of the license or at your option any later version",
    "mpl-subject-open": "this source code form is subject to the terms of the mozilla public license v",
    "mpl-title": "mozilla public license version 2 0",
    "epl2-title": "eclipse public license v 2 0",
    "epl1-title": "eclipse public license v 1 0",
    "epl2-notice": "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0",
    "zlib-as-is": "this software is provided as is without any express or implied warranty",
    "zlib-grant": "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    "zlib-title": "zlib license",
    "bsl-title": "boost software license version 1 0 august 17th 2003",
    "bsl-notice": "distributed under the boost software license version 1 0",
    "artistic-title": "the artistic license 2 0",
    "cddl-title": "common development and distribution license cddl version 1 0",
    "cc-by-nc-sa": "licensed under cc by nc sa 4 0",
    "cc-by-nc-sa-long": "this work is licensed under a creative commons attribution noncommercial sharealike 4 0 international license",
    "reserved": "all rights reserved",
}

#: Licence names of the tag `SPDX-License-Identifier`, and what they are called here where that differs.
TAGS = ("MIT", "ISC", "BSD-2-Clause", "BSD-3-Clause", "Apache-2.0", "AGPL-3.0", "LGPL-3.0", "LGPL-2.1", "GPL-3.0", "GPL-2.0", "MPL-2.0", "EPL-1.0", "EPL-2.0",
        "Zlib", "BSL-1.0", "Artistic-2.0", "CDDL-1.0", "CC-BY-4.0", "CC-BY-SA-4.0", "CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "CC0-1.0", "Unlicense")


def _tagged() -> dict[str, tuple[str, tuple[str, ...]]]:
    """Sentences of the tag and the licences they name, by identifier: one licence, its `only` and `or later` forms, and a choice of two."""
    forms = {tag: (tag,) for tag in TAGS}
    forms |= {f"{tag}-{end}": (tag,) for tag in TAGS if "GPL" in tag for end in ("only", "or-later")}
    forms |= {f"{tag} OR {other}": (tag, other) for tag in TAGS for other in TAGS[:5] if other != tag}
    return {"spdx-" + words.lower().replace(" ", "-"): (re.sub("[^a-z0-9]+", " ", f"spdx license identifier {words}".lower()), which)
            for words, which in forms.items()}


SENTENCES |= {name: words for name, (words, _) in _tagged().items()}

#: List signs that stand before or behind a condition where no empty line parts them, normalised.
SIGNS = ("1", "2", "3", "4", "a", "b", "c", "d", "i", "ii", "iii", "iv", "o")


def _listed() -> dict[str, str]:
    """The conditions of the BSD licences with their list signs, and those that run into one sentence, by identifier."""
    out = {f"bsd-grant-{s}": f"{SENTENCES['bsd-grant']} {s}" for s in SIGNS}
    out |= {f"{name}-{s}": f"{s} {SENTENCES[name]}" for name in ("bsd-source", "bsd-binary", "bsd-names") for s in SIGNS}
    return out | {f"bsd-open{s and '-' + s}": " ".join(filter(None, (SENTENCES["bsd-grant"], s, SENTENCES["bsd-source"]))) for s in ("", *SIGNS)}


SENTENCES |= _listed()
_SIGN = f"(-({'|'.join(SIGNS)}))?"
#: The grant and the first condition: apart, or in one sentence.
_BSD = ((f"bsd-grant{_SIGN}", f"bsd-source{_SIGN}"), (f"bsd-open{_SIGN}",))
#: Licence rules in order: licence, the sentences in the order they come (regular expressions over identifiers), and the licences this rule takes the place of.
RULES = (
    ("MIT", ("mit-grant", "as-is"), ()),
    ("MIT", ("mit-title", "mit-grant"), ()),
    ("MIT", ("mit-notice",), ()), ("MIT", ("mit-notice-licensed",), ()), ("MIT", ("mit-notice-this",), ()),
    ("MIT", ("mit-title-the",), ()), ("MIT", ("mit-grant",), ()), ("MIT", ("mit-permission", "mit-condition"), ()), ("MIT", ("mit-title", "as-is"), ()),
    ("ISC", ("isc-title",), ()), ("ISC", ("isc-grant",), ()),
    *(("BSD-3-Clause", (*start, f"bsd-binary{_SIGN}", f"bsd-names{_SIGN}"), ("BSD-2-Clause",)) for start in _BSD),
    ("BSD-3-Clause", ("bsd-notice-3",), ()), ("BSD-3-Clause", ("bsd-notice",), ()), ("BSD-3-Clause", ("bsd-notice-licensed",), ()),
    *(("BSD-2-Clause", (*start, f"bsd-binary{_SIGN}"), ()) for start in _BSD), ("BSD-2-Clause", ("bsd-notice-2",), ()),
    ("Apache-2.0", ("apache-notice-header", "apache-comply", "apache-as-is"), ()),
    ("Apache-2.0", ("apache-notice",), ()), ("Apache-2.0", ("apache-notice-header",), ()),
    ("AGPL-3.0", ("agpl-free",), ("GPL-3.0",)), ("AGPL-3.0", ("agpl-notice",), ()),
    ("LGPL-3.0", ("lgpl-free",), ("GPL-3.0",)), ("LGPL-3.0", ("lgpl-notice",), ()),
    ("GPL-3.0", ("gpl3-notice",), ()), ("GPL-3.0", ("gpl3-notice-short",), ()), ("GPL-3.0", ("gpl-free",), ()),
    ("GPL-2.0", ("gpl2-notice",), ()), ("GPL-2.0", ("gpl2-notice-short",), ()), ("GPL-2.0", ("gpl2-free",), ()),
    ("MPL-2.0", ("mpl-subject",), ()), ("MPL-2.0", ("mpl-notice",), ()),
    ("CC-BY-4.0", ("cc-by",), ()), ("CC-BY-4.0", ("cc-by-long",), ()),
    ("CC-BY-SA-4.0", ("cc-by-sa",), ()), ("CC-BY-SA-4.0", ("cc-by-sa-long",), ()),
    ("CC-BY-NC-4.0", ("cc-by-nc",), ()), ("CC-BY-NC-4.0", ("cc-by-nc-long",), ()),
    ("CC-BY-ND-4.0", ("cc-by-nd",), ()),
    ("CC0-1.0", ("cc0",), ()), ("CC0-1.0", ("cc0-notice",), ()),
    ("Unlicense", ("unlicense",), ()),
    ("Apache-2.0", ("apache-title",), ()), ("Apache-2.0", ("apache-title-address",), ()),
    ("GPL-3.0", ("gpl3-title",), ()), ("GPL-2.0", ("gpl2-title",), ()), ("AGPL-3.0", ("agpl3-title",), ("GPL-3.0",)),
    ("LGPL-3.0", ("lgpl3-title",), ("GPL-3.0",)), ("LGPL-2.1", ("lgpl21-title",), ()), ("LGPL-2.1", ("lgpl21-free",), ()),
    ("GPL-2.0", ("gpl-terms", "version-2"), ()), ("GPL-3.0", ("gpl-terms", "version-3"), ()),
    ("LGPL-2.1", ("lgpl-terms", "version-2-1"), ()), ("LGPL-3.0", ("lgpl-terms", "version-3"), ()),
    ("MPL-2.0", ("mpl-subject-open",), ()), ("MPL-2.0", ("mpl-title",), ()), ("EPL-2.0", ("epl2-title",), ()), ("EPL-2.0", ("epl2-notice",), ()), ("EPL-1.0", ("epl1-title",), ()),
    ("Zlib", ("zlib-as-is", "zlib-grant"), ()), ("Zlib", ("zlib-title",), ()), ("BSL-1.0", ("bsl-title",), ()), ("BSL-1.0", ("bsl-notice",), ()),
    ("Artistic-2.0", ("artistic-title",), ()), ("CDDL-1.0", ("cddl-title",), ()),
    ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa",), ()), ("CC-BY-NC-SA-4.0", ("cc-by-nc-sa-long",), ()),
    *((licence, ("(" + "|".join(name for name, (_, which) in _tagged().items() if licence in which) + ")",), ()) for licence in TAGS),
    ("proprietary", ("reserved",), ()),
)
#: This licence counts only where no other rule matches: most licence texts carry its sentence too.
LAST = "proprietary"
#: What a licence asks of training data, most restrictive kind first.
KINDS = {
    "restricted": ("CC-BY-NC-4.0", "CC-BY-NC-SA-4.0", "CC-BY-ND-4.0", "proprietary"),
    "copyleft": ("AGPL-3.0", "GPL-3.0", "GPL-2.0", "LGPL-3.0", "LGPL-2.1", "MPL-2.0", "EPL-2.0", "EPL-1.0", "CDDL-1.0", "CC-BY-SA-4.0"),
    "permissive": ("MIT", "ISC", "BSD-3-Clause", "BSD-2-Clause", "Apache-2.0", "Zlib", "BSL-1.0", "Artistic-2.0", "CC-BY-4.0", "CC0-1.0", "Unlicense"),
}
#: A sentence ends with one of these marks before white space, with a copyright line, or with an empty line.
ENDS = r"([.!?;]|Copyright[^\n.!?;]*[0-9]{4}[^\n.!?;]*)[ \t\r\n]+|\n[ \t\r]*\n"
CUT = "\x01"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def normal(sentence: Column) -> Column:
    return F.btrim(F.regexp_replace(F.translate(sentence, UPPER, LOWER), "[^a-z0-9]+", " "))


def sequence(text: Column) -> Column:
    """The identifiers of known sentences in a text, in order."""
    sentences = F.split(F.regexp_replace(text, ENDS, f"$1{CUT}"), CUT)
    units = F.flatten(F.transform(sentences, lambda s: F.array_distinct(F.concat(F.array(s), F.split(s, "\n")))))
    shortest, longest = min(map(len, SENTENCES.values())), max(map(len, SENTENCES.values()))
    plain = F.transform(F.filter(units, lambda u: F.length(u) >= shortest), normal)
    known = F.create_map(*[F.lit(x) for name, words in SENTENCES.items() for x in (words, name)])
    short = F.filter(plain, lambda u: F.length(u).between(shortest, longest))
    return F.filter(F.transform(short, lambda u: F.element_at(known, u)), lambda i: i.isNotNull())


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, sentences (the sequence found), licences (sorted, comma-joined) and kind."""
    found = docs.select("doc_id", F.coalesce(sequence(F.col("text")), F.array().cast("array<string>")).alias("ids"))
    flow = F.concat(F.lit("|"), F.array_join("ids", "||"), F.lit("|"))
    hits = [F.when(flow.rlike(".*".join(rf"\|{s}\|" for s in rule)), F.lit(name)) for name, rule, _ in RULES]
    gone = F.flatten(F.array(*[F.when(h.isNotNull(), F.array(*[F.lit(x) for x in takes])).otherwise(F.array().cast("array<string>"))
                               for h, (_, _, takes) in zip(hits, RULES) if takes]))
    named = F.array_sort(F.array_distinct(F.array_except(F.filter(F.array(*hits), lambda x: x.isNotNull()), gone)))
    named = F.when(F.size(named) > 1, F.array_remove(named, LAST)).otherwise(named)
    out = found.withColumn("_names", F.when(F.size("ids") > 0, named).otherwise(F.array().cast("array<string>")))
    kind = F.lit("none")
    for name in reversed(KINDS):
        kind = F.when(F.arrays_overlap("_names", F.array(*[F.lit(x) for x in KINDS[name]])), name).otherwise(kind)
    return out.select("doc_id", F.array_join("ids", ",").alias("sentences"), F.array_join("_names", ",").alias("licences"),
                      kind.alias("kind"))


def oracle() -> str:
    """The same in SQL: sentences and lines as rows, looked up by a join, rules by regular expressions."""
    known = ", ".join(f"('{words}', '{name}')" for name, words in SENTENCES.items())
    rules = ", ".join(f"({i}, '{name}', '{'.*'.join(chr(92) + '|' + s + chr(92) + '|' for s in rule)}')" for i, (name, rule, _) in enumerate(RULES))
    takes = ", ".join(f"({i}, '{x}')" for i, (_, _, t) in enumerate(RULES) for x in t)
    kinds = "".join(f" WHEN list_has_any(names, {list(v)!r}) THEN '{k}'" for k, v in KINDS.items())
    cut = "chr(1)"
    return f"""
WITH known(words, name) AS (VALUES {known}), rules(i, licence, shape) AS (VALUES {rules}), takes(i, licence) AS (VALUES {takes}),
d AS (SELECT row_number() OVER () AS row, doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT row, unnest(x) AS s, generate_subscripts(x, 1) AS pos FROM (SELECT row,
      string_split(regexp_replace(text, '{ENDS}', chr(92) || '1' || {cut}, 'g'), {cut}) AS x FROM d)),
u AS (SELECT row, pos, 0 AS part, s AS unit FROM s UNION ALL
      SELECT row, pos, part, unit FROM (SELECT row, pos, s, unnest(string_split(s, chr(10))) AS unit,
             generate_subscripts(string_split(s, chr(10)), 1) AS part FROM s WHERE contains(s, chr(10)))),
k AS (SELECT row, pos, min(part) AS part, name FROM (SELECT row, pos, part, name, unit FROM u JOIN known
      ON trim(regexp_replace(translate(unit, '{UPPER}', '{LOWER}'), '[^a-z0-9]+', ' ', 'g')) = words) GROUP BY row, pos, unit, name),
f AS (SELECT row, string_agg(name, ',' ORDER BY pos, part) AS sentences, '|' || string_agg(name, '||' ORDER BY pos, part) || '|' AS flow
      FROM k GROUP BY row),
h AS (SELECT DISTINCT row, i, licence FROM f JOIN rules ON regexp_matches(flow, shape)),
l AS (SELECT row, CASE WHEN len(names) > 1 THEN list_filter(names, lambda x: x <> '{LAST}') ELSE names END AS names FROM (
      SELECT row, list_sort(list(DISTINCT licence)) AS names FROM h WHERE NOT EXISTS
      (SELECT 1 FROM takes JOIN h g ON g.i = takes.i WHERE g.row = h.row AND takes.licence = h.licence) GROUP BY row))
SELECT doc_id, coalesce(sentences, '') AS sentences, coalesce(array_to_string(names, ','), '') AS licences,
       CASE WHEN names IS NULL THEN 'none'{kinds} ELSE 'none' END AS kind
FROM d LEFT JOIN f USING (row) LEFT JOIN l USING (row)
"""
