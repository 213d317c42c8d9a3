"""Per-document operators against plain versions: secrets, quality rules, licences, toxicity."""

import hashlib
import math
import random
import re
import time

import duckdb
import pytest

from slatewise.llm import licenses, quality_rules, secret_scan, toxicity

ordered = lambda x: sorted((tuple(r) for r in (x.collect() if hasattr(x, "collect") else x)), key=repr)
BLANK = r"[^\x20\x09-\x0D]+"

SECRETS = [
    (1, 'token=ab secret: "abcdefgh"'), (2, "PASSWORD = hunter2hunter2 passwd:x"), (3, "AKIA" + "A" * 16 + " AKIAB"),
    (4, "deadbeef" * 3 + " " + "0123456789abcdef" * 2), (5, "token = \"" + "0a" * 20 + "\""), (6, None), (7, ""),
    (8, "é token=ééé api_key='abc.def-ghi' apikey:\"AKIA" + "Z" * 20), (9, "secret=token=password=abcdefghij"), (9, "secret=token=password=abcdefghij"),
    (10, "ſecret=abcdefgh toKen=abcdefgh"),
]


def plain_base(text):
    text = text or ""
    out = [("assign", m.start(), m.end()) for m in re.finditer(
        r"""([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        text) if len(m[2]) >= 6]
    out += [("access", m.start(), m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 20]
    out += [("hex", m.start(), m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 24]
    return sorted(out, key=lambda s: (s[1], ("assign", "access", "hex").index(s[0])))


def test_secret_base(spark, docs, no_docs):
    frame = spark.createDataFrame(SECRETS, "doc_id long, text string")
    for given in (frame, docs):
        found = secret_scan.digest(secret_scan.scan(given)).select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")
        want = []
        for doc_id, text in given.select("doc_id", "text").collect():
            spans = plain_base(text)
            count = [sum(s[0] == k for s in spans) for k in ("assign", "access", "hex")]
            want.append((doc_id, *count, hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in spans).encode()).hexdigest()))
        assert ordered(found) == ordered(want)
    assert secret_scan.digest(secret_scan.scan(no_docs)).count() == 0


@pytest.mark.parametrize("text, want", [
    ('x = "Zk39fjQ0aLw8Tq2v"\ndb_pwd = x\n', [(5, 21)]),
    ('a = "Zk39fjQ0"\nb = a\nauthToken: b + "aLw8Tq2v"', [(5, 13), (37, 45)]),
    ('{"client-credentials": "Zk39fjQ0aLw8Tq2v", "b": 3}', [(24, 40)]),
    ("export DB_PWD=Zk39fjQ0aLw8Tq2v\nfoo", [(14, 30)]),
    ("<dbPwd>Zk39fjQ0aLw8Tq2v</dbPwd>", [(7, 23)]),
    ('privateKey => `Zk39fjQ0aLw8Tq2v`;', [(15, 31)]),
    ('pwd = "your_password_here"', []), ("pass: the end is near", []), ("key: value", []), ('pwd = "${DB_PWD_VALUE1}"', []),
])
def test_named_literals(text, want):
    assert secret_scan.named_literals(text) == want


def test_long_runs_of_signs_stay_linear():
    assert secret_scan.named_literals("pwd " + "a=" * 100_000 + " x") == []


def plain_literals(text):
    """The named literals by lists of spans that are copied and joined at every step."""
    token = re.compile(r"""(?P<text>"(?:[^"\\\n]|\\.)*"|'(?:[^'\\\n]|\\.)*'|`(?:[^`\\\n]|\\.)*`)|<(?P<tag>[A-Za-z_][\w.-]*)>(?P<inner>[^<>\n]*)</(?P=tag)>"""
                       r"""|(?P<name>[^\W\d][\w.-]*)|(?P<set>:=|=>|==|!=|<=|>=|=|:)|(?P<plus>\+)|(?P<end>[\n;,(){}\[\]])|(?P<gap>[^\S\n]+)|(?P<odd>.)""")
    bare_value = re.compile(r"[^\S\n]*([A-Za-z0-9+/_.=@!#%^&*~-]+)[^\S\n]*(?:\n|$|#|;)")
    found, held, target, spans, mode, last, at = [], {}, None, [], "", None, 0
    while at < len(text):
        m = token.match(text, at)
        kind, at = m.lastgroup, m.end()
        if m["tag"] is not None:
            found.append((m["tag"], [m.span("inner")]))
        elif kind == "end" or (kind == "set" and m[0] in ("=", ":=", ":", "=>") and last is not None):
            if target is not None and spans:
                held[target] = list(spans)
                found.append((target, list(spans)))
            target, spans, mode = (None, [], "") if kind == "end" else (last, [], "value")
            bare = bare_value.match(text, at) if kind == "set" else None
            whole = bare and re.match(r"[A-Za-z0-9+/_.=@!#%^&*~-]+", text[bare.start(1):])[0]
            if bare and whole == bare[1] and bare[1] not in held:
                spans, mode, at = [bare.span(1)], "done", bare.end(1)
            last = None
        elif kind == "plus":
            mode = "value" if target is not None else mode
        elif kind == "text":
            if target is not None and mode == "value":
                spans.append((m.start() + 1, m.end() - 1))
            last = m[0][1:-1]
        elif kind == "name":
            spans += held.get(m[0], []) if target is not None and mode == "value" else []
            last = m[0]
        elif kind != "gap":
            last = None
    if target is not None and spans:
        found.append((target, spans))
    out = set()
    for name, spans in found:
        value = "".join(text[a:b] for a, b in spans)
        weight, low = secret_scan.sensitivity(name), value.lower()
        harmless = (low in secret_scan.HARMLESS_WHOLE or low.startswith(secret_scan.HARMLESS_STARTS) or len(set(low)) == 1
                    or any(w in low for w in secret_scan.HARMLESS_INSIDE))
        if weight and len(value) >= 8 and not re.search(r"\s", value) and not harmless:
            bits = -sum(value.count(c) / len(value) * math.log2(value.count(c) / len(value)) for c in set(value))
            strength = min(1.0, bits / 4) * (0.4 + 0.2 * sum(bool(re.search(k, value)) for k in ("[a-z]", "[A-Z]", "[0-9]", "[^A-Za-z0-9]")))
            if weight + strength >= 1.5 and strength >= 0.5:
                out.update(s for s in spans if s[0] < s[1])
    low = text.lower()
    return sorted(out) if any(s in low for s in secret_scan._STEMS) and any(c in text for c in "=:>") else []


def test_named_literals_by_a_plain_lexer():
    rng = random.Random(3)
    bits = ["token", "pwd", "a", "b", "apiKey", "=", " = ", ":", '"', "'", "`", "+", " + ", "\n", ",", "{", "}", "\\", '\\"', "Zk39fjQ0aLw8Tq2v", "example", "your_",
            "<dbPwd>", "</dbPwd>", "xxxxxxxx", "aAaAaAaA", '"Qw8!zzT1"', "(", ";", "=>", "é", "password", "placeh", "older", "process.", "12345678", "\t", "#"]
    texts = ["".join(rng.choice(bits) for _ in range(rng.randint(1, 40))) for _ in range(4000)]
    found = [secret_scan.named_literals(t) for t in texts]
    assert found == [plain_literals(t) for t in texts] and sum(map(bool, found)) > 100


MB = 1_000_000


@pytest.mark.parametrize("text, literals", [
    ('private_key = "' + "".join(random.Random(1).choices("abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789", k=MB)) + '"', 1),
    ("{" + ",".join(rf'\"api_key\":\"v{i}\"' for i in range(MB // 20)) + "}", 0),
    ('token = token + "abc"\n' * (MB // 22), 0),
    ('a = "v"\n' + "a = a + a\n" * (MB // 10) + "token = a\n", 0),
    ('a = "Zk39fjQ0aLw8"\n' + "a = a + a\n" * 200 + 'pwd = a + "Tq2v!"\n', 2),
    ('"' * MB, 0),
])
def test_long_texts_stay_linear(text, literals):
    """Milliseconds a kilobyte; a second a kilobyte before."""
    start = time.process_time()
    assert len([s for s in secret_scan.spans_of(text) if s[0] == "literal"]) == literals
    assert time.process_time() - start < 8


def test_redaction_keeps_rows_and_columns(docs, no_docs):
    found = secret_scan.redact(docs)
    assert found.columns == docs.columns and found.count() == docs.count()
    assert secret_scan.cut_out('token = "abcdefgh" ok') == 'token = "[assign]" ok'
    assert secret_scan.redact(no_docs).count() == 0


def plain_measures(text):
    text = text or ""
    words = re.findall(BLANK, text)
    lines = [x for x in text.split("\n") if re.search(BLANK, x)]
    windows = [tuple(words[i:i + 5]) for i in range(len(words) - 4)]
    covered = {i + k for i, w in enumerate(windows) if windows.count(w) > 1 for k in range(5)}
    return (len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), sum(x in lines[:i] for i, x in enumerate(lines)), len(covered))


def test_quality_ledger(spark, docs, no_docs):
    small = docs.where("text IS NULL OR length(text) < 6000")
    found = quality_rules.apply_policy(quality_rules.ledger(small))
    want = []
    for doc_id, text in small.select("doc_id", "text").collect():
        m = plain_measures(text)
        want.append((doc_id, *m, m[0] < 10 or 100 * m[4] > 20 * m[0]))
    assert ordered(found.select("doc_id", *quality_rules.MEASURES[:5], "base_failed")) == ordered(want)
    assert found.where("base_failed AND kept").count() == 0
    assert quality_rules.ledger(no_docs).count() == 0


def test_ablations_count_what_each_rule_costs(docs):
    entries = quality_rules.ledger(docs).cache()
    rules = quality_rules.POLICIES["v2"]
    masks = [r.failed for r in entries.select("failed").collect()]
    for r in quality_rules.ablations(entries).collect():
        bit, every = quality_rules.bits([r.rule]), quality_rules.bits(rules)
        assert r.failing == sum(bool(m & bit) for m in masks)
        assert r.kept_without == sum(not m & every & ~bit for m in masks)
        assert r.failing_alone == sum(m & every == bit for m in masks)


def test_verdicts_of_all_versions(docs, no_docs):
    entries = quality_rules.ledger(docs).cache()
    found = quality_rules.verdicts(entries).collect()
    every = quality_rules.bits(quality_rules.RULES)
    alone = {r.rule: r.failing_alone for r in quality_rules.ablations(entries).collect()}
    assert len(found) == entries.count() and any(r.sole_rule for r in found)
    for r in found:
        for name, rules in quality_rules.POLICIES.items():
            assert r[f"kept_{name}"] == (not r.failed & quality_rules.bits((*quality_rules.BASE, *rules)))
        assert r.kept == r.kept_v2
        assert r.sole_rule == next((x for x in quality_rules.RULES if r.failed & every == quality_rules.bits([x])), None)
        assert r.sole_rule_documents == alone.get(r.sole_rule)
    assert quality_rules.verdicts(quality_rules.ledger(no_docs)).count() == 0


LICENCES = [
    (1, "Intro text.\nReleased under the MIT License.\nMore."), (2, "# Licensed under the Apache License, Version 2.0.\ncode"), (3, None), (4, ""),
    (5, "Permission is hereby granted"), (6, "no end of line\nLicensed under CC BY-NC 4.0.\nEnd"), (6, "no end of line\nLicensed under CC BY-NC 4.0.\nEnd"),
    (7, "Redistribution and use in source and binary forms, with or without\n * modification, are permitted provided that the following conditions\n"
        " * are met: x. Released under the BSD license. This work is licensed under the GNU General Public License, version 3."),
    (8, "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.\n\n"
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met."),
    (9, "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
        "published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
]


def test_licences_match_sql(spark, docs, no_docs):
    frame = spark.createDataFrame(LICENCES, "doc_id long, text string")
    for given in (frame, docs, no_docs):
        documents = given.select("doc_id", "text").toPandas()  # noqa: F841  (read by DuckDB)
        con = duckdb.connect()
        con.register("documents", documents.astype({"doc_id": "Int64"}))
        assert ordered(licenses.scan(given)) == ordered(con.execute(licenses.oracle()).fetchall())
    kinds = {r.doc_id: r.licences for r in licenses.scan(frame).collect()}
    assert kinds[1] == "MIT" and kinds[2] == "Apache-2.0" and kinds[6] == "CC-BY-NC-4.0" and kinds[8] == "" and kinds[9] == "AGPL-3.0"


MIT = """{title}

Copyright (c) 2024 A Name

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY.
"""
BSD2 = """Copyright (c) 2024, A Name

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

{0} Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

{1} Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.

"""
BSD3 = BSD2 + """{2} Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.

"""
ISC = """{title}

Copyright (c) 2024, A Name

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""
APACHE = """Copyright 2024 A Name

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
"""


def licences_as_in_sql(spark, rows):
    """The licences by number, after comparison with the SQL."""
    frame = spark.createDataFrame(rows, "doc_id long, text string")
    documents = frame.toPandas()  # noqa: F841  (read by DuckDB)
    con = duckdb.connect()
    con.register("documents", documents)
    found = licenses.scan(frame)
    assert ordered(found) == ordered(con.execute(licenses.oracle()).fetchall())
    return {r.doc_id: r.licences for r in found.collect()}


def test_whole_licence_texts(spark):
    signs = ["1. 2. 3.", "(1) (2) (3)", "1) 2) 3)", "a. b. c.", "(i) (ii) (iii)", "* * *", "- - -", "o o o"]
    whole = [("MIT", MIT.format(title=x)) for x in ("MIT License", "The MIT License (MIT)", "")]
    whole += [("ISC", ISC.format(title=x)) for x in ("ISC License", "")] + [("Apache-2.0", APACHE)]
    whole += [(name, text.format(*x.split())) for name, text in (("BSD-2-Clause", BSD2), ("BSD-3-Clause", BSD3)) for x in signs]
    forms = [lambda x: x, lambda x: x.replace("\n\n", "\n"), lambda x: x.replace("met:\n\n", "met:\n"), lambda x: x.replace("\n", "\r\n"),
             lambda x: "".join(f" * {line}\n" for line in x.splitlines())]
    rows = [(name, form(text)) for name, text in whole for form in forms]
    found = licences_as_in_sql(spark, [(i, text) for i, (_, text) in enumerate(rows)])
    assert [(i, name, found[i], rows[i][1][:60]) for i, (name, _) in enumerate(rows) if found[i] != name] == []


def test_padding_does_not_hide_licences(spark):
    grant = MIT.format(title="").split("\n\n")[2] + "\n" + MIT.format(title="").split("\n\n")[3]
    box = "/" + "*" * 200 + "\n" + "".join(f"* {line:<196} *\n" for line in grant.splitlines()) + "*" * 200 + "/\n"
    rows = [(1, "Released under the MIT License" + " " * 1200 + ".\nMore."), (2, box), (3, "=" * 3000 + " All rights reserved " + "=" * 3000)]
    assert licences_as_in_sql(spark, rows) == {1: "MIT", 2: "MIT", 3: "proprietary"}


GPL_HEAD = """                    GNU {0}GENERAL PUBLIC LICENSE
                       Version {1}

 Copyright (C) {2} Free Software Foundation, Inc. <https://fsf.org/>
 Everyone is permitted to copy and distribute verbatim copies
 of this license document, but changing it is not allowed.

                            Preamble

  The {0}General Public License is a free, copyleft license for software.
"""


def test_heads_tags_and_reserved_rights(spark):
    bsd = BSD3.format("1.", "2.", "3.").replace("A Name\n", "A Name\nAll rights reserved.\n")
    rows = [("BSD-3-Clause", bsd), ("BSD-2-Clause", BSD2.format("*", "*", "*").replace("A Name\n", "A Name. All rights reserved.\n")),
            ("proprietary", "Copyright 2020 A Name. All rights reserved."), ("GPL-3.0", GPL_HEAD.format("", "3, 29 June 2007", "2007")),
            ("GPL-2.0", GPL_HEAD.format("", "2, June 1991", "1989, 1991")), ("AGPL-3.0", GPL_HEAD.format("AFFERO ", "3, 19 November 2007", "2007")),
            ("LGPL-3.0", GPL_HEAD.format("LESSER ", "3, 29 June 2007", "2007")), ("LGPL-2.1", GPL_HEAD.format("LESSER ", "2.1, February 1999", "1991, 1999")),
            ("LGPL-2.1", "This library is free software; you can redistribute it and/or\n modify it under the terms of the GNU Lesser General Public\n License as published "
             "by the Free Software Foundation; either\n version 2.1 of the License, or (at your option) any later version.\n"),
            ("GPL-2.0", "This program is free software; you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\n"
             "the Free Software Foundation; either version 2 of the License, or\n(at your option) any later version.\n"),
            ("MPL-2.0", "Mozilla Public License Version 2.0\n==================================\n\n1. Definitions\n"),
            ("MPL-2.0", "// This Source Code Form is subject to the terms of the Mozilla Public\n// License, v. 2.0. If a copy of the MPL was not distributed"),
            ("Apache-2.0", "                                 Apache License\n                           Version 2.0, January 2004\n"
             "                        http://www.apache.org/licenses/\n\n   TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION\n"),
            ("EPL-2.0", "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM"), ("BSL-1.0", "Boost Software License - Version 1.0 - August 17th, 2003\n\nPermission"),
            ("Zlib", "This software is provided 'as-is', without any express or implied\nwarranty. In no event will the authors be held liable.\n\nPermission is granted to anyone "
             "to use this software for any purpose,\nincluding commercial applications, and to alter it and redistribute it\nfreely, subject to the following restrictions:\n\n1. The origin"),
            ("Apache-2.0", "# SPDX-License-Identifier: Apache-2.0\nimport os\n"), ("GPL-2.0", "/* SPDX-License-Identifier: GPL-2.0-only */\n"),
            ("LGPL-2.1", "x\n// SPDX-License-Identifier: LGPL-2.1-or-later\ny"), ("Apache-2.0,MIT", "// SPDX-License-Identifier: MIT OR Apache-2.0\n"),
            ("", "SPDX-License-Identifier: Unknown-1.0"), ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0.\n")]
    found = licences_as_in_sql(spark, [(i, text) for i, (_, text) in enumerate(rows)])
    assert [(i, name, found[i]) for i, (name, _) in enumerate(rows) if found[i] != name] == []


def test_folding_keeps_positions():
    text = "Ａ 1d10t mоrоn ÍDIÓT ﬀ 😀\ud83d"
    assert len(toxicity.fold(text)) == len(text)
    assert toxicity.fold("1D10T mоrоn ｃｌｏｗｎ ídiót") == "idiot moron clown idiot"


def test_matcher_spares_exception_phrases_and_parts_of_words():
    match = toxicity.Matcher({"clown": 2.0, "idiot": 3.0}, ["clown fish"])
    assert match.spans("A clown fish, a cl0wn, idiotic 1d10t") == [(16, 21, 2.0), (31, 36, 3.0)]
    assert toxicity.Matcher({}).spans("idiot") == []


def labelled(spark):
    rows, marks = [], []
    for i in range(400):
        bad = i % 4 == 0
        words = f"plain text number {i} goes on with people and then w{i % 7} ends".split()
        if bad:
            words.insert(i // 4 % 9, "moron")
            words.insert(i // 4 % 7, "idiot")
        rows.append((i, " ".join(words)))
        marks.append((i, 1, int(bad)))
    return spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame(marks, "doc_id long, quality int, toxic int")


def test_toxicity_held_out(spark, docs, no_docs):
    import zlib
    frame, marks = labelled(spark)
    model = toxicity.learn(frame, marks)
    assert {"moron", "idiot"} <= set(model["weights"])
    for r in toxicity.score(frame, model).collect():
        assert r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 5 == 0)
        assert r.predicted == int(r.doc_id % 4 == 0) == int(r.score >= 0.5)
    held = marks.where("doc_id % 4 <> 0").unionByName(marks.where("doc_id = 0"))
    assert toxicity.learn(frame, held.limit(0))["weights"] == {}
    found = toxicity.score(docs, model)
    assert found.count() == docs.count() and found.where("score < 0 OR score > 1 OR held_out IS NULL").count() == 0
    assert toxicity.reject(docs, model).columns == docs.columns and toxicity.score(no_docs, model).count() == 0
    assert toxicity.learn(no_docs, marks)["weights"] == {}
