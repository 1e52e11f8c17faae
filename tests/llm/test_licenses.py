from eventlens.llm import licenses as L
from tests.llm.helpers import awkward, frame

MIT, APACHE, GPL = "Released under the MIT License.", "Licensed under the Apache License, Version 2.0.", "This work is licensed under the GNU General Public License, version 3."


def scan(spark, rows):
    df = spark.createDataFrame(rows, "path string, text string").withColumn("license", L.F.lit("x")).withColumn("_row", L.F.lit(1))
    out = L.scan_licenses(df)
    return {r["path"]: (r["header_license"], r["inherited_license"], r["inherited_from"], r["license"]) for r in out.collect()}


def test_nearest_license_file(spark):
    got = scan(spark, [
        ("LICENSE", MIT), ("a/LICENSE", "some words\n" + APACHE), ("a/b/COPYING", "no notice here"), ("a/b/c.txt", "code"),
        ("a/b/d/e.txt", GPL.upper()), ("a/b/d/f.txt", None), ("x/y.txt", ""), ("z.txt", "the license"), ("a/b/d/LICENSE.txt", GPL),
        ("a/b/d/LICENSE.md", MIT + "\n" + GPL), ("q/LICENSE", None), ("q/r.txt", "r"),
    ])
    assert got["a/b/c.txt"] == (None, "Apache-2.0", "a", "Apache-2.0")
    assert got["a/b/d/e.txt"] == ("GPL-3.0", None, None, "GPL-3.0")
    assert got["a/b/d/f.txt"] == (None, "GPL-3.0", "a/b/d", "GPL-3.0")
    assert got["x/y.txt"] == got["z.txt"] == got["q/r.txt"] == (None, "MIT", "", "MIT")
    assert got["a/b/COPYING"][1] == "Apache-2.0"


def test_no_license_anywhere_and_awkward_rows(spark):
    docs = frame(spark, awkward(), line="1", token="'t'", best="2").withColumn("path", L.document_path())
    rows = L.scan_licenses(docs).collect()
    assert len(rows) == len(awkward()) and not any(r["license"] for r in rows)
    assert L.scan_licenses(docs.limit(0)).count() == 0
    hot = spark.createDataFrame([("LICENSE", MIT)] + [(f"d/{i}", MIT if i % 3 == 0 else "z") for i in range(300)] + [("d/1", "z"), (None, MIT), (None, "z")], "path string, text string")
    rows = L.scan_licenses(hot).collect()
    assert len(rows) == 304 and all(r["license"] == "MIT" for r in rows if r["path"]) and sum(r["header_license"] is None for r in rows) == 202


def test_needed_tokens_lose_no_match():
    w = L._Weights(L.TEMPLATES, 0.6)
    for number in range(len(L.TEMPLATES)):
        own = [(t, x) for n, _, t, x in w.rows if n == number]
        assert sum(x * x for t, x in own if t not in w.needed) ** 0.5 < 0.6


def test_wrapped_notices_and_titles(spark):
    isc = "Permission to use, copy, modify,\nand distribute this software\nfor any purpose with or without\nfee is hereby granted."
    gpl = "This program is licensed\nunder the GNU General Public\nLicense, version 2."
    comment = lambda text: "".join(f" * {x}\n" for x in text.split("\n"))
    long = "lorem ipsum dolor sit amet " * 400
    got = scan(spark, [
        ("a/x.c", isc), ("b/x.c", f"{long}\n\n{gpl}\n \t\n{long}"), ("c/x.c", f"/*\n * Copyright 2020 Nobody\n *\n{comment(gpl)} *\n * {long}\n */\n{long}"),
        ("d/x.c", f"head\r\n\r\n{isc}\r\n\r\n{long}"), ("e/LICENSE", f"  GNU GENERAL PUBLIC LICENSE\n  Version 2, June 1991\n\n{long}"), ("e/x.c", long),
        ("f/LICENSE", f"GNU GENERAL PUBLIC LICENSE\nVersion 3, 29 June 2007\n\n{long}"), ("g/LICENSE", f"Mozilla Public License\nVersion 2.0\n\n{long}"),
        ("h/LICENSE", isc.replace("\n", "\n\n")), ("i/x.c", "GNU\n" + long + "\nPublic License"),
    ])
    want = ["ISC", "GPL-2.0", "GPL-2.0", "ISC", "GPL-2.0", "GPL-2.0", "GPL-3.0", "MPL-2.0", "ISC", None]
    assert [got[p][3] for p in ("a/x.c", "b/x.c", "c/x.c", "d/x.c", "e/LICENSE", "e/x.c", "f/LICENSE", "g/LICENSE", "h/LICENSE", "i/x.c")] == want


def test_common_notices(spark):
    gpl = "This program is free software%s you can redistribute it and/or modify\nit under the terms of the GNU General Public License as published by\nthe Free Software Foundation%s either version %s of the License, or\n(at your option) any later version."
    lgpl = gpl.replace("program", "library").replace("General", "Lesser General")
    got = scan(spark, [
        ("a", gpl % (":", ",", "3")), ("b", gpl % (";", ";", "2")), ("c", lgpl % (";", ";", "2.1")), ("d", "// SPDX-License-Identifier: MIT\ncode"),
        ("e", "ISC License\n\nCopyright (c) 2020"), ("f", "# Licensed under the Apache License, Version 2.0 (the \"License\");"), ("g", "The MIT License (MIT)"),
        ("h", "Licensed under the BSD 2-Clause License."), ("i", "SPDX-License-Identifier: BSD-3-Clause"), ("j", "SPDX-License-Identifier: Zlib"), ("k", "mit"),
        ("l", "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."),
        ("m", "\n".join("/* " + x for x in (gpl % (":", ",", "3")).split("\n")) + "\n\n" + "lorem the of and to in a is " * 300),
    ])
    want = ["GPL-3.0", "GPL-2.0", "LGPL-2.1", "MIT", "ISC", "Apache-2.0", "MIT", "BSD-2-Clause", "BSD-3-Clause", None, None, "MPL-2.0", "GPL-3.0"]
    assert [got[p][0] for p in "abcdefghijklm"] == want


def test_no_test_drops_a_match(spark):
    """Notices among other words, by brute force over all units."""
    import math
    import random
    import re
    from collections import Counter

    rng = random.Random(11)
    w = L._Weights(L.TEMPLATES, L.THRESHOLD, L.TITLES)
    pool = [text for _, text in (*L.TEMPLATES, *L.TITLES)]
    filler = "the of and lorem ipsum dolor any copy sit with or amet version software license 2 0".split()
    texts = []
    for _ in range(250):
        words = rng.choice(pool).split()
        for _ in range(rng.randrange(0, 14)):
            words.insert(rng.randrange(len(words) + 1), rng.choice(filler))
        words = [x for x in words if rng.random() > 0.15]
        texts.append("".join(x + rng.choice([" ", " ", " ", "\n", "\n\n", "\n--\n"]) for x in words))

    def best(text):
        found = []
        for unit in {*text.split("\n"), *re.split(r"\n\s*\n", text), *re.split(r"\n[^A-Za-z0-9]*\n", text), text}:
            n = Counter(t for t in re.findall("[a-z0-9]+", unit.lower()) if t not in L.COMMON_WORDS)
            norm = math.sqrt(sum((c * w.idf.get(t, w.unknown)) ** 2 for t, c in n.items())) or 1.0
            for number in {r[0] for r in w.rows}:
                own = [r for r in w.rows if r[0] == number and n[r[2]]]
                if len(own) > 1 and (number < len(L.TEMPLATES) or "\n" in unit):
                    found.append((-round(sum(n[t] * w.idf[t] * x for _, _, t, x in own) / norm, 6), own[0][1]))
        return min([f for f in found if f[0] <= -L.THRESHOLD], default=None)

    want = {t: best(t) for t in texts}
    got = {r["text_hash"]: (-r["score"], r["license"]) for r in L.notices(spark.createDataFrame([(t,) for t in texts], "text string")).collect()}
    hashes = {r["text"]: r["h"] for r in spark.createDataFrame([(t,) for t in want], "text string").selectExpr("text", "xxhash64(text) AS h").collect()}
    assert sum(v is not None for v in want.values()) > 60
    for t, v in want.items():
        assert (hashes[t] in got) == (v is not None)
        assert v is None or (abs(got[hashes[t]][0] - v[0]) < 2e-6 and (got[hashes[t]][1] == v[1] or abs(got[hashes[t]][0] - v[0]) > 0))
