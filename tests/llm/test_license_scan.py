from lorekeep.llm import license_scan as L


def test_own_and_inherited(spark):
    rows = [
        ("r/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
        ("r/a/x.py", "code\nLicensed under the Apache License, Version 2.0. More text here."),
        ("r/a/y.py", "nothing at all"), ("r/b/c/z.py", None), ("r/b/COPYING", "This work is licensed under the GNU General Public License, version 3."),
        ("r/b/c/d/e.py", "a licence is mentioned, yet none of those known to us here"), ("s/q.py", ""), ("top.py", "text"), (None, "Released under the MIT License."), ("s/q.py", ""),
    ]
    got = {r.path: (r.licence, r.licence_from) for r in L.licences(spark.createDataFrame([(*r, "x") for r in rows], "path string, text string, score string")).collect()}
    assert got == {
        "r/LICENSE": ("MIT", "r/LICENSE"), "r/a/x.py": ("Apache-2.0", "r/a/x.py"), "r/a/y.py": ("MIT", "r/LICENSE"), "r/b/c/z.py": ("GPL-3.0", "r/b/COPYING"),
        "r/b/COPYING": ("GPL-3.0", "r/b/COPYING"), "r/b/c/d/e.py": ("GPL-3.0", "r/b/COPYING"), "s/q.py": (None, None), "top.py": (None, None),
    }
    assert L.licences(spark.createDataFrame([], "path string, text string")).count() == 0


def test_versions_are_told_apart(spark):
    rows = [("2", "This work is licensed under the GNU General Public License, version 2."), ("3", "This work is licensed under the GNU General Public License, version 3."), ("nc", "Licensed under CC BY-NC 4.0."), ("by", "Licensed under CC BY 4.0.")]
    got = {r.path: r.licence for r in L.own_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"2": "GPL-2.0", "3": "GPL-3.0", "nc": "CC-BY-NC-4.0", "by": "CC-BY-4.0"}


def test_whole_texts_and_wrapped_headers(spark):
    import textwrap

    texts = dict(L.TEXTS)

    def wrapped(name, mark=""):
        return "\n".join(mark + x for x in textwrap.wrap(texts[name], 66))

    gpl = "This program is free software: you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation, either version {} of the License, or\n(at your option) any later version.\n\nThis program is distributed in the hope that it will be useful."
    head = "                    GNU {}\n                       Version {}\n\n Copyright (C) Free Software Foundation, Inc.\n Everyone is permitted to copy and distribute verbatim copies\n of this license document, but changing it is not allowed.\n\n                            Preamble\n"
    rows = {
        "GPL-2.0": head.format("GENERAL PUBLIC LICENSE", "2, June 1991"), "GPL-3.0": head.format("GENERAL PUBLIC LICENSE", "3, 29 June 2007"), "LGPL-2.1": head.format("LESSER GENERAL PUBLIC LICENSE", "2.1, February 1999"),
        "GPL-2.0 h": "/*\n" + "\n".join(" * " + x for x in gpl.format("General Public License", 2).split("\n")) + "\n */\n\nint x;", "GPL-3.0 h": "\n".join("# " + x for x in gpl.format("General Public License", 3).split("\n")) + "\n\nx = 1",
        "LGPL-3.0 h": gpl.format("Lesser General Public License", 3), "BSD-2-Clause": "Copyright (c) 2020, A\n\n" + wrapped("BSD-2-Clause"), "BSD-3-Clause": "Copyright (c) 2020, A\n\n" + wrapped("BSD-3-Clause"), "BSD-2-Clause h": "# Copyright A\n#\n" + wrapped("BSD-2-Clause", "# ") + "\n\nimport x",
        "ISC": "Copyright (c) 2020 A\n\n" + wrapped("ISC"), "MIT": "MIT License\n\nCopyright (c) 2020 A\n\n" + wrapped("MIT"), "EPL-2.0": "Eclipse Public License - v 2.0\n\nTHE ACCOMPANYING PROGRAM IS PROVIDED UNDER THE TERMS OF THIS AGREEMENT", "CC-BY-SA-4.0": "Attribution-ShareAlike 4.0 International\n\n=====\n\nmore",
    }
    got = {r.path: r.licence for r in L.own_licences(spark.createDataFrame(list(rows.items()), "path string, text string")).collect()}
    assert got == {k: k.split()[0] for k in rows}


def test_dropped_units_could_not_match():
    import random

    import numpy as np

    r, units = random.Random(5), L.Units(0.75)
    terms = sorted(units.number) + [f"other{i}" for i in range(400)]
    texts = [" ".join(r.choice(terms) for _ in range(r.randint(1, 40))) for _ in range(300)] + [" ".join(r.sample(t.split(), max(1, len(t.split()) * 2 // 3)) + r.choices(terms, k=r.randint(0, 9))) for _, t in L.TEMPLATES + L.TEXTS]
    for df in (np.zeros(len(units.number), int), np.array([r.randint(0, 5000) for _ in units.number])):
        s = L.Scorer(units, 5000, df)
        for t in texts:
            words = L._TERMS.findall(t.translate(L._FOLD))
            known = {w: words.count(w) for w in words if w in units.number}
            unknown = sum(words.count(w) ** 2 for w in set(words) - set(known))
            every = s.best([units.number[w] for w in known], list(known.values()), unknown) if known else None
            v = units.vector(*units.split(words))
            share = (s.templates[:, [units.number[w] for w in known]] @ (np.array(list(known.values())) * s.idf[[units.number[w] for w in known]])).max(initial=0)
            norm = np.sqrt(sum((n * s.idf[units.number[w]]) ** 2 for w, n in known.items()) + unknown * s.unknown**2)
            assert (s.best(*v) if v else None) == every and (every is None) == (round(share / norm, 9) < 0.75)


def test_odd_rows(spark, odd, none):
    named = odd.selectExpr("concat('p/', doc_id) as path", "text", "score", "'x' as licence")
    got = L.licences(named).collect()
    assert {r.path for r in got} == {f"p/{i}" for i in range(1, 10)} and all(r.licence is None for r in got)
    long = "words without end " * 50_000 + "\nReleased under the MIT License.\n" + "more of it. " * 50_000
    ties = [("a", "Licensed under CC BY 4.0"), ("a", "Licensed under CC BY 4.0"), ("b", long), ("c", "SPDX-License-Identifier: MIT\nSPDX-License-Identifier: ISC")]
    assert {r.path: (r.licence, r.score) for r in L.own_licences(spark.createDataFrame(ties, "path string, text string")).collect()} == {"a": ("CC-BY-4.0", 1.0), "b": ("MIT", 1.0), "c": ("ISC", 1.0)}


def test_known_headers(spark):
    apache = 'Copyright 2020 A\n\nLicensed under the Apache License, Version 2.0 (the "License");\nyou may not use this file except in compliance with the License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n\nUnless required by applicable law, do not.'
    mpl = "This Source Code Form is subject to the terms of the Mozilla Public\nLicense, v. 2.0. If a copy of the MPL was not distributed with this\nfile, You can obtain one at https://mozilla.org/MPL/2.0/."
    rows = {"Apache-2.0": "/*\n * " + apache.replace("\n", "\n * ") + "\n */\nint x;", "MPL-2.0": "// " + mpl.replace("\n", "\n// ") + "\ncode", "Apache-2.0 p": "# " + apache.replace("\n", "\r\n# ") + "\r\n\r\nimport os"}
    assert {r.path: r.licence for r in L.own_licences(spark.createDataFrame(list(rows.items()), "path string, text string")).collect()} == {k: k.split()[0] for k in rows}
