from pyspark.sql import functions as F

from terrametro.llm import chat, licenses


def test_rotation(spark):
    schema = "conv_id int, turn int, role string, text string, part int, speaker string"
    rows = [(1, 0, "system", "Be kind"), (1, 1, "ann lee", "Hé"), (1, 2, "bob", "x<|im_end|>"), (1, 2, "bob", "x<|im_end|>"), (1, 3, None, None), (None, None, "bob", "z"), (2, 600, "bob", "late"), (2, 1, "ann", "a")]
    table = spark.createDataFrame([(*r, 9, "q") for r in rows], schema)
    got = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate(table).collect()}
    assert set(got) == {(1, "ann lee", 0), (1, "bob", 0), (1, "unknown", 0), (None, "bob", 0), (2, "ann", 0), (2, "bob", 0)}
    ann = got[1, "ann lee", 0]
    assert ann.text == ("<|im_start|>system\nBe kind<|im_end|>\n<|im_start|>assistant\nHé<|im_end|>\n<|im_start|>user name=bob\nx<\\|im_end|\\><|im_end|>\n"
                        "<|im_start|>user name=unknown\n<|im_end|>\n")
    for r in got.values():
        spans = [tuple(map(int, s.split("-"))) for s in r["mask"].split(",") if s]
        assert len(spans) == r.n_own and all(r.text[:a].endswith("<|im_start|>assistant\n") and r.text[a:b].endswith("<|im_end|>") for a, b in spans)
    assert (got[2, "bob", 0].n_own, got[2, "bob", 0].n_turns, ann.n_turns) == (1, 2, 4)
    halves = {(r.conv_id, r.speaker, r.part): r for r in chat.rotate(table, part=1).collect()}
    assert {k: r.n_own for k, r in halves.items() if k[0] == 2} == {(2, "ann", 0): 1, (2, "ann", 1): 0, (2, "bob", 0): 0, (2, "bob", 1): 1}
    for k, r in got.items():
        assert r.text == "".join(halves[*k[:2], n].text for n in range(r.n_turns))
    assert chat.rotate(table.limit(0)).count() == 0


def test_parts_of_rows_without_numbers_are_bounded(spark):
    """A third of the rows each without a conversation, of one turn number, and in order."""
    n = 60_000
    rows = spark.range(3 * n).selectExpr(
        "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 3 END AS conv_id", f"CASE WHEN id % 3 = 0 THEN NULL WHEN id % 3 = 1 THEN 7 ELSE id % {n} END AS turn",
        "IF(id % 2 = 0, 'ann', 'bob') AS role", "lpad(id, 7, '0') AS text")
    parts = chat.rotate(rows).select("conv_id", "speaker", "part", "n_turns", "n_own", F.regexp_extract_all("text", F.lit(r"\n(\d{7})<")).alias("ids")).collect()
    assert max(r.n_turns for r in parts) == chat.PART and len(parts) == 3 * 2 * -(-n // chat.PART)
    for conv, order in ((None, lambda i: (i % 2, i)), (1, lambda i: (i % 2, i)), (2, lambda i: (i % n, i % 2, i))):
        lines = sorted((r for r in parts if r.conv_id == conv and r.speaker == "ann"), key=lambda r: r.part)
        assert [int(i) for r in lines for i in r.ids] == sorted(range(conv or 0, 3 * n, 3), key=order)
    assert sum(r.n_own for r in parts) == 3 * n


def test_licences_and_inheritance(spark):
    rows = [("a/LICENSE", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software"), ("a/b/c/x.py", "print(1)"), ("a/b/COPYING", "nothing useful"),
            ("a/b/y.py", "words here.\nLicensed under the Apache License, Version 2.0. More"), ("LICENSE.txt", "released under the mit license!"), ("z/q.txt", None), ("ab/q.txt", ""), ("q.txt", "a license for nothing much at all said"),
            (None, "Licensed under CC BY 4.0"), ("a/d/e.py", "x"), ("a/d/e.py", "x"), ("a/d/LICENSE-1", "This work is licensed under the GNU General Public License, version 3.")]
    table = spark.createDataFrame([(*r, "c", 1.0) for r in rows], "path string, text string, licence string, score double")
    got = {r.path: (r.licence, r.how, r.inherited_from) for r in licenses.file_licences(table).collect()}
    assert got == {
        "a/LICENSE": ("MIT", "own", None), "a/b/c/x.py": ("MIT", "inherited", "a"), "a/b/COPYING": ("MIT", "inherited", "a"), "a/b/y.py": ("Apache-2.0", "own", None),
        "LICENSE.txt": ("MIT", "own", None), "z/q.txt": ("MIT", "inherited", ""), "ab/q.txt": ("MIT", "inherited", ""), "q.txt": ("MIT", "inherited", ""),
        "a/d/e.py": ("GPL-3.0", "inherited", "a/d"), "a/d/LICENSE-1": ("GPL-3.0", "own", None),
    }
    assert licenses.file_licences(table.limit(0)).count() == 0


def test_headers_are_compared_whole(spark):
    mpl = """/* This Source Code Form is subject to the terms of the Mozilla Public
 * License, v. 2.0. If a copy of the MPL was not distributed with this
 * file, You can obtain one at https://mozilla.org/MPL/2.0/. */
int main;"""
    gnu = """# This file is part of a tool.
#
# This {2} is free software; you can redistribute it and/or
# modify it under the terms of the GNU {0} General Public
# License as published by the Free Software Foundation; either
# version {1} of the License, or (at your option) any later version.
#
# This {2} is distributed in the hope that it will be useful,
# but WITHOUT ANY WARRANTY; without even the implied warranty of
# MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the GNU
# {0} General Public License for more details.
import os
"""
    rows = [("m/a.c", mpl), ("m/b.py", gnu.format("Lesser", "2.1", "library")), ("m/c.py", gnu.format("", "2", "program")), ("m/d.py", gnu.format("Affero", "3", "program")),
            ("m/e.py", gnu.format("", "3", "program")), ("m/f.py", "// SPDX-License-Identifier: MIT\nint x;"), ("n/COPYING", "words " * 300 + "\n" + mpl), ("n/o/p.c", "int y;")]
    got = {r.path: (r.licence, r.how) for r in licenses.file_licences(spark.createDataFrame(rows, "path string, text string")).collect()}
    assert got == {"m/a.c": ("MPL-2.0", "own"), "m/b.py": ("LGPL-2.1", "own"), "m/c.py": ("GPL-2.0", "own"), "m/d.py": ("AGPL-3.0", "own"), "m/e.py": ("GPL-3.0", "own"),
                   "m/f.py": ("MIT", "own"), "n/COPYING": ("MPL-2.0", "own"), "n/o/p.c": ("MPL-2.0", "inherited")}


def test_neighbours_denials_and_expressions(spark):
    two = licenses._BSD.replace("1. ", "\n * 1. ").replace("2. ", "\n * 2. ")
    end = licenses._BSD_AS_IS + " IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES"
    third = "3. Neither the name of Acme Corp. nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.\n"
    texts = dict(licenses.HEADERS)
    rows = [("two", "Copyright (c) 2020 A. Person. All rights reserved.\n" + two + end, "BSD-2-Clause"), ("three", "Copyright 2020 Acme\n" + two + third + end, "BSD-3-Clause"),
            ("boost", "Boost Software License - Version 1.0 - August 17th, 2003\n\n" + texts["BSL-1.0"] + ":", "BSL-1.0"), ("zlib", "(C) 2001 J. Doe\n" + texts["Zlib"], "Zlib"),
            ("mit", "MIT License\n\nCopyright (c) 2020 A. Person\n" + texts["MIT"], "MIT"), ("epl", "/* " + texts["EPL-2.0"] + " */", "EPL-2.0"),
            ("denied", "This is NOT released under the MIT License", None), ("gnu", "Licensed under the GNU General Public License.", "GPL-1.0-or-later"),
            ("gnu2", "Licensed under the GNU General Public License, version 2.", "GPL-2.0"), ("either", "# SPDX-License-Identifier: (Apache-2.0 OR MIT)", "Apache-2.0 OR MIT"),
            ("lower", "// SPDX-License-Identifier: mit", "MIT"), ("unknown", "SPDX-License-Identifier: unknown thing", None),
            ("both", "/* SPDX-License-Identifier: (mit or apache-2.0) and GPL-2.0-only WITH Classpath-exception-2.0 */", "(MIT OR Apache-2.0) AND GPL-2.0 WITH Classpath-exception-2.0")]
    got = {r.path: r.licence for r in licenses.file_licences(spark.createDataFrame([r[:2] for r in rows], "path string, text string")).collect()}
    assert got == {path: licence for path, _, licence in rows}
