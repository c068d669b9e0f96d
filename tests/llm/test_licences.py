import re

from foliant.llm.licences import RULES, SENTENCES, scan
from tests.llm.oracle import compare


def test_whole_table(spark, sf):
    assert compare(spark, sf, "op7_license_scan") == spark.read.parquet(f"{sf}/documents.parquet").count()


def test_finds_the_notices(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    found = {r.doc_id for r in scan(docs).where("licences <> ''").collect()}
    lines = re.compile(r"^(Licensed under|Released under|This work is licensed under)|All rights reserved\.", re.M)
    assert found == {r.doc_id for r in docs.collect() if lines.search(r.text)} and found


APACHE = """Copyright 2020 A B.
Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance
with the License. You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE."""


def test_sequences_and_odd_rows(spark):
    rows = [(1, APACHE), (2, GPL), (3, "x\nReleased under the MIT License.\nlicensed under cc by-nc 4.0."), (4, "the Released under the MIT License"), (5, None), (6, ""), (7, "...\n\n"),
            (8, "All rights reserved.\n" * 20_000), (9, "RELEASED   UNDER—THE MIT\tLICENSE!"), (9, "RELEASED   UNDER—THE MIT\tLICENSE!"), (None, "Licensed under CC BY 4.0"), (10, "w " * 300_000 + ". Licensed under CC BY-SA 4.0.\n")]
    got = scan(spark.createDataFrame([(*r, "u") for r in rows], "doc_id long, text string, unit string")).collect()
    named = sorted((str(r.doc_id), r.licences) for r in got)
    assert named == sorted((str(d), x) for d, x in [(1, "Apache-2.0"), (2, "GPL-3.0-or-later"), (3, "CC-BY-NC-4.0,MIT"), (4, ""), (5, ""), (6, ""), (7, ""), (8, "Proprietary"), (9, "MIT"), (9, "MIT"), (None, "CC-BY-4.0"), (10, "CC-BY-SA-4.0")])
    assert {r.n_sentences for r in got if r.doc_id == 8} == {20_000}


def test_a_rule_needs_its_order(spark):
    rules, sentences = [("AB", (1, 2)), ("A", (1,))], {1: "one", 2: "two"}
    docs = spark.createDataFrame([(1, "one. two."), (2, "two. one."), (3, "one. other words. two."), (4, "one. one. two. ")], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in scan(docs, sentences=sentences, rules=rules).collect()} == {1: "AB", 2: "A", 3: "AB", 4: "A,AB"}


def test_empty_table(spark):
    assert scan(spark.createDataFrame([], "doc_id long, text string")).collect() == []


def test_tables_are_normal():
    assert all(re.fullmatch("[a-z0-9]+( [a-z0-9]+)*", s) for s in SENTENCES.values())
    assert all(i in SENTENCES for _, ids in RULES for i in ids)


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial
portions of the Software.
"""
BSD = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:
1. Redistributions of source code must retain the above copyright
   notice, this list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following
   disclaimer in the documentation and/or other materials provided with the distribution.
"""
GPL_2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.
"""


def test_source_headers(spark):
    """Notices in comments, lists without a blank line, and further licences."""
    def star(t):
        return "/*\n" + "".join(f" * {x}".rstrip() + "\n" for x in t.splitlines()) + " */\nint main;\n"

    def sharp(t):
        return "#!/bin/sh\n" + "".join(f"# {x}".rstrip() + "\n" for x in t.splitlines()) + "\nx=1\n"

    known = [(MIT, "MIT"), (BSD, "BSD-2-Clause"), (APACHE, "Apache-2.0"), (GPL, "GPL-3.0-or-later"), (GPL_2, "GPL-2.0-or-later"), (MPL, "MPL-2.0"), (ISC, "ISC")]
    rows = [(f(t), name) for t, name in known for f in (str, star, sharp)] + [("// SPDX-License-Identifier: LGPL-2.1-or-later\nx", "LGPL-2.1-or-later")]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id long, text string")
    assert {r.doc_id: r.licences for r in scan(docs).collect()} == {i: name for i, (_, name) in enumerate(rows)}
