"""Licence notices by sentence rules: normalised sentences become identifiers, whose sequences are matched against ordered licence rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from foliant.llm.common import numbered

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# Sentences of public licences and notices, normalised (A-Z lower-cased, runs of other characters than a-z and 0-9 as one blank).
SENTENCES = {
    1: "licensed under the apache license version 2 0",
    2: "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license",
    3: "you may obtain a copy of the license at",
    4: "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    5: "see the license for the specific language governing permissions and limitations under the license",
    10: "released under the mit license",
    11: "licensed under the mit license",
    12: "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    13: "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software",
    20: "this work is licensed under the gnu general public license version 3",
    21: "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    22: "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose",
    23: "see the gnu general public license for more details",
    30: "licensed under cc by nc 4 0",
    31: "licensed under cc by 4 0",
    32: "licensed under cc by sa 4 0",
    40: "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met",
    41: "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer",
    42: "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    43: "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    50: "all rights reserved",
}
#: (licence, sentence identifiers in order): of the rules that start at a place the longest wins.
RULES = [
    ("Apache-2.0", (1,)), ("Apache-2.0", (2,)), ("Apache-2.0", (2, 3, 4, 5)), ("MIT", (10,)), ("MIT", (11,)), ("MIT", (12, 13)),
    ("GPL-3.0", (20,)), ("GPL-3.0-or-later", (21,)), ("GPL-3.0-or-later", (21, 22, 23)), ("CC-BY-NC-4.0", (30,)), ("CC-BY-4.0", (31,)), ("CC-BY-SA-4.0", (32,)),
    ("BSD-2-Clause", (40, 41, 42)), ("BSD-3-Clause", (40, 41, 42, 43)), ("Proprietary", (50,)),
]
# More licences and their SPDX lines, in a table of their own: the query's SQL states the ones above.
_GNU = "is free software you can redistribute it and or modify it under the terms of the gnu "
_FSF = "general public license as published by the free software foundation either version "
_LATER = " of the license or at your option any later version"
MORE_SENTENCES = {
    100: f"this program {_GNU}{_FSF}2{_LATER}",
    101: f"this program {_GNU}general public license version 2 as published by the free software foundation",
    102: f"this library {_GNU}lesser {_FSF}2 1{_LATER}",
    103: f"this program {_GNU}lesser {_FSF}2 1{_LATER}",
    104: f"this library {_GNU}lesser {_FSF}3{_LATER}",
    105: f"this program {_GNU}lesser {_FSF}3{_LATER}",
    106: f"this program {_GNU}affero {_FSF}3{_LATER}",
    110: "this source code form is subject to the terms of the mozilla public license v",
    111: "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0",
    112: "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
    120: "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
}
MORE_RULES = [("GPL-2.0-or-later", (100,)), ("GPL-2.0-only", (101,)), ("LGPL-2.1-or-later", (102,)), ("LGPL-2.1-or-later", (103,)), ("LGPL-3.0-or-later", (104,)), ("LGPL-3.0-or-later", (105,)),
              ("AGPL-3.0-or-later", (106,)), ("MPL-2.0", (110, 111)), ("MPL-2.0", (110, 112)), ("ISC", (120,))]
#: Identifiers whose SPDX line is known. GPL-2.0 and the like are old names, with or without a plus sign.
SPDX = ("0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-2.0 BSD-2-Clause BSD-3-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0 CC-BY-SA-4.0 CC0-1.0 EPL-2.0 GPL-2.0 GPL-2.0-only GPL-2.0-or-later "
        "GPL-3.0 GPL-3.0-only GPL-3.0-or-later ISC LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MPL-2.0 Unlicense Zlib").split()
MORE_SENTENCES |= {200 + i: "spdx license identifier " + name.lower().replace("-", " ").replace(".", " ") for i, name in enumerate(SPDX)}
MORE_RULES += [(name, (200 + i,)) for i, name in enumerate(SPDX)]
#: Where sentences end: as running text, whose lines may wrap, and line by line.
ENDS = (r"[.!?]+[\x09-\x0d\x20]+|[\x0a\x0d][\x09-\x0d\x20]*[\x0a\x0d]", r"[.!?]+[\x09-\x0d\x20]+|[\x0a\x0d]+")
#: Comment marks that begin a line, and where sentences end once they are gone: as running text, also with a colon that ends a line.
COMMENT = r"(?m)^[\x09\x20]*(?:#![^\x0a\x0d]*|/\*+|\*+/|\*+|//+!?|#+|;+|--+|%+)"
COMMENT_ENDS = (ENDS[0], ENDS[0] + r"|:[\x09\x20]*[\x0a\x0d]+")
#: Sentence tables up to this number of rows are sent to all executors (some 300 bytes each).
SENT_SENTENCES = 20_000


def normal(c: Column) -> Column:
    return F.trim(F.regexp_replace(F.translate(c, UPPER, LOWER), "[^a-z0-9]+", " "))


def _listed(spark: SparkSession, rows: list[Column]) -> DataFrame:
    return spark.range(1).select(F.inline(F.array(*rows)))


def scan(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", sentences: dict[int, str] | None = None, rules: list | None = None) -> DataFrame:
    """doc_id, licences (distinct, sorted, joined by commas; empty if none) and n_sentences (known ones found) per row.

    A text is cut into sentences as running text and line by line, and as running text without comment marks at line starts, there also
    with a colon that ends a line; each cut's known sentences form a sequence of identifiers in
    order of place. A rule fits where its identifiers follow each other in a sequence; one that starts where a longer one does gives way
    to it. n_sentences is the largest count of all cuts. Null and empty texts have none; rows that repeat an id are scanned on their own.
    """
    spark = docs.sparkSession
    sentences, rules = sentences or SENTENCES | MORE_SENTENCES, rules or RULES + MORE_RULES
    known = _listed(spark, [F.struct(F.lit(i).alias("sentence"), F.lit(unit).alias("unit")) for i, unit in sentences.items()])
    known = F.broadcast(known) if len(sentences) <= SENT_SENTENCES else known
    text = F.coalesce(F.col(text_column).cast("string"), F.lit(""))
    bare = F.regexp_replace(text, COMMENT, "")
    cut = F.array(*[F.struct(F.lit(i).alias("cut"), F.transform(F.split(t, ends, -1), normal).alias("units"))
                    for i, (t, ends) in enumerate([(text, e) for e in ENDS] + [(bare, e) for e in COMMENT_ENDS])])
    # Known sentences are found in the pass that lists the rows: a stored row keeps the places of its known units only, and texts are read once.
    names = F.array(*[F.lit(s) for s in sorted(sentences.values())]) if len(sentences) <= 1000 else None
    keep = (lambda u: F.array_contains(names, u)) if names is not None else (lambda u: F.length(u) > 0)
    cut = F.transform(cut, lambda c: F.struct(c["cut"].alias("cut"), F.filter(F.transform(c["units"], lambda u, i: F.struct(i.alias("place"), u.alias("unit"))), lambda x: keep(x["unit"])).alias("units")))
    rows = numbered(docs.select(F.col(id_column).cast("long").alias("doc_id"), cut.alias("cuts")), "sentences")
    units = rows.select("_row", F.explode("cuts").alias("c")).select("_row", "c.cut", F.explode("c.units").alias("u")).select("_row", "cut", "u.place", "u.unit")
    found = units.join(known, "unit")
    order = Window.partitionBy("_row", "cut").orderBy("place")
    longest = max(len(ids) for _, ids in rules)
    coming = F.concat_ws(",", *[F.lead("sentence", k).over(order).cast("string") for k in range(longest)])
    seen = found.select("_row", "cut", "place", "sentence", F.concat(coming, F.lit(",")).alias("coming"))
    table = _listed(spark, [F.struct(F.lit(ids[0]).alias("sentence"), F.lit(",".join(map(str, ids)) + ",").alias("ids"), F.lit(len(ids)).alias("size"), F.lit(name).alias("licence"))
                            for name, ids in rules])
    table = F.broadcast(table) if len(rules) <= SENT_SENTENCES else table
    fits = seen.join(table, "sentence").where("startswith(coming, ids)")
    best = fits.groupBy("_row", "cut", "place").agg(F.min(F.struct(-F.col("size"), "licence")).alias("m"))
    licences = best.groupBy("_row").agg(F.concat_ws(",", F.array_sort(F.collect_set("m.licence"))).alias("licences"))
    counts = found.groupBy("_row", "cut").count().groupBy("_row").agg(F.max("count").alias("n"))
    return (rows.select("_row", "doc_id").join(licences, "_row", "left").join(counts, "_row", "left")
            .select("doc_id", F.coalesce("licences", F.lit("")).alias("licences"), F.coalesce("n", F.lit(0)).cast("long").alias("n_sentences")))
