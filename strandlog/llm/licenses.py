"""Licence scan by sentences: known licence sentences get identifiers, identifier sequences are matched against rules.

A text is cut into sentences at line ends, behind ``. ! ? ;`` before white space, and behind the colon that ends a grant
("following conditions:", "are met:"); a sentence is normalised (lower case,
runs of anything but letters and digits become one blank). Sentences of the table below are looked up by a hash join with a
table of fixed size; the line SPDX-License-Identifier is read by its grammar (identifiers with OR, AND or WITH between
them), and copyright lines by a pattern. A document's identifiers in
reading order are a sequence, and a rule is an ordered list of identifiers that must stand in it one after another, other
licence sentences between them allowed. Everything is built-in column functions.

A known sentence may also stand on several such parts of a text that follow each other (a hard-wrapped text, a comment, or
a sentence with ``v. 2.0.`` in it): it is found where it begins with one part and ends with another. Of sentences within
each other the longer one counts. The SQL of oracle() knows the parts only, not sentences that are wrapped.

Defined results: a null or empty text has no sentences, an empty list and no licence; repeated rows give repeated rows;
very long texts are scanned whole; other columns are ignored.
"""

from __future__ import annotations

import re
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

# Sentence identifier | sentence of a public licence text or notice.
SENTENCES = """
mit-grant | Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
mit-notice | The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.
as-is-mit | THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.
isc-grant | Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.
bsd-grant | Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:
bsd-source | Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.
bsd-binary | Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.
bsd-endorse | Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.
apache-notice | Licensed under the Apache License, Version 2.0
apache-notice-long | Licensed under the Apache License, Version 2.0 (the "License")
apache-use | you may not use this file except in compliance with the License.
apache-basis | Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
mit-notice-short | Released under the MIT License.
mit-notice-short | Licensed under the MIT License.
mit-notice-short | This project is licensed under the MIT License.
gpl3-notice-short | This work is licensed under the GNU General Public License, version 3.
gpl3-notice-short | Licensed under the GNU General Public License, version 3.
gpl-free | This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
gpl2-free | This program is free software
gpl2-terms | you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation
gpl2-or | either version 2 of the License, or (at your option) any later version.
gpl3-or | either version 3 of the License, or (at your option) any later version.
gpl-useful | This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY
lgpl21-or | either version 2.1 of the License, or (at your option) any later version.
lgpl-terms | you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation
mpl-notice | This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.
mpl-copy | If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.
cc-by | Licensed under CC BY 4.0.
cc-by | This work is licensed under a Creative Commons Attribution 4.0 International License.
cc-by-sa | Licensed under CC BY-SA 4.0.
cc-by-sa | This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.
cc-by-nc | Licensed under CC BY-NC 4.0.
cc-by-nc | This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.
cc-by-nd | Licensed under CC BY-ND 4.0.
cc0 | This work is dedicated to the public domain under CC0 1.0.
unlicense | This is free and unencumbered software released into the public domain.
bsd-as-is | THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.
isc-as-is | THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.
zero-bsd-grant | Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.
apache-see | See the License for the specific language governing permissions and limitations under the License.
gpl2-only-terms | you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.
lgpl-library | This library is free software
agpl-terms | you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation
agpl-free | you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
agpl-free | This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.
zlib-as-is | This software is provided 'as-is', without any express or implied warranty.
zlib-grant | Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:
epl-notice | This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0
boost-notice | Distributed under the Boost Software License, Version 1.0.
reserved | All rights reserved.
"""

# SPDX identifiers that a line SPDX-License-Identifier may name.
SPDX = """
0BSD AGPL-3.0 AGPL-3.0-only AGPL-3.0-or-later Apache-1.1 Apache-2.0 Artistic-2.0 BSD-2-Clause BSD-3-Clause BSD-4-Clause BSL-1.0 CC-BY-4.0 CC-BY-NC-4.0
CC-BY-ND-4.0 CC-BY-SA-4.0 CC0-1.0 CDDL-1.0 EPL-1.0 EPL-2.0 EUPL-1.2 GPL-1.0-or-later GPL-2.0 GPL-2.0-only GPL-2.0-or-later GPL-3.0 GPL-3.0-only
GPL-3.0-or-later ISC LGPL-2.0-only LGPL-2.0-or-later LGPL-2.1 LGPL-2.1-only LGPL-2.1-or-later LGPL-3.0 LGPL-3.0-only LGPL-3.0-or-later MIT MIT-0 MPL-1.1
MPL-2.0 MS-PL OFL-1.1 OpenSSL PostgreSQL Python-2.0 Unlicense WTFPL X11 Zlib
"""

# Identifier | pattern of a whole normalised sentence, for notices in free words.
FORMS = """
copyright | (copyright )?(c )?copyright( c)? [0-9]{4}( [0-9]{4})* .*
"""

# rule's licence | identifiers that must follow each other; earlier rules of a licence are the fuller ones.
RULES = """
MIT | mit-grant mit-notice as-is-mit
MIT | mit-grant mit-notice
MIT | mit-notice-short
ISC | isc-grant
BSD-3-Clause | bsd-grant bsd-source bsd-binary bsd-endorse
BSD-2-Clause | bsd-grant bsd-source bsd-binary
Apache-2.0 | apache-notice-long apache-use apache-basis
Apache-2.0 | apache-notice-long
Apache-2.0 | apache-notice
GPL-3.0 | gpl3-notice-short
GPL-3.0-or-later | gpl-free
GPL-3.0-or-later | gpl2-free gpl2-terms gpl3-or
GPL-2.0-or-later | gpl2-free gpl2-terms gpl2-or
LGPL-2.1-or-later | lgpl-terms lgpl21-or
MPL-2.0 | mpl-notice mpl-copy
MPL-2.0 | mpl-notice
CC-BY-4.0 | cc-by
CC-BY-SA-4.0 | cc-by-sa
CC-BY-NC-4.0 | cc-by-nc
CC-BY-ND-4.0 | cc-by-nd
CC0-1.0 | cc0
Unlicense | unlicense
0BSD | zero-bsd-grant
GPL-2.0-only | gpl2-free gpl2-only-terms
LGPL-2.1-or-later | lgpl-library lgpl-terms lgpl21-or
LGPL-3.0-or-later | lgpl-terms gpl3-or
AGPL-3.0-or-later | agpl-free
AGPL-3.0-or-later | agpl-terms gpl3-or
Zlib | zlib-as-is zlib-grant
EPL-2.0 | epl-notice
BSL-1.0 | boost-notice
"""

#: A sentence without any of these can't be in the tables; spares the join most of the text.
HINT = "licen|permi|copyright|redistribut|warrant|free software|reserved|neither the name|either version|mpl|cc0|public domain|may not use this file|identifier"


def _pairs(table: str) -> list[tuple[str, str]]:
    return [(a.strip(), b.strip()) for a, b in (line.split(" | ", 1) for line in table.strip().splitlines())]


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), "[^\\p{L}\\p{N}]+", " "))


def sentences(text: Column) -> Column:
    """The raw sentences of a text, in order."""
    return F.split(F.coalesce(text, F.lit("")), r"\n+|(?<=[.!?;])\s+|(?<=following conditions:)\s+|(?<=are met:)\s+")


def _rules() -> list[tuple[str, str]]:
    return _pairs(RULES) + [(x, f"spdx-{x}") for x in SPDX.split()]


_IDENTIFIER = "spdx license identifier "


def operands(sentence: Column) -> Column:
    """A normalised sentence, or the operands of its SPDX expression, each as a sentence of its own."""
    parts = F.split(F.replace(F.substring(sentence, len(_IDENTIFIER) + 1, 1 << 20), F.lit(" or later"), F.lit(" orlater")), " (?:or|and|with) ")
    return F.when(sentence.startswith(_IDENTIFIER), F.transform(parts, lambda x: F.concat(F.lit(_IDENTIFIER), x))).otherwise(F.array(sentence))


def _spdx_sentence(name: str) -> str:
    words = "".join(c if c.isalnum() else " " for c in name.lower()).split()
    return _IDENTIFIER + " ".join(words).replace(" or later", " orlater")


def sentence_table(spark: SparkSession, spdx: bool = False) -> DataFrame:
    """(sentence, sid): the known sentences, normalised, with their identifiers; with ``spdx`` also those of one SPDX name."""
    known = spark.createDataFrame(_pairs(SENTENCES), "sid string, raw string")
    parts = known.select("sid", normalised(F.col("raw")).alias("sentence"))
    if spdx:
        parts = parts.unionByName(spark.createDataFrame([(f"spdx-{x}", _spdx_sentence(x)) for x in SPDX.split()], "sid string, sentence string"))
    return parts.groupBy("sentence").agg(F.min("sid").alias("sid"))


def wrapped(texts: DataFrame) -> DataFrame:
    """(row, place, stop, sid): known sentences on several following parts of the texts (row, text); parts without words don't count."""
    known = sentence_table(texts.sparkSession)
    table = [(r.sentence, r.sid) for r in known.collect()]  # the fixed table
    most = max(len(s.split()) for s, _ in table)  # every part has a word at least
    sentence = F.array(*[F.lit(s) for s, _ in table])
    # only texts that hold a known sentence, wherever their parts end, are looked at part by part
    holds = lambda t: reduce(or_, [t.contains(s) for s, _ in table])
    texts = texts.where(F.exists(F.array(normalised(F.col("text"))), holds))
    parts = F.transform(sentences(F.col("text")), lambda s, i: F.struct(i.alias("place"), normalised(s).alias("s")))
    parts = texts.select("row", F.filter(parts, lambda x: x["s"] != "").alias("parts"))
    begins = lambda x: F.exists(sentence, lambda k: k.startswith(F.concat(x["s"], F.lit(" "))))
    at = F.filter(F.transform("parts", lambda x, i: F.when(begins(x), i)), lambda i: i.isNotNull())
    rows = parts.select("row", "parts", F.explode(at).alias("at")).select("row", F.slice("parts", F.col("at") + 1, most).alias("run"))
    rows = rows.withColumn("line", F.concat(F.array_join(F.transform("run", lambda x: x["s"]), " "), F.lit(" ")))
    rows = rows.join(F.broadcast(known), F.col("line").startswith(F.concat("sentence", F.lit(" "))))
    # the part behind which the sentence ends, if it ends with one
    ends = F.filter(F.sequence(F.lit(2), F.size("run")), lambda n: F.array_join(F.transform(F.slice("run", 1, n), lambda x: x["s"]), " ") == F.col("sentence"))
    rows = rows.where(F.size("run") > 1).withColumn("n", F.get(ends, F.lit(0))).where("n is not null")
    return rows.select("row", F.col("run")[0]["place"].alias("place"), F.get("run", F.col("n") - 1)["place"].alias("stop"), "sid")


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licenses (sorted, joined by a blank), sequence (identifiers in order), n_sentences for every row of ``docs``."""
    form = F.lit(None).cast("string")
    for sid, pattern in _pairs(FORMS):
        form = F.coalesce(form, F.when(F.col("sentence").rlike(f"^{pattern}$"), F.lit(sid)))
    base = docs.select(F.col("doc_id").cast("long"), "text").withColumn("row", F.xxhash64("doc_id", "text"))
    hinted = F.filter(F.transform(sentences(F.col("text")), lambda s, i: F.struct(i.alias("place"), s.alias("raw"))), lambda x: F.lower(x["raw"]).rlike(HINT))
    likely = base.where(F.lower("text").rlike(HINT.replace(" ", "[^\\p{L}\\p{N}]+")))
    parts = likely.select("doc_id", "row", F.explode(hinted).alias("s")).select("doc_id", "row", "s.place", F.explode(operands(normalised(F.col("s.raw")))).alias("sentence"))
    known = parts.join(F.broadcast(sentence_table(docs.sparkSession, spdx=True)), "sentence", "left").withColumn("sid", F.coalesce("sid", form)).where("sid is not null")
    # repeated rows share a key, so their places are counted once
    known = known.select("row", "place", F.col("place").alias("stop"), "sid").unionByName(wrapped(likely.select("row", "text")))
    by_row = known.distinct().groupBy("row").agg(F.array_sort(F.collect_list(F.struct("place", "sid", "stop"))).alias("found"))
    by_row = by_row.withColumn("long", F.filter("found", lambda x: x["stop"] > x["place"]))
    inside = lambda x, y: (y["place"] <= x["place"]) & (y["stop"] >= x["stop"]) & (y["stop"] - y["place"] > x["stop"] - x["place"])
    by_row = by_row.withColumn("found", F.when(F.size("long") > 0, F.filter("found", lambda x: ~F.exists("long", lambda y: inside(x, y)))).otherwise(F.col("found")))
    by_row = by_row.select("row", F.concat(F.lit(" "), F.array_join(F.transform("found", lambda x: x["sid"]), " "), F.lit(" ")).alias("sequence"), F.size("found").alias("n_sentences"))
    matched = F.array()
    for licence, ids in _rules():
        matched = F.concat(matched, F.when(F.col("sequence").rlike(" " + " (?:.* )?".join(map(re.escape, ids.split())) + " "), F.array(F.lit(licence))).otherwise(F.array().cast("array<string>")))
    licences = F.array_join(F.array_sort(F.array_distinct(matched)), " ")
    by_row = by_row.select("row", licences.alias("licenses"), F.trim("sequence").alias("sequence"), "n_sentences")
    return base.select("doc_id", "row").join(by_row, "row", "left").select("doc_id", F.coalesce("licenses", F.lit("")).alias("licenses"), F.coalesce("sequence", F.lit("")).alias("sequence"), F.coalesce("n_sentences", F.lit(0)).alias("n_sentences"))


def oracle() -> str:
    """The scan in DuckDB SQL."""
    quote = lambda x: x.replace("'", "''")
    norm = "trim(regexp_replace(lower({}), '[^\\p{{L}}\\p{{N}}]+', ' ', 'g'))"
    known = ", ".join(f"('{sid}', '{quote(raw)}')" for sid, raw in _pairs(SENTENCES) + [(f"spdx-{x}", _spdx_sentence(x)) for x in SPDX.split()])
    forms = " ".join(f"WHEN regexp_full_match(sentence, '{p}') THEN '{sid}'" for sid, p in _pairs(FORMS))
    rules = ", ".join(f"CASE WHEN regexp_matches(sequence, ' {' (?:.* )?'.join(map(re.escape, ids.split()))} ') THEN '{licence}' END" for licence, ids in _rules())
    return f"""
    WITH known AS (SELECT {norm.format('raw')} AS sentence, min(sid) AS sid FROM (VALUES {known}) t(sid, raw) GROUP BY 1),
    base AS (SELECT row_number() OVER () AS row, doc_id, regexp_split_to_array(regexp_replace(coalesce(text, ''), '([.!?;]|following conditions:|are met:)\\s+', '\\1' || chr(10), 'g'), '\\n+') AS parts FROM documents),
    exploded AS (SELECT row, unnest(range(len(parts))) AS place, unnest(parts) AS raw FROM base),
    whole AS (SELECT row, place, {norm.format('raw')} AS sentence FROM exploded),
    norms AS (SELECT row, place, unnest(CASE WHEN starts_with(sentence, '{_IDENTIFIER}') THEN list_transform(string_split_regex(replace(sentence[{len(_IDENTIFIER) + 1}:], ' or later', ' orlater'),
      ' (?:or|and|with) '), lambda x: '{_IDENTIFIER}' || x) ELSE [sentence] END) AS sentence FROM whole),
    found AS (SELECT DISTINCT n.row, n.place, coalesce(k.sid, CASE {forms} END) AS sid FROM norms n LEFT JOIN known k USING (sentence)),
    seqs AS (SELECT row, ' ' || string_agg(sid, ' ' ORDER BY place, sid) || ' ' AS sequence, count(*) AS n FROM found WHERE sid IS NOT NULL GROUP BY row),
    out AS (SELECT row, sequence, n, list_filter([{rules}], lambda x: x IS NOT NULL) AS m FROM seqs)
    SELECT b.doc_id, coalesce(array_to_string(list_sort(list_distinct(o.m)), ' '), '') AS licenses, coalesce(trim(o.sequence), '') AS sequence, CAST(coalesce(o.n, 0) AS INTEGER) AS n_sentences
    FROM base b LEFT JOIN out o USING (row)"""
