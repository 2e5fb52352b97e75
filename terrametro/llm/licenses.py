"""Licences of files: headers and statements matched to templates, then inherited from the nearest directory.

The text of a file, lines joined and comment marks removed, is compared with whole headers and
licence texts wherever it shares a pair of licence words with one, over the template's length,
by the cosine of sparse TF-IDF vectors. An SPDX line gives its whole expression. A statement is a sentence
or line that speaks of a licence and does not deny it, compared with one-line templates. A file has the licence of
its best header, without one of its best statement. A file
without one takes that of the licence file in the nearest directory above it.
"""

from __future__ import annotations

import math
import re
from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..sources.staging import staged

# Licence identifiers and the public wording of their notices.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS"),
    ("MIT", "Released under the MIT License"),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License, version 3"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2"),
    ("GPL-1.0-or-later", "Licensed under the GNU General Public License"),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3"),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted"),
    ("BSD-3-Clause", "Released under the BSD 3-Clause License"),
    ("BSD-2-Clause", "Released under the BSD 2-Clause License"),
    ("BSL-1.0", "Distributed under the Boost Software License, Version 1.0"),
    ("Zlib", "Released under the zlib License"),
    ("EPL-2.0", "Licensed under the Eclipse Public License 2.0"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0"),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0"),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0"),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related rights, CC0 1.0"),
    ("Unlicense", "This is free and unencumbered software released into the public domain"),
    ("Proprietary", "Copyright, all rights reserved"),
]
_GNU = (
    "free software; you can redistribute it and/or modify it under the terms of the GNU {0} as published by the Free Software Foundation; either "
    "version {1} of the License, or (at your option) any later version. This {2} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; "
    "without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0} for more details. "
    "You should have received a copy of the GNU {0} along with this {2}"
)
_GNU_TEXT = (
    "GNU {0} Version {1} Copyright (C) {2} Free Software Foundation, Inc. "
    "Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed."
)
_AS_IS = (
    "THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, "
    "FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY"
)
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of "
    "source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, "
    "this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_AS_IS = (
    "THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, "
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."
)
# Whole headers; short licences whole, of the long ones the beginning, which names licence and version.
HEADERS = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at "
     "http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, "
     "WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/ TERMS AND CONDITIONS FOR USE, REPRODUCTION, AND DISTRIBUTION 1. Definitions. "
     "License shall mean the terms and conditions for use, reproduction, and distribution as defined by Sections 1 through 9 of this document."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software "
     "without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons "
     "to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or "
     "substantial portions of the Software. " + _AS_IS),
    ("GPL-2.0", "This program is " + _GNU.format("General Public License", "2", "program")),
    ("GPL-3.0", "This program is " + _GNU.format("General Public License", "3", "program")),
    ("LGPL-2.1", "This library is " + _GNU.format("Lesser General Public License", "2.1", "library")),
    ("LGPL-3.0", "This library is " + _GNU.format("Lesser General Public License", "3", "library")),
    ("AGPL-3.0", "This program is " + _GNU.format("Affero General Public License", "3", "program")),
    ("GPL-2.0", _GNU_TEXT.format("GENERAL PUBLIC LICENSE", "2, June 1991", "1989, 1991")),
    ("GPL-3.0", _GNU_TEXT.format("GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007")),
    ("LGPL-2.1", _GNU_TEXT.format("LESSER GENERAL PUBLIC LICENSE", "2.1, February 1999", "1991, 1999")),
    ("LGPL-3.0", _GNU_TEXT.format("LESSER GENERAL PUBLIC LICENSE", "3, 29 June 2007", "2007")),
    ("AGPL-3.0", _GNU_TEXT.format("AFFERO GENERAL PUBLIC LICENSE", "3, 19 November 2007", "2007")),
    ("BSD-3-Clause", _BSD + "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software "
     "without specific prior written permission. " + _BSD_AS_IS),
    ("BSD-2-Clause", _BSD + _BSD_AS_IS),
    ("BSL-1.0", "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license "
     "(the Software) to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the "
     "Software is furnished to do so, all subject to the following"),
    ("Zlib", "This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software. "
     "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following "
     "restrictions: 1. The origin of this software must not be misrepresented; you must not claim that you wrote the original software."),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at "
     "https://www.eclipse.org/legal/epl-2.0/"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, "
     "You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "Mozilla Public License Version 2.0 1. Definitions 1.1. Contributor means each individual or legal entity that creates, contributes to the creation of, or owns Covered Software."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this "
     "permission notice appear in all copies. THE SOFTWARE IS PROVIDED AS IS AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE"),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
     "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means."),
]
#: Comment marks at the two ends of a line.
MARKS = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+|#+|--+|;+|%+|<!--|\.\.|\"{3}|'{3}|dnl\b|rem\b)?[ \t]*|[ \t]*(?:\*+/|-->)?[ \t\r]*$"
_ID = r"[a-z0-9][a-z0-9.+-]*"
SPDX = rf"(?i)spdx-licen[cs]e-identifier:[ \t]*((?:\([ \t]*)*{_ID}(?:[ \t]*\))*(?:[ \t]+(?:and|or|with)[ \t]+(?:\([ \t]*)*{_ID}(?:[ \t]*\))*)*)"
#: Identifiers without a digit or hyphen; others need one of these to be taken as an identifier.
PLAIN_IDS = ["MIT", "ISC", "Zlib", "Unlicense", "X11", "curl", "Ruby", "Vim", "PostgreSQL", "OpenSSL", "Libpng", "NCSA", "Beerware", "WTFPL"]
#: A statement that denies a licence.
DENIED = r"(?i)(^|[^a-z0-9_])(not|never|no longer|isn't|aren't)[ \t]+([a-z]+[ \t]+)?(licen[cs]ed|released|distributed|available|covered|published|offered|provided|under)([^a-z0-9_]|$)"
TRIGGER = r"(?i)licen[cs]e|copyright|spdx|permission (is|to)|redistribution|public domain|rights reserved|free software"
TERM = r"[a-z0-9]+(?:\.[0-9]+)?"
LICENCE_FILE = r"(?i)^(un)?(licen[cs]e|copying|notice)([.-].*)?$"
#: Least cosine of a match.
LEAST = 0.5
#: Least cosine of a whole header.
LEAST_HEADER = 0.75


def weights(templates: list[tuple[str, str]] = TEMPLATES) -> tuple[list[tuple[int, str, str, float]], float]:
    """(template, licence, term, weight of the unit vector), and the idf of a term no template has."""
    bags = [re.findall(TERM, text.lower()) for _, text in templates]
    n = len(bags)
    idf = {t: math.log((1 + n) / (1 + sum(t in b for b in bags))) + 1 for b in bags for t in b}
    rows = []
    for k, ((licence, _), bag) in enumerate(zip(templates, bags)):
        vector = {t: bag.count(t) * idf[t] for t in bag}
        norm = math.sqrt(sum(v * v for v in vector.values()))
        rows += [(k, licence, t, idf[t], v / norm) for t, v in vector.items()]
    return rows, math.log(1 + n) + 1


def _templates(spark: SparkSession, templates: list[tuple[str, str]]) -> tuple[DataFrame, float]:
    rows, other = weights(templates)
    values = ", ".join(f"({k}, '{licence}', '{term}', {idf!r}D, {weight!r}D)" for k, licence, term, idf, weight in rows)
    return spark.sql(f"SELECT * FROM VALUES {values} AS t(template, licence, term, idf, weight)"), other


def statements(text):
    """Lines and sentences of a text that speak of a licence and do not deny it."""
    parts = F.split(F.regexp_replace(text, r"([.;!?])\s+", "$1\n"), "\n")
    return F.when(text.rlike(TRIGGER), F.filter(parts, lambda s: s.rlike(TRIGGER) & ~s.rlike(DENIED)))


def spdx_licence(expression):
    """An SPDX expression with names in their usual case, versions without suffixes; NULL if a name cannot be an identifier."""
    found = F.regexp_replace(expression, r"[.-]+$", "")
    found = F.regexp_replace(found, r"(?i)(-only|-or-later|\+)(?=[ \t)]|$)", "")
    found = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace(found, r"[ \t]+", " "), r"\( ", "("), r" \)", ")"))
    found = F.regexp_replace(found, r"^\(([^()]*)\)?$", "$1")
    for name in ["AND", "OR", "WITH", *sorted({licence for licence, _ in TEMPLATES + HEADERS} | set(PLAIN_IDS))]:
        found = F.regexp_replace(found, rf"(?i)(?<![\w.+-]){re.escape(name)}(?![\w.+-])", name)
    names = F.filter(F.split(F.regexp_replace(found, r"[()]", ""), " "), lambda n: ~n.isin("AND", "OR", "WITH"))
    likely = F.forall(names, lambda n: n.isin(PLAIN_IDS) | n.rlike("[0-9-]"))
    balanced = F.length(F.regexp_replace(found, r"[^(]", "")) == F.length(F.regexp_replace(found, r"[^)]", ""))
    return F.when(likely & balanced, found)


def read_once(rows: DataFrame) -> DataFrame:
    """rows(path, body) -> path, statements, spdx expressions, and the words of texts that speak of a licence: all that is needed of a text."""
    speaks = F.col("body").rlike(TRIGGER)
    plain = F.lower(F.regexp_replace("body", MARKS, ""))
    return rows.select(
        "path", F.array_distinct(statements(F.col("body"))).alias("statements"),
        F.when(speaks, F.regexp_extract_all("body", F.lit(SPDX), 1)).alias("spdx"),
        F.when(speaks, F.regexp_extract_all(plain, F.lit(TERM), 0)).alias("words"))


def windows(rows: DataFrame) -> DataFrame:
    """read_once rows -> distinct (path, statement): the text over a header's length, laid so that a pair of licence words meets that of the header."""
    laid = {}
    for _, text in HEADERS:
        bag = re.findall(TERM, text.lower())
        for k, pair in enumerate(zip(bag, bag[1:])):
            if re.search(r"licen[cs]e|permission|redistribut|unencumbered|source code|accompanying materials", " ".join(pair)):
                laid.setdefault(" ".join(pair), set()).add((k, len(bag)))
    values = ", ".join(f"('{pair}', {k}, {n})" for pair, places in sorted(laid.items()) for k, n in sorted(places))
    places = rows.sparkSession.sql(f"SELECT * FROM VALUES {values} AS t(pair, before, length)")
    words = rows.select("path", "words").where("words IS NOT NULL AND size(words) > 1")
    pair = lambda k: F.concat_ws(" ", F.get("words", k), F.get("words", k + 1))
    met = F.filter(F.sequence(F.lit(0), F.size("words") - 2), lambda k: pair(k).isin(*laid))
    met = words.select("path", "words", F.explode(met).alias("at")).select("path", "words", "at", pair(F.col("at")).alias("pair"))
    begin = F.greatest(F.col("at") - F.col("before"), F.lit(0))
    cut = F.array_join(F.slice("words", begin + 1, F.col("length")), " ")
    return met.join(F.broadcast(places), "pair").select("path", cut.alias("statement")).distinct()


def match_statements(found: DataFrame, fixed: list[tuple[str, str]] = TEMPLATES, least: float = LEAST) -> DataFrame:
    """found(statement), distinct -> (statement, licence, score) of the best template at the least cosine or more."""
    templates, other = _templates(found.sparkSession, fixed)
    known = templates.select("term", "idf").distinct()
    terms = found.select("statement", F.explode(F.regexp_extract_all(F.lower("statement"), F.lit(TERM), 0)).alias("term"))
    counted = terms.groupBy("statement", "term").agg(F.count("*").alias("tf"))
    # The templates are a fixed list of a few hundred terms.
    valued = counted.join(F.broadcast(known), "term", "left").select("statement", "term", (F.col("tf") * F.coalesce("idf", F.lit(other))).alias("value"))
    norms = valued.groupBy("statement").agg(F.sqrt(F.sum(F.col("value") * F.col("value"))).alias("norm"))
    dots = valued.join(F.broadcast(templates.select("template", "licence", "term", "weight")), "term").groupBy("statement", "template", "licence").agg(
        F.sum(F.col("value") * F.col("weight")).alias("dot"))
    cosine = dots.join(norms, "statement").select("statement", "licence", F.round(F.col("dot") / F.col("norm"), 6).alias("score")).where(F.col("score") >= least)
    best = cosine.groupBy("statement").agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best"))
    return best.select("statement", "best.licence", (-F.col("best.s")).alias("score"))


def file_licences(files: DataFrame, path_column: str = "path", text_column: str = "text") -> DataFrame:
    """One row per distinct path: path, licence, score, how (own, inherited, none), directory it came from.

    Rows that repeat a path are parts of one file. Equal statements are scored once, and the
    directories of files are looked up once each, so that neither a frequent statement nor a
    crowded directory is one task's work. Ties go to the first licence by name. Missing texts
    have no statements; rows without a path are left out, as they are in no directory. An empty
    table gives no rows; other columns are ignored.
    """
    rows = staged(read_once(files.select(F.col(path_column).alias("path"), F.col(text_column).alias("body")).where("path IS NOT NULL")), "licences")
    said = rows.select("path", F.explode("statements").alias("statement"))
    said = said.groupBy("path", "statement").agg(F.lit(1).alias("one")).drop("one")
    matched = match_statements(said.groupBy("statement").agg(F.lit(1).alias("one")).drop("one"))
    laid = staged(windows(rows), "windows")
    whole = laid.join(match_statements(laid.select("statement").distinct(), HEADERS, LEAST_HEADER), "statement")
    named = rows.select("path", F.explode("spdx").alias("given")).select("path", spdx_licence(F.col("given")).alias("licence"), F.lit(1.0).alias("score"))
    named = named.where("licence IS NOT NULL")
    kinds = [(named, 0), (whole, 0), (said.join(matched, "statement"), 1)]
    every = reduce(DataFrame.union, [t.select("path", F.struct(F.lit(k).alias("kind"), (-F.col("score")).alias("s"), "licence").alias("best")) for t, k in kinds])
    own = every.groupBy("path").agg(F.min("best").alias("best"))
    own = own.select("path", F.col("best.licence").alias("licence"), (-F.col("best.s")).alias("score"))

    here, name = F.regexp_extract("path", r"^(.*?)/?[^/]*$", 1), F.regexp_extract("path", r"[^/]*$", 0)
    given = own.where(name.rlike(LICENCE_FILE)).groupBy(here.alias("above")).agg(F.min(F.struct((-F.col("score")).alias("s"), "licence")).alias("best"))
    given = given.select("above", F.col("best.licence").alias("given"))
    places = rows.groupBy("path").agg(F.lit(1).alias("one")).select("path", here.alias("directory"))
    folders = places.groupBy("directory").agg(F.lit(1).alias("one")).drop("one")
    steps = F.split("directory", "/")
    upward = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda k: F.array_join(F.slice(steps, F.lit(1), k), "/"))
    climbed = folders.select("directory", F.posexplode(F.when(F.col("directory") == "", F.array(F.lit(""))).otherwise(upward)).alias("height", "above"))
    nearest = climbed.join(given, "above").groupBy("directory").agg(F.max(F.struct("height", "above", "given")).alias("near"))
    nearest = nearest.select("directory", F.col("near.above").alias("source"), F.col("near.given").alias("given"))
    out = places.join(own, "path", "left").join(nearest, "directory", "left")
    how = F.when(F.col("licence").isNotNull(), "own").when(F.col("given").isNotNull(), "inherited").otherwise("none")
    return out.select("path", F.coalesce("licence", "given").alias("licence"), "score", how.alias("how"), F.when(F.col("licence").isNull(), F.col("source")).alias("inherited_from"))
