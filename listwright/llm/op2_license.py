"""License scans.

Method: a text that names a license is taken apart at five levels, comment marks left out: its lines and sentences, the
sentences with their line breaks joined, its paragraphs, its comment blocks, and the whole file. Those that name a license are its
license units; each gets a TF-IDF vector, with document frequencies counted over all units of all files, and its cosine to
the notices, whole license headers and whole license texts of templates() (sparse: only shared terms are multiplied). A wrapped
header is thus compared as a whole, and versions and families differ by the terms that only one template has. What a license's name
says must agree as well: its version stands in the unit, so do its restrictions and no others, and "or later" only where the
license has it. A file's own license is its best unit's, if the cosine is MIN_COSINE or more; licenses has the best ones of all units
with MANY or more, so that a choice of licenses is seen (parts of an SPDX expression are units). n_units counts lines and sentences. A file that is mostly license
text (by its lines, or as the whole file is like a template), or is named like one, is its directory's license file. A file without
a license of its own inherits from the nearest directory above it that has a license file, by joins on paths.

Broadcast are the templates' terms alone (under 20,000 rows). Skew: directories are made distinct before their ancestors are
listed, and the table of directories' licenses is written before it is joined to the files, so a directory with very many files is a skewed
sort-merge join that adaptive execution splits.

Edge cases: a null or empty text has no units; a null path has no directory and inherits nothing. Keys may be null or repeated: a file is
its key, path and text, and has its own units. Of equally good licenses the first by
name wins; of several license files of a directory the best. Repeated rows are returned each. Texts are read whole;
only those that name a license are taken apart. AGPL-3.0 has no whole text here; its file is known by title and header. Other columns are not read; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import pkgutil
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from listwright.session import shared_table

MIN_COSINE, MANY, FILE_SHARE = 0.5, 0.7, 0.3

_FREE = "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; either version {2} of the License, or (at your option) any later version."
_REST = " This {0} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {1}General Public License for more details. You should have received a copy of the GNU {1}General Public License along with this {0}."
_AS_IS = 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.'
_BSD_2 = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
_BSD_3 = " 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_MIT = 'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:'
_MIT_REST = ' The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.'
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_ISC_REST = ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.'
_APACHE = "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0"
_APACHE_REST = ' Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.'
_ONLY = ("This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License version {2} as published by the Free Software Foundation.", "This {0} is free software; you can redistribute it and/or modify it under the terms of the GNU {1}General Public License as published by the Free Software Foundation; version {2} of the License.")
#: License, word for the work, family and version of the headers of the GNU licenses.
_GNU = [("GPL-1.0", "program", "", "1"), ("GPL-2.0", "program", "", "2"), ("GPL-3.0", "program", "", "3"), ("LGPL-2.0", "library", "Library ", "2"), ("LGPL-2.1", "library", "Lesser ", "2.1"), ("LGPL-3.0", "library", "Lesser ", "3"), ("LGPL-3.0", "program", "Lesser ", "3"), ("AGPL-3.0", "program", "Affero ", "3")]

#: Short notices, header sentences and whole headers of public licenses.
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-1.0-or-later", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License"),
    ("LGPL-2.0", "Licensed under the GNU Library General Public License, version 2."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", "GNU Affero General Public License Version 3, 19 November 2007"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("BSD-3-Clause", "Redistribution and use in source and binary forms, with or without modification, are permitted under the BSD License"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted. ISC License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0. Creative Commons Attribution 4.0 International License"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("Apache-1.1", "Licensed under the Apache License, Version 1.1"),
    ("Apache-1.1", "The Apache Software License, Version 1.1"),
    ("CC0-1.0", "Dedicated to the public domain under CC0 1.0 Universal."),
    ("Unlicense", "This is free and unencumbered software released into the public domain. Unlicense"),
    ("Apache-2.0", _APACHE), ("Apache-2.0", _APACHE + _APACHE_REST),
    ("MIT", _MIT), ("MIT", _MIT + _MIT_REST), ("ISC", _ISC), ("ISC", _ISC + _ISC_REST),
    ("BSD-2-Clause", f"{_BSD_2} {_AS_IS}"), ("BSD-3-Clause", f"{_BSD_2}{_BSD_3} {_AS_IS}"), ("BSD-2-Clause", _BSD_2), ("BSD-3-Clause", _BSD_2 + _BSD_3),
    *((name, text.format(*rest)) for name, *rest in _GNU for text in (_FREE, _FREE + _REST)),
    *((f"{name}-only", text.format(*rest)) for name, *rest in _GNU if name != "GPL-1.0" for text in _ONLY),
    *((x.split()[0], f"SPDX-License-Identifier: {x.split()[-1]}") for x in "Apache-2.0|MIT|GPL-2.0-only|GPL-2.0 GPL-2.0-or-later|GPL-3.0-only|GPL-3.0 GPL-3.0-or-later|LGPL-2.0 LGPL-2.0-or-later|LGPL-2.1-only|LGPL-2.1 LGPL-2.1-or-later|LGPL-3.0-only|LGPL-3.0 LGPL-3.0-or-later|AGPL-3.0-only|AGPL-3.0 AGPL-3.0-or-later|MPL-2.0|BSD-2-Clause|BSD-3-Clause|ISC|CC-BY-4.0|CC-BY-SA-4.0|CC-BY-NC-4.0|CC-BY-ND-4.0|CC-BY-NC-SA-4.0|CC-BY-NC-ND-4.0|Apache-1.1|CC0-1.0|Unlicense".split("|")),
]
TRIGGER = r"(?i)licen[cs]e|permission is hereby|permission to use|public domain|redistribut"
TERM = r"[a-z0-9]+(?:\.[0-9]+)*"
FILE_NAME = r"(?i)(?:^|/)(?:licen[cs]e|copying|unlicense|notice)(?:[.\-_][^/]*)?$"


#: What begins or ends a commented line, and runs of commented lines.
MARK = r"(?m)^[ \t]*(?:/\*+|\*+/?|//+[/!]?|#+|;+|--+|<!--|%+|\"\"\"|'{3}|dnl\b|@?rem\b)?[ \t]*|[ \t]*(?:\*+/|-->|\"\"\"|'{3})?[ \t\r]*$"
BLOCK = r"(?m)/\*(?s:.*?)\*/|<!--(?s:.*?)-->|(?:^[ \t]*+(?://|#|;|--|%|\*|dnl\b)[^\n]*+\n?+)++"


def templates() -> list[tuple[str, str]]:
    """The notices and headers of TEMPLATES, and whole license texts."""
    return TEMPLATES + list(json.loads(pkgutil.get_data(__package__, "licenses.json")).items())


#: Restrictions in a license's name, and how texts write them.
RESTRICTIONS = {"NC": ["nc", "noncommercial"], "ND": ["nd", "noderivatives", "noderivs"], "SA": ["sa", "sharealike"]}
#: A version of its own stands in the names of these.
VERSIONED = re.compile(r"(?:[AL]?GPL|Apache|MPL|CC0|CC)\b.*?-([0-9]+(?:\.[1-9])?)")
EXPRESSION = r"(?i)(spdx-license-identifier:\s*)(.*)"


def rule(name: str, text: str) -> tuple[list[list[str]], list[str]]:
    """(lists of which a unit must have a term each, terms that it must not have) for a template."""
    need, bar = [], []
    gnu = "GPL" in name
    if name == "GPL-1.0-or-later":
        return [], ["version"]
    if m := VERSIONED.match(name):
        need.append([m[1]])
    if name.startswith("CC-BY"):
        for mark, words in RESTRICTIONS.items():
            need, bar = ([*need, words], bar) if f"-{mark}" in name else (need, [*bar, *words])
    if gnu and name.endswith("-only"):
        bar = ["later"]
    elif gnu and "later version" in text and len(text) < 1200:
        need.append(["later"])
    return need, bar


#: Level of the whole file in units().
WHOLE = 4


def terms(c: Column) -> Column:
    """Words and versions, of which "v2" and "version 2.0" are the same."""
    c = F.regexp_replace(F.lower(c), r"(?:\b|(?<=gpl))v(?:er)?\.?\s*(?=[0-9])", " version ")
    return F.regexp_extract_all(F.regexp_replace(c, r"(?<=[0-9])\.0(?!\.?[0-9])", ""), F.lit(TERM), F.lit(0))


def units(files: DataFrame) -> DataFrame:
    """key, rid, level, unit (number in the text), terms: the license units of each text (key, rid, text)."""
    named = lambda parts: F.filter(parts, lambda p: p.rlike(TRIGGER))
    said = lambda p, k: F.regexp_extract(p, EXPRESSION, k)
    each = lambda p: F.when(p.rlike(EXPRESSION), F.transform(F.split(said(p, 2), r"(?i)\s+(?:or|and)\s+|[()]"), lambda x: F.concat(said(p, 1), x))).otherwise(F.array(p))
    bare = F.regexp_replace("text", MARK, "")
    paragraphs = named(F.split("bare", r"\n\s*\n"))
    sentences = F.flatten(F.transform("paragraphs", lambda p: named(F.split(p, r"(?<=[.!?])\s+"))))
    levels = [F.flatten(F.transform(named(F.split("text", r"\n|(?<=[.!?])\s+")), each)), sentences, F.col("paragraphs"), named(F.regexp_extract_all("text", F.lit(BLOCK), F.lit(0))), F.array("bare")]
    found = files.where(F.col("text").rlike(TRIGGER)).withColumn("bare", bare).withColumn("paragraphs", paragraphs)
    found = found.select("key", "rid", F.posexplode(F.array(*levels)).alias("level", "parts")).select("key", "rid", "level", F.posexplode("parts").alias("unit", "line"))
    return found.select("key", "rid", "level", "unit", terms(F.col("line")).alias("terms"))


def scan(files: DataFrame, key: str, path: str, text: str) -> DataFrame:
    """key, path, own_license, own_score, n_units, is_license_file, inherited_license, license_dir, license, licenses of each file."""
    spark = files.sparkSession
    base = files.select(F.col(key).alias("key"), F.col(path).alias("path"), F.col(text).alias("text"))
    # a file is its key, path and text: keys may be null or repeated
    base = base.withColumn("rid", F.when(F.col("text").rlike(TRIGGER), F.xxhash64("key", "path", "text")))
    same = lambda a, b: a["key"].eqNullSafe(b["_key"]) & (a["rid"] == b["_rid"])
    unit = shared_table(units(base).withColumn("id", F.xxhash64("key", "rid", "level", "unit", "terms")).dropDuplicates(["key", "rid", "level", "unit", "id"]), "units")
    one = unit.select("key", "rid", "level", "unit", "id", F.explode("terms").alias("term")).groupBy("key", "rid", "level", "unit", "id", "term").agg(F.count("*").alias("tf"))
    one = shared_table(one, "terms")
    n = unit.count()

    # document frequencies of the templates' terms over all units; a term of no template weighs as one that no other unit has
    known = templates()
    rules = [(k, *rule(*t)) for k, t in enumerate(known)]
    named_terms = sorted({t for _, need, bar in rules for t in [*bar, *(x for xs in need for x in xs)]})
    rules = F.broadcast(spark.createDataFrame(rules, "template int, need array<array<string>>, bar array<string>"))  # a row for each template
    model = spark.createDataFrame([(k, lic, t) for k, (lic, t) in enumerate(known)], "template int, name string, notice string")
    model = model.select("template", "name", F.explode(terms(F.col("notice"))).alias("term")).groupBy("template", "name", "term").agg(F.count("*").alias("ttf"))
    vocabulary = F.broadcast(model.select("term").distinct())
    df = one.join(vocabulary, "term").groupBy("term").agg(F.count("*").alias("df"))
    weight = lambda df: F.log((1 + F.lit(n)) / (1 + F.coalesce(df, F.lit(0)))) + 1
    model = model.join(df, "term", "left").withColumn("tw", F.col("ttf") * weight(F.col("df")))
    model = model.join(model.groupBy("template").agg(F.sqrt(F.sum(F.col("tw") ** 2)).alias("tnorm")), "template")
    model = shared_table(model.select("template", "name", "term", "df", (F.col("tw") / F.col("tnorm")).alias("tw")), "templates")
    idf = F.broadcast(model.select("term", "df").distinct())
    weighed = one.join(idf, "term", "left").withColumn("w", F.col("tf") * weight(F.col("df")))
    norm = weighed.groupBy("key", "rid", "level", "unit", "id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"), F.collect_list(F.when(F.col("df").isNotNull(), F.struct("term", "w"))).alias("known"), F.collect_list(F.when(F.col("term").isin(named_terms), F.col("term"))).alias("has"))
    cosine = norm.select("key", "rid", "level", "unit", "id", "norm", "has", F.explode("known").alias("k")).join(F.broadcast(model), F.col("k.term") == F.col("term"))
    cosine = cosine.groupBy("key", "rid", "level", "unit", "id", "template", "name").agg(F.round(F.sum(F.col("k.w") * F.col("tw")) / F.first("norm"), 6).alias("cos"), F.first("has").alias("has"))
    agrees = F.forall("need", lambda x: F.arrays_overlap(x, F.col("has"))) & ~F.arrays_overlap("bar", F.col("has"))
    cosine = cosine.where(F.col("cos") >= MIN_COSINE).join(rules, "template").where(agrees)
    of_unit = cosine.groupBy("key", "rid", "level", "unit", "id").agg(F.min(F.struct((-F.col("cos")).alias("c"), "name")).alias("best"))
    best = of_unit.groupBy("key", "rid").agg(F.min("best").alias("best"), F.collect_set(F.when(F.col("best.c") <= -MANY, F.col("best.name"))).alias("strong"), F.max(F.col("level") == WHOLE).alias("whole"))
    every = F.array_distinct(F.concat(F.array("best.name"), "strong"))
    every = F.when(F.exists(every, lambda x: x.contains("GPL") & (x != "GPL-1.0-or-later")), F.array_remove(every, "GPL-1.0-or-later")).otherwise(every)
    best = best.select(F.col("key").alias("_key"), F.col("rid").alias("_rid"), F.col("best.name").alias("own_license"), (-F.col("best.c")).alias("own_score"), F.array_sort(every).alias("licenses"), "whole")
    sizes = unit.where("level = 0").groupBy("key", "rid").agg(F.count("*").alias("n_units"), F.sum(F.size("terms")).alias("unit_terms"))
    found = shared_table(sizes.join(best, same(sizes, best), "left").drop("_key", "_rid").withColumnsRenamed({"key": "_key", "rid": "_rid"}), "found")

    files_ = base.withColumn("n_terms", F.when(F.col("text").rlike(TRIGGER), F.size(terms(F.col("text")))).otherwise(0)).drop("text")
    files_ = files_.withColumn("dir", F.when(F.col("path").contains("/"), F.regexp_replace("path", "/[^/]*$", "")).otherwise(F.when(F.col("path").isNotNull(), F.lit(""))))
    files_ = files_.join(found, same(files_, found), "left").drop("rid", "_key", "_rid")
    named = F.col("path").rlike(FILE_NAME) | F.col("whole") | (F.col("unit_terms") >= FILE_SHARE * F.col("n_terms"))
    files_ = shared_table(files_.withColumn("is_license_file", F.coalesce(named & F.col("own_license").isNotNull(), F.lit(False))), "files")

    licensed = files_.where("is_license_file and dir is not null").groupBy("dir").agg(F.min(F.struct((-F.col("own_score")).alias("s"), F.col("own_license").alias("name"))).alias("x")).select(F.col("dir").alias("up"), F.col("x.name").alias("name"))
    licensed = shared_table(licensed, "licensed")
    steps = F.transform(F.sequence(F.lit(0), F.size(F.split("dir", "/"))), lambda k: F.array_join(F.slice(F.split("dir", "/"), 1, k), "/"))
    above = files_.where("dir is not null").select("dir").distinct().select("dir", F.posexplode(steps).alias("depth", "up"))
    nearest = above.join(licensed, "up").groupBy("dir").agg(F.max(F.struct("depth", "up", "name")).alias("x"))
    nearest = shared_table(nearest.select("dir", F.col("x.up").alias("license_dir"), F.col("x.name").alias("inherited")), "nearest")
    out = files_.join(nearest, "dir", "left")
    gone = F.when(F.col("own_license").isNull(), F.col("inherited"))
    return out.select("key", "path", "own_license", "own_score", F.coalesce("n_units", F.lit(0)).cast("long").alias("n_units"), "is_license_file", gone.alias("inherited_license"), F.when(gone.isNotNull(), F.col("license_dir")).alias("license_dir"), F.coalesce("own_license", gone).alias("license"), F.coalesce("licenses", F.when(gone.isNotNull(), F.array(gone))).alias("licenses"))
