"""Licence scans by the Dice coefficient over word bigrams (native: DataFrame functions only).

A text is cut at line ends and after sentence ends.  Each run of consecutive units is normalised (lower case, letters
and digits only) and its set of word bigrams compared with each template's, so wrapped notices, headers and bodies of
several sentences match as wholes.  A run of several units holds at most (2 - t) / t times the template's bigrams, repeats
counted; a single unit is bound by its distinct bigrams alone.  Of runs that overlap the nearest counts, at ties the one of fewer units,
then the earlier one.  Three exact prunings come first:

* size: with Dice >= t, a run has between t / (2 - t) and (2 - t) / t times the template's bigrams;
* anchors: a run that reaches t shares more than n * (2 - 2t) / (2 - t) fewer than all n bigrams of the template, so
  it holds one of any that many of them; texts without any anchor bigram can't match and are never cut;
* shared bigrams: a template of which a text holds fewer than t / (2 - t) of the bigrams is not compared, and a run begins and ends
  in units that hold a bigram of the template.

Templates are a literal array in the plan: no join, no shuffle.

Edge cases: a null or empty text has no unit and no match; runs of one word have no bigram and match nothing; ties
between licences all count; repeated rows are scanned separately; an empty table gives no rows; other columns are
ignored.
"""

from __future__ import annotations

import math
import re
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import only, read_table

DICE = 0.8
#: (licence, notice of one sentence); OP7_SQL compares these with single units
TEMPLATES = (
    ("agpl-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("apache-2.0", "This work is licensed under the Apache License, Version 2.0."),
    ("bsd-3-clause", "Released under the BSD 3-Clause License."),
    ("cc-by-4.0", "Licensed under CC BY 4.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("cc-by-nc-4.0", "Licensed under CC BY-NC 4.0."),
    ("cc-by-nc-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("cc-by-sa-4.0", "Licensed under CC BY-SA 4.0."),
    ("cc0-1.0", "Dedicated to the public domain under CC0 1.0."),
    ("gpl-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("gpl-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("lgpl-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("mit", "Released under the MIT License."),
    ("mit", "Licensed under the MIT License."),
    ("mpl-2.0", "This work is subject to the terms of the Mozilla Public License, Version 2.0."),
    ("proprietary", "All rights reserved."),
    ("proprietary", "All rights reserved, no part may be reproduced without permission."),
)
_GNU = (
    "This {what} is free software{colon} you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation{comma} "
    "either version {v} of the License, or (at your option) any later version. "
    "This {what} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. "
    "See the {name} for more details. You should have received a copy of the {name} along with this {what}{end}"
)
_GNU_SHORT = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the {name} as published by the Free Software Foundation, "
    "either version {v} of the License, or (at your option) any later version."
)
_WEB, _MAIL = ". If not, see <https://www.gnu.org/licenses/>.", "; if not, write to the Free Software Foundation, Inc., 51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA."
_GPL, _LGPL, _AGPL = ("GNU " + x + "General Public License" for x in ("", "Lesser ", "Affero "))
_BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: "
    "1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
    "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. "
)
_BSD_THIRD = "3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. "
_BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, '
    "THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. "
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES "
    "(INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, "
    "WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."
)
_MIT_GRANT = (
    'Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, '
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, "
    "subject to the following conditions: "
)
_MIT_END = (
    'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. '
    "IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE "
    "OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
#: (licence, header or body of several sentences)
TEXTS = (
    ("agpl-3.0", _GNU.format(what="program", colon=":", comma=",", name=_AGPL, v=3, end=_WEB)),
    ("agpl-3.0", _GNU_SHORT.format(name=_AGPL, v=3)),
    (
        "apache-2.0",
        'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 '
        'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. '
        "See the License for the specific language governing permissions and limitations under the License.",
    ),
    ("bsd-2-clause", _BSD + _BSD_END),
    ("bsd-3-clause", _BSD + _BSD_THIRD + _BSD_END),
    ("gpl-2.0", _GNU.format(what="program", colon=";", comma=";", name=_GPL, v=2, end=_MAIL)),
    ("gpl-2.0", _GNU.format(what="program", colon=";", comma=";", name=_GPL, v=2, end=_WEB)),
    ("gpl-2.0", _GNU_SHORT.format(name=_GPL, v=2)),
    ("gpl-3.0", _GNU.format(what="program", colon=":", comma=",", name=_GPL, v=3, end=_WEB)),
    ("gpl-3.0", _GNU_SHORT.format(name=_GPL, v=3)),
    (
        "isc",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. "
        'THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. '
        "IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, "
        "WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    ),
    ("lgpl-2.1", _GNU.format(what="library", colon=";", comma=";", name=_LGPL, v="2.1", end=_MAIL)),
    ("lgpl-3.0", _GNU.format(what="program", colon=":", comma=",", name=_LGPL, v=3, end=_WEB)),
    ("lgpl-3.0", _GNU_SHORT.format(name=_LGPL, v=3)),
    ("mit", _MIT_GRANT + "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. " + _MIT_END),
    ("mit", _MIT_GRANT),
    (
        "mpl-2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    ),
    (
        "unlicense",
        "This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, "
        "either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    ),
)
_JUNK = r"[^\p{L}\p{N}]+"


def normalise(text: str) -> list[str]:
    return re.findall(r"[a-z0-9]+", text.lower())


def _templates(templates: tuple, least: float) -> list[tuple[str, list[str], int, int]]:
    out = []
    for name, text in templates:
        w = normalise(text)
        grams = sorted({f"{a} {b}" for a, b in zip(w, w[1:])})
        n = len(grams)
        out.append((name, grams, math.ceil(n * least / (2 - least) - 1e-9), math.floor(n * (2 - least) / least + 1e-9)))
    return out


def anchors(templates: tuple = TEMPLATES, least: float = DICE) -> list[str]:
    """For each template, so many of its bigrams that a matching unit has one: the ones that fewest templates share."""
    t = _templates(templates, least)
    spread = Counter(g for _, grams, _, _ in t for g in grams)
    out: set[str] = set()
    for _, grams, _, _ in t:
        need = math.floor(len(grams) * (2 - 2 * least) / (2 - least) + 1e-9) + 1
        out |= set(sorted(grams, key=lambda g: (spread[g], -len(g), g))[:need])
    return sorted(out)


def _pattern(phrases: list[str]) -> str:
    """These phrases at word beginnings, as a tree by letters: at most places of a text one look at a letter fails."""
    tree: dict = {}
    for p in phrases:
        at = tree
        for c in p:
            at = at.setdefault(c, {})
        at[""] = {}

    def text(at: dict) -> str:
        if "" in at or not at:
            return ""
        each = [(_JUNK if c == " " else c) + text(x) for c, x in sorted(at.items())]
        return each[0] if len(each) == 1 else f"(?:{'|'.join(each)})"

    return "(?<![a-z0-9])" + text(tree)


def _units(text: Column) -> Column:
    return F.split(F.regexp_replace(text, r"([.!?])[\x20\x09-\x0D]+", "$1\n"), "\n", -1)


def scan(docs: DataFrame, templates: tuple = TEMPLATES + TEXTS, least: float = DICE) -> DataFrame:
    """doc_id and `found`: array of (dice, licence, unit), for each run of units, given by its first, the licences that come nearest if they reach the coefficient."""
    d = only(docs, doc_id="long", text="string")
    rows = _templates(templates, least)
    most = [math.floor((len(normalise(text)) - 1) * (2 - least) / least + 1e-9) for _, text in templates]
    words = lambda x: f"array({', '.join(map(repr, x))})"
    table = F.expr("array(" + ", ".join(f"named_struct('licence', {n!r}, 'g', {words(g)}, 'lo', {lo}, 'hi', {hi}, 'most', {k})" for (n, g, lo, hi), k in zip(rows, most, strict=True)) + ")")
    every = F.expr(words(sorted({x for _, g, _, _ in rows for x in g})))
    units = F.transform(
        _units(F.lower("text")),
        lambda u, i: F.struct(i.alias("unit"), F.filter(F.split(F.regexp_replace(u, _JUNK, " "), " ", -1), lambda x: x != "").alias("w")),
    )
    s = d.select("doc_id", F.when(F.lower("text").rlike(_pattern(anchors(templates, least))), F.filter(units, lambda u: F.size(u["w"]) > 0)).alias("units"))
    # words before each unit, and all bigrams by the place of their first word
    s = s.select("doc_id", F.col("units.unit").alias("unit"), F.flatten("units.w").alias("w"), F.aggregate("units", F.array(F.lit(0)), lambda a, u: F.concat(a, F.array(F.element_at(a, -1) + F.size(u["w"])))).alias("off"))
    s = s.select("doc_id", "unit", "off", F.when(F.size("w") > 1, F.transform(F.sequence(F.lit(0), F.size("w") - 2), lambda i: F.concat(F.get("w", i), F.lit(" "), F.get("w", i + 1)))).alias("g"))
    s = s.select("*", F.array_intersect("g", every).alias("held"))
    s = s.select("doc_id", "unit", "off", "g", F.filter(table, lambda t: F.size(F.array_intersect("held", t["g"])) >= t["lo"]).alias("live"))
    off = lambda i: F.get("off", i)
    between = lambda a, z: F.slice("g", a + 1, F.greatest(z - a, F.lit(0)))  # noqa: E731  bigrams whose first words are a to z - 1
    last = F.size("unit") - 1

    def dice(t: Column, i: Column, j: Column) -> Column:
        each = F.transform(F.array(F.array_distinct(between(off(i), off(j + 1) - 1))), lambda g: F.when(F.size(g).between(t["lo"], t["hi"]), 2.0 * F.size(F.array_intersect(g, t["g"])) / (F.size(g) + F.size(t["g"]))).otherwise(0.0))
        return F.get(each, F.lit(0))

    def runs(t: Column) -> Column:
        begins = F.filter(F.sequence(F.lit(0), last), lambda i: F.arrays_overlap(between(off(i), off(i + 1)), t["g"]))
        ends = lambda i: F.filter(F.sequence(i, F.least(i + t["most"], last)), lambda j: (i == j) | (off(j + 1) - off(i) - 1).between(t["lo"], t["most"]))
        near = lambda i: F.transform(ends(i), lambda j: F.struct((-dice(t, i, j)).alias("far"), (j - i).alias("more"), i.alias("i"), t["licence"].alias("licence")))
        return F.filter(F.flatten(F.transform(begins, near)), lambda x: x["far"] <= -least)

    s = s.select("doc_id", "unit", F.array_sort(F.array_distinct(F.flatten(F.transform("live", runs)))).alias("near"))
    same = lambda a, b: (a["i"] == b["i"]) & (a["more"] == b["more"]) & (a["far"] == b["far"])
    apart = lambda a, b: (a["i"] + a["more"] < b["i"]) | (b["i"] + b["more"] < a["i"])
    none = "cast(array() as array<struct<{}>>)".format
    kept = F.aggregate("near", F.expr(none("far:double,more:int,i:int,licence:string")), lambda a, x: F.when(F.forall(a, lambda y: apart(x, y) | same(x, y)), F.concat(a, F.array(x))).otherwise(a))
    found = F.transform(kept, lambda x: F.struct((-x["far"]).alias("dice"), x["licence"].alias("licence"), F.get("unit", x["i"]).alias("unit")))
    return s.select("doc_id", F.coalesce(found, F.expr(none("dice:double,licence:string,unit:int"))).alias("found"))


def op7_dice_licences(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scan(read_table(spark, sf_dir, "documents"))
    return s.select(
        "doc_id",
        F.size("found").cast("long").alias("n_matches"),
        F.array_join(F.array_sort(F.array_distinct(F.col("found.licence"))), ",").alias("licences"),
        F.round(F.coalesce(F.array_max(F.col("found.dice")), F.lit(0.0)), 6).alias("best_dice"),
    )


def op7_sql(templates: tuple = TEMPLATES, least: float = DICE) -> str:
    rows = ",\n".join(f"({k}, '{n}', {len(g)}, [{', '.join(repr(x) for x in g)}])" for k, (n, g, _, _) in enumerate(_templates(templates, least)))
    return rf"""
with t(k, licence, n, grams) as (values {rows}),
units as (select doc_id, unnest(string_split(regexp_replace(lower(text), '([.!?])[\x20\x09-\x0D]+', '\1' || chr(10), 'g'), chr(10))) as u from documents where text is not null),
numbered as (select row_number() over () as uid, doc_id, list_filter(string_split(regexp_replace(u, '[^\p{{L}}\p{{N}}]+', ' ', 'g'), ' '), lambda x: x <> '') as w from units),
grams as (select uid, doc_id, list_distinct(list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as g from numbered where len(w) between 2 and 60),
scored as (
  select g.doc_id, g.uid, t.licence, max(2.0 * len(list_intersect(g.g, t.grams)) / (len(g.g) + t.n)) as dice
  from grams g join t on len(g.g) between t.n * {least} / (2 - {least}) - 1e-9 and t.n * (2 - {least}) / {least} + 1e-9
  group by all),
hits as (select * from scored where dice >= {least} qualify rank() over (partition by uid order by dice desc) = 1),
found as (select doc_id, count(*) as n_matches, string_agg(distinct licence, ',' order by licence) as licences, round(max(dice), 6) as best_dice from hits group by doc_id)
select d.doc_id, coalesce(f.n_matches, 0)::bigint as n_matches, coalesce(f.licences, '') as licences, coalesce(f.best_dice, 0.0)::double as best_dice
from documents d left join found f using (doc_id)
"""


OP7_SQL = op7_sql()
