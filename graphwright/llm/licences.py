"""Licence recognition by sentence rules, with DataFrame functions only.

A text is cut into sentences, each normalised to its letters and digits. Sentences that
licences are known for have identifiers; what a text has of them, in order, is matched against
rules, each the identifiers of one licence text or notice. Rules are tried in order, longer and more specific ones
first, and a rule takes the identifiers it matches, so that none counts twice. Rules and sentences
are a fixed small table within the expression: nothing is joined, shuffled or exploded.

Lines of a paragraph are joined, without the marks of comments, so that wrapped licence files and headers are read like texts of one line.
"""

from __future__ import annotations

import re
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Licence texts and notices. The known sentences are theirs, cut and normalised like those of any text.
TEXTS: dict[str, str] = {
    "Apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.
You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and limitations under the License.""",
    "MIT": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.""",
    "BSD-3-Clause": """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.

3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.

THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.""",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.""",
    "GPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.""",
    "GPL-2.0": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.

This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU General Public License for more details.

You should have received a copy of the GNU General Public License along with this program.""",
    "LGPL-3.0": """This library is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

See the GNU Lesser General Public License for more details.""",
    "LGPL-2.1": """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.

See the GNU Lesser General Public License for more details.""",
    "AGPL-3.0": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.

See the GNU Affero General Public License for more details.""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.""",
    "Unlicense": """This is free and unencumbered software released into the public domain.

Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.""",
    "Zlib": """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.

Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:""",
    "BSL-1.0": """Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:""",
    "CC0-1.0": """To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.""",
}
# Other forms of them.
FORMS: list[tuple[str, str]] = [
    ("GPL-3.0", """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."""),
    ("LGPL-3.0", """This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 3 of the License, or (at your option) any later version."""),
]

# Names of licences as notices of one sentence give them, normalised.
NAMES: dict[str, list[str]] = {
    "Apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache 2 0"],
    "MIT": ["mit license", "mit"],
    "BSD-2-Clause": ["bsd 2 clause license", "2 clause bsd license", "simplified bsd license", "bsd 2 clause"],
    "BSD-3-Clause": ["bsd 3 clause license", "3 clause bsd license", "new bsd license", "bsd license", "bsd 3 clause"],
    "ISC": ["isc license", "isc"],
    "Zlib": ["zlib license", "zlib"],
    "BSL-1.0": ["boost software license version 1 0", "boost software license 1 0", "bsl 1 0"],
    "Unlicense": ["unlicense"],
    "GPL-2.0": ["gnu general public license version 2", "gnu general public license v2", "gnu gpl version 2", "gpl v2", "gplv2", "gpl 2 0", "gpl 2 0 only", "gpl 2 0 or later"],
    "GPL-3.0": ["gnu general public license version 3", "gnu general public license v3", "gnu gpl version 3", "gpl v3", "gplv3", "gpl 3 0", "gpl 3 0 only", "gpl 3 0 or later"],
    "LGPL-2.1": ["gnu lesser general public license version 2 1", "lgpl v2 1", "lgplv2 1", "lgpl 2 1", "lgpl 2 1 only", "lgpl 2 1 or later"],
    "LGPL-3.0": ["gnu lesser general public license version 3", "lgpl v3", "lgplv3", "lgpl 3 0", "lgpl 3 0 only", "lgpl 3 0 or later"],
    "AGPL-3.0": ["gnu affero general public license version 3", "agpl v3", "agplv3", "agpl 3 0", "agpl 3 0 only", "agpl 3 0 or later"],
    "MPL-2.0": ["mozilla public license version 2 0", "mozilla public license 2 0", "mozilla public license v 2 0", "mpl 2 0"],
    "CC0-1.0": ["cc0 1 0", "cc0", "creative commons zero"],
    "CC-BY-4.0": ["cc by 4 0", "creative commons attribution 4 0 international license", "creative commons attribution 4 0 license"],
    "CC-BY-SA-4.0": ["cc by sa 4 0", "creative commons attribution sharealike 4 0 international license"],
    "CC-BY-NC-4.0": ["cc by nc 4 0", "creative commons attribution noncommercial 4 0 international license"],
    "CC-BY-ND-4.0": ["cc by nd 4 0", "creative commons attribution noderivatives 4 0 international license"],
    "CC-BY-NC-SA-4.0": ["cc by nc sa 4 0", "creative commons attribution noncommercial sharealike 4 0 international license"],
    "CC-BY-NC-ND-4.0": ["cc by nc nd 4 0", "creative commons attribution noncommercial noderivatives 4 0 international license"],
}

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Stands for the end of a sentence.
END = "\x01"
# How a lower-cased text is cut, as patterns that Java, RE2 and Python read alike, and what takes their place (\1 is a group).
CUTS: list[tuple[str, str]] = [
    ("\r\n?", "\n"),
    # marks of comments
    (r"(?m)^[ \t]*(//+!?|/\*+!?|\*+/|\*+|#+!?|--+|;+|%+|<!--|dnl )[ \t]*", ""),
    # an address on a line of its own belongs to the sentence before it
    (r"( at:?)[ \t]*\n([ \t]*\n)*[ \t]*(https?://)", r"\1 \3"),
    # items of lists, lines of copyright, titles, tags
    (r"(?m)^[ \t]*\(?([0-9]{1,2}|[a-z])[.)][ \t]+", END),
    (r"(?m)^[ \t]*(copyright[ \t]+(\(c\)|©|[0-9]{4}|by )[^\n]*)$", END + r"\1" + END),
    (r"(?m)^[ \t]*((the )?(mit|isc|zlib|boost software|mozilla public|apache|(new |simplified )?bsd( [0-9]-clause)?|[0-9]-clause bsd)( software)? licen[sc]e( \([a-z0-9 -]+\))?,?( v(ersion|\.)? ?[0-9.]+)?)[ \t]*$", END + r"\1" + END),
    (r"spdx-license-identifier:[ \t]*([^\n*]*)", END + r"spdx license identifier \1" + END),
    (r"(?m)^[ \t]*licen[sc]e:[ \t]*([^\n]*)$", END + r"license \1" + END),
    (r"( v)\.[ \t\n]+([0-9])", r"\1 \2"),
    (r"\n[ \t]*\n", END),
    (r"([.!?;:])[ \t\n]+", r"\1" + END),
]
# Beginnings of normalised sentences that vary, and what stands for them.
SLOTS: list[tuple[str, str]] = [
    ("^((this|the) (work|file|software|project|program|code|document|text|content|data) is )?(dual )?(licensed|released|distributed|available|published|made available|provided) under (the )?(terms of )?(the )?|^spdx license identifier |^licen[sc]e ", "under "),
    ("^neither the name of .* nor the names of (its|the|their) contributors ", "neither the name of x nor the names of its contributors "),
    ("^this software is provided by .* as is and any ", "this software is provided by x as is and any "),
    ("^in no event shall .* be liable for any ", "in no event shall x be liable for any "),
]
#: Every known sentence has one of these in its text; texts without them have no known sentence and are cut no further.
KEYWORDS = "licen|under|software|redistribut|permission|warrant|anyone|mpl|copyright"


def cut(text: str) -> list[str]:
    """A text's sentences, normalised, as plain Python; for the tables."""
    text = text.translate(str.maketrans(UPPER, LOWER))
    for pattern, to in CUTS:
        text = re.sub(pattern, to, text)
    out = []
    for s in text.split(END):
        s = re.sub("[^a-z0-9]+", " ", s).strip(" ")
        for pattern, to in SLOTS:
            s = re.sub(pattern, to, s)
        if s:
            out.append(s)
    return out


def tables() -> tuple[dict[str, int], list[tuple[str, list[int]]]]:
    """Identifiers of sentences, and the rules in order: (licence, identifiers)."""
    known: dict[str, int] = {}
    texts = [(licence, [known.setdefault(s, len(known) + 1) for s in cut(text)]) for licence, text in [*TEXTS.items(), *FORMS]]
    rules, of = list(texts), dict(reversed(texts))
    # without the clause on names, the three sentences before it are another licence's
    rules += [("BSD-3-Clause", of["BSD-3-Clause"][:4]), ("BSD-2-Clause", of["BSD-3-Clause"][:3])]
    own = {i for _, ids in texts for i in ids if len({licence for licence, other in texts if i in other}) == 1}
    for licence, ids in texts:  # licence texts and notices are often cut: two sentences that follow each other tell, if one is the licence's own
        rules += [(licence, ids[i : i + 2]) for i in range(len(ids) - 1) if licence != "BSD-3-Clause" and own & set(ids[i : i + 2])]
    for licence, names in NAMES.items():
        rules += [(licence, [known.setdefault(f"under {name}", len(known) + 1)]) for name in names]
    # a sentence that names its licence, or stands in no other, tells alone
    for licence, k in {"Apache-2.0": 0, "MPL-2.0": 0, "Unlicense": 0, "CC0-1.0": 0, "BSL-1.0": 0, "GPL-2.0": 2, "LGPL-2.1": 2, "GPL-3.0": 1, "LGPL-3.0": 1, "AGPL-3.0": 1}.items():
        rules.append((licence, [of[licence][k]]))
    return known, rules


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` of a value that is computed once, however often it stands in there."""
    return F.element_at(F.transform(F.array(value), body), 1)


def sentences(text: Column) -> Column:
    """array<string>: a text's sentences, normalised; those without letters or digits are left out.

    A sentence ends at . ! ? : or ; before white space, at a blank line, and around list items, copyright lines, titles and licence tags. ASCII letters are
    lower-cased, every run of anything but ASCII letters and digits is one blank, and a beginning like "Licensed under the" is `under`.
    """
    marked = F.translate(F.coalesce(text, F.lit("")), UPPER, LOWER)
    for pattern, to in CUTS:
        # Java knows more line ends than \n unless told so
        marked = F.regexp_replace(marked, pattern.replace("(?m)", "(?md)"), re.sub(r"\\([0-9])", r"$\1", to))

    def plain(s: Column) -> Column:
        s = F.trim(F.regexp_replace(s, "[^a-z0-9]+", " "))
        for pattern, to in SLOTS:
            s = F.regexp_replace(s, pattern, to)
        return s

    return F.filter(F.transform(F.split(marked, END), plain), lambda s: s != "")


def recognise(text: Column) -> Column:
    """struct<sentence_ids array<int>, licences array<string>>: the known sentences of a text in order, and the licences whose rules match, sorted.

    A null or empty text has none. Sentences that repeat are listed at each place; a licence is listed once.
    """
    known, rules = tables()
    numbers = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    table = F.array(*[F.struct(F.lit(licence).alias("licence"), F.lit(",".join(f"<{i}>" for i in rule)).alias("rule")) for licence, rule in rules])
    none = F.struct(F.array().cast("array<int>").alias("sentence_ids"), F.array().cast("array<string>").alias("licences"))

    def matched(ids: Column) -> Column:
        marked = F.concat(F.lit(","), F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i.cast("string"), F.lit(">"))), ","), F.lit(","))
        start = F.struct(marked.alias("left"), F.array().cast("array<string>").alias("found"))
        step = lambda so_far, r: F.when(
            F.contains(so_far["left"], r["rule"]),
            F.struct(F.replace(so_far["left"], r["rule"], F.lit("-")).alias("left"), F.concat(so_far["found"], F.array(r["licence"])).alias("found")),
        ).otherwise(so_far)
        found = F.aggregate(table, start, step)["found"]
        return F.when(F.size(ids) > 0, F.struct(ids.alias("sentence_ids"), F.array_sort(F.array_distinct(found)).alias("licences"))).otherwise(none)

    ids = F.filter(F.transform(sentences(text), lambda s: F.element_at(numbers, s)), lambda i: i.isNotNull())
    return F.when(F.coalesce(F.rlike(text, F.lit("(?i)" + KEYWORDS)), F.lit(False)), _let(ids, matched)).otherwise(none)


def scan(docs: DataFrame, text_column: str = "text", out: str = "licence") -> DataFrame:
    """`docs` with the struct of `recognise` as column `out`, which replaces one of its name.

    Every row stays, repeated ones too; very long texts are read whole; no rows give no rows.
    """
    return docs.withColumn(out, recognise(F.col(f"`{text_column}`")))


def oracle(table: str = "documents") -> str:
    """DuckDB SQL for doc_id, sentence_ids and licences (both joined by commas)."""
    known, rules = tables()
    quoted = lambda s: "'" + s.replace("'", "''") + "'"
    marked, plain = f"translate(coalesce(text, ''), '{UPPER}', '{LOWER}')", "trim(regexp_replace(s, '[^a-z0-9]+', ' ', 'g'))"
    for pattern, to in CUTS:
        marked = f"regexp_replace({marked}, {quoted(pattern)}, {quoted(to)}, 'g')"
    for pattern, to in SLOTS:
        plain = f"regexp_replace({plain}, {quoted(pattern)}, {quoted(to)})"
    left, found, steps = "marked", [], []
    for k, (licence, rule) in enumerate(rules):
        mark = quoted(",".join(f"<{i}>" for i in rule))
        steps.append(f"r{k} AS (SELECT *, replace({left}, {mark}, '-') AS left{k}, CASE WHEN contains({left}, {mark}) THEN {quoted(licence)} END AS found{k} FROM {f'r{k - 1}' if k else 'marks'})")
        left = f"left{k}"
        found.append(f"found{k}")
    return f"""
WITH texts AS (SELECT doc_id, row_number() OVER () AS row, text FROM {table}),
pieces AS (SELECT row, unnest(string_split({marked}, '{END}')) AS s, generate_subscripts(string_split({marked}, '{END}'), 1) AS place FROM texts),
numbered AS (
  SELECT row, list(id ORDER BY place) AS ids
  FROM (SELECT row, place, {plain} AS sentence FROM pieces) JOIN (VALUES {", ".join(f"({quoted(s)}, {i})" for s, i in known.items())}) AS known (sentence, id) USING (sentence)
  GROUP BY row
), rows AS (
  SELECT doc_id, coalesce(array_to_string(ids, ','), '') AS sentence_ids, ',' || coalesce(array_to_string(list_transform(ids, lambda i: '<' || i || '>'), ','), '') || ',' AS marked
  FROM texts LEFT JOIN numbered USING (row)
), marks AS (SELECT DISTINCT marked FROM rows),
{", ".join(steps)}
SELECT doc_id, sentence_ids, coalesce(array_to_string(list_sort(list_distinct(list_filter([{", ".join(found)}], lambda x: x IS NOT NULL))), ','), '') AS licences
FROM rows JOIN r{len(rules) - 1} USING (marked)
"""
