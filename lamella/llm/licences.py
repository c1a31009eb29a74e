"""Licence recognition by sentences: known sentences have identifiers, licences are ordered sequences of them.

A text is cut into sentences at . ! ? : ; before white space (not in "v. 2") and at blank lines; a sentence is lower-cased and
reduced to its letters and digits with single spaces. A single line feed may end a sentence or be white space in one: the
longest known sentence is taken. Known ones become their identifier, others "_" (empty ones and numbers of lists never). The rules are tried in their order, the more specific first; each takes the places where its identifiers follow one
another without another sentence between, and what it has taken no later rule sees.

All of it are expressions on a row: no shuffle, and the knowledge base (SENTENCES, RULES and the further STANDARD ones) is a literal of
fixed size in the plan. Every known sentence has one of the anchors, so texts without any need not be cut. The SQL cuts at
every line feed and has only SENTENCES and RULES; it agrees where each sentence stands on one line.

Null and empty texts have no licence. A text with several licences has a row for each; one without has none. Repeated rows
give repeated results. Very long texts are read whole. An empty table gives an empty result. Only doc_id and text are read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Normalised sentences of public licences and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-name",
    "licensed under the mit license": "mit-name",
    "the mit license": "mit-title",
    "mit license": "mit-title",
    "the mit license mit": "mit-title",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions ": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software": "mit-liability",
    "licensed under the apache license version 2 0": "apache-name",
    "licensed under the apache license version 2 0 the license": "apache-name",
    "apache license": "apache-title",
    "you may not use this file except in compliance with the license": "apache-compliance",
    "you may obtain a copy of the license at": "apache-copy",
    "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied": "apache-basis",
    "see the license for the specific language governing permissions and limitations under the license": "apache-language",
    "this work is licensed under the gnu general public license version 3": "gpl3-name",
    "this work is licensed under the gnu general public license version 2": "gpl2-name",
    "licensed under the gnu general public license version 3": "gpl3-name",
    "licensed under the gnu general public license version 2": "gpl2-name",
    "this program is free software": "gpl-free-licence",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation": "gpl-redistribute",
    "either version 3 of the license or at your option any later version": "gpl3-later",
    "either version 2 of the license or at your option any later version": "gpl2-later",
    "this program is distributed in the hope that it will be useful but without any warranty": "gpl-warranty",
    "without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-implied-warranty",
    "see the gnu general public license for more details": "gpl-see",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-permission",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-endorse",
    "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed": "bsd-warranty",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-permission",
    "licensed under cc by nc 4 0": "cc-by-nc-name",
    "licensed under cc by 4 0": "cc-by-name",
    "licensed under cc by sa 4 0": "cc-by-sa-name",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-name",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-name",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-name",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-name",
    "this is free and unencumbered software released into the public domain without licence": "unlicense-name",
}
SENTENCES = {k.strip(): v for k, v in SENTENCES.items()}
#: Licence, rule, identifiers in their order.
RULES = (
    ("MIT", "mit-full", ("mit-grant", "mit-notice", "mit-warranty", "mit-liability")),
    ("MIT", "mit-notice-only", ("mit-grant", "mit-notice")),
    ("BSD-3-Clause", "bsd-3", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty")),
    ("BSD-2-Clause", "bsd-2", ("bsd-permission", "bsd-source", "bsd-binary", "bsd-warranty")),
    ("Apache-2.0", "apache-header", ("apache-name", "apache-compliance", "apache-copy")),
    ("Apache-2.0", "apache-notice", ("apache-name", "apache-compliance")),
    ("GPL-3.0-or-later", "gpl3-header", ("gpl-free-licence", "gpl-redistribute", "gpl3-later")),
    ("GPL-2.0-or-later", "gpl2-header", ("gpl-free-licence", "gpl-redistribute", "gpl2-later")),
    ("MIT", "mit-reference", ("mit-name",)),
    ("MIT", "mit-heading", ("mit-title",)),
    ("Apache-2.0", "apache-reference", ("apache-name",)),
    ("GPL-3.0", "gpl3-reference", ("gpl3-name",)),
    ("GPL-2.0", "gpl2-reference", ("gpl2-name",)),
    ("ISC", "isc", ("isc-permission",)),
    ("CC-BY-NC-4.0", "cc-by-nc-reference", ("cc-by-nc-name",)),
    ("CC-BY-SA-4.0", "cc-by-sa-reference", ("cc-by-sa-name",)),
    ("CC-BY-4.0", "cc-by-reference", ("cc-by-name",)),
    ("MPL-2.0", "mpl2-reference", ("mpl2-name",)),
)
ANCHORS = ("licen", "permi", "copyright", "redistribut", "warrant", "holders", "free software")
#: Sentences and rules of standard texts that the SQL hasn't.
STANDARD = {
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-redistribute-later",
    "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-redistribute-later",
    "gnu general public license version 3 29 june 2007": "gpl3-title",
    "gnu general public license version 2 june 1991": "gpl2-title",
    "this library is free software": "lgpl-free-licence",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation": "lgpl-redistribute",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version": "lgpl3-redistribute-later",
    "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-redistribute-later",
    "either version 2 1 of the license or at your option any later version": "lgpl21-later",
    "gnu lesser general public license version 3 29 june 2007": "lgpl3-title",
    "gnu lesser general public license version 2 1 february 1999": "lgpl21-title",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-redistribute-later",
    "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation": "agpl-redistribute",
    "gnu affero general public license version 3 19 november 2007": "agpl3-title",
    "apache license version 2 0 january 2004": "apache-title-2004",
    "mozilla public license version 2 0": "mpl2-title",
    "this source code form is subject to the terms of the mozilla public license version 2 0": "mpl2-name",
    "eclipse public license v 2 0": "epl2-title",
    "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0": "epl2-name",
    "boost software license version 1 0 august 17th 2003": "bsl-title",
    "distributed under the boost software license version 1 0": "bsl-name",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "cc0 1 0 universal": "cc0-title",
    "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work": "cc0-waiver",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted": "0bsd-permission",
    "this software is provided as is without any express or implied warranty": "zlib-warranty",
    "in no event will the authors be held liable for any damages arising from the use of this software": "zlib-liability",
    "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions": "zlib-grant",
    "this is free and unencumbered software released into the public domain": "unlicense-name",
}
STANDARD_RULES = (
    ("GPL-3.0-or-later", "gpl3-header", ("gpl-free-licence", "gpl3-redistribute-later")),
    ("GPL-2.0-or-later", "gpl2-header", ("gpl-free-licence", "gpl2-redistribute-later")),
    ("GPL-3.0", "gpl3-text", ("gpl3-title",)),
    ("GPL-2.0", "gpl2-text", ("gpl2-title",)),
    ("LGPL-2.1-or-later", "lgpl21-header", ("lgpl-free-licence", "lgpl-redistribute", "lgpl21-later")),
    ("LGPL-2.1-or-later", "lgpl21-header", ("lgpl-free-licence", "lgpl21-redistribute-later")),
    ("LGPL-3.0-or-later", "lgpl3-header", ("lgpl-free-licence", "lgpl-redistribute", "gpl3-later")),
    ("LGPL-3.0-or-later", "lgpl3-header", ("lgpl-free-licence", "lgpl3-redistribute-later")),
    ("LGPL-3.0-or-later", "lgpl3-header", ("gpl-free-licence", "lgpl3-redistribute-later")),
    ("LGPL-3.0", "lgpl3-text", ("lgpl3-title",)),
    ("LGPL-2.1", "lgpl21-text", ("lgpl21-title",)),
    ("AGPL-3.0-or-later", "agpl3-header", ("gpl-free-licence", "agpl3-redistribute-later")),
    ("AGPL-3.0-or-later", "agpl3-header", ("gpl-free-licence", "agpl-redistribute", "gpl3-later")),
    ("AGPL-3.0", "agpl3-text", ("agpl3-title",)),
    ("Apache-2.0", "apache-text", ("apache-title-2004",)),
    ("Apache-2.0", "apache-warranty", ("apache-basis", "apache-language")),
    ("MPL-2.0", "mpl2-text", ("mpl2-title",)),
    ("EPL-2.0", "epl2-text", ("epl2-title",)),
    ("EPL-2.0", "epl2-reference", ("epl2-name",)),
    ("BSL-1.0", "bsl-full", ("bsl-title", "bsl-grant")),
    ("BSL-1.0", "bsl-grant-only", ("bsl-grant",)),
    ("BSL-1.0", "bsl-reference", ("bsl-name",)),
    ("CC0-1.0", "cc0-text", ("cc0-title",)),
    ("CC0-1.0", "cc0-waiver-only", ("cc0-waiver",)),
    ("0BSD", "0bsd", ("0bsd-permission",)),
    ("Zlib", "zlib-full", ("zlib-warranty", "zlib-liability", "zlib-grant")),
    ("Zlib", "zlib-grant-only", ("zlib-grant",)),
    ("Unlicense", "unlicense-reference", ("unlicense-name",)),
)
#: White space and sentence ends, as both Java's and RE2's expressions read them.
_CUT, _OTHER = r"([.!?:;])[\x20\x09-\x0D]+", r"[^a-z0-9]+"


def anchors() -> list[str]:
    """Words of which every known sentence has one; a line feed within any of them can't hide it."""
    out = [a for a in ANCHORS if " " not in a]
    return out + sorted({max(k.split(), key=len) for k in {**SENTENCES, **STANDARD} if not any(a in k for a in out)})


def scan(docs: DataFrame) -> DataFrame:
    """doc_id, licence, rule, n_found for each licence rule that a text of docs(doc_id, text) has, and the number of its
    known sentences."""
    text = F.lower(F.coalesce(F.col("text").cast("string"), F.lit("")))
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("t")).filter(" OR ".join(f"contains(t, '{a}')" for a in anchors()))
    # a text as |sentence|sentence/after a single line feed|
    t = F.regexp_replace("t", r"\bv\.[\x20\x09-\x0D]+(?=[0-9])", "v ")
    t = F.regexp_replace(F.regexp_replace(t, _CUT, "\x01"), "\n", "\x02")
    t = F.regexp_replace(t, r"[^a-z0-9\x01\x02]+", " ")
    t = F.regexp_replace(F.regexp_replace(t, " ?(\x01|\x02 ?\x02)[ \x01\x02]*", "|"), " ?\x02 ?", "/")
    t = F.regexp_replace(F.regexp_replace(F.concat(F.lit("|"), F.trim(t), F.lit("|")), r"[|/ ]*\|[|/ ]*", "|"), r"(?<=[|/])[0-9]+[|/]", "")
    known = {**SENTENCES, **STANDARD}
    table = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r"(?<=[|/])" + k.replace(" ", "[ /]") + r"(?=[|/])").alias("p"), F.lit(f"<{known[k]}>").alias("i")) for k in sorted(known, key=lambda k: (-len(k), k))])
    # the text with and without its marks is bound once, then each known sentence that it has becomes its identifier
    swap = lambda t, flat: F.aggregate(table, t, lambda s, x: F.when(F.contains(flat, x["k"]), F.regexp_replace(s, x["p"], x["i"])).otherwise(s))
    t = F.transform(F.array(t), lambda t: F.transform(F.array(F.regexp_replace(t, "[|/]", " ")), lambda flat: swap(t, flat))[0])[0]
    marks = F.regexp_replace(F.regexp_replace(t, r"(?<=[|/])[^|/<>]+(?=[|/])", "<_>"), "[|/]", "")
    d = d.select("doc_id", marks.alias("s0")).withColumn("n_known", F.regexp_count("s0", F.lit("<[^_>]+>")).cast("long"))
    found = []
    for k, (licence, rule, sequence) in enumerate((*RULES, *STANDARD_RULES)):
        mark = "".join(f"<{x}>" for x in sequence)
        d = d.withColumn(f"s{k + 1}", F.replace(F.col(f"s{k}"), F.lit(mark), F.lit("#")))
        n = (F.length(f"s{k}") - F.length(f"s{k + 1}")) / F.lit(len(mark) - 1)
        found.append(F.struct(F.lit(licence).alias("licence"), F.lit(rule).alias("rule"), n.cast("long").alias("n_found")))
    # a rule with several sequences is one: the first of them has the sum
    names = [r[:2] for r in (*RULES, *STANDARD_RULES)]
    total = lambda k: sum((found[j].getField("n_found") for j in range(k + 1, len(names)) if names[j] == names[k]), found[k].getField("n_found"))
    found = [F.struct(F.lit(names[k][0]).alias("licence"), F.lit(names[k][1]).alias("rule"), total(k).alias("n_found")) for k in range(len(names)) if names[k] not in names[:k]]
    d = d.select("doc_id", "n_known", F.explode(F.filter(F.array(*found), lambda x: x.getField("n_found") > 0)).alias("x"))
    return d.select("doc_id", "x.licence", "x.rule", "x.n_found", "n_known")


def sql() -> str:
    """The same in DuckDB's SQL."""
    quote = lambda x: "'" + x.replace("'", "''") + "'"
    rows = ", ".join(f"({quote(k)}, {quote(v)})" for k, v in SENTENCES.items())
    steps, unions = ["r0 AS (SELECT doc_id, n_known, s AS s0 FROM marks)"], []
    for k, (licence, rule, sequence) in enumerate(RULES):
        mark = "".join(f"<{x}>" for x in sequence)
        steps.append(f"r{k + 1} AS (SELECT *, replace(s{k}, {quote(mark)}, '#') AS s{k + 1} FROM r{k})")
        unions.append(f"SELECT doc_id, {quote(licence)} AS licence, {quote(rule)} AS rule, (length(s{k}) - length(s{k + 1})) // {len(mark) - 1} AS n_found, n_known FROM r{len(RULES)} WHERE s{k} <> s{k + 1}")
    anchors = " OR ".join(f"contains(t, '{a}')" for a in ANCHORS)
    return f"""
        WITH known(sentence, id) AS (VALUES {rows}),
        t AS (SELECT doc_id, lower(coalesce(text, '')) AS t FROM documents),
        cut AS (SELECT doc_id, string_split(regexp_replace(t, '([.!?:;])[\\x20\\x09-\\x0D]+', '\\1' || chr(10), 'g'), chr(10)) AS parts FROM t WHERE {anchors}),
        each AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS k FROM cut),
        sentences AS (SELECT doc_id, k, trim(regexp_replace(part, '[^a-z0-9]+', ' ', 'g')) AS sentence FROM each),
        ids AS (SELECT doc_id, k, coalesce(id, '_') AS id FROM sentences LEFT JOIN known USING (sentence) WHERE sentence <> ''),
        marks AS (SELECT doc_id, count(*) FILTER (id <> '_') AS n_known, string_agg('<' || id || '>', '' ORDER BY k) AS s FROM ids GROUP BY doc_id HAVING n_known > 0),
        {", ".join(steps)}
        {" UNION ALL ".join(unions)}
    """
