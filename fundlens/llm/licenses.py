"""Licence recognition by sentence rules, DataFrame functions only.

A text is normalised (lower case, every run of other characters than a-z 0-9 one space) and the
known licence sentences are looked up in it as whole words, wherever lines, comment signs or other
sentences break them; of sentences that begin at one place the longest counts.
The identifiers of a row, in order and without the unknown sentences between them, are
matched against ordered licence rules; what an earlier rule took is not seen by later ones.

Everything happens inside the row: no shuffle, no group, whole texts. Cases: null or empty
text and rows without a known sentence give no row; a row whose known sentences meet no rule
gives one row with licence ``unrecognised``; repeated rows and null ids keep their
multiplicity; extra columns are ignored.
"""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Known licence sentences and their identifiers.
SENTENCES = {
    "ApacheNotice": "Licensed under the Apache License, Version 2.0",
    "ApacheUse": "you may not use this file except in compliance with the License",
    "ApacheCopy": "You may obtain a copy of the License at",
    "ApacheAsIs": "Unless required by applicable law or agreed to in writing, software distributed under the License is "
                  "distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied",
    "ApacheLimits": "See the License for the specific language governing permissions and limitations under the License",
    "MitNotice": "Released under the MIT License",
    "MitGrant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
                "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
                "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of "
                "the Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
                "conditions:",
    "MitKeep": "The above copyright notice and this permission notice shall be included in all copies or substantial "
               "portions of the Software",
    "Gpl3Notice": "This work is licensed under the GNU General Public License, version 3",
    "GplFree": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
               "option) any later version",
    "GplHope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY",
    "CcByNc4Notice": "Licensed under CC BY-NC 4.0",
    "CcBy4Notice": "Licensed under CC BY 4.0",
    "AllRights": "All rights reserved",
    "MitLicensed": "Licensed under the MIT License",
    "GplFree2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License as published by the Free Software Foundation; either version 2 of the License, or (at your "
                "option) any later version",
    "GplOnly2": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General "
                "Public License version 2 as published by the Free Software Foundation",
    "LgplFree21": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                  "published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any "
                  "later version",
    "LgplFree3": "you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                 "later version",
    "AgplFree3": "you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as "
                 "published by the Free Software Foundation, either version 3 of the License, or (at your option) any "
                 "later version",
    "MplForm": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
    "IscGrant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
                "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "IscGrantOld": "Permission to use, copy, modify, and distribute this software for any purpose with or without fee is "
                   "hereby granted, provided that the above copyright notice and this permission notice appear in all copies",
    "UnlicenseFree": "This is free and unencumbered software released into the public domain",
    "BslNotice": "Distributed under the Boost Software License, Version 1.0",
    "BsdNames": "nor the names of its contributors may be used to endorse or promote products derived from this software "
                "without specific prior written permission",
    "BsdGrant": "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
                "that the following conditions are met:",
    "BsdSource": "Redistributions of source code must retain the above copyright notice, this list of conditions and the "
                 "following disclaimer",
    "BsdBinary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the "
                 "following disclaimer in the documentation and/or other materials provided with the distribution",
}

# Licence rules, tried in this order; longer sequences before their parts.
RULES = [
    ("Apache-2.0", ["ApacheNotice", "ApacheUse", "ApacheCopy", "ApacheAsIs", "ApacheLimits"]),
    ("Apache-2.0", ["ApacheNotice"]),
    ("MIT", ["MitGrant", "MitKeep"]),
    ("MIT", ["MitNotice"]),
    ("GPL-3.0-or-later", ["GplFree", "GplHope"]),
    ("GPL-3.0-or-later", ["GplFree"]),
    ("GPL-3.0-only", ["Gpl3Notice"]),
    ("CC-BY-NC-4.0", ["CcByNc4Notice"]),
    ("CC-BY-4.0", ["CcBy4Notice"]),
    ("MIT", ["MitLicensed"]),
    ("GPL-2.0-or-later", ["GplFree2"]),
    ("GPL-2.0-only", ["GplOnly2"]),
    ("LGPL-2.1-or-later", ["LgplFree21"]),
    ("LGPL-3.0-or-later", ["LgplFree3"]),
    ("AGPL-3.0-or-later", ["AgplFree3"]),
    ("MPL-2.0", ["MplForm"]),
    ("ISC", ["IscGrant"]),
    ("ISC", ["IscGrantOld"]),
    ("Unlicense", ["UnlicenseFree"]),
    ("BSL-1.0", ["BslNotice"]),
    ("LicenseRef-all-rights-reserved", ["AllRights"]),
    ("BSD-3-Clause", ["BsdGrant", "BsdSource", "BsdBinary", "BsdNames"]),
    ("BSD-2-Clause", ["BsdGrant", "BsdSource", "BsdBinary"]),
]

BREAK = r"[.!?;]+[ \t\r]+|\n+"
NOISE = "[^a-z0-9]+"


def normal(sentence: str) -> str:
    """The normalised form of a known sentence (parameters only; rows use :func:`normalised`)."""
    return re.sub(NOISE, " ", sentence.lower()).strip()


def normalised(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), NOISE, " "))


def sentence_ids(text: Column, sentences: dict[str, str] = SENTENCES) -> Column:
    """Array of the identifiers of the known sentences of ``text``, in order."""
    known = F.create_map(*[F.lit(x) for k, s in sentences.items() for x in (normal(s), k)])
    ordered = sorted({normal(s) for s in sentences.values()}, key=lambda s: (-len(s), s))
    found = F.regexp_extract_all(normalised(text), F.lit(r"\b(" + "|".join(ordered) + r")\b"), F.lit(1))
    # each sentence has one of these words: rows with none are not searched
    marks = "|".join(sorted({marked(s) for s in ordered}))
    return F.when(F.lower(text).rlike(marks), F.transform(found, lambda s: F.element_at(known, s)))


def marked(sentence: str) -> str:
    """A telling word of a normalised sentence, or its longest word."""
    return next((w for w in ("license", "reserved", "permission", "redistribution", "warranty", "software",
                             "permitted") if w in sentence), max(sentence.split(), key=len))


def scan(docs: DataFrame, text: str = "text", key: str = "doc_id", sentences: dict[str, str] = SENTENCES,
         rules: list[tuple[str, list[str]]] = RULES) -> DataFrame:
    """(key, license, n_matches, sentences): a row for each licence found in a row of ``docs``."""
    rows = (docs.select(F.col(key), sentence_ids(F.col(text), sentences).alias("_ids"))
            .where(F.size("_ids") > 0)
            .select(key, F.concat(F.lit("|"), F.array_join("_ids", "||"), F.lit("|")).alias("_seq"),
                    F.size("_ids").cast("long").alias("_n")))
    rest = F.col("_seq")
    names = list(dict.fromkeys(n for n, _ in rules))
    counts = {n: F.lit(0) for n in names}
    for name, ids in rules:
        sought = "".join(f"|{i}|" for i in ids)
        left = F.replace(rest, F.lit(sought), F.lit("#"))
        hits = ((F.length(rest) - F.length(left)) / (len(sought) - 1)).cast("int")
        counts[name] = counts[name] + hits
        rest = left
    found = F.filter(F.array(*[F.struct(F.lit(n).alias("license"), counts[n].cast("long").alias("n_matches"))
                               for n in names]), lambda x: x["n_matches"] > 0)
    none = F.array(F.struct(F.lit("unrecognised").alias("license"), F.lit(0).cast("long").alias("n_matches")))
    return (rows.select(key, F.explode(F.when(F.size(found) > 0, found).otherwise(none)).alias("_hit"),
                        F.col("_n").alias("n_sentences"))
            .select(key, "_hit.license", "_hit.n_matches", "n_sentences"))


def oracle_sql() -> str:
    """DuckDB SQL for ``scan(documents)``."""
    quote = lambda s: "'" + s.replace("'", "''") + "'"
    known = ", ".join(f"({quote(normal(s))}, {quote(k)})" for k, s in SENTENCES.items())
    steps, prev, cols = [], "s0", []
    for n, (name, ids) in enumerate(RULES):
        sought = quote("".join(f"|{i}|" for i in ids))
        size = sum(len(i) + 2 for i in ids) - 1
        steps.append(f"s{n + 1} AS (SELECT *, replace(r{n}, {sought}, '#') AS r{n + 1}, "
                     f"(length(r{n}) - length(replace(r{n}, {sought}, '#'))) // {size} AS c{n} FROM {prev})")
        prev = f"s{n + 1}"
    by: dict[str, list[str]] = {}
    for n, (name, _) in enumerate(RULES):
        by.setdefault(name, []).append(f"c{n}")
    cols = " UNION ALL ".join(f"SELECT doc_id, {quote(k)} AS license, CAST({' + '.join(v)} AS BIGINT) AS n_matches, n_sentences "
                              f"FROM {prev} WHERE {' + '.join(v)} > 0" for k, v in by.items())
    total = " + ".join(f"c{n}" for n in range(len(RULES)))
    return (f"WITH known(sentence, id) AS (VALUES {known}), "
            f"numbered AS (SELECT row_number() OVER () AS rid, doc_id, text FROM documents), "
            f"cut AS (SELECT rid, doc_id, unnest(regexp_split_to_array(text, '{BREAK}')) AS s, "
            f"generate_subscripts(regexp_split_to_array(text, '{BREAK}'), 1) AS pos FROM numbered), "
            f"ids AS (SELECT rid, doc_id, pos, id FROM cut JOIN known ON "
            f"trim(regexp_replace(lower(s), '{NOISE}', ' ', 'g')) = sentence), "
            f"s0 AS (SELECT doc_id, '|' || string_agg(id, '||' ORDER BY pos) || '|' AS r0, count(*) AS n_sentences "
            f"FROM ids GROUP BY rid, doc_id), {', '.join(steps)} {cols} "
            f"UNION ALL SELECT doc_id, 'unrecognised', 0, n_sentences FROM {prev} WHERE {total} = 0")
