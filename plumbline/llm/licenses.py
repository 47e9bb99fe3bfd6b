"""License scans by sentence rules, in built-in expressions only.

A text is cut into sentences, each normalised (lower case, runs of other characters than letters and digits
become one space).  A known sentence begins and ends at a cut and may run over cuts in between, as in wrapped
lines or after a colon.  Known sentences map to identifiers; the identifiers of a text, in order, are matched
against licence rules, each an ordered sequence of identifiers that must follow one another.  Rules are tried in
order, the longer ones first; what a rule has matched is used up, so that a part of it names no other licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Known licence sentences (normalised) and their identifiers.
SENTENCES = {
    "released under the mit license": "mit-ref",
    "licensed under the mit license": "mit-ref",
    "this project is licensed under the mit license": "mit-ref",
    "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions": "mit-grant",
    "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software": "mit-notice",
    "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement": "mit-warranty",
    "licensed under the apache license version 2 0": "apache2-ref",
    "licensed under the apache license version 2 0 the license": "apache2-grant",
    "you may not use this file except in compliance with the license": "apache2-use",
    "you may obtain a copy of the license at http www apache org licenses license 2 0": "apache2-copy",
    "this work is licensed under the gnu general public license version 3": "gpl3-ref",
    "licensed under the gnu general public license version 3": "gpl3-ref",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version": "gpl3-grant",
    "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "licensed under cc by nc 4 0": "cc-by-nc-ref",
    "this work is licensed under cc by nc 4 0": "cc-by-nc-ref",
    "licensed under cc by 4 0": "cc-by-ref",
    "this work is licensed under a creative commons attribution 4 0 international license": "cc-by-ref",
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met": "bsd-grant",
    "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer": "bsd-source",
    "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution": "bsd-binary",
    "licensed under the apache license 2 0": "apache2-ref",
    "spdx license identifier mit": "mit-ref",
    "spdx license identifier apache 2 0": "apache2-ref",
    "spdx license identifier bsd 2 clause": "bsd2-ref",
    "spdx license identifier bsd 3 clause": "bsd3-ref",
    "spdx license identifier gpl 2 0 or later": "gpl2-ref",
    "spdx license identifier gpl 3 0 or later": "gpl3-later-ref",
    "spdx license identifier mpl 2 0": "mpl2-ref",
    "licensed under the bsd 3 clause license": "bsd3-ref",
    "licensed under the mozilla public license version 2 0": "mpl2-ref",
    "this source code form is subject to the terms of the mozilla public license v 2 0": "mpl2-grant",
    "if a copy of the mpl was not distributed with this file you can obtain one at http mozilla org mpl 2 0": "mpl2-copy",
    "if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0": "mpl2-copy",
    "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies": "isc-grant",
    "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness": "isc-warranty",
    "this is free and unencumbered software released into the public domain": "unlicense-grant",
    "anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary for any purpose commercial or non commercial and by any means": "unlicense-use",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version": "gpl2-grant",
    "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2 1 of the license or at your option any later version": "lgpl21-grant",
    "this library is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose": "gpl-warranty",
    "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version": "agpl3-grant",
    "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software and to permit third parties to whom the software is furnished to do so all subject to the following": "bsl-grant",
    "licensed under cc by sa 4 0": "cc-by-sa-ref",
    "this work is licensed under a creative commons attribution sharealike 4 0 international license": "cc-by-sa-ref",
    "this work is licensed under a creative commons attribution noncommercial 4 0 international license": "cc-by-nc-ref",
    "licensed under cc0 1 0": "cc0-ref",
    "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission": "bsd-names",
}
#: Licence rules, identifiers in order.
RULES = [
    ("MIT", ("mit-ref",)),
    ("MIT", ("mit-grant", "mit-notice", "mit-warranty")),
    ("MIT", ("mit-grant", "mit-notice")),
    ("Apache-2.0", ("apache2-ref",)),
    ("Apache-2.0", ("apache2-grant", "apache2-use", "apache2-copy")),
    ("Apache-2.0", ("apache2-grant", "apache2-use")),
    ("GPL-3.0", ("gpl3-ref",)),
    ("GPL-3.0-or-later", ("gpl3-grant", "gpl-warranty")),
    ("GPL-3.0-or-later", ("gpl3-grant",)),
    ("CC-BY-NC-4.0", ("cc-by-nc-ref",)),
    ("CC-BY-4.0", ("cc-by-ref",)),
    ("GPL-3.0-or-later", ("gpl3-later-ref",)),
    ("GPL-2.0-or-later", ("gpl2-ref",)),
    ("GPL-2.0-or-later", ("gpl2-grant", "gpl-warranty")),
    ("GPL-2.0-or-later", ("gpl2-grant",)),
    ("LGPL-2.1-or-later", ("lgpl21-grant", "gpl-warranty")),
    ("LGPL-2.1-or-later", ("lgpl21-grant",)),
    ("AGPL-3.0-or-later", ("agpl3-grant", "gpl-warranty")),
    ("AGPL-3.0-or-later", ("agpl3-grant",)),
    ("MPL-2.0", ("mpl2-ref",)),
    ("MPL-2.0", ("mpl2-grant", "mpl2-copy")),
    ("MPL-2.0", ("mpl2-grant",)),
    ("ISC", ("isc-grant", "isc-warranty")),
    ("ISC", ("isc-grant",)),
    ("Unlicense", ("unlicense-grant", "unlicense-use")),
    ("Unlicense", ("unlicense-grant",)),
    ("BSL-1.0", ("bsl-grant",)),
    ("CC-BY-SA-4.0", ("cc-by-sa-ref",)),
    ("CC0-1.0", ("cc0-ref",)),
    ("BSD-2-Clause", ("bsd2-ref",)),
    ("BSD-3-Clause", ("bsd3-ref",)),
    ("BSD-2-Clause", ("bsd-grant", "bsd-source", "bsd-binary")),
    ("BSD-3-Clause", ("bsd-grant", "bsd-source", "bsd-binary", "bsd-names")),
]
#: A text is cut at line ends, and after stops that a space follows.  A text without any of HINTS has no known sentence.
CUT = r"[\n\r]+|(?<=[.;:!?])[ \t]+"
HINTS = r"(?i)licen[sc]e|permission|redistribut|warrant|copyright|public domain|anyone is free"
#: The rules as they are tried: the longer first, then as they stand.
ORDERED = sorted(RULES, key=lambda r: -len(r[1]))


def _mark(rule: tuple[str, ...]) -> str:
    """A rule as it stands in a line of identifiers, each between spaces of its own."""
    return "".join(f" {i} " for i in rule)


def _known() -> str:
    """A pattern of the known sentences, the longest first, in a text whose cuts are lone line ends between spaces."""
    longest = sorted(SENTENCES, key=len, reverse=True)
    return r"(?<=\n )(?:" + "|".join(s.replace(" ", r" (?:\n )?") for s in longest) + r")(?= \n)"


def identifiers(text: Column) -> Column:
    """The identifiers of the known sentences of a text, in order."""
    known = F.create_map(*[F.lit(x) for kv in SENTENCES.items() for x in kv])
    plain = F.regexp_replace(F.lower(F.regexp_replace(text, CUT, "\n")), r"[^\p{L}\p{N}\n]+", " ")
    plain = F.regexp_replace(F.concat(F.lit("\n"), plain, F.lit("\n")), r" ?\n[ \n]*", " \n ")
    found = F.regexp_extract_all(plain, F.lit(_known()), F.lit(0))
    return F.transform(found, lambda s: F.try_element_at(known, F.replace(s, F.lit("\n "), F.lit(""))))


def scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, sentences, licenses): the identifiers found, in order, and the licences whose rules they match, sorted.

    Null and empty texts, and texts without known sentences, have two empty lists.  Sentences that a rule has matched
    count for no later rule; of rules of one length the first in the table is tried first.  Each row gives one row, repeated
    ones repeated results, without a shuffle; a very long text is scanned whole; further columns play no part.
    """
    none = F.array().cast("array<string>")
    ids = F.when(F.col(text_col).rlike(HINTS), identifiers(F.col(text_col)))
    rows = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(ids, none).alias("sentences"))
    state = F.struct(F.concat(F.lit(" "), F.array_join("sentences", "  "), F.lit(" ")).alias("line"), none.alias("found"))
    rules = F.array(*[F.struct(F.lit(name).alias("name"), F.lit(_mark(rule)).alias("mark")) for name, rule in ORDERED])

    def tried(s: Column, r: Column) -> Column:
        hit = F.contains(s["line"], r["mark"])
        return F.struct(F.replace(s["line"], r["mark"], F.lit("|")).alias("line"), F.when(hit, F.array_append(s["found"], r["name"])).otherwise(s["found"]).alias("found"))

    found = F.aggregate(rules, state, tried, lambda s: F.array_sort(F.array_distinct(s["found"])))
    return rows.withColumn("licenses", F.when(F.size("sentences") > 0, found).otherwise(none))


def report(docs: DataFrame) -> DataFrame:
    return scan(docs).select("doc_id", F.size("sentences").cast("long").alias("n_sentences"), F.array_join("sentences", ",").alias("sentences"), F.array_join("licenses", ",").alias("licenses"))


def _quote(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def oracle() -> str:
    """DuckDB SQL for report(); every clause reads the same constants."""
    known = ", ".join(f"({_quote(k)}, {_quote(v)})" for k, v in SENTENCES.items())
    lines, found = ["' ' || replace(sentences, ',', '  ') || ' '"], []
    for name, rule in ORDERED:  # each rule looks at what the ones before it have left
        found.append(f"CASE WHEN contains(l{len(found)}, {_quote(_mark(rule))}) THEN {_quote(name)} END")
        lines.append(f"replace(l{len(found) - 1}, {_quote(_mark(rule))}, '|')")
    chain = ", ".join(f"{x} AS l{k}" for k, x in enumerate(lines))
    return rf"""
WITH known(sentence, id) AS (VALUES {known}),
cut AS (SELECT doc_id, string_split_regex(regexp_replace(text, '([.;:!?])[ \t]+', '\1' || chr(10), 'g'), '[\n\r]+') AS parts FROM documents),
each AS (SELECT doc_id, unnest(parts) AS part, generate_subscripts(parts, 1) AS pos FROM cut),
hits AS (SELECT doc_id, string_agg(id, ',' ORDER BY pos) AS sentences, count(*) AS n FROM (SELECT doc_id, pos, trim(regexp_replace(lower(part), '[^\p{{L}}\p{{N}}]+', ' ', 'g')) AS sentence FROM each WHERE regexp_matches(part, '{HINTS}')) JOIN known USING (sentence) GROUP BY doc_id),
tried AS (SELECT doc_id, {chain} FROM hits),
named AS (SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter([{', '.join(found)}], lambda x: x IS NOT NULL))), ',') AS licenses FROM tried)
SELECT doc_id, coalesce(hits.n, 0)::BIGINT AS n_sentences, coalesce(sentences, '') AS sentences, coalesce(licenses, '') AS licenses
FROM documents LEFT JOIN hits USING (doc_id) LEFT JOIN named USING (doc_id)
"""
