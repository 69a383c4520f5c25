"""License scan by sentence rules.

A text is cut into sentences at line ends and after . ! ? ; : (the hard reading),
and also with single line ends as spaces (the soft one, for licences that are
wrapped). A sentence is lower-cased and what is not a letter or digit becomes one
space; known sentences have an identifier. Known sentences are cut in the same
way: one that is cut into pieces is recognised where all of them follow one
another, the longest known sentence first. The rules, in order, are matched
against the sequence of identifiers: a licence is found where the identifiers of
its rule follow one another with nothing between, and what a rule has matched is
not matched again by later ones. So longer rules stand before those within them.

Both readings are matched. The one that recognises more sentences is shown (the
hard one, if equal); of the other, a licence whose rule lies within that of a
licence found is left out.

Defined results: null text counts as empty and has none. A licence that several
rules or places show is given once; the names are in order of code points.
Repeated rows give repeated results and no rows give none.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gridloom.llm.common import need_columns, text_or_empty

#: Sentences that licences and licence notices are made of.
SENTENCES = {
    "mit-name": "MIT License",
    "mit-the-name": "The MIT License",
    "mit-released": "Released under the MIT License.",
    "mit-licensed": "Licensed under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:",
    "mit-0-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so.",
    "mit-notice": "The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "as-is-software": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-title": "Apache License",
    "apache-version": "Version 2.0, January 2004",
    "apache-title-version": "Apache License Version 2.0, January 2004",
    "apache-licensed": "Licensed under the Apache License, Version 2.0.",
    "apache-licensed-the": "Licensed under the Apache License, Version 2.0 (the \"License\");",
    "apache-may-not": "you may not use this file except in compliance with the License.",
    "apache-obtain": "You may obtain a copy of the License at",
    "gnu-gpl-2": "GNU GENERAL PUBLIC LICENSE Version 2, June 1991",
    "gnu-gpl-3": "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gnu-lgpl-2.1": "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999",
    "gnu-lgpl-3": "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007",
    "gnu-agpl-3": "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007",
    "gpl3-work": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl2-free": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl2-free-only": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License version 2 as published by the Free Software Foundation.",
    "lgpl2.1-free": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "lgpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "agpl3-free": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-hope": "This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "lgpl-hope": "This library is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY;",
    "cc-by-nc-4": "Licensed under CC BY-NC 4.0.",
    "cc-by-4": "Licensed under CC BY 4.0.",
    "cc-by-sa-4": "Licensed under CC BY-SA 4.0.",
    "cc0-dedicated": "To the extent possible under law, the author(s) have dedicated all copyright and related and neighboring rights to this software to the public domain worldwide.",
    "cc0-warranty": "This software is distributed without any warranty.",
    "bsd-redistribution": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-source": "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
    "bsd-binary": "Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "bsd-advertising": "All advertising materials mentioning features or use of this software must display the following acknowledgement:",
    "bsd-neither": "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "0bsd-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "isc-as-is": "THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS.",
    "zlib-as-is": "This software is provided 'as-is', without any express or implied warranty.",
    "zlib-liable": "In no event will the authors be held liable for any damages arising from the use of this software.",
    "zlib-grant": "Permission is granted to anyone to use this software for any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following restrictions:",
    "zlib-origin": "The origin of this software must not be misrepresented;",
    "unlicense-public": "This is free and unencumbered software released into the public domain.",
    "unlicense-anyone": "Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any means.",
    "mpl2-subject": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "mpl2-title": "Mozilla Public License Version 2.0",
    "epl2-available": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at https://www.eclipse.org/legal/epl-2.0/",
    "bsl-distributed": "Distributed under the Boost Software License, Version 1.0.",
    "bsl-grant": "Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the \"Software\") to use, reproduce, display, distribute, execute, and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following:",
    "postgresql-grant": "Permission to use, copy, modify, and distribute this software and its documentation for any purpose, without fee, and without a written agreement is hereby granted, provided that the above copyright notice and this paragraph and the following two paragraphs appear in all copies.",
}
#: Licences and the ordered sentences that show each, longer rules before those within them.
RULES = [
    ("BSD-4-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-advertising"]),
    ("BSD-3-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary", "bsd-neither"]),
    ("BSD-2-Clause", ["bsd-redistribution", "bsd-source", "bsd-binary"]),
    ("Zlib", ["zlib-as-is", "zlib-liable", "zlib-grant", "zlib-origin"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is-software"]),
    ("MIT-0", ["mit-0-grant", "as-is-software"]),
    ("ISC", ["isc-grant", "isc-as-is"]),
    ("0BSD", ["0bsd-grant", "isc-as-is"]),
    ("Apache-2.0", ["apache-licensed-the", "apache-may-not"]),
    ("Apache-2.0", ["apache-title", "apache-version"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope"]),
    ("GPL-2.0-only", ["gpl2-free-only", "gpl-hope"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope"]),
    ("LGPL-2.1-or-later", ["lgpl2.1-free", "lgpl-hope"]),
    ("LGPL-3.0-or-later", ["lgpl3-free", "gpl-hope"]),
    ("AGPL-3.0-or-later", ["agpl3-free", "gpl-hope"]),
    ("Unlicense", ["unlicense-public", "unlicense-anyone"]),
    ("CC0-1.0", ["cc0-dedicated", "cc0-warranty"]),
    ("AGPL-3.0", ["gnu-agpl-3"]),
    ("Apache-2.0", ["apache-licensed"]),
    ("Apache-2.0", ["apache-title-version"]),
    ("BSL-1.0", ["bsl-distributed"]),
    ("BSL-1.0", ["bsl-grant"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("EPL-2.0", ["epl2-available"]),
    ("GPL-2.0", ["gnu-gpl-2"]),
    ("GPL-3.0", ["gnu-gpl-3"]),
    ("GPL-3.0", ["gpl3-work"]),
    ("LGPL-2.1", ["gnu-lgpl-2.1"]),
    ("LGPL-3.0", ["gnu-lgpl-3"]),
    ("MIT", ["mit-licensed"]),
    ("MIT", ["mit-released"]),
    ("MPL-2.0", ["mpl2-subject"]),
    ("MPL-2.0", ["mpl2-title"]),
    ("PostgreSQL", ["postgresql-grant"]),
]
#: Names in licence tags.
TAGS = [
    "0BSD", "AGPL-3.0-only", "AGPL-3.0-or-later", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSD-4-Clause", "BSL-1.0", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0", "CC0-1.0", "EPL-2.0",
    "GPL-2.0-only", "GPL-2.0-or-later", "GPL-3.0-only", "GPL-3.0-or-later", "ISC", "LGPL-2.1-only", "LGPL-2.1-or-later", "LGPL-3.0-only", "LGPL-3.0-or-later", "MIT", "MIT-0", "MPL-2.0",
    "PostgreSQL", "Unlicense", "Zlib",
]
SENTENCES |= {f"spdx-{tag}": f"SPDX-License-Identifier: {tag}" for tag in TAGS}
RULES += [(tag, [f"spdx-{tag}"]) for tag in TAGS]
#: For each licence, those with a rule that holds one of its rules.
WIDER: dict[str, list[str]] = {}
for _name, _ids in RULES:
    _over = {n for n, ids in RULES if n != _name and any(ids[i : i + len(_ids)] == _ids for i in range(len(ids)))}
    WIDER[_name] = sorted(_over | set(WIDER.get(_name, [])))
#: A known sentence has one of these words; texts without any are not cut up.
HINT = r"(?i)licen[sc]e|permi|copyright|warrant|redistribut|public domain|free software|anyone is free|version [23]|liable|misrepresented|advertising|neither the name|eclipse"
#: Where a sentence ends: after its mark and white space, or at a line's end.
BREAK, SOFT_BREAK = r"(?<=[.!?;:])\s+|\n", r"(?<=[.!?;:])\s+|\n[ \t\r]*\n"
#: Between the pieces of a known sentence that is cut; no normalised piece holds it.
PIECES = "|"


def normal(sentence: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(sentence), r"[^\p{L}\p{N}]+", " "))


def _identifiers(text: Column, at: str, known: Column, heads: dict[int, list[str]]) -> Column:
    """The identifiers of the known sentences, in order. heads: of the known sentences that
    are cut into n pieces, their first pieces."""

    def among(pieces: Column) -> Column:
        def identify(piece: Column, i: Column) -> Column:
            found = [F.when(piece.isin(heads[n]), F.try_element_at(known, F.array_join(F.slice(pieces, i + 1, n), PIECES))) for n in sorted(heads, reverse=True)]
            return F.coalesce(*found, F.try_element_at(known, piece))

        return F.filter(F.transform(pieces, identify), lambda x: x.isNotNull())

    # A lambda over a one-element array computes its argument once.
    return F.get(F.transform(F.array(F.transform(F.split(text, at), normal)), among), 0)


def _sequence(ids: list[str]) -> str:
    return "".join(f"<{i}>" for i in ids)


def _licenses(ids: Column) -> Column:
    """The licences whose rules match, each rule on what the rules before have left."""
    rules = F.array(*[F.struct(F.lit(_sequence(rule)).alias("ids"), F.lit(name).alias("name")) for name, rule in RULES])
    whole = F.array_join(F.transform(ids, lambda i: F.concat(F.lit("<"), i, F.lit(">"))), "")
    none = F.array().cast("array<string>")

    def match(acc: Column, rule: Column) -> Column:
        hit = F.contains(acc["left"], rule["ids"])
        return F.struct(F.replace(acc["left"], rule["ids"], F.lit("|")).alias("left"), F.when(hit, F.array_append(acc["names"], rule["name"])).otherwise(acc["names"]).alias("names"))

    found = F.aggregate(rules, F.struct(whole.alias("left"), none.alias("names")), match, lambda acc: F.array_distinct(acc["names"]))
    return F.when(F.size(ids) > 0, found).otherwise(none)


def scan(docs: DataFrame) -> DataFrame:
    """One row a document: doc_id, n_sentences (known ones), sentences and licenses (comma-joined)."""
    need_columns(docs, "doc_id", "text")
    spark = docs.sparkSession
    plain = spark.createDataFrame([(k, v) for k, v in SENTENCES.items()], "id string, sentence string").select("id", F.transform(F.split("sentence", BREAK), normal).alias("s"))
    # The fixed table of sentences, cut and normalised as texts are.
    cut = plain.collect()
    table = {PIECES.join(r["s"]): r["id"] for r in cut}
    heads = {n: sorted({r["s"][0] for r in cut if len(r["s"]) == n}) for n in {len(r["s"]) for r in cut} - {1}}
    known = F.create_map(*[F.lit(x) for pair in table.items() for x in pair])
    none = F.array().cast("array<string>")
    text = text_or_empty()
    hinted = F.col("text").rlike(HINT)
    found = docs.select("doc_id", *[F.when(hinted, _identifiers(text, at, known, heads)).otherwise(none).alias(name) for name, at in (("hard", BREAK), ("soft", SOFT_BREAK))])
    # The reading that recognises more sentences gives the sequence that is shown.
    soft = F.size("soft") > F.size("hard")
    found = found.select("doc_id", F.when(soft, F.col("soft")).otherwise(F.col("hard")).alias("ids"), F.when(soft, F.col("hard")).otherwise(F.col("soft")).alias("other"))
    found = found.select("doc_id", "ids", _licenses(F.col("ids")).alias("shown"), _licenses(F.col("other")).alias("more"))
    within = F.create_map(*[x for name, over in WIDER.items() if over for x in (F.lit(name), F.array(*map(F.lit, over)))])
    every = F.array_union("shown", "more")
    more = F.filter("more", lambda name: ~F.coalesce(F.arrays_overlap(F.try_element_at(within, name), every), F.lit(False)))
    licenses = F.array_join(F.array_sort(F.array_union("shown", more)), ",")
    return found.select("doc_id", F.size("ids").cast("long").alias("n_sentences"), F.array_join("ids", ",").alias("sentences"), licenses.alias("licenses"))
