"""Licence scan by sentence rules, in DataFrame functions only.

Texts are normalised (lower case, only letters, digits, dots and hyphens) with a mark where a sentence ends and a lighter one where a line,
table cell or clause (`;`, `:`) does. A known licence sentence is found wherever it stands between two marks of either kind; lighter marks
may also stand inside it, so it may be wrapped, and a line of its own need not follow a full stop. A document becomes a sequence of
identifiers, with a bar where other text stands between.
Rules, in order, replace a run of identifiers by the licence it means, so that a longer rule takes its sentences before a shorter one
sees them. What no rule takes is reported as unmatched.

Every known sentence holds one of `ANCHORS`, so only texts with such a word are cut up. Null and empty texts have no licence.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from plumbline.llm.tables import free, without

#: Normalised sentences by identifier.
SENTENCES = {
    "all-rights-reserved": ["all rights reserved"],
    "apache-2": ["licensed under the apache license version 2.0", "licensed under the apache license version 2.0 the license"],
    "apache-comply": ["you may not use this file except in compliance with the license"],
    "apache-obtain": ["you may obtain a copy of the license at http www.apache.org licenses license-2.0", "you may obtain a copy of the license at https www.apache.org licenses license-2.0"],
    "apache-warranty": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied"
    ],
    "apache-see": ["see the license for the specific language governing permissions and limitations under the license"],
    "bsd-permit": [
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"
    ],
    "bsd-source": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "bsd-binary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the "
        "documentation and or other materials provided with the distribution"
    ],
    "bsd-endorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from "
        "this software without specific prior written permission"
    ],
    "bsd-warranty": [
        "this software is provided by the copyright holders and contributors as is and any express or implied warranties including but not "
        "limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed"
    ],
    "cc-by-4": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "cc-by-nc-4": ["licensed under cc by-nc 4.0", "this work is licensed under a creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa-4": ["licensed under cc by-sa 4.0", "this work is licensed under a creative commons attribution-sharealike 4.0 international license"],
    "gpl-2": ["this work is licensed under the gnu general public license version 2", "licensed under the gnu general public license version 2"],
    "gpl-3": ["this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3"],
    "gpl-3-later": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 3 of the license or at your option any later version"
    ],
    "gpl-2-later": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation either version 2 of the license or at your option any later version"
    ],
    "gpl-warranty": [
        "this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose"
    ],
    "gpl-see": ["see the gnu general public license for more details"],
    "mit": ["released under the mit license", "licensed under the mit license", "mit license"],
    "mit-permit": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial "
        "portions of the software",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the "
        "software to deal in the software without restriction including without limitation the rights to use copy modify merge publish "
        "distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to "
        "the following conditions",
    ],
    "mit-notice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "mit-warranty": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of "
        "merchantability fitness for a particular purpose and noninfringement"
    ],
    "mit-liability": [
        "in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract "
        "tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software"
    ],
    "spdx-apache-2": ["spdx-license-identifier apache-2.0"],
    "spdx-mit": ["spdx-license-identifier mit"],
}

#: Licence and the run of identifiers that means it; the first rule that fits takes the run.
RULES = [
    ("MIT", ["mit", "mit-permit", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-permit", "mit-notice", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit", "mit-permit", "mit-warranty", "mit-liability"]),
    ("MIT", ["mit-permit", "mit-warranty", "mit-liability"]),
    ("Apache-2.0", ["apache-2", "apache-comply", "apache-obtain", "apache-warranty", "apache-see"]),
    ("BSD-3-Clause", ["bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("BSD-2-Clause", ["bsd-permit", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("GPL-3.0-or-later", ["gpl-3-later", "gpl-warranty", "gpl-see"]),
    ("GPL-2.0-or-later", ["gpl-2-later", "gpl-warranty", "gpl-see"]),
    ("GPL-3.0-or-later", ["gpl-3-later"]),
    ("GPL-2.0-or-later", ["gpl-2-later"]),
    ("GPL-3.0", ["gpl-3"]),
    ("GPL-2.0", ["gpl-2"]),
    ("Apache-2.0", ["apache-2"]),
    ("Apache-2.0", ["spdx-apache-2"]),
    ("MIT", ["mit"]),
    ("MIT", ["spdx-mit"]),
    ("CC-BY-4.0", ["cc-by-4"]),
    ("CC-BY-NC-4.0", ["cc-by-nc-4"]),
    ("CC-BY-SA-4.0", ["cc-by-sa-4"]),
    ("Proprietary", ["all-rights-reserved"]),
]

def _spdx() -> tuple[dict, list]:
    """Sentences and rules of the SPDX lines that `SENTENCES` does not have, with old and new names."""
    names = {n: [n] for n in ("BSD-2-Clause", "BSD-3-Clause", "MPL-2.0", "ISC", "CC-BY-4.0", "CC-BY-NC-4.0", "CC-BY-SA-4.0")}
    for n in ("GPL-2.0", "GPL-3.0", "LGPL-2.1", "LGPL-3.0", "AGPL-3.0"):
        names |= {n: [n, f"{n}-only"], f"{n}-or-later": [f"{n}-or-later"]}
    sentences = {f"spdx-{n.lower()}": [f"spdx-license-identifier {x.lower()}" for x in many] for n, many in names.items()}
    return sentences, [(n, [f"spdx-{n.lower()}"]) for n in names]


def _later(program: str, name: str, version: str) -> str:
    return (
        f"this {program} is free software you can redistribute it and or modify it under the terms of the gnu {name} general public license as published "
        f"by the free software foundation either version {version} of the license or at your option any later version"
    )


def _gnu_warranty(program: str) -> str:
    return (
        f"this {program} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose"
    )


#: Sentences of published headers and texts beyond `SENTENCES`.
PUBLISHED = {
    "apache-2": [
        "licensed to you under the apache license version 2.0 the license",
        "the asf licenses this file to you under the apache license version 2.0 the license",
        "apache license version 2.0",
    ],
    "apache-obtain": [f"you may obtain a copy of the license at {p} www.apache.org licenses license-2.0.{x}" for p in ("http", "https") for x in ("txt", "html")],
    "mit": ["the mit license", "the mit license mit", "mit license mit"],
    "mit-notice": [
        "the above copyright notice and this permission notice including the next paragraph shall be included in all copies or substantial portions of the software"
    ],
    "bsd-2": ["licensed under the bsd 2-clause license", "bsd 2-clause license", "the bsd 2-clause license"],
    "bsd-3": ["licensed under the bsd 3-clause license", "bsd 3-clause license", "the bsd 3-clause license"],
    "cc-by-4": ["this work is licensed under cc by 4.0", "this work is licensed under the creative commons attribution 4.0 international license"],
    "cc-by-nc-4": ["this work is licensed under cc by-nc 4.0", "this work is licensed under the creative commons attribution-noncommercial 4.0 international license"],
    "cc-by-sa-4": ["this work is licensed under cc by-sa 4.0", "this work is licensed under the creative commons attribution-sharealike 4.0 international license"],
    "gpl-2-only": [
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published "
        "by the free software foundation",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published "
        "by the free software foundation version 2 of the license",
    ],
    "lgpl-2.1-later": [_later(p, "lesser", "2.1") for p in ("library", "program")],
    "lgpl-3-later": [_later(p, "lesser", "3") for p in ("library", "program")],
    "lgpl-2.1": ["licensed under the gnu lesser general public license version 2.1", "this work is licensed under the gnu lesser general public license version 2.1"],
    "lgpl-3": ["licensed under the gnu lesser general public license version 3", "this work is licensed under the gnu lesser general public license version 3"],
    "lgpl-warranty": [_gnu_warranty("library")],
    "lgpl-see": ["see the gnu lesser general public license for more details"],
    "agpl-3-later": [_later("program", "affero", "3")],
    "agpl-3": ["licensed under the gnu affero general public license version 3", "this work is licensed under the gnu affero general public license version 3"],
    "agpl-see": ["see the gnu affero general public license for more details"],
    "mpl-2": [
        "this source code form is subject to the terms of the mozilla public license v 2.0",
        "licensed under the mozilla public license version 2.0",
        "licensed under the mozilla public license v 2.0",
    ],
    "mpl-obtain": [f"if a copy of the mpl was not distributed with this file you can obtain one at {a} mpl 2.0" for p in ("http", "https") for a in (f"{p} mozilla.org", f"{p} www.mozilla.org")],
    "isc": ["licensed under the isc license", "released under the isc license", "isc license", "the isc license", "isc license isc", "the isc license isc"],
    "isc-permit": [
        f"permission to use copy modify {how} distribute this software for any purpose with or without fee is hereby granted provided that the above "
        "copyright notice and this permission notice appear in all copies"
        for how in ("and or", "and")
    ],
    "isc-warranty": [
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness"
    ],
    "isc-liability": [
        "in no event shall the author be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from "
        "loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the "
        "use or performance of this software"
    ],
}

#: Rules for `PUBLISHED`.
PUBLISHED_RULES = [
    ("BSD-3-Clause", ["all-rights-reserved", "bsd-permit", "bsd-source", "bsd-binary", "bsd-endorse", "bsd-warranty"]),
    ("BSD-2-Clause", ["all-rights-reserved", "bsd-permit", "bsd-source", "bsd-binary", "bsd-warranty"]),
    ("GPL-2.0", ["gpl-2-only", "gpl-warranty", "gpl-see"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-later", "lgpl-warranty", "lgpl-see"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-later", "gpl-warranty", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl-3-later", "lgpl-warranty", "lgpl-see"]),
    ("LGPL-3.0-or-later", ["lgpl-3-later", "gpl-warranty", "lgpl-see"]),
    ("AGPL-3.0-or-later", ["agpl-3-later", "gpl-warranty", "agpl-see"]),
    ("MPL-2.0", ["mpl-2", "mpl-obtain"]),
    ("ISC", ["isc-permit", "isc-warranty", "isc-liability"]),
    ("GPL-2.0", ["gpl-2-only"]),
    ("LGPL-2.1-or-later", ["lgpl-2.1-later"]),
    ("LGPL-3.0-or-later", ["lgpl-3-later"]),
    ("AGPL-3.0-or-later", ["agpl-3-later"]),
    ("LGPL-2.1", ["lgpl-2.1"]),
    ("LGPL-3.0", ["lgpl-3"]),
    ("AGPL-3.0", ["agpl-3"]),
    ("MPL-2.0", ["mpl-2"]),
    ("ISC", ["isc"]),
    ("BSD-2-Clause", ["bsd-2"]),
    ("BSD-3-Clause", ["bsd-3"]),
]

#: Single words (or parts) of which every known sentence holds one, however it is wrapped.
ANCHORS = ["license", "copyright", "reserved", "redistribut", "permission", "warrant", "mozilla", "tortious"]

#: Sign of a list item or comment word at the beginning of a line.
ITEM = r"(?<=^|\n)[^a-z0-9\n|]*+(?:rem|dnl|[0-9a-z][)])(?=[ \t])"

#: Stops that end a sentence: not inside a name, number or address. A second step is taken for "v. 2".
STOP = r"(?<![.!?])[.!?]++(?![a-z0-9_/-])(?!(?<=\bv\.)[ \t\r\n]+[0-9])"


def _marked(text: Column) -> Column:
    """Words of the text with one sign between them: `|` where a sentence ends, a line break at lighter marks, or a space."""
    s = F.translate(F.regexp_replace(F.lower(text), r"(?<=gpl-[0-9][.][0-9])[+]", "-or-later"), "|;:", "\n\n\n")
    for pattern, sign in (
        (STOP, "|"),
        (ITEM, "\n"),
        (r"[^a-z0-9.|\n-]+", " "),
        (r"(?<![a-z0-9])[.-]+|[.-]+(?![a-z0-9])", " "),
        (r" {2,}", " "),
        (r" ?\n[ \n]*", "\n"),
        (r"[ \n]?\|[ \n|]*", "|"),
        (r"^ | $", ""),
    ):
        s = F.regexp_replace(s, pattern, sign)
    return s


def known_sentences() -> dict[str, str]:
    """Identifier of every known sentence."""
    return {s: i for bank in (SENTENCES, PUBLISHED, _spdx()[0]) for i, many in bank.items() for s in many}


def rules() -> list[tuple[str, list[str]]]:
    """All rules, longer ones first, else in order."""
    return sorted([*RULES, *PUBLISHED_RULES, *_spdx()[1]], key=lambda rule: -len(rule[1]))


def _identifiers(text: Column) -> Column:
    """`<id>` for known sentences and `|` for other text, as one string."""
    known = known_sentences()
    names = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    longest_first = sorted(known, key=lambda s: (-len(s), s))
    words = "|".join(s.replace(".", "[.]").replace(" ", "[ \n]") for s in longest_first)
    pattern = rf"(?<=^|[|\n])(?:{words})(?=[|\n]|$)"
    marked = _marked(text)
    found = F.transform(F.regexp_extract_all(marked, F.lit(pattern), F.lit(0)), lambda s: F.concat(F.lit("<"), names[F.translate(s, "\n", " ")], F.lit(">")))
    # Between: more than single letters and digits, as before list items, is other text.
    between = F.transform(F.split(marked, pattern, -1), lambda s: F.when(s.rlike(r"[^|\n]{2}"), "|").otherwise(""))
    return F.array_join(F.zip_with(between, found, lambda b, f: F.concat(b, F.coalesce(f, F.lit("")))), "")


def find_licenses(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """Every row of `docs` with `licenses` (sorted, distinct) and `unmatched` (identifiers no rule took, in order), comma-joined.

    Columns of these names are replaced.
    """
    docs = without(docs, ["licenses", "unmatched"], (text_col,))
    text = F.coalesce(F.col(text_col), F.lit(""))
    low = F.lower(text)
    anchored = low.contains(ANCHORS[0])
    for word in ANCHORS[1:]:
        anchored = anchored | low.contains(word)
    run = F.when(anchored, _identifiers(text)).otherwise("")
    for licence, ids in rules():
        run = F.replace(run, F.lit("".join(f"<{i}>" for i in ids)), F.lit(f"[{licence}]"))
    inside = free(docs, "run")
    licences = F.array_sort(F.array_distinct(F.regexp_extract_all(inside, F.lit(r"\[([^\]]+)\]"), F.lit(1))))
    unmatched = F.regexp_extract_all(inside, F.lit("<([^>]+)>"), F.lit(1))
    kept = [F.col(f"`{c}`") for c in docs.columns]
    return docs.withColumn(inside, run).select(*kept, F.array_join(licences, ",").alias("licenses"), F.array_join(unmatched, ",").alias("unmatched"))
