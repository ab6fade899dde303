"""Licence scan by sentence rules, with DataFrame operations only.

A text is cut into sentences, each is normalised, and a sentence that is known from licence texts and notices becomes its
identifier, also when it is wrapped over the lines of a paragraph; runs of other sentences become a gap. Ordered rules then match
sequences of identifiers, passing over list numbers, lines without a word and lines that are a URL. A rule that matches takes its
identifiers out of the sequence, so that a licence's full text is not also found as the notice it contains.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyward.llm.common import documents

# Sentences of public licence texts and notices, lower-cased, with runs of other characters than a-z, 0-9 and
# the point inside numbers as one space.
SENTENCES = {
    "Apache2Short": ["licensed under the apache license version 2.0"],
    "Apache2Grant": ["licensed under the apache license version 2.0 the license", "you may not use this file except in compliance with the license"],
    "Apache2Copy": ["you may obtain a copy of the license at", "you may obtain a copy of the license at http www apache org licenses license 2.0"],
    "Apache2AsIs": [
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied",
    ],
    "Apache2See": ["see the license for the specific language governing permissions and limitations under the license"],
    "MitShort": ["released under the mit license", "licensed under the mit license", "this project is licensed under the mit license"],
    "MitTitle": ["mit license", "the mit license", "the mit license mit"],
    "MitGrant": [
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
    ],
    "MitNotice": ["the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software"],
    "MitAsIs": [
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
    ],
    "Gpl3Short": [
        "this work is licensed under the gnu general public license version 3", "licensed under the gnu general public license version 3",
        "licensed under the gnu general public license v3.0",
    ],
    "GplFree": ["this program is free software"],
    "Gpl3OrLater": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "Gpl2OrLater": [
        "you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version",
    ],
    "GplHope": ["this program is distributed in the hope that it will be useful but without any warranty"],
    "CcByNc4": ["licensed under cc by nc 4.0", "this work is licensed under cc by nc 4.0", "this work is licensed under a creative commons attribution noncommercial 4.0 international license"],
    "CcBySa4": ["licensed under cc by sa 4.0", "this work is licensed under a creative commons attribution sharealike 4.0 international license"],
    "CcBy4": ["licensed under cc by 4.0", "this work is licensed under a creative commons attribution 4.0 international license"],
    "Cc0": ["cc0 1.0 universal", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"],
    "BsdRedistribution": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"],
    "BsdSource": ["redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer"],
    "BsdBinary": [
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution",
    ],
    "BsdEndorse": [
        "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission",
    ],
    "Mpl2": ["this source code form is subject to the terms of the mozilla public license v 2.0", "licensed under the mozilla public license version 2.0"],
    "AllRights": ["all rights reserved"],
    "LgplFree": ["this library is free software"],
    "Lgpl21OrLater": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 2.1 of the license or at your option any later version",
    ],
    "Lgpl3OrLater": [
        "you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "Agpl3OrLater": [
        "you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation either version 3 of the license or at your option any later version",
    ],
    "Gpl2Only": ["you can redistribute it and or modify it under the terms of the gnu general public license version 2 as published by the free software foundation"],
    "Gpl2Short": ["licensed under the gnu general public license version 2", "licensed under the gnu general public license v2.0"],
    "Gpl2Head": ["gnu general public license version 2 june 1991"],
    "Gpl3Head": ["gnu general public license version 3 29 june 2007"],
    "Lgpl21Head": ["gnu lesser general public license version 2.1 february 1999"],
    "Lgpl3Head": ["gnu lesser general public license version 3 29 june 2007"],
    "Agpl3Head": ["gnu affero general public license version 3 19 november 2007"],
    "Apache2Head": ["apache license version 2.0 january 2004"],
    "IscGrant": [
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies",
    ],
    "ZeroBsdGrant": ["permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"],
    "IscAsIs": [
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
    ],
    "Unlicense": ["this is free and unencumbered software released into the public domain"],
    "ZlibAsIs": ["this software is provided as is without any express or implied warranty"],
    "ZlibGrant": [
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
    ],
    "Epl2": ["this program and the accompanying materials are made available under the terms of the eclipse public license 2.0"],
    "Boost1": ["distributed under the boost software license version 1.0"],
}

# Further forms of the same sentences, normalised alike. A bar is where a form has a sentence end of its own.
FORMS = {
    "Apache2Copy": [f"you may obtain a copy of the license at {scheme} www.apache.org licenses license 2.0" for scheme in ("http", "https")],
    "Gpl3OrLater": [SENTENCES["Gpl3OrLater"][0].replace(" either ", " | either ")],
    "Gpl2OrLater": [SENTENCES["Gpl2OrLater"][0].replace(" either ", " | either ")],
    "Lgpl21OrLater": [SENTENCES["Lgpl21OrLater"][0].replace(" either ", " | either ")],
    "Lgpl3OrLater": [SENTENCES["Lgpl3OrLater"][0].replace(" either ", " | either ")],
    "Agpl3OrLater": [SENTENCES["Agpl3OrLater"][0].replace(" either ", " | either ")],
    "Mpl2": ["this source code form is subject to the terms of the mozilla public license v | 2.0"],
    "Epl2": [f"{SENTENCES['Epl2'][0]} which is available at {scheme} www.eclipse.org legal epl 2.0" for scheme in ("http", "https")],
}
#: Every known sentence holds one of these, so that a text without them has none.
KEYS = ("licens", "software", "warranty", "redistribution", "rights", "cc0")

# Fixed order: longer sequences first, so that what a rule takes is not left for a weaker one. (licence, identifiers in order,
# a point for other sentences between them)
RULES = [
    ("Apache-2.0", ("Apache2Grant", "Apache2Grant", "Apache2Copy", "Apache2AsIs", "Apache2See")),
    ("Apache-2.0", ("Apache2Grant", "Apache2Copy")),
    ("LGPL-2.1-or-later", ("LgplFree", "Lgpl21OrLater")),
    ("LGPL-3.0-or-later", ("LgplFree", "Lgpl3OrLater")),
    ("LGPL-3.0-or-later", ("GplFree", "Lgpl3OrLater")),
    ("AGPL-3.0-or-later", ("GplFree", "Agpl3OrLater", "GplHope")),
    ("AGPL-3.0-or-later", ("GplFree", "Agpl3OrLater")),
    ("GPL-2.0-only", ("GplFree", "Gpl2Only")),
    ("GPL-3.0-or-later", ("GplFree", "Gpl3OrLater", "GplHope")),
    ("GPL-3.0-or-later", ("GplFree", "Gpl3OrLater")),
    ("GPL-2.0-or-later", ("GplFree", "Gpl2OrLater", "GplHope")),
    ("GPL-2.0-or-later", ("GplFree", "Gpl2OrLater")),
    # The reservation of rights in a copyright line is a part of these texts.
    ("BSD-3-Clause", ("AllRights", "BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("AllRights", "BsdRedistribution", "BsdSource", "BsdBinary")),
    ("BSD-3-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary", "BsdEndorse")),
    ("BSD-2-Clause", ("BsdRedistribution", "BsdSource", "BsdBinary")),
    ("MIT", ("MitTitle", "MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitGrant", "MitNotice", "MitAsIs")),
    ("MIT", ("MitGrant", "MitNotice")),
    ("ISC", ("IscGrant", "IscAsIs")),
    ("ISC", ("IscGrant",)),
    ("0BSD", ("ZeroBsdGrant", "IscAsIs")),
    ("Zlib", ("ZlibAsIs", ".", "ZlibGrant")),
    ("Unlicense", ("Unlicense",)),
    ("Apache-2.0", ("Apache2Head",)),
    ("GPL-2.0-only", ("Gpl2Head",)),
    ("GPL-3.0-only", ("Gpl3Head",)),
    ("LGPL-2.1-only", ("Lgpl21Head",)),
    ("LGPL-3.0-only", ("Lgpl3Head",)),
    ("AGPL-3.0-only", ("Agpl3Head",)),
    ("Apache-2.0", ("Apache2Short",)),
    ("Apache-2.0", ("Apache2Grant",)),
    ("MIT", ("MitShort",)),
    ("GPL-3.0-only", ("Gpl3Short",)),
    ("GPL-2.0-only", ("Gpl2Short",)),
    ("EPL-2.0", ("Epl2",)),
    ("BSL-1.0", ("Boost1",)),
    ("CC-BY-NC-4.0", ("CcByNc4",)),
    ("CC-BY-SA-4.0", ("CcBySa4",)),
    ("CC-BY-4.0", ("CcBy4",)),
    ("CC0-1.0", ("Cc0",)),
    ("MPL-2.0", ("Mpl2",)),
    ("All-Rights-Reserved", ("AllRights",)),
]

#: Each identifier as one character of a private area, so that a sequence is a short string. A gap is a point.
_MARKS = {name: chr(0xE000 + i) for i, name in enumerate(SENTENCES)}
_GAP = "."


def sentences(text: Column) -> Column:
    """The sentences of a text that are not blank. A sentence ends at a line break, or at a full stop, colon, semicolon,
    question or exclamation mark before white space."""
    ended = F.regexp_replace(F.coalesce(text, F.lit("")), r"([.:;?!])[ \t\r]+", "$1\n")
    return F.filter(F.split(ended, "\n"), lambda s: F.trim(s) != "")


#: Ends in a normalised text: a line break is one that a sentence may run over, `_END` is none. `_PASSED` is a piece without words.
_PASSED, _END = "\uf8f0", "\uf8f1"
_START, _STOP = rf"(?<![^\n{_END}])", rf"(?=[\n{_END}]|\z)"

# Each pattern with what replaces it, in order. The text is in lower case.
_STEPS = [
    (r"[\uE000-\uF8FF]", "#"),
    (r"([.:;?!])[ \t\r]+", rf"$1{_END}"),
    (r"""([.:;?!]["')\]\u201D\u2019]*+[ \t\r]*+)(?=\n|\z)""", rf"$1{_END}"),
    # List numbers in brackets.
    (rf"{_START}[^\p{{L}}\p{{N}}\n{_END}]*+(?:[0-9]{{1,3}}|[a-z]|[ivx]{{1,5}})\)[ \t]+", f"{_PASSED}{_END}"),
    # Pieces that are a URL; that have words, but none of a-z and 0-9; that have no words.
    (rf"{_START}[^\p{{L}}\p{{N}}\n{_END}]*+(?:https?://|www\.)[^\s{_END}]++[ \t\r]*+{_STOP}", _PASSED),
    (rf"{_START}[^\p{{L}}\p{{N}}\n{_END}]*+[\p{{L}}\p{{N}}&&[^a-z0-9]][^a-z0-9\n{_END}]*+{_STOP}", "zz"),
    (rf"{_START}(?= *+[^ \n{_END}])[^a-z0-9\n{_END}]++{_STOP}", _PASSED),
    # Only a-z, 0-9 and points inside numbers or names, single spaces.
    (rf"[^a-z0-9.\n{_PASSED}{_END}]+", " "),
    (r"\.++(?![a-z0-9])", " "),
    (r" {2,}", " "),
    (rf" ?([\n{_END}]) ?", "$1"),
    # A line of blanks ends a sentence.
    (rf"[\n{_END}]{{2,}}", _END),
    (r"\A[ \n]+| \z", ""),
    # List numbers with a point.
    (rf"{_START}(?:[0-9]{{1,3}}|[a-z]|[ivx]{{1,5}})(?={_END})", _PASSED),
]


def _pattern(sentence: str) -> str:
    """A normalised sentence that fills whole pieces, its words parted by spaces or single line breaks."""
    parts = [r"[ \n]".join(word.replace(".", r"\.") for word in part.split()) for part in sentence.split("|")]
    return _START + rf"[\n{_END}]".join(parts) + _STOP


def sequence(text: Column) -> Column:
    """The text's known sentences as marks, all other pieces as gaps or, if the rules pass over them, as `_PASSED`.

    The longest sentences are looked for first: a title may be the end of a wrapped notice.
    """
    out = F.lower(text)
    for pattern, new in _STEPS:
        out = F.regexp_replace(out, pattern, new)
    pairs = [(sentence, mark) for name, mark in _MARKS.items() for sentence in SENTENCES[name] + FORMS.get(name, [])]
    for sentence, mark in sorted(pairs, key=lambda pair: -len(pair[0])):
        out = F.regexp_replace(out, _pattern(sentence), mark)
    return F.regexp_replace(F.regexp_replace(out, "[a-z0-9. ]+", _GAP), rf"[\n{_END}]", "")


def scan(frame: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row the id, `n_sentences`, `n_known`, `sentence_ids` (identifiers in order, gaps as a point) and `licences`, the
    distinct licences in the order of the rules, and `unmatched`, the known sentences that no rule took.

    A null text has no sentence, an empty one neither. No row is dropped; rows are independent, so repeated ids do not matter.
    Other columns are ignored. An empty table gives an empty result.
    """
    rows = documents(frame, id_column, text_column)
    marks = "".join(_MARKS.values())
    text = F.coalesce(F.col(f"`{text_column}`"), F.lit(""))
    lower, pieces = F.lower(text), F.size(sentences(text)).cast("long")
    any_key = reduce(or_, [F.contains(lower, F.lit(key)) for key in KEYS])
    found = rows.select(
        F.col(f"`{id_column}`").alias("_id"), pieces.alias("n_sentences"), F.when(any_key, sequence(text)).alias("_marks"),
    ).select(
        "_id", "n_sentences",
        F.coalesce(F.regexp_replace("_marks", rf"[{_GAP}{_PASSED}]+", _GAP), F.when(F.col("n_sentences") > 0, _GAP).otherwise("")).alias("_seen"),
        F.coalesce(F.regexp_replace(F.regexp_replace("_marks", _PASSED, ""), r"\.+", _GAP), F.lit(_GAP)).alias("_taken"),
    )
    left, hits = F.col("_taken"), []
    step = found.withColumn("_left", left)
    for at, (licence, names) in enumerate(RULES):
        wanted = "".join(_MARKS.get(n, n) for n in names)
        hits.append(F.when(F.col(f"_hit{at}"), F.lit(licence)))
        step = step.withColumns({f"_hit{at}": F.contains("_left", F.lit(wanted)), "_left": F.replace("_left", F.lit(wanted), F.lit(_GAP))})
    names = F.create_map(*[F.lit(x) for name, mark in _MARKS.items() for x in (mark, name)])
    ids = F.transform(F.split(F.col("_seen"), ""), lambda c: F.coalesce(F.try_element_at(names, c), c))
    return step.select(
        F.col("_id").alias(id_column), "n_sentences",
        (F.length("_seen") - F.length(F.translate("_seen", marks, ""))).cast("long").alias("n_known"),
        F.filter(ids, lambda c: c != "").alias("sentence_ids"),
        F.array_distinct(F.filter(F.array(*hits), lambda x: x.isNotNull())).alias("licences"),
        (F.length("_left") - F.length(F.translate("_left", marks, ""))).cast("long").alias("unmatched"),
    )


def report(frame: DataFrame) -> DataFrame:
    """The scan of every document with its lists as text."""
    return scan(frame).select(
        "doc_id", "n_sentences", "n_known", F.array_join("sentence_ids", " ").alias("sentence_ids"),
        F.array_join("licences", ",").alias("licences"), "unmatched",
    )


def _oracle() -> str:
    """The report as SQL: the tables of sentences and rules become VALUES, the rules nested replacements."""
    values = ", ".join(f"('{text}', '{_MARKS[name]}')" for name, texts in SENTENCES.items() for text in texts)
    names = ", ".join(f"('{mark}', '{name}')" for name, mark in _MARKS.items())
    steps, left = [], "seen"
    for at, (_, rule) in enumerate(RULES):
        wanted = "".join(_MARKS.get(n, n) for n in rule)
        steps.append(f"s{at} AS (SELECT *, contains(left{at}, '{wanted}') AS hit{at}, replace(left{at}, '{wanted}', '.') AS left{at + 1} FROM {f's{at - 1}' if at else 'seq'})")
    hits = ", ".join(f"CASE WHEN hit{at} THEN '{licence}' END" for at, (licence, _) in enumerate(RULES))
    marks = "[" + "".join(_MARKS.values()) + "]"
    last = f"left{len(RULES)}"
    order = ", ".join(f"'{x}'" for x in dict.fromkeys(licence for licence, _ in RULES))
    return rf"""
WITH known(text, mark) AS (VALUES {values}), named(mark, name) AS (VALUES {names}), cut AS (
  SELECT doc_id, string_split(regexp_replace(coalesce(text, ''), '([.:;?!])[ \t\r]+', '\1' || chr(10), 'g'), chr(10)) AS s FROM documents
), rows AS (
  SELECT doc_id, i, trim(regexp_replace(regexp_replace(lower(s[i]), '[^a-z0-9.]+', ' ', 'g'), '\.+( |$)', ' ', 'g')) AS n
  FROM cut, LATERAL (SELECT unnest(range(1, len(s) + 1)) AS i) WHERE trim(s[i], ' ') <> ''
), marked AS (SELECT doc_id, i, coalesce(mark, '.') AS m FROM rows LEFT JOIN known ON n = known.text
), joined AS (
  SELECT doc_id, count(*) AS n_sentences, regexp_replace(string_agg(m, '' ORDER BY i), '\.+', '.', 'g') AS seen FROM marked GROUP BY doc_id
), seq AS (
  SELECT doc_id, coalesce(n_sentences, 0)::BIGINT AS n_sentences, coalesce(seen, '') AS seen, coalesce(seen, '') AS left0
  FROM documents LEFT JOIN joined USING (doc_id)
), {", ".join(steps)}, words AS (
  SELECT doc_id, string_agg(coalesce(name, c), ' ' ORDER BY i) AS ids
  FROM (SELECT doc_id, i, seen[i] AS c FROM seq, LATERAL (SELECT unnest(range(1, length(seen) + 1)) AS i)) LEFT JOIN named ON c = named.mark
  GROUP BY doc_id
)
SELECT doc_id, n_sentences, (length(seen) - length(regexp_replace(seen, '{marks}', '', 'g')))::BIGINT AS n_known,
       coalesce(ids, '') AS sentence_ids,
       array_to_string(list_filter([{order}], lambda x: list_contains([{hits}], x)), ',') AS licences,
       (length({last}) - length(regexp_replace({last}, '{marks}', '', 'g')))::BIGINT AS unmatched
FROM s{len(RULES) - 1} LEFT JOIN words USING (doc_id)
"""


ORACLE = _oracle()
