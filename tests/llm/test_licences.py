"""Known notices, full texts that are not also their notices, and odd input."""

import re

import pytest

from tallyward.llm import licences

APACHE = (
    'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the '
    "License.\nYou may obtain a copy of the License at\n\n    http://www.apache.org/licenses/LICENSE-2.0\n"
)
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License "
    "as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."
)

CASES = [
    (None, ""), ("", ""), ("\n \n", ""), ("Nothing here. At all.", ""),
    ("Some text.\nLicensed under the Apache License, Version 2.0.\nMore.", "Apache-2.0"),
    ("Released under the MIT License. And so on", "MIT"),
    ("RELEASED  UNDER THE MIT LICENSE", "MIT"),
    ("This work is licensed under the GNU General Public License, version 3.", "GPL-3.0-only"),
    ("Licensed under CC BY-NC 4.0.\nAll rights reserved.", "CC-BY-NC-4.0,All-Rights-Reserved"),
    ("Licensed under CC BY 4.0.\nLicensed under CC BY 4.0.", "CC-BY-4.0"),
    ("A story about how it was not licensed under the Apache License, Version 2.0 at all.", ""),
    (GPL, "GPL-3.0-or-later"), (APACHE, "Apache-2.0"),
    ("filler text. " * 20000 + "All rights reserved.", "All-Rights-Reserved"),
]


def test_cases(spark):
    rows = [(i // 2, text, "x") for i, (text, _) in enumerate(CASES)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, licences string").coalesce(1)
    assert [r["licences"] for r in licences.report(frame).collect()] == [expected for _, expected in CASES]
    assert licences.report(frame.limit(0)).count() == 0


def test_sequence(spark):
    frame = spark.createDataFrame([(1, "A. B.\nAll rights reserved.\nThe MIT License\nC")], "doc_id long, text string")
    (row,) = licences.scan(frame).collect()
    assert row["sentence_ids"] == [".", "AllRights", "MitTitle", "."]
    assert (row["n_sentences"], row["n_known"], row["unmatched"]) == (5, 2, 1)


@pytest.mark.parametrize("name", sorted({n for _, rule in licences.RULES for n in rule}))
def test_rules_use_known_sentences(name):
    assert name in licences.SENTENCES or name == "."


MIT_TEXT = """MIT License

Copyright (c) 2020 Somebody

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER
LIABILITY.
"""
BSD_TEXT = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
ENDORSE = """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
GPL_TEXT = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.
"""
APACHE_TEXT = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
CANONICAL = {
    "MIT": MIT_TEXT, "BSD-2-Clause": BSD_TEXT, "BSD-3-Clause": BSD_TEXT + ENDORSE, "GPL-3.0-or-later": GPL_TEXT, "Apache-2.0": APACHE_TEXT,
    "GPL-2.0-or-later": GPL_TEXT.replace("software:", "software;").replace("Foundation,", "Foundation;").replace("version 3", "version 2"),
}


def test_canonical_texts(spark):
    """Whole licence texts: wrapped, in comments, with other line ends, unwrapped, with other list marks."""
    changes = [
        lambda t: t,
        lambda t: "".join(f" * {line}\n" for line in t.split("\n")),
        lambda t: "".join(f"# {line}\n".replace("#  ", "# ") for line in t.split("\n")),
        lambda t: t.replace("\n", "\r\n"),
        lambda t: re.sub(r"(?<!\n)\n(?!\n) *", " ", t),
        lambda t: re.sub(r"(?m)^(\d)\.", r"(\1)", t),
        lambda t: re.sub(r"(?m)^\d\.", "*", t),
        lambda t: f"Some words.\nA line before\n\n{t}\nand one after",
    ]
    rows = [(name, change(text)) for name, text in CANONICAL.items() for change in changes]
    frame = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    got = [(r["doc_id"], r["licences"], r["unmatched"]) for r in licences.report(frame).collect()]
    assert [g for g in got if g[1] != g[0]] == []
    assert {g for g in got if g[2]} <= {("MIT", "MIT", 1)}  # its title


NOTICES = {
    "LGPL-2.1-or-later": GPL_TEXT.replace("program", "library").replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "LGPL-3.0-or-later": GPL_TEXT.replace("program", "library").replace("GNU General", "GNU Lesser General"),
    "AGPL-3.0-or-later": GPL_TEXT.replace("GNU General", "GNU Affero General"),
    "GPL-2.0-only": """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License version 2 as
published by the Free Software Foundation.
""",
    "BSD-3-Clause": "Copyright (c) 2020, Somebody\nAll rights reserved.\n\n" + BSD_TEXT + ENDORSE,
    "BSD-2-Clause": "Copyright (c) 2020, Somebody. All rights reserved.\n\n" + BSD_TEXT,
    "ISC": """ISC License

Copyright (c) 2020, Somebody

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY DAMAGES.
""",
    "0BSD": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH
REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY
AND FITNESS.
""",
    "MPL-2.0": """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
""",
    "Zlib": """This software is provided 'as-is', without any express or implied
warranty. In no event will the authors be held liable for any damages
arising from the use of this software.

Permission is granted to anyone to use this software for any purpose,
including commercial applications, and to alter it and redistribute it
freely, subject to the following restrictions:
""",
    "Unlicense": "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy.",
    "EPL-2.0": """This program and the accompanying materials are made
available under the terms of the Eclipse Public License 2.0
which is available at https://www.eclipse.org/legal/epl-2.0/
""",
    "BSL-1.0": "Distributed under the Boost Software License, Version 1.0.\n   (See accompanying file LICENSE_1_0.txt)\n",
    "Apache-2.0": "   Apache License\n  Version 2.0, January 2004\n  http://www.apache.org/licenses/\n\nTERMS AND CONDITIONS\n",
    "GPL-3.0-only": "  GNU GENERAL PUBLIC LICENSE\n    Version 3, 29 June 2007\n\n Copyright (C) 2007\n",
    "LGPL-2.1-only": "  GNU LESSER GENERAL PUBLIC LICENSE\n    Version 2.1, February 1999\n\n Copyright (C) 1991\n",
}


def test_more_notices(spark):
    changes = [lambda t: t, lambda t: "".join(f" * {line}\n" for line in t.split("\n")), lambda t: f"Words before.\n\n{t}\n\nand after"]
    rows = [(name, change(text)) for name, text in NOTICES.items() for change in changes]
    frame = spark.createDataFrame(rows, "doc_id string, text string").coalesce(1)
    got = [(r["doc_id"], r["licences"]) for r in licences.report(frame).collect()]
    assert [g for g in got if g[0] != g[1]] == []


def test_sentences_end(spark):
    """A sentence runs over single line breaks only, not over its end or a blank line."""
    cases = [
        ("Licensed under the\nApache License,\n  Version 2.0", "Apache-2.0"), ("Licensed under the\n\nApache License, Version 2.0", ""),
        ("Licensed under the.\nApache License, Version 2.0", ""), ("Licensed under\n *\n * the MIT License", ""),
        ("It is\nreleased under the MIT License\nas such", "MIT"), ("Somebody released under the\nMIT License", ""),
        ("许可\nAll rights reserved.", "All-Rights-Reserved"), ("All rights\n许可\nreserved.", ""), ("", ""),
        (MIT_TEXT.replace("\n\nThe above", "\n\n许可\n\nThe above"), ""),
        ("You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0", ""),
    ]
    frame = spark.createDataFrame([(i, text) for i, (text, _) in enumerate(cases)], "doc_id long, text string").coalesce(1)
    got = licences.report(frame).collect()
    assert [r["licences"] for r in got] == [expected for _, expected in cases]
    assert got[-1]["sentence_ids"] == "Apache2Copy"


def test_every_sentence_holds_a_key():
    forms = [s for table in (licences.SENTENCES, licences.FORMS) for texts in table.values() for s in texts]
    assert [s for s in forms if not any(key in s for key in licences.KEYS)] == []
