"""Labels of whole notices and licences against labels written by hand."""

import os

import pytest

from tessella.llm import licenses
from tests.conftest import documents

COPYRIGHT = "Copyright (c) 2024 Jane Roe and others. "
AS_IS = 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED'
MIT_END = (
    AS_IS + ", INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, "
    "WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."
)
GNU_END = "{0} is distributed in the hope that it will be useful,\n but WITHOUT ANY WARRANTY; without even the implied warranty of\n MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the\n {1} for more details."
BSD_END = (
    'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. '
    "IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; "
    "LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED."
)
LAPACK = "either version {0} of the License, or\n * (at your option) any later version.\n *\n * "
ZERO = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
NO_WARRANTY = (
    ' THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, '
    "OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."
)
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, "
    "publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. "
)
UNLICENSE = (
    "This is free and unencumbered software released into the public domain.\n\nAnyone is free to copy, modify, publish, use, compile, sell, or\ndistribute this software, either in source code form or as a compiled\nbinary, for any purpose, commercial or non-commercial, and by any\nmeans.\n\n"
    "In jurisdictions that recognize copyright laws, the author or authors\nof this software dedicate any and all copyright interest in the\nsoftware to the public domain. "
)
BOOST = (
    'Boost Software License - Version 1.0. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the Software, '
    "and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all subject to the following: "
)
BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. "
TRUTH = {
    "lgpl": COPYRIGHT + "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; " + LAPACK.format("2.1") + GNU_END.format("This library", "GNU Lesser General Public License"),
    "agpl": COPYRIGHT + "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, " + LAPACK.format("3") + GNU_END.format("This program", "GNU Affero General Public License"),
    "gpl": COPYRIGHT + "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; " + LAPACK.format("2") + GNU_END.format("This program", "GNU General Public License"),
    "0bsd": COPYRIGHT + ZERO + "." + NO_WARRANTY,
    "isc": COPYRIGHT + ZERO + ", provided that the above copyright notice and this permission notice appear in all copies." + NO_WARRANTY,
    "mit": COPYRIGHT + MIT + MIT_END,
    "boost": BOOST + MIT_END,
    "unlicense": UNLICENSE + MIT_END.replace("AUTHORS OR COPYRIGHT HOLDERS", "AUTHORS"),
    "bsd": COPYRIGHT + BSD + "2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. " + BSD_END,
    "mpl": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/.",
    "apache": COPYRIGHT + 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS.',
}
NONE = {
    "sentence": AS_IS + ".",
    "disclaimer of one licence": MIT_END,
    "disclaimer of another": BSD_END,
    "gnu disclaimer": GNU_END.format("This program", "manual"),
    "prose": "The map was distributed in the hope that it will be useful but without any warranty, as they say, and without even the implied warranty of accuracy.",
    "law": "Unless required by applicable law or agreed to in writing, no party pays for software that is distributed on an as is basis.",
    "grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of the key to the garden.",
}


def test_whole_notices_have_their_label_only(spark):
    rows = licenses.license_scan(documents(spark, [*TRUTH.values(), *NONE.values()])).collect()
    got = {r.doc_id: r.labels for r in rows}
    assert {name: got[i] for i, name in enumerate([*TRUTH, *NONE])} == {name: name if name in TRUTH else "" for name in [*TRUTH, *NONE]}
    assert all((r.score > 0) == (r.labels != "") for r in rows)


def test_notices_in_one_file_have_all_their_labels(spark):
    both = TRUTH["mit"] + "\n\nprose stands between them for a while, as it does in many files of this kind\n\n" + TRUTH["agpl"] + "\n\n" + TRUTH["0bsd"]
    row = licenses.license_scan(documents(spark, [both])).first()
    assert row.labels == "0bsd,agpl,mit" and {s.label for s in row.spans} == {"0bsd", "agpl", "mit"}
    assert [s.start for s in row.spans] == sorted(s.start for s in row.spans)


def test_a_shared_passage_tells_no_label():
    templates = [("one", "alpha beta gamma delta epsilon zeta eta theta"), ("two", "alpha beta gamma delta epsilon iota kappa lambda")]
    automaton, number, sizes = licenses.scanner(templates)
    tells = licenses.telling_states(automaton, templates)
    for text, label in (("alpha beta gamma delta epsilon", None), (templates[0][1], "one"), (templates[1][1], "two")):
        told = {}
        runs = licenses.runs_of(automaton, [number[w] for w in licenses.split_words(text)], 0, tells, told)
        held = licenses.accepted(licenses.chains(automaton, runs), told, sizes, templates)
        assert {templates[t][0] for t, *_ in held} == ({label} if label else set())


def test_own_templates_take_the_place_of_the_built_in_ones(spark):
    own = [("house", "Take what you need and leave the kitchen as you found it.")]
    rows = licenses.license_scan(documents(spark, ["Please take what you need, and leave the kitchen as you found it!", TRUTH["mit"]]), own).collect()
    assert [(r.labels, len(r.spans)) for r in sorted(rows, key=lambda r: r.doc_id)] == [("house", 1), ("", 0)]


FOLDER = "/usr/share/common-licenses"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="the system has no licence texts")
@pytest.mark.parametrize(("name", "label"), [("Apache-2.0", "apache"), ("GPL-2", "gpl"), ("GPL-3", "gpl"), ("LGPL-2.1", "lgpl"), ("LGPL-3", "lgpl"), ("MPL-2.0", "mpl"), ("BSD", "bsd"), ("CC0-1.0", "cc0"), ("Artistic", None)])
def test_whole_long_licences(spark, name, label):
    if not os.path.exists(f"{FOLDER}/{name}"):
        pytest.skip("no such text")
    with open(f"{FOLDER}/{name}", encoding="utf-8") as text:
        row = licenses.license_scan(documents(spark, [text.read()])).first()
    method = {s.label for s in row.spans}
    assert (label in row.labels.split(",") and method <= {label, "gpl", "lgpl"}) if label else not method
