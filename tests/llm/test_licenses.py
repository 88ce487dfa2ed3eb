"""License scans of whole notices as they stand in files, with hand-written results."""

import pytest
from threadlens.llm.licenses import RULES, scan_licenses

MIT = """MIT License

Copyright (c) 2020 Jane Doe

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
LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM,
OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE.
"""
ISC = """Copyright (c) 2020, Jane Doe

Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS.
"""
BSD = """Copyright (c) 2020, Jane Doe
All rights reserved.

Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.
2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
NAMES = """3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
BSD_END = """
THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS"
AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE
IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE
DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE
FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE.
"""
APACHE = """Copyright 2020 Jane Doe

Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License.
"""
GPL = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License
along with this program.  If not, see <https://www.gnu.org/licenses/>.
"""


def scanned(spark, texts):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    rows = sorted(scan_licenses(docs).collect(), key=lambda r: r.doc_id)
    return [(list(r.licenses), list(r.unmatched)) for r in rows]


def commented(text, first, each, last):
    return first + "".join(f"{each} {line}".rstrip() + "\n" for line in text.splitlines()) + last


WRAPPED = [
    (MIT, ["Copyright-notice", "MIT"]),
    (ISC, ["Copyright-notice", "ISC"]),
    (BSD + BSD_END, ["BSD-2-Clause", "Proprietary"]),
    (BSD + NAMES + BSD_END, ["BSD-3-Clause", "Proprietary"]),
    (APACHE, ["Apache-2.0", "Copyright-notice"]),
    (GPL, ["GPL-3.0"]),
    (GPL.replace("GNU General", "GNU Affero General"), ["AGPL-3.0"]),
    (GPL.replace("GNU General", "GNU Lesser General"), ["LGPL"]),
]
COMMENTS = [("", "", ""), ("/*\n", " *", " */\n"), ("", "//", ""), ("", "#", ""), ("<!--\n", "", "-->\n")]


@pytest.mark.parametrize("marks", COMMENTS)
def test_wrapped_notices(spark, marks):
    got = scanned(spark, [commented(text, *marks) for text, _ in WRAPPED])
    assert got == [(licenses, []) for _, licenses in WRAPPED]
    windows = scanned(spark, [commented(text, *marks).replace("\n", "\r\n") for text, _ in WRAPPED])
    assert windows == got


def test_sentences_end_at_points_and_empty_lines(spark):
    assert scanned(spark, [
        "You may not use this file except in\n\ncompliance with the License.",
        "You may not use this file except in.\ncompliance with the License.",
        "// You may not use this file except in\n//\n// compliance with the License.",
        "You may not use this file except in\ncompliance with the License.",
    ]) == [([], []), ([], []), ([], []), ([], ["APACHE2_COMPLY"])]


def test_places_are_in_order(spark):
    text = "x\nYou may not use this file except\nin compliance with the License.\n\ny\nAll rights reserved"
    docs = spark.createDataFrame([(1, text)], "doc_id int, text string")
    (row,) = scan_licenses(docs).collect()
    assert [(s.place, s.id) for s in row.sentences] == [(1, "APACHE2_COMPLY"), (3, "ALL_RIGHTS")]


def test_spdx_tags_name_their_licenses(spark):
    rows = [
        ("// SPDX-License-Identifier: Apache-2.0\nint x;", ["Apache-2.0"]),
        ("/* SPDX-License-Identifier: (GPL-2.0-only WITH Linux-syscall-note) OR MIT */", ["GPL-2.0", "MIT"]),
        ("# spdx-license-identifier: mit and (BSD-3-Clause or LGPL-2.1+)", ["BSD-3-Clause", "LGPL", "MIT"]),
        ("SPDX-License-Identifier: MIT, see LICENSE\nSPDX-License-Identifier:GPL-3.0-or-later", ["GPL-3.0", "MIT"]),
        ("<!-- SPDX-License-Identifier: CC-BY-NC-SA-4.0-->", ["CC-BY-NC-SA"]),
        ("SPDX-License-Identifier: Zlib OR LicenseRef-Own OR Zlib", ["LicenseRef-Own", "Zlib"]),
        ("SPDX-License-Identifier: MIT\nAND more", ["MIT"]), ("SPDX-License-Identifier:\nMIT", []),
        ("Released under the MIT License.", []), ("", []), (None, []),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(rows)], "doc_id int, text string")
    got = sorted((r.doc_id, list(r.tagged)) for r in scan_licenses(docs).collect())
    assert got == [(i, want) for i, (_, want) in enumerate(rows)]


GPL2 = """This program is free software; you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation; either version 2 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details.

You should have received a copy of the GNU General Public License along
with this program; if not, write to the Free Software Foundation, Inc.,
51 Franklin Street, Fifth Floor, Boston, MA 02110-1301 USA.
"""
LGPL21 = """This library is free software; you can redistribute it and/or
modify it under the terms of the GNU Lesser General Public
License as published by the Free Software Foundation; either
version 2.1 of the License, or (at your option) any later version.
"""
MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/.
"""
NOTICES = [
    (GPL2, ["GPL-2.0"]), (GPL2.replace("version 2", "version 3"), ["GPL-3.0"]), (LGPL21, ["LGPL"]),
    (MPL2, ["MPL-2.0"]), (" ".join(MPL2.split()), ["MPL-2.0"]), (" ".join(GPL2.split()), ["GPL-2.0"]),
    (ISC.replace("and/or", "and"), ["Copyright-notice", "ISC"]),
    (BSD_END.replace("THE COPYRIGHT HOLDERS", "FOO, INC."), []),
    ("Released under the MIT License, see LICENSE.", ["MIT"]),
    ("Licensed under an MIT licence; see the file COPYING.", ["MIT"]),
    ("It is distributed\nunder the terms of the MIT License (see LICENSE\nfor details).", ["MIT"]),
    ("Licensed under the BSD 3-Clause License.", ["BSD"]),
    ("Available under a two-clause BSD license that can be found in LICENSE.", ["BSD"]),
    ("Licensed under the Apache-2.0 license.", ["Apache-2.0"]),
    ("Licensed under the Apache License, Version 2.0, see NOTICE.", ["Apache-2.0"]),
    ("Licensed under the GNU General Public License v. 3.0 as in COPYING.", ["GPL-3.0"]),
    ("Licensed under the GNU General Public License version 2, see COPYING.", ["GPL-2.0"]),
    ("Released under MIT supervision. Available under the Apache tents.", []),
]


def test_standard_notices(spark):
    assert [x for x, _ in scanned(spark, [text for text, _ in NOTICES])] == [x for _, x in NOTICES]


UNDER = "This work is licensed under "
GRANT = "you can redistribute it and/or modify\nit under the terms of the GNU {} as published by\nthe Free Software Foundation; either version {} of the License, or later."
SAID = {
    "APACHE2_REF": 'Licensed under the Apache License, Version 2.0 (the "License");',
    "APACHE2_COMPLY": "you may not use this file except in compliance with the License.",
    "APACHE2_COPY": "You may obtain a copy of the License at\nhttp://www.apache.org/licenses/LICENSE-2.0\n",
    "APACHE2_AS_IS": APACHE[APACHE.index("Unless") : APACHE.index("See the")],
    "APACHE2_SEE": APACHE[APACHE.index("See the") :],
    "MIT_REF": UNDER + "the MIT License, see LICENSE.",
    "MIT_GRANT": MIT[MIT.index("Permission") : MIT.index("The above")],
    "MIT_NOTICE": MIT[MIT.index("The above") : MIT.index("THE SOFT")],
    "MIT_AS_IS": MIT[MIT.index("THE SOFT") : MIT.index("IN NO EV")],
    "MIT_LIABILITY": MIT[MIT.index("IN NO EV") :],
    "ISC_GRANT": ISC[ISC.index("Permission") : ISC.index("THE SOFT")],
    "ISC_AS_IS": ISC[ISC.index("THE SOFT") :],
    "BSD_REF": UNDER + "the BSD 3-Clause License.",
    "BSD_GRANT": BSD[BSD.index("Redistribution and") : BSD.index("1.")],
    "BSD_SOURCE": BSD[BSD.index("1.") : BSD.index("2. ")],
    "BSD_BINARY": BSD[BSD.index("2. ") :],
    "BSD_NAMES": NAMES,
    "BSD_AS_IS": BSD_END[: BSD_END.index("IN NO EV")],
    "BSD_LIABILITY": BSD_END[BSD_END.index("IN NO EV") :],
    "GPL_FREE": "This program is free software;",
    "AGPL3_GRANT": GRANT.format("Affero General Public License", 3),
    "LGPL_GRANT": GRANT.format("Lesser General Public License", 2.1),
    "GPL3_GRANT": GRANT.format("General Public License", 3),
    "GPL2_GRANT": GRANT.format("General Public License", 2),
    "GPL_HOPE": GPL2[GPL2.index("This program is dis") : GPL2.index("See the")],
    "GPL_MORE": GPL2[GPL2.index("See the") : GPL2.index("You should")],
    "GPL_COPY": GPL2[GPL2.index("You should") :],
    "AGPL3_REF": UNDER + "the GNU Affero General Public License, v. 3.0.",
    "LGPL_REF": UNDER + "the GNU Lesser General Public License, version 2.1.",
    "GPL3_REF": UNDER + "the GNU General Public License, v. 3.0, see COPYING.",
    "GPL2_REF": UNDER + "the GNU General Public License, version 2, see COPYING.",
    "MPL2_FORM": MPL2[: MPL2.index("If a")],
    "MPL2_COPY": MPL2[MPL2.index("If a") :],
    "CC0_REF": UNDER + "CC0 1.0 Universal.",
    "CC_BY_NC_SA_REF": UNDER + "a Creative Commons\nAttribution-NonCommercial-ShareAlike 4.0 International License.",
    "CC_BY_NC_ND_REF": UNDER + "CC BY-NC-ND 4.0.",
    "CC_BY_NC_REF": UNDER + "a Creative Commons Attribution-NonCommercial 4.0\nInternational License.",
    "CC_BY_SA_REF": UNDER + "a Creative Commons Attribution-ShareAlike\n4.0 International License.",
    "CC_BY_ND_REF": UNDER + "a Creative Commons Attribution-NoDerivatives 4.0 License.",
    "CC_BY_REF": UNDER + "a Creative Commons Attribution 4.0 International License.",
    "UNLICENSE": "This is free and unencumbered software released into the public\ndomain.",
    "PUBLIC_DOMAIN": "This file has been placed in the public domain. It is in the public domain.",
    "COPYRIGHT": "Copyright (c) 2020 Jane Doe\n",
    "ALL_RIGHTS": "All rights reserved.",
}


def test_each_rule_is_reached(spark):
    texts = ["\n".join(SAID[i].rstrip("\n") for i in ids.split()) for _, ids in RULES]
    got = scanned(spark, texts)
    assert [(ids, x) for (_, ids), x in zip(RULES, got)] == [(ids, ([n], [])) for n, ids in RULES]


def test_the_query_names_what_spdx_tags_say(spark, tmp_path):
    """A document whose only mark is an SPDX line, in the query and in its SQL."""
    import compare
    import duckdb
    from threadlens.llm.queries import ORACLES, QUERIES

    lines = ["MIT", "apache-2.0", "(GPL-2.0-only WITH Classpath-exception-2.0) OR BSD-3-Clause",
             "LGPL-2.1+ and CC-BY-NC-SA-4.0", "Own-Thing", "CC0-1.0 OR unlicense OR AGPL-3.0-or-later"]
    docs = [(i, f"some text\n// SPDX-License-Identifier: {x} */\nmore") for i, x in enumerate(lines)]
    docs += [(20, "\n".join(t for _, t in docs[:3])), (21, None), (22, "SPDX-License-Identifier:")]
    spark.createDataFrame(docs, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    found = QUERIES["op3_license_scan"](spark, str(tmp_path))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    assert compare.differences(found, con, ORACLES["op3_license_scan"]) == []
    got = {r.doc_id: r.tagged for r in found.collect()}
    assert [got[i] for i in range(6)] == [
        "MIT", "Apache-2.0", "BSD-3-Clause,GPL-2.0", "CC-BY-NC-SA,LGPL", "Own-Thing",
        "AGPL-3.0,CC0-1.0,Unlicense",
    ]
    assert got[20] == "Apache-2.0,BSD-3-Clause,GPL-2.0,MIT" and got[21] == got[22] == ""
