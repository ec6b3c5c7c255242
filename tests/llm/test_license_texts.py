"""Whole public licence texts, written out: each is found by all of its mandatory wording, and not once a part is changed or missing."""

import duckdb
import pytest

from tidemill.llm import licenses, queries

MIT = """MIT License. Copyright (c) 2021 Jane Doe. Permission is hereby granted, free of charge, to any person obtaining a copy of this
software and associated documentation files (the "Software"), to deal in the Software without restriction, including without limitation
the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice
shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND,
EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND
NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN
ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE
SOFTWARE."""
BSD2 = """Copyright (c) 2019, Jane Doe. All rights reserved. Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above
copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES,
INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO
EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL
DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS
INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR
OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE."""
BSD3 = BSD2.replace("distribution. THIS", """distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used
to endorse or promote products derived from this software without specific prior written permission. THIS""")
ISC_HEAD = "Copyright (c) Jane Doe. Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"
ISC_TAIL = """. THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES
OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY
DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION,
ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE."""
APACHE = """Copyright 2020 Jane Doe. Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance
with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or
agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY
KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published
by the Free Software Foundation, either version 3 of the License, or (at your option) any later version. This program is distributed in the
hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR
PURPOSE. See the GNU General Public License for more details. You should have received a copy."""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ZLIB = """This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages
arising from the use of this software. Permission is granted to anyone to use this software for any purpose, including commercial
applications, and to alter it and redistribute it freely, subject to the following restrictions: 1. The origin of this software must not be
misrepresented; you must not claim that you wrote the original software. If you use this software in a product, an acknowledgment in the
product documentation would be appreciated but is not required. 2. Altered source versions must be plainly marked as such, and must not be
misrepresented as being the original software. 3. This notice may not be removed or altered from any source distribution."""
UNLICENSE = """This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish, use, compile, sell,
or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, and by any
means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the
software to the public domain. We make this dedication for the benefit of the public at large and to the detriment of our heirs and
successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and future rights to this software
under copyright law. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS BE LIABLE FOR ANY CLAIM,
DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR
THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
BOOST = """Boost Software License. Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
accompanying documentation covered by this license (the "Software") to use, reproduce, display, distribute, execute, and transmit the
Software, and to prepare derivative works of the Software, and to permit third-parties to whom the Software is furnished to do so, all
subject to the following: The copyright notices in the Software and this entire statement, including the above license grant, this
restriction and the following disclaimer, must be included in all copies of the Software, in whole or in part, and all derivative works of
the Software, unless such copies or derivative works are solely in the form of machine-executable object code generated by a source language
processor. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF
MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE, TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL THE COPYRIGHT HOLDERS OR ANYONE DISTRIBUTING
THE SOFTWARE BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH
THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE."""
WHOLE = {
    "mit": MIT, "bsd-2-clause": BSD2, "bsd-3-clause": BSD3, "isc": ISC_HEAD + ", provided that the above copyright notice and this permission notice appear in all copies" + ISC_TAIL, "0bsd": ISC_HEAD + ISC_TAIL,
    "apache-2": APACHE, "gpl-3.0": GPL3, "gpl-2.0": GPL3.replace("version 3", "version 2").replace("software:", "software;"),
    "lgpl-3.0": GPL3.replace("GNU General", "GNU Lesser General").replace("program", "library"), "lgpl-2.1": GPL3.replace("GNU General", "GNU Lesser General").replace("version 3", "version 2.1"),
    "agpl-3.0": GPL3.replace("GNU General", "GNU Affero General"), "mpl-2.0": MPL, "zlib": ZLIB, "unlicense": UNLICENSE, "bsl-1.0": BOOST,
    "cc-by": "This work is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by-sa": "It is licensed under CC BY-SA 4.0.",
    "cc-by-nc-sa": "licensed under the Creative Commons Attribution-NonCommercial-ShareAlike 3.0 Unported License", "cc-by-nd": "licensed under a CC BY-ND 4.0 licence",
    "cc-by-nc-nd": "licensed under a Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License", "cc-by-nc": "licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
    "cc0": "To the extent possible under law, Jane Doe has waived all copyright and related or neighboring rights to this work.",
}


def labels(text):
    return licenses.scanner({}, licenses.TEMPLATES)([text.encode()])[5][0]


def test_every_template_has_a_text():
    assert set(WHOLE) == set(licenses.TEMPLATES)


@pytest.mark.parametrize("label", WHOLE)
def test_whole_texts(label):
    text = WHOLE[label]
    assert labels(text) == label and labels(f"so it was said. {text} and more of it") == label
    words = text.split()
    start = 4 if label == "gpl-2.0" else 0
    assert labels(" ".join(words[: len(words) // 2 + start])) == ("apache-2" if label == "apache-2" else "")  # its short notice stays


def test_changed_wording():
    assert labels(BSD2.replace("NO\nEVENT", "EVERY EVENT").replace("NO EVENT", "EVERY EVENT")) == ""
    assert labels(MIT.replace("NONINFRINGEMENT", "INFRINGEMENT")) == ""
    assert labels(GPL3.replace("version 3", "version 4")) == "" and labels(ZLIB.replace("must not claim", "may claim")) == ""
    assert labels(BSD3.replace("Neither the name", "The name")) == ""


def test_one_name_for_each_licence():
    found = licenses.scanner(licenses.PHRASES, licenses.TEMPLATES)
    base, all_of = found([b"Licensed under the Apache License, Version 2.0. licensed under CC BY-NC 4.0, under the MIT License"])[4:6]
    assert base == all_of == ["apache-2,cc-by-nc,mit"]


def test_the_query_is_its_sql(spark, tmp_path):
    """The SQL's patterns are made without the operator's parser; on whole texts, halves of them, and joined ones."""
    texts = [*WHOLE.values(), *(" ".join(t.split()[: len(t.split()) // 2]) for t in WHOLE.values()), " ".join(WHOLE.values()), None, "", "under the MIT license " * 3000, *(t.replace("the", "a", 1) for t in WHOLE.values())]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"file://{tmp_path}/documents.parquet")
    con = duckdb.connect()
    con.sql(f"create view documents as select * from '{tmp_path}/documents.parquet/*.parquet'")
    got = sorted(tuple(r) for r in queries.op1_license_scan(spark, f"file://{tmp_path}").collect())
    want = sorted(con.sql(queries.ORACLE_SQL["op1_license_scan"]).fetchall())
    assert [r[:-1] for r in got] == [r[:-1] for r in want]
    assert [r[-1] for r in got] == pytest.approx([r[-1] for r in want])
