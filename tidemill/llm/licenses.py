"""License scans by template markup: optional and replaceable regions compiled into token automata.

Markup in a template's text: ``<<beginOptional>> words <<endOptional>>`` (may be nested) and
``<<var;max=N>>`` for up to N words of any kind. All other words are mandatory and must stand
exactly so, in this order, with nothing between them.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .arrow import map_texts

# Phrases with the labels of the base scan.
PHRASES = {
    "under the mit license": "mit",
    "apache license version 2": "apache-2",
    "cc by nc": "cc-by-nc",
}

# Public notices and licence texts in template markup, and parts that several share.
_WARRANTY = """THE SOFTWARE IS PROVIDED AS IS, WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE
WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE"""
_DEALINGS = "ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE"
_CLAIM = f"BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, {_DEALINGS}"
_BSD_CONDITIONS = """Redistribution and use in source and binary forms, with or without modification, are permitted provided
that the following conditions are met: <<var;max=2>> Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer. <<var;max=2>> Redistributions in binary form must reproduce the above
copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided
with the distribution. """
_BSD_DISCLAIMER = """THIS SOFTWARE IS PROVIDED BY <<var;max=12>> AS IS AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT
LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL
<<var;max=12>> BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT
NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER
CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE)
ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE"""
_ISC_GRANT = "Permission to use, copy, modify, and<<beginOptional>>/or<<endOptional>> distribute this software for any purpose with or without fee is hereby granted"
_ISC_DISCLAIMER = """THE SOFTWARE IS PROVIDED AS IS AND <<var;max=12>> DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING
ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY SPECIAL, DIRECT,
INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION
OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE"""


def _gnu(kind: str, version: str) -> str:
    """The notice that the GNU licences ask for at the head of a file."""
    return f"""is free software<<beginOptional>>,<<endOptional>> you can redistribute it and/or modify it under the terms of the GNU {kind} License as
    published by the Free Software Foundation, either version {version} of the License, <<beginOptional>>or (at your option) any later version.
    <<endOptional>><<var;max=6>> is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of
    MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {kind} License for more details"""


def _commons(name: str, short: str) -> list[str]:
    """The notices of a Creative Commons licence."""
    return [
        f"licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>CC {short} 4.0",
        f"licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>Creative Commons {name} 4.0 International License",
        f"licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>the <<endOptional>>Creative Commons {name} 3.0 Unported License",
    ]


TEMPLATES = {
    "mit": [
        "<<beginOptional>>this <<var;max=3>> is <<endOptional>>released under the MIT License",
        "<<beginOptional>>this <<var;max=3>> is <<endOptional>>licensed under the <<beginOptional>>terms of the <<endOptional>>MIT License",
        f"""Permission is hereby granted, free of charge, to any person obtaining a copy of <<var;max=6>> and associated
        documentation files (the <<var;max=3>>), to deal in the Software without restriction, including without
        limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the
        Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:
        The above copyright notice and this permission notice <<beginOptional>>(including the next paragraph)
        <<endOptional>>shall be included in all copies or substantial portions of the Software. {_WARRANTY} AND NONINFRINGEMENT. IN
        NO EVENT SHALL <<var;max=12>> {_CLAIM}""",
    ],
    "apache-2": [
        "licensed under the Apache License, Version 2.0",
        """licensed under the Apache License, Version 2.0 (the <<var;max=3>>); you may not use this <<var;max=4>> except in
        compliance with the License. You may obtain a copy of the License at <<var;max=12>> Unless required by
        applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS,
        WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language
        governing permissions and limitations under the License""",
    ],
    "gpl-2.0": [_gnu("General Public", "2")],
    "gpl-3.0": [
        """this <<var;max=4>> is licensed under the <<beginOptional>>terms of the <<endOptional>>GNU General Public License,
        <<beginOptional>>GPL <<endOptional>>version 3""",
        _gnu("General Public", "3"),
    ],
    "lgpl-2.1": [_gnu("Lesser General Public", "2.1")],
    "lgpl-3.0": [_gnu("Lesser General Public", "3")],
    "agpl-3.0": [_gnu("Affero General Public", "3")],
    "mpl-2.0": [
        """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not
        distributed with this file, You can obtain one at""",
    ],
    "cc-by": _commons("Attribution", "BY"),
    "cc-by-sa": _commons("Attribution-ShareAlike", "BY-SA"),
    "cc-by-nd": _commons("Attribution-NoDerivatives", "BY-ND"),
    "cc-by-nc": _commons("Attribution-NonCommercial", "BY-NC"),
    "cc-by-nc-sa": _commons("Attribution-NonCommercial-ShareAlike", "BY-NC-SA"),
    "cc-by-nc-nd": _commons("Attribution-NonCommercial-NoDerivatives", "BY-NC-ND"),
    "cc0": ["To the extent possible under law, <<var;max=12>> has waived all copyright and related or neighboring rights to"],
    "bsd-2-clause": [_BSD_CONDITIONS + _BSD_DISCLAIMER],
    "bsd-3-clause": [
        _BSD_CONDITIONS + """ <<var;max=2>> Neither the name of <<var;max=12>> nor the names of its contributors may be used to
        endorse or promote products derived from this software without specific prior written permission. """ + _BSD_DISCLAIMER,
    ],
    "0bsd": [f"{_ISC_GRANT}. {_ISC_DISCLAIMER}"],
    "isc": [f"{_ISC_GRANT}, provided that the above copyright notice and this permission notice appear in all copies. {_ISC_DISCLAIMER}"],
    "zlib": [
        """This software is provided as-is, without any express or implied warranty. In no event will <<var;max=6>> be held
        liable for any damages arising from the use of this software. Permission is granted to anyone to use this software for
        any purpose, including commercial applications, and to alter it and redistribute it freely, subject to the following
        restrictions: <<var;max=2>> The origin of this software must not be misrepresented; you must not claim that you wrote
        the original software. If you use this software in a product, an acknowledgment in the product documentation would be
        appreciated but is not required. <<var;max=2>> Altered source versions must be plainly marked as such, and must not be
        misrepresented as being the original software. <<var;max=2>> This notice may not be removed or altered from any source
        distribution""",
    ],
    "bsl-1.0": [
        f"""Permission is hereby granted, free of charge, to any person or organization obtaining a copy of the software and
        accompanying documentation covered by this license (the <<var;max=3>>) to use, reproduce, display, distribute, execute,
        and transmit the Software, and to prepare derivative works of the Software, and to permit third-parties to whom the
        Software is furnished to do so, all subject to the following: The copyright notices in the Software and this entire
        statement, including the above license grant, this restriction and the following disclaimer, must be included in all
        copies of the Software, in whole or in part, and all derivative works of the Software, unless such copies or derivative
        works are solely in the form of machine-executable object code generated by a source language processor. {_WARRANTY},
        TITLE AND NON-INFRINGEMENT. IN NO EVENT SHALL <<var;max=12>> BE LIABLE FOR ANY DAMAGES OR OTHER LIABILITY, WHETHER IN
        CONTRACT, TORT OR OTHERWISE, {_DEALINGS}""",
    ],
    "unlicense": [
        f"""This is free and unencumbered software released into the public domain. Anyone is free to copy, modify, publish,
        use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose,
        commercial or non-commercial, and by any means. In jurisdictions that recognize copyright laws, the author or authors of
        this software dedicate any and all copyright interest in the software to the public domain. We make this dedication for
        the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an
        overt act of relinquishment in perpetuity of all present and future rights to this software under copyright law.
        {_WARRANTY} AND NONINFRINGEMENT. IN NO EVENT SHALL <<var;max=6>> {_CLAIM}""",
    ],
}

_MARK = re.compile(r"<<(beginOptional|endOptional|var;max=(\d+))>>")
_WORD = re.compile("[^\x00-\x2f\x3a-\x60\x7b-\x7f]+")
_TABLE = bytes(c if c >= 0x80 or 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A else c + 32 if 0x41 <= c <= 0x5A else 0x20 for c in range(256))


def words_of(text: bytes | None) -> list[bytes]:
    """Lower-cased words of UTF-8 bytes: runs of digits, letters a to z and characters beyond ASCII."""
    return text.translate(_TABLE).split() if text else []


def parse(template: str) -> list:
    """A template as a list of words (str), replaceable regions (int, the most words) and optional regions (list)."""
    stack: list[list] = [[]]
    at = 0

    def literal(text: str) -> None:
        stack[-1].extend(_WORD.findall(text.lower()))

    for m in _MARK.finditer(template):
        literal(template[at : m.start()])
        at = m.end()
        if m[1] == "beginOptional":
            stack.append([])
        elif m[1] == "endOptional":
            if len(stack) == 1:
                raise ValueError("endOptional without beginOptional")
            region = stack.pop()
            stack[-1].append(region)
        else:
            stack[-1].append(int(m[2]))
    literal(template[at:])
    if len(stack) != 1:
        raise ValueError("beginOptional without endOptional")
    return stack[0]


@dataclass
class Automaton:
    """States are bits of an integer, one for each place between two tokens of the template."""

    label: str
    masks: dict[bytes, int] = field(default_factory=dict)
    anything: int = 0
    skips: list[tuple[int, int]] = field(default_factory=list)
    size: int = 0
    mandatory: list[bytes] = field(default_factory=list)

    @classmethod
    def compile(cls, label: str, template: str) -> Automaton:
        own = cls(label)

        def place(items: list, must: bool) -> None:
            for item in items:
                if isinstance(item, str):
                    word = item.encode()
                    own.masks[word] = own.masks.get(word, 0) | 1 << own.size
                    own.size += 1
                    if must:
                        own.mandatory.append(word)
                elif isinstance(item, int):
                    end = own.size + item
                    for _ in range(item):
                        own.anything |= 1 << own.size
                        own.skips.append((1 << own.size, 1 << end))
                        own.size += 1
                else:
                    begin, n = own.size, len(own.skips)
                    place(item, False)
                    own.skips.insert(n, (1 << begin, 1 << own.size))

        place(parse(template), True)
        if not own.mandatory:
            raise ValueError(f"a template of {label} has no mandatory word")
        own.skips.sort()
        own.start = own.closed(1)
        own.firsts = [w for w, m in own.masks.items() if m & own.start]
        return own

    def closed(self, states: int) -> int:
        for a, b in self.skips:
            if states & a:
                states |= b
        return states

    def accepts(self, words: list[bytes], at: int) -> bool:
        """Whether the template's wording starts at a word."""
        states, last, n = self.start, 1 << self.size, len(words)
        while not states & last:
            if at >= n:
                return False
            states = self.closed((states & (self.masks.get(words[at], 0) | self.anything)) << 1)
            if not states:
                return False
            at += 1
        return True

    def found(self, words: list[bytes]) -> bool:
        if self.start & self.anything:
            return any(self.accepts(words, i) for i in range(len(words)))
        for first in self.firsts:
            at = -1
            while True:
                try:
                    at = words.index(first, at + 1)
                except ValueError:
                    break
                if self.accepts(words, at):
                    return True
        return False


def places(words: list[bytes], phrase: list[bytes]) -> list[int]:
    """All places where a phrase's words stand consecutively."""
    out, at = [], -1
    while True:
        try:
            at = words.index(phrase[0], at + 1)
        except ValueError:
            return out
        if words[at : at + len(phrase)] == phrase:
            out.append(at)


def confidence(mandatory_words: int) -> float:
    return mandatory_words / (mandatory_words + 4)


def shared_words(wordings: list[list[bytes]]) -> list[bytes]:
    """A few long words of which each wording has one: again and again the one that most of the rest share."""
    rest, out = [set(w) for w in wordings], []
    while rest:
        n = Counter(w for own in rest for w in own)
        best = max(n, key=lambda w: (min(len(w), 8), n[w], len(w), w))
        out.append(best)
        rest = [own for own in rest if best not in own]
    return out


FIELDS = T.StructType([
    T.StructField("n_words", T.LongType()), T.StructField("n_base", T.LongType()),
    T.StructField("first_word", T.LongType()), T.StructField("last_word", T.LongType()),
    T.StructField("base_labels", T.StringType()), T.StructField("labels", T.StringType()), T.StructField("score", T.DoubleType()),
])


def scanner(phrases: dict[str, str], templates: dict[str, list[str]]) -> Callable[[list[bytes | None]], list[list]]:
    automata = [Automaton.compile(label, t) for label, ts in templates.items() for t in ts]
    listed = [(p.encode().split(), label) for p, label in phrases.items()]
    needed = shared_words([a.mandatory for a in automata] + [p for p, _ in listed])  # a document without any of these has no wording at all

    def scan(texts: list[bytes | None]) -> list[list]:
        rows = []
        for text in texts:
            low = text.translate(_TABLE) if text else b""
            words = low.split()
            starts: list[int] = []
            base, labels, best = set(), set(), 0
            if any(x in low for x in needed):
                present = set(words)
                for phrase, label in listed:
                    if found := places(words, phrase):
                        starts += found
                        base.add(label)
                        best = max(best, len(phrase))
                for a in automata:
                    if present.issuperset(a.mandatory) and a.found(words):
                        labels.add(a.label)
                        best = max(best, len(a.mandatory))
            rows.append((len(words), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(base)), ",".join(sorted(base | labels)), confidence(best) if best else 0.0))
        return [list(c) for c in zip(*rows, strict=True)]

    return scan


def scan_licenses(docs: DataFrame, keep: list[str], text_col: str = "text", phrases: dict[str, str] = PHRASES, templates: dict[str, list[str]] = TEMPLATES) -> DataFrame:
    """``keep`` columns of every row with what was found in its whole text.

    ``n_base``, ``first_word`` and ``last_word`` are of the phrases, ``labels`` of phrases and
    templates; ``score`` is m / (m + 4) for the accepted wording with the most mandatory words m.
    A null or empty text has no words: no labels, empty strings, null places, score 0. Repeated
    rows give repeated rows, an empty table none. A word sequence that several templates accept
    gives all their labels.
    """
    return map_texts(docs, text_col, keep, FIELDS, lambda: scanner(phrases, templates), kind="bytes")


def as_regex(template: str) -> str:
    """A template as a regular expression over words that each end with a space."""

    def of(items: list) -> str:
        return "".join(f"{x} " if isinstance(x, str) else f"(?:[^ ]+ ){{0,{x}}}" if isinstance(x, int) else f"(?:{of(x)})?" for x in items)

    return of(parse(template))
