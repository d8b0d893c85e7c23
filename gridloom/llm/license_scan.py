"""Licence detection: templates with markup, compiled into automata over words.

A template is a licence's wording with two kinds of regions: ``[[ ... ]]``
encloses words that may be missing, ``{n}`` stands for up to n words of any
kind. It becomes a nondeterministic automaton over words; a text carries the
licence where all mandatory words stand exactly as in the template. Notices,
titles and identifiers, which name a licence without its wording, have labels of
their own. Templates in the common markup of ``<<beginOptional>>`` and
``<<var;...>>`` are read by from_markup()."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import DataFrame

from .common import map_text

#: Bytes to words: A-Z become a-z; digits, a-z and all of 0x80 up stay; the rest separates words.
_TABLE = bytes(c + 32 if 0x41 <= c <= 0x5A else c if 0x30 <= c <= 0x39 or 0x61 <= c <= 0x7A or c >= 0x80 else 0x20 for c in range(256))

#: The phrases of the contract: label and wording.
BASE = {"mit": "under the mit license", "apache-2": "apache license version 2", "cc-by-nc": "cc by nc"}

_AS_IS = "this software is provided by {12} as is and any express or implied warranties including but not limited to the implied warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall {12} be liable for any direct indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
_BSD = "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met [[1]] redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer [[2]] redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials provided with the distribution"

#: Whole licences: label and wording (fixed values, the licences' own texts).
LICENSES = {
    "mit": "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission notice [[including the next paragraph]] shall be included in all copies or substantial portions of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement in no event shall {12} be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
    "bsd-2": f"{_BSD} {_AS_IS}",
    "bsd-3": f"{_BSD} [[3]] neither the name of {{16}} nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission {_AS_IS}",
    "isc": "permission to use copy modify and [[or]] distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies the software is provided as is and {12} disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness in no event shall {12} be liable for any special direct indirect or consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action arising out of or in connection with the use or performance of this software",
    "zlib": "this software is provided as is without any express or implied warranty in no event will {12} be held liable for any damages arising from the use of this software permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions [[1]] the origin of this software must not be misrepresented you must not claim that you wrote the original software if you use this software in a product an acknowledgment in the product documentation would be appreciated but is not required [[2]] altered source versions must be plainly marked as such and must not be misrepresented as being the original software [[3]] this notice may not be removed or altered from any source distribution",
}


def _gnu(name: str, version: str) -> str:
    """The notice that a program under this licence carries."""
    rest = f"this {{3}} is distributed in the hope that it will be useful but without any warranty without even the implied warranty of merchantability or fitness for a particular purpose see the {name} for more details"
    return f"free software you can redistribute it and or modify it under the terms of the {name} as published by the free software foundation [[either]] version {version} of the license [[or at your option any later version]] {rest}"


def _title(name: str, version: str) -> str:
    return f"{name} version {version} [[copyright {{24}}]] everyone is permitted to copy and distribute verbatim copies of this license document but changing it is not allowed"


_GPL, _LGPL, _AGPL = "gnu general public license", "gnu lesser general public license", "gnu affero general public license"
#: Notices, titles and identifiers (fixed values); their labels say that they aren't the licence itself.
NOTICES = {
    "apache-2-notice": ["licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at {8} unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license"],
    "apache-2-title": ["apache license version 2 0 january 2004 {6} terms and conditions for use reproduction and distribution"],
    "gpl-2-notice": [_gnu(_GPL, "2")], "gpl-3-notice": [_gnu(_GPL, "3")], "lgpl-2.1-notice": [_gnu(_LGPL, "2 1")], "lgpl-3-notice": [_gnu(_LGPL, "3")], "agpl-3-notice": [_gnu(_AGPL, "3")],
    "gpl-2-title": [_title(_GPL, "2 june 1991")], "gpl-3-title": [_title(_GPL, "3 29 june 2007")], "lgpl-2.1-title": [_title(_LGPL, "2 1 february 1999")], "lgpl-3-title": [_title(_LGPL, "3 29 june 2007")], "agpl-3-title": [_title(_AGPL, "3 19 november 2007")],
    "mpl-2-notice": ["source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this [[source]] file you can obtain one at {8}"],
    "mpl-2-title": ["mozilla public license version 2 0 1 definitions"],
    "bsd-notice": ["under the [[{2}]] bsd [[{2}]] license"], "gpl-notice": [f"under the [[terms of the]] {_GPL}"], "lgpl-notice": [f"under the [[terms of the]] {_LGPL}"], "agpl-notice": [f"under the [[terms of the]] {_AGPL}"],
    "cc-by-nc-notice": ["creative commons attribution noncommercial [[{3}]] license", "creative commons attribution non commercial [[{3}]] license"], "cc-by-sa-notice": ["cc by sa", "creative commons attribution share alike [[{3}]] license", "creative commons attribution sharealike [[{3}]] license"],
    "cc-by-notice": ["cc by 4 0", "cc by 3 0", "creative commons attribution [[3 0]] [[4 0]] [[unported]] [[international]] license"], "cc0-notice": ["cc0 1 0", "creative commons zero"],
} | {f"{k}-identifier": [f"spdx license identifier {v}"] for k, v in (("mit", "mit"), ("apache-2", "apache 2 0"), ("bsd-2", "bsd 2 clause"), ("bsd-3", "bsd 3 clause"), ("isc", "isc"), ("gpl-2", "gpl 2 0"), ("gpl-3", "gpl 3 0"), ("lgpl-2.1", "lgpl 2 1"), ("lgpl-3", "lgpl 3 0"), ("agpl-3", "agpl 3 0"), ("mpl-2", "mpl 2 0"))}
TEMPLATES = {k: [v] for k, v in LICENSES.items()} | NOTICES

_MARKUP = re.compile(r"<<(beginOptional|endOptional|var)\b((?:[^<>\"]|\"[^\"]*\"|<(?!<)|>(?!>))*)>>")


def from_markup(template: str, most: int = 60) -> str:
    """A wording from a template with <<beginOptional>>, <<endOptional>> and <<var;...>>; a variable stands for up to so many words. What is optional before the first mandatory word is left out."""
    plain = _MARKUP.sub(lambda m: {"beginOptional": " [[ ", "endOptional": " ]] ", "var": f" {{{most}}} "}[m[1]], re.sub(r"[\[\]{}]", " ", template))
    depth, at = 0, 0
    for m in re.finditer(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", plain):
        depth += (m[0] == "[[") - (m[0] == "]]")
        if not depth and m[0] not in ("[[", "]]") and m[0][0] != "{" and tokens_of(m[0].encode()):
            at = m.start()
            break
    return plain[at:]


@dataclass(frozen=True)
class Automaton:
    """states[i]: the word that leads from i to i + 1 (None: any word), and the states reached from i for nothing."""

    label: str
    base: bool
    words: tuple[str | None, ...]
    skips: tuple[tuple[int, ...], ...]

    def ends(self, tokens: list[bytes], start: int) -> int:
        """The largest end of a match that starts at this token, or -1."""
        now, at, best = self._closed({0}), start, -1
        while now:
            if len(self.words) in now:
                best = at
            if at == len(tokens):
                break
            now = self._closed({i + 1 for i in now if i < len(self.words) and (self.words[i] is None or self.words[i] == tokens[at])})
            at += 1
        return best

    def _closed(self, states: set[int]) -> set[int]:
        todo, out = list(states), set(states)
        while todo:
            for j in self.skips[todo.pop()]:
                if j not in out:
                    out.add(j)
                    todo.append(j)
        return out


def compile_template(label: str, wording: str, base: bool = False) -> Automaton:
    """The automaton of a wording with markup. Its first word must be mandatory."""
    words: list[bytes | None] = []
    skips: dict[int, list[int]] = {}
    opened: list[int] = []
    for part in re.findall(r"\[\[|\]\]|\{\d+\}|[^\s\[\]{}]+", wording):
        if part == "[[":
            opened.append(len(words))
        elif part == "]]":
            skips.setdefault(opened.pop(), []).append(len(words))
        elif part[0] == "{":
            first, n = len(words), int(part[1:-1])
            words += [None] * n
            for i in range(n):
                skips.setdefault(first + i, []).append(first + n)
        else:
            words += tokens_of(part.encode())
    if opened or not words or words[0] is None or 0 in skips:
        raise ValueError(f"a template must begin with a mandatory word and close its markup: {wording!r}")
    return Automaton(label, base, tuple(words), tuple(tuple(skips.get(i, ())) for i in range(len(words) + 1)))


def tokens_of(text: bytes) -> list[bytes]:
    return text.translate(_TABLE).split()


def scan_licenses(docs: DataFrame, templates: dict[str, list[str]] | None = None) -> DataFrame:
    """Licences named or quoted in each whole text.

    Returns doc_id, n_words, n_base (places of the phrases in BASE), first_word
    and last_word (smallest and largest first word of such a place), base_labels
    and labels (distinct, sorted, comma-joined; labels has those of the templates
    too), and score: the share of the text's words inside licence wording.

    A null text is empty: no words, no labels, score 0. Repeated rows give
    repeated rows; an empty table gives none; other columns are ignored. All of
    a text is read, however long it is."""
    more = TEMPLATES if templates is None else templates
    automata = [compile_template(k, v, True) for k, v in BASE.items()] + [compile_template(k, v) for k, vs in more.items() for v in vs]
    # A template can match only where its longest mandatory word stands.
    keyed = [(max((w for i, w in enumerate(a.words) if w and not _optional(a, i)), key=len), a) for a in automata]

    def scan(text: bytes):
        plain = text.translate(_TABLE)
        words = plain.split()
        labels, base_labels, starts, n_base, spans = set(), set(), [], 0, []
        by_first: dict[bytes, list[Automaton]] = {}
        for key, a in keyed:
            if key in plain:
                by_first.setdefault(a.words[0], []).append(a)
        if by_first:
            for at, word in enumerate(words):
                for a in by_first.get(word, ()):
                    end = a.ends(words, at)
                    if end < 0:
                        continue
                    labels.add(a.label)
                    spans.append((at, end))
                    if a.base:
                        n_base += 1
                        starts.append(at)
                        base_labels.add(a.label)
        covered, last = 0, 0
        for a, b in sorted(spans):
            covered, last = covered + max(0, b - max(a, last)), max(b, last)
        return len(words), n_base, min(starts, default=None), max(starts, default=None), ",".join(sorted(base_labels)), ",".join(sorted(labels)), covered / len(words) if words else 0.0

    return map_text(docs, scan, "n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double")


def _optional(a: Automaton, i: int) -> bool:
    """Whether some way through the automaton leaves out word i."""
    return any(s <= i < e for s, ends in enumerate(a.skips) for e in ends)
