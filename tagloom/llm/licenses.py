"""License scans: templates with optional and replaceable regions, matched as automata over words.

Method: template-markup matching. A template is wording with ``<<optional>> ... <<end>>`` around words
that may be left out (regions may nest) and ``<<words 0..8>>`` where other words may stand. It is compiled
into an automaton over words; a text is accepted at a place if its words from there spell all mandatory
wording in order, exactly. Every place of a text is tried that begins with a template's first word.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame

from tagloom.llm.common import add_columns, as_bytes

# Fixed phrases and labels that every scan reports.
BASE = (
    ("mit", "under the mit license"),
    ("apache-2", "apache license version 2"),
    ("cc-by-nc", "cc by nc"),
)
_AS_IS = "<<optional>> as is <<end>> <<optional>> “as is” <<end>>"
_BSD = (
    "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
    "<<words 0..1>> redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
    "<<words 0..1>> redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer "
    "in the documentation and or other materials provided with the distribution "
)
_BSD_DISCLAIMER = (
    f"this software is provided by <<words 1..12>> {_AS_IS} and any express or implied warranties including but not limited to the implied "
    "warranties of merchantability and fitness for a particular purpose are disclaimed in no event shall <<words 1..12>> be liable for any direct "
    "indirect incidental special exemplary or consequential damages including but not limited to procurement of substitute goods or services loss of "
    "use data or profits or business interruption however caused and on any theory of liability whether in contract strict liability or tort including "
    "negligence or otherwise arising in any way out of the use of this software even if advised of the possibility of such damage"
)
# Further wordings of well-known public licenses: full texts, notices, and, under labels of their own, openings alone.
TEMPLATES = (
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files <<optional>> the software <<end>> "
            "to deal in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of "
            "the software and to permit persons to whom the software is furnished to do so subject to the following conditions the above copyright notice and this permission "
            "notice <<optional>> including the next paragraph <<end>> shall be included in all copies or substantial portions of the software the software is provided "
            f"{_AS_IS} without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and "
            "noninfringement in no event shall <<words 1..12>> be liable for any claim damages or other liability whether in an action of contract tort or otherwise arising "
            "from out of or in connection with the software or the use or other dealings in the software"),
    ("bsd-2", _BSD + _BSD_DISCLAIMER),
    ("bsd-3", _BSD + "<<words 0..1>> neither the name of <<words 1..12>> nor the names of <<words 1..3>> may be used to endorse or promote products derived from this software "
              "without specific prior written permission " + _BSD_DISCLAIMER),
    ("isc", "permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted provided that the above "
            f"copyright notice and this permission notice appear in all copies the software is provided {_AS_IS} and <<words 1..12>> disclaims all warranties with regard to "
            "this software including all implied warranties of merchantability and fitness in no event shall <<words 1..12>> be liable for any special direct indirect or "
            "consequential damages or any damages whatsoever resulting from loss of use data or profits whether in an action of contract negligence or other tortious action "
            "arising out of or in connection with the use or performance of this software"),
    ("mit-opening", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files "
            "<<optional>> the software <<end>> to deal in the software without restriction"),
    ("apache-2", "licensed under the apache license <<words 0..3>> 2 <<optional>> 0 <<end>> <<optional>> the license <<end>> "
                 "you may not use this file except in compliance with the license"),
    ("gpl", "<<optional>> under the <<optional>> terms of the <<end>> <<end>> gnu general public license <<optional>> as published by the free software foundation <<end>>"),
    ("gpl-3", "gnu general public license <<optional>> as published by the free software foundation either <<end>> version 3"),
    ("gpl-2", "gnu general public license <<optional>> as published by the free software foundation either <<end>> version 2"),
    ("lgpl", "gnu <<words 1..1>> general public license"),
    ("bsd-opening", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc-opening", "permission to use copy modify and <<optional>> or <<end>> distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "subject to the terms of the mozilla public license v 2 <<optional>> 0 <<end>>"),
    ("cc-by-nc", "creative commons attribution <<optional>> non commercial <<end>> <<optional>> noncommercial <<end>> <<words 0..3>> license"),
    ("unlicense-opening", "this is free and unencumbered software released into the public domain"),
    ("all-rights-reserved", "copyright <<optional>> c <<end>> <<words 1..8>> all rights reserved"),
)

# Fixed: what is no part of a word (bytes of other characters all are), and ASCII letters lower-cased.
_FOLD = bytes(32 if b < 0x30 or 0x3A <= b <= 0x60 and not 0x41 <= b <= 0x5A or 0x7B <= b <= 0x7F else b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def text_words(text: bytes) -> list[bytes]:
    return text.translate(_FOLD).split()


@dataclass
class Automaton:
    """States are numbered; ``step[s]`` maps a word to the next states, ``any[s]`` lists those any word leads to."""

    label: str
    base: bool
    step: list[dict[bytes, set[int]]] = field(default_factory=list)
    any: list[set[int]] = field(default_factory=list)
    skip: list[set[int]] = field(default_factory=list)
    final: int = 0

    def state(self) -> int:
        self.step.append({})
        self.any.append(set())
        self.skip.append(set())
        return len(self.step) - 1

    def closure(self, states: set[int]) -> set[int]:
        todo, seen = list(states), set(states)
        while todo:
            for t in self.skip[todo.pop()] - seen:
                seen.add(t)
                todo.append(t)
        return seen

    def longest(self, words: list[bytes], at: int) -> tuple[int, int] | None:
        """(end, literally matched words) of the longest text from ``at`` that is accepted."""
        now = dict.fromkeys(self.closure({0}), 0)
        found = None
        for i in range(at, len(words)):
            after: dict[int, int] = {}
            for s, literal in now.items():
                for t in self.step[s].get(words[i], ()):
                    after[t] = max(after.get(t, 0), literal + 1)
                for t in self.any[s]:
                    after[t] = max(after.get(t, 0), literal)
            if not after:
                break
            now = {}
            for s, literal in after.items():
                for t in self.closure({s}):
                    now[t] = max(now.get(t, 0), literal)
            if self.final in now:
                found = i + 1, now[self.final]
        return found


def compile_template(label: str, markup: str, base: bool = False) -> Automaton:
    """``ValueError`` for regions left open or closed twice, and for templates that begin with replaceable words."""
    a = Automaton(label, base)
    at, open_at = a.state(), []
    for part in re.findall(r"<<[^>]*>>|[^<]+", markup):
        if part == "<<optional>>":
            open_at.append(at)
            at, before = a.state(), at
            a.skip[before].add(at)
        elif part == "<<end>>":
            if not open_at:
                raise ValueError(f"{label}: a region ends that was not opened")
            to = a.state()
            a.skip[at].add(to)
            a.skip[open_at.pop()].add(to)
            at = to
        elif m := re.fullmatch(r"<<words (\d+)\.\.(\d+)>>", part):
            if at == 0:
                raise ValueError(f"{label}: replaceable words cannot come first")
            low, high = map(int, m.groups())
            ends = [at] if low == 0 else []
            for k in range(1, high + 1):
                to = a.state()
                a.any[at].add(to)
                at = to
                if k >= low:
                    ends.append(at)
            at = a.state()
            for e in ends:
                a.skip[e].add(at)
        else:
            for w in text_words(part.encode()):
                to = a.state()
                a.step[at].setdefault(w, set()).add(to)
                at = to
    if open_at:
        raise ValueError(f"{label}: a region is left open")
    a.final = at
    return a


class Scanner:
    def __init__(self, base=BASE, templates=TEMPLATES) -> None:
        self.first: dict[bytes, list[Automaton]] = {}
        for a in [compile_template(*t, True) for t in base] + [compile_template(*t) for t in templates]:
            for word in {w for s in a.closure({0}) for w in a.step[s]}:
                self.first.setdefault(word, []).append(a)

    def scan(self, text: bytes) -> tuple[int, list[tuple[int, int, str, bool, float]]]:
        """(number of words, matches as (first word, end, label, base, share of literal words))."""
        words, first = text_words(text), self.first
        found = []
        for i in [i for i, w in enumerate(words) if w in first]:
            for a in first[words[i]]:
                if hit := a.longest(words, i):
                    found.append((i, hit[0], a.label, a.base, hit[1] / (hit[0] - i)))
        return len(words), found


def scan(df: DataFrame, base=BASE, templates=TEMPLATES, text_col: str = "text") -> DataFrame:
    """``df`` with ``n_words`` and ``matches``: array of (start, end, label, base, score), in words from 0,
    ends exclusive, by start; ``base`` marks the fixed phrases, whose every place is reported.

    Null and empty texts have no words and no matches. Whole texts are scanned, whatever their length;
    a template at several places gives several matches, several templates at one place one each. Columns
    of ``df`` named ``n_words`` or ``matches`` give way.
    """
    scanner = Scanner(base, templates)
    kind = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("label", pa.string()), ("base", pa.bool_()), ("score", pa.float64())]))

    def run(batch: pa.RecordBatch) -> dict[str, pa.Array]:
        made = [scanner.scan(t) for t in as_bytes(batch.column(1))]
        names = ("start", "end", "label", "base", "score")
        return {
            "n_words": pa.array([n for n, _ in made], pa.int64()),
            "matches": pa.array([[dict(zip(names, m)) for m in found] for _, found in made], kind),
        }

    return add_columns(df, run, [text_col], "n_words long, matches array<struct<start:bigint,end:bigint,label:string,base:boolean,score:double>>")
