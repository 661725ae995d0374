"""License scans with templates compiled to token automata.

A template is wording with markup: ``<<beginOptional>>...<<endOptional>>`` may be absent and
``<<var;max=N;match=REGEX>>`` stands for up to N words that match. It is compiled to an
automaton over words: states, the word or pattern that leads on from each, and jumps over
optional regions. A text is accepted where an automaton started at its first mandatory word
reaches its end, so all mandatory wording matches exactly and in order. Every start is tried,
over whole texts; a text without a template's rarest mandatory word cannot match and is not run.

Words: A-Z lower-cased, then runs of characters other than ASCII non-alphanumerics.

Defined results: null and empty texts have no words, no labels and score 0; texts of any length
are scanned whole, in time proportional to their length; of two matches of a template that
overlap the first stays, templates may overlap each other; repeated rows are scanned each; only
doc_id and text are read, so other columns cannot clash; an empty table gives an empty result.
Rows are never shuffled.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vectorloom.llm.common import text_of
from vectorloom.tables import bounded_rows, prepare

#: Templates a table may hold; they are compiled on the driver and sent with the tasks.
MOST_TEMPLATES = 20_000

#: Phrases whose places every scan counts, and their labels.
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Fixed wording: the head of the two- and three-clause texts.
_BSD = ("redistribution and use in source and binary forms with or without modification are "
        "permitted provided that the following conditions are met <<beginOptional>>1 "
        "<<endOptional>>redistributions of source code must retain the above copyright notice "
        "this list of conditions and the following disclaimer <<beginOptional>>2 "
        "<<endOptional>>redistributions in binary form must reproduce the above copyright notice "
        "this list of conditions and the following disclaimer in the documentation and or other "
        "materials provided with the distribution")
#: Fixed wording: the notice at the top of a file.
_FREE = ("<<var;max=4;match=[^\\s]+>> is free software you can redistribute it and or modify it "
         "under the terms of the gnu {} as published by the free software foundation either "
         "version <<var;max=2;match=[0-9]+>> of the license or at your option any later version")
#: Templates by label: notices and license texts with their optional and replaceable regions.
TEMPLATES = {
    "mit-notice": "<<beginOptional>>released <<endOptional>><<beginOptional>>licensed "
                  "<<endOptional>>under the <<beginOptional>>terms of the <<endOptional>>"
                  "mit license",
    "apache-2.0": "licensed under the apache license version 2<<beginOptional>> 0<<endOptional>>",
    "gpl-3.0": "licensed under the <<beginOptional>>terms of the <<endOptional>>"
               "<<beginOptional>>gnu <<endOptional>>general public license "
               "<<beginOptional>>as published by the free software foundation either "
               "<<endOptional>>version 3",
    "gpl-2.0": "licensed under the <<beginOptional>>terms of the <<endOptional>>"
               "<<beginOptional>>gnu <<endOptional>>general public license "
               "<<beginOptional>>as published by the free software foundation either "
               "<<endOptional>>version 2",
    "cc-by-nc-4.0": "licensed under <<beginOptional>>a <<endOptional>><<beginOptional>>"
                    "creative commons <<endOptional>>cc by nc 4 0",
    "mit-text": "permission is hereby granted free of charge to any person obtaining a copy of "
                "<<var;max=6;match=[^\\s]+>> and associated documentation files "
                "<<beginOptional>>the <<var;max=3;match=[^\\s]+>> <<endOptional>>to deal in "
                "<<var;max=4;match=[^\\s]+>> without restriction including without limitation "
                "the rights to use copy modify merge publish distribute sublicense and or sell "
                "copies of <<var;max=4;match=[^\\s]+>> and to permit persons to whom "
                "<<var;max=4;match=[^\\s]+>> is furnished to do so subject to the following "
                "conditions the above copyright notice and this permission notice "
                "<<beginOptional>>including the next paragraph <<endOptional>>shall be included "
                "in all copies or substantial portions of <<var;max=4;match=[^\\s]+>>",
    "isc-text": "permission to use copy modify and or distribute this software for any purpose "
                "with or without fee is hereby granted provided that the above copyright notice "
                "and this permission notice appear in all copies",
    "bsd-2-clause": _BSD,
    "bsd-3-clause": _BSD + " <<beginOptional>>3 <<endOptional>>neither the name of "
                    "<<var;max=12;match=[^\\s]+>> nor the names of "
                    "<<var;max=4;match=[^\\s]+>> contributors may be used to endorse or promote "
                    "products derived from this software without specific prior written "
                    "permission",
    "zlib-text": "this software is provided as is without any express or implied warranty in no "
                 "event will the authors be held liable for any damages arising from the use of "
                 "this software permission is granted to anyone to use this software for any "
                 "purpose including commercial applications and to alter it and redistribute it "
                 "freely subject to the following restrictions",
    "bsl-1.0": "permission is hereby granted free of charge to any person or organization "
               "obtaining a copy of the software and accompanying documentation covered by this "
               "license the software to use reproduce display distribute execute and transmit "
               "the software",
    "unlicense": "this is free and unencumbered software released into the public domain "
                 "<<beginOptional>>anyone is free to copy modify publish use compile sell or "
                 "distribute this software <<endOptional>>",
    "apache-2.0-header": "licensed under the apache license version 2 0 the license "
                         "<<beginOptional>>you may not use this file except in compliance with "
                         "the license <<endOptional>>you may obtain a copy of the license at "
                         "<<var;max=12;match=[^\\s]+>> unless required by applicable law or "
                         "agreed to in writing software distributed under the license is "
                         "distributed on an as is basis without warranties or conditions of any "
                         "kind either express or implied see the license for the specific "
                         "language governing permissions and limitations under the license",
    "mpl-2.0": "this source code form is subject to the terms of the mozilla public license v 2 0 "
               "<<beginOptional>>if a copy of the mpl was not distributed with this file you can "
               "obtain one at <<var;max=8;match=[^\\s]+>> <<endOptional>>",
    "lgpl": _FREE.format("lesser general public license"),
    "agpl": _FREE.format("affero general public license"),
    "gpl": _FREE.format("general public license"),
}
_MARKUP = re.compile(r"<<(.*?)>>")
#: Bytes of words stay, A-Z become lower case, all other ASCII becomes space.
_TABLE = bytes(
    (b | 0x20) if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 0x20
    for b in range(256))


def words_of(text: str) -> bytes:
    """The words of a text joined by single spaces, in UTF-8."""
    return b" ".join(text.encode().translate(_TABLE).split())


@dataclass
class Automaton:
    """State s goes to s + 1 on ``needs[s]`` (a word, or a compiled pattern); ``skips[s]`` are
    states reachable from s without a word. The last state accepts."""

    label: str
    needs: list = field(default_factory=list)
    skips: list[list[int]] = field(default_factory=list)
    rarest: bytes = b""
    first: frozenset = frozenset()

    def closure(self, states) -> set[int]:
        found, todo = set(), list(states)
        while todo:
            s = todo.pop()
            if s not in found:
                found.add(s)
                if s < len(self.skips):
                    todo += self.skips[s]
        return found

    def accepts(self, words: list[bytes], at: int) -> int:
        """Words of the longest match that starts at ``at``; 0 if none."""
        states, best, i = self.closure([0]), 0, at
        while states:
            if len(self.needs) in states:
                best = i - at
            if i == len(words):
                break
            word = words[i]
            states = self.closure(
                s + 1 for s in states if s < len(self.needs)
                and (self.needs[s] == word if isinstance(self.needs[s], bytes)
                     else self.needs[s].fullmatch(word)))
            i += 1
        return best


def compiled(label: str, template: str) -> Automaton:
    """The automaton of a template; its mandatory wording must not be empty."""
    made = Automaton(label)
    starts: list[int] = []
    mandatory: list[bytes] = []

    def add(need) -> None:
        made.needs.append(need)
        made.skips.append([])

    at = 0
    parts = []
    for m in _MARKUP.finditer(template):
        parts += [("text", template[at:m.start()]), ("markup", m[1])]
        at = m.end()
    for kind, part in [*parts, ("text", template[at:])]:
        if kind == "text":
            for word in words_of(part).split():
                add(word)
                if not starts:
                    mandatory.append(word)
        elif part == "beginOptional":
            starts.append(len(made.needs))
        elif part == "endOptional":
            begin = starts.pop()
            if begin < len(made.needs):
                made.skips[begin].append(len(made.needs))
        elif part.startswith("var;"):
            options = dict(x.split("=", 1) for x in part.split(";")[1:])
            pattern = re.compile(options.get("match", r"[^\s]+").encode())
            begin = len(made.needs)
            for _ in range(int(options.get("max", 1))):
                add(pattern)
            for s in range(begin, len(made.needs)):
                made.skips[s].append(len(made.needs))
        else:
            raise ValueError(f"unknown markup <<{part}>>")
    if starts or not mandatory:
        raise ValueError(f"{label}: an optional region is open, or nothing is mandatory")
    made.rarest = max(mandatory, key=len)
    starts = [made.needs[s] for s in made.closure([0]) if s < len(made.needs)]
    if all(isinstance(need, bytes) for need in starts):
        made.first = frozenset(starts)
    return made


def scan(text: str | None, automata: list[Automaton], phrases: dict[str, str] = PHRASES) -> dict:
    """n_words, n_base, first_word, last_word, base_labels, labels, score, and spans, a list of
    (label, first word, words)."""
    joined = words_of(text or "")
    n_words = joined.count(b" ") + 1 if joined else 0
    places: list[int] = []
    base: set[str] = set()
    padded = b" " + joined + b" "
    for phrase, label in phrases.items():
        key = b" " + phrase.encode() + b" "
        at, before, seen = padded.find(key), 0, 0
        while at >= 0:
            seen += padded.count(b" ", before, at)
            places.append(seen)
            base.add(label)
            at, before = padded.find(key, at + 1), at
    spans: list[tuple[str, int, int]] = []
    words: list[bytes] | None = None
    for a in automata:
        if b" " + a.rarest + b" " not in padded:
            continue
        words = joined.split() if words is None else words
        at = 0
        while at < len(words):
            length = a.accepts(words, at) if words[at] in a.first or not a.first else 0
            if length:
                spans.append((a.label, at, length))
            at += max(1, length)
    labels = sorted(base | {s[0] for s in spans})
    return {
        "n_words": n_words, "n_base": len(places),
        "first_word": min(places, default=None), "last_word": max(places, default=None),
        "base_labels": ",".join(sorted(base)), "labels": ",".join(labels),
        "score": 1.0 if spans else 0.5 if base else 0.0, "spans": spans}


RESULT = ("n_words BIGINT, n_base BIGINT, first_word BIGINT, last_word BIGINT, "
          "base_labels STRING, labels STRING, score DOUBLE, "
          "spans ARRAY<STRUCT<label: STRING, first: BIGINT, words: BIGINT>>")


def templates_of(table: DataFrame) -> dict[str, str]:
    """Templates from a table (label, template) of at most ``MOST_TEMPLATES`` rows; of equal
    labels the first by wording stays."""
    found = bounded_rows(table.select("label", "template").where(
        "label IS NOT NULL AND template IS NOT NULL").groupBy("label").agg(
        F.min("template").alias("template")), MOST_TEMPLATES, "license templates")
    return {r.label: r.template for r in sorted(found)}


def license_scan(docs: DataFrame, templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """doc_id and the columns of ``RESULT``. score: 1 for a full template, 0.5 for phrases.
    ``templates`` by label, or a table of them; by default those of this module."""
    prepare(docs.sparkSession)
    if isinstance(templates, DataFrame):
        templates = templates_of(templates)
    automata = [compiled(k, v) for k, v in (TEMPLATES if templates is None else templates).items()]
    kind = docs.schema["doc_id"].dataType.simpleString()
    spans = pa.list_(pa.struct([("label", pa.string()), ("first", pa.int64()),
                                ("words", pa.int64())]))
    types = {"n_words": pa.int64(), "n_base": pa.int64(), "first_word": pa.int64(),
             "last_word": pa.int64(), "base_labels": pa.string(), "labels": pa.string(),
             "score": pa.float64(), "spans": spans}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [scan(x.as_py(), automata) for x in batch.column("text")]
            for f in found:
                f["spans"] = [dict(zip(("label", "first", "words"), s, strict=True))
                              for s in f["spans"]]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"),
                 *[pa.array([f[c] for f in found], t) for c, t in types.items()]],
                names=["doc_id", *types])

    rows = docs.select(docs["doc_id"], text_of(docs).alias("text"))
    return rows.mapInArrow(run, f"doc_id {kind}, {RESULT}")
