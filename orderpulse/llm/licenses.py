"""License scans: templates with optional and replaceable regions as token automata over the words of whole texts.

A template is running text with three marks: `<<optional>> ... <<end>>` encloses words that may be missing (nested as
needed) and `<<any N>>` stands for up to N words of any kind. Texts and templates are cut into the same words, so
case, punctuation and line breaks don't matter; everything outside the marks is mandatory wording and must match word
for word. All templates are compiled into one automaton with states between words; a text is read once, a run of the
automaton begins at every word that begins a template, and lives no longer than the longest way through its template.
The work of a text is thus bounded by its words times the templates' lengths, whatever it holds.

`score` is k / (k + 4) for the k mandatory words of the longest template that was accepted, 0 where none was: a line of
four words is weaker proof than the whole wording of a license.

Defined cases: a null text is an empty one, with no words and no places; a template that is accepted again from the same
word counts once there; repeated rows are each returned; ids of any type, also null, are handed on; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of UTF-8 text whose A-Z are lower-cased: digits, a-z and everything beyond ASCII.
_WORDS = re.compile(rb"[0-9a-z\x80-\xff]+").findall
_MARKS = re.compile(r"<<(optional|end|any (\d+))>>")
#: Mandatory words at which the score is one half.
EVIDENCE = 4

#: The phrases whose places are counted, and their labels.
BASE = [
    ("under the mit license", "mit"),
    ("apache license version 2", "apache-2"),
    ("cc by nc", "cc-by-nc"),
]

_AS_IS = """THIS SOFTWARE IS PROVIDED BY <<any 16>> "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO,
THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED."""
_BSD = """Redistribution and use in source and binary forms, with or without modification, are permitted provided that the
following conditions are met: <<any 1>> Redistributions of source code must retain the above copyright notice, this list of
conditions and the following disclaimer. <<any 1>> Redistributions in binary form must reproduce the above copyright notice,
this list of conditions and the following disclaimer in the documentation and/or other materials provided with the
distribution."""

#: Wording of licenses and of the notices that name them, with their labels.
TEMPLATES = [
    ("""Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
    documentation files (the "Software"), to deal in the Software without restriction, including without limitation the
    rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit
    persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and
    this permission notice <<optional>>(including the next paragraph)<<end>> shall be included in all copies or substantial
    portions of the Software. THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND""", "mit"),
    ("licensed under the <<optional>>terms of the<<end>> MIT <<optional>>open source<<end>> license", "mit"),
    ("SPDX-License-Identifier: MIT", "mit"),
    (f"{_BSD} {_AS_IS}", "bsd-2-clause"),
    (f"""{_BSD} <<any 1>> Neither the name of <<any 16>> nor the names of <<any 8>> contributors may be used to endorse or promote
    products derived from this software without specific prior written permission. {_AS_IS}""", "bsd-3-clause"),
    ("""Permission to use, copy, modify, and<<optional>>/or<<end>> distribute this software for any purpose with or without fee is
    hereby granted, provided that the above copyright notice and this permission notice appear in all copies.""", "isc"),
    ("""This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable
    for any damages arising from the use of this software. Permission is granted to anyone to use this software for any purpose,
    including commercial applications, and to alter it and redistribute it freely""", "zlib"),
    ("""Licensed under the Apache License, Version 2.0 <<optional>>(the "License")<<end>>; you may not use this file except in
    compliance with the License.""", "apache-2"),
    ("SPDX-License-Identifier: Apache-2.0", "apache-2"),
    ("GNU General Public License<<optional>>, as published by the Free Software Foundation<<end>><<optional>>, either<<end>> version 3", "gpl-3"),
    ("GNU General Public License<<optional>>, as published by the Free Software Foundation<<end>><<optional>>, either<<end>> version 2", "gpl-2"),
    ("GNU GPL <<optional>>version<<end>> <<optional>>v<<end>> 3", "gpl-3"),
    ("GPL v3", "gpl-3"),
    ("GNU Lesser General Public License<<optional>>, as published by the Free Software Foundation<<end>><<optional>>, either<<end>> version <<any 1>>", "lgpl"),
    ("GNU Affero General Public License<<optional>>, as published by the Free Software Foundation<<end>><<optional>>, either<<end>> version 3", "agpl-3"),
    ("subject to the terms of the Mozilla Public License, v<<optional>>ersion<<end>>. 2.0", "mpl-2"),
    ("Boost Software License <<optional>>-<<end>> Version 1.0", "bsl-1"),
    ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("CC0 1.0 <<optional>>Universal<<end>>", "cc0"),
    ("Creative Commons Attribution 4.0 <<optional>>International<<end>> License", "cc-by"),
    ("CC BY 4.0", "cc-by"),
    ("Creative Commons Attribution-ShareAlike <<any 2>> <<optional>>International<<end>> License", "cc-by-sa"),
    ("CC BY SA <<any 2>>", "cc-by-sa"),
    ("Creative Commons Attribution-NonCommercial <<any 2>> <<optional>>International<<end>> License", "cc-by-nc"),
]


def words(text: bytes | None) -> list[bytes]:
    return _WORDS((text or b"").lower())


class Automaton:
    """States between the words of templates (text, label); `base` ones have their places counted.

    `after[state]` maps a word to the states that follow it, `free[state]` holds those that follow any word, and
    `done[state]` is the template that ends there. States are closed over what may be left out.
    """

    def __init__(self, base: Iterable[tuple[str, str]], templates: Iterable[tuple[str, str]]):
        self.base, self.labels, self.sizes = [], [], []
        self.after: list[dict[bytes, list[int]]] = []
        self.free: list[list[int]] = []
        self.skip: list[list[int]] = []
        self.done: dict[int, int] = {}
        starts = [self._compile(text, label, plain) for plain, group in ((True, base), (False, templates)) for text, label in group]
        closed = [self._closure(k) for k in range(len(self.after))]
        widen = lambda states: frozenset(x for k in states for x in closed[k])
        self.free = [widen(x) for x in self.free]
        self.after = [{w: widen(x) for w, x in edges.items()} for edges in self.after]
        self.first: dict[bytes, frozenset[int]] = {}
        for start in starts:
            if any(self.free[k] or k in self.done for k in closed[start]):
                raise ValueError("a template begins with mandatory wording")
            for k in closed[start]:
                for word, states in self.after[k].items():
                    self.first[word] = self.first.get(word, frozenset()) | states

    def _state(self) -> int:
        self.after.append({})
        self.free.append([])
        self.skip.append([])
        return len(self.after) - 1

    def _compile(self, text: str, label: str, plain: bool) -> int:
        start = at = self._state()
        opened, size, cursor = [], 0, 0
        for mark in [*_MARKS.finditer(text), None]:
            for word in words(text[cursor:mark.start() if mark else None].encode()):
                new = self._state()
                self.after[at].setdefault(word, []).append(new)
                at, size = new, size + (not opened)
            if mark is None:
                break
            cursor = mark.end()
            if mark[1] == "optional":
                opened.append(at)
            elif mark[1] == "end":
                self.skip[opened.pop()].append(at)
            else:
                begin = [at]
                for _ in range(int(mark[2])):
                    new = self._state()
                    self.free[at].append(new)
                    at = new
                    begin.append(at)
                for k in begin[:-1]:
                    self.skip[k].append(at)
        if opened:
            raise ValueError("an optional region does not end")
        self.done[at] = len(self.labels)
        self.base.append(plain)
        self.labels.append(label)
        self.sizes.append(size)
        return start

    def _closure(self, state: int) -> set[int]:
        found, todo = {state}, [state]
        while todo:
            for x in self.skip[todo.pop()]:
                if x not in found:
                    found.add(x)
                    todo.append(x)
        return found

    def places(self, text: list[bytes]) -> Iterator[tuple[int, int]]:
        """(template, first word) of every place where a template is accepted, in order of the places."""
        first, after, free, done = self.first, self.after, self.free, self.done
        for start, word in enumerate(text):
            if word not in first:
                continue
            states, found, at = first[word], set(), start
            while states:
                found.update(done[k] for k in states if k in done)
                at += 1
                if at == len(text):
                    break
                word = text[at]
                states = {x for k in states for x in (*after[k].get(word, ()), *free[k])}
            for template in sorted(found):
                yield template, start


def scan(docs: DataFrame, base: list[tuple[str, str]] = BASE, templates: list[tuple[str, str]] = TEMPLATES) -> DataFrame:
    """One row per row of `docs` (doc_id, text): counts, places and labels."""
    kind = docs.schema["doc_id"].dataType.simpleString()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        automaton = Automaton(base, templates)
        names = ["n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score"]
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.float64()]
        for batch in batches:
            rows: list[tuple] = []
            for value in batch.column("text"):
                text = words(value.as_py())
                found = list(automaton.places(text))
                own = [start for template, start in found if automaton.base[template]]
                labels = {automaton.labels[t] for t, _ in found}
                plain = {automaton.labels[t] for t, _ in found if automaton.base[t]}
                size = max((automaton.sizes[t] for t, _ in found), default=0)
                rows.append((len(text), len(own), min(own, default=None), max(own, default=None), ",".join(sorted(plain)), ",".join(sorted(labels)), size / (size + EVIDENCE)))
            columns = [pa.array([r[k] for r in rows], kinds[k]) for k in range(len(names))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *columns], ["doc_id", *names])

    schema = f"doc_id {kind}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double"
    return docs.select("doc_id", F.col("text").cast("binary").alias("text")).mapInArrow(work, schema)
