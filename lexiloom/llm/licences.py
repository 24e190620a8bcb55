"""License scans by conditional compression.

Candidate blocks are the paragraphs of a text (its lines up to a blank one,
joined without their comment marks), long ones in windows, that hold a licensing
word. The surroundings of a block's licensing words are compressed as they are
and with each template as a raw dictionary of zstandard. Templates are ranked by
the bytes they save; those that save at least SHARE of what they save on their
own wording are the winners, and only these are compared word by word. A winner
is confirmed if none of its words is missing and the words between them are
those of its free fields (years, names, versions) or FILLERS, and if no negation
stands before it. In a tag line, the identifiers of an expression are each
confirmed. The saving of a confirmed template is the share of the matched
passage's compressed size; a block that confirms nothing has the best ranked
template, what it saves of the surroundings, and its difference in wording.

Defined results: a null or empty text has no blocks and no rows; a block has a
row for each licence that it confirms, with the best ranked of the licence's
confirmed templates; a block that no template confirms has a null licence and the best
template's figures; a passage in the overlap of two windows counts once;
repeated rows give repeated results; further columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from collections import OrderedDict, defaultdict
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexiloom.llm.common import map_batches

#: Short notices and characteristic phrases of public licences, with the name each stands for. `*` stands for up to FREE words.
TEMPLATES: tuple[tuple[str, str], ...] = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "This project is licensed under the terms of the MIT license."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Released under the Apache License 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "Licensed under the GNU General Public License v3.0."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", "Licensed under the GNU General Public License v2.0."),
    ("GPL-3.0", "Licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "Licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("GPL", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-2.1", "This work is licensed under the GNU Lesser General Public License, version 2.1."),
    ("AGPL-3.0", "This work is licensed under the GNU Affero General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Licensed under the Mozilla Public License, version 2.0."),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("ISC", "Licensed under the ISC License."),
    ("CC0-1.0", "To the extent possible under law, * has waived all copyright and related or neighboring rights to this work."),
    ("CC0-1.0", "Released under CC0 1.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-NC-ND-4.0", "Licensed under CC BY-NC-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC-BY-SA-4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Public-Domain", "This work is in the public domain."),
    ("All-Rights-Reserved", "All rights reserved."),
)
#: Further identifiers that a tag line may give.
TAG_NAMES = ("0BSD", "AFL-3.0", "Artistic-2.0", "BSL-1.0", "CDDL-1.0", "CDDL-1.1", "CPL-1.0", "ECL-2.0", "EPL-1.0", "EPL-2.0", "EUPL-1.1", "EUPL-1.2", "LGPL-2.0", "MIT-0", "MPL-1.1", "MS-PL", "MS-RL", "NCSA", "OFL-1.1", "OSL-3.0", "PostgreSQL", "PSF-2.0", "Python-2.0", "Ruby", "UPL-1.0", "W3C", "WTFPL", "X11", "Zlib", "ZPL-2.1")
#: Names above that are no SPDX identifiers, and suffixes that identifiers of the GNU licences may have; every other name is also sought in a tag line.
UNTAGGED, GNU_SUFFIXES = {"GPL", "BSD", "Public-Domain", "All-Rights-Reserved"}, ("", "-only", "-or-later")
TAGS = tuple((name, f"SPDX-License-Identifier: {name}{suffix}") for name in dict.fromkeys([*(n for n, _ in TEMPLATES if n not in UNTAGGED), *TAG_NAMES]) for suffix in (GNU_SUFFIXES if "GPL" in name else ("",)))
#: A block is a candidate if it holds one of these.
SIGNS = ("licen", "copyright", "rights reserved", "public domain", "hereby granted", "free software", "redistribut", "mozilla public", "waived all", "cc0", "cc by")
#: Spellings taken as one, words that may stand between a template's own, words that join identifiers, and negations.
SAME = {"licence": "license", "licences": "licenses", "licenced": "licensed", "distributed": "released", "published": "released"}
FILLERS = {"the", "terms", "and", "conditions", "of"}
TAG, JOINS = "spdx-license-identifier", {"or", "and", "with"}
NEGATIONS = {"not", "never", "nor", "t"}  # t: of isn't
#: Words that a free field of a template may hold, characters on either side of a licensing word that are compressed (more than any template has), and words before a passage in which a negation counts.
FREE, AROUND, BEFORE = 8, 200, 2
#: Most fillers in a row, and the least share of a template's own saving with which it is compared by wording.
SKIPS, SHARE = 4, 0.1
LEVEL = 3
#: Most characters of a block; longer paragraphs are scanned in overlapping windows.
WINDOW, OVERLAP = 2000, 400
CACHE = 50_000

#: Marks of a comment or a quotation at either end of a line.
MARKS = re.compile(r"^\s*(?:(?:[#/*;!%>|]+|--+|<!--+|\.\.|dnl\b|rem\b|\(\*+)(?:\s+|$))+|\s*(?:\*+[/)]|--+>)\s*$", re.IGNORECASE)

_WORD = re.compile(r"[\w.+-]*\w|\*")


def words(text: str) -> list[str]:
    return [SAME.get(w, w) for w in _WORD.findall(text.lower())]


def paragraphs(text: str) -> Iterator[tuple[str, list[int], list[int]]]:
    """(content, offsets, line numbers): the lines up to a blank one, joined without their comment marks, and where each starts."""
    parts, offsets, numbers, at = [], [], [], 0
    for number, line in enumerate([*text.split("\n"), ""]):
        if bare := MARKS.sub("", line).strip():
            parts.append(bare)
            offsets.append(at)
            numbers.append(number)
            at += len(bare) + 1
        elif parts:
            yield " ".join(parts), offsets, numbers
            parts, offsets, numbers, at = [], [], [], 0


def windows(content: str) -> Iterator[tuple[int, str, int]]:
    """(offset, window, characters that the window before also has). Cuts are at blanks where there are any."""
    at = seen = 0
    while True:
        end = len(content)
        if end - at > WINDOW:
            blank = content.rfind(" ", at + WINDOW - OVERLAP // 2, at + WINDOW)
            end = blank if blank > 0 else at + WINDOW
        yield at, content[at:end], max(0, seen - at)
        if end == len(content):
            return
        seen, blank = end, content.find(" ", end - OVERLAP, end - OVERLAP // 2)
        at = blank + 1 if blank > 0 else end - OVERLAP


def located(text: str | None) -> Iterator[tuple[list[int], list[int], int, str, int]]:
    """(offsets, line numbers, offset of the block, block, characters seen before) of the candidate blocks."""
    if text and has_sign(text):
        for content, offsets, numbers in paragraphs(text):
            if has_sign(content):
                yield from ((offsets, numbers, at, block, seen) for at, block, seen in windows(content) if has_sign(block))


def has_sign(text: str) -> bool:
    low = text.lower()
    return any(s in low for s in SIGNS)


def blocks(text: str | None) -> list[tuple[int, str]]:
    """(number of the first line, block) of the candidate blocks."""
    return [(numbers[bisect_right(offsets, at) - 1], block) for offsets, numbers, at, block, _ in located(text)]


@dataclass(frozen=True)
class Match:
    """A licence that a block confirms, or the best template of a block that confirms none; start and end of its last place in the block."""

    licence: str | None
    template: int
    saving: float
    missing: int
    extra: int
    start: int
    end: int


def wording_end(template: list[str], block: list[str], at: int) -> int | None:
    """The place after the template's wording, if that starts at block[at]; FILLERS may stand between its words."""
    for k, w in enumerate(template):
        if w == "*":
            ends = (wording_end(template[k + 1 :], block, at + skip) for skip in range(FREE + 1))
            return next((e for e in ends if e is not None), None)
        skipped = 0
        while k and at < len(block) and block[at] != w and block[at] in FILLERS and skipped < SKIPS:
            at, skipped = at + 1, skipped + 1
        if at >= len(block) or block[at] != w:
            return None
        at += 1
    return at


def tag_end(name: str, block: list[str], at: int) -> int | None:
    """The place after an identifier in the expression that follows a tag at block[at]: identifiers with a joining word between them."""
    for k in range(at + 1, len(block), 2):
        if block[k] == name:
            return k + 1
        if k + 1 >= len(block) or block[k + 1] not in JOINS:
            return None
    return None


def difference(template: list[str], block: list[str]) -> tuple[int, int]:
    """(missing, extra): words of the template that the block lacks at its best place, and words of the block between them beyond free fields.

    The alignment with the fewest missing words, then the fewest extra ones: a row
    a template word, a cell the block's word that it is matched with at the latest.
    """
    spelled = [w for w in template if w != "*"]
    free = [FREE if i and template[i - 1] == "*" else 0 for i, w in enumerate(template) if w != "*"]
    best = (len(spelled), 0)
    ends: dict[int, tuple[int, int]] = {}  # place of the last matched word: cost, with the words before it
    for k, w in enumerate(spelled):
        found = {}
        for at in (i for i, own in enumerate(block) if own == w):
            options = [(k, 0)] + [(m, e + max(0, at - place - 1 - free[k])) for place, (m, e) in ends.items() if place < at <= place + 1 + FREE + free[k]]
            found[at] = min(options)
        ends = {place: (m + 1, e) for place, (m, e) in ends.items()}
        for at, cost in found.items():
            ends[at] = min(cost, ends.get(at, cost))
    return min([best, *ends.values()])


class Scanner:
    """Templates as dictionaries, and the matches of the blocks met last."""

    def __init__(self, templates: tuple[tuple[str, str], ...] = TEMPLATES + TAGS):
        self.templates = templates
        self.words = [words(t) for _, t in templates]
        self.tags = {i for i, w in enumerate(self.words) if w[0] == TAG}
        self.plain = zstandard.ZstdCompressor(level=LEVEL, write_content_size=False, write_checksum=False)
        self.given = [zstandard.ZstdCompressor(level=LEVEL, dict_data=zstandard.ZstdCompressionDict(t.lower().encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_dict_id=False) for _, t in templates]
        self.own = [self._saved(t, [i])[0][0] for i, (_, t) in enumerate(templates)]
        self.known: OrderedDict[str, tuple[Match, ...]] = OrderedDict()

    def match(self, block: str) -> Match:
        """The first of the block's matches: that of the best ranked template."""
        return self.matches(block)[0]

    def matches(self, block: str) -> tuple[Match, ...]:
        """A match for each licence that the block confirms, or one without a licence."""
        if block not in self.known:
            ranked = self._ranked(block)
            self.known[block] = tuple(self._confirmed(block, [i for i, _, share in ranked if share >= SHARE])) or (self._best(block, *ranked[0][:2]),)
            if len(self.known) > CACHE:
                self.known.popitem(last=False)
        return self.known[block]

    def _saved(self, piece: str, chosen: list[int]) -> tuple[list[int], int]:
        """(bytes saved by each chosen template, bytes without any)."""
        raw = " ".join(piece.lower().split()).encode("utf-8", "surrogatepass")
        alone = len(self.plain.compress(raw))
        return [alone - len(self.given[i].compress(raw)) for i in chosen], alone

    def _ranked(self, block: str) -> list[tuple[int, float, float]]:
        """(template, share of the compressed size that it saves, share of its own saving), by saved bytes; the best of the stretches around licensing words counts."""
        chosen = [i for i in range(len(self.templates)) if i not in self.tags or TAG in block.lower()]
        saved, rows = dict.fromkeys(chosen, (-(1 << 30), 1)), []
        for piece in surroundings(block):
            each, alone = self._saved(piece, chosen)
            for i, n in zip(chosen, each, strict=True):
                saved[i] = max(saved[i], (n, alone))
        for i, (n, alone) in saved.items():
            rows.append((-n, -len(self.words[i]), i, n / alone))
        return [(i, part, -n / self.own[i]) for n, _, i, part in sorted(rows)]

    def _confirmed(self, block: str, winners: list[int]) -> Iterator[Match]:
        """A match for each licence that one of the winners, in order, confirms by its wording."""
        spans = [m for m in _WORD.finditer(block) if m[0] != "*"]
        own, places = [SAME.get(m[0].lower(), m[0].lower()) for m in spans], defaultdict(list)
        for at, w in enumerate(own):
            places[w].append(at)
        first, met = {}, defaultdict(dict)
        for i in winners:
            licence, template = self.templates[i][0], self.words[i]
            for at in places.get(template[0], ()):
                end = tag_end(template[1], own, at) if i in self.tags else wording_end(template, own, at)
                if end and not NEGATIONS & set(own[max(0, at - BEFORE) : at]):
                    first.setdefault(licence, (i, block[spans[at].start() : spans[end - 1].end()]))
                    met[licence][at] = min(end, met[licence].get(at, end))
        for licence, (i, passage) in first.items():
            at = max(met[licence])
            (saved,), alone = self._saved(passage, [i])
            extra = 0 if i in self.tags or "*" in self.words[i] else len(words(passage)) - len(self.words[i])
            yield Match(licence, i, saved / alone, 0, extra, spans[at].start(), spans[met[licence][at] - 1].end())

    def _best(self, block: str, i: int, saving: float) -> Match:
        """The best ranked template of a block that confirms none, with its difference in wording."""
        missing, extra = difference(self.words[i], words(block))
        signs = list(signed(block)) or [(0, len(block))]
        return Match(None, i, saving, missing, extra, min(a for a, _ in signs), max(b for _, b in signs))


def signed(block: str) -> Iterator[tuple[int, int]]:
    low = block.lower()
    yield from sorted((m.start(), m.end()) for s in SIGNS for m in re.finditer(re.escape(s), low))


def surroundings(block: str) -> Iterator[str]:
    """The stretches of AROUND characters on either side of licensing words, overlapping ones as one."""
    begin = upto = None
    for start, end in signed(block) if has_sign(block) else [(0, len(block))]:
        if upto is None or start - AROUND > upto:
            if upto is not None:
                yield block[begin:upto]
            begin = max(0, start - AROUND)
        upto = end + AROUND
    yield block[begin:upto]


def scan(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each licence of a candidate block: doc_id, line (where the match starts), block, licence (null: not confirmed), template, saving, missing, extra."""
    names = ["doc_id", "line", "block", "licence", "template", "saving", "missing", "extra"]
    types = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.int32(), pa.int32())
    held: list[Scanner] = []

    def work(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        if not held:
            held.append(Scanner())
        rows = []
        for doc, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            for offsets, numbers, at, block, seen in located(text):
                for m in held[0].matches(block):
                    if m.end > seen:
                        line = numbers[bisect_right(offsets, at + m.start) - 1]
                        rows.append((doc, line, block, m.licence, held[0].templates[m.template][1], m.saving, m.missing, m.extra))
        if not rows:
            return None
        return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return map_batches(df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), "doc_id long, line int, block string, licence string, template string, saving double, missing int, extra int", work)
