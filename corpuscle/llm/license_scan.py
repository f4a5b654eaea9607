"""License notices in documents by conditional compression.

Candidate blocks are windows of words around each mention of a license, a copyright or permission, in five widths; they
overlap by half, go over sentence and line ends and start before the mention as well.  Every block is compressed alone
and with each template as a zstandard raw dictionary, and templates are ranked by the bytes they save.  A template wins
a block if it saves at least MIN_GAIN of what it saves on its own wording.  Winners are aligned with the block in that
order and confirmed by exact wording: all differences are listed, and a difference in a name, number or version refutes.
A confirmed notice, from its first word to its last, is compressed once more by itself; of notices that overlap the one
that saves most bytes, less the bytes of names that differ, stays.  A notice that holds none of those mentions (_TRIGGER) isn't looked for.

Whole texts are read; a document may have any number of findings.  Nulls: a null text has none.  Rows repeat freely.
Other columns are ignored.
"""

from __future__ import annotations

import bisect
import difflib
import functools
import math
import re
from collections import Counter

import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Public wordings of license notices.
TEMPLATES: list[tuple[str, str]] = [
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("GPL-2.0", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version."),
    ("LGPL-2.1", "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version."),
    ("AGPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("CC0-1.0", "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
]
_TRIGGER = re.compile(r"licen[cs]e|copyright|permission|redistribut|public domain|free software", re.I)
_WORD = re.compile(r"[\w.+-]*\w")
#: Words that may differ without changing what is granted.
_SOFT = frozenset("a an the this that is are of to in by or and under released licensed license work works file software program it may be with see you".split())
MIN_RATIO = 0.8
#: Share of the bytes saved on a template's own wording that a block must save.
MIN_GAIN = 0.25
#: Words of the longest template of each width of blocks.
WIDTHS = (8, 16, 32, 64, 128)
RESULT = "license string, start int, length int, reduction double, ratio double, missing array<string>, added array<string>"


@functools.cache
def _compressors() -> tuple[zstandard.ZstdCompressor, list[zstandard.ZstdCompressor]]:
    """A plain compressor and one for the words of each template."""
    plain = {"level": 12, "write_content_size": False, "write_checksum": False}
    return zstandard.ZstdCompressor(**plain), [zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(" ".join(a).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), **plain) for a, _ in _templates()]


def _words(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@functools.cache
def _templates() -> list[tuple[list[str], Counter]]:
    return [(w, Counter(w)) for w in (_words(t) for _, t in TEMPLATES)]


def confirm(a: list[str], b: list[str]) -> tuple[float, list[str], list[str], int, int] | None:
    """Share of the template's words found in order, words missing, words put between, and the first and last word's
    place in b; None where they refute it."""
    steps = difflib.SequenceMatcher(None, a, b, autojunk=False).get_opcodes()
    missing, added, same = [], [], 0
    inner = [i for i, s in enumerate(steps) if s[0] == "equal"]
    if not inner:
        return None
    for i, (what, p, q, r, s) in enumerate(steps):
        if what == "equal":
            same += q - p
        else:
            missing += a[p:q]
            if inner[0] < i < inner[-1]:  # what stands before or after the notice isn't part of it
                added += b[r:s]
    hard = [w for w in missing + added if w not in _SOFT]
    ratio = same / len(a)
    if ratio < MIN_RATIO or any(re.search(r"\d", w) for w in hard) or len(hard) > 0.1 * len(a):
        return None
    return ratio, missing, added, steps[inner[0]][3], steps[inner[-1]][4] - 1


@functools.cache
def _own_gains() -> list[int]:
    """Bytes that each template saves on its own wording."""
    plain, primed = _compressors()
    own = [" ".join(a).encode() for a, _ in _templates()]
    return [len(plain.compress(t)) - len(c.compress(t)) for t, c in zip(own, primed, strict=True)]


def ranked(block: list[str]) -> list[tuple[int, int]]:
    """(bytes saved, number of the template) of a block of words, most first."""
    plain, primed = _compressors()
    data = " ".join(block).encode("utf-8", "surrogatepass")
    alone = len(plain.compress(data))
    return sorted(((alone - len(c.compress(data)), k) for k, c in enumerate(primed)), key=lambda r: (-r[0], r[1]))


def _blocks(near: list[int]):
    """(first place, one past the last, width) of the candidate blocks that hold one of the places near."""
    for c in WIDTHS:
        size = 2 * c + max(2, c // 5)
        for g in sorted({g for i in near for g in range(max(0, (i - size) // c + 1), i // c + 1)}):
            yield g * c, g * c + size, c


def _aligned(words: list[str], at: int, to: int, k: int, tried: set[tuple[int, int]]):
    """Confirmed places of template k in a block: (template, first place, last place, proof)."""
    a, count = _templates()[k]
    slack = max(2, len(a) // 5)
    window = words[at:to]
    offsets = Counter(at + q - p for q, w in enumerate(window) if w in count for p, x in enumerate(a) if x == w)
    # a notice has at most that many words missing or put between, so some offset has its share of equal words
    need = max(1, math.ceil(MIN_RATIO * len(a)) // (slack + 1))
    for start, _ in sorted(((o, n) for o, n in offsets.items() if n >= need), key=lambda o: (-o[1], o[0])):
        if (k, start) in tried:
            continue
        tried.add((k, start))
        for more in (0, slack):  # a notice with words put between is longer than its template
            low = max(0, start - more)
            part = words[low : max(0, start + len(a) + more)]
            if (Counter(part) & count).total() < MIN_RATIO * len(a):
                continue
            if sure := confirm(a, part):
                yield k, low + sure[3], low + sure[4], sure[:3]
                if sure[0] == 1 and not sure[2]:
                    break


def _notices(words: list[str], near: list[int]):
    """Confirmed notices in the words of a text, near: the triggers among them."""
    tried: set[tuple[int, int]] = set()
    own = _own_gains()
    for at, to, c in _blocks(near):
        for saved, k in ranked(words[at:to]):
            if saved >= MIN_GAIN * own[k] and c == min(w for w in WIDTHS if w >= len(_templates()[k][0])):
                yield from _aligned(words, at, to, k, tried)


def _apart(rows: list[tuple]) -> list[tuple]:
    """Rows (first place, last place, ...) without those that overlap an earlier one."""
    firsts: list[int] = []
    taken: list[int] = []  # last places in the order of the first
    out: list[tuple] = []
    for r in rows:
        at = bisect.bisect_right(firsts, r[1])
        if at == 0 or taken[at - 1] < r[0]:
            firsts.insert(at, r[0])
            taken.insert(at, r[1])
            out.append(r)
    return out


def scan(text: str | None) -> list[tuple]:
    """(license, start, length, reduction, ratio, missing, added) for each notice, in text order."""
    if not text or not _TRIGGER.search(text):
        return []
    plain, primed = _compressors()
    spans = [m.span() for m in _WORD.finditer(text)]
    words = [text[p:q].lower() for p, q in spans]
    starts = [p for p, _ in spans]
    near = sorted({max(0, bisect.bisect_right(starts, m.start()) - 1) for m in _TRIGGER.finditer(text)}) if spans else []
    proven: list[list[tuple]] = [[] for _ in TEMPLATES]
    for k, i, j, sure in _notices(words, near):
        proven[k].append((i, j, sure))
    notices = []
    for k, places in enumerate(proven):
        for i, j, sure in _apart(sorted(places, key=lambda r: (-r[2][0], len(r[2][2]), r[0], r[1]))):
            at, end = spans[i][0], spans[j][1]
            end += text[end : end + 1] == TEMPLATES[k][1][-1]  # its last stop
            data = " ".join(words[i : j + 1]).encode("utf-8", "surrogatepass")
            alone = len(plain.compress(data))
            saves = alone - len(primed[k].compress(data))
            notices.append((at, end - 1, saves - sum(len(w) for w in sure[1] + sure[2] if w not in _SOFT), k, saves / alone, sure))
    # of those that overlap the one that saves most bytes, less those of names and other hard words that differ
    found = _apart(sorted(notices, key=lambda r: (-r[2], -r[5][0], r[3], r[0])))
    return [(TEMPLATES[k][0], at, last + 1 - at, round(gain, 6), round(sure[0], 6), *sure[1:]) for at, last, _, k, gain, sure in sorted(found, key=lambda r: r[0])]


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, n_licenses, licenses (distinct, sorted, joined by commas), findings for every row."""

    def run(batches):
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch = whole.slice(at, 256)
                rows = [scan(t) for t in batch.column(1).to_pylist()]
                names = [c.split()[0] for c in RESULT.split(", ")]
                kind = pa.struct([("license", pa.string()), ("start", pa.int32()), ("length", pa.int32()), ("reduction", pa.float64()), ("ratio", pa.float64()), ("missing", pa.list_(pa.string())), ("added", pa.list_(pa.string()))])
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in rows], pa.int64()), pa.array([",".join(sorted({f[0] for f in r})) for r in rows]), pa.array([[dict(zip(names, f, strict=True)) for f in r] for r in rows], pa.list_(kind))], ["doc_id", "n_licenses", "licenses", "findings"])

    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(run, f"doc_id long, n_licenses long, licenses string, findings array<struct<{', '.join(c.replace(' ', ':', 1) for c in RESULT.split(', '))}>>")
