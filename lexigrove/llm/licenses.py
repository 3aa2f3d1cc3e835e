"""License scans by conditional compression.

A window of words around each run of cue words is a candidate block; line breaks and
comment marks are no words, so a notice may be wrapped. Each template is aligned with
the words of a block; a span that has its wording but for few words is confirmed if
compression of the span with the template as zstandard raw dictionary saves bytes. Of spans that
overlap, the one that differs in the fewest words stays, and what is left on both its sides is
searched again; the result lists exactly which words differ.

Defined cases: null and empty texts have no blocks; a text without cues has no
rows; rows that repeat a doc_id are scanned each; spans that differ in equally few words go to the
longer template, then to the larger saving, then by name; further columns are ignored.
"""

from __future__ import annotations

import math
import re
from bisect import bisect_right
from collections import Counter
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lexigrove.llm._store import bound_batches

# The public wordings of these notices.
TEMPLATES = {
    "all-rights-reserved": "All rights reserved.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "agpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "apache-2.0-header": 'Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file except in compliance with the License.',
    "apache-2.0-warranty": 'Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an "AS IS" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.',
    "boost-1.0": "Distributed under the Boost Software License, Version 1.0.",
    "bsd-3-clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:",
    "bsd-disclaimer": 'THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS "AS IS" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED.',
    "cc-by-4.0": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0.",
    "cc-by-sa-4.0": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "cc0-1.0": "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work.",
    "epl-2.0": "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which is available at",
    "gpl-2.0-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "lgpl-2.1-header": "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.",
    "mit": "Released under the MIT License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files, to deal in the Software without restriction.",
    "mit-warranty": 'THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.',
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
    "zlib": "This software is provided 'as-is', without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.",
}
CUES = r"(?i)licen[sc]e|copyright|rights\W+reserved|redistribut|permission\W+is|waived\W+all|CC\W+BY|without\W+(?:any\W+express|warranty)|public\W+domain"
#: More words than the longest template and the words that may be added within it.
WINDOW = 60
LEAST_SHARE = 0.8

_WORD = re.compile(r"\w+(?:[.\-]\w+)*")
_CUE = re.compile(CUES)


def wording(text: str) -> list[str]:
    return [w.lower() for w in _WORD.findall(text)]


@cache
def _plain() -> zstandard.ZstdCompressor:
    return zstandard.ZstdCompressor(level=9, write_content_size=False)


@cache
def _packers() -> dict[str, tuple[zstandard.ZstdCompressor, list[str]]]:
    raw = lambda t: zstandard.ZstdCompressionDict((t * max(1, -(-16 // len(t)))).encode(), dict_type=zstandard.DICT_TYPE_RAWCONTENT)
    return {name: (zstandard.ZstdCompressor(level=9, dict_data=raw(text), write_content_size=False), wording(text)) for name, text in TEMPLATES.items()}


def blocks(text: str) -> Iterator[tuple[int, str]]:
    """(start, block) of the candidates of a text: WINDOW words on both sides of each cue, windows that meet being one."""
    marks = list(_WORD.finditer(text))
    starts = [m.start() for m in marks]
    spans: list[list[int]] = []
    for cue in _CUE.finditer(text):
        a, b = (bisect_right(starts, x) - 1 for x in (cue.start(), cue.end() - 1))
        a, b = max(0, a - WINDOW), min(len(marks), b + 1 + WINDOW)
        if spans and a <= spans[-1][1]:
            spans[-1][1] = b
        else:
            spans.append([a, b])
    for a, b in spans:
        yield marks[a].start(), text[marks[a].start() : marks[b - 1].end()]


def _limits(n: int) -> tuple[int, int]:
    """Words of a template of n words that may be missing, and that may be added within it."""
    return n - math.ceil(LEAST_SHARE * n), math.floor((1 - LEAST_SHARE) * n)


def confirmed(words: list[str], own: list[str]) -> list[tuple[int, int, int]]:
    """(words that differ, begin, end) of spans of ``own`` that have the wording, none overlapping another, the closest first."""
    n, m = len(words), len(own)
    number = {w: i for i, w in enumerate(dict.fromkeys(words))}
    codes = np.array([number.get(w, -1) for w in own], dtype=np.int64)
    template = [number[w] for w in words]
    lost, more = _limits(n)
    # for each end, the fewest words missing or added over all begins, and the first begin that has so few: as one number
    base, at = m + 1, np.arange(m + 1)
    best = at.copy()
    for code in template:
        step = best + base
        step[1:] = np.where(codes == code, np.minimum(step[1:], best[:-1]), step[1:])
        best = np.minimum.accumulate(step - at * base) + at * base
    spans = []
    for end in np.flatnonzero(best // base <= lost + more).tolist():
        differ, begin = divmod(int(best[end]), base)
        same = (n + end - begin - differ) // 2
        if n - same > lost or end - begin - same > more:  # another begin may differ more and yet be within both limits
            low = max(0, end - n - more)
            part = codes[low:end]
            common = np.zeros(len(part) + 1, dtype=np.int64)
            for code in reversed(template):
                step = common.copy()
                step[:-1] = np.where(part == code, np.maximum(step[:-1], common[1:] + 1), step[:-1])
                common = np.maximum.accumulate(step[::-1])[::-1]
            missing, added = n - common, len(part) - np.arange(len(part) + 1) - common
            total = np.where((missing <= lost) & (added <= more), missing + added, n + m)
            begin, differ = low + int(total.argmin()), int(total.min())
            if differ == n + m:
                continue
        spans.append((differ, begin, end))
    return _apart(sorted(spans), m)


def _apart(spans: list[tuple], m: int) -> list[tuple]:
    """Those spans (..., begin, end) that overlap none before them."""
    taken, out = np.zeros(m, dtype=bool), []
    for span in spans:
        if not taken[span[-2] : span[-1]].any():
            taken[span[-2] : span[-1]] = True
            out.append(span)
    return out


def _different(words: list[str], own: list[str]) -> tuple[list[str], list[str]]:
    """(words missing, words added) of a longest common subsequence."""
    length = [[0] * (len(own) + 1) for _ in range(len(words) + 1)]
    for i in range(len(words) - 1, -1, -1):
        for j in range(len(own) - 1, -1, -1):
            length[i][j] = length[i + 1][j + 1] + 1 if words[i] == own[j] else max(length[i + 1][j], length[i][j + 1])
    i, j, missing, added = 0, 0, [], []
    while i < len(words) or j < len(own):
        if i < len(words) and j < len(own) and words[i] == own[j]:
            i, j = i + 1, j + 1
        elif j == len(own) or i < len(words) and length[i + 1][j] >= length[i][j + 1]:
            missing.append(words[i])
            i += 1
        else:
            added.append(own[j])
            j += 1
    return missing, added


def notices(block: str) -> list[tuple[int, str, int, int, list[str], list[str]]]:
    """(start, license, bytes saved, words that differ, words missing, words added within it) of all confirmed spans, none overlapping another, by their start."""
    marks = list(_WORD.finditer(block))
    own = [m.group().lower() for m in marks]
    out, rest = [], [(0, len(own))]
    while rest:
        low, high = rest.pop()
        there, found = Counter(own[low:high]), []
        for name, (packer, words) in _packers().items():
            if sum((Counter(words) & there).values()) < LEAST_SHARE * len(words):
                continue
            for differ, begin, end in confirmed(words, own[low:high]):
                data = block[marks[low + begin].start() : marks[low + end - 1].end()].encode()
                saved = len(_plain().compress(data)) - len(packer.compress(data))
                if saved > 0:
                    found.append((differ, -len(words), -saved, name, begin, end))
        spans = _apart(sorted(found), high - low)
        for differ, _, less, name, begin, end in spans:
            out.append((marks[low + begin].start(), name, -less, differ, *_different(_packers()[name][1], own[low + begin : low + end])))
        if spans:
            edges = [0, *(x for s in sorted(spans, key=lambda s: s[-1]) for x in s[-2:]), high - low]
            rest += [(low + a, low + b) for a, b in zip(edges[::2], edges[1::2], strict=True) if a < b]
    return sorted(out, key=lambda x: x[0])


def judged(block: str) -> tuple[str, int, int, list[str], list[str]] | None:
    """(license, bytes saved, words that differ, words missing, words added within it) of the notice of a block that differs least, if there is one."""
    found = [x[1:] for x in notices(block)]
    return min(found, key=lambda x: (x[2], -len(_packers()[x[0]][1]), -x[1], x[0])) if found else None


def license_scan(docs: DataFrame) -> DataFrame:
    """doc_id, start (code point), license, saved_bytes, differing_words, missing, added of each notice."""
    bound_batches(docs.sparkSession)
    ddl = "doc_id long, start long, license string, saved_bytes int, differing_words int, missing string, added string"
    types = {"long": pa.int64(), "string": pa.string(), "int": pa.int32()}
    schema = pa.schema([(x.split()[0], types[x.split()[1]]) for x in ddl.split(", ")])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                for start, block in blocks(text):
                    for at, name, saved, differ, missing, added in notices(block):
                        rows.append((doc_id, start + at, name, saved, differ, " ".join(missing), " ".join(added)))
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], t) for k, t in enumerate(schema.types)], schema=schema)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").where(F.col("text").rlike(CUES)).mapInArrow(scan, ddl)
