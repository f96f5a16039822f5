"""License scans by patience alignment of whole texts with license templates.

A word that occurs once in the text and once in the template is an anchor; the longest increasing subsequence of anchors is
kept, and the gaps between them are aligned in the same way, where words that repeat over the whole text may be unique again.
Gaps without anchors match equal words at their ends. Coverage is the share of the template's words that are aligned. A text
holds a license if coverage reaches the threshold and the aligned stretch of text is not much longer than the template. Windows
of that length are aligned one by one, so that a notice that stands twice, or stray words beside it, make no word ambiguous. The
words that name the license and its version (``NAMING``) must be among the aligned ones.

A template needs at least its threshold's share of words in the text, so texts that lack them are left out before alignment;
this loses nothing. Templates are few and given by the caller (``TEMPLATES`` by default); each text lies whole in one task.

Defined results: a null or wordless text has no license; of equally covered templates the longer, then the first by name wins;
repeated rows are judged alike; an empty table gives an empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections import Counter
from collections.abc import Collection, Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F

_WORD = re.compile(r"[^\W_]+(?:[.\-][^\W_]+)*")
RESULT = "license string, coverage double, n_aligned long, first_word long, last_word long"
THRESHOLD, STRETCH = 0.8, 2.0

#: Short public notices by which texts name their license.
TEMPLATES = {
    "MIT": "Released under the MIT License.",
    "MIT-long": """Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated
        documentation files (the "Software"), to deal in the Software without restriction, including without limitation the rights
        to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to
        whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this
        permission notice shall be included in all copies or substantial portions of the Software.""",
    "Apache-2.0": "Licensed under the Apache License, Version 2.0.",
    "GPL-3.0": "This work is licensed under the GNU General Public License, version 3.",
    "GPL-2.0": "This work is licensed under the GNU General Public License, version 2.",
    "BSD-3-Clause": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.",
    "CC-BY-NC-4.0": "Licensed under CC BY-NC 4.0.",
    "CC-BY-4.0": "Licensed under CC BY 4.0.",
    "CC-BY-SA-4.0": "Licensed under CC BY-SA 4.0.",
    "CC0-1.0": "To the extent possible under law, the author has waived all copyright and related rights to this work.",
    "Proprietary": "Copyright. All rights reserved. No part of this publication may be reproduced without permission.",
    "ISC": """Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided
        that the above copyright notice and this permission notice appear in all copies.""",
    "GPL-3.0-notice": """This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.""",
    "GPL-2.0-notice": """This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public
        License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.""",
}
#: Words by which a notice names its license and version: without them the rest of a notice may belong to another license.
NAMING = {
    "MIT": ("mit",),
    "Apache-2.0": ("apache", "2.0"),
    "GPL-3.0": ("gnu", "3"),
    "GPL-2.0": ("gnu", "2"),
    "GPL-3.0-notice": ("gnu", "3"),
    "GPL-2.0-notice": ("gnu", "2"),
    "CC-BY-NC-4.0": ("cc", "by-nc", "4.0"),
    "CC-BY-4.0": ("cc", "by", "4.0"),
    "CC-BY-SA-4.0": ("cc", "by-sa", "4.0"),
    "CC0-1.0": ("waived", "copyright"),
    "Proprietary": ("rights", "reserved"),
}


def words(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def increasing(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Longest subsequence of pairs, sorted by their first number, whose second numbers increase."""
    tails: list[int] = []
    ends: list[int] = []
    back = [-1] * len(pairs)
    for i, (_, b) in enumerate(pairs):
        k = bisect_left(tails, b)
        back[i] = ends[k - 1] if k else -1
        if k == len(tails):
            tails.append(b)
            ends.append(i)
        else:
            tails[k], ends[k] = b, i
    out, i = [], ends[-1] if ends else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


def patience(a: list[str], b: list[str]) -> list[tuple[int, int]]:
    """Aligned places (in a, in b), in order. Gaps wait on a list, so deep nesting needs no recursion."""
    out, gaps = [], [(0, len(a), 0, len(b))]
    while gaps:
        a0, a1, b0, b1 = gaps.pop()
        while a0 < a1 and b0 < b1 and a[a0] == b[b0]:
            out.append((a0, b0))
            a0, b0 = a0 + 1, b0 + 1
        while a0 < a1 and b0 < b1 and a[a1 - 1] == b[b1 - 1]:
            a1, b1 = a1 - 1, b1 - 1
            out.append((a1, b1))
        if a0 == a1 or b0 == b1:
            continue
        in_b = Counter(b[b0:b1])
        wanted = {w for w, n in in_b.items() if n == 1}
        place: dict[str, int] = {}
        for i in range(a0, a1):
            if a[i] in wanted:
                place[a[i]] = -1 if a[i] in place else i
        anchors = increasing(sorted((place[b[j]], j) for j in range(b0, b1) if place.get(b[j], -1) >= 0))
        if not anchors:
            continue
        out += anchors
        for (p, q), (r, s) in zip([(a0 - 1, b0 - 1), *anchors], [*anchors, (a1, b1)], strict=True):
            if p + 1 < r and q + 1 < s:
                gaps.append((p + 1, r, q + 1, s))
    return sorted(out)


def windows(text: list[str], template: list[str], threshold: float) -> list[tuple[int, int]]:
    """Stretches of the text, as long as STRETCH templates, that hold enough of the template's words; overlapping ones merged."""
    need, size = Counter(template), max(len(template), int(STRETCH * len(template)))
    places = [i for i, w in enumerate(text) if w in need]
    out: list[tuple[int, int]] = []
    have: Counter = Counter()
    common, left = 0, 0
    for right, i in enumerate(places):
        have[text[i]] += 1
        common += have[text[i]] <= need[text[i]]
        while places[left] <= i - size:
            w = text[places[left]]
            common -= have[w] <= need[w]
            have[w] -= 1
            left += 1
        if common >= threshold * len(template) - 1e-9:
            start = places[left]
            if out and start <= out[-1][1]:
                out[-1] = (out[-1][0], i)
            else:
                out.append((start, i))
    return out


def in_order(text: list[str], template: list[str]) -> Iterator[int]:
    """Length of the longest common subsequence, which no alignment exceeds, after each word; a number's bits are template places."""
    places: dict[str, int] = {}
    for i, w in enumerate(template):
        places[w] = places.get(w, 0) | 1 << i
    every = v = (1 << len(template)) - 1
    for w in text:
        m = places.get(w, 0)
        v = (v + (v & m) | v & ~m) & every
        yield len(template) - v.bit_count()


def align(text: list[str], template: list[str], threshold: float, naming: Collection[str] = ()) -> tuple[int, int, int] | None:
    """(aligned words, first, last) of the best aligned window of a stretch, then the first; None below the threshold or if one of
    the naming words is not aligned.

    Every window that begins and ends with a word of the template, is not too long and has words enough is aligned by itself, so a
    repeated notice or stray words beside it hide nothing. Windows with most words in order come first; none aligns more.
    """
    least, limit, known = threshold * len(template) - 1e-9, max(len(template), int(STRETCH * len(template))), set(template)
    starts = [i for i, w in enumerate(text) if w in known]
    best: tuple[int, int, int] | None = None
    target = max(in_order(text, template), default=0)
    while target >= least and (best is None or -best[0] <= target):
        for start in starts:
            if best and -best[0] >= target and start > best[1]:
                break
            for end, common in enumerate(in_order(text[start : start + limit], template), start):
                if common > target:
                    break
                if common == target and text[end] in known:
                    pairs = patience(text[start : end + 1], template)
                    if len(pairs) >= least and set(naming) <= {template[q] for _, q in pairs}:
                        found = (-len(pairs), start + pairs[0][0], start + pairs[-1][0])
                        best = min(best, found) if best else found
                        if len(pairs) >= target:
                            break
        target -= 1
    return best and (-best[0], best[1], best[2])


def scan(text: str | None, templates: dict[str, list[str]], threshold: float = THRESHOLD, naming: dict[str, tuple[str, ...]] | None = None) -> tuple:
    """The best covered template of a whole text: RESULT as a tuple. naming: words that must be aligned, by template."""
    own, best = words(text), None
    have = Counter(own)
    for name, template in templates.items():
        named = (naming or {}).get(name, ())
        if not all(have[w] for w in named) or sum(min(n, have[w]) for w, n in Counter(template).items()) < threshold * len(template) - 1e-9:
            continue
        for first, last in windows(own, template, threshold):
            if aligned := align(own[first : last + 1], template, threshold, named):
                n, start, end = aligned
                found = (-n / len(template), -len(template), name, first + start, first + end, n)
                best = min(best, found) if best else found
    return (None, 0.0, 0, None, None) if best is None else (best[2], -best[0], best[5], best[3], best[4])


def scan_licenses(docs: DataFrame, templates: dict[str, str] | None = None, threshold: float = THRESHOLD, naming: dict[str, tuple[str, ...]] | None = None, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc_id, license, coverage, n_aligned, first_word, last_word) of every row. Own templates have no naming words by default."""
    known = {k: words(v) for k, v in (templates or TEMPLATES).items() if words(v)}
    named = naming if naming is not None or templates else NAMING

    @F.pandas_udf(RESULT)
    def result(texts: pd.Series) -> pd.DataFrame:
        out = pd.DataFrame([scan(t, known, threshold, named) for t in texts], columns=["license", "coverage", "n_aligned", "first_word", "last_word"])
        return out.astype({"first_word": "Int64", "last_word": "Int64"})

    return docs.select(F.col(doc_id).alias("doc_id"), result(F.col(text)).alias("_r")).select("doc_id", "_r.*")
