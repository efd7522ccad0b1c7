"""License scans: MinHash bands over windows retrieve templates, shingle containment verifies them."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import pick

SHINGLE = 5  # words
CONTAINED = 0.8
BANDS = 32
BAND_ROWS = 2
FILTER_BITS = 20
MOST_TEMPLATES = 20_000  # they go to every task

# Wordings of public licenses and of common notices that name one.
TEMPLATES = {
    "mit-name": "Released under the MIT License.",
    "mit-name-2": "Licensed under the MIT License.",
    "apache-2.0-name": "Licensed under the Apache License, Version 2.0.",
    "gpl-3-name": "This work is licensed under the GNU General Public License, version 3.",
    "cc-by-nc-4.0-name": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-name": "This work is licensed under a Creative Commons Attribution 4.0 International License.",
    "cc-by-sa-4.0-name": "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.",
    "mit-grant": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.",
    "mit-warranty": "THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT.",
    "apache-2.0-header": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License for the specific language governing permissions and limitations under the License.",
    "gpl-3-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "gpl-2-header": "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution.",
    "isc-grant": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.",
    "mpl-2.0-header": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
    "unlicense": "This is free and unencumbered software released into the public domain.",
}


def word_hashes(text: Column) -> Column:
    """Hashes of a text's words, lower case, cut at anything that is neither a letter nor a digit."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0x7FB5D329728EA185)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x81DADEF4BC2DD44D)
    return x ^ (x >> np.uint64(33))


_SEEDS = _mix(np.arange(1, BANDS * BAND_ROWS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


def shingles(words: np.ndarray) -> np.ndarray:
    """A hash per run of five words; one for a text with fewer."""
    n = max(1, len(words) - SHINGLE + 1)
    out = np.zeros(n, np.uint64)
    for i in range(min(SHINGLE, len(words))):
        out = _mix(out * np.uint64(31) + words[i : i + n])
    return out


def bands(grams: np.ndarray) -> np.ndarray:
    """A number per band, from the smallest hash of each of its rows."""
    least = _mix(np.unique(grams)[None, :] ^ _SEEDS[:, None]).min(1).reshape(BANDS, BAND_ROWS)
    out = np.zeros(BANDS, np.uint64)
    for row in range(BAND_ROWS):
        out = _mix(out * np.uint64(31) + least[:, row])
    return out


class Library:
    """Templates with their shingles, and an index from bands to the templates that have them.

    A template of n shingles is looked for in windows of 1.5 n, half a template apart, so that one window holds all of an
    occurrence. That window and the template then have a Jaccard similarity of 2/3, or 8/17 if a fifth is changed (0.8 n of
    1.5 n + n - 0.8 n), and share one of 32 bands of two rows with a probability above 0.99999999, or of 0.9997. Templates
    of one size share their windows, so the work on a text grows with the sizes there are, not with the templates.
    """

    def __init__(self, hashes: dict[str, list[int]]):
        self.names = sorted(hashes)
        self.grams = [np.unique(shingles(np.array(hashes[n], np.int64).view(np.uint64))) for n in self.names]
        by_size: dict[int, list[int]] = {}
        for template, own in enumerate(self.grams):
            by_size.setdefault(len(own), []).append(template)
        self.sizes = [(size, _distinct([self.grams[t] for t in of]), *self._filed(of)) for size, of in sorted(by_size.items())]
        self.known = _distinct(self.grams)
        self.filter = np.zeros(1 << FILTER_BITS, bool)
        self.filter[(self.known >> np.uint64(64 - FILTER_BITS)).astype(np.int64)] = True

    def _filed(self, templates: list[int]) -> tuple[np.ndarray, np.ndarray]:
        keys = np.concatenate([band_keys(self.grams[t]) for t in templates])
        order = np.argsort(keys, kind="stable")
        return keys[order], np.repeat(templates, BANDS)[order]

    def hits(self, grams: np.ndarray) -> np.ndarray:
        """Where shingles are that some template has; a window without any shares no band with a template."""
        at = np.flatnonzero(self.filter[(grams >> np.uint64(64 - FILTER_BITS)).astype(np.int64)])
        return at[_among(grams[at], self.known)]

    def scan(self, grams: np.ndarray, hits: np.ndarray) -> list[tuple[str, float, int, int]]:
        """``name, containment, first shingle, last shingle`` of templates in one text; touching finds of one are one."""
        found: dict[int, list[list]] = {}
        for size, known, keys, owners in self.sizes:
            mine = hits[_among(grams[hits], known)]
            if not len(mine):
                continue
            width, step = max(1, -(-3 * size // 2)), max(1, size // 2)
            first = np.maximum(0, (mine - width) // step)
            starts = np.unique(np.concatenate([first + i for i in range(width // step + 2)])) * step
            for start in starts[starts < len(grams)].tolist():
                a, b = np.searchsorted(mine, [start, start + width])
                if a == b:
                    continue
                own = band_keys(grams[start : start + width])
                low, high = np.searchsorted(keys, own), np.searchsorted(keys, own, side="right")
                retrieved = {int(t) for i, j in zip(low, high, strict=True) if i < j for t in owners[i:j]}
                for template in retrieved:
                    inside = mine[a:b][_among(grams[mine[a:b]], self.grams[template])]
                    share = len(np.unique(grams[inside])) / size
                    if share < CONTAINED - 1e-12:
                        continue
                    regions = found.setdefault(template, [])
                    if regions and inside[0] <= regions[-1][2]:
                        regions[-1][0] = max(regions[-1][0], share)
                        regions[-1][2] = max(regions[-1][2], int(inside[-1]))
                    else:
                        regions.append([share, int(inside[0]), int(inside[-1])])
        return [(self.names[template], *region) for template in sorted(found) for region in found[template]]


def band_keys(grams: np.ndarray) -> np.ndarray:
    """Bands with their place among the bands, as one number each."""
    return _mix(bands(grams) ^ _SEEDS[:BANDS])


def _distinct(parts: list[np.ndarray]) -> np.ndarray:
    return np.unique(np.concatenate(parts))


def _among(values: np.ndarray, known: np.ndarray) -> np.ndarray:
    """Which values are among sorted known ones."""
    return known[np.minimum(np.searchsorted(known, values), len(known) - 1)] == values


def _scan(library: Library):
    kinds = [("key", None), ("license", pa.string()), ("containment", pa.float64()), ("first_word", pa.int64()), ("n_words", pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column("words")
            flat, ends = column.flatten().to_numpy(zero_copy_only=False).view(np.uint64), np.cumsum(column.value_lengths().fill_null(0).to_numpy())
            key = batch.column("key")
            out: list[list] = [[] for _ in kinds]
            if len(flat):
                grams = shingles(flat)
                starts = np.concatenate([[0], ends[:-1]])
                hits = library.hits(grams)
                of = np.searchsorted(ends, hits, side="right")
                fits = hits + SHINGLE <= ends[of]
                hits, of = hits[fits], of[fits]
                cuts = np.flatnonzero(np.diff(of, prepend=-1))
                for a, b in zip(cuts, np.append(cuts, len(of))[1:], strict=True):
                    doc = int(of[a])
                    begin, end = int(starts[doc]), int(ends[doc])
                    for name, share, first, last in library.scan(grams[begin : end - SHINGLE + 1], hits[a:b] - begin):
                        for c, v in zip(out, (doc, name, share, first, last - first + SHINGLE), strict=True):
                            c.append(v)
            yield pa.RecordBatch.from_arrays(
                [key.take(pa.array(out[0], pa.int64())), *(pa.array(c, t) for c, (_, t) in zip(out[1:], kinds[1:], strict=True))], names=[n for n, _ in kinds]
            )

    return run


def scan_licenses(rows: DataFrame, key: str = "doc_id", text: str = "text", templates: dict[str, str] | DataFrame | None = None) -> DataFrame:
    """Where documents hold license wordings: ``key, license, containment, first_word, n_words``, a row per place.

    ``containment`` is the share of the template's five-word shingles found there, 0.8 at least. Words are letters and digits in
    lower case. Each document is scanned alone, whole, and nothing is shuffled, so a wording in very many documents does no
    harm. ``templates`` are names and wordings, or a table ``name, text`` of up to ``MOST_TEMPLATES`` rows (more are refused);
    a few public wordings if not given. Null or repeated names and templates under five words are refused; without any, nothing is found.
    Null or empty texts and texts under five words hold none; null keys are passed on; a repeated row is reported again. Further
    columns are not looked at. An empty table gives an empty result.
    """
    hashes = _hashes(rows.sparkSession, TEMPLATES if templates is None else templates)
    words = pick(rows, key=key, text=text).select("key", word_hashes(F.coalesce("text", F.lit(""))).alias("words"))
    kind = words.schema["key"].dataType.simpleString()
    words = words if hashes else words.where(F.lit(False))
    found = words.mapInArrow(_scan(Library(hashes) if hashes else None), f"key {kind}, license string, containment double, first_word long, n_words long")
    return found.withColumnRenamed("key", key)


def _hashes(spark: SparkSession, templates: dict[str, str] | DataFrame) -> dict[str, list[int]]:
    """Hashes of the words of each template, by its name."""
    if not isinstance(templates, DataFrame):
        templates = spark.createDataFrame(sorted(templates.items()), "name string, text string")
    listed = pick(templates, name="name", text="text").select("name", word_hashes(F.coalesce("text", F.lit(""))).alias("h"))
    found = listed.limit(MOST_TEMPLATES + 1).collect()
    if len(found) > MOST_TEMPLATES:
        raise ValueError(f"more than {MOST_TEMPLATES} templates")
    hashes = {r["name"]: r["h"] for r in found}
    if None in hashes or len(hashes) < len(found):
        raise ValueError("templates need names, each its own")
    if short := [n for n, h in hashes.items() if len(h) < SHINGLE]:
        raise ValueError(f"templates of fewer than {SHINGLE} words: {', '.join(sorted(short))}")
    return hashes
