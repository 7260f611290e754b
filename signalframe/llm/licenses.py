"""License scan: MinHash bands over overlapping windows find templates, shingles decide.

Texts and templates become words (letters and digits, A-Z lower-cased) and five-word
shingles. A template belongs to the window width that fits into two thirds of it;
its windows at every offset are indexed. A text's windows overlap by half, so one
lies wholly inside any copy of the template. Rows per band and the number of bands
follow from the wanted collision probability at a window similarity. What the bands
retrieve is decided by the exact share of the template's shingles in the text.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import text_of

K = 5
CONTAINED = 0.8
#: A pair of windows this similar collides with at least this probability.
SIMILARITY, COLLISION = 0.5, 0.99
ROWS = 2
#: Shingles of several texts that are searched at a time.
_TOGETHER = 1 << 17

# Opening sentences and notices of public licenses.
TEMPLATES = [
    ("mit-line", "Released under the MIT License."),
    ("apache-2.0-line", "Licensed under the Apache License, Version 2.0."),
    ("gpl-3.0-line", "This work is licensed under the GNU General Public License, version 3."),
    ("cc-by-nc-4.0-line", "Licensed under CC BY-NC 4.0."),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"),
    ("apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version."),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("mpl-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("cc-by-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("unlicense", "This is free and unencumbered software released into the public domain."),
]

_WORD = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 48 <= b <= 57 or 97 <= b <= 122 else 32 for b in range(256))


def band_count(similarity: float = SIMILARITY, collision: float = COLLISION, rows: int = ROWS) -> int:
    """Least number of bands with ``1 - (1 - similarity**rows)**bands >= collision``."""
    return math.ceil(math.log(1 - collision) / math.log(1 - similarity**rows) - 1e-9)


def shingles(text: bytes, k: int = K) -> np.ndarray:
    words = text.translate(_WORD).split()
    digest = xxhash.xxh64_intdigest
    if len(words) <= k:
        return np.array([digest(b" ".join(words))] if words else [], dtype=np.uint64)
    return np.array([digest(s) for s in map(b" ".join, zip(*[words[i:] for i in range(k)]))], dtype=np.uint64)


def width_for(n: int) -> int:
    """Largest power of four that fits into two thirds of ``n`` shingles, at least 1."""
    w = 1
    while 4 * w <= n / 1.5:
        w *= 4
    return w


def _mix(h):
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    return h ^ (h >> np.uint64(33))


_TOP = np.uint64(2**64 - 1)


def _ranked(hashes: np.ndarray, i: int) -> np.ndarray:
    """The i-th order of the shingles: their hashes times an odd number."""
    return hashes * np.uint64(((2 * i + 1) * 0x9E3779B97F4A7C15 | 1) & (2**64 - 1))


def _halved(minima: np.ndarray) -> np.ndarray:
    if len(minima) % 2:
        minima = np.append(minima, _TOP)
    return np.minimum(minima[0::2], minima[1::2])


def window_minima(hashes: np.ndarray, i: int, widths) -> dict[int, np.ndarray]:
    """Per width (a power of two) the least i-th rank of all windows, half a width apart; the last is shorter."""
    block, size, out = _ranked(hashes, i), 1, {}
    for w in sorted(widths):
        while size < w // 2:
            block, size = _halved(block), size * 2
        out[w] = block if w == 1 else np.minimum(block, np.append(block[1:], _TOP))
    return out


def _key(parts, band: int, width: int) -> np.ndarray:
    key = np.full(len(parts[0]), band * 131 + width, dtype=np.uint64)
    for minima in parts:
        key = _mix(key * np.uint64(0x9E3779B97F4A7C15) + minima)
    return key


class Index:
    """Band keys of all templates' windows by band and width, and the templates' shingles."""

    def __init__(self, templates):
        self.names = [name for name, _ in templates]
        self.sets = [np.unique(shingles(text.encode())) for _, text in templates]
        self.bands = band_count()
        parts: dict[tuple[int, int], list] = {}
        for t, (_, text) in enumerate(templates):
            h = shingles(text.encode())
            if not len(h):
                continue
            w = width_for(len(h))
            for b in range(self.bands if w > 1 else 1):
                windows = np.lib.stride_tricks.sliding_window_view
                minima = [windows(_ranked(h, b * ROWS + r), w).min(axis=1) for r in range(ROWS)]
                parts.setdefault((b, w), []).append((_key(minima, b, w), np.full(len(h) - w + 1, t)))
        self.tables = {}
        for at, found in parts.items():
            keys, ids = (np.concatenate(x) for x in zip(*found))
            order = np.argsort(keys, kind="stable")
            self.tables[at] = keys[order], ids[order]
        self.widths = sorted({w for _, w in self.tables})

    def find(self, hashes: np.ndarray, text: np.ndarray) -> set[tuple[int, int]]:
        """(text, template) pairs with a window that shares a band.

        ``text`` numbers the texts the shingles come from, in order. A window over
        two texts stands for both; what it finds by chance is decided later.
        """
        found: set[tuple[int, int]] = set()
        for b in range(self.bands):
            widths = [w for w in self.widths if (b, w) in self.tables]
            minima = [window_minima(hashes, b * ROWS + r, widths) for r in range(ROWS)]
            for w in widths:
                keys, ids = self.tables[b, w]
                key = _key([m[w] for m in minima], b, w)
                lo = np.searchsorted(keys, key)
                hit = np.flatnonzero(keys[np.minimum(lo, len(keys) - 1)] == key)
                for n in hit.tolist():
                    up = np.searchsorted(keys, key[n], side="right")
                    start = n * max(1, w // 2)
                    ends = {int(text[start]), int(text[min(start + w, len(text)) - 1])}
                    found.update((d, int(t)) for d in ends for t in ids[lo[n] : up])
        return found


_SCHEMA = "doc_id long, license string, contained double, first_shingle int, last_shingle int"


def _scan(templates, contained):
    def search(index, held, out):
        sizes = [len(h) for _, h in held]
        if not sum(sizes):
            return
        pairs = index.find(np.concatenate([h for _, h in held]), np.repeat(np.arange(len(held)), sizes))
        for d, t in sorted(pairs):
            (doc_id, hashes), own = held[d], index.sets[t]
            spots = np.flatnonzero(np.isin(hashes, own))
            share = len(np.unique(hashes[spots])) / len(own)
            if share >= contained:
                for c, v in zip(out, (doc_id, index.names[t], share, int(spots[0]), int(spots[-1]))):
                    c.append(v)

    def run(batches):
        index = Index(templates)
        for batch in batches:
            out, held, n = [[] for _ in range(5)], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1).cast(pa.binary()).to_pylist()):
                held.append((doc_id, shingles(text)))
                n += len(held[-1][1])
                if n >= _TOGETHER:
                    search(index, held, out)
                    held, n = [], 0
            search(index, held, out)
            kinds = (pa.int64(), pa.string(), pa.float64(), pa.int32(), pa.int32())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], [c.split()[0] for c in _SCHEMA.split(", ")])

    return run


def scan(docs: DataFrame, templates=None, contained: float = CONTAINED) -> DataFrame:
    """``doc_id, license, contained, first_shingle, last_shingle`` of every match.

    Templates are a short list that goes with the code. A template of fewer than
    five words is one shingle. A null or empty text matches nothing; rows that
    repeat match again; an empty table gives an empty one.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_of().alias("text"))
    return rows.mapInArrow(_scan(list(templates or TEMPLATES), contained), _SCHEMA)
