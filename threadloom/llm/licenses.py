"""Operator 2: license scans by MinHash bands over overlapping windows, then exact containment.

Words are runs of ASCII letters, digits and non-ASCII bytes, lower-cased; a text's 5-word shingles
are cut into blocks of L shingles, and every two neighbouring blocks are a window. A template of m
shingles is sought in windows of the least L >= m (L a power of two), so an occurrence of it lies whole
in some window, and its Jaccard similarity to that window is at least 0.8 m / (2 L + 0.2 m) > 0.19. With
64 bands of one row the chance that no band agrees is below 0.81^64 = 1.4e-6 for each occurrence.
Each retrieved template is verified exactly: the share of its distinct shingles that the window holds.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from threadloom.llm import words as W
from threadloom.llm.common import mix, text_slices

BANDS, SHINGLE, CONTAINED = 64, 5, 0.8
LEAST_BLOCK = 1

# Notices and grants of public licenses, as their texts state them.
TEMPLATES = (
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
)

FOLD = np.full(256, 0x20, np.uint8)  # every byte that is no part of a word becomes a space
FOLD[0x30:0x3A] = np.arange(0x30, 0x3A)
FOLD[0x41:0x5B] = np.arange(0x61, 0x7B)
FOLD[0x61:0x7B] = np.arange(0x61, 0x7B)
FOLD[0x80:] = np.arange(0x80, 0x100)
SEEDS = mix(np.arange(1, BANDS + 1, dtype=np.uint64) * W.GOLDEN) | np.uint64(1)


def shingles(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shingles of all texts, in order, and the n + 1 bounds of each text's part."""
    folded = FOLD[data]
    start, end, at = W.word_spans(folded, off)
    words = W.span_hash(folded, start, end)
    n = np.maximum(np.diff(at) - SHINGLE + 1, 0)
    every = W.window_hash(words, SHINGLE)
    bounds = np.concatenate([[0], np.cumsum(n)])
    take = np.repeat(at[:-1] - bounds[:-1], n) + np.arange(bounds[-1])
    return every[take], bounds


def _compile(templates) -> dict[int, list[tuple[str, np.ndarray, np.ndarray]]]:
    """Templates by block length: name, distinct shingles, and the signature of the shingles."""
    by_block: dict[int, list] = {}
    for name, text in templates:
        raw = np.frombuffer(text.encode(), np.uint8)
        own = np.unique(shingles(raw, np.array([0, len(raw)]))[0])
        if not len(own):
            raise ValueError(f"template {name} has fewer than {SHINGLE} words")
        block = max(LEAST_BLOCK, 1 << (len(own) - 1).bit_length())
        by_block.setdefault(block, []).append((name, own, (own[None, :] * SEEDS[:, None]).min(1)))
    return by_block


def find(data: np.ndarray, off: np.ndarray, by_block) -> list[tuple[int, str, int, int, float]]:
    """(text, template, first shingle, last shingle + 1, containment) of every verified window."""
    every, bounds = shingles(data, off)
    if not len(every):
        return []
    found = []
    size = np.diff(bounds)
    block, n_blocks = 1, size
    # a block of one shingle is its own minimum in every band, so one band is all of them
    mins = [every * SEEDS[0]]
    for length in sorted(by_block):
        if length > 1 and len(mins) == 1:
            mins = [every * s for s in SEEDS]
        while block < length:
            step = length if block == 1 else 2
            new = -(-n_blocks // step)
            first = np.concatenate([[0], np.cumsum(n_blocks)])[:-1]
            base = np.concatenate([[0], np.cumsum(new)])
            cut = np.repeat(first - step * base[:-1], new) + step * np.arange(base[-1])
            mins = [np.minimum.reduceat(m, cut) for m in mins]
            block, n_blocks = step * block, new
        text = np.repeat(np.arange(len(size)), n_blocks)
        paired = np.append(text[1:] == text[:-1], False)
        nth = np.arange(len(text)) - np.repeat(np.cumsum(n_blocks) - n_blocks, n_blocks)
        for name, own, sign in by_block[length]:
            hit = np.zeros(len(text), bool)
            for least, own_least in zip(mins, sign):
                hit |= least == own_least
            # a window is a block and the next; it collides when either of its blocks has the least value
            hit[:-1] |= hit[1:] & paired[:-1]
            for w in np.flatnonzero(hit):
                t = int(text[w])
                lo = int(bounds[t] + nth[w] * length)
                hi = int(min(bounds[t + 1], lo + 2 * length))
                inside = np.isin(own, every[lo:hi])
                share = float(inside.sum()) / len(own)
                if share >= CONTAINED:
                    at = np.flatnonzero(np.isin(every[lo:hi], own))
                    found.append((t, name, int(lo - bounds[t] + at[0]), int(lo - bounds[t] + at[-1] + 1), share))
    return found


def _scan(templates):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        by_block = _compile(templates)
        for rows, data, off in text_slices(batches, "text", 1 << 20):
            ids = rows.column("doc_id")
            best: dict[tuple[int, str], list] = {}
            for t, name, lo, hi, share in find(data, off, by_block):
                best.setdefault((t, name), []).append((lo, hi, share))
            out = []
            for (t, name), spans in sorted(best.items()):
                merged = []
                for lo, hi, _ in sorted(spans):
                    if merged and lo < merged[-1][1]:
                        merged[-1][1] = max(merged[-1][1], hi)
                    else:
                        merged.append([lo, hi])
                out.append((ids[t].as_py(), name, len(merged), merged[0][0], max(s for _, _, s in spans)))
            cols = list(zip(*out)) if out else [[]] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.float64()))],
                names=["doc_id", "license", "n_matches", "first_word", "containment"])
    return run


def scan_licenses(docs: DataFrame, templates=TEMPLATES) -> DataFrame:
    """One row for each document and license found in its whole text.

    ``templates`` is a short list of (license, text), each text of five words at least; it travels
    with the tasks. Null, empty and short texts give no row; repeated rows give a row each. A license
    with several templates counts once for overlapping matches. No shuffle.
    """
    picked = docs.select(docs["doc_id"].cast("bigint").alias("doc_id"), "text")
    return picked.mapInArrow(_scan(tuple(templates)), "doc_id bigint, license string, n_matches bigint, first_word bigint, containment double")
