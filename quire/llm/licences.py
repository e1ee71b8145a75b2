"""Licence scans by a trained paragraph classifier.

Paragraphs (lines) are read in windows of words, and so are runs of lines, for notices that are wrapped. Sparse word n-grams of a window feed a multinomial logistic
regression over licence families and an unknown class, which decides: a family is found where its calibrated probability passes
the least one that held-out unknown windows don't reach. Comparison with the family's template phrases then confirms it: a share of what tells one
of them from other families' phrases must be in the window. Phrases of one family share most words with others (versions of
the GNU licences, Creative Commons terms), so comparison alone names several; what it doesn't confirm is counted apart.

The model is trained here, on the template phrases and on other wordings of each family's names, varied at random under a fixed
seed, and for the unknown class on near misses and windows of a bounded sample of the corpus (`Setup.sample` texts of least hash, of
each its first `Setup.sample_chars`). Temperature and least probability come from a model that knows neither the wordings nor
the near misses that they are fitted on (`Model.report` says how it fares there); the model in use has seen all. Everything else covers every paragraph of every text.

Defined cases: a null text is an empty one and has no licence; repeated rows are scanned each; an empty table gives an
empty result, and then the unknown class is trained from near misses alone. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from quire.llm import common

_WORD = re.compile(r"[^\W_]+(?:[.'-][^\W_]+)*")

# Phrases by which licence texts and notices are known.
TEMPLATES = {
    "apache-2.0": [
        "Licensed under the Apache License, Version 2.0",
        "Released under the Apache License, Version 2.0",
        "you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "SPDX-License-Identifier: Apache-2.0",
    ],
    "mit": [
        "Released under the MIT License",
        "Licensed under the MIT License",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files",
        "to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense",
        "SPDX-License-Identifier: MIT",
    ],
    "bsd": [
        "Licensed under the BSD License",
        "Released under the BSD 3-Clause License",
        "Released under the BSD 2-Clause License",
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
        "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software",
        "SPDX-License-Identifier: BSD-3-Clause",
    ],
    "gpl-3.0": [
        "This work is licensed under the GNU General Public License, version 3",
        "Licensed under the GNU General Public License v3.0",
        "under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License",
        "SPDX-License-Identifier: GPL-3.0-or-later",
    ],
    "gpl-2.0": [
        "This work is licensed under the GNU General Public License, version 2",
        "Licensed under the GNU General Public License v2.0",
        "under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License",
        "SPDX-License-Identifier: GPL-2.0-only",
    ],
    "lgpl": [
        "This work is licensed under the GNU Lesser General Public License",
        "under the terms of the GNU Lesser General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: LGPL-2.1-or-later",
    ],
    "agpl-3.0": [
        "This work is licensed under the GNU Affero General Public License, version 3",
        "under the terms of the GNU Affero General Public License as published by the Free Software Foundation",
        "SPDX-License-Identifier: AGPL-3.0-only",
    ],
    "mpl-2.0": [
        "Licensed under the Mozilla Public License, Version 2.0",
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
        "SPDX-License-Identifier: MPL-2.0",
    ],
    "cc-by": [
        "Licensed under CC BY 4.0",
        "This work is licensed under a Creative Commons Attribution 4.0 International License",
        "SPDX-License-Identifier: CC-BY-4.0",
    ],
    "cc-by-sa": [
        "Licensed under CC BY-SA 4.0",
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License",
        "SPDX-License-Identifier: CC-BY-SA-4.0",
    ],
    "cc-by-nc": [
        "Licensed under CC BY-NC 4.0",
        "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License",
        "SPDX-License-Identifier: CC-BY-NC-4.0",
    ],
    "cc0": [
        "Licensed under CC0 1.0 Universal",
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work",
        "SPDX-License-Identifier: CC0-1.0",
    ],
    "isc": [
        "Licensed under the ISC License",
        "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted",
        "SPDX-License-Identifier: ISC",
    ],
    "unlicense": [
        "Released under the Unlicense",
        "This is free and unencumbered software released into the public domain",
        "SPDX-License-Identifier: Unlicense",
    ],
}
# How else licences are named, and how notices put it. The last name and every fourth sentence are what calibration holds out.
NAMES = {
    "apache-2.0": ["the Apache License, Version 2.0", "the Apache 2.0 license", "the Apache Software License 2.0", "Apache License v2"],
    "mit": ["the MIT License", "the MIT licence", "the permissive MIT license", "the MIT (Expat) license"],
    "bsd": ["the BSD License", "the 3-clause BSD license", "the 2-clause BSD license", "the New BSD License"],
    "gpl-3.0": ["the GNU General Public License, version 3", "the GNU GPL v3", "GPLv3", "the GPL version 3"],
    "gpl-2.0": ["the GNU General Public License, version 2", "the GNU GPL v2", "GPLv2", "the GPL version 2"],
    "lgpl": ["the GNU Lesser General Public License", "the GNU LGPL", "the LGPL", "the Lesser GPL"],
    "agpl-3.0": ["the GNU Affero General Public License", "the GNU AGPL", "the AGPL", "the Affero GPL"],
    "mpl-2.0": ["the Mozilla Public License 2.0", "the Mozilla Public License, v. 2.0", "the MPL 2.0", "Mozilla's public license"],
    "cc-by": ["CC BY 4.0", "the Creative Commons Attribution 4.0 license", "Creative Commons Attribution", "a Creative Commons BY license"],
    "cc-by-sa": ["CC BY-SA 4.0", "the Creative Commons Attribution-ShareAlike 4.0 license", "Creative Commons Attribution-ShareAlike", "a Creative Commons BY-SA license"],
    "cc-by-nc": ["CC BY-NC 4.0", "the Creative Commons Attribution-NonCommercial 4.0 license", "Creative Commons Attribution-NonCommercial", "a Creative Commons BY-NC license"],
    "cc0": ["CC0 1.0 Universal", "CC0", "the CC0 public domain dedication", "Creative Commons Zero (CC0)"],
    "isc": ["the ISC License", "the ISC licence", "the simple ISC license", "the ISC terms"],
    "unlicense": ["the Unlicense", "The Unlicense (public domain)", "the terms of the Unlicense", "Unlicense"],
}
SENTENCES = [
    "Licensed under {}", "Released under {}", "This work is licensed under {}", "This project is distributed under the terms of {}", "The code in this repository is made available under {}", "{} applies to all files here",
    "You may copy and modify it under {}", "Published under {}, see the file COPYING", "Its use is governed by {}", "License: {}", "Covered by {}; see LICENSE for details", "Everything in this folder falls under {}",
]
# What speaks of licences and names none.
NEAR_MISSES = [
    "All rights reserved", "Copyright 2020 by the authors", "The driver must carry a valid licence at all times", "A licence fee is due for each public performance of this work",
    "The licence agreement between the parties ends in version two of the contract", "Permission to enter the building is granted by the porter", "The general public is not admitted to the foundation",
    "Apache helicopters were seen over the city", "She studied at MIT and released her second record there", "Use of this software is subject to the terms of a commercial license",
    "No part of this publication may be reproduced without prior permission", "The conditions are met under which a license may be published", "Free software was discussed at the conference",
    "This file is provided as is without warranty of any kind", "The work is in the collection of the museum", "Licensed premises must close at midnight", "Version 2.0 has been released",
    "You may obtain a copy of the form at the desk", "This work was published in version 3 of the series", "Creative people and the commons they share", "Distributed under a proprietary license",
]
UNKNOWN = "unknown"


@dataclass(frozen=True)
class Setup:
    #: Texts whose windows stand for the unknown class, those of least hash: a fixed bound, whatever the corpus.
    sample: int = 400
    sample_chars: int = 20_000
    sample_windows: int = 3000
    window: int = 40
    stride: int = 20
    #: Examples made of a template phrase or near miss, and of another wording.
    variants: int = 12
    wordings: int = 2
    #: Share of what tells a template phrase (its words and word pairs, each by how few families have it) that must be in the window.
    overlap: float = 0.45
    penalty: float = 1e-3
    steps: int = 200
    seed: int = 7


def words_of(text: str) -> list[str]:
    return _WORD.findall(text.lower())


def grams(words: list[str]) -> set[str]:
    return {" ".join(words[i : i + n]) for n in (1, 2, 3) for i in range(len(words) - n + 1)}


def windows(n: int, setup: Setup) -> list[tuple[int, int]]:
    """Word ranges that cover n words; every run of `stride` words lies whole in one of them."""
    if n <= setup.window:
        return [(0, n)] if n else []
    return [(s, min(n, s + setup.window)) for s in range(0, n - setup.window + setup.stride, setup.stride)]


class Model:
    """Weights of n-grams for each family, the unknown class last, and what calibrates them."""

    def __init__(self, families: list[str], weights: dict[str, np.ndarray], bias: np.ndarray, temperature: float, least: float, setup: Setup, report: dict[str, float]) -> None:
        self.families, self.weights, self.bias, self.temperature, self.least, self.setup, self.report = families, weights, bias, temperature, least, setup, report
        # each template phrase as its word pairs, and as what its words and pairs tell, by the number of families that have them
        units = {f: [{*w, *zip(w, w[1:], strict=False)} for w in map(words_of, TEMPLATES[f])] for f in families}
        held = Counter(u for f in families for u in set().union(*units[f]))
        self.phrases = {f: [({x for x in t if isinstance(x, tuple)}, {x: float(np.log((1 + len(families)) / held[x])) for x in t}) for t in units[f]] for f in families}
        # the most that a word, pair or triple adds to any family's lead over unknown; words of none of them add nothing
        self.leads = {tuple(g.split(" ")): max(0.0, float((w[:-1] - w[-1]).max())) for g, w in weights.items()}
        self.known = {w: self.leads.get((w,), 0.0) for g in self.leads for w in g}
        # below this sum no family can reach the least probability
        self.need = temperature * float(np.log(least / (1 - least))) - float((bias[:-1] - bias[-1]).max())

    def logits(self, words: list[str]) -> np.ndarray:
        out = self.bias.copy()
        for g in self.grams(words):
            w = self.weights.get(g)
            if w is not None:
                out += w
        return out

    def grams(self, words: list[str]) -> set[str]:
        """The n-grams of words that may have weights: those all of whose words are in some."""
        out, known, n = set(), self.known, len(words)
        for i, w in enumerate(words):
            if w in known:
                out.add(w)
                if i + 1 < n and words[i + 1] in known:
                    pair = f"{w} {words[i + 1]}"
                    out.add(pair)
                    if i + 2 < n and words[i + 2] in known:
                        out.add(f"{pair} {words[i + 2]}")
        return out

    def gains(self, words: list[str], before: tuple[str, ...] = ()) -> list[float]:
        """For each word, the most that it and the pair and triple that it ends add to a lead; `before`: the two words before. Their sum bounds a window's lead."""
        out, known, leads = [], self.known, self.leads
        p, q = (before[-1] if before and before[-1] in known else None), (before[-2] if len(before) > 1 and before[-2] in known else None)
        for w in words:
            gain = known.get(w)
            if gain is None:
                out.append(0.0)
                p = None
                continue
            if p is not None:
                gain += leads.get((p, w), 0.0)
                if q is not None:
                    gain += leads.get((q, p, w), 0.0)
            out.append(gain)
            q, p = p, w
        return out

    def probabilities(self, words: list[str]) -> np.ndarray:
        x = self.logits(words) / self.temperature
        x = np.exp(x - x.max())
        return x / x.sum()

    def family(self, words: list[str]) -> tuple[str, float, bool]:
        """The family of a window (unknown below the least probability), its probability, and whether a template confirms it."""
        p = self.probabilities(words)
        k = int(p[:-1].argmax())
        if p[k] < self.least:
            return UNKNOWN, float(p[-1]), False
        return self.families[k], float(p[k]), any(self.alike(tells, words) for _, tells in self.phrases[self.families[k]])

    def alike(self, tells: dict, words: list[str]) -> bool:
        """Whether words have the share of a template phrase that confirms it."""
        here = {*words, *zip(words, words[1:], strict=False)}
        return sum(w for x, w in tells.items() if x in here) >= self.setup.overlap * sum(tells.values())

    def runs(self, k: int, words: list[str], pairs: list[tuple[str, str]], taken: set[int]) -> list[tuple[int, int, set[int]]]:
        """For each template of family k that a window's words confirm, the longest first: first and last word of the shortest run
        with all its pairs that are there, and their places. Half of these pairs must have places that aren't taken."""
        out = []
        for t, tells in self.phrases[self.families[k]]:
            places = [n for n, x in enumerate(pairs) if x in t]
            kinds = {pairs[n] for n in places}
            own = {pairs[n] for n in places if n not in taken} if taken else kinds
            if not kinds or len(own) < 0.5 * len(kinds) or not self.alike(tells, words):
                continue
            count, lo, best = {}, 0, (0, len(pairs))
            for n in places:
                count[pairs[n]] = count.get(pairs[n], 0) + 1
                while count[pairs[places[lo]]] > 1:
                    count[pairs[places[lo]]] -= 1
                    lo += 1
                if len(count) == len(kinds) and n + 1 - places[lo] < best[1] - best[0]:
                    best = places[lo], n + 1
            out.append((*best, {n for n in places if best[0] <= n < best[1]}))
        return sorted(out, key=lambda x: x[0] - x[1])

    def _alone(self, k: int, words: list[str]) -> bool:
        p = self.probabilities(words)
        return int(p[:-1].argmax()) == k and p[k] >= self.least

    def licences(self, words: list[str]) -> tuple[list[tuple[str, int, int]], bool]:
        """(family, first, last word) of each family that a window names, and whether it seems to name one that no template confirms.

        Every family is tried whose odds against unknown reach the least probability. The likeliest needs a template, if it has that
        probability among all families too; any other must be the family of its template's run by itself, or of what other runs leave.
        """
        x = self.logits(words) / self.temperature
        likely = [k for k in np.argsort(-x[:-1], kind="stable").tolist() if x[k] - x[-1] >= np.log(self.least / (1 - self.least))]
        if not likely:
            return [], False
        p = np.exp(x - x.max())
        pairs = list(zip(words, words[1:], strict=False))
        sure: dict[int, tuple[int, int]] = {}
        taken: set[int] = set()
        for again in (False, True):
            for k in likely:
                for a, b, places in [] if k in sure else self.runs(k, words, pairs, taken):
                    if again:
                        good = bool(taken) and self._alone(k, [w for n, w in enumerate(words) if n not in taken and n - 1 not in taken])
                    else:
                        good = k == likely[0] and p[k] >= self.least * p.sum() or self._alone(k, words[max(0, a - 2) : b + 3])
                    if good:
                        sure[k] = a, b
                        taken |= places
                        break
        return [(self.families[k], a, b) for k, (a, b) in sure.items()], not sure

    def scan(self, text: str) -> tuple[int, int, list[tuple[int, int, str]]]:
        """Paragraphs (lines) with a word, windows that no template confirms, and (start, end, family) of each licence paragraph or run of lines."""
        n = doubtful = at = 0
        found: list[tuple[int, int, str]] = []
        block: list[tuple[int, int, list[str], list[float]]] = []
        for line in text.split("\n"):
            words = words_of(line)
            if words:
                n += 1
                last = tuple((block[-2][2] if len(block) > 1 else [])[-1:] + block[-1][2][-2:]) if block else ()
                block.append((at, at + len(line), words, self.gains(words, last)))
            elif block:
                doubtful += self._block(block, found)
                block = []
            at += len(line) + 1
        if block:
            doubtful += self._block(block, found)
        return n, doubtful, sorted(found)

    def _block(self, block: list[tuple[int, int, list[str], list[float]]], found: list[tuple[int, int, str]]) -> int:
        """Adds what lines between two without a word name, each by itself and then windows across their ends; the number of windows that nothing confirms."""
        need, setup = self.need, self.setup
        alone: list[tuple[str, int, int, int]] = []  # family, line, first and last word in the block
        unsure, first = [0] * len(block), 0
        for i, (_, _, words, gain) in enumerate(block):
            if sum(gain) >= need:
                for s, e in windows(len(words), setup):
                    if sum(gain[s:e]) >= need:
                        sure, doubt = self.licences(words[s:e])
                        alone += [(f, i, first + s + a, first + s + b) for f, a, b in sure]
                        unsure[i] += doubt
            first += len(words)
        across, more, told = [], 0, {i for _, i, *_ in alone}
        if len(block) > 1:
            upto = [0.0, *accumulate(chain.from_iterable(b[3] for b in block))]
            words: list[str] = []
            for s, e in windows(len(upto) - 1, setup):
                if upto[e] - upto[s] >= need - 1e-6:
                    if not words:
                        words, owner = [w for b in block for w in b[2]], [i for i, b in enumerate(block) for _ in b[2]]
                    if owner[s] != owner[e - 1]:
                        sure, doubt = self.licences(words[s:e])
                        more += doubt and not any(unsure[i] or i in told for i in range(owner[s], owner[e - 1] + 1))
                        got = [(f, s + a, s + b) for f, a, b in sure]
                        # a run of the window before that starts in this one is decided here, where more of what follows it stands
                        across = [x for x in across if x[1] < s or not any(a <= x[2] and x[1] <= b for _, a, b in got)] + got
        named = {(f, i) for f, i, a, b in alone if not any(c <= a and b <= d for _, c, d in across) or any(f == g and c <= b and a <= d for g, c, d in across)}
        spans: dict[str, list[list[int]]] = {}
        for f, a, b in sorted(across, key=lambda x: x[1]):
            i, j = owner[a], owner[b]
            if not any((f, x) in named for x in range(i, j + 1)):
                own = spans.setdefault(f, [])
                if own and i <= own[-1][1]:
                    own[-1][1] = max(j, own[-1][1])
                else:
                    own.append([i, j])
            unsure[i : j + 1] = [0] * (j + 1 - i)
        found += [(block[i][0], block[i][1], f) for f, i in named]
        found += [(block[i][0], block[j][1], f) for f, own in spans.items() for i, j in own]
        return sum(unsure) + more


def _varied(rng: np.random.Generator, base: list[str], corpus: list[list[str]], setup: Setup) -> list[str]:
    """A phrase with words left out, cut at the ends and set among other words."""
    w = list(base)
    if len(w) > 7:
        w = [x for x in w if rng.random() > 0.08]
    if len(w) > 20 and rng.random() < 0.5:
        cut = int(rng.integers(0, len(w) // 4))
        w = w[cut:] if rng.random() < 0.5 else w[: len(w) - cut]
    if corpus and rng.random() < 0.6:
        other = corpus[int(rng.integers(len(corpus)))]
        m = int(rng.integers(0, max(1, min(len(other), setup.window - len(w))) + 1))
        w = other[:m] + w if rng.random() < 0.5 else w + other[:m]
    return w[: setup.window + 10]


def _examples(rng: np.random.Generator, corpus: list[list[str]], setup: Setup) -> list[tuple[str, list[str], bool]]:
    """(family, words, whether calibration holds it out). All variants of a wording, near miss or window fall on the same side."""
    out = []

    def add(family: str, phrase: str, held: bool, times: int) -> None:
        base = words_of(phrase)
        out.append((family, base, held))
        out.extend((family, _varied(rng, base, corpus, setup), held) for _ in range(times - 1))

    for family in TEMPLATES:
        for phrase in TEMPLATES[family]:
            add(family, phrase, False, setup.variants)
        for n, name in enumerate(NAMES[family]):
            for k, sentence in enumerate(SENTENCES):
                add(family, sentence.format(name), n == len(NAMES[family]) - 1 or k % 4 == 3, setup.wordings)
    for k, miss in enumerate(NEAR_MISSES):
        add(UNKNOWN, miss, k % 4 == 3, setup.variants)
    loose = [w for f in TEMPLATES for phrase in TEMPLATES[f] for w in words_of(phrase)]
    for k in range(40 * setup.variants):  # template words out of order name nothing
        out.append((UNKNOWN, [loose[int(i)] for i in rng.integers(0, len(loose), int(rng.integers(2, 20)))], k % 4 == 3))
    return out + [(UNKNOWN, w, k % 4 == 3) for k, w in enumerate(corpus)]


def _fit(x: np.ndarray, label: np.ndarray, classes: int, setup: Setup) -> tuple[np.ndarray, np.ndarray]:
    """Weights and bias by full-batch descent with per-weight step sizes; every class counts alike."""
    y = np.eye(classes, dtype=np.float32)[label]
    weights, bias = np.zeros((x.shape[1], classes), np.float32), np.zeros(classes, np.float32)
    share = (1 / np.maximum(1, np.bincount(label, minlength=classes)))[label].astype(np.float32)[:, None]
    share /= share.sum()
    m = v = mb = vb = 0.0
    for t in range(1, setup.steps + 1):
        z = x @ weights + bias
        z = np.exp(z - z.max(1, keepdims=True))
        d = (z / z.sum(1, keepdims=True) - y) * share
        g, gb = x.T @ d + setup.penalty / (classes - 1) * weights, d.sum(0)
        m, mb, v, vb = 0.9 * m + 0.1 * g, 0.9 * mb + 0.1 * gb, 0.99 * v + 0.01 * g * g, 0.99 * vb + 0.01 * gb * gb
        fix, fix2 = 1 - 0.9**t, 1 - 0.99**t
        weights -= 0.1 * (m / fix) / (np.sqrt(v / fix2) + 1e-8)
        bias -= 0.1 * (mb / fix) / (np.sqrt(vb / fix2) + 1e-8)
    return weights, bias


def _calibrated(z: np.ndarray, truth: np.ndarray, unknown: int) -> tuple[float, float, dict[str, float]]:
    """Temperature and least probability for logits of examples that the model hasn't seen, and how it fares on them."""
    share = (1 / np.bincount(truth, minlength=unknown + 1).clip(1))[truth]
    share /= share.sum()

    def chances(t: float) -> np.ndarray:
        q = np.exp((z - z.max(1, keepdims=True)) / t)
        return q / q.sum(1, keepdims=True)

    temperature = min((0.25 * 1.25**k for k in range(20)), key=lambda t: float(-(share * np.log(chances(t)[np.arange(len(z)), truth] + 1e-12)).sum()))
    p = chances(temperature)
    strange = np.sort(p[truth == unknown, :-1].max(1))
    least = float(min(0.95, max(0.5, strange[int(0.999 * (len(strange) - 1))] if len(strange) else 0.5)))
    sure, right = p.max(1), p.argmax(1) == truth
    bins = np.minimum((sure * 10).astype(int), 9)
    gap = sum(abs((share * (right - sure))[bins == b].sum()) for b in range(10))
    known = truth != unknown
    named = (p[:, :-1].max(1) >= least) & (p[:, :-1].argmax(1) == truth)
    report = {"held_out": len(truth), "accuracy": float((share * right).sum()), "calibration_error": float(gap), "named": float(named[known].mean()), "mistaken_unknown": float((strange >= least).mean()) if len(strange) else 0.0}
    return temperature, least, report


def train(corpus_texts: list[str], setup: Setup = Setup()) -> Model:
    """corpus_texts: the bounded sample for the unknown class; windows that a template phrase fits are left out of it."""
    rng = np.random.default_rng(setup.seed)
    families = list(TEMPLATES)
    pairs = [{*zip(w, w[1:], strict=False)} for f in families for w in map(words_of, [*TEMPLATES[f], *NAMES[f]]) if len(w) > 1]
    corpus: list[list[str]] = []
    for line in (x for t in corpus_texts for x in t.split("\n")):
        words = words_of(line)
        for s, e in windows(len(words), setup) if len(corpus) < setup.sample_windows else []:
            own = {*zip(words[s:e], words[s + 1 : e], strict=False)}
            if not any(len(t & own) >= 0.5 * len(t) for t in pairs):
                corpus.append(words[s:e])
    examples = _examples(rng, corpus, setup)
    vocabulary = {g: i for i, g in enumerate(sorted({g for f in families for t in [*TEMPLATES[f], *NAMES[f]] for g in grams(words_of(t))}))}
    label = np.array([families.index(f) if f != UNKNOWN else len(families) for f, *_ in examples])
    held = np.array([h for *_, h in examples])
    x = np.zeros((len(examples), len(vocabulary)), np.float32)
    for i, (_, w, _) in enumerate(examples):
        x[i, [vocabulary[g] for g in grams(w) if g in vocabulary]] = 1
    weights, bias = _fit(x[~held], label[~held], len(families) + 1, setup)
    temperature, least, report = _calibrated(x[held] @ weights + bias, label[held], len(families))
    weights, bias = _fit(x, label, len(families) + 1, setup)
    kept = {g: weights[i].astype(np.float64) for g, i in vocabulary.items() if np.abs(weights[i]).max() > 1e-6}
    return Model(families, kept, bias.astype(np.float64), temperature, least, setup, report)


def fitted(spark: SparkSession, docs: DataFrame, text: str = "text", setup: Setup = Setup()) -> Model:
    """A model whose unknown class knows the corpus by at most `sample` distinct texts of least hash.

    Their hashes are found first, below a cut that the row count sets; only those texts travel, as few over any corpus.
    """
    hashed = docs.where(F.col(text).isNotNull()).select(F.col(text).alias("t"), F.xxhash64(text).alias("h"))
    share = min(1.0, 8 * setup.sample / max(1, docs.count()))
    near = hashed.where(F.col("h") <= F.lit(int(-(2**63) + share * (2**64 - 1)) if share < 1 else 2**63 - 1))
    least = near.groupBy("h").count().orderBy("h").limit(setup.sample).agg(F.max("h")).first()[0]
    sample = [] if least is None else hashed.where(F.col("h") <= F.lit(least)).groupBy("h").agg(F.min(F.substring("t", 1, setup.sample_chars)).alias("t")).collect()
    return train([r["t"] for r in sorted(sample, key=lambda r: r["h"])], setup)


def scan(spark: SparkSession, docs: DataFrame, model: Model, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, licences (distinct families, in alphabetical order, comma-joined), n_paragraphs, n_licence, n_unconfirmed, spans (family:start:end)."""
    kind = docs.schema[key].dataType.simpleString()
    shared = spark.sparkContext.broadcast(model)  # as large as the templates, whatever the corpus

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for b in common.sliced(batches):
            got = [model.scan(x or "") for x in b.column(1).to_pylist()]
            yield pa.record_batch(
                [
                    b.column(0), pa.array([",".join(sorted({k for *_, k in f})) for *_, f in got], pa.string()), pa.array([n for n, *_ in got], pa.int64()),
                    pa.array([len(f) for *_, f in got], pa.int64()), pa.array([d for _, d, _ in got], pa.int64()), pa.array([",".join(f"{k}:{s}:{e}" for s, e, k in f) for *_, f in got], pa.string()),
                ],
                ["key", "licences", "n_paragraphs", "n_licence", "n_unconfirmed", "spans"],
            )

    got = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).mapInArrow(run, f"key {kind}, licences string, n_paragraphs long, n_licence long, n_unconfirmed long, spans string")
    return got.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = common.read(spark, sf_dir, "documents")
    return scan(spark, docs, fitted(spark, docs))
