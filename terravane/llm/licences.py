"""Licence notices in alert texts: a trained classifier of windows inside paragraphs, confirmed by comparison with templates."""

from __future__ import annotations

import itertools
import random
import re
from collections.abc import Iterator

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from terravane.llm.texts import small_batches, text_of

# Notices by licence family, several wordings each.
TEMPLATES: dict[str, tuple[str, ...]] = {
    "apache": (
        "Licensed under the Apache License, Version 2.0.",
        "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0",
        "Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.",
        "SPDX-License-Identifier: Apache-2.0",
    ),
    "mit": (
        "Released under the MIT License.",
        "This project is licensed under the terms of the MIT license.",
        "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
        "SPDX-License-Identifier: MIT",
    ),
    "gpl": (
        "This work is licensed under the GNU General Public License, version 3.",
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
        "SPDX-License-Identifier: GPL-3.0-or-later", "Licensed under the GPL version 2.",
    ),
    "lgpl": (
        "This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or any later version.",
        "Licensed under the GNU Lesser General Public License, version 3.", "SPDX-License-Identifier: LGPL-2.1-or-later",
    ),
    "agpl": (
        "This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation.",
        "Licensed under the GNU Affero General Public License, version 3.", "SPDX-License-Identifier: AGPL-3.0-only",
    ),
    "bsd": (
        "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer.",
        "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "Licensed under the BSD 3-Clause License.", "SPDX-License-Identifier: BSD-3-Clause",
    ),
    "mpl": (
        "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/.",
        "Licensed under the Mozilla Public License, version 2.0.", "SPDX-License-Identifier: MPL-2.0",
    ),
    "cc-by": (
        "This work is licensed under a Creative Commons Attribution 4.0 International License.", "Licensed under CC BY 4.0.",
        "Except where otherwise noted, content is available under the Creative Commons Attribution License.", "SPDX-License-Identifier: CC-BY-4.0",
    ),
    "cc-by-sa": (
        "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Licensed under CC BY-SA 4.0.",
        "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply.",
    ),
    "cc-by-nc": (
        "Licensed under CC BY-NC 4.0.", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.",
        "Licensed under CC BY-NC-SA 4.0.", "Licensed under CC BY-NC-ND 4.0.",
    ),
    "cc0": (
        "To the extent possible under law, the author has waived all copyright and related or neighboring rights to this work under CC0 1.0 Universal.",
        "This work has been dedicated to the public domain.", "This is free and unencumbered software released into the public domain.",
    ),
    "proprietary": (
        "All rights reserved.", "Copyright (c) 2020 Example Corp. All rights reserved.",
        "No part of this publication may be reproduced, distributed, or transmitted in any form without the prior written permission of the publisher.",
        "Confidential and proprietary. Unauthorized copying of this file, via any medium, is strictly prohibited.",
    ),
}
# Names of the families, and the ways to say in en, de, fr and es that a work is under one.
NAMES: dict[str, tuple[str, ...]] = {
    "apache": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0", "Apache-Lizenz, Version 2.0", "Apache-Lizenz 2.0", "licence Apache, version 2.0", "licence Apache 2.0", "licencia Apache, versión 2.0", "licencia Apache 2.0"),
    "mit": ("MIT License", "MIT licence", "MIT-Lizenz", "licence MIT", "licencia MIT", "Expat license"),
    "gpl": ("GNU General Public License, version 3", "GNU General Public License v2.0", "GNU GPL v3", "GNU GPL version 2", "GPL v2", "GPL v3", "GPLv3", "GPL-3.0-or-later", "GPL-2.0-only", "GNU GPL, Version 3", "licence publique générale GNU, version 3", "licence GPL v3", "licencia pública general de GNU, versión 3", "licencia GPL v2", "GPL-Lizenz, Version 3"),
    "lgpl": ("GNU Lesser General Public License, version 3", "GNU LGPL v2.1", "LGPLv3", "LGPL-2.1-or-later", "LGPL-3.0-only", "licence publique générale limitée GNU", "licencia pública general reducida de GNU", "LGPL-Lizenz"),
    "agpl": ("GNU Affero General Public License, version 3", "GNU AGPL v3", "AGPLv3", "AGPL-3.0-or-later", "AGPL-3.0-only", "licence publique générale GNU Affero", "licencia pública general Affero de GNU", "AGPL-Lizenz"),
    "bsd": ("BSD 3-Clause License", "BSD 2-Clause License", "BSD license", "BSD-3-Clause", "BSD-2-Clause", "BSD-Lizenz", "licence BSD", "licencia BSD", "New BSD License"),
    "mpl": ("Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPL-2.0", "Mozilla-Lizenz 2.0", "licence publique Mozilla, version 2.0", "licencia pública de Mozilla, versión 2.0"),
    "cc-by": ("CC BY 4.0", "CC-BY-4.0", "CC BY 3.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution License", "Creative Commons Namensnennung 4.0 International Lizenz", "licence Creative Commons Attribution 4.0 International", "licencia Creative Commons Atribución 4.0 Internacional", "licencia Creative Commons Reconocimiento 4.0"),
    "cc-by-sa": ("CC BY-SA 4.0", "CC-BY-SA-4.0", "CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike License", "Creative Commons Namensnennung - Weitergabe unter gleichen Bedingungen 4.0", "licence Creative Commons Attribution - Partage dans les mêmes conditions 4.0", "licencia Creative Commons Atribución-CompartirIgual 4.0"),
    "cc-by-nc": ("CC BY-NC 4.0", "CC-BY-NC-4.0", "CC BY-NC-SA 4.0", "CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Namensnennung - Nicht kommerziell 4.0", "licence Creative Commons Attribution - Pas d'utilisation commerciale 4.0", "licencia Creative Commons Atribución-NoComercial 4.0"),
    "cc0": ("CC0 1.0 Universal", "CC0-1.0", "CC0 1.0", "CC0 Public Domain Dedication", "Creative Commons Zero v1.0 Universal", "CC0-Lizenz", "licence CC0", "licencia CC0"),
}
FRAMES = (
    "{}", "{}.", "SPDX-License-Identifier: {}", "License: {}", "Licensed under the {}.", "Released under the {}.", "Distributed under the terms of the {}.", "Published under {}.",
    "This work is licensed under {}.", "Available under the {}.", "Lizenz: {}", "Lizenziert unter der {}.", "Veröffentlicht unter {}.", "Dieses Werk steht unter der {}.",
    "Licence : {}", "Publié sous {}.", "Distribué sous la {}.", "Cette œuvre est mise à disposition sous {}.", "Licencia: {}", "Publicado bajo la {}.", "Distribuido bajo los términos de la {}.",
    "Esta obra está bajo una {}.", "This software is made available under the {}.", "Diese Software steht unter der {}.", "Ce logiciel est distribué sous {}.", "Este software se distribuye bajo la {}.",
)
# Wordings that name no licence, by family.
SAID: dict[str, tuple[str, ...]] = {
    "proprietary": (
        "All rights reserved.", "All rights reserved worldwide.", "Copyright © 2019. All rights reserved.", "Alle Rechte vorbehalten.", "© 2021 Beispiel GmbH. Alle Rechte vorbehalten.", "Sämtliche Rechte vorbehalten.",
        "Urheberrechtlich geschützt. Alle Rechte vorbehalten.", "Nachdruck, auch auszugsweise, nur mit schriftlicher Genehmigung des Verlags.", "Die Vervielfältigung und Verbreitung ist ohne schriftliche Zustimmung nicht gestattet.",
        "Tous droits réservés.", "© 2021 Société Exemple. Tous droits réservés.", "Tous droits de reproduction réservés.", "Toute reproduction, même partielle, est interdite sans autorisation écrite de l'éditeur.",
        "Todos los derechos reservados.", "© 2021 Empresa Ejemplo. Todos los derechos reservados.", "Reservados todos los derechos.", "Prohibida la reproducción total o parcial sin autorización escrita del titular.",
        "Reproduction in whole or in part without written permission is prohibited.", "Copyright 2020 Example Corp.", "Weiterverbreitung ohne Genehmigung nicht gestattet.",
    ),
    "cc0": (
        "Dieses Werk ist gemeinfrei.", "Dieses Werk wurde in die Gemeinfreiheit entlassen.", "Cette œuvre est dans le domaine public.", "Cette œuvre a été placée dans le domaine public.",
        "Esta obra es de dominio público.", "Esta obra ha sido dedicada al dominio público.", "Released into the public domain.",
    ),
}
# Ordinary sentences with words of notices.
ORDINARY = (
    "The driver lost the driving licence last year.", "She has a licence and the right to drive.", "He asked for permission to enter the dam.", "The version of events was disputed.", "All rights of way are closed.", "The library is free and open to the public.",
    "The general public was warned of the storm.", "The pump comes with a warranty of two years.", "A court ruled on human rights and copyright.", "Rain fell in the public park.", "The work is under way at the bridge.", "Published in the news on Monday.",
    "The road is available under certain conditions.", "The terms of the agreement were met.", "Food was distributed under the bridge.", "Attribution of the flood to rain is not certain.", "The village is at 4.0 metres and the gate at 2.0.", "Common land was flooded.",
    "Er fuhr mit dem Wagen unter der Brücke durch.", "Alle Rechte der Anwohner wurden beachtet.", "Das Werk steht unter Wasser.", "Mit der Zeit stieg das Wasser.", "Die Versammlung ist öffentlich.", "Die Lizenz des Fahrers ist abgelaufen.", "Plätze sind vorbehalten, aber frei.",
    "Il a perdu son permis.", "Les droits des habitants sont connus.", "La place est dans le parc public.", "Cette œuvre est au musée.", "Tous les trains sont arrivés.", "La licence du club est chère.", "Il est interdit de passer.", "Places réservées aux familles.",
    "Los derechos de los vecinos se respetan.", "Esta obra está cerrada.", "La plaza es de uso público.", "Todos los trenes llegaron.", "La licencia de obra fue negada.", "Bajo la lluvia, los caminos están cerrados.", "Mesas reservadas para todos.",
)
NONE = "none"
UNKNOWN = "unknown"
BACKGROUND_TEXTS = 2_000
# Calibrated probability below which a notice is of no known family, and the overlap with a template that confirms one.
CERTAIN = 0.6
OVERLAP = 0.5
FIELDS = 1 << 18
TOKEN = re.compile(r"[^\W_]+(?:\.[^\W_]+)*")
# A part is a sentence, as far as it stands on one line; longer ones are cut.  A window is a run of parts.
PART = re.compile(r"\S[^\n]*?(?:[.!?](?=\s)|(?=\n)|\Z)")
PART_WORDS = 24
CUT_WORDS = 4
WINDOW_PARTS = 12
GROUP_WORDS = 100_000


def _words(text: str) -> list[str]:
    return TOKEN.findall(text.lower())


class Hashes(dict):
    """Hash of a word in lower case, remembered."""

    def __missing__(self, word: str) -> int:
        from zlib import crc32

        if len(self) > 500_000:
            self.clear()
        self[word] = code = crc32(word.lower().encode("utf-8", "surrogatepass"))
        return code


def _fields(codes):
    """Fields of single words, and of each word with the one before it."""
    return (codes % FIELDS).astype("int64"), ((codes[:-1] * 31 + codes[1:] * 7 + 1) % FIELDS).astype("int64")


def parts(text: str) -> Iterator[tuple[int, int, list[str], bool, int]]:
    """``start, stop, words, first, at``: parts with words; ``first`` of a paragraph, which ends at a blank line.

    Pieces of a long sentence have its start and stop, and ``at``, their first word in it; ``place`` finds where they are.
    """
    before, first, find = 0, True, TOKEN.findall
    for m in PART.finditer(text):
        a, b = m.span()
        if a - before > 1 and text.count("\n", before, a) > 1:
            first = True
        before = b
        words = find(m.group())
        if len(words) > PART_WORDS:
            # Cut from the end, where a notice behind other words ends.
            for k in range(len(words) % CUT_WORDS or CUT_WORDS, len(words) + 1, CUT_WORDS):
                yield a, b, words[max(0, k - CUT_WORDS) : k], first, max(0, k - CUT_WORDS)
                first = False
        elif words:
            yield a, b, words, first, -1
            first = False


def place(text: str, start: int, stop: int, at: int, n: int) -> tuple[int, int]:
    """Start and stop of a part of ``n`` words in its text."""
    if at < 0:
        return start, stop
    spans = [t.span() for t in TOKEN.finditer(text, start, stop)]
    return spans[at][0] if at else start, stop if at + n == len(spans) else spans[at + n - 1][1]


class Notices:
    """Classifier of windows: softmax over families and 'none', divided by a fitted temperature."""

    def __init__(self, weights, bias, temperature: float, families: list[str]):
        self.weights, self.bias, self.temperature, self.families = weights, bias, temperature, families
        self.templates = {f: [set(_words(t)) for t in ts] for f, ts in wordings().items()}
        self.pairs = {f: [set(zip(w, w[1:])) for w in map(_words, ts)] for f, ts in wordings().items()} | {NONE: []}
        self.hashes, self.known = Hashes(), {}

    def __reduce__(self):
        return Notices, (self.weights, self.bias, self.temperature, self.families)

    def goes_on(self, family: int, words: list[str]) -> bool:
        pairs = set(zip(words, words[1:]))
        return any(len(pairs & t) > 0.7 * len(pairs) for t in self.pairs[self.families[family]])

    def overlap(self, family: str, said: str) -> float:
        """Share of a template in the window or of the window in the template, whichever tells more."""
        if (family, said) not in self.known:
            if len(self.known) > 10_000:
                self.known.clear()
            words = set(_words(said))
            self.known[family, said] = max(len(t & words) / max(1, min(len(t), len(words))) for t in self.templates[family])
        return self.known[family, said]

    def windows(self, codes, starts, paragraph):
        """First part, part behind the last, log-odds of the family, log-odds of a notice, probabilities: every window that the
        classifier takes for a notice.

        All runs of at most WINDOW_PARTS parts inside a paragraph are scored; sums over a run are differences of running sums.
        """
        import numpy as np

        single, pair = _fields(codes)
        z = self.weights[single]
        between = self.weights[pair]
        # A word that only repeats the one before it in its paragraph says nothing.
        again = codes[1:] == codes[:-1]
        again[starts[1:][paragraph[1:] != paragraph[:-1]] - 1] = False
        between[again] = 0
        z[1:][again] = 0
        z[1:] += between
        counts = np.concatenate([[0, 1], 1 + np.cumsum(~again)])
        # The pair across the border in front of a window is not of the window.
        across = np.zeros((len(starts), z.shape[1]))
        across[1:] = between[starts[1:] - 1]
        total = np.zeros((len(starts) + 1, z.shape[1]))
        np.cumsum(np.add.reduceat(z, starts, axis=0, dtype=np.float64), axis=0, out=total[1:])
        behind = total[:-1] + across
        ends = counts[np.append(starts, len(codes))]
        none = self.families.index(NONE)
        for n in range(1, min(WINDOW_PARTS, len(starts)) + 1):
            i = np.flatnonzero(paragraph[: len(starts) - n + 1] == paragraph[n - 1 :])
            if not len(i):
                break
            size = np.maximum(2 * (ends[i + n] - ends[i]) - 1, 1)
            z = (total[i + n] - behind[i]) / np.sqrt(size)[:, None] + self.bias
            taken = z[:, :none].max(1) > z[:, none]
            i, z = i[taken], z[taken] / self.temperature
            p = np.exp(z - z.max(1, keepdims=True))
            p /= p.sum(1, keepdims=True)
            for k in np.flatnonzero(1 - p[:, none] >= CERTAIN):
                against = lambda f: float(np.logaddexp.reduce(np.delete(z[k], f)) - z[k, f])
                yield int(i[k]), int(i[k]) + n, -against(int(z[k].argmax())), against(none), p[k]

    def _found(self, texts, held, codes, starts, paragraph) -> list[list[dict]]:
        import numpy as np

        out: list[list[dict]] = [[] for _ in texts]
        if not codes:
            return out
        where = lambda k: place(texts[held[k][0]], *held[k][1:])
        free = [True] * len(held)
        chosen = []
        found = list(self.windows(np.array(codes, dtype=np.int64), np.array(starts), np.array(paragraph)))
        spans = {(i, j): (notice, p) for i, j, _, notice, p in found}
        # Sure families first, the surest first; then what else of notices is around them, then notices of no family for sure.
        ordered = sorted(found, key=lambda w: (-w[2], w[0], w[1]))
        for sure in (True, False):
            fresh = []
            for i, j, _, _, p in ordered:
                if (p.max() >= CERTAIN) == sure and all(free[i:j]):
                    free[i:j] = [False] * (j - i)
                    fresh.append((i, j))
            for i, j in fresh:
                family, best = spans[i, j][1].argmax(), (spans[i, j][0], i, j)
                for a in range(max(0, j - WINDOW_PARTS), i + 1):
                    for b in range(j, a + WINDOW_PARTS + 1):
                        if (a, b) in spans and spans[a, b][1].argmax() == family and spans[a, b][0] > best[0] and all(free[a:i]) and all(free[j:b]):
                            best = (spans[a, b][0], a, b)
                _, a, b = best
                # Parts around it that go on in the words of one wording of the family belong to it.
                said = lambda k: _words(texts[held[k][0]][slice(*where(k))])
                while a and free[a - 1] and paragraph[a - 1] == paragraph[a] and self.goes_on(family, [*said(a - 1), *said(a)[:1]]):
                    a -= 1
                while b < len(held) and free[b] and paragraph[b] == paragraph[a] and self.goes_on(family, [*said(b - 1)[-1:], *said(b)]):
                    b += 1
                free[a:b] = [False] * (b - a)
                chosen.append((a, b, spans[i, j][1]))
        last = None
        for i, j, p in sorted(chosen, key=lambda w: w[0]):
            row, start, stop = held[i][0], where(i)[0], where(j - 1)[1]
            best = int(p.argmax())
            family = self.families[best]
            overlap = self.overlap(family, texts[row][start:stop])
            if p[best] < CERTAIN or overlap < OVERLAP:
                family = UNKNOWN
            notice = {"family": family, "probability": float(p[best]), "overlap": overlap, "start": start, "stop": stop}
            if last == (i, family, paragraph[i]):
                # A notice longer than a window goes on.
                old = out[row][-1]
                old.update(stop=stop, probability=max(old["probability"], notice["probability"]), overlap=max(old["overlap"], overlap))
            else:
                out[row].append(notice)
            last = (j, family, paragraph[i])
        return out

    def scan(self, texts: list[str]) -> list[list[dict]]:
        """Notices of every text, in order; texts are scored together up to GROUP_WORDS words."""
        out: list[list[dict]] = []
        group, held, codes, starts, paragraph, at = [], [], [], [], [], 0
        code = self.hashes.__getitem__
        for text in texts:
            for a, b, words, first, k in parts(text):
                at += first
                held.append((len(group), a, b, k, len(words)))
                starts.append(len(codes))
                codes += map(code, words)
                paragraph.append(at)
            group.append(text)
            if len(codes) > GROUP_WORDS:
                out += self._found(group, held, codes, starts, paragraph)
                group, held, codes, starts, paragraph = [], [], [], [], []
        return out + self._found(group, held, codes, starts, paragraph)


def wordings() -> dict[str, list[str]]:
    """All wordings by family: templates, names in their frames, and those that name no licence."""
    return {f: [*TEMPLATES[f], *SAID.get(f, ()), *(frame.format(n) for n in NAMES.get(f, ()) for frame in FRAMES)] for f in TEMPLATES}


def train_notices(background: list[str], seed: int = 5, copies: int = 24, steps: int = 200, ridge: float = 1e-3) -> Notices:
    """Multinomial logistic regression on wordings of the templates and on ordinary parts of texts.

    Wordings: whole, with words left out, cut, or set among ordinary words.  A fifth is held back to fit the temperature.
    """
    import numpy as np

    rng = random.Random(seed)
    families = [*TEMPLATES, NONE]
    background = [*background, *ORDINARY]
    pool = [w for b in background for w in b.split()]
    data: list[tuple[str, int]] = []
    texts = wordings()
    for k, f in enumerate(TEMPLATES):
        own = [*TEMPLATES[f], *SAID.get(f, ())]
        for template in [*own * (copies if f != "proprietary" else copies // 2), *texts[f][len(own) :]]:
            words = template.split()
            if len(words) > 5:
                words = [w for w in words if rng.random() > 0.06]
            if len(words) > 12 and rng.random() < 0.6:
                # A piece of a long wording, as hard-wrapped lines have it.
                n = rng.randrange(8, len(words))
                cut = rng.randrange(len(words) - n + 1)
                words = words[cut : cut + n]
            before, after = (rng.randrange(1, 6) if rng.random() < 0.3 else 0 for _ in range(2))
            data.append((" ".join([*rng.choices(pool, k=before), *words, *rng.choices(pool, k=after)]), k))
    own_words = {w for ts in texts.values() for t in ts for w in _words(t)}
    said = [w for ts in texts.values() for t in ts for w in t.split()]
    n = len(data)
    for b in background[: n // 2]:
        words = b.split()
        cut = rng.randrange(len(words)) if rng.random() < 0.5 else 0
        words = words[cut : cut + rng.randrange(1, 40)]
        plain = _words(" ".join(words))
        # What is made of words of notices for the most part may be one, however it is worded.
        if len(plain) < 3 or sum(w in own_words for w in plain) < 0.6 * len(plain):
            data.append((" ".join(words), len(families) - 1))
    data += [(b, len(families) - 1) for b in ORDINARY * 10]
    # Single words of notices, alone or among ordinary text, are no notice.
    data += [(" ".join([*rng.choices(pool, k=rng.randrange(0, 20)), *rng.choices(said, k=rng.randrange(1, 3)), *rng.choices(pool, k=rng.randrange(1, 5))]), len(families) - 1) for _ in range(n // 3)]
    data += [(rng.choice(pool), len(families) - 1) for _ in range(n // 10)]
    whole = {" ".join(_words(t)) for ts in texts.values() for t in ts}
    data += [(w, len(families) - 1) for w in sorted(own_words - whole) * 10]
    data += [(" ".join([*rng.choices(pool, k=rng.randrange(2)), w, *rng.choices(pool, k=rng.randrange(1, 4))]), len(families) - 1) for w in sorted(own_words - whole) * 3]
    rng.shuffle(data)
    hashes = Hashes()
    feats, labels = [], []
    for text, label in data:
        words = [w for w, v in itertools.pairwise(["", *_words(text)][::-1]) if w != v][::-1]
        if words:
            feats.append(np.concatenate(_fields(np.array([hashes[w] for w in words], dtype=np.int64))))
            labels.append(label)
    labels = np.array(labels)
    lens = np.array([len(f) for f in feats])
    idx = np.concatenate(feats)
    row = np.repeat(np.arange(len(feats)), lens)
    # What stands once or twice in ordinary text only has no weight.
    here = (np.bincount(idx, minlength=FIELDS) > 2) | (np.bincount(idx, labels[row] < len(families) - 1, FIELDS) > 0)
    idx, row = idx[here[idx]], row[here[idx]]
    x = 1 / np.sqrt(lens)[row]
    slots, place = np.unique(idx, return_inverse=True)
    held = np.arange(len(feats)) % 5 == 0
    y = np.eye(len(families))[labels]
    w, b = np.zeros((len(slots), len(families))), np.zeros(len(families))
    gw, gb = np.full_like(w, 1e-6), np.full_like(b, 1e-6)

    def scores():
        z = np.zeros((len(feats), len(families)))
        for k in range(len(families)):
            z[:, k] = np.bincount(row, weights=w[place, k] * x, minlength=len(feats))
        return z + b

    for _ in range(steps):
        z = scores()
        p = np.exp(z - z.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - y) * ~held[:, None] / (~held).sum()
        g = np.stack([np.bincount(place, weights=d[row, k] * x, minlength=len(slots)) for k in range(len(families))], 1) + ridge * w / len(families)
        gw += g * g
        gb += d.sum(0) ** 2
        w -= 0.3 * g / np.sqrt(gw)
        b -= 0.3 * d.sum(0) / np.sqrt(gb)
    z = scores()[held]

    def loss(t: float) -> float:
        s = z / t
        return float((np.logaddexp.reduce(s, axis=1) - s[np.arange(len(s)), labels[held]]).mean())

    temperature = min((t / 20 for t in range(6, 61)), key=loss)
    weights = np.zeros((FIELDS, len(families)), dtype=np.float32)
    weights[slots] = w
    return Notices(weights, b.astype(np.float32), temperature, families)


def scan_licences(alerts: DataFrame, background_texts: int = BACKGROUND_TEXTS, alert_id: str = "alert_id", description: str = "description") -> DataFrame:
    """Licence notices in every paragraph of every description.

    A paragraph ends at a blank line; its lines are joined.  Every run of up to WINDOW_PARTS sentences or lines in it is scored,
    nothing is left out beforehand; of overlapping notices the one of the highest odds counts.  Returns one row per row of
    ``alerts``: ``alert_id, notices array<struct<family, probability, overlap, start, stop>>`` in code points, in order of the
    text; 'unknown' is a notice of no family for sure; neighbours of one family in a paragraph are one notice.  The classifier
    learns from the fixed wordings and from paragraphs of about ``background_texts`` alerts, chosen by a hash.
    NULL and empty texts have no notices; repeated rows get equal ones; an empty table gives an empty table; other
    columns are ignored.
    """
    import pyarrow as pa

    small_batches(alerts.sparkSession)
    base = alerts.select(F.col(alert_id).alias("alert_id"), text_of(description).alias("description"))
    # One paragraph of at most 400 characters per chosen text: the list that reaches the driver is bounded.
    n = base.count()
    chosen = base.filter(F.pmod(F.xxhash64("description"), F.lit(1_000_000)) < int(1_000_000 * min(1.0, background_texts / max(n, 1))))
    lines = chosen.select(F.explode(F.slice(F.split("description", "\n"), 1, 3)).alias("line")).filter("length(line) > 20").select(
        F.substring("line", 1, 400).alias("line")).distinct().orderBy(F.xxhash64("line")).limit(3 * background_texts)
    model = train_notices(sorted(r["line"] for r in lines.collect()))
    shared = alerts.sparkSession.sparkContext.broadcast(model)
    kind = pa.list_(pa.struct([("family", pa.string()), ("probability", pa.float64()), ("overlap", pa.float64()), ("start", pa.int64()), ("stop", pa.int64())]))

    def scanned(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        for batch in batches:
            rows = model.scan(batch.column("description").to_pylist())
            yield pa.RecordBatch.from_arrays([batch.column("alert_id"), pa.array(rows, kind)], ["alert_id", "notices"])

    id_kind = base.schema["alert_id"].dataType.simpleString()
    return base.mapInArrow(scanned, f"alert_id {id_kind}, notices array<struct<family:string,probability:double,overlap:double,start:bigint,stop:bigint>>")
