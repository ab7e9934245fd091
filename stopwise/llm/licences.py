"""Licence scan by sentence rules: normalised sentences become identifiers, sequences of these become licences.

A text is cut into units at line ends and sentence marks. A known sentence may be wrapped over several
units, so units are joined as long as what they make begins a known sentence. The identifiers found, in
order, are matched against the rules, first rule first; a rule may have as many as ``GAP`` unknown units
between two of its sentences.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from stopwise.llm.common import texts

GAP = 2

# Sentences of public licences and of notices that name one, by identifier.
SENTENCES = {
    "mit-name": ["MIT License", "The MIT License (MIT)", "The MIT License", "Released under the MIT License", "Licensed under the MIT License", "This project is licensed under the MIT License", "This software is released under the MIT License"],
    "mit-grant": ["Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions"],
    "mit-notice": ["The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software"],
    "as-is": ["The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement"],
    "mit-liability": ["In no event shall the authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the software or the use or other dealings in the software"],
    "isc-name": ["ISC License", "Licensed under the ISC License"],
    "isc-grant": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies"],
    "isc-disclaimer": ["The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness"],
    "bsd-name": ["BSD License", "Licensed under the BSD License", "Released under the BSD License"],
    "bsd2-name": ["BSD 2-Clause License", "Licensed under the BSD 2-Clause License"],
    "bsd3-name": ["BSD 3-Clause License", "Licensed under the BSD 3-Clause License"],
    "bsd-grant": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "bsd-source": ["Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer"],
    "bsd-binary": ["Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution"],
    "bsd-endorse": ["Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "apache2-name": ["Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0", "Licensed under the Apache License, Version 2.0 (the License)", "Released under the Apache License, Version 2.0", "Released under the Apache License 2.0"],
    "apache2-comply": ["You may not use this file except in compliance with the License"],
    "apache2-copy": ["You may obtain a copy of the License at"],
    "apache2-basis": ["Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an AS IS BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied"],
    "gpl-free": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version"],
    "gpl2-free": ["This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version"],
    "gpl-hope": ["This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE"],
    "gpl-details": ["See the GNU General Public License for more details"],
    "gpl3-name": ["GNU General Public License, version 3", "GNU General Public License v3.0", "This work is licensed under the GNU General Public License, version 3", "Licensed under the GNU General Public License, version 3"],
    "gpl2-name": ["GNU General Public License, version 2", "This work is licensed under the GNU General Public License, version 2", "Licensed under the GNU General Public License, version 2"],
    "lgpl3-name": ["GNU Lesser General Public License, version 3", "Licensed under the GNU Lesser General Public License, version 3"],
    "agpl3-name": ["GNU Affero General Public License, version 3", "Licensed under the GNU Affero General Public License, version 3"],
    "mpl2-form": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0", "Licensed under the Mozilla Public License, version 2.0"],
    "mpl2-copy": ["If a copy of the MPL was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/"],
    "unlicense-public": ["This is free and unencumbered software released into the public domain"],
    "cc0-name": ["CC0 1.0 Universal", "Licensed under CC0 1.0", "Released under CC0 1.0"],
    "cc-by4-name": ["Licensed under CC BY 4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-sa4-name": ["Licensed under CC BY-SA 4.0", "This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License"],
    "cc-by-nc4-name": ["Licensed under CC BY-NC 4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License"],
    "cc-by-nd4-name": ["Licensed under CC BY-ND 4.0"],
    "rights-reserved": ["All rights reserved"],
}

# Ordered rules. The first that fits at a place names the licence; whole texts stand before notices.
RULES = [
    ("MIT", ["mit-name", "mit-grant", "mit-notice", "as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice", "as-is", "mit-liability"]),
    ("MIT", ["mit-grant", "mit-notice"]),
    ("ISC", ["isc-name", "isc-grant", "isc-disclaimer"]),
    ("ISC", ["isc-grant", "isc-disclaimer"]),
    ("BSD-3-Clause", ["bsd-grant", "bsd-source", "bsd-binary", "bsd-endorse"]),
    ("BSD-2-Clause", ["bsd-grant", "bsd-source", "bsd-binary"]),
    ("Apache-2.0", ["apache2-name", "apache2-comply", "apache2-copy", "apache2-basis"]),
    ("Apache-2.0", ["apache2-name", "apache2-comply"]),
    ("GPL-3.0-or-later", ["gpl-free", "gpl-hope", "gpl-details"]),
    ("GPL-3.0-or-later", ["gpl-free"]),
    ("GPL-2.0-or-later", ["gpl2-free", "gpl-hope", "gpl-details"]),
    ("GPL-2.0-or-later", ["gpl2-free"]),
    ("MPL-2.0", ["mpl2-form", "mpl2-copy"]),
    ("MIT", ["mit-name"]),
    ("ISC", ["isc-name"]),
    ("BSD-2-Clause", ["bsd2-name"]),
    ("BSD-3-Clause", ["bsd3-name"]),
    ("BSD", ["bsd-name"]),
    ("Apache-2.0", ["apache2-name"]),
    ("GPL-3.0", ["gpl3-name"]),
    ("GPL-2.0", ["gpl2-name"]),
    ("LGPL-3.0", ["lgpl3-name"]),
    ("AGPL-3.0", ["agpl3-name"]),
    ("MPL-2.0", ["mpl2-form"]),
    ("Unlicense", ["unlicense-public"]),
    ("CC0-1.0", ["cc0-name"]),
    ("CC-BY-4.0", ["cc-by4-name"]),
    ("CC-BY-SA-4.0", ["cc-by-sa4-name"]),
    ("CC-BY-NC-4.0", ["cc-by-nc4-name"]),
    ("CC-BY-ND-4.0", ["cc-by-nd4-name"]),
    ("all-rights-reserved", ["rights-reserved"]),
]

# A line end, or a sentence mark before white space or the end; a mark inside "2.0" or "v. 2" is none.
_CUT = re.compile(r"\r?\n|(?<!\bv)[.;:!?]+(?=\s|$)")
_OTHER = re.compile(r"[^a-z0-9]+")


def normalised(text: str) -> str:
    return _OTHER.sub(" ", text.lower()).strip()


KNOWN = {normalised(s): name for name, forms in SENTENCES.items() for s in forms}
_SORTED = sorted(KNOWN)
# What a unit must begin with to begin a known sentence.
_FIRST = frozenset(s.split(" ", 1)[0] for s in KNOWN)
# Every known sentence has one of these, so a text with none of them has no known sentence.
HINTS = ("licen", "permission", "warrant", "copyright", "redistribut", "reserved", "unencumbered", "liable", "mpl", "cc0")
_HINT = re.compile("|".join(HINTS))


def _begins(text: str) -> bool:
    at = bisect_left(_SORTED, text)
    return at < len(_SORTED) and (_SORTED[at] == text or _SORTED[at].startswith(text + " "))


def units(text: str) -> list[tuple[int, int, str]]:
    """``start, end, normalised`` of what stands between cuts; empty ones are left out."""
    out, at = [], 0
    for cut in [*_CUT.finditer(text), None]:
        end = cut.start() if cut else len(text)
        plain = normalised(text[at:end])
        if plain:
            lead = len(text[at:end]) - len(text[at:end].lstrip())
            out.append((at + lead, end, plain))
        at = cut.end() if cut else end
    return out


def sentences(text: str) -> list[tuple[int, int, int, int, str]]:
    """``start, end, first unit, last unit, identifier`` of the known sentences; the longest at each place."""
    parts, found, k = units(text), [], 0
    while k < len(parts):
        best = None
        if parts[k][2].split(" ", 1)[0] in _FIRST:
            joined, j = parts[k][2], k
            while _begins(joined):
                if joined in KNOWN:
                    best = (parts[k][0], parts[j][1], k, j, KNOWN[joined])
                j += 1
                if j == len(parts):
                    break
                joined += " " + parts[j][2]
        if best:
            found.append(best)
        k = best[3] + 1 if best else k + 1
    return found


def recognised(text: str | None) -> tuple[list[tuple[str, int, int]], int]:
    """Licences as ``name, start, end`` (code points, end exclusive), and the number of known sentences."""
    if not text or not _HINT.search(text.lower()):
        return [], 0
    found, out, k = sentences(text), [], 0
    while k < len(found):
        step = 1
        for name, rule in RULES:
            part = found[k : k + len(rule)]
            if [s[4] for s in part] == rule and all(b[2] - a[3] - 1 <= GAP for a, b in zip(part, part[1:])):
                out.append((name, part[0][0], part[-1][1]))
                step = len(rule)
                break
        k += step
    return out, len(found)


def scan_licences(docs: DataFrame) -> DataFrame:
    """``doc_id, licences (licence, start, end), n_sentences`` for every row of ``docs``.

    Places are code points of the whole text, end exclusive. A null or empty text has none; a known
    sentence that no rule takes up counts in ``n_sentences`` only; repeated rows are scanned each.
    """

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        span = pa.list_(pa.struct([("licence", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))
        for batch in batches:
            seen = [recognised(t.as_py()) for t in batch.column(1)]
            made = [[{"licence": n, "start": a, "end": b} for n, a, b in s[0]] for s in seen]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(made, span), pa.array([s[1] for s in seen], pa.int64())],
                ["doc_id", "licences", "n_sentences"],
            )

    return texts(docs).mapInArrow(
        scan, "doc_id long, licences array<struct<licence:string,start:int,end:int>>, n_sentences long"
    )


def digest(found: DataFrame) -> DataFrame:
    each = F.transform("licences", lambda s: F.concat_ws(":", s["licence"], s["start"], s["end"]))
    return found.select(
        "doc_id",
        "n_sentences",
        F.size("licences").cast("long").alias("n_licences"),
        F.array_join(F.array_sort(F.array_distinct("licences.licence")), ",").alias("licences"),
        F.array_join(each, ",").alias("spans"),
    )
