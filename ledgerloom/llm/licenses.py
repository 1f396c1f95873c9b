"""License scan: MinHash bands over overlapping windows, then exact containment; native expressions only.

A text's words (lower-cased runs of letters and digits) make 5-word shingles, which
are hashed once, word by word, without being joined.  Windows of 4, 16 or 64 shingles overlap by half.  A window's MinHash
signature is made by one permutation: the least hash in each bin of hash space, each
bin a band of one row; small windows have more bins, as they hold fewer hashes to choose from.  A template belongs to the least window size that holds
it; one of more shingles than the largest window is cut into parts of that size, so
license texts of any length can be looked for.  A window retrieves a template if one
band of one of its parts collides.

Guarantee: a band collides if no other shingle of the window lies in the bin of one
that both have, and below it; of a window of n shingles that holds one of them, n - 1 others do
with a probability of (n - 1) / (2 bins) at most: 0.002 % in windows of 4, 3 % in those of 16,
49 % in those of 64.  Templates are over a quarter of their window (or a window's size, in
which case some window holds at least three quarters of the part), so those of 5 to 16
shingles miss with less than 0.03 ** 4 and larger ones with less than 0.5 ** 13 if they are whole.  Tests
measure the recall of damaged templates that brute force finds: 0.99 and more.

Templates found are verified by the share of their shingles, as strings, that the
text holds.  Everything is array expressions inside a row: no shuffle and no explosion.
The templates are data: one row, read by a scalar subquery, with a bit map of the bands'
values, so the plan doesn't grow with the list; the row is bounded by ``MOST_BANDS``
values, and longer lists are scanned a part of the list at a time.

Defined results: a null text, or one under five words, holds no template; a template
counts once a text however often it occurs; repeated rows and rows with null keys are
scanned each; an empty table gives no rows; a text of any length is scanned whole in
its row; other columns are kept, whatever their names (but ``_l_...``, which is this
module's).
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

SHINGLE, SIZES, CONTAINED = 5, (4, 16, 64), 0.8
#: Bins by window size, told by a hash's first so many bits.
BIN_BITS = {4: 16, 16: 8, 64: 6}
#: Band values of the templates that are looked for in one scan.
MOST_BANDS = 1 << 16
#: Seed of ``F.xxhash64``.
SEED = 42

#: Notices, headers and texts of common licenses, in their published words.
TEMPLATES = {
    "apache-2.0": "Licensed under the Apache License, Version 2.0",
    "apache-2.0-header": "you may not use this file except in compliance with the License. You may obtain a copy of the License at",
    "bsd-conditions": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met",
    "bsd-3-clause-text": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met: 1. Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. 2. Redistributions in binary form must reproduce the above copyright notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution. 3. Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission. THIS SOFTWARE IS PROVIDED BY THE COPYRIGHT HOLDERS AND CONTRIBUTORS \"AS IS\" AND ANY EXPRESS OR IMPLIED WARRANTIES, INCLUDING, BUT NOT LIMITED TO, THE IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS FOR A PARTICULAR PURPOSE ARE DISCLAIMED. IN NO EVENT SHALL THE COPYRIGHT HOLDER OR CONTRIBUTORS BE LIABLE FOR ANY DIRECT, INDIRECT, INCIDENTAL, SPECIAL, EXEMPLARY, OR CONSEQUENTIAL DAMAGES (INCLUDING, BUT NOT LIMITED TO, PROCUREMENT OF SUBSTITUTE GOODS OR SERVICES; LOSS OF USE, DATA, OR PROFITS; OR BUSINESS INTERRUPTION) HOWEVER CAUSED AND ON ANY THEORY OF LIABILITY, WHETHER IN CONTRACT, STRICT LIABILITY, OR TORT (INCLUDING NEGLIGENCE OR OTHERWISE) ARISING IN ANY WAY OUT OF THE USE OF THIS SOFTWARE, EVEN IF ADVISED OF THE POSSIBILITY OF SUCH DAMAGE.",
    "cc-by-4.0": "Licensed under CC BY 4.0",
    "cc-by-nc-4.0": "Licensed under CC BY-NC 4.0",
    "cc-by-sa-4.0": "Licensed under CC BY-SA 4.0",
    "gpl-3.0": "This work is licensed under the GNU General Public License, version 3",
    "gpl-3.0-header": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.",
    "isc-text": "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies. THE SOFTWARE IS PROVIDED \"AS IS\" AND THE AUTHOR DISCLAIMS ALL WARRANTIES WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF MERCHANTABILITY AND FITNESS. IN NO EVENT SHALL THE AUTHOR BE LIABLE FOR ANY SPECIAL, DIRECT, INDIRECT, OR CONSEQUENTIAL DAMAGES OR ANY DAMAGES WHATSOEVER RESULTING FROM LOSS OF USE, DATA OR PROFITS, WHETHER IN AN ACTION OF CONTRACT, NEGLIGENCE OR OTHER TORTIOUS ACTION, ARISING OUT OF OR IN CONNECTION WITH THE USE OR PERFORMANCE OF THIS SOFTWARE.",
    "mit": "Released under the MIT License",
    "mit-permission": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software",
    "mit-text": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY, FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION OF CONTRACT, TORT OR OTHERWISE, ARISING FROM, OUT OF OR IN CONNECTION WITH THE SOFTWARE OR THE USE OR OTHER DEALINGS IN THE SOFTWARE.",
    "mpl-2.0": "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0",
}

def normal_words(text: str) -> list[str]:
    import regex

    return [w for w in regex.split(r"[^\p{L}\p{N}]+", text.lower()) if w]


def shingles_of(words: list[str]) -> list[str]:
    return [" ".join(words[i : i + SHINGLE]) for i in range(len(words) - SHINGLE + 1)]


def template_shingles(templates: dict[str, str]) -> dict[str, list[str]]:
    out = {name: list(dict.fromkeys(shingles_of(normal_words(text)))) for name, text in templates.items()}
    if short := [name for name, s in out.items() if not s]:
        raise ValueError(f"templates need {SHINGLE} words at least: {short}")
    return out


def parts_of(shingles: list) -> list[list]:
    """A template's parts, each at most a window of the largest size."""
    size = SIZES[-1]
    starts = [*range(0, max(1, len(shingles) - size + 1), size)]
    return [shingles[s : s + size] for s in starts] + ([shingles[-size:]] if starts[-1] + size < len(shingles) else [])


def size_of(part: list) -> int:
    """The least window that holds a part."""
    return next(n for n in SIZES if n >= len(part))


def bands_of(shingles: list[str]) -> list[int]:
    """The least hash of each bin, signed, as ``_bands`` makes them in Spark."""
    import xxhash

    def chained(shingle: str) -> int:
        """Each word's hash is the seed of the next, as ``F.xxhash64`` takes several columns."""
        h = SEED
        for word in shingle.split(" "):
            h = xxhash.xxh64_intdigest(word.encode(), h)
        return h

    hashes = map(chained, shingles)
    least: dict[int, int] = {}
    for h in sorted(h - (1 << 64) if h >> 63 else h for h in hashes):
        least.setdefault(h >> 64 - BIN_BITS[size_of(shingles)], h)
    return list(least.values())


def _bands(sizes: list[int]) -> str:
    """SQL for the band values of all windows of ``_l_h``."""
    of_size = []
    for n in sizes:
        step = n // 2
        starts = f"sequence(0, greatest(size(_l_h) - {step} - 1, 0), {step})"
        windows = f"transform({starts}, s -> sort_array(slice(_l_h, s + 1, {n})))"
        bin_ = 64 - BIN_BITS[n]
        least = f"filter(a, (x, i) -> i = 0 OR shiftright(x, {bin_}) <> shiftright(get(a, i - 1), {bin_}))"
        of_size.append(f"flatten(transform({windows}, a -> {least}))")
    return f"concat({', '.join(of_size)})"


def _per_shingle(value: str, kind: str) -> str:
    """SQL for an array of a value for each shingle of ``_l_w``, the first word's place being ``i``."""
    return f"CASE WHEN size(_l_w) >= {SHINGLE} THEN transform(sequence(0, size(_l_w) - {SHINGLE}), i -> {value}) ELSE CAST(array() AS array<{kind}>) END"


def scan(df: DataFrame, templates: dict[str, str] | None = None, text_column: str = "text") -> DataFrame:
    """``df`` with ``_l_candidates``, how many templates bands retrieved, and ``_l_matches``: (license, containment), by name."""
    known = template_shingles(templates or TEMPLATES)
    signed = [(name, known[name], [v for part in parts_of(known[name]) for v in bands_of(part)]) for name in sorted(known)]
    lists, room = [[]], 0
    for row in signed:
        if room + len(row[2]) > MOST_BANDS and lists[-1]:
            lists.append([])
            room = 0
        lists[-1].append(row)
        room += len(row[2])

    names = [F.col(f"`{c}`") for c in df.columns]
    text = F.lower(F.coalesce(F.col(f"`{text_column}`"), F.lit("")))
    words = df.select(*names, F.filter(F.split(text, r"[^\p{L}\p{N}]+"), lambda w: w != "").alias("_l_w"))
    # hashes come from the words; shingles as strings are made only where a template is retrieved
    hashed = words.select(*names, "_l_w", F.expr(_per_shingle(f"xxhash64({', '.join(f'get(_l_w, i + {k})' for k in range(SHINGLE))})", "bigint")).alias("_l_h"))
    sizes = sorted({size_of(p) for s in known.values() for p in parts_of(s)})
    banded = hashed.select(*names, "_l_w", F.expr(_bands(sizes)).alias("_l_b"))
    none = F.array().cast("array<struct<license:string,containment:double>>")
    for k, part in enumerate(lists):
        banded = _matched(banded, part, names, k)
    return banded.select(
        *names,
        sum((F.col(f"_l_n{k}") for k in range(1, len(lists))), F.col("_l_n0")).alias("_l_candidates"),
        F.concat(none, *(F.col(f"_l_m{k}") for k in range(len(lists)))).alias("_l_matches"),
    )


def _matched(banded: DataFrame, part: list, names: list, k: int) -> DataFrame:
    """``banded`` and the candidates' number and the matches of some templates."""
    values = sorted({v for _, _, sig in part for v in sig})
    size = 1 << max(10, (64 * len(values)).bit_length())  # bits: one in 64 or fewer is set
    bits = [0] * (size >> 6)
    for v in values:
        bits[(v & size - 1) >> 6] |= 1 << (v & 63)
    bits = [b - (1 << 64) if b >> 63 else b for b in bits]
    row = banded.sparkSession.createDataFrame([(bits, part)], "bits array<long>, templates array<struct<name:string,shingles:array<string>,sig:array<long>>>")
    held = banded.select("*", row.select(F.struct("bits", "templates")).scalar().alias("_l_t"))
    marked = f"filter(_l_b, v -> (shiftright(get(_l_t.bits, CAST(shiftright(v & {size - 1}L, 6) AS INT)), CAST(v & 63L AS INT)) & 1L) = 1L)"
    found = held.withColumn("_l_f", F.array_distinct(F.expr(marked)))
    chosen = found.withColumn("_l_c", F.when(F.size("_l_f") > 0, F.filter(F.col("_l_t.templates"), lambda t: F.arrays_overlap(t["sig"], F.col("_l_f")))))
    grams = F.expr(_per_shingle(f"concat_ws(' ', slice(_l_w, i + 1, {SHINGLE}))", "string"))
    matches = F.filter(
        F.transform("_l_c", lambda t: F.struct(t["name"].alias("license"), (F.size(F.array_intersect(t["shingles"], grams)) / F.size(t["shingles"])).alias("containment"))),
        lambda m: m["containment"] >= CONTAINED,
    )
    count = F.when(F.col("_l_c").isNull(), 0).otherwise(F.size("_l_c")).cast("long").alias(f"_l_n{k}")
    none = F.array().cast("array<struct<license:string,containment:double>>")
    before = [f"_l_{x}{j}" for j in range(k) for x in "nm"]
    return chosen.select(*names, "_l_w", "_l_b", *before, count, F.coalesce(matches, none).alias(f"_l_m{k}"))
