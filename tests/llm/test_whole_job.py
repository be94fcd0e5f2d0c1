"""What the training-data operators once left out: each case here failed before its correction."""

import random

import numpy as np
from pyspark.sql import functions as F

from tessera.llm import imatch, licenses, minhash

SCHEMA = "doc_id long, text string"


def single_link(texts, first=None):
    """The least index of each text's class, by comparing all pairs of the first texts."""
    shingled = [minhash.shingles(w) for w in minhash.hashed_texts(texts)]
    sketch = np.zeros((2, minhash.CELLS), np.int64)
    for hashes, _ in shingled:
        for row in (0, 1):
            np.add.at(sketch[row], minhash.cells_of(hashes, row), 1)
    weigh = minhash.Weights(sketch, len(texts))
    weighed = [(h, weigh(h, c)) for h, c in shingled]
    n = first or len(texts)
    least = list(range(n))
    for a in range(n):
        for b in range(a):
            if least[a] != least[b] and minhash.weighted_jaccard(weighed[a], weighed[b]) >= minhash.THRESHOLD:
                low, high = sorted((least[a], least[b]))
                least = [low if x == high else x for x in least]
    return least


def edited(rng, words, n):
    own = list(words)
    for k in rng.sample(range(len(own)), n):
        own[k] = "".join(rng.choices("abcdefgh", k=7))
    return own


def test_near_duplicates_of_one_member_of_a_large_class(spark):
    rng = random.Random(21)
    new = lambda n: edited(rng, [""] * n, n)
    base = new(94)
    members = [base + new(6) for _ in range(200)]
    texts = members + [new(8) + m[8:] for m in members[:30]]  # each of these is near its own member alone
    chain = [new(100)]
    while len(chain) < 40:
        chain.append(edited(rng, chain[-1], 1))
    texts = [" ".join(t) for t in texts + chain]
    found = {r.doc_id: r.class_id for r in minhash.classes(spark.createDataFrame(list(enumerate(texts)), SCHEMA)).collect()}
    assert [found[k] for k in range(len(texts))] == single_link(texts)


def test_recall_in_a_cloud_of_near_copies(spark):
    """Hundreds of edits of one text, from light to heavy, beside null ids and ids of two texts."""
    rng = random.Random(4)
    base = edited(rng, [""] * 120, 120)
    cloud = [" ".join(edited(rng, base, rng.choice((1, 1, 2, 2, 3, 4, 5, 6)))) for _ in range(260)]
    lone = [edited(rng, [""] * 80, 80) for _ in range(4)]
    pairs = [" ".join(t) for w in lone for t in (w, edited(rng, w, 1))]
    rest = [f"{k} {k * k} {k * 7 + 1}" for k in range(3000)]
    texts = cloud + pairs + rest
    ids = [*range(260), None, None, 7, 500, 501, 7, None, 502, *range(1000, 4000)]
    found = minhash.classes(spark.createDataFrame(list(zip(ids, texts, strict=True)), SCHEMA)).collect()
    assert len(found) == len(texts)
    of = {}
    for r in found:
        of.setdefault(r.doc_id, []).append(r.label)
    truth = single_link(texts, 268)
    together = [(a, b) for a in range(260) if a != 7 for b in range(a) if b != 7 and truth[a] == truth[b]]
    caught = sum(of[a][0] == of[b][0] for a, b in together)
    apart = [(a, b) for a in range(260) if a != 7 for b in range(a) if b != 7 and truth[a] != truth[b]]
    assert len(together) > 1000 and len(apart) > 3000, (len(together), len(apart))
    assert caught >= 0.95 * len(together) and not any(of[a][0] == of[b][0] for a, b in apart)
    nulls = of[None]  # two near copies with null ids are one class, the third is one with 502
    assert sorted(nulls.count(c) for c in set(nulls)) == [1, 2] and of[502][0] in nulls
    assert of[500][0] in of[7] and of[501][0] in of[7] and of[500] != of[501]


def test_every_lexicon_term_touches_the_fingerprint(spark):
    docs = spark.createDataFrame([(k, f"w{k % 400}") for k in range(800)], SCHEMA)
    kept = imatch.lexicon(docs, low=0.001)
    assert len(kept) == 400
    prints = docs.limit(400).select("text", imatch.fingerprint("text", kept).alias("p"))
    assert prints.filter(F.forall("p", lambda h: h == 0)).count() == 0
    both = docs.select(F.concat_ws(" ", F.lit("w0"), "text").alias("text")).distinct().withColumn("p", imatch.fingerprint("text", kept))
    assert both.select("p").distinct().count() == 400


GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice,
   this list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright
   notice, this list of conditions and the following disclaimer in the
   documentation and/or other materials provided with the distribution."""
MPL2 = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""


def test_wrapped_licences_and_spdx_lines(spark):
    spdx = {"MPL-2.0": "MPL-2.0", "AGPL-3.0": "AGPL-3.0-only", "LGPL": "LGPL-2.1", "BSD-2-Clause": "BSD-2-Clause", "GPL-2.0-or-later": "GPL-2.0-or-later", "GPL-2.0": "GPL-2.0-only", "GPL-3.0": "GPL-3.0-or-later", "MIT": "MIT"}
    cases = [(licence, f"// SPDX-License-Identifier: {i}") for licence, i in spdx.items()] + [("GPL-2.0-or-later", "SPDX-License-Identifier: GPL-2.0+\nint x;")]
    cases += [(licence, mark + text.replace("\n", "\n" + mark)) for licence, text in (("GPL-3.0", GPL3), ("BSD-2-Clause", BSD2), ("MPL-2.0", MPL2)) for mark in ("", " * ", "# ", "// ")]
    cases += [("GPL-3.0", "GNU GENERAL PUBLIC LICENSE\n   Version 3, 29 June 2007"), ("GPL-2.0-or-later", GPL3.replace("3", "2")), ("LGPL", GPL3.replace("General", "Lesser\nGeneral"))]
    cases += [("NONE", "GNU General Public License\n\nThere are 3 files.")]
    rows = licenses.scan(spark.createDataFrame([(f"{k} {licence}", t) for k, (licence, t) in enumerate(cases)], "doc_id string, text string")).collect()
    assert [(r.doc_id, r.licence) for r in rows if r.doc_id.split()[1] != r.licence] == []
    both = spark.createDataFrame([("", "See the MIT License\nAll rights reserved")], "doc_id string, text string")
    assert licenses.scan(both).first().sentence_ids == ["mit_name", "proprietary"]


def test_several_licences(spark):
    cases = [
        ("Released under the MIT License. Parts: GNU General Public License, version 3.", ["GPL-3.0", "MIT"]),
        ("SPDX-License-Identifier: MIT\n\nSPDX-License-Identifier: Apache-2.0", ["Apache-2.0", "MIT"]),
        ("BSD License. Redistribution and use in source and binary forms, with or without modification, are permitted. Redistributions of source code must retain the above copyright notice. Redistributions in binary form must reproduce the above copyright notice. All rights reserved.", ["BSD-2-Clause"]),
        ("All rights reserved.", ["Proprietary"]),
        ("Permission is hereby granted, free of charge, to any person obtaining a copy.", []),
        (None, []),
    ]
    rows = licenses.scan(spark.createDataFrame([(k, t) for k, (t, _) in enumerate(cases)], "doc_id int, text string")).orderBy("doc_id").collect()
    assert [list(r.licences) for r in rows] == [found for _, found in cases]
    assert [r.licence for r in rows] == ["GPL-3.0", "Apache-2.0", "BSD-2-Clause", "Proprietary", "UNKNOWN", "NONE"]
