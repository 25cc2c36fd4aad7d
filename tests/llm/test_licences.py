"""Licence families, licence talk of no known family and ordinary text."""

import pytest

from corvane.llm import license as licences

DOCS = "doc_id long, text string"
OTHER = [
    "Licensed under the Sybase License",
    "released under the Zlib license",
    "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted.",
    "The licensed premises renew their liquor licence each year.",
    "This work is licensed under the Sybase Open Watcom Public License version 1.0",
    "licensed under the EUPL Public License version 3 general",
    "Distributed under the Academic Free License, version 3.0.",  # from here on of families that no example names
    "This file is available under the PostgreSQL License.",
    "The code is licensed under the Nokia Open Source License.",
    "Covered by the CeCILL license agreement.",
    "You may use it under the NASA Open Source Agreement license 1.3",
]
KNOWN = {
    "mit": ["Released under the MIT License.", "SPDX-License-Identifier: MIT", "Permission is hereby granted, free of charge, to any person\nobtaining a copy of this software and associated documentation files\n(the \"Software\"), to deal in the Software without restriction"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3.", "This program is free software: you can redistribute it\nand/or modify it under the terms of the GNU General Public License\nas published by the Free Software Foundation"],
    "lgpl": ["under the terms of the GNU Lesser General Public License, version 2.1"],
    "agpl": ["Licensed under the GNU Affero General Public License version 3"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["released under the BSD 3-Clause License", "Redistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are met:"],
    "mpl-2.0": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."],
    "cc-by": ["Licensed under CC BY 4.0."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License."],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0."],
    "cc-by-nd": ["Licensed under CC BY-ND 4.0."],
    "cc0": ["Licensed under CC0 1.0"],
}
PLAIN = ["Die Katze sitzt mit dem Hund auf dem Sofa.", "He walked home along the river and thought of the general public.", "Version 2 0 of the plan was sent to the author", "", "   \n\n"]


@pytest.fixture(scope="module")
def model(spark):
    return licences.fit(spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text"))


def found(spark, model, texts):
    rows = licences.find(spark.createDataFrame(list(enumerate(texts)), DOCS), model).collect()
    return {i: {r.family for r in rows if r.doc_id == i} for i in range(len(texts))}, rows


def test_families_are_found_and_confirmed(spark, model):
    texts = [(f, t) for f, own in KNOWN.items() for t in own]
    got, rows = found(spark, model, [f"Some words before.\n{t}\n\nAnd after it." for _, t in texts])
    assert [(f, got[i]) for i, (f, _) in enumerate(texts)] == [(f, {f}) for f, _ in texts]
    assert all(r.confirmed and r.overlap >= 0.8 and r.paragraph == 1 for r in rows)


def test_other_licence_talk_is_unknown(spark, model):
    got, rows = found(spark, model, OTHER)
    assert got == dict.fromkeys(range(len(OTHER)), {"unknown"})
    assert not any(r.confirmed for r in rows)


def test_ordinary_text_has_no_row(spark, model):
    assert found(spark, model, PLAIN)[1] == []


def test_a_long_paragraph_is_read_in_windows(spark, model):
    words = " ".join(f"w{i}" for i in range(500))
    _, rows = found(spark, model, [f"{words} released under the MIT License {words}"])
    assert rows and {(r.paragraph, r.family) for r in rows} == {(0, "mit")} and {r.window for r in rows} <= {11, 12}


def test_thresholds_follow_held_out_talk(model):
    assert 0.5 <= model.least < 1 and 0 < model.talk <= 0.5
