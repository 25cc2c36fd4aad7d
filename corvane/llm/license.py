"""Licence scans of paragraphs with DataFrame operations and spark.ml alone.

A paragraph is a block of lines: lines run on until one ends a sentence or a blank one comes. Blocks with a word that
licence talk needs are cut into windows of words; their hashed one- and two-word counts go through a multinomial
logistic regression over licence families, other licence talk (`unknown`) and ordinary text (`none`). Two thresholds are
fitted on families that the regression has not seen: the probability from which a family may stand, and the one from
which a window is licence talk at all. A family stands if one of its templates is there: a name as a whole and in its
order, or most of the word pairs of a longer clause; else the window is `unknown`.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.feature import HashingTF
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut

# fixed values: names of licence families, as they stand in sentences
NAMES = {
    "apache-2.0": ["apache license version 2 0", "apache license 2 0", "apache 2 0 license", "apache software license 2 0", "apache 2 0"],
    "mit": ["mit license", "mit licence", "mit expat license", "license mit", "identifier mit", "under mit"],
    "bsd": ["bsd 3 clause license", "bsd 2 clause license", "bsd license", "new bsd license", "simplified bsd license", "bsd 3 clause", "bsd 2 clause"],
    "gpl": ["gnu general public license", "gnu gpl", "gpl version 3", "gpl version 2", "gpl 3 0", "gpl 2 0", "gplv3", "gplv2", "under the gpl"],
    "lgpl": ["gnu lesser general public license", "gnu library general public license", "gnu lgpl", "lgpl 3 0", "lgpl 2 1", "lgplv3", "under the lgpl"],
    "agpl": ["gnu affero general public license", "affero general public license", "gnu agpl", "agpl 3 0", "agplv3", "under the agpl"],
    "mpl-2.0": ["mozilla public license version 2 0", "mozilla public license v 2 0", "mozilla public license 2 0", "mozilla public license", "mpl 2 0"],
    "cc-by": ["creative commons attribution 4 0 international license", "creative commons attribution 4 0", "creative commons attribution 3 0", "creative commons attribution license", "cc by 4 0", "cc by 3 0"],
    "cc-by-sa": ["creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike", "creative commons attribution share alike", "cc by sa 4 0", "cc by sa 3 0", "cc by sa"],
    "cc-by-nc": ["creative commons attribution noncommercial 4 0 international license", "creative commons attribution noncommercial", "creative commons attribution non commercial", "cc by nc 4 0", "cc by nc 3 0", "cc by nc"],
    "cc-by-nd": ["creative commons attribution noderivatives 4 0 international license", "creative commons attribution noderivatives", "creative commons attribution no derivatives", "cc by nd 4 0", "cc by nd 3 0", "cc by nd"],
    "cc0": ["cc0 1 0 universal", "cc0 1 0", "creative commons zero", "cc0 public domain dedication", "under cc0"],
}
# fixed values: clauses of the licences' texts
CLAUSES = {
    "apache-2.0": ["you may not use this file except in compliance with the license you may obtain a copy of the license at", "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied", "see the license for the specific language governing permissions and limitations under the license"],
    "mit": ["permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction", "the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software", "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement"],
    "bsd": ["redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met", "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"],
    "gpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation", "you should have received a copy of the gnu general public license along with this program"],
    "lgpl": ["this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license as published by the free software foundation", "you should have received a copy of the gnu lesser general public license along with this library"],
    "agpl": ["this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation", "you should have received a copy of the gnu affero general public license along with this program"],
    "mpl-2.0": ["this source code form is subject to the terms of the mozilla public license v 2 0", "if a copy of the mpl was not distributed with this file you can obtain one at"],
    "cc-by": ["this work is licensed under a creative commons attribution 4 0 international license"],
    "cc-by-sa": ["this work is licensed under a creative commons attribution sharealike 4 0 international license"],
    "cc-by-nc": ["this work is licensed under a creative commons attribution noncommercial 4 0 international license"],
    "cc-by-nd": ["this work is licensed under a creative commons attribution noderivatives 4 0 international license"],
    "cc0": ["to the extent possible under law the author has waived all copyright and related or neighboring rights to this work", "no rights reserved public domain dedication cc0"],
}
# fixed values: licences and licence talk of no family above; each row is a family of its own
OTHERS = {
    "isc": ["isc license", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", "the software is provided as is and the author disclaims all warranties with regard to this software"],
    "zlib": ["zlib license", "zlib libpng license", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"],
    "boost": ["boost software license version 1 0", "distributed under the boost software license see accompanying file"],
    "unlicense": ["the unlicense", "this is free and unencumbered software released into the public domain"],
    "epl": ["eclipse public license version 2 0", "this program and the accompanying materials are made available under the terms of the eclipse public license"],
    "eupl": ["european union public licence version 1 2", "eupl version 1 2", "licensed under the eupl"],
    "ofl": ["sil open font license version 1 1", "this font software is licensed under the sil open font license"],
    "artistic": ["artistic license 2 0", "the perl artistic license", "same terms as perl itself"],
    "sybase": ["sybase open watcom public license version 1 0", "sybase license"],
    "cddl": ["common development and distribution license version 1 0", "the contents of this file are subject to the terms of the common development and distribution license"],
    "oracle": ["oracle binary code license agreement", "oracle technology network license"],
    "microsoft": ["microsoft public license", "microsoft reciprocal license", "microsoft software license terms"],
    "proprietary": ["all rights reserved", "proprietary license", "unauthorized copying of this file via any medium is strictly prohibited", "this software is confidential and proprietary information of the company", "licensed not sold"],
    "agreement": ["subject to the terms of the license agreement", "end user license agreement", "commercial license", "evaluation license", "by installing the software you accept the terms of this license"],
    "file": ["see the license file for details", "see license txt in the project root for license information", "license terms can be found in the documentation"],
    "data": ["open data commons open database license", "community data license agreement permissive version 2 0", "odc by license"],
    "notices": ["copyright by the authors", "copyright notice must stay intact", "reproduced with permission of the publisher", "subject to the licence of its publisher"],
    "trade": ["the licensed premises renew their liquor licence each year", "a driving licence was issued in march", "the fishing license costs ten dollars", "the license fee is due in may", "licensed practitioners must register with the board"],
    "sales": ["limited warranty of two years", "the warranty covers parts and labor", "permission was granted by the council", "a patent license was granted to the manufacturer"],
}
SAID = ["licensed under the {}", "released under the {}", "distributed under the terms of the {}", "this work is licensed under a {}", "spdx license identifier {}", "available under {}", "{}", "the code is covered by the {} see the file for details", "copyright 2019 the authors {}", "published under {} terms"]
AROUND = ["", "note that", "the project and its parts are", "for details see", "please read", "in this file"]
#: Words without which no window is licence talk.
CUES = r"licen[cs]|copyright|spdx|rights reserved|public domain|creative commons|\bcc[ -]?by\b|\bcc0\b|redistribut|permission|warrant|unencumbered|\b[al]?gpl|\bmpl\b|\beupl\b|prohibited|proprietary|apache|mozilla|\bbsd\b|same terms|under mit\b"
FAMILIES = [*NAMES, "unknown", "none"]
SLOTS, WINDOW, STRIDE = 1 << 14, 80, 40


def words(text: Column) -> Column:
    """Words of a paragraph: runs of letters and digits in lower case."""
    return F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != "")


def word_pairs(ws: Column) -> Column:
    n = F.greatest(F.size(ws) - 1, F.lit(0))
    return F.zip_with(F.slice(ws, 1, n), F.slice(ws, 2, n), lambda a, b: F.concat(a, F.lit(" "), b))


def features(rows: DataFrame) -> DataFrame:
    """Adds the sparse vector `features` of one- and two-word counts to rows with `words`."""
    grams = rows.withColumn("grams", F.concat("words", word_pairs(F.col("words"))))
    return HashingTF(inputCol="grams", outputCol="features", numFeatures=SLOTS, binary=True).transform(grams).drop("grams")


@dataclass(frozen=True)
class LicenceModel:
    regression: LogisticRegressionModel
    least: float  # calibrated: the probability from which a family may stand
    talk: float  # calibrated: the probability of all families and `unknown` from which a window is licence talk


def _examples(spark: SparkSession) -> DataFrame:
    """Names in sentences, clauses as a whole and in windows of twelve words, between words of talk around them. `part`
    is what is held out together: an other family as a whole, a phrase of the named ones."""
    rows = []
    sets = [(f, f"{f} {p}", p, p in NAMES[f]) for f in NAMES for p in (*NAMES[f], *CLAUSES[f])]
    sets += [("unknown", g, p, len(p.split()) <= 8) for g, own in OTHERS.items() for p in own]
    for label, part, p, name in sets:
        ws = p.split()
        spans = [said.format(p) for said in SAID] if name else [p, *(" ".join(ws[i : i + 12]) for i in range(0, max(1, len(ws) - 11), 4))]
        rows += [(label, part, f"{AROUND[(i + k) % len(AROUND)]} {s}".strip()) for i, s in enumerate(spans) for k in (0, 1, 3)]
    return spark.createDataFrame(rows, "label string, part string, text string")


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, paragraph (its number) and text of the blocks of lines that hold a cue of licence talk. A line that ends
    without . ! ? : or ; runs on in the next one, unless that is blank."""
    joined = F.regexp_replace("text", r"([^.!?:;\s])[ \t\r]*\n[ \t]*(?=[^\s])", "$1 ")
    blocks = F.filter(F.split(joined, r"\n"), lambda x: F.trim(x) != "")
    numbered = F.transform(blocks, lambda x, i: F.struct(i.alias("paragraph"), x.alias("text")))
    cued = docs.where(F.lower("text").rlike(CUES)).select("doc_id", F.explode(F.filter(numbered, lambda b: F.lower(b["text"]).rlike(CUES))).alias("b"))
    return cued.select("doc_id", "b.paragraph", "b.text")


def windows(blocks: DataFrame) -> DataFrame:
    """doc_id, paragraph, window, words: WINDOW words of a block each, at every STRIDE of them, if they hold a cue."""
    n = F.size("ws")
    starts = F.when(n <= WINDOW, F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.greatest(n - WINDOW + STRIDE - 1, F.lit(0)), F.lit(STRIDE)))
    cuts = F.transform(starts, lambda at, i: F.struct(i.alias("window"), F.slice("ws", at + 1, WINDOW).alias("words")))  # a long block's words are held twice, not once a window
    cued = F.filter(cuts, lambda c: F.array_join(c["words"], " ").rlike(CUES))
    rows = blocks.withColumn("ws", words(F.col("text"))).select("doc_id", "paragraph", F.explode(cued).alias("c"))
    return rows.select("doc_id", "paragraph", "c.window", "c.words")


def fit(docs: DataFrame, max_paragraphs: int = 4000, false_share: float = 0.02) -> LicenceModel:
    """Trains on the examples and on at most max_paragraphs lines of docs without cues, those of the least hashes: the
    documented bound of the sample. A fifth of the lines and of the other families, each as a whole, is held out. A
    family may stand from the probability that at most false_share of the held-out lines reach, and of the windows of
    held-out families, 0.5 at least. A window is talk from the probability that all but false_share of the latter reach,
    0.5 at most. An empty table leaves the examples alone to learn from."""
    spark = docs.sparkSession
    total = docs.count()
    few = docs.where(F.pmod(F.xxhash64("doc_id", "text", F.lit(21)), F.lit(1_000_000)) < int(1e6 * min(1.0, max_paragraphs / 4 / max(total, 1))) + 1)
    plain = few.select(F.explode(F.split("text", "\n")).alias("text")).where((F.trim("text") != "") & ~F.lower("text").rlike(CUES))
    drawn = F.xxhash64("text", F.lit(22))
    plain = plain.where(F.pmod(drawn, F.lit(4)) == 0).orderBy(drawn, "text").limit(max_paragraphs).select(F.lit("none").alias("label"), "text", F.col("text").alias("part"))
    rows = _examples(spark).unionByName(plain)
    fold = F.when(F.col("label").isin("unknown", "none"), F.pmod(F.xxhash64("part", F.lit(2)), F.lit(5))).otherwise(1)
    rows = features(rows.select("label", F.slice(words(F.col("text")), 1, WINDOW).alias("words"), fold.alias("fold")))
    rows = cut(rows.withColumn("label", F.array_position(F.array(*map(F.lit, FAMILIES)), F.col("label")).cast("double") - 1).select("label", "features", "fold"), "licences")
    n = len(NAMES)
    sizes = rows.agg(F.count(F.when(F.col("label") <= n, 1)).alias("talk"), F.count(F.when(F.col("label") > n, 1)).alias("plain")).first()
    # as much weight for all ordinary lines as for all talk, however few stand for them
    rows = rows.withColumn("weight", F.when(F.col("label") > n, max(0.05, sizes.talk / max(sizes.plain, 1))).otherwise(1.0))
    model = LogisticRegression(family="multinomial", regParam=0.0005, maxIter=60, weightCol="weight").fit(rows.where("fold > 0"))
    p = vector_to_array("probability")
    held = model.transform(rows.where(f"fold = 0 and label >= {n}")).select("label", F.array_max(F.slice(p, 1, n)).alias("family"), (1 - F.element_at(p, n + 2)).alias("talk"))
    held = {r.label: r for r in held.groupBy("label").agg(F.percentile("family", 1 - false_share).alias("family"), F.percentile("talk", false_share).alias("talk")).collect()}
    talk = min(0.5, held[float(n)].talk) if float(n) in held else 0.5
    return LicenceModel(model, max([0.5, *(r.family for r in held.values())]), talk)


def find(docs: DataFrame, model: LicenceModel, least_overlap: float = 0.8) -> DataFrame:
    """doc_id, paragraph, window, family, probability, overlap, confirmed: the windows of paragraphs of docs (doc_id,
    text) that talk of a licence. family is the predicted one if its probability reaches the model's threshold and one of
    its templates confirms it: a name word for word, or least_overlap of the pairs of neighbouring words of a clause;
    else `unknown`. overlap is the best of the predicted family's templates, 1.0 for a name.

    Null, empty and blank texts have no paragraphs; null ids pass through; repeated rows repeat; other columns are
    ignored. Texts are read whole: a long paragraph has a window for every 40 words, so a licence may show in two.
    Windows without a cue are no licence talk. No shuffle, no Python."""
    rows = features(windows(paragraphs(docs)))
    n = len(NAMES)
    scored = model.regression.transform(rows).select("doc_id", "paragraph", "window", "words", vector_to_array("probability").alias("p"))
    best = F.slice("p", 1, n)
    scored = scored.select("doc_id", "paragraph", "window", "words", F.array_max(best).alias("probability"), F.array_position(best, F.array_max(best)).cast("int").alias("at"), F.element_at("p", n + 1).alias("unknown"), (1 - F.element_at("p", n + 2)).alias("talk"))
    text = F.concat(F.lit(" "), F.array_join("words", " "), F.lit(" "))
    scored = scored.withColumn("said", text).withColumn("pairs", word_pairs(F.col("words")))
    # a family's templates as one text each, so that the plan holds a dozen texts and not each word of them
    of = lambda sets, sep: F.split(F.element_at(F.array(*[F.lit(sep.join(own)) for own in sets.values()]), F.col("at")), rf"\{sep}")
    pairs = {f: [",".join(f"{a} {b}" for a, b in zip(c.split(), c.split()[1:], strict=False)) for c in own] for f, own in CLAUSES.items()}
    scored = scored.withColumn("names", of(NAMES, "|")).withColumn("clauses", F.transform(of(pairs, "|"), lambda c: F.array_distinct(F.split(c, ","))))
    named = F.exists("names", lambda x: F.contains(F.col("said"), F.concat(F.lit(" "), x, F.lit(" "))))
    share = F.array_max(F.transform("clauses", lambda c: F.size(F.array_intersect(c, F.col("pairs"))) / F.size(c)))
    out = scored.withColumn("overlap", F.when(named, 1.0).otherwise(share)).withColumn("name", F.element_at(F.array(*map(F.lit, NAMES)), F.col("at")))
    stands = (F.col("probability") >= model.least) & (F.col("overlap") >= least_overlap)
    out = out.withColumn("confirmed", stands).where(F.col("confirmed") | (F.col("talk") >= model.talk))
    return out.select("doc_id", "paragraph", "window", F.when(F.col("confirmed"), F.col("name")).otherwise("unknown").alias("family"), F.when(F.col("confirmed"), F.col("probability")).otherwise(F.greatest("unknown", 1 - F.col("probability"))).alias("probability"), "overlap", "confirmed")
