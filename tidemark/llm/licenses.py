"""License scans on DataFrame functions and spark.ml alone: a trained classifier of paragraphs, confirmed by templates.

A multinomial logistic regression with an elastic-net penalty over word 1- and 2-grams learns licence families from whole notices and
from names in the ways in which texts state them, and from lines of prose that are none. A temperature fitted on names, notices
and ways kept out of training calibrates its probabilities. Each paragraph with a learnt word or a cue of licences is told: with its family; as unknown
if it speaks of a licence but no family is likely enough, or if too little of any notice and no name of the likely family stands in it; or as none,
if it likely speaks of something else. Further families whose notice or name stands in it are told beside the first.

A paragraph is a line, or a block: two or more neighbouring lines of at most WRAPPED characters, without comment marks, as file heads
have them. A line inside a confirmed block that has no family of its own is not told again.
"""

from __future__ import annotations

import json
import math
import re

from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .shared import materialise

#: Documents, those of least hash, whose lines are the classifier's prose.
PROSE_DOCUMENTS = 300
#: Longest lines of a block.
WRAPPED = 100
#: Stands for a line's end in a block.
JOIN = "\x1f"
#: Words are features if at most this share of the prose lines has them.
RARE = 0.002
#: A family counts from this calibrated probability, a notice from this share of its 2-grams on.
SURE, CONFIRMED = 0.5, 0.6
NONE, UNKNOWN = "none", "unknown"
# Notices by family.
NOTICES = {
    "agpl": ["This program is free software: you can redistribute it and/or modify it under the terms of the GNU Affero General Public License as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later version.", "SPDX-License-Identifier: AGPL-3.0-or-later"],
    "apache": ["Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License. You may obtain a copy of the License at apache.org.", "Licensed to the Apache Software Foundation under one or more contributor license agreements.", "SPDX-License-Identifier: Apache-2.0"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met.", "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission.", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file.", "SPDX-License-Identifier: BSD-2-Clause"],
    "cc-by": ["Dieses Werk ist lizenziert unter einer Creative Commons Namensnennung 4.0 International Lizenz.", "This work is licensed under a Creative Commons Attribution 4.0 International License.", "You are free to share and adapt the material for any purpose, even commercially, if you give appropriate credit."],
    "cc-by-nc": ["This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License.", "You are free to share and adapt the material if you give appropriate credit, but not for commercial purposes."],
    "cc-by-sa": ["This work is licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "Text is available under the Creative Commons Attribution-ShareAlike License; additional terms may apply."],
    "epl": ["This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 which accompanies this distribution.", "SPDX-License-Identifier: EPL-2.0"],
    "eupl": ["Licensed under the EUPL, Version 1.2 or, as soon they will be approved by the European Commission, subsequent versions of the EUPL.", "SPDX-License-Identifier: EUPL-1.2"],
    "gpl": ["Everyone is permitted to copy and distribute verbatim copies of this license document, but changing it is not allowed.", "This program is free software; you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later version.", "You should have received a copy of the GNU General Public License along with this program.", "This work is licensed under the GNU General Public License, version 3.", "SPDX-License-Identifier: GPL-3.0-only"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies.", "SPDX-License-Identifier: ISC"],
    "lgpl": ["This library is free software; you can redistribute it and/or modify it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation; either version 2.1 of the License, or (at your option) any later version.", "SPDX-License-Identifier: LGPL-2.1-or-later"],
    "mit": ["The software is provided as is, without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement.", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software.", "SPDX-License-Identifier: MIT"],
    "mpl": ["This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL was not distributed with this file, you can obtain one at mozilla.org.", "SPDX-License-Identifier: MPL-2.0"],
    "proprietary": ["All rights reserved.", "Unauthorized copying of this file, via any medium, is strictly prohibited.", "No part of this publication may be reproduced without the prior written permission of the publisher.", "This software is proprietary and confidential.", "Confidential and proprietary information of the company."],
    "public-domain": ["This is free and unencumbered software released into the public domain.", "To the extent possible under law, the author has waived all copyright and related rights to this work.", "Dedicated to the public domain under CC0 1.0.", "This work is in the public domain."],
    "wtfpl": ["Do what the fuck you want to public license. Everyone is permitted to copy and distribute verbatim or modified copies of this license document, and changing it is allowed as long as the name is changed.", "This program is free software. It comes without any warranty, under the terms of the Do What The Fuck You Want To Public License, Version 2."],
    "zlib": ["This software is provided as-is, without any express or implied warranty. In no event will the authors be held liable for any damages arising from the use of this software.", "SPDX-License-Identifier: Zlib"],
    UNKNOWN: ["You may use this work under the terms of its own license.", "See the license agreement for the terms of use.", "Use of this product is subject to the license terms of the vendor.", "By installing the software you accept the license agreement.", "The license file has the full terms."],
}
# Names by family, as texts write them.
NAMES = {
    "agpl": ["GNU Affero General Public License, version 3", "GNU Affero General Public License", "GNU AGPL", "GNU Affero GPL", "AGPLv3", "AGPL 3.0", "AGPL license"],
    "apache": ["Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 license", "Apache-2.0 license", "Apache Software License", "Apache 2 license", "ASL 2.0"],
    "bsd": ["BSD 3-Clause License", "BSD 2-Clause license", "BSD license", "three-clause BSD license", "new BSD license", "simplified BSD license", "modified BSD license"],
    "cc-by": ["CC BY 4.0", "CC BY 3.0", "CC-BY 4.0", "Creative Commons Attribution 4.0 International License", "Creative Commons Attribution license", "Creative Commons Attribution 3.0"],
    "cc-by-nc": ["CC BY-NC 4.0", "CC BY-NC-SA 4.0", "CC BY-NC 3.0", "Creative Commons Attribution-NonCommercial 4.0 International License", "Creative Commons Attribution-NonCommercial license", "Creative Commons NonCommercial license"],
    "cc-by-sa": ["CC BY-SA 4.0", "CC BY-SA 3.0", "CC-BY-SA", "Creative Commons Attribution-ShareAlike 4.0 International License", "Creative Commons Attribution-ShareAlike license", "Creative Commons ShareAlike license"],
    "epl": ["Eclipse Public License 2.0", "Eclipse Public License, version 1.0", "Eclipse Public License", "EPL 2.0", "EPL license"],
    "eupl": ["EUPL-1.2", "European Union Public License 1.2", "European Union Public License", "EUPL, version 1.2", "EUPL"],
    "gpl": ["GNU General Public License, version 3", "GNU General Public License version 2", "GNU GPL", "GPLv3", "GPLv2", "GPL 3.0", "GPL license", "GPL"],
    "isc": ["ISC License", "ISC licence terms", "Internet Systems Consortium license"],
    "lgpl": ["GNU Lesser General Public License, version 3", "GNU Lesser General Public License", "GNU LGPL, version 2.1", "LGPLv3", "LGPL 2.1", "LGPL license", "GNU Library General Public License"],
    "mit": ["MIT License", "MIT licence", "MIT/X11 license", "Expat license", "MIT open source license"],
    "mpl": ["Mozilla Public License, version 2.0", "Mozilla Public License 2.0", "MPL 2.0", "MPLv2", "MPL license"],
    "public-domain": ["CC0 1.0 Universal", "CC0", "Unlicense", "public domain"],
    "wtfpl": ["WTFPL", "Do What The Fuck You Want To Public License", "WTFPL license", "WTFPL version 2"],
    "zlib": ["zlib License", "zlib/libpng license", "zlib licence terms", "zlib-style license"],
    UNKNOWN: ["Example License, version 1", "Sample Public License", "custom license", "license of its vendor", "Open Widget License 1.2", "Acme Software License", "Data Sharing License"],
}
# Words that tell nothing of a licence, alone or together.
FUNCTION = frozenset("a all also an and any are as at be been but by can do does each for from had has have he her here his i if in into is it its more must no not of on one or other our out she so some such that the their them then there these they this those to up use used was we were what when where which who will with you your".split())
# Prose with words of licences that is none, and ways in which names and notices stand in texts.
OTHER_PROSE = [
    "He lost his driving license and had to walk to work.", "The version of the story that was published in 2001 is free of errors.", "Students at MIT built a new kind of battery.", "The Apache are a people of the southwest.",
    "Permission was granted by the council after a long debate.", "The library is open to the public on Monday.", "The terms of the treaty were published by the foundation.", "All rights and duties of the members are equal.",
    "She reserved a table for two.", "The work was released in version 3 of the album.", "Creative people commons rooms in the house.", "The general public may use the source of water.",
    "Copyright law is taught in the second year.", "The software was modified for any purpose that they had.", "Use of the forms is permitted in the office.", "By 4.0 seconds the runner won.",
    "A fishing license costs ten dollars.", "The bar lost its liquor license last year.", "The house was sold under the terms of the will.", "The plane is available under a lease.",
    "The book is covered by the press.", "The code is 4711.", "Their marriage license was issued in May.", "Poetic license is common in such films.",
]
SAYINGS = [
    "Licensed under the {}.", "Released under the {}.", "Distributed under the {}.", "Available under the {}.", "This work is licensed under the {}.", "The code is {}.", "Covered by the {}.", "It is distributed under the terms of the {}.",
    "This project is licensed under the terms of the {}.", "Text is available under a {}.", "License: {}", "Published under {}.", "This software is made available under the {}; see the LICENSE file.", "You can use it under the {}.", "{}", "Source code under {}, data separate.",
    "This package uses the {}.", "The library is covered by the {}.", "All files here are under the {}.", "We chose the {} for this project.",
]
WAYS = ["{}", "{} See the LICENSE file for details.", "Copyright (c) 2019 The Authors. {}", "Note: {}", "{} Copyright 2021.", "The following holds: {}"]
#: Of names, ways and sayings, each of this number is kept out of training and only calibrates.
KEPT_OUT = 4
#: Lines with these stems are not taken for prose.
STEMS = "licen[sc]|copyright|reserved|permission|public domain|spdx|redistribut|gpl|\\bcc[ -]by\\b"
# Words, as words_of gives them, by which a paragraph is told.
CUES = "license licenses licensed licensing licensor licensors licensee sublicense sublicensed relicensed unlicense unlicensed copyright copyrights copyrighted copyleft reserved permission permissions permitted spdx gpl lgpl agpl mpl epl eupl wtfpl eula redistribute redistributed redistribution redistributions warranty warranties proprietary confidential verbatim liable liability commons unencumbered lizenz lizenzen lizenziert licencia licencias licenza".split()


def written() -> list[tuple[str, str, bool]]:
    """(family, text, kept out) of the rows that train: names in all sayings, notices in all ways. What is kept out shares neither its
    name nor its saying, or not its way, with what trains; of names, each family keeps its last."""
    out = []
    for family, names in sorted(NAMES.items()):
        for n, name in enumerate(names):
            for k, saying in enumerate(SAYINGS):
                last, odd = n == len(names) - 1 and n > 2, k % KEPT_OUT == 3
                if last == odd or n <= 2:
                    out.append((family, saying.format(name), last and odd))
    for family, texts in sorted(NOTICES.items()):
        out += [(family, way.format(t), k == KEPT_OUT) for t in texts for k, way in enumerate(WAYS)]
    return out


def plain(text: Column) -> Column:
    """Lower case, with one spelling of licence and versions apart from names (gplv3: gpl 3)."""
    low = F.regexp_replace(F.lower(text), "licen[cs]e", "license")
    return F.regexp_replace(low, r"(?<=[a-z])v?(?=[0-9])|\bv(?=[0-9])", " ")


def words_of(text: Column) -> Column:
    return F.split(plain(text), r"[^\p{L}\p{N}]+")


def grams(text: Column) -> Column:
    """The words of a text in lower case, then its pairs of neighbours."""
    words = F.filter(words_of(text), lambda w: w != "")
    pairs = lambda w: F.when(F.size(w) > 1, F.transform(F.sequence(F.lit(1), F.size(w) - 1), lambda i: F.concat_ws(" ", F.get(w, i - 1), F.get(w, i)))).otherwise(F.array().cast("array<string>"))
    return F.transform(F.array(words), lambda w: F.concat(w, pairs(w)))[0]


def _rows(spark: SparkSession, rows: list[tuple[str, str, bool]]) -> DataFrame:
    """(family, text, out) rows, as one literal of a plan."""
    written = json.dumps([dict(zip(("family", "text", "out"), r)) for r in rows])
    return spark.range(1).select(F.inline(F.from_json(F.lit(written), "array<struct<family:string,text:string,out:boolean>>")))


class LicenseModel:
    """A trained classifier; score() adds to a column of paragraphs its family, probability and similarity."""

    def __init__(self, docs: DataFrame, notices: dict[str, list[str]] = NOTICES, prose_documents: int = PROSE_DOCUMENTS):
        spark = docs.sparkSession
        self.notices, self.families = notices, [NONE, *sorted(notices)]
        texts = docs.select(F.coalesce(docs["text"].cast("string"), F.lit("")).alias("text"), F.xxhash64(docs["doc_id"].cast("string"), docs["text"].cast("string")).alias("h"))
        # Hashes alone go to one task; their texts are picked where they are.
        bound = texts.select("h").orderBy("h").limit(prose_documents).agg(F.max("h")).first()[0]
        chosen = texts.where(F.col("h") <= F.lit(bound).cast("long"))
        prose = chosen.select(F.explode(F.split("text", "\n")).alias("text")).where(~F.lower("text").rlike(STEMS))
        prose = prose.select(F.lit(NONE).alias("family"), "text", (F.xxhash64("text") % 8 == 0).alias("out"))
        rows = _rows(spark, written() + [(NONE, t, False) for t in OTHER_PROSE]).unionByName(prose)
        label = F.array_position(F.array(*[F.lit(f) for f in self.families]), F.col("family")).cast("double") - 1
        data = materialise(rows.select(label.alias("label"), grams(F.col("text")).alias("grams"), "out", F.when(F.col("family") == NONE, 0.2).otherwise(1.0).alias("w")), "notices")
        # Only what notices have and prose has hardly ever is a feature; a paragraph without any has the intercepts' class: none.
        lines = data.where("label = 0").count()
        split = data.select("label", F.explode(F.array_distinct("grams")).alias("g")).groupBy("g").agg(F.max(F.col("label") > 0).alias("notice"), F.count_if(F.col("label") == 0).alias("in_prose")).where("notice")
        in_prose = {r.g: r.in_prose for r in split.orderBy("g").collect()}  # the notices' own, some thousand
        empty = lambda w: w in FUNCTION or w.isdigit() or len(w) == 1
        own = [g for g, n in in_prose.items() if n <= RARE * lines and not all(map(empty, g.split(" ")))]
        self.vector = CountVectorizerModel.from_vocabulary(own, inputCol="grams", outputCol="features").setBinary(True)
        seen = self.vector.transform(data)
        self.model = LogisticRegression(family="multinomial", regParam=2e-4, elasticNetParam=0.5, maxIter=60, weightCol="w").fit(seen.where("NOT out"))
        weights = self.model.coefficientMatrix.toArray()
        # A paragraph with a feature of any weight has one of these words: each feature's word that is rarest in prose.
        self.words = sorted({min(g.split(" "), key=lambda w: (empty(w), in_prose.get(w, 0), w)) for g, k in zip(own, abs(weights).max(0)) if k > 1e-9})
        margins = self.model.transform(seen.where("out")).select("label", vector_to_array("rawPrediction").alias("m"))
        self.temperature = self._calibrate(margins)

    def _calibrate(self, margins: DataFrame) -> float:
        """The temperature of least log loss on rows kept out of training."""
        grid = [0.5 * 1.15**k for k in range(20)]
        loss = lambda t: F.avg(F.log(F.aggregate(F.transform("m", lambda x: F.exp((x - F.array_max("m")) / t)), F.lit(0.0), lambda a, b: a + b)) + (F.array_max("m") - F.get("m", F.col("label").cast("int"))) / t)
        found = margins.agg(*[loss(t).alias(str(k)) for k, t in enumerate(grid)]).first()
        return min(((x, t) for x, t in zip(found, grid) if x is not None and not math.isnan(x)), default=(0.0, 1.0))[1]

    def score(self, paragraphs: DataFrame) -> DataFrame:
        """paragraphs (with column paragraph) that have a learnt word or a cue: family (or unknown, or none), probability, similarity and others, the further
        families whose notice or name they have, beside their columns."""
        told = sorted({*self.words, *CUES})
        touched = F.exists(words_of(F.col("paragraph")), lambda w: w.isin(told))
        given = paragraphs.where(touched).withColumn("grams", grams(F.col("paragraph")))
        p = F.transform(F.array(vector_to_array("rawPrediction")), lambda m: F.transform(m, lambda x: F.exp((x - F.array_max(m)) / self.temperature)))[0]
        p = F.transform(F.array(p), lambda a: F.transform(a, lambda x: x / F.aggregate(a, F.lit(0.0), lambda s, v: s + v)))[0]
        scored = self.model.transform(self.vector.transform(given)).select(*paragraphs.columns, "grams", p.alias("p"))
        # The likeliest family, and the largest part of one of its notices' pairs of words that the paragraph has.
        best = F.array_max(F.transform(F.slice("p", 2, len(self.families)), lambda x, i: F.struct(x.alias("p"), (-i).alias("i"))))
        named = scored.withColumn("best", best).withColumn("likely", F.get(F.array(*[F.lit(f) for f in self.families]), 1 - F.col("best.i")))
        part = lambda t: F.size(F.array_intersect("grams", F.array(*[F.lit(x) for x in t]))) / float(len(t))
        # A name counts whole or not at all.
        whole = lambda t: F.when(part(t) == 1.0, 1.0).otherwise(0.0)
        templates = {f: [part(template(t)) for t in texts] + [whole(template(t)) for t in NAMES.get(f, [])] for f, texts in self.notices.items()}
        similarity = F.coalesce(*[F.when(F.col("likely") == f, F.greatest(F.lit(0.0), *x)) for f, x in templates.items()])
        named = named.withColumn("similarity", F.when(F.get("p", F.lit(0)) >= 0.5, 0.0).otherwise(similarity))
        sure = (F.col("best.p") >= SURE) & (F.col("similarity") >= CONFIRMED)
        nothing = F.get("p", F.lit(0))
        family = F.when(nothing >= 0.5, NONE).when(sure, F.col("likely")).otherwise(UNKNOWN)
        named = named.withColumn("family", family)
        # Templates are held against what speaks of a licence alone.
        stands = [F.when(~F.col("family").isin(NONE, f) & (F.greatest(F.lit(0.0), *x) >= CONFIRMED), f) for f, x in templates.items() if f != UNKNOWN]
        others = F.when(F.col("family") == NONE, F.array().cast("array<string>")).otherwise(F.array_sort(F.array_compact(F.array(*stands))))
        return named.select(*paragraphs.columns, "family", F.when(F.col("family") == NONE, nothing).otherwise(F.col("best.p")).alias("probability"), "similarity", others.alias("others"))


def template(text: str) -> list[str]:
    """The pairs of words of a notice or name, each once; a single word stands for itself."""
    low = re.sub(r"(?<=[a-z])v?(?=[0-9])|\bv(?=[0-9])", " ", re.sub("licen[cs]e", "license", text.lower()))
    words = [w for w in re.split(r"[^\w]+", low) if w]
    return list(dict.fromkeys(f"{a} {b}" for a, b in zip(words, words[1:]))) or words


def paragraphs(docs: DataFrame) -> DataFrame:
    """doc_id, row (a hash of the text), kind, place and paragraph of docs (doc_id, text): each line with its number, and each block with the
    number of paragraphs before it, if blocks and single lines are counted."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    short, shorter = f"[^\\n]{{1,{WRAPPED}}}", f"[^\\n]{{0,{WRAPPED - 1}}}"
    # A break between two short lines that aren't blank becomes JOIN.
    joined = F.regexp_replace(F.concat(F.lit("\n"), text, F.lit("\n")), rf"\n(?<=\n{short}\n)(?<=\S[^\S\n]{{0,9}}\n)(?=[^\S\n]{{0,9}}\S{shorter}\n)", JOIN)
    one = lambda kind: lambda x, i: F.struct(F.lit(kind).alias("kind"), i.alias("place"), x.alias("paragraph"))
    blocks = F.filter(F.transform(F.split(joined, "\n"), lambda x, i: one("block")(x, i - 1)), lambda x: F.contains(x["paragraph"], F.lit(JOIN)))
    every = F.concat(F.transform(F.split(text, "\n"), one("line")), blocks)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("row"), F.explode(every).alias("p")).select("doc_id", "row", "p.*")


def scan_licenses(docs: DataFrame, model: LicenseModel | None = None) -> DataFrame:
    """doc_id, kind, place, paragraph, family, probability, similarity, others of each paragraph of docs (doc_id, text) that a word or cue of licences touches.

    Of a block only a confirmed family is told, and only if none of its lines has that family by itself; a line of such a block has to
    have a family of its own. Null and empty texts have no paragraph of interest; rows that agree in doc_id and text are told each; other
    columns are not read.
    """
    model = model or LicenseModel(docs)
    found = materialise(model.score(paragraphs(docs)), "licences")
    lines, blocks = found.where("kind = 'line'"), found.where(F.col("kind") == "block").where(~F.col("family").isin(UNKNOWN, NONE))
    side = lambda df, *c: df.select(F.col("doc_id").alias("_id"), F.col("row").alias("_row"), F.col("paragraph").alias("_text"), *c).distinct()
    same = lambda df, other: df["doc_id"].eqNullSafe(other["_id"]) & (df["row"] == other["_row"])
    named = side(lines.where(~F.col("family").isin(UNKNOWN, NONE)), F.col("family").alias("_family"))
    blocks = blocks.join(named, same(blocks, named) & (blocks["family"] == named["_family"]) & F.contains(blocks["paragraph"], named["_text"]), "left_anti")
    whole = side(blocks)
    lines = lines.join(whole, same(lines, whole) & lines["family"].isin(UNKNOWN, NONE) & F.contains(whole["_text"], lines["paragraph"]), "left_anti")
    return lines.unionByName(blocks).withColumn("paragraph", F.replace("paragraph", F.lit(JOIN), F.lit("\n"))).drop("row")


def op4_license_scan(spark, sf_dir: str) -> DataFrame:
    """All documents' licence paragraphs."""
    found = scan_licenses(spark.read.parquet(f"{sf_dir}/documents.parquet"))
    return found.select("doc_id", "kind", F.col("place").cast("long").alias("paragraph"), "family", F.round("probability", 6).alias("probability"), F.round("similarity", 6).alias("similarity"), F.array_join("others", ",").alias("others"))
