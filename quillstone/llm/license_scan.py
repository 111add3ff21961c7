"""License scans: sparse TF-IDF cosine of headers and licence files to templates, inherited from the nearest directory."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quillstone.llm.shared import Stage, broadcast_if_small

# How works say under which licence they are, how well-known licences begin, and the short ones in full.
_MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files (the Software), to deal in the Software without restriction, "
    "including without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit persons to whom the Software is furnished "
    "to do so, subject to the following conditions:"
)
_ISC = "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all copies."
_BSD = "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met:"
_BSD_CLAUSES = (
    "Redistributions of source code must retain the above copyright notice, this list of conditions and the following disclaimer. Redistributions in binary form must reproduce the above copyright "
    "notice, this list of conditions and the following disclaimer in the documentation and/or other materials provided with the distribution."
)
_BSD_NAMES = "Neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission."
_BSD_END = (
    "This software is provided by the copyright holders and contributors as is and any express or implied warranties, including, but not limited to, the implied warranties of merchantability and "
    "fitness for a particular purpose are disclaimed. In no event shall the copyright holder or contributors be liable for any direct, indirect, incidental, special, exemplary, or consequential damages "
    "(including, but not limited to, procurement of substitute goods or services; loss of use, data, or profits; or business interruption) however caused and on any theory of liability, whether in "
    "contract, strict liability, or tort (including negligence or otherwise) arising in any way out of the use of this software, even if advised of the possibility of such damage."
)
_GNU = "This program is free software; you can redistribute it and/or modify it under the terms of the GNU {} as published by the Free Software Foundation; either version {} of the License, or (at your option) any later version."
_UNLICENSE = "This is free and unencumbered software released into the public domain."
TEMPLATES = [
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the License); you may not use this file except in compliance with the License."),
    ("Apache-2.0", "Apache License Version 2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files."),
    ("MIT", _MIT),
    ("MIT", (
        "MIT License Copyright (c) " + _MIT + " The above copyright notice and this permission notice shall be included in all copies or substantial portions of the Software. The Software is provided as is, "
        "without warranty of any kind, express or implied, including but not limited to the warranties of merchantability, fitness for a particular purpose and noninfringement. In no event shall the "
        "authors or copyright holders be liable for any claim, damages or other liability, whether in an action of contract, tort or otherwise, arising from, out of or in connection with the Software "
        "or the use or other dealings in the Software."
    )),
    ("BSD-3-Clause", "Licensed under the BSD 3-Clause License."),
    ("BSD-3-Clause", _BSD),
    ("BSD-3-Clause", f"BSD 3-Clause License Copyright (c) All rights reserved. {_BSD} {_BSD_CLAUSES} {_BSD_NAMES} {_BSD_END}"),
    ("BSD-2-Clause", "Licensed under the BSD 2-Clause License."),
    ("BSD-2-Clause", f"BSD 2-Clause License Copyright (c) All rights reserved. {_BSD} {_BSD_CLAUSES} {_BSD_END}"),
    ("GPL-2.0", "Licensed under the GNU General Public License, version 2."),
    ("GPL-2.0", _GNU.format("General Public License", "2")),
    ("GPL-2.0", "GNU General Public License Version 2"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", _GNU.format("General Public License", "3")),
    ("GPL-3.0", "GNU General Public License Version 3"),
    ("LGPL-2.1", _GNU.format("Lesser General Public License", "2.1")),
    ("LGPL-2.1", "GNU Lesser General Public License Version 2.1"),
    ("LGPL-3.0", "Licensed under the GNU Lesser General Public License, version 3."),
    ("LGPL-3.0", _GNU.format("Lesser General Public License", "3")),
    ("LGPL-3.0", "GNU Lesser General Public License Version 3"),
    ("AGPL-3.0", "Licensed under the GNU Affero General Public License, version 3."),
    ("AGPL-3.0", _GNU.format("Affero General Public License", "3")),
    ("AGPL-3.0", "GNU Affero General Public License Version 3"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0."),
    ("MPL-2.0", "Mozilla Public License Version 2.0"),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-SA-4.0", "Licensed under CC BY-NC-SA 4.0."),
    ("CC-BY-ND-4.0", "Licensed under CC BY-ND 4.0."),
    ("CC0-1.0", "Released under CC0 1.0 Universal, dedicated to the public domain."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("ISC", _ISC),
    ("ISC", (
        "ISC License Copyright (c) " + _ISC + " The software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and "
        "fitness. In no event shall the author be liable for any special, direct, indirect, or consequential damages or any damages whatsoever resulting from loss of use, data or profits, whether in an "
        "action of contract, negligence or other tortious action, arising out of or in connection with the use or performance of this software."
    )),
    ("Unlicense", _UNLICENSE),
    ("Unlicense", (
        _UNLICENSE + " Anyone is free to copy, modify, publish, use, compile, sell, or distribute this software, either in source code form or as a compiled binary, for any purpose, commercial or non-commercial, "
        "and by any means. In jurisdictions that recognize copyright laws, the author or authors of this software dedicate any and all copyright interest in the software to the public domain. We make this "
        "dedication for the benefit of the public at large and to the detriment of our heirs and successors. We intend this dedication to be an overt act of relinquishment in perpetuity of all present and "
        "future rights to this software under copyright law."
    )),
]
#: Licence names as identifiers; the GNU ones also say which versions they mean.
IDENTIFIERS = [(n, n + end) for n in dict(TEMPLATES) for end in (("", "-only", "-or-later") if "GPL" in n else ("",))]
#: A sentence that speaks of a licence: from the words that begin such a sentence to its end, however long.
HEADER = r"(?is)\b(?:this (?:work|software|file|document|source code form|program) is |)(?:licen[sc]ed under|released under|released into|subject to the terms of|permission is hereby|permission to use|redistribution and use|free and unencumbered|free software[:;,]? you can redistribute|redistribute it and/or modify).*?(?:\.(?=\s|$)|\n\s*\n|$)"
#: The title that a licence's own text begins with, and the identifier after a tag (the line's end ends it).
TITLE = r"(?i)\A[^A-Za-z0-9]*((?:gnu (?:(?:lesser|affero) )?general public license|apache license|mozilla public license)[\s,]+version\s+[0-9](?:\.[0-9])?)"
IDENTIFIER = r"(?i)spdx-license-identifier:[\x20\t(]*([a-z0-9][a-z0-9.+-]*)"
HINTS = (
    "licensed under", "licenced under", "released under", "released into", "subject to the terms", "permission is hereby", "permission to use", "redistribution and use", "free and unencumbered",
    "you can redistribute", "redistribute it and/or modify",
)
#: Cosine from which a header or a whole licence file counts, from which an identifier does, and the share of a file's words
#: in its headers from which it is a licence file.
LEAST_COSINE, LEAST_IDENTIFIER, FILE_SHARE = 0.6, 0.9, 0.5
LICENCE_NAME = r"(?i)(?:^|/)(?:licen[sc]e|copying|unlicense)(?:[.-][^/]*)?$"
#: Kinds of passages that are compared with templates.
WHOLE, SENTENCE, NAME = 0, 1, 2


def _tokens(text):
    return F.array_remove(F.split(F.lower(text), "[^a-z0-9]+"), "")


def _of_kind(kind: int, texts: Column) -> Column:
    return F.transform(texts, lambda t: F.struct(F.lit(kind).alias("kind"), t.alias("text")))


def license_scan(spark: SparkSession, files: DataFrame, templates: list[tuple[str, str]] = TEMPLATES, least: float = LEAST_COSINE, id_col: str = "doc_id", path_col: str = "path", text_col: str = "text") -> DataFrame:
    """One row per row of ``files``: its id, path, own_license, cosine (to its template, 4 digits), license, inherited, and
    license_dir (the directory whose licence file it has the license from).

    Passages to compare are a licence file's whole text (files named as such), the sentences of any text that speak of a
    licence, the title that a licence's text begins with, and identifiers after an SPDX tag. Weights are
    tf * (1 + ln((N + 1) / (df + 1))), df over all N files for the templates' terms; other terms have df 0. A file's own
    license is that of its whole text if that is near enough to a template, else that of its nearest passage (ties: first
    name). A licence file (by name, or with half of its words in such passages) speaks for its directory; a file
    without a license of its own inherits from its nearest ancestor directory that has one (best cosine, then first path).

    Null or blank texts have no license of their own but inherit. A null path is the root's. Null ids and repeated rows are
    kept. Texts of any length are read whole. An empty table gives no rows. Other columns are ignored. DataFrame functions only.
    """
    stage = Stage(spark, "license")
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    path = F.coalesce(F.regexp_replace(F.col(path_col).cast("string"), "^/+", ""), F.lit(""))
    rows = files.select(F.monotonically_increasing_id().alias("row"), F.col(id_col).alias("rid"), path.alias("path"), text.alias("text"))
    low = F.lower("text")
    hinted = F.lit(False)
    for h in HINTS:
        hinted = hinted | low.contains(h)
    none = F.array().cast("array<string>")
    title = F.regexp_extract("text", TITLE, 1)
    found = [
        (WHOLE, F.when(F.col("path").rlike(LICENCE_NAME), F.array("text")).otherwise(none)),
        (SENTENCE, F.when(hinted, F.regexp_extract_all("text", F.lit(HEADER), F.lit(0))).otherwise(none)),
        (SENTENCE, F.when(title != "", F.array(title)).otherwise(none)),
        (NAME, F.when(low.contains("spdx-license-identifier"), F.regexp_extract_all("text", F.lit(IDENTIFIER), F.lit(1))).otherwise(none)),
    ]
    passages = F.concat(*[_of_kind(k, x) for k, x in found])
    named = [(i, n, t, False) for i, (n, t) in enumerate(templates)] + [(len(templates) + i, n, t, True) for i, (n, t) in enumerate(IDENTIFIERS) if n in dict(templates)]
    vocab = spark.createDataFrame(named, "template int, name string, text string, identifier boolean")
    tf = vocab.select("template", "name", "identifier", F.explode(_tokens(F.col("text"))).alias("token")).groupBy("template", "name", "identifier", "token").agg(F.count(F.lit(1)).alias("tf"))
    terms = F.lit(sorted({t for _, _, x, _ in named for t in "".join(c if c.isascii() and c.isalnum() else " " for c in x.lower()).split()}))
    seen = rows.select(
        "row", "rid", "path", passages.alias("passages"), F.array_intersect(_tokens(F.col("text")), terms).alias("terms"), F.regexp_count("text", F.lit("[A-Za-z0-9]+")).alias("n_tokens"),
    )
    seen = stage.cut(seen, "seen")
    n = F.broadcast(seen.agg(F.count(F.lit(1)).alias("n")))
    df = seen.select(F.explode("terms").alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("df"))
    idf = tf.select("token").distinct().join(df, "token", "left").join(n).select("token", (1 + F.log((F.col("n") + 1) / (F.coalesce("df", F.lit(0)) + 1))).alias("idf"))
    idf = stage.cut(idf, "idf")
    known = tf.join(idf, "token").withColumn("w", F.col("tf") * F.col("idf"))
    norms = known.groupBy("template").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    known = stage.cut(known.join(norms, "template").select("template", "name", "identifier", "token", (F.col("w") / F.col("norm")).alias("part")), "templates")

    heads = seen.select("row", "n_tokens", F.posexplode("passages").alias("head", "p")).select("row", "head", "p.kind", "n_tokens", F.explode(_tokens(F.col("p.text"))).alias("token"))
    heads = heads.groupBy("row", "head", "kind", "n_tokens", "token").agg(F.count(F.lit(1)).alias("tf"))
    weights = heads.join(F.broadcast(idf), "token", "left").join(n)  # as many rows as the templates have terms
    weights = weights.withColumn("w", F.col("tf") * F.coalesce("idf", 1 + F.log(F.col("n") + 1)))
    size = weights.groupBy("row", "head", "kind", "n_tokens").agg(F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"), F.sum("tf").alias("head_tokens"))
    dot = weights.join(F.broadcast(known), "token").where(F.col("identifier") == (F.col("kind") == NAME)).groupBy("row", "head", "template", "name").agg(F.sum(F.col("w") * F.col("part")).alias("dot"))
    scored = dot.join(size, ["row", "head"]).withColumn("cosine", F.round(F.col("dot") / F.col("norm"), 4)).where(F.col("cosine") >= F.when(F.col("kind") == NAME, LEAST_IDENTIFIER).otherwise(least))
    per_head = scored.groupBy("row", "head", "kind", "n_tokens", "head_tokens").agg(F.min(F.struct((F.col("kind") != WHOLE).alias("part"), (-F.col("cosine")).alias("c"), "name")).alias("best"))
    said = F.sum(F.when(F.col("kind") == WHOLE, 0).otherwise(F.col("head_tokens")))
    own = per_head.groupBy("row").agg(F.min("best").alias("best"), (said >= FILE_SHARE * F.max("n_tokens")).alias("mostly"))
    own = own.select("row", F.col("best.name").alias("own_license"), (-F.col("best.c")).alias("cosine"), "mostly")
    directory = F.regexp_extract("path", "^(.*)/[^/]*$", 1)
    placed = stage.cut(seen.select("row", "rid", "path", directory.alias("dir")).join(own, "row", "left"), "placed")

    speaks = placed.where(F.col("own_license").isNotNull() & (F.col("mostly") | F.col("path").rlike(LICENCE_NAME)))
    speaks = speaks.groupBy("dir").agg(F.min(F.struct((-F.col("cosine")).alias("c"), "path", "own_license")).alias("b")).select(F.col("dir").alias("license_dir"), F.col("b.own_license").alias("dir_license"))
    dirs = placed.where("own_license is null").select("dir").distinct()
    steps = F.split("dir", "/")
    above = F.transform(F.sequence(F.lit(0), F.size(steps)), lambda i: F.array_join(F.slice(steps, 1, i), "/"))
    nearest = dirs.select("dir", F.posexplode(F.array_distinct(above)).alias("depth", "license_dir")).join(speaks, "license_dir")
    nearest = nearest.groupBy("dir").agg(F.max(F.struct("depth", "license_dir", "dir_license")).alias("b")).select("dir", "b.license_dir", "b.dir_license")
    nearest = stage.cut(nearest, "nearest")  # a row per directory
    out = placed.join(broadcast_if_small(nearest, nearest.count(), 100_000), "dir", "left")
    mine = F.col("own_license").isNotNull()
    return out.select(
        F.col("rid").alias(id_col), "path", "own_license", "cosine", F.coalesce("own_license", "dir_license").alias("license"),
        (~mine & F.col("dir_license").isNotNull()).alias("inherited"), F.when(~mine, F.col("license_dir")).alias("license_dir"),
    )
