"""Licence scans: Dice coefficient of word bigrams against licence templates, in SQL functions only."""

from __future__ import annotations

import math
from collections.abc import Sequence
from functools import reduce
from importlib.resources import files
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lendscope.llm.common import full_text

THRESHOLD = 0.8

#: Notices under which texts and code are commonly published.
NOTICES = (
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                   "compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("MIT", "Released under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
            "documentation files (the \"Software\"), to deal in the Software without restriction, including without "
            "limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the "
            "Software, and to permit persons to whom the Software is furnished to do so, subject to the following "
            "conditions:"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-2.0", "This work is licensed under the GNU General Public License, version 2."),
    ("LGPL-3.0", "This work is licensed under the GNU Lesser General Public License, version 3."),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the MPL "
                "was not distributed with this file, You can obtain one at https://mozilla.org/MPL/2.0/."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:"),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby "
            "granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    ("CC-BY-SA-4.0", "Licensed under CC BY-SA 4.0."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("0BSD", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Apache License Version 2.0, January 2004 http://www.apache.org/licenses/"),
    ("GPL-2.0", "GNU GENERAL PUBLIC LICENSE Version 2, June 1991"),
    ("GPL-3.0", "GNU GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("AGPL-3.0", "GNU AFFERO GENERAL PUBLIC LICENSE Version 3, 19 November 2007"),
    ("LGPL-2.1", "GNU LESSER GENERAL PUBLIC LICENSE Version 2.1, February 1999"),
    ("LGPL-3.0", "GNU LESSER GENERAL PUBLIC LICENSE Version 3, 29 June 2007"),
    ("EPL-2.0", "This program and the accompanying materials are made available under the terms of the Eclipse Public License 2.0 "
                "which is available at https://www.eclipse.org/legal/epl-2.0/"),
    ("EPL-1.0", "All rights reserved. This program and the accompanying materials are made available under the terms of the Eclipse "
                "Public License v1.0 which accompanies this distribution, and is available at http://www.eclipse.org/legal/epl-v10.html"),
    ("BSD", "Use of this source code is governed by a BSD-style license that can be found in the LICENSE file."),
    ("MIT", "Use of this source code is governed by an MIT-style license that can be found in the LICENSE file."),
)
#: The standard header of the GNU licences: the program's kind, the licence, and its versions.
GNU_HEADER = ("This {kind} is free software{sep} you can redistribute it and/or modify it under the terms of the GNU {title} as published by "
              "the Free Software Foundation, either version {version} of the License, or (at your option) any later version.")
GNU_WARRANTY = ("This {kind} is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied warranty of "
                "MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {title} for more details.")
GNU = (("GPL", "General Public License", "program", ("2.0", "3.0")), ("LGPL", "Lesser General Public License", "library", ("2.1", "3.0")),
       ("AGPL", "Affero General Public License", "program", ("3.0",)))
#: Names of licences in notices. A licence without a version is reported without one.
TITLES = {
    "Apache-2.0": ("Apache License, Version 2.0", "Apache License 2.0", "Apache 2.0 License"),
    "MIT": ("MIT License",), "ISC": ("ISC License",), "Zlib": ("zlib License",), "BSL-1.0": ("Boost Software License 1.0", "Boost Software License, Version 1.0"),
    "Unlicense": ("The Unlicense", "Unlicense"), "0BSD": ("Zero-Clause BSD License", "BSD Zero Clause License"),
    "BSD-2-Clause": ("BSD 2-Clause License", "2-Clause BSD License", "Simplified BSD License"),
    "BSD-3-Clause": ("BSD 3-Clause License", "3-Clause BSD License", "New BSD License"), "BSD": ("BSD License",),
    "MPL-2.0": ("Mozilla Public License 2.0", "Mozilla Public License, version 2.0", "Mozilla Public License, v. 2.0"),
    "EPL-1.0": ("Eclipse Public License 1.0", "Eclipse Public License v1.0"), "EPL-2.0": ("Eclipse Public License 2.0", "Eclipse Public License v2.0"),
    "CC0-1.0": ("CC0 1.0 Universal", "Creative Commons Zero v1.0 Universal License"),
    "CC-BY-4.0": ("CC BY 4.0", "Creative Commons Attribution 4.0 International License"),
    "CC-BY-SA-4.0": ("CC BY-SA 4.0", "Creative Commons Attribution-ShareAlike 4.0 International License"),
    "CC-BY-NC-4.0": ("CC BY-NC 4.0", "Creative Commons Attribution-NonCommercial 4.0 International License"),
    "CC-BY-ND-4.0": ("CC BY-ND 4.0", "Creative Commons Attribution-NoDerivatives 4.0 International License"),
    "CC-BY-NC-SA-4.0": ("CC BY-NC-SA 4.0", "Creative Commons Attribution-NonCommercial-ShareAlike 4.0 International License"),
    "CC-BY-NC-ND-4.0": ("CC BY-NC-ND 4.0", "Creative Commons Attribution-NonCommercial-NoDerivatives 4.0 International License"),
    "CC-BY-3.0": ("CC BY 3.0", "Creative Commons Attribution 3.0 Unported License"),
    "CC-BY-SA-3.0": ("CC BY-SA 3.0", "Creative Commons Attribution-ShareAlike 3.0 Unported License"),
}
PHRASES = ("Licensed under the {}", "Released under the {}", "Distributed under the {}", "This project is licensed under the {}",
           "This project is released under the {}", "This work is licensed under the {}", "This work is licensed under a {}",
           "This software is released under the {}", "This code is licensed under {}", "Licensed under {}", "License: {}")
#: Full texts kept beside this module, without copyright lines.
TEXTS = ("0BSD", "Apache-2.0", "BSD-2-Clause", "BSD-3-Clause", "BSL-1.0", "CC0-1.0", "GPL-2.0", "ISC", "LGPL-2.1", "LGPL-3.0", "MIT", "MPL-2.0",
         "Unlicense", "Zlib")


def all_templates() -> tuple[tuple[str, str], ...]:
    """NOTICES, the GNU headers, every phrase with every title, identifier lines and full texts; equal word lists once."""
    found, titles = list(NOTICES), {name: list(known) for name, known in TITLES.items()}
    for short, title, kind, versions in GNU:
        for version in versions:
            name, number = f"{short}-{version}", version.removesuffix(".0")
            for sep in (":", ";"):
                found.append((name, GNU_HEADER.format(kind=kind, sep=sep, title=title, version=number)))
            titles[name] = [f"GNU {title}, version {number}", f"GNU {title}, version {number} or later", f"GNU {title} v{version}", f"GNU {short} v{number}",
                            f"{short}v{number}"]
        found.append((short, GNU_WARRANTY.format(kind=kind, title=title)))
        titles[short] = [f"GNU {title}", f"GNU {short}"]
    for name, known in titles.items():
        for title in known:
            found += [(name, title), *((name, phrase.format(title)) for phrase in PHRASES)]
        found += [(name, f"SPDX-License-Identifier: {name}{rest}") for rest in ("", *(("-only", "-or-later") if "GPL-" in name else ()))]
    found += [(name, files(__package__).joinpath("license_texts", f"{name}.txt").read_text("utf-8")) for name in TEXTS]
    once = {}
    for name, text in found:
        once.setdefault(" ".join("".join(c if c.isalnum() else " " for c in text.lower()).split()), (name, text))
    return tuple(pair for words, pair in once.items() if " " in words)


TEMPLATES = all_templates()
#: Parts of words of which nearly every template has many; a unit without any is compared with the other templates only.
MARKS = ("licen", "public", "creative commons", "gnu ", "permi", "redistribut", "warrant", "copyright")


def normal_lines(text: Column) -> Column:
    """The lines of a text in lower case, words of letters and digits with one space between them."""
    clean = F.regexp_replace(F.lower(text), r"[^\p{L}\p{N}\n]+", " ")
    return F.transform(F.split(clean, "\n"), lambda line: F.trim(line))


def template_words(text: str) -> list[str]:
    return "".join(c if c.isalnum() else " " for c in text.lower()).split()


def size_bounds(bigrams: int, threshold: float) -> range:
    """Sizes at which a Dice coefficient of ``threshold`` is possible at all: 2 min / (a + b) reaches it."""
    low, high = bigrams * threshold / (2 - threshold), bigrams * (2 - threshold) / threshold
    return range(max(1, math.ceil(low - 1e-9)), math.floor(high + 1e-9) + 1)


def license_scan(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    templates: Sequence[tuple[str, str]] = TEMPLATES, threshold: float = THRESHOLD,
) -> DataFrame:
    """One row per line, and per block of several lines, whose best template reaches ``threshold``. A block is a run of
    lines with words, up to a line without any.

    Columns: doc_id, unit ('line' or 'block'), unit_no (from 1: of the line, or among the runs), license, template (its position),
    bigrams, dice. Dice counts repeated bigrams. Of equal coefficients the first template wins. Null and
    empty texts, texts without two words and an empty table give no rows; repeated rows and a null id give rows like others.

    A unit is compared only with templates whose size can reach the threshold: template sizes are spread
    over the admissible numbers of bigrams, which makes an equality join of a fixed, small table. Only units of whose bigrams
    threshold / (2 - threshold) or more occur in some template at all, and which have one word more of templates, come that far. The
    coefficient itself is worked out where enough distinct bigrams are shared for it to reach the threshold. A unit that
    reaches it shares at least threshold / (2 - threshold) of the template's bigrams; templates of which too few lack a mark
    for that (``MARKS``) are kept from units without a mark.
    """
    spark = docs.sparkSession
    sizes, bags = [], []
    for no, (name, text) in enumerate(templates):
        words = template_words(text)
        pairs = [f"{a} {b}" for a, b in zip(words, words[1:])]
        bags.append((no, name, len(pairs), sorted({p: pairs.count(p) for p in pairs}.items()), sorted(set(pairs))))
        unmarked = sum(not any(m in p for m in MARKS) for p in pairs)
        free = unmarked >= math.ceil(len(pairs) * threshold / (2 - threshold) - 1e-9)
        sizes += [(no, n, marked) for n in size_bounds(len(pairs), threshold) for marked in ((True, False) if free else (True,))]
    known = spark.createDataFrame(bags, "template int, license string, own int, bag array<struct<pair:string,n:int>>, distinct array<string>")
    fits = spark.createDataFrame(sizes, "template int, bigrams int, marked boolean")

    def sized(kind: str):
        return lambda words, i: F.struct(
            F.lit(kind).alias("unit"), (i + 1).alias("unit_no"), words.alias("words"),
            (F.length(words) - F.length(F.replace(words, F.lit(" "), F.lit("")))).cast("int").alias("bigrams"))

    low, high = min(n for _, n, _ in sizes), max(n for _, n, _ in sizes)
    lines = docs.select(F.col(id_col).alias("doc_id"), F.monotonically_increasing_id().alias("row_no"),
                        normal_lines(full_text(text_col)).alias("lines"))
    # One step a select, so that each long expression is worked out once.
    runs = lines.select("doc_id", "row_no", F.explode(F.array("lines")).alias("lines")).select(
        "doc_id", "row_no", "lines", F.split(F.trim(F.array_join("lines", "\n"), F.lit("\n")), "\n\n+").alias("runs"))
    inside = lambda u: (u["bigrams"] >= low) & (u["bigrams"] <= high)
    whole = F.transform(F.transform("runs", lambda r, i: F.when(F.contains(r, F.lit("\n")), F.replace(r, F.lit("\n"), F.lit(" "))).otherwise("")),
                        sized("block"))
    units = runs.select("doc_id", "row_no", F.explode(F.concat(
        F.filter(F.transform("lines", sized("line")), inside), F.filter(whole, inside))).alias("u")).select("doc_id", "row_no", "u.*")
    words = F.split("words", " ")
    pairs = F.zip_with(F.slice(words, 1, F.col("bigrams")), F.slice(words, F.lit(2), F.col("bigrams")),
                       lambda a, b: F.concat(a, F.lit(" "), b))
    marked = reduce(or_, [F.contains("words", F.lit(m)) for m in MARKS])
    # Before any template is looked at; template words are letters and digits only.
    some = {"pairs": sorted({p for *_, distinct in bags for p in distinct}), "split(words, ' ')": sorted({w for *_, distinct in bags for p in distinct for w in p.split()})}
    in_some = [f"size(filter({of}, x -> x IN ({', '.join(map(repr, texts))})))" for of, texts in some.items()]
    able = "{1} - 1 >= {2} AND {0} >= {2}".format(*in_some, f"bigrams * {threshold / (2 - threshold)!r}D - 1e-9D")
    close = (units.select("doc_id", "row_no", "unit", "unit_no", "bigrams", marked.alias("marked"), pairs.alias("pairs"))
             .where(able)
             .join(F.broadcast(fits), ["bigrams", "marked"])
             .join(F.broadcast(known), "template"))
    repeats = F.col("own") - F.size("distinct")
    enough = F.size(F.array_intersect("pairs", "distinct")) + repeats >= (F.col("bigrams") + F.col("own")) * (threshold / 2) - 1e-9
    close = close.filter(enough)
    common = F.aggregate(F.col("bag"), F.lit(0), lambda sum_, g: sum_ + F.least(
        F.size(F.filter("pairs", lambda p: p == g["pair"])), g["n"]))
    dice = (common * F.lit(2.0)) / (F.col("bigrams") + F.col("own"))
    found = close.withColumn("dice", dice).filter(F.col("dice") >= threshold)
    best = found.groupBy("doc_id", "row_no", "unit", "unit_no", "bigrams").agg(
        F.max(F.struct("dice", (-F.col("template")).alias("first"), "license")).alias("best"))
    return best.select("doc_id", "unit", "unit_no", "best.license", (-F.col("best.first")).alias("template"),
                       "bigrams", "best.dice")
