"""License scans with a positional rare-token index, in DataFrame operations only.

Licence texts are word templates with a mandatory key phrase.  Key phrases may stand with some words replaced: one in every EDITED.  The inverted index
holds, of each key phrase, the places whose words have the highest inverse document frequency over the whole corpus: two more than may be
replaced.  A document's licence words are those of the index; their postings are looked up where they stand, and a place in the document less a posting's
place proposes a start of the template.  Starts that enough of a template's rare words agree on (all but those that may be replaced) are kept, so no notice is
lost, and no template is tried on a document that lacks them.

A start counts when its key phrase is verified word by word, when no word of denial stands in the DENIED words before the notice (its words before the phrase count to twice as many), and when enough of the template's words
stand about it where they would (give or take a tenth of its length): NAME_SHARE for phrases of fewer than NAME words, which are names rather than
grants, and EDITED_SHARE where words of the phrase are replaced.  All other words of a template count in the score alone.

Null and empty texts have no words.  Extra columns are ignored; repeated rows are
scanned each for themselves, whatever their doc_id.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Label and phrase of the base rules.
BASE = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
#: Label, licence text or notice, and its mandatory key phrase, as lower-case words.
TEMPLATES = [
    ("mit", "released under the mit license", "the mit license"),
    (
        "mit",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without restriction "
        "including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the software is furnished to do so "
        "subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions of the software "
        "the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a particular purpose and noninfringement",
        "permission is hereby granted free of charge",
    ),
    ("apache-2", "licensed under the apache license version 2 0", "apache license version 2"),
    (
        "apache-2",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
        "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without warranties or conditions of any kind either express or implied "
        "see the license for the specific language governing permissions and limitations under the license",
        "apache license version 2",
    ),
    ("cc-by-nc", "licensed under cc by nc 4 0", "cc by nc"),
    ("cc-by-sa", "licensed under cc by sa 4 0", "cc by sa"),
    ("cc-by", "licensed under cc by 4 0", "cc by 4 0"),
    ("cc-by", "this work is licensed under the creative commons attribution 4 0 international license", "creative commons attribution 4 0"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work under cc0 1 0 universal", "waived all copyright and related or neighboring rights"),
    ("gpl-3", "licensed under the gnu general public license version 3", "gnu general public license version 3"),
    ("gpl-2", "licensed under the gnu general public license version 2", "gnu general public license version 2"),
    (
        "gpl",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version of the license or at your option any later version this program is distributed in the hope that it will be useful but without any warranty without even the implied warranty of "
        "merchantability or fitness for a particular purpose see the gnu general public license for more details you should have received a copy of the gnu general public license along with this program",
        "terms of the gnu general public license as published by the free software foundation",
    ),
    ("lgpl", "under the terms of the gnu lesser general public license", "gnu lesser general public license"),
    ("agpl-3", "under the gnu affero general public license version 3", "gnu affero general public license"),
    (
        "mpl-2",
        "this source code form is subject to the terms of the mozilla public license v 2 0 if a copy of the mpl was not distributed with this file you can obtain one at https mozilla org mpl 2 0",
        "mozilla public license",
    ),
    (
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met redistributions of source code must retain the above "
        "copyright notice this list of conditions and the following disclaimer redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in "
        "the documentation and or other materials provided with the distribution",
        "redistribution and use in source and binary forms",
    ),
    (
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission notice appear in all copies "
        "the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of merchantability and fitness",
        "permission to use copy modify and or distribute this software for any purpose",
    ),
    (
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        "permission is granted to anyone to use this software for any purpose",
    ),
    (
        "boost",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software to use reproduce display "
        "distribute execute and transmit the software and to prepare derivative works of the software",
        "permission is hereby granted free of charge to any person or organization",
    ),
    (
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code form or as a compiled binary "
        "for any purpose commercial or non commercial and by any means",
        "free and unencumbered software released into the public domain",
    ),
    ("cc-by-nd", "licensed under cc by nd 4 0", "cc by nd"),
    ("cc-by-nc-sa", "licensed under cc by nc sa 4 0", "cc by nc sa"),
    ("cc-by-nc-nd", "licensed under cc by nc nd 4 0", "cc by nc nd"),
    ("cc-by-sa", "this work is licensed under the creative commons attribution sharealike 4 0 international license", "creative commons attribution sharealike 4 0"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license 2 0 which is available at https www eclipse org legal epl 2 0", "eclipse public license"),
    ("ofl", "this font software is licensed under the sil open font license version 1 1", "sil open font license version 1 1"),
    ("artistic-2", "this library is free software you can redistribute it and or modify it under the terms of the artistic license 2 0", "under the terms of the artistic license"),
    ("eupl", "licensed under the eupl version 1 2 or as soon they will be approved by the european commission subsequent versions of the eupl", "licensed under the eupl version 1 2"),
]
#: One word in so many of a key phrase may be replaced (shorter ones are names and versions); phrases of fewer than NAME words are names alone; how many words before a notice may deny it;
#: the shares of a template's words that a name and an edited phrase need.
EDITED, NAME, DENIED, NAME_SHARE, EDITED_SHARE = 8, 6, 4, 0.6, 0.5
#: Words that deny what follows.
DENIALS = ["not", "never", "nor", "neither", "cannot", "isn", "don", "doesn", "won", "wasn", "aren"]
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
SEPARATORS = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def vocabulary() -> list[str]:
    """The words of the index."""
    return sorted({w for _, _, key in TEMPLATES for w in key.split()})


def lowered(text: Column) -> Column:
    """A-Z in lower case, nothing else changed; pure ASCII takes the fast way."""
    ascii_only = F.octet_length(text) == F.char_length(text)
    return F.when(ascii_only, F.lower(text)).otherwise(F.translate(text, UPPER, LOWER))


def _phrase(words: str) -> str:
    return "".join(f" {w} " for w in words.split())


def _spread(text: Column) -> Column:
    """The words, each between two spaces of its own, so that phrases that follow each other don't share one."""
    inner = F.trim(F.regexp_replace(lowered(text), SEPARATORS, "  "))
    return F.coalesce(F.concat(F.lit(" "), F.nullif(inner, F.lit("")), F.lit(" ")), F.lit(""))


def _words(spread: Column) -> Column:
    return ((F.length(spread) - F.length(F.replace(spread, F.lit("  "), F.lit(" ")))) + F.when(spread == "", 0).otherwise(1)).cast("long")


def _places(spread: Column, phrase: str) -> Column:
    return ((F.length(spread) - F.length(F.replace(spread, F.lit(phrase), F.lit("")))) / len(phrase)).cast("long")


def frequencies(words: DataFrame) -> dict[str, float]:
    """Inverse document frequency of each template word over all rows of words (bag array<string>); a row for each word goes to the driver.

    Every row also counts for the empty word, which gives their number.
    """
    found = words.select(F.explode(F.concat(F.array(F.lit("")), "bag")).alias("w")).groupBy("w").agg(F.count("*").alias("n")).collect()
    n = {r["w"]: r["n"] for r in found}
    from math import log

    return {w: log((1 + n.get("", 0)) / (1 + n.get(w, 0))) for w in vocabulary()}


def _literals(words: list[str]) -> Column:
    return F.array(*[F.lit(w) for w in words])


def _starts(phrase: str) -> Column:
    """Where the words of a phrase stand consecutively in `words`."""
    p = phrase.split()
    at = F.filter(F.sequence(F.lit(0), F.greatest(F.size("words") - len(p), F.lit(0))), lambda i: F.slice(F.col("words"), i + 1, F.lit(len(p))) == _literals(p))
    return F.when(F.contains(F.col("s"), F.lit(_phrase(phrase))), at).otherwise(F.array().cast("array<int>"))


def allowed(key: str) -> int:
    """How many words of a key phrase may be replaced."""
    return len(key.split()) // EDITED


def rare_places(key: str, order: list[str]) -> list[int]:
    """The places of a key phrase that are looked up: those of its rarest words, two more than may be replaced."""
    words = key.split()
    return sorted(range(len(words)), key=lambda o: (order.index(words[o]), o))[: allowed(key) + 2]


def _index(order: list[str]) -> tuple[Column, Column]:
    """The inverted index, word to postings (t: template, o: place), and the templates: label, key phrase, distinct words, how many starts must agree, how many words may be replaced."""
    postings: dict[str, list[Column]] = {}
    templates = []
    for t, (label, text, key) in enumerate(TEMPLATES):
        words, phrase, places = text.split(), key.split(), rare_places(key, order)
        shift = next(i for i in range(len(words)) if words[i : i + len(phrase)] == phrase)
        for o in places:
            postings.setdefault(phrase[o], []).append(F.struct(F.lit(t).alias("t"), F.lit(o).alias("o")))
        templates.append(F.struct(
            F.lit(label).alias("label"), _literals(phrase).alias("key"), _literals(sorted(set(words))).alias("words"), F.lit(len(words)).alias("n"), F.lit(shift).alias("shift"),
            F.lit(len(places) - allowed(key)).alias("need"), F.lit(allowed(key)).alias("allowed"), F.lit(NAME_SHARE if len(phrase) < NAME else 0.0).alias("least"),
        ))
    return F.create_map(*[x for w in sorted(postings) for x in (F.lit(w), F.array(*postings[w]))]), F.array(*templates)


def _with_hits(frame: DataFrame, order: list[str]) -> DataFrame:
    """frame (words) with `hits`: label and share of each place where a template's key phrase is verified.

    Each step is a column of its own, so that it is made once for a row.
    """
    index, templates = _index(order)
    looked_up = sorted({key.split()[o] for _, _, key in TEMPLATES for o in rare_places(key, order)}, key=order.index)
    frame = frame.withColumn("bag", F.array_intersect(_literals(looked_up), F.col("words")))
    some, template = F.size("bag") > 1, lambda t: F.get(templates, t)
    places = F.filter(F.transform("words", lambda w, i: F.struct(w.alias("w"), i.alias("i"))), lambda x: F.array_contains(F.col("bag"), x["w"]))
    frame = frame.withColumn("places", F.when(some, places))
    proposed = F.flatten(F.transform("places", lambda x: F.transform(index[x["w"]], lambda p: F.struct(p["t"].alias("t"), (x["i"] - p["o"]).alias("s")))))
    frame = frame.withColumn("proposed", F.when(some, F.array_sort(F.filter(proposed, lambda x: x["s"] >= 0))))
    nothing = F.struct(F.lit(-1).alias("t"), F.lit(-1).alias("s"), F.lit(0).alias("n"), F.array().cast("array<struct<t:int,s:int>>").alias("met"))

    def agree(acc: Column, x: Column) -> Column:
        n = F.when((acc["t"] == x["t"]) & (acc["s"] == x["s"]), acc["n"] + 1).otherwise(F.lit(1))
        met = F.when(n == template(x["t"])["need"], F.concat(acc["met"], F.array(x))).otherwise(acc["met"])
        return F.struct(x["t"].alias("t"), x["s"].alias("s"), n.alias("n"), met.alias("met"))

    frame = frame.withColumn("met", F.when(some, F.aggregate("proposed", nothing, agree)["met"]))

    def judged(x: Column) -> Column:
        t, s = template(x["t"]), x["s"]
        there = F.slice("words", s + 1, F.size(t["key"]))
        replaced = F.size(F.filter(F.zip_with(there, t["key"], lambda a, b: a != b), lambda off: off)) + F.size(t["key"]) - F.size(there)
        slack = (t["n"] / 10).cast("int")
        first = F.greatest(s - t["shift"] - slack, F.lit(0))
        near = F.slice("words", first + 1, s - t["shift"] + t["n"] + slack - first)
        share = F.size(F.array_intersect(t["words"], near)) / F.size(t["words"])
        reach = F.least(t["shift"], F.lit(2 * DENIED)) + DENIED
        before = F.slice("words", F.greatest(s - reach, F.lit(0)) + 1, F.least(s, reach))
        least = F.when(replaced > 0, F.greatest(t["least"], F.lit(EDITED_SHARE))).otherwise(t["least"])
        good = (F.size(there) > 0) & (replaced <= t["allowed"]) & (share >= least) & (F.size(F.array_intersect(before, _literals(DENIALS))) == 0)
        return F.struct(t["label"].alias("label"), share.alias("share"), good.alias("good"))

    return frame.withColumn("hits", F.when(some, F.filter(F.transform("met", judged), lambda h: h["good"])))


def scan(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) -> doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score; one row for each row of docs.

    labels: base labels and those whose template was found; score: 1 for a base phrase, else the largest
    share of a found template's words, else 0.
    """
    spread = docs.select(F.col("doc_id").cast("long").alias("doc_id"), _spread(F.coalesce(F.col("text").cast("string"), F.lit(""))).alias("s"))
    words = F.when(F.length("s") > 0, F.split(F.trim("s"), "  ")).otherwise(F.array().cast("array<string>"))
    names = vocabulary()
    idf = frequencies(spread.select(F.array_intersect(words, _literals(names)).alias("bag")))
    # highest inverse document frequency first, then by the alphabet
    order = sorted(names, key=lambda w: (-idf[w], w))
    base = spread.withColumn("words", words)
    starts = F.array().cast("array<int>")
    found_base = []
    for label, phrase in BASE:
        base = base.withColumn(f"at_{label}", _starts(phrase))
        starts = F.concat(starts, F.col(f"at_{label}"))
        found_base.append(F.when(F.size(f"at_{label}") > 0, F.lit(label)))
    base = _with_hits(base.withColumn("starts", starts), order)
    base_labels = F.array_sort(F.array_compact(F.array(*found_base)))
    labels = F.array_sort(F.array_union(base_labels, F.coalesce(F.transform("hits", lambda h: h["label"]), F.array().cast("array<string>"))))
    return base.select(
        "doc_id",
        _words(F.col("s")).alias("n_words"),
        F.size("starts").cast("long").alias("n_base"),
        F.array_min("starts").cast("long").alias("first_word"),
        F.array_max("starts").cast("long").alias("last_word"),
        F.array_join(base_labels, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.when(F.size("starts") > 0, F.lit(1.0)).otherwise(F.coalesce(F.array_max(F.transform("hits", lambda h: h["share"])), F.lit(0.0))).alias("score"),
    )
