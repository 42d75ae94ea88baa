"""License scan: an exact set-similarity join of text blocks with license templates.

Built from DataFrame functions alone.  A block is a line of a document and a
template a short text; a pair is found where at least ``threshold`` of the
template's distinct words stand in the block.

The templates' words are counted in all blocks, which orders them globally from
rare to frequent.  A template of n words that must share k with a block keeps
only its n - k + 1 rarest as a prefix: a block without any of them shares at
most k - 1.  Blocks are joined with templates on prefix words; the length filter
asks for k words in the block, the positional filter bounds the overlap by the
word's place in the template, and the pairs that are left are verified.

Templates are a fixed list of this module or a parameter.  Their words are the
only thing that is sent to the driver or broadcast, so its size does not depend
on the documents.
"""

from __future__ import annotations

import math
import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphlake.llm.common import NON_WORD, ascii_lower, let, text_key, words_of

#: Words that stand consecutively, and the label they give.
PHRASES = {
    "cc by": "cc-by",
    "general public license": "gpl",
    "all rights reserved": "reserved",
}
#: Label of a license, and sentences that announce it.
TEMPLATES = {
    "agpl": ["licensed under the GNU Affero General Public License"],
    "apache-2.0": ["Licensed under the Apache License, Version 2.0", "you may not use this file except in compliance with the License"],
    "bsd": ["Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"],
    "cc-by-4.0": ["This work is licensed under a Creative Commons Attribution 4.0 International License"],
    "cc-by-nc": ["Licensed under CC BY-NC 4.0", "licensed under a Creative Commons Attribution NonCommercial License"],
    "cc-by-sa": ["Licensed under CC BY-SA 4.0", "licensed under a Creative Commons Attribution ShareAlike License"],
    "cc0": ["dedicated to the public domain under CC0 1.0 Universal"],
    "gpl": ["This work is licensed under the GNU General Public License, version 3", "redistribute it and/or modify it under the terms of the GNU General Public License"],
    "isc": ["Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"],
    "lgpl": ["licensed under the GNU Lesser General Public License"],
    "mit": ["Released under the MIT License", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"],
    "mpl-2.0": ["subject to the terms of the Mozilla Public License, v. 2.0"],
    "reserved": ["All rights reserved worldwide"],
}
#: Label, a sentence that announces the license, words that must stand with it, and words that make it another.
NOTICES = [
    ("agpl", "licensed under the GNU Affero General Public License", "affero", ""),
    ("agpl", "modify it under the terms of the GNU Affero General Public License", "affero", ""),
    ("apache-2.0", TEMPLATES["apache-2.0"][0], "apache", ""),
    ("apache-2.0", TEMPLATES["apache-2.0"][1], "compliance", ""),
    ("bsd", TEMPLATES["bsd"][0], "redistribution binary", ""),
    ("cc-by-4.0", TEMPLATES["cc-by-4.0"][0], "creative commons attribution", "noncommercial sharealike noderivatives"),
    ("cc-by-nc", TEMPLATES["cc-by-nc"][0], "cc nc", ""),
    ("cc-by-nc", TEMPLATES["cc-by-nc"][1], "commons noncommercial", ""),
    ("cc-by-sa", TEMPLATES["cc-by-sa"][0], "cc sa", ""),
    ("cc-by-sa", TEMPLATES["cc-by-sa"][1], "commons sharealike", ""),
    ("cc0", TEMPLATES["cc0"][0], "cc0", ""),
    ("gpl", "licensed under the GNU General Public License", "gnu general public", "affero lesser library"),
    ("gpl", TEMPLATES["gpl"][0], "gnu general public", "affero lesser library"),
    ("gpl", TEMPLATES["gpl"][1], "gnu general public", "affero lesser library"),
    ("isc", TEMPLATES["isc"][0], "fee", ""),
    ("lgpl", "licensed under the GNU Lesser General Public License", "lesser", ""),
    ("lgpl", "modify it under the terms of the GNU Lesser General Public License", "lesser", ""),
    ("mit", TEMPLATES["mit"][0], "mit", ""),
    ("mit", TEMPLATES["mit"][1], "charge obtaining", ""),
    ("mpl-2.0", TEMPLATES["mpl-2.0"][0], "mozilla", ""),
    ("reserved", TEMPLATES["reserved"][0], "reserved", ""),
]
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def _template_words(text: str) -> list[str]:
    lowered = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)
    return list(dict.fromkeys(_WORD.findall(lowered)))


def _needed(n: int, threshold: float) -> int:
    return max(1, math.ceil(round(n * threshold, 9)))


def scan_licenses(
    docs: DataFrame,
    templates: dict[str, list[str]] | None = None,
    phrases: dict[str, str] | None = None,
    threshold: float = 0.8,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Base phrases and license templates of each document.

    Returns a row for each row of ``docs``: the id, ``n_words``, ``places`` (an
    array of word position and label, a place where a phrase's words stand
    consecutively each), ``matches`` (an array of label and containment, the best
    of each label whose template meets the threshold in a line) and the columns
    of ``text_key``.

    * Null or empty text has no words, places or matches.
    * Repeated rows get equal results; ids may be null.
    * Other columns are not read, whatever their names.  An empty table gives an
      empty table.
    * A text of any length is read whole.  Of lines that match a label alike the
      containment is the same, so ties are of no matter.
    """
    templates = TEMPLATES if templates is None else templates
    phrases = PHRASES if phrases is None else phrases
    id_, text = F.col(f"`{id_col}`"), F.coalesce(F.col(f"`{text_col}`"), F.lit(""))
    key = text_key(id_, text)
    flat = [(label, w) for label, texts in templates.items() for t in texts if (w := _template_words(t))]

    # n_words and the phrases' places: one scan, no shuffle.
    split = [p.split(" ") for p in phrases]
    labels = list(phrases.values())

    empty = F.array().cast("array<struct<at:bigint,label:string>>")

    def places_of(words: Column, phrase: list[str], label: str) -> Column:
        at = F.filter(
            F.transform(words, lambda x, i: F.when(x == phrase[0], i)),
            lambda i: i.isNotNull() & (F.slice(words, i + 1, len(phrase)) == F.array(*map(F.lit, phrase))),
        )
        found = F.transform(at, lambda i: F.struct(i.cast("long").alias("at"), F.lit(label).alias("label")))
        return F.when(F.array_contains(words, phrase[-1]) & F.array_contains(words, phrase[0]), found).otherwise(empty)

    def places(words: Column) -> Column:
        found = [places_of(words, p, label) for p, label in zip(split, labels, strict=True)]
        return F.struct(F.size(words).cast("long").alias("n_words"), F.concat(empty, *found).alias("places"))

    base = docs.select(*key, id_.alias("__id"), let(words_of(text), places).alias("__b")).select(
        "__key_id", "__key_text", "__id", "__b.n_words", "__b.places"
    )
    none = F.array().cast("array<struct<label:string,containment:double>>")
    if not flat:
        return base.select(F.col("__id").alias(id_col), "n_words", "places", none.alias("matches"), "__key_id", "__key_text")

    vocabulary = sorted({w for _, ws in flat for w in ws})
    blocks = docs.select(*key, F.explode(F.split(text, "\n", -1)).alias("__line"))
    # The global order: how many blocks hold each word of the templates. No more rows than the templates have words.
    counted = (
        blocks.select(F.explode(F.array_intersect(F.split(ascii_lower(F.col("__line")), NON_WORD), F.array(*map(F.lit, vocabulary)))).alias("w"))
        .groupBy("w")
        .count()
    )
    seen = {r["w"]: r["count"] for r in counted.collect()}
    order = {w: i for i, w in enumerate(sorted(vocabulary, key=lambda w: (seen.get(w, 0), w)))}
    rows = []
    for n, (label, ws) in enumerate(flat):
        ws = sorted(ws, key=order.__getitem__)
        need = _needed(len(ws), threshold)
        rows += [(n, label, ws, need, i, w) for i, w in enumerate(ws[: len(ws) - need + 1])]
    prefix = docs.sparkSession.createDataFrame(rows, "__t int, __label string, __words array<string>, __need int, __at int, __w string")
    prefixes = sorted({r[5] for r in rows})
    words = F.array_distinct(words_of(F.col("__line")))
    maybe = blocks.filter(F.arrays_overlap(F.split(ascii_lower(F.col("__line")), NON_WORD), F.array(*map(F.lit, prefixes))))
    probes = maybe.select("__key_id", "__key_text", words.alias("__has")).withColumn(
        "__w", F.explode(F.array_intersect("__has", F.array(*map(F.lit, prefixes))))
    )
    shared = F.size(F.array_intersect("__has", "__words"))
    pairs = (
        probes.join(F.broadcast(prefix), "__w")
        .filter(F.size("__has") >= F.col("__need"))  # length
        .filter(F.size("__words") - F.col("__at") + F.size(F.array_intersect("__has", F.slice("__words", F.lit(1), F.col("__at")))) >= F.col("__need"))  # position
        .withColumn("__shared", shared)
        .filter(F.col("__shared") >= F.col("__need"))
    )
    best = (
        pairs.groupBy("__key_id", "__key_text", "__label")
        .agg(F.max(F.col("__shared") / F.size("__words")).alias("__c"))
        .groupBy("__key_id", "__key_text")
        .agg(F.array_sort(F.collect_list(F.struct(F.col("__label").alias("label"), F.col("__c").alias("containment")))).alias("matches"))
    )
    return base.join(best, ["__key_id", "__key_text"], "left").select(
        F.col("__id").alias(id_col), "n_words", "places", F.coalesce("matches", none).alias("matches"), "__key_id", "__key_text"
    )


def scan_notices(docs: DataFrame, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """License notices of each document, wherever its lines end.

    Returns the id, ``n_words`` and ``matches``: label and containment of the
    licenses of which a notice has at least ``threshold`` of its distinct words
    in as many consecutive words as it is long, with all words that it must have
    and none that make it another license. Only documents that hold so many of a
    notice's words anywhere are looked through; nothing is shuffled.

    * Null or empty text has no words or matches.
    * Repeated rows get equal results; ids may be null; no rows give no rows.
    * Other columns are not read.  A text of any length is read whole.
    """
    kind = "array<struct<label:string,containment:double>>"
    array = lambda ws: F.array(*map(F.lit, ws))

    def notice(words: Column, held: Column, label: str, text: str, must: str, never: str) -> Column:
        own = _template_words(text)
        n, need = len(_WORD.findall(text.lower())), _needed(len(own), threshold)
        asked, other = must.split(), never.split()
        rare = [F.array_contains(held, w) for w in asked]

        def best(at: Column) -> Column:
            window = F.slice(words, at + 1, n)
            fits = F.size(F.array_intersect(window, array(asked))) == len(asked)
            if other:
                fits = fits & ~F.arrays_overlap(window, array(other))
            shared = F.size(F.array_intersect(window, array(own)))
            return F.when(fits & (shared >= need), shared / len(own))

        # The best window can be moved on to begin at a word of the notice.
        starts = F.filter(F.transform(words, lambda w, i: F.when(w.isin(own), i)), lambda i: i.isNotNull())
        most = F.array_max(F.transform(starts, best))
        found = F.filter(F.array(F.struct(F.lit(label).alias("label"), most.alias("containment"))), lambda m: m["containment"].isNotNull())
        for has in rare:
            found = F.when(has, found)
        return F.coalesce(F.when(F.size(F.array_intersect(held, array(own))) >= need, found), F.array().cast(kind))

    vocabulary = sorted({w for _, text, must, _ in NOTICES for w in [*_template_words(text), *must.split()]})

    def merged(every: Column) -> Column:
        labels = F.array_sort(F.array_distinct(F.transform(every, lambda m: m["label"])))
        best = lambda x: F.array_max(F.transform(F.filter(every, lambda m: m["label"] == x), lambda m: m["containment"]))
        return F.transform(labels, lambda x: F.struct(x.alias("label"), best(x).alias("containment")))

    def scanned(words: Column) -> Column:
        def of(held: Column) -> Column:
            every = F.concat(*[notice(words, held, *x) for x in NOTICES])
            return F.when(F.size(held) > 2, let(every, merged)).otherwise(F.array().cast(kind))

        return F.struct(F.size(words).cast("long").alias("n_words"), let(F.array_intersect(words, array(vocabulary)), of).alias("matches"))

    read = docs.select(F.col(f"`{id_col}`").alias(id_col), let(words_of(F.col(f"`{text_col}`")), scanned).alias("__s"))
    return read.select(id_col, "__s.n_words", "__s.matches")
