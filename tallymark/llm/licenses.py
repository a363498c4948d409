"""License scans: an exact set-similarity join of text blocks with license templates.

A block is a line of a text, or any run of a template's number of words, so that notices wrapped
over lines are found; a template is the set of a notice's words.  A pair is found if the
block holds at least ``threshold`` of the template's words.  Words of templates are put into one
global order, rare ones first, by the number of texts that hold them, counted over the whole
corpus.  A template's prefix are its first words in that order, as many as can be missing and one
more: a block that reaches the threshold holds one of them.  Blocks are probed against an index from
prefix words to templates, thinned by the length filter and by the positional filter, and the
survivors are verified on full sets.

The templates are few and given as a parameter; they, their index and their order travel as
literals, so rows are neither shuffled nor joined.  Only DataFrame functions are used.  The corpus is
read once: what the order needs and what later steps need is written in that pass.

Defined results: a null text is empty and has no words; a text of any length is read whole; ties
and repeated rows are scanned each alike; phrase places may overlap; an empty table gives an empty
table; other columns than the id and text columns are not read.
"""

from __future__ import annotations

import math
import string

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import only, written

#: Phrases whose places are counted, with their labels (fixed values).
PHRASES = {"under the mit license": "mit", "apache license version 2": "apache-2", "cc by nc": "cc-by-nc"}

#: Notices as they are commonly printed, with their labels.
TEMPLATES = [
    ("mit", "released under the mit license"),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files"),
    ("apache-2", "licensed under the apache license version 2 0"),
    ("apache-2", "you may not use this file except in compliance with the license you may obtain a copy of the license at"),
    ("cc-by-nc", "licensed under cc by nc 4 0"),
    ("cc-by", "this work is licensed under a creative commons attribution 4 0 international license"),
    ("gpl-3", "this work is licensed under the gnu general public license version 3"),
    ("gpl", "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license"),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met"),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl-2", "this source code form is subject to the terms of the mozilla public license v 2 0"),
    ("gpl-2", "gnu general public license as published by the free software foundation either version 2 of the license or at your option any later version"),
    ("gpl-3", "gnu general public license as published by the free software foundation either version 3 of the license or at your option any later version"),
    ("lgpl", "this library is free software you can redistribute it and or modify it under the terms of the gnu lesser general public license"),
    ("agpl", "under the terms of the gnu affero general public license as published by the free software foundation"),
    ("bsd-3", "neither the name of the copyright holder nor the names of its contributors may be used to endorse or promote products derived from this software without specific prior written permission"),
    ("epl-2", "this program and the accompanying materials are made available under the terms of the eclipse public license"),
    ("zlib", "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software"),
    ("bsl-1", "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license"),
    ("postgresql", "permission to use copy modify and distribute this software and its documentation for any purpose without fee and without a written agreement is hereby granted"),
    ("ofl-1.1", "this font software is licensed under the sil open font license version 1 1"),
    ("cc0", "to the extent possible under law the author has waived all copyright and related or neighboring rights to this work"),
    ("unlicense", "this is free and unencumbered software released into the public domain"),
]

#: Words that tell a template from its likes: one that has any of its label's is held only with all of them.
NAMING = {
    "mit": {"mit", "associated", "files"}, "apache-2": {"apache"}, "cc-by-nc": {"cc", "nc"}, "cc-by": {"creative", "commons"}, "cc0": {"waived"},
    "gpl": {"gnu", "program"}, "gpl-2": {"gnu", "2"}, "gpl-3": {"gnu", "3"}, "lgpl": {"lesser"}, "agpl": {"affero"}, "mpl-2": {"mozilla"}, "epl-2": {"eclipse"},
    "isc": {"or", "with"}, "postgresql": {"written", "agreement"}, "bsl-1": {"organization", "accompanying"}, "ofl-1.1": {"sil", "font"}, "unlicense": {"unencumbered"},
}

NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def spaced(text: Column) -> Column:
    """The words of a text, each between two blanks of its own; empty if there are none."""
    lower = F.translate(text, string.ascii_uppercase, string.ascii_lowercase)
    joined = F.trim(F.regexp_replace(lower, NOT_WORD, "  "))
    return F.when(joined == "", F.lit("")).otherwise(F.concat(F.lit(" "), joined, F.lit(" ")))


def _count(text: Column, part: str | Column) -> Column:
    part = F.lit(part) if isinstance(part, str) else part
    return ((F.length(text) - F.length(F.replace(text, part, F.lit("")))) / F.length(part)).cast("long")


def _words_in(text: Column) -> Column:
    return (_count(text, " ") / 2).cast("long")


def _wrapped(phrase: str) -> str:
    return "".join(f" {w} " for w in phrase.split())


def _overlaps(phrase: str) -> bool:
    """Whether a place of the phrase can begin within another one: some end of it is a beginning."""
    words = phrase.split()
    return any(words[:n] == words[len(words) - n :] for n in range(1, len(words)))


def phrase_places(text: Column, phrase: str) -> tuple[Column, Column, Column]:
    """Number of places, first and last place (in words from 0, else null) in a spaced text."""
    part = _wrapped(phrase)
    found = F.contains(text, F.lit(part))
    # a look ahead takes no signs, so overlapping places count, too
    places = F.regexp_count(text, F.lit(f"(?=\\Q{part}\\E)")).cast("long") if _overlaps(phrase) else _count(text, part)
    before = F.substring_index(text, part, 1)
    after = F.substring_index(text, part, -1)
    last = F.left(text, F.length(text) - F.length(after) - F.lit(len(part)))
    return F.when(found, places).otherwise(F.lit(0)).cast("long"), F.when(found, _words_in(before)), F.when(found, _words_in(last))


def word_order(held: DataFrame, words: list[str]) -> list[str]:
    """Template words, the rarest over all texts first (ties by the word), from the words that each text
    holds (``held``).  A row per template word reaches the driver."""
    seen = {r["word"]: r["count"] for r in held.select(F.explode("held").alias("word")).groupBy("word").count().collect()}
    return sorted(words, key=lambda w: (seen.get(w, 0), w))


def _ordered(templates: list[tuple[str, str]], order: list[str], threshold: float) -> tuple[list[list[str]], list[int], dict[str, list[tuple[int, int]]]]:
    """Template sets in global order, the words each needs, and the index of their prefixes."""
    place = {w: i for i, w in enumerate(order)}
    sets = [sorted(set(words.split()), key=place.__getitem__) for _, words in templates]
    need = [max(1, math.ceil(threshold * len(s) - 1e-9)) for s in sets]
    index: dict[str, list[tuple[int, int]]] = {}
    for t, (words, n) in enumerate(zip(sets, need, strict=True)):
        for i, w in enumerate(words[: len(words) - n + 1]):
            index.setdefault(w, []).append((t, i))
    return sets, need, index


def _naming(template: tuple[str, str]) -> Column:
    """The words of a template that must not be missing."""
    label, words = template
    return F.lit(sorted(NAMING.get(label, set()) & set(words.split()))).cast("array<string>")


def _named(row: Column, own: Column) -> Column:
    return F.size(F.array_except(row["naming"], own)) == 0


def block_hits(blocks: Column, templates: list[tuple[str, str]], order: list[str], threshold: float) -> Column:
    """For an array of spaced blocks the array of (label, containment) of all pairs that reach the threshold."""
    place = {w: i for i, w in enumerate(order)}
    sets, need, index = _ordered(templates, order, threshold)

    def array(values: list, of) -> Column:
        return F.array(*[of(v) for v in values])

    probe = F.create_map(*[x for w, hits in index.items() for x in (F.lit(w), array(hits, lambda h: F.struct(F.lit(h[0]).alias("t"), F.lit(h[1]).alias("i"))))])
    table = array(list(zip(templates, sets, need, strict=True)), lambda x: F.struct(F.lit(x[0][0]).alias("label"), F.lit(x[1]).alias("words"), F.lit(x[2]).alias("need"), _naming(x[0]).alias("naming")))
    prefix = F.lit(sorted(index, key=place.__getitem__))

    def held(block: Column) -> Column:
        return F.array_intersect(F.lit(order), F.split(block, "  ?"))  # in global order

    def pairs(own: Column) -> Column:
        """Candidates of a block's template words, after the length and positional filters."""

        def thin(word: Column) -> Column:
            j = F.array_position(own, word).cast("int") - 1

            def fits(hit: Column) -> Column:
                row = F.get(table, hit["t"])
                rest = F.least(F.size(row["words"]) - hit["i"], F.size(own) - j)
                return (F.size(own) >= row["need"]) & (F.least(hit["i"], j) + rest >= row["need"])

            return F.transform(F.filter(F.element_at(probe, word), fits), lambda h: h["t"])

        return F.array_distinct(F.flatten(F.transform(F.array_intersect(own, prefix), thin)))

    def verified(own: Column) -> Column:
        rows = F.transform(pairs(own), lambda t: F.get(table, t))
        shared = lambda row: F.size(F.array_intersect(row["words"], own))
        return F.transform(F.filter(rows, lambda row: (shared(row) >= row["need"]) & _named(row, own)), lambda row: F.struct(row["label"].alias("label"), (shared(row) / F.size(row["words"])).alias("held")))

    return F.flatten(F.transform(F.transform(blocks, held), verified))


def window_hits(text: Column, templates: list[tuple[str, str]], order: list[str], threshold: float) -> Column:
    """For a spaced text the array of (label, containment) of the templates that some run of their
    number of words holds: runs that reach the threshold hold a prefix word, so only those around
    a prefix word are looked at."""
    sets, need, index = _ordered(templates, order, threshold)
    rows = [F.struct(F.lit(label).alias("label"), F.lit(own).alias("words"), F.lit(n).alias("need"), F.lit(len(words.split())).alias("run"), _naming((label, words)).alias("naming")) for (label, words), own, n in zip(templates, sets, need, strict=True)]
    probe = F.create_map(*[x for w, hits in index.items() for x in (F.lit(w), F.array(*[rows[t] for t, _ in hits]))])

    def near(words: Column, word: Column, at: Column) -> Column:
        """The templates with this prefix word, and the words that runs through it can reach."""

        def cut(row: Column) -> Column:
            start = F.greatest(at - row["run"] + 1, F.lit(0))
            return F.struct(row.alias("row"), F.slice(words, start + 1, at + row["run"] - start).alias("near"))

        return F.transform(F.element_at(probe, word), cut)

    def shared(row: Column, part: Column) -> Column:
        return F.size(F.array_intersect(row["words"], part))

    def best(row: Column, part: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(part) - row["run"] + 1, F.lit(1)))
        runs = F.filter(F.transform(starts, lambda s: F.slice(part, s, row["run"])), lambda run: _named(row, run))
        return F.array_max(F.transform(runs, lambda run: shared(row, run)))

    def reached(words: Column) -> Column:
        places = F.filter(F.transform(words, lambda w, i: F.when(w.isin(list(index)), F.struct(w.alias("w"), i.alias("i")))), lambda p: p.isNotNull())
        return F.flatten(F.transform(places, lambda p: F.filter(near(words, p["w"], p["i"]), lambda c: shared(c["row"], c["near"]) >= c["row"]["need"])))

    # a variable of a lambda is split once, not for every place
    split = F.array(F.split(F.trim(text), "  "))
    found = F.transform(F.array_distinct(F.flatten(F.transform(split, reached))), lambda c: F.struct(c["row"].alias("row"), best(c["row"], c["near"]).alias("n")))
    return F.transform(F.filter(found, lambda f: f["n"] >= f["row"]["need"]), lambda f: F.struct(f["row"]["label"].alias("label"), (f["n"] / F.size(f["row"]["words"])).alias("held")))


def _least(words: str, threshold: float) -> int:
    return max(1, math.ceil(threshold * len(set(words.split())) - 1e-9))


def scan(docs: DataFrame, templates: list[tuple[str, str]] | None = None, phrases: dict[str, str] | None = None, threshold: float = 0.8, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``id_col, n_words, n_base, first_word, last_word, base_labels, labels, score``.

    ``base_labels`` are the labels of the phrases found, ``labels`` those and the labels of all
    templates that a line or a run of words holds; ``score`` is the largest containment (1 for a phrase).

    The texts are read once: words and phrases are counted, and a text stays in the written table
    only if it holds enough words of some template as a whole, as it must if a block of it does.
    """
    templates, phrases = templates if templates is not None else TEMPLATES, phrases if phrases is not None else PHRASES
    words = sorted({w for _, t in templates for w in t.split()})
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = only(docs, id_col, text_col).select(F.col(f"`{id_col}`").alias("id"), text.alias("whole"), spaced(text).alias("t"))
    places = [(label, *phrase_places(F.col("t"), phrase)) for phrase, label in phrases.items()]
    base = F.array(*[F.struct(F.lit(label).alias("label"), n.alias("n"), a.alias("a"), b.alias("b")) for label, n, a, b in places])
    own = F.array_intersect(F.lit(words).cast("array<string>"), F.split(F.trim("t"), "  "))
    rows = rows.select("id", "whole", _words_in(F.col("t")).alias("n_words"), base.alias("base"), own.alias("held"))
    table = F.array(*[F.struct(F.lit(sorted(set(t.split()))).alias("words"), F.lit(_least(t, threshold)).alias("need"), _naming((label, t)).alias("naming")) for label, t in templates])
    enough = F.exists(table, lambda row: (F.size(F.array_intersect(row["words"], F.col("held"))) >= row["need"]) & _named(row, F.col("held"))) if templates else F.lit(False)
    rows = written(rows.withColumn("whole", F.when(enough, F.col("whole"))), "licenses")
    hits = F.lit([]).cast("array<struct<label:string,held:double>>")
    if templates:
        order = word_order(rows, words)
        lines = F.transform(F.split("whole", "[\n\r]+"), spaced)
        # a run within one line is part of that line's block
        wrapped = F.when(F.rlike(F.trim("whole"), F.lit("[\n\r]")), window_hits(spaced(F.col("whole")), templates, order, threshold)).otherwise(hits)
        hits = F.when(F.col("whole").isNotNull(), F.concat(block_hits(lines, templates, order, threshold), wrapped)).otherwise(hits)
    rows = rows.select("id", "n_words", "base", hits.alias("hits"))
    found = F.filter("base", lambda p: p["n"] > 0)
    base = F.array_sort(F.array_distinct(F.transform(found, lambda p: p["label"])))
    labels = F.array_sort(F.array_union(base, F.array_distinct(F.transform("hits", lambda h: h["label"]))))
    return rows.select(
        F.col("id").alias(id_col),
        "n_words",
        F.aggregate("base", F.lit(0).cast("long"), lambda n, p: n + p["n"]).alias("n_base"),
        F.array_min(F.transform(found, lambda p: p["a"])).alias("first_word"),
        F.array_max(F.transform(found, lambda p: p["b"])).alias("last_word"),
        F.array_join(base, ",").alias("base_labels"),
        F.array_join(labels, ",").alias("labels"),
        F.greatest(F.when(F.size(found) > 0, F.lit(1.0)).otherwise(F.lit(0.0)), F.coalesce(F.array_max(F.transform("hits", lambda h: h["held"])), F.lit(0.0))).alias("score"),
    )
