"""License scan with a positional index of rare licence words, in DataFrame operations.

Licence templates are indexed word by word: word -> (template, position). Of each template the key-phrase words with the
highest inverse document frequency are looked up in the file. A look-up votes for (template, position in file - position in
template); votes that agree on both put the template at one place of the file. Every such place is verified: the mandatory
key phrases must stand in the file at their relative positions. A key phrase that stands in full always has these votes, so
no template can crowd out another.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import any_of, cut, fold_ascii, fresh, read

WORD = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

# Phrases whose places are counted, with their labels.
PHRASES = [
    ("gnu general public license", "gpl"),
    ("apache license", "apache"),
    ("cc by", "cc-by"),
    ("mit license", "mit"),
]

# Licence templates (label, words, mandatory key phrases).
TEMPLATES = [
    ("agpl", "gnu affero general public license", ["affero general public license"]),
    ("apache-2.0", "licensed under the apache license version 2 0", ["apache license version 2"]),
    ("apache-2.0",
     "you may not use this file except in compliance with the license you may obtain a copy of the license at http www apache org licenses license 2 0 "
     "unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis without "
     "warranties or conditions of any kind either express or implied",
     ["in compliance with the license", "unless required by applicable law or agreed to in writing", "warranties or conditions of any kind"]),
    ("bsd", "redistribution and use in source and binary forms with or without modification are permitted", ["source and binary forms"]),
    ("bsd",
     "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
     "1 redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
     "2 redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation",
     ["source and binary forms", "must retain the above copyright notice", "must reproduce the above copyright notice"]),
    ("cc-by", "creative commons attribution 4 0 international license", ["creative commons attribution"]),
    ("cc-by-nc", "licensed under cc by nc 4 0", ["cc by nc"]),
    ("cc-by-sa", "licensed under cc by sa 4 0", ["cc by sa"]),
    ("cc0", "creative commons zero public domain dedication", ["public domain dedication"]),
    ("gpl-3.0", "licensed under the gnu general public license version 3", ["gnu general public license version 3"]),
    ("gpl-2.0", "licensed under the gnu general public license version 2", ["gnu general public license version 2"]),
    ("gpl",
     "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free "
     "software foundation",
     ["redistribute it and or modify it under the terms", "gnu general public license as published"]),
    ("isc", "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted", ["with or without fee is hereby granted"]),
    ("lgpl", "gnu lesser general public license", ["lesser general public license"]),
    ("mit", "permission is hereby granted free of charge to any person obtaining a copy of this software", ["free of charge to any person"]),
    ("mit", "released under the mit license", ["the mit license"]),
    ("mit",
     "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal "
     "in the software without restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell "
     "copies of the software and to permit persons to whom the software is furnished to do so subject to the following conditions",
     ["free of charge to any person", "without restriction including without limitation", "merge publish distribute sublicense"]),
    ("mpl", "mozilla public license version 2 0", ["mozilla public license"]),
    ("unlicense", "this is free and unencumbered software released into the public domain", ["unencumbered software"]),
]
# Words too common to be indexed, unless a key phrase has them.
COMMON = "a an and any are as at by for following in is it may not of on or that the this to under use with you".split()

#: So many of a template's key-phrase words, those with the highest inverse document frequency, are looked up and must agree on its place.
AGREEING = 2

_KEY_WORDS = {w for phrase, _ in PHRASES for w in phrase.split()} | {w for _, _, keys in TEMPLATES for key in keys for w in key.split()}
_VOCABULARY = sorted(_KEY_WORDS | {w for _, words, _ in TEMPLATES for w in words.split() if w not in COMMON})


def with_words(df: DataFrame, text: str, into: str) -> DataFrame:
    """Add ``into``: the number of words ``n``, the licence words with their places (``placed``) and the distinct ones (``kinds``)."""
    whole = F.coalesce(F.col(text), F.lit(""))
    # lower() is faster than folding A-Z alone, and differs for these two letters only as far as these words go.
    folded = F.when(F.contains(whole, F.lit("\u212a")) | F.contains(whole, F.lit("\u0130")), fold_ascii(whole)).otherwise(F.lower(whole))
    df = df.withColumn(into, F.regexp_extract_all(folded, F.lit(f"({WORD})"), F.lit(1)))
    numbered = F.transform(into, lambda w, i: F.struct(i.alias("at"), w.alias("w")))
    df = df.withColumn(into, F.struct(F.size(into).cast("long").alias("n"), F.filter(numbered, lambda x: x["w"].isin(_VOCABULARY)).alias("placed")))
    kinds = F.array_distinct(F.transform(F.col(into)["placed"], lambda x: x["w"]))
    return df.withColumn(into, F.struct(F.col(into)["n"].alias("n"), F.col(into)["placed"].alias("placed"), kinds.alias("kinds")))


def _has_all(kinds: Column, words: list[str]) -> Column:
    """Does the row have all these licence words?"""
    return F.size(F.array_except(F.array(*map(F.lit, dict.fromkeys(words))), kinds)) == 0


def _places_before(placed: Column, word: str, step: int) -> Column:
    return F.transform(F.filter(placed, lambda x: x["w"] == word), lambda x: x["at"] - step)


def phrase_places(row: Column, phrase: str) -> Column:
    """Places where the words of the phrase stand one after another."""
    votes = [_places_before(row["placed"], word, step) for step, word in enumerate(phrase.split())]
    return F.when(_has_all(row["kinds"], phrase.split()), F.array_distinct(reduce(F.array_intersect, votes))).otherwise(F.array().cast("array<int>"))


def document_frequencies(df: DataFrame, words: str) -> dict[str, float]:
    """Inverse document frequency of every licence word over all rows of df, which has the column ``words``. One entry a word of the templates."""
    total = df.count()
    found = {r[0]: r[1] for r in df.select(F.explode(F.col(words)["kinds"]).alias("_w")).groupBy("_w").count().collect()}
    return {w: math.log((1 + total) / (1 + found.get(w, 0))) for w in _VOCABULARY}


def _looked_up(t: int, idf: dict[str, float]) -> list[tuple[str, int]]:
    """The rarest words of the template's key phrases with their positions in it; ties in weight go by word."""
    _, words, keys = TEMPLATES[t]
    places = {word: i for i, word in sorted(_key_places(words.split(), keys).items(), reverse=True)}
    return sorted(places.items(), key=lambda x: (-idf.get(x[0], 0.0), x[0]))[:AGREEING]


def _key_places(words: list[str], keys: list[str]) -> dict[int, str]:
    return {_find(words, key.split()) + i: w for key in keys for i, w in enumerate(key.split())}


def find_licenses(df: DataFrame, words: str, idf: dict[str, float]) -> DataFrame:
    """scan_licenses on rows that have the column ``words`` of with_words instead of a text."""
    row = F.col(words)
    placed = row["placed"]
    none = F.array().cast("array<struct<label:string,word:int,share:double>>")

    def agreeing(s: Column, at: dict[int, str], n: int) -> Column:
        """How many of these words of a template stand at their places, if it starts at s."""
        wanted = F.array(*[F.lit(at.get(i)).cast("string") for i in range(n)])
        return F.size(F.filter(placed, lambda x: F.coalesce(F.get(wanted, x["at"] - s) == x["w"], F.lit(False))))

    # A template's words at a place are verified against all licence words of the file.
    def judged(t: int) -> Column:
        label, template, keys = TEMPLATES[t]
        template = template.split()
        key_places = _key_places(template, keys)
        indexed = {i: w for i, w in enumerate(template) if w in _KEY_WORDS or w not in COMMON}
        starts = F.array_distinct(reduce(F.array_intersect, [_places_before(placed, w, i) for w, i in _looked_up(t, idf)]))
        held = F.filter(starts, lambda s: agreeing(s, key_places, len(template)) == len(key_places))
        hits = F.transform(held, lambda s: F.struct(
            F.lit(label).alias("label"), s.cast("int").alias("word"), (agreeing(s, indexed, len(template)) / len(indexed)).alias("share")))
        return F.when(_has_all(row["kinds"], [*key_places.values()]), hits).otherwise(none)

    base_places, found_now, n_words = fresh(df, "_base", "_found", "_n")
    found = F.concat(*[judged(t) for t in range(len(TEMPLATES))])
    possible = any_of([_has_all(row["kinds"], " ".join(keys).split()) for _, _, keys in TEMPLATES])
    df = df.withColumns({
        base_places: F.array(*[phrase_places(row, phrase) for phrase, _ in PHRASES]), n_words: row["n"], found_now: F.when(possible, found).otherwise(none),
    }).drop(words)
    places = F.flatten(base_places)
    base = F.filter(F.array(*[F.when(F.size(F.get(base_places, k)) > 0, label) for k, (_, label) in enumerate(PHRASES)]), lambda x: x.isNotNull())
    best = F.array_max(F.transform(found_now, lambda x: x["share"]))
    return df.withColumns({
        "n_words": F.col(n_words),
        "n_base": F.size(places).cast("long"),
        "first_word": F.array_min(places).cast("long"),
        "last_word": F.array_max(places).cast("long"),
        "base_labels": F.array_join(F.array_sort(F.array_distinct(base)), ","),
        "labels": F.array_join(F.array_sort(F.array_union(base, F.transform(found_now, lambda x: x["label"]))), ","),
        "score": F.when(F.size(places) > 0, 1.0).otherwise(F.coalesce(best, F.lit(0.0))),
        "found": F.col(found_now),
    }).drop(base_places, found_now, n_words)


def scan_licenses(df: DataFrame, idf: dict[str, float] | None = None, text: str = "text") -> DataFrame:
    """Add n_words, n_base, first_word, last_word, base_labels, labels, score and ``found`` (the method's templates with place and score).

    ``idf`` comes from all rows of df if it is not given. ``score`` is the largest share of a verified template's indexed words
    that stand at its place (1 for a base phrase), 0 without any. Null and empty texts have no words, no labels (empty strings)
    and null first and last word. A place counted for a phrase may overlap another. Repeated rows get equal results; an empty
    table stays empty; long texts are scanned whole. Columns of df with those names are replaced, all others stay.
    """
    (words,) = fresh(df, "_license_words")
    if idf is None:
        idf = document_frequencies(with_words(df.select(text), text, words), words)
    return find_licenses(with_words(df, text, words), words, idf)


def _find(words: list[str], key: list[str]) -> int:
    return next(i for i in range(len(words)) if words[i : i + len(key)] == key)


def op4_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    # Texts are read once: their licence words are written and serve the frequencies and the scan.
    words = cut(with_words(read(spark, sf_dir, "documents").select("doc_id", "text"), "text", "words").drop("text"))
    return find_licenses(words, "words", document_frequencies(words, "words")).select(
        "doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score")
