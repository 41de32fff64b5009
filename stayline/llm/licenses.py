"""Licence scans over a positional index of rare tokens, in DataFrame functions only.

Templates are licence texts and notices, each with key phrases that must stand in a file
for the template to count. The index posts every word of a key phrase under its template,
phrase and position. One pass over the texts keeps, per file, the places of words that
any template has; document counts of those words over all files give their IDF weights.

A file is a candidate for a template if it has every word of its key phrases. Of each
phrase the file's two words of highest IDF are looked up, and their postings intersected
by relative position: only where both stand at their distance can the phrase begin.
There the whole phrase is verified. Since a phrase cannot stand without its rare words,
the index loses no place. Phrases of one template must stand in the template's relative
positions, give or take ``SLACK`` words, which allows for names filled in.

The score of a match is the part of the template's IDF weight whose words stand where
the nearest key phrase before them puts them; a file's score is that of its best match.

Defined results: a null text counts as empty and has no words; files without a match have
no labels, null places and score 0; repeated rows are judged row by row; phrases may
overlap, and every place counts. An empty table gives an empty result. Input columns are
carried in ``row``.
"""

from __future__ import annotations

import re
from collections.abc import Mapping, Sequence
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from stayline.llm.common import as_row, keep, lower_ascii, numbered

#: Fixed value: what parts words, after A-Z have been lower-cased.
GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"
#: How many words a phrase may be off its place relative to the template's first phrase.
SLACK = 24
#: Words of a phrase that are looked up.
RARE = 2

#: Phrases that are labels by themselves.
PHRASES = {"cc by": "cc-by", "general public license": "gpl", "all rights reserved": "reserved"}


def words_of(text: str) -> tuple[str, ...]:
    lower = text.translate({c: c + 32 for c in range(65, 91)})
    return tuple(w for w in re.split(GAP, lower) if w)


@dataclass(frozen=True)
class Template:
    """A licence text with the phrases it cannot do without, in the order of the text."""

    label: str
    text: str
    keys: tuple[str, ...]

    @cached_property
    def words(self) -> tuple[str, ...]:
        return words_of(self.text)

    @cached_property
    def phrases(self) -> tuple[tuple[int, tuple[str, ...]], ...]:
        """Place in the text and words of every key phrase."""
        found = []
        for key in self.keys:
            own = words_of(key)
            places = [i for i in range(len(self.words)) if own and self.words[i:i + len(own)] == own]
            if not places:
                raise ValueError(f"{key!r} does not stand in the template {self.label}")
            found.append((places[0], own))
        if not found or [p for p, _ in found] != sorted({p for p, _ in found}):
            raise ValueError(f"key phrases of {self.label} must stand in the order of its text")
        return tuple(found)

    def phrase_at(self, place: int) -> int:
        """The phrase that a word's place hangs on: the nearest that begins before it."""
        return max((i for i, (p, _) in enumerate(self.phrases) if p <= place), default=0)


def notice(label: str, text: str) -> Template:
    """A short text that must stand whole."""
    return Template(label, text, (text,))


#: Public licence texts (opening parts) and the usual notices.
TEMPLATES = (
    Template("mit", """Permission is hereby granted, free of charge, to any person obtaining a copy of this software
and associated documentation files (the "Software"), to deal in the Software without restriction, including without
limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software,
and to permit persons to whom the Software is furnished to do so, subject to the following conditions: The above
copyright notice and this permission notice shall be included in all copies or substantial portions of the Software.""",
             ("permission is hereby granted free of charge", "copies or substantial portions of the software")),
    notice("mit", "under the MIT License"),
    Template("bsd", """Redistribution and use in source and binary forms, with or without modification, are permitted
provided that the following conditions are met: Redistributions of source code must retain the above copyright notice,
this list of conditions and the following disclaimer.""",
             ("redistribution and use in source and binary forms", "must retain the above copyright notice")),
    notice("bsd-3-clause", "be used to endorse or promote products derived from this software"),
    Template("isc", """Permission to use, copy, modify, and/or distribute this software for any purpose with or
without fee is hereby granted, provided that the above copyright notice and this permission notice appear in all
copies.""", ("permission to use copy modify and or distribute this software", "fee is hereby granted")),
    Template("apache-2.0", """Licensed under the Apache License, Version 2.0 (the "License"); you may not use this file
except in compliance with the License. You may obtain a copy of the License at""",
             ("apache license version 2 0", "in compliance with the license")),
    notice("apache-2.0", "Apache License, Version 2.0"),
    notice("gpl-2.0", "GNU General Public License, version 2"),
    notice("gpl-3.0", "GNU General Public License, version 3"),
    Template("gpl-2.0", """you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation; either version 2 of the License, or (at your option) any later
version.""", ("gnu general public license as published by the free software foundation", "version 2 of the license")),
    Template("gpl-3.0", """you can redistribute it and/or modify it under the terms of the GNU General Public License
as published by the Free Software Foundation, either version 3 of the License, or (at your option) any later
version.""", ("gnu general public license as published by the free software foundation", "version 3 of the license")),
    notice("lgpl", "GNU Lesser General Public License"),
    notice("agpl", "GNU Affero General Public License"),
    Template("mpl-2.0", """This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy
of the MPL was not distributed with this file, You can obtain one at""",
             ("mozilla public license v 2 0",)),
    notice("epl-2.0", "Eclipse Public License, version 2.0"),
    notice("unlicense", "This is free and unencumbered software released into the public domain"),
    notice("cc-by-4.0", "CC BY 4.0"),
    notice("cc-by-sa-4.0", "CC BY-SA 4.0"),
    notice("cc-by-nc-4.0", "CC BY-NC 4.0"),
    notice("cc-by-nd-4.0", "CC BY-ND 4.0"),
    notice("cc-by-nc-sa-4.0", "CC BY-NC-SA 4.0"),
    notice("cc-by-4.0", "Creative Commons Attribution 4.0 International"),
    notice("cc0-1.0", "CC0 1.0 Universal"),
)


def with_phrases(templates: Sequence[Template], phrases: Mapping[str, str]) -> list[Template]:
    """All templates: the phrases that are labels, as notices, come first."""
    return [notice(label, phrase) for phrase, label in phrases.items()] + list(templates)


def vocabulary(templates: Sequence[Template]) -> list[str]:
    return sorted({w for t in templates for w in t.words})


def with_places(docs: DataFrame, words: Sequence[str], text: str = "text", carry: list[str] | None = None) -> DataFrame:
    """``row`` (see ``as_row``), ``n_words``, and ``hits``: place and word, in order, of
    every word of the text that is one of ``words``."""
    parts = docs.select(
        as_row(docs, carry), F.split(lower_ascii(F.coalesce(F.col(f"`{text}`"), F.lit(""))), GAP).alias("parts"))
    # A text that begins or ends between words has an empty part there.
    count, begins = F.size("parts"), (F.get("parts", F.lit(0)) == "").cast("int")
    ends = ((count > 1) & (F.get("parts", count - 1) == "")).cast("int")
    placed = parts.select("row", "parts", begins.alias("skip"), (count - begins - ends).cast("long").alias("n_words"))
    every = F.transform("parts", lambda w, i: F.struct((i - F.col("skip")).alias("pos"), w.alias("w")))
    return placed.select("row", "n_words", F.filter(every, lambda h: h["w"].isin(*words)).alias("hits"))


def _starts(phrase: Sequence[str]) -> Column:
    """Where the phrase stands, from the ordered hits: its words are neighbours there."""
    def start(hit: Column, j: Column) -> Column:
        whole = hit["w"] == phrase[0]
        for k, word in enumerate(phrase[1:], 1):
            after = F.get("hits", j + k)
            whole = whole & F.coalesce((after["w"] == word) & (after["pos"] == hit["pos"] + k), F.lit(False))
        return F.when(whole, hit["pos"])

    return F.filter(F.transform("hits", start), lambda p: p.isNotNull())


def _values(spark: SparkSession, names: Sequence[str], rows: Sequence[tuple]) -> DataFrame:
    """A small constant table; the words in it hold neither quotes nor backslashes."""
    shown = ", ".join("(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in r) + ")" for r in rows)
    return spark.sql(f"SELECT * FROM VALUES {shown} AS fixed({', '.join(names)})")


def weights(placed: DataFrame) -> DataFrame:
    """(w, weight): IDF of each licence word over all files, in thousandths, 1 at least.

    At most one row per word of the templates.
    """
    held = placed.select(F.explode(F.array_distinct(F.transform("hits", lambda h: h["w"]))).alias("w"))
    total = placed.agg(F.count(F.lit(1)).alias("n")).withColumnRenamed("n", "total")
    counted = held.groupBy("w").agg(F.count(F.lit(1)).alias("df"))
    # One row of totals, so the broadcast is bounded.
    idf = F.floor(1000 * F.log((2 * F.col("total") + 2) / (2 * F.col("df") + 1)))
    return counted.join(F.broadcast(total)).select("w", (F.greatest(idf, F.lit(0)) + 1).cast("long").alias("weight"))


def _candidates(placed: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(key, of, pos, w): the hits of files that have all key words of the templates ``of``."""
    must = F.array(*[
        F.struct(F.lit(t).alias("t"), F.array(*[F.lit(w) for w in sorted({w for _, p in one.phrases for w in p})]).alias("words"))
        for t, one in enumerate(templates)
    ])
    held = placed.select("key", "hits", F.array_distinct(F.transform("hits", lambda h: h["w"])).alias("held")).where(F.size("held") > 1)
    fitting = F.filter(must, lambda t: F.size(F.array_except(t["words"], F.col("held"))) == 0)
    some = held.select("key", "hits", F.transform(fitting, lambda t: t["t"]).alias("of")).where(F.size("of") > 0)
    return some.select("key", "of", F.explode("hits").alias("h")).select("key", "of", "h.pos", "h.w")


def _anchors(spark: SparkSession, templates: Sequence[Template], idf: DataFrame) -> DataFrame:
    """(t, phrase, w, j, needed): the rarest words of every phrase at their positions."""
    posted = _values(spark, ("t", "phrase", "j", "w"), [
        (t, i, j, w) for t, one in enumerate(templates) for i, (_, p) in enumerate(one.phrases) for j, w in enumerate(p)])
    known = posted.join(F.broadcast(idf), "w", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    ranked = known.groupBy("t", "phrase").agg(F.sort_array(F.collect_list(F.struct(
        (-F.col("weight")).alias("rank"), "w", "j"))).alias("order"))
    first = ranked.select("t", "phrase", F.slice("order", 1, RARE).alias("first"))
    return first.select("t", "phrase", F.size("first").alias("needed"), F.explode("first").alias("a")).select(
        "t", "phrase", "needed", F.col("a.w").alias("w"), F.col("a.j").alias("j"))


def _places(hits: DataFrame, anchors: DataFrame, phrase_words: DataFrame) -> DataFrame:
    """(key, t, phrase, start): where key phrases stand, found by anchors, then verified."""
    looked_up = hits.join(F.broadcast(anchors), "w").where(F.array_contains("of", F.col("t")))
    meeting = looked_up.groupBy("key", "t", "phrase", (F.col("pos") - F.col("j")).alias("start"), "needed").agg(
        F.count(F.lit(1)).alias("n")).where(F.col("n") == F.col("needed"))
    spelled = meeting.select("key", "t", "phrase", "start").join(F.broadcast(phrase_words), ["t", "phrase"]).withColumn(
        "pos", F.col("start") + F.col("j"))
    there = spelled.join(hits.select("key", "pos", "w"), ["key", "pos", "w"], "left_semi")
    return there.groupBy("key", "t", "phrase", "start", "length").agg(F.count(F.lit(1)).alias("n")).where(
        F.col("n") == F.col("length")).select("key", "t", "phrase", "start")


def _aligned(places: DataFrame, phrases: DataFrame) -> DataFrame:
    """(key, t, at, phrase, shift): matches whose phrases all stand, and where each puts
    the template. ``at`` names a match: where its first phrase puts it.

    Places meet within cells of the slack's width, so a file that repeats a phrase does
    not pair all places with all others.
    """
    shifts = places.join(F.broadcast(phrases), ["t", "phrase"]).withColumn("shift", F.col("start") - F.col("q"))
    width = 2 * SLACK + 1
    first = shifts.where("phrase = 0").select("key", "t", F.col("shift").alias("at"), "of_t")
    cells = F.sequence(F.floor((F.col("at") - SLACK) / width), F.floor((F.col("at") + SLACK) / width))
    others = shifts.where("phrase > 0").select("key", "t", "phrase", "shift", F.floor(F.col("shift") / width).alias("cell"))
    near = first.select("key", "t", "at", F.explode(cells).alias("cell")).join(others, ["key", "t", "cell"])
    off = F.abs(F.col("shift") - F.col("at"))
    closest = near.where(off <= SLACK).groupBy("key", "t", "at", "phrase").agg(
        F.min(F.struct(off.alias("off"), "shift")).alias("best")).select("key", "t", "at", "phrase", "best.shift")
    found = first.select("key", "t", "at", F.lit(0).alias("phrase"), F.col("at").alias("shift")).unionByName(closest)
    grouped = found.groupBy("key", "t", "at").agg(F.collect_list(F.struct("phrase", "shift")).alias("p"))
    whole = grouped.join(F.broadcast(phrases.select("t", "of_t").distinct()), "t").where(F.size("p") == F.col("of_t"))
    return whole.select("key", "t", "at", F.explode("p").alias("p")).select("key", "t", "at", "p.phrase", "p.shift")


def matches(placed: DataFrame, templates: Sequence[Template]) -> DataFrame:
    """(key, label, start, score) of every match in a written table of ``with_places`` with
    its ``key``."""
    spark = placed.sparkSession
    idf = keep(weights(placed), "idf")
    every = list(enumerate(templates))
    phrases = _values(spark, ("t", "phrase", "q", "of_t"), [
        (t, i, q, len(one.phrases)) for t, one in every for i, (q, _) in enumerate(one.phrases)])
    spelled = _values(spark, ("t", "phrase", "j", "w", "length"), [
        (t, i, j, w, len(p)) for t, one in every for i, (_, p) in enumerate(one.phrases) for j, w in enumerate(p)])
    texts = _values(spark, ("t", "label", "phrase", "q", "w"), [
        (t, one.label, one.phrase_at(q), q, w) for t, one in every for q, w in enumerate(one.words)])
    hits = keep(_candidates(placed, templates), "hits")
    places = _places(hits, _anchors(spark, templates, idf), spelled)
    aligned = keep(_aligned(places, phrases), "aligned")
    weighed = texts.join(F.broadcast(idf), "w", "left").withColumn("weight", F.coalesce("weight", F.lit(0)))
    total = weighed.groupBy("t", "label").agg(F.sum("weight").alias("total"))
    expected = aligned.join(F.broadcast(weighed), ["t", "phrase"]).select(
        "key", "t", "at", "weight", (F.col("shift") + F.col("q")).alias("pos"), "w")
    there = expected.join(hits.select("key", "pos", "w"), ["key", "pos", "w"], "left_semi")
    summed = there.groupBy("key", "t", "at").agg(F.sum("weight").alias("met"))
    first = _values(spark, ("t", "q"), [(t, one.phrases[0][0]) for t, one in every])
    return summed.join(F.broadcast(total), "t").join(F.broadcast(first), "t").select(
        "key", "label", (F.col("at") + F.col("q")).alias("start"), (F.col("met") / F.col("total")).alias("score"))


def scan(
    docs: DataFrame, templates: Sequence[Template] = TEMPLATES, phrases: Mapping[str, str] = PHRASES,
    text: str = "text", carry: list[str] | None = None,
) -> DataFrame:
    """``row`` (see ``as_row``), ``n_words``, places of ``phrases`` (``n_base``, ``first_word``,
    ``last_word``, ``base_labels``), ``labels`` of all matches too, the best ``score``, and
    ``found``: label, first word of the first key phrase, and score of every match."""
    every = with_phrases(templates, phrases)
    placed = keep(numbered(with_places(docs, vocabulary(every), text, carry), "key"), "places")
    found = matches(placed, every).groupBy("key").agg(
        F.sort_array(F.collect_list(F.struct("start", "label", "score"))).alias("found"),
        F.collect_set("label").alias("more"), F.max("score").alias("score"))
    starts = placed.select("key", "row", "n_words", *[
        _starts(words_of(p)).alias(f"at{i}") for i, p in enumerate(phrases)])
    at = [F.col(f"at{i}") for i in range(len(phrases))]
    nothing = F.array().cast("array<int>")
    places = F.concat(nothing, *at)
    named = F.array_compact(F.array(
        F.lit(None).cast("string"), *[F.when(F.size(a) > 0, F.lit(label)) for a, label in zip(at, phrases.values())]))
    based = starts.select(
        "key", "row", "n_words", F.size(places).cast("long").alias("n_base"),
        F.array_min(places).cast("long").alias("first_word"), F.array_max(places).cast("long").alias("last_word"),
        F.array_sort(F.array_distinct(named)).alias("base_labels"))
    return based.join(found, "key", "left").select(
        "row", "n_words", "n_base", "first_word", "last_word", "base_labels",
        F.array_sort(F.array_union("base_labels", F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.coalesce("score", F.lit(0.0)).alias("score"),
        F.coalesce("found", F.array().cast("array<struct<start:int,label:string,score:double>>")).alias("found"))
