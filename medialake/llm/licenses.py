"""Operator 4, licence scans by a positional rare-token index (DataFrame functions only).

A licence is a label with one or more templates: the words of its text or notice, and its mandatory key phrases in
their order. One scan finds which licence words each text has and so their document frequencies. Postings hold each
template's words of highest IDF, over the whole template and in its first key phrase, with their positions. A second
scan looks up the words of each text: where two different rare words of a template agree on where it would begin,
within ``SLACK`` words, it is laid over the text. It is met if each key phrase stands within ``SLACK`` words of its
place there; a phrase of ``DAMAGED_FROM`` words or more may have one other word in it, but not in place of a number or
of a name that tells licences apart, and a word
inserted in it or left out breaks it. A label is given when a template of its is met. The alignment's share is that of
the template's words that stand within ``SLACK`` words of their places; the score is the largest share, and
``MENTION`` at least where a base phrase stands. Base phrases are found by their two rarest words at one relative
position and compared word by word. Both scans are row-local; only the frequencies, a row for each licence word, are gathered.

Defined cases: a null or empty text has no words, no places, empty labels and score 0; a phrase occurrence may
overlap others and each counts; a template that a text's begin or end cuts off is met by the key phrases that are
there, and its missing words lower the share, so a lone key phrase scores low; words inserted or left out shift what
follows, which counts as long as the shift is within ``SLACK``; labels met twice are listed once; a text of any length
is scanned whole, with work in proportion to its words and its hits; repeated rows get a row each; an empty table gives
no rows; other columns are ignored.
"""

from __future__ import annotations

from dataclasses import dataclass

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from .common import NOT_WORD_LOWER, text_of

# The base labels and their phrases.
BASE = {"gpl": "gnu general public license", "apache": "apache license", "cc-by": "cc by", "mit": "mit license"}



@dataclass(frozen=True)
class Template:
    """A licence's words and its mandatory key phrases, in the order in which they stand there."""

    label: str
    text: str
    keys: tuple[str, ...]

    @property
    def words(self) -> list[str]:
        return self.text.split()

    @property
    def places(self) -> list[int]:
        """The word at which each key phrase begins."""
        out, at = [], 0
        for key in self.keys:
            own = key.split()
            at = next(i for i in range(at, len(self.words)) if self.words[i : i + len(own)] == own)
            out.append(at)
        return out


# The words of licence texts and notices, and the phrases that each has to hold.
TEMPLATES = [
    Template("agpl-3.0", "licensed under the gnu affero general public license version 3", ("gnu affero general public license", "version 3")),
    Template(
        "agpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu affero general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        ("gnu affero general public license as published by the free software foundation", "version 3 of the license"),
    ),
    Template("apache-2.0", "licensed under the apache license version 2 0", ("apache license", "version 2 0")),
    Template(
        "apache-2.0",
        "licensed under the apache license version 2 0 the license you may not use this file except in compliance with the license you may obtain a copy of the license at "
        "http www apache org licenses license 2 0 unless required by applicable law or agreed to in writing software distributed under the license is distributed on an as is basis "
        "without warranties or conditions of any kind either express or implied see the license for the specific language governing permissions and limitations under the license",
        ("apache license version 2 0", "except in compliance with the license", "on an as is basis"),
    ),
    Template(
        "bsd",
        "redistribution and use in source and binary forms with or without modification are permitted provided that the following conditions are met "
        "redistributions of source code must retain the above copyright notice this list of conditions and the following disclaimer "
        "redistributions in binary form must reproduce the above copyright notice this list of conditions and the following disclaimer in the documentation and or other materials "
        "provided with the distribution",
        ("redistribution and use in source and binary forms", "with or without modification"),
    ),
    Template(
        "bsl-1.0",
        "permission is hereby granted free of charge to any person or organization obtaining a copy of the software and accompanying documentation covered by this license the software "
        "to use reproduce display distribute execute and transmit the software and to prepare derivative works of the software",
        ("permission is hereby granted free of charge to any person or organization",),
    ),
    Template("cc-by-4.0", "licensed under cc by 4 0", ("cc by 4 0",)),
    Template("cc-by-4.0", "licensed under a creative commons attribution 4 0 international license", ("creative commons attribution 4 0 international",)),
    Template("cc-by-nc-4.0", "licensed under cc by nc 4 0", ("cc by nc 4 0",)),
    Template("cc-by-nc-4.0", "licensed under a creative commons attribution noncommercial 4 0 international license", ("creative commons attribution noncommercial 4 0 international",)),
    Template("cc-by-sa-4.0", "licensed under cc by sa 4 0", ("cc by sa 4 0",)),
    Template("cc-by-sa-4.0", "licensed under a creative commons attribution sharealike 4 0 international license", ("creative commons attribution sharealike 4 0 international",)),
    Template("cc0-1.0", "licensed under cc0 1 0 universal", ("cc0 1 0 universal",)),
    Template("epl-2.0", "this program and the accompanying materials are made available under the terms of the eclipse public license v 2 0", ("eclipse public license", "v 2 0")),
    Template("epl-2.0", "licensed under the eclipse public license version 2 0", ("eclipse public license", "version 2 0")),
    Template("gpl-2.0", "licensed under the gnu general public license version 2", ("gnu general public license", "version 2")),
    Template(
        "gpl-2.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 2 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation", "version 2 of the license"),
    ),
    Template("gpl-3.0", "licensed under the gnu general public license version 3", ("gnu general public license", "version 3")),
    Template(
        "gpl-3.0",
        "this program is free software you can redistribute it and or modify it under the terms of the gnu general public license as published by the free software foundation "
        "either version 3 of the license or at your option any later version",
        ("gnu general public license as published by the free software foundation", "version 3 of the license"),
    ),
    Template(
        "isc",
        "permission to use copy modify and or distribute this software for any purpose with or without fee is hereby granted provided that the above copyright notice and this permission "
        "notice appear in all copies the software is provided as is and the author disclaims all warranties with regard to this software including all implied warranties of "
        "merchantability and fitness",
        ("permission to use copy modify and or distribute this software", "is hereby granted"),
    ),
    Template("lgpl", "licensed under the gnu lesser general public license", ("gnu lesser general public license",)),
    Template(
        "mit-text",
        "permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files the software to deal in the software without "
        "restriction including without limitation the rights to use copy modify merge publish distribute sublicense and or sell copies of the software and to permit persons to whom the "
        "software is furnished to do so subject to the following conditions the above copyright notice and this permission notice shall be included in all copies or substantial portions "
        "of the software the software is provided as is without warranty of any kind express or implied including but not limited to the warranties of merchantability fitness for a "
        "particular purpose and noninfringement in no event shall the authors or copyright holders be liable for any claim damages or other liability whether in an action of contract tort "
        "or otherwise arising from out of or in connection with the software or the use or other dealings in the software",
        ("permission is hereby granted free of charge to any person obtaining a copy",),
    ),
    Template("mpl-2.0", "this source code form is subject to the terms of the mozilla public license v 2 0", ("mozilla public license", "v 2 0")),
    Template("mpl-2.0", "licensed under the mozilla public license version 2 0", ("mozilla public license", "version 2 0")),
    Template(
        "unlicense",
        "this is free and unencumbered software released into the public domain anyone is free to copy modify publish use compile sell or distribute this software either in source code "
        "form or as a compiled binary for any purpose commercial or non commercial and by any means",
        ("free and unencumbered software released into the public domain",),
    ),
    Template(
        "zlib",
        "this software is provided as is without any express or implied warranty in no event will the authors be held liable for any damages arising from the use of this software "
        "permission is granted to anyone to use this software for any purpose including commercial applications and to alter it and redistribute it freely subject to the following restrictions",
        ("provided as is without any express or implied warranty", "permission is granted to anyone to use this software for any purpose"),
    ),
]

# Names that tell one licence from another; they and numbers are never taken for damage.
NAMES = {"affero", "apache", "attribution", "cc", "cc0", "eclipse", "general", "gnu", "lesser", "mozilla", "noncommercial", "sharealike", "v"}

#: Words of highest IDF by which each phrase is indexed.
RARE_WORDS = 2
#: A template is indexed by its ``RARE_WORDS`` rarest words, or by one in so many of its words if these are more.
WORDS_A_POSTING = 20
#: Words by which a rare word, a key phrase or another word may stand off its place, for what a text inserts or leaves out.
SLACK = 3
#: The shortest key phrase in which one word may be another.
DAMAGED_FROM = 5
#: The score of a base phrase that no template is met around.
MENTION = 0.25


def words(text: Column) -> Column:
    """The words of a text after A-Z are lower-cased. ``lower`` also changes other letters; that moves no word
    boundary, and the one sign it would turn into an ASCII letter that phrases hold is kept apart first."""
    lowered = F.lower(F.regexp_replace(text, "\u212a", "\u00e9"))
    return F.array_remove(F.split(lowered, NOT_WORD_LOWER), "")


def frequencies(docs: DataFrame, phrases: list[str]) -> tuple[dict[str, int], int]:
    """In how many texts each licence word stands, and the number of texts."""
    vocabulary = sorted({w for p in phrases for w in p.split()})
    found = docs.select(F.array_intersect(F.array(*map(F.lit, vocabulary)), words(text_of())).alias("found"))
    rows = found.select(F.explode(F.array_append("found", F.lit(""))).alias("word")).groupBy("word").agg(F.count("*").alias("n")).collect()
    counts = {r["word"]: r["n"] for r in rows}  # at most a row for each licence word, and "" for all texts
    return {w: counts.get(w, 0) for w in vocabulary}, counts.get("", 0)


def rare_words(phrase: str, frequency: dict[str, int], k: int = RARE_WORDS) -> list[tuple[str, int]]:
    """The ``k`` words of lowest document frequency, which is highest IDF, with their positions."""
    at = {w: i for i, w in reversed(list(enumerate(phrase.split())))}
    return sorted(at.items(), key=lambda x: (frequency[x[0]], x[1]))[:k]


def rare_places(template: Template, frequency: dict[str, int]) -> list[tuple[str, int]]:
    """A template's postings: the rarest words of all of it, and of its first key phrase, with their places."""
    own = rare_words(template.text, frequency, max(RARE_WORDS, len(template.words) // WORDS_A_POSTING))
    first = [(w, template.places[0] + i) for w, i in rare_words(template.keys[0], frequency)]
    return list(dict.fromkeys(own + first))


def firm(phrase: str) -> list[int]:
    """The places of a phrase's words that must not differ."""
    return [i for i, w in enumerate(phrase.split()) if w.isdigit() or w in NAMES or len(phrase.split()) < DAMAGED_FROM]


def quoted(word: str) -> str:
    return "'" + word.replace("\\", "\\\\").replace("'", "\\'") + "'"


def listed(own: list[str]) -> str:
    return f"array({', '.join(map(quoted, own))})"


def numbers(own: list[int]) -> str:
    return f"array({', '.join(map(str, own))})" if own else "cast(array() as array<int>)"


def base_places(phrases: list[str], frequency: dict[str, int]) -> str:
    """SQL for the places ``(phrase, start)`` of the phrases in the words ``w``: the rare words of a phrase met in ``w`` say
    where it would begin, and a phrase whose rare words all agree is compared with the text there."""
    postings: dict[str, list[tuple[int, int]]] = {}
    needed, rarest = [], set()
    for number, phrase in enumerate(phrases):
        own = rare_words(phrase, frequency)
        needed.append(len(own))
        rarest.add(own[0][0])
        for word, position in own:
            postings.setdefault(word, []).append((number, position))
    index = ", ".join(f"{quoted(w)}, array({', '.join(f'named_struct({chr(39)}phrase{chr(39)}, {n}, {chr(39)}at{chr(39)}, {p})' for n, p in own)})" for w, own in sorted(postings.items()))
    spelled, wanted = f"array({', '.join(listed(p.split()) for p in phrases)})", numbers(needed)
    return f"""
    CASE WHEN arrays_overlap(w, {listed(sorted(rarest))}) THEN
      transform(array(array_sort(flatten(transform(
          filter(transform(w, (x, i) -> named_struct('x', x, 'i', i)), h -> array_contains({listed(sorted(postings))}, h.x)),
          h -> transform(element_at(map({index}), h.x), p -> named_struct('phrase', p.phrase, 'start', h.i - p.at)))))), starts ->
        filter(filter(starts, (s, k) ->
            s.start >= 0 AND k + element_at({wanted}, s.phrase + 1) <= size(starts) AND starts[least(k + element_at({wanted}, s.phrase + 1) - 1, size(starts) - 1)] = s),
            s -> slice(w, s.start + 1, size(element_at({spelled}, s.phrase + 1))) = element_at({spelled}, s.phrase + 1)))[0]
    ELSE cast(array() as array<struct<phrase:int,start:int>>) END"""


def alignments(templates: list[Template], frequency: dict[str, int]) -> str:
    """SQL for the templates met in the words ``w``, as ``(label, share)``. Hits are sorted by template and begin; those
    within ``SLACK`` of one of them are a bounded number of places away, so each is compared with a bounded slice."""
    if not templates:
        return "cast(array() as array<struct<label:string,share:double>>)"
    postings: dict[str, list[tuple[int, int]]] = {}
    for number, template in enumerate(templates):
        for word, position in rare_places(template, frequency):
            postings.setdefault(word, []).append((number, position))
    words_ = sorted(postings)
    reach = (2 * SLACK + 1) * max(len(rare_places(t, frequency)) for t in templates)
    posted = lambda j, own: ", ".join(f"named_struct('t', {n}, 'at', {p}, 'j', {j})" for n, p in own)
    index = ", ".join(f"{quoted(w)}, array({posted(j, postings[w])})" for j, w in enumerate(words_))
    key = lambda k, at: f"named_struct('at', {at}, 'words', {listed(k.split())}, 'firm', {numbers(firm(k))})"
    laid = ", ".join(f"named_struct('label', {quoted(t.label)}, 'words', {listed(t.words)}, 'keys', array({', '.join(key(k, a) for k, a in zip(t.keys, t.places))}))" for t in templates)
    near = numbers(sorted(range(-SLACK, SLACK + 1), key=abs))
    at = lambda place: f"coalesce(get(w, {place}), '')"
    stands = f"""forall(k.firm, i -> {at('c.s + k.at + d + i')} = k.words[i])
        AND size(filter(k.words, (x, i) -> {at('c.s + k.at + d + i')} = x)) >= size(k.words) - 1"""
    return f"""
    transform(array(array_sort(flatten(transform(
        filter(transform(w, (x, i) -> CASE WHEN x IN ({', '.join(map(quoted, words_))}) THEN i END), i -> i IS NOT NULL),
        i -> transform(element_at(map({index}), w[i]), p -> named_struct('t', p.t, 's', i - p.at, 'j', p.j)))))), hits ->
      flatten(transform(
        filter(hits, (h, n) -> (n = 0 OR get(hits, n - 1).t <> h.t OR get(hits, n - 1).s <> h.s)
            AND exists(slice(hits, greatest(n + 1 - {reach}, 1), 2 * {reach} + 1), o -> o.t = h.t AND o.j <> h.j AND abs(o.s - h.s) <= {SLACK})),
        c -> transform(
          filter(array(element_at(array({laid}), c.t + 1)), t -> forall(t.keys, k -> exists({near}, d -> {stands}))),
          t -> named_struct('label', t.label, 'share', cast(size(filter(t.words, (x, k) -> exists({near}, d -> {at('c.s + k + d')} = x))) as double) / size(t.words))))))[0]"""


def scan(docs: DataFrame, base: dict[str, str] | None = None, templates: list[Template] | None = None, id_column: str = "doc_id") -> DataFrame:
    """The licence report of every row of ``docs(doc_id, text)``."""
    base, templates = BASE if base is None else base, TEMPLATES if templates is None else templates
    phrases = list(dict.fromkeys(base.values()))
    place = {p: n for n, p in enumerate(phrases)}
    frequency, _ = frequencies(docs, [*phrases, *(t.text for t in templates)])
    # array(w0) binds the words once: the expression for w0 itself is put where w0 stands
    per_row = F.expr(f"transform(array(w0), w -> named_struct('n_words', cast(size(w) as bigint), 'places', {base_places(phrases, frequency)}, 'met', {alignments(templates, frequency)}))[0]")
    rows = docs.select(id_column, words(text_of()).alias("w0")).select(id_column, per_row.alias("r"))
    rows = rows.select(id_column, "r.n_words", "r.met", F.expr("transform(r.places, p -> cast(p.start as bigint))").alias("base"), F.expr("array_distinct(transform(r.places, p -> p.phrase))").alias("found"))
    base_labels = F.array_compact(F.array(*(F.when(F.array_contains("found", place[p]), F.lit(label)) for label, p in base.items())))

    def joined(labels: Column) -> Column:
        return F.array_join(F.array_sort(F.array_distinct(labels)), ",")

    score = F.greatest(F.when(F.size("base") > 0, F.lit(MENTION)).otherwise(F.lit(0.0)), F.array_max("met.share"))
    return rows.select(
        id_column, "n_words", F.size("base").cast("long").alias("n_base"), F.array_min("base").alias("first_word"), F.array_max("base").alias("last_word"),
        joined(base_labels).alias("base_labels"), joined(F.concat(base_labels, F.col("met.label"))).alias("labels"), score.alias("score"),
    )
