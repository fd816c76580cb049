"""License scans: Dice coefficient over word bigrams against licence templates.

Texts and templates (notices, headers and whole licence texts, the last in
the folder ``licences``) are normalised: lower case, letters and digits only.
Every window of a text's words is compared with every template by
Dice = 2 |A and B| / (|A| + |B|) over the sets of word bigrams, wherever the
lines and sentences end.  A window has at most (2 - t) / t times as many
bigrams, repeated ones counted, as the template.  As Dice >= t needs
t / (2 - t) <= |A| / |B| <= (2 - t) / t, a text must hold t / (2 - t) of a
template's bigrams; other templates are dropped before any window is looked
at, and most texts before all of them.  Windows need only begin and end with a
bigram of the template, as others at the ends never raise Dice.

SQL functions only.  Texts that hold enough bigrams of some template are
written and scanned, once for all copies, each in its own row, so that
nothing but the text is ever shuffled; the others are done.  Their windows are tried from the likeliest beginnings on, so that a
whole licence takes a few tries instead of one for each of its words; the
result is that of trying all (see :func:`_windows` and :func:`_settled`).  A
text of any length is scanned whole.

Defined results: of the windows with one beginning the most similar (then the
shortest) stands for a template; of overlapping windows the more similar, then
the one of the first template, then the earlier one stays.  n_units counts
those that stay.  Null text is the empty text; texts without a matching window
have no licence (null), similarity null and an empty list; of equal best
similarities the first template in order wins; repeated rows give repeated
results; other columns are not read.
"""

from __future__ import annotations

import re
from pathlib import Path

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import whole_text, written
from .spans import let

THRESHOLD = 0.8
#: Bigrams up to which a template is compared with every text; for longer ones those of all templates together decide at first.
SHORT = 160
#: Whole licence texts: NAME.txt, or NAME.CLAUSES.txt for the BSD licences.
LICENCES = Path(__file__).parent / "licences"


def _whole_texts() -> tuple[tuple[str, str], ...]:
    return tuple(("BSD" if f.name.startswith("BSD.") else f.stem, f.read_text("utf-8")) for f in sorted(LICENCES.glob("*.txt")))


_GNU = ("This program is free software: you can redistribute it and/or modify it under the terms of the GNU {0}General Public "
        "License as published by the Free Software Foundation, either version {1} of the License, or (at your option) any later "
        "version.")
_GNU_REST = (" This program is distributed in the hope that it will be useful, but WITHOUT ANY WARRANTY; without even the implied "
             "warranty of MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE. See the GNU {0}General Public License for more "
             "details. You should have received a copy of the GNU {0}General Public License along with this program. If not, see "
             "<https://www.gnu.org/licenses/>.")
_GNU_KINDS = (("GPL-3.0", "", "3"), ("GPL-2.0", "", "2"), ("AGPL-3.0", "Affero ", "3"), ("LGPL-3.0", "Lesser ", "3"), ("LGPL-2.1", "Lesser ", "2.1"))
# Notices, headers and licence texts as they are commonly written.
TEMPLATES = (
    ("MIT", "Released under the MIT License."),
    ("MIT", "This project is licensed under the MIT License."),
    ("MIT", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and "
            "associated documentation files (the \"Software\"), to deal in the Software without restriction, including "
            "without limitation the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell "
            "copies of the Software, and to permit persons to whom the Software is furnished to do so, subject to the "
            "following conditions:"),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except "
                   "in compliance with the License. You may obtain a copy of the License at "
                   "http://www.apache.org/licenses/LICENSE-2.0"),
    ("GPL-3.0", "This work is licensed under the GNU General Public License, version 3."),
    ("GPL-3.0", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU "
                "General Public License as published by the Free Software Foundation, either version 3 of the License, "
                "or (at your option) any later version."),
    ("CC-BY-NC-4.0", "Licensed under CC BY-NC 4.0."),
    ("CC-BY-NC-4.0", "This work is licensed under a Creative Commons Attribution-NonCommercial 4.0 International License."),
    ("CC-BY-4.0", "This work is licensed under a Creative Commons Attribution 4.0 International License."),
    ("ISC", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is "
            "hereby granted, provided that the above copyright notice and this permission notice appear in all copies."),
    ("BSD", "Redistribution and use in source and binary forms, with or without modification, are permitted provided "
            "that the following conditions are met:"),
    ("MPL-2.0", "This Source Code Form is subject to the terms of the Mozilla Public License, v. 2.0. If a copy of the "
                "MPL was not distributed with this file, You can obtain one at http://mozilla.org/MPL/2.0/."),
    ("Unlicense", "This is free and unencumbered software released into the public domain."),
    ("Apache-2.0", "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in compliance "
                   "with the License. You may obtain a copy of the License at http://www.apache.org/licenses/LICENSE-2.0 Unless "
                   "required by applicable law or agreed to in writing, software distributed under the License is distributed on "
                   "an \"AS IS\" BASIS, WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied. See the License "
                   "for the specific language governing permissions and limitations under the License."),
    # Neighbours of the notices above, which would else be taken for them.
    *((name, f"This work is licensed under the GNU {kind}General Public License, version {version}.") for name, kind, version in _GNU_KINDS[1:]),
    *((name, _GNU.format(kind, version)) for name, kind, version in _GNU_KINDS[1:]),
    *((name, (_GNU + _GNU_REST).format(kind, version)) for name, kind, version in _GNU_KINDS),
    *((f"CC-BY-{sign}-4.0", f"Licensed under CC BY-{sign} 4.0.") for sign in ("SA", "ND", "NC-SA", "NC-ND")),
    ("CC-BY-4.0", "Licensed under CC BY 4.0."),
    *((f"CC-BY-{sign}-4.0", f"This work is licensed under a Creative Commons Attribution-{kind} 4.0 International License.")
      for sign, kind in (("SA", "ShareAlike"), ("ND", "NoDerivatives"), ("NC-SA", "NonCommercial-ShareAlike"),
                         ("NC-ND", "NonCommercial-NoDerivatives"))),
    *_whole_texts(),
)


def _list(text: str) -> list[str]:
    words = re.findall(r"[a-z0-9]+", text.lower())
    return [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]


def template_bigrams(text: str) -> set[str]:
    return set(_list(text))


def size_bounds(size: int, threshold: float = THRESHOLD) -> tuple[int, int]:
    """Sizes a set may have to reach the threshold with a set of ``size`` bigrams, in whole percents."""
    t = round(100 * threshold)
    return -(-size * t // (200 - t)), size * (200 - t) // t


def _in(own: set[str]) -> str:
    """SQL list of bigrams, which hold letters, digits and blanks only; a long list becomes a hash set."""
    return "(" + ", ".join(f"'{b}'" for b in sorted(own)) + ")"


def _bigrams(text: Column) -> Column:
    return let(F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0)), lambda words: F.zip_with(
        words, F.slice(words, 2, F.size(words)), lambda a, b: F.concat(a, F.lit(" "), b)))


def _places(bigrams: Column) -> Column:
    """Each bigram, in order, with the place where it stood before (-1 if nowhere)."""
    def linked(by_word: Column) -> Column:
        return F.transform(by_word, lambda x, i: let(F.get(by_word, i - 1), lambda before: F.struct(
            x["i"].alias("i"), F.when(before["b"] == x["b"], before["i"]).otherwise(-1).alias("prev"), x["b"].alias("b"))))

    return F.array_sort(let(F.array_sort(F.transform(bigrams, lambda b, i: F.struct(b.alias("b"), i.alias("i")))), linked))


WINDOW = "struct<order:double,rank:int,start:int,end:int,licence:string>"


def _none() -> Column:
    return F.array().cast(f"array<{WINDOW}>")


def _starts(places: Column, holds: Column, n: Column, cap: Column, low: Column) -> Column:
    """Where a window of the template may begin, best bound first: (bound, start), the bound being negative like ``order``.

    No window from p has more of the template's bigrams than the C distinct
    ones among the ``cap`` places from p on, so none is more similar than
    2 C / (C + n).  Place i of an own bigram counts for the starts after its
    last occurrence and after i - cap: C is the number of such ranges that
    have begun by p, less the own places before p.  Sorting both together
    counts them for all starts at once.
    """
    def counted(own: Column) -> Column:
        marks = F.sort_array(F.concat(F.transform(own, lambda o: F.struct(o["begins"].alias("at"), F.lit(0).alias("order"))),
                                      F.transform(own, lambda o: F.struct(o["i"].alias("at"), F.lit(1).alias("order")))))
        places = F.filter(F.transform(marks, lambda m, q: F.when(m["order"] == 1, q)), lambda q: q.isNotNull())
        bounds = F.transform(F.zip_with(own, places, lambda o, q: F.struct(o["i"].alias("i"), q.alias("q"))), lambda x, j: F.struct(
            (x["q"] - 2 * j).alias("held"), x["i"].alias("i")))
        enough = F.filter(bounds, lambda b: b["held"] >= low)
        return F.sort_array(F.transform(enough, lambda b: F.struct((-2.0 * b["held"] / (b["held"] + n)).alias("bound"), b["i"].alias("start"))))

    own = F.filter(F.zip_with(places, holds, lambda x, own: F.when(own, F.struct(
        x["i"].alias("i"), (F.greatest(x["prev"], x["i"] - cap) + 1).alias("begins")))), lambda o: o.isNotNull())
    return let(own, counted)


def _best_from(places: Column, t: Column, p: Column) -> Column:
    """The best window of template ``t`` (see :func:`_tried`) that begins at ``p``, as WINDOW, or null."""
    n = t["n"]

    def step(acc: Column, x: Column) -> Column:
        new = x["prev"] < p
        m, c = acc["m"] + new.cast("int"), acc["c"] + (new & x["own"]).cast("int")
        better = new & x["own"] & (200 * c >= t["percent"] * (m + n)) & (c * (acc["bm"] + n) > acc["bc"] * (m + n))
        return F.struct((acc["k"] + 1).alias("k"), m.alias("m"), c.alias("c"), F.when(better, m).otherwise(acc["bm"]).alias("bm"),
                        F.when(better, c).otherwise(acc["bc"]).alias("bc"), F.when(better, p + acc["k"]).otherwise(acc["end"]).alias("end"))

    begin = F.struct(*(F.lit(v).alias(k) for k, v in (("k", 0), ("m", 0), ("c", 0), ("bm", 0), ("bc", 0), ("end", -1))))
    within = F.zip_with(F.slice(places, p + 1, t["cap"]), F.slice(t["holds"], p + 1, t["cap"]), lambda x, own: F.struct(
        x["prev"].alias("prev"), own.alias("own")))
    return F.aggregate(within, begin, step, lambda acc: F.when(acc["end"] >= 0, F.struct(
        (-2.0 * acc["bc"] / (acc["bm"] + n)).alias("order"), t["rank"].alias("rank"), p.alias("start"), acc["end"].alias("end"),
        t["licence"].alias("licence")).cast(WINDOW)))


def _goes_before(w: Column, s: Column, rank: Column) -> Column:
    """Whether window ``w`` holds start ``s`` and goes before every window of template ``rank`` from it."""
    return (w["start"] <= s["start"]) & (s["start"] <= w["end"]) & (
        (w["order"] < s["bound"]) | ((w["order"] == s["bound"]) & (w["rank"] <= rank)))


def _windows(places: Column, t: Column, seeds: Column | None) -> Column:
    """The best windows of template ``t`` from its starts, best bound first.

    A start that a window found so far, or one of ``seeds``, holds and goes before can add nothing as long as
    that window stays, so it isn't tried (unless ``seeds`` is None).
    """
    def step(acc: Column, s: Column) -> Column:
        found = let(_best_from(places, t, s["start"]), lambda w: F.when(w.isNotNull(), F.concat(acc, F.array(w))).otherwise(acc))
        if seeds is None:
            return found
        known = F.exists(seeds, lambda w: _goes_before(w, s, t["rank"])) | F.exists(acc, lambda w: _goes_before(w, s, t["rank"]))
        return F.when(known, acc).otherwise(found)

    return F.aggregate(t["starts"], _none(), step)


def _apart(windows: Column) -> Column:
    """The windows that overlap no better one, best first."""
    return F.aggregate(F.array_sort(F.array_distinct(windows)), _none(), lambda acc, c: F.when(
        F.exists(acc, lambda a: (a["start"] <= c["end"]) & (c["start"] <= a["end"])), acc).otherwise(F.concat(acc, F.array(c))))


def _settled(found: Column, kept: Column) -> Column:
    """Whether every start was tried and found, or lies in a kept window that goes before all windows from it, or in none at all."""
    every = F.flatten(F.transform(found, lambda t: t["windows"]))

    def fine(t: Column, s: Column, windows: Column) -> Column:
        return F.exists(kept, lambda k: _goes_before(k, s, t["rank"])) | ~F.exists(windows, lambda w: _goes_before(w, s, t["rank"]))

    return let(every, lambda windows: F.forall(found, lambda t: F.forall(t["starts"], lambda s: fine(t, s, windows))))


def _tried(places: Column, near: Column, holds: Column) -> Column:
    """The near templates that have starts in a text, the likeliest first: ``holds`` says of each place whether its bigram is the template's."""
    def described(t: Column, own: Column) -> Column:
        return let(_starts(places, own, t["n"], t["cap"], t["low"]), lambda starts: F.struct(
            F.get(starts, F.lit(0))["bound"].alias("bound"), *(t[c].alias(c) for c in ("rank", "licence", "n", "cap", "percent")),
            own.alias("holds"), starts.alias("starts")))

    return F.array_sort(F.filter(F.zip_with(near, holds, described), lambda t: F.size(t["starts"]) > 0))


def _kept(places: Column, tried: Column) -> Column:
    """A text's windows that stay, best first: those of a few tries if they settle it, else those of all."""
    def apart(found: Column) -> Column:
        return _apart(F.flatten(F.transform(found, lambda t: t["windows"])))

    def few(seeds: Column) -> Column:
        # What the likeliest template finds spares the others their starts inside.
        return F.transform(tried, lambda t, k: F.struct(
            F.when(k == 0, seeds).otherwise(_windows(places, t, seeds)).alias("windows"), t["rank"].alias("rank"), t["starts"].alias("starts")))

    def judged(found: Column) -> Column:
        return let(apart(found), lambda kept: F.when(_settled(found, kept), kept).otherwise(
            apart(F.transform(tried, lambda t: F.struct(_windows(places, t, None).alias("windows"))))))

    first = F.get(F.transform(F.slice(tried, 1, 1), lambda t: _windows(places, t, _none())), F.lit(0))
    return let(first, lambda seeds: let(few(seeds), judged))


def scan(docs: DataFrame, templates=TEMPLATES, threshold: float = THRESHOLD, text: str = "text",
         key: str = "doc_id") -> DataFrame:
    """Per document: key, n_units (matching windows), licences (distinct, sorted), licence and similarity (the best)."""
    percent = round(100 * threshold)
    lists = [_list(t) for _, t in templates]
    sets = [set(own) for own in lists]
    described = [(rank, name, len(own), size_bounds(len(whole), threshold)[1], size_bounds(len(own), threshold)[0], percent)
                 for rank, ((name, _), own, whole) in enumerate(zip(templates, sets, lists, strict=True))]
    templates_ = F.array(*(F.struct(*(F.lit(v).alias(c) for c, v in zip(("rank", "licence", "n", "cap", "low", "percent"), row)))
                           for row in described))
    # One hash set for all templates, as large as they are, whatever the documents.
    ranked = _in({f"{rank} {b}" for rank, own in enumerate(sets) for b in own})
    # A text is looked at if it holds enough of some short template, or enough template bigrams for a long one.
    short = [(own, low) for own, (*_, low, _) in zip(sets, described, strict=True) if len(own) <= SHORT]
    least = min((low for own, (*_, low, _) in zip(sets, described, strict=True) if len(own) > SHORT), default=None)

    body = whole_text(text)
    grams = docs.select(F.col(key).alias("row_key"), F.md5(body).alias("text_key"), body.alias("body"), _bigrams(body).alias("bigrams"))
    held = grams.withColumn("held", F.expr(f"array_distinct(filter(bigrams, b -> b IN {_in(set().union(*sets))}))"))
    enough = F.size("held") >= least if least is not None else F.lit(False)
    for own, low in short:
        enough = enough | ((F.size("held") >= low) & F.expr(f"size(filter(held, b -> b IN {_in(own)})) >= {low}"))
    rows = written(held.select("row_key", "text_key", F.when(enough, F.col("held")).alias("held"), F.when(enough, F.col("body")).alias("body")),
                   "licence-texts")
    texts = rows.filter("held IS NOT NULL").groupBy("text_key").agg(F.first("held").alias("held"), F.first("body").alias("body"))
    near = texts.select("text_key", "body", "held", templates_.alias("templates")).select("text_key", "body", F.expr(
        f"filter(templates, t -> size(held) >= t.low AND size(filter(held, b -> concat(string(t.rank), ' ', b) IN {ranked})) >= t.low)")
        .alias("near"))
    places = near.select("text_key", "near", F.when(F.size("near") > 0, _places(_bigrams(F.col("body")))).alias("places"))
    marked = places.select("text_key", "near", "places", F.expr(
        f"transform(near, t -> transform(places, x -> concat(string(t.rank), ' ', x.b) IN {ranked}))").alias("holds"))
    kept = written(marked.select(F.col("text_key").alias("kept_key"), let(F.col("places"), lambda places: let(
        _tried(places, F.col("near"), F.col("holds")), lambda tried: _kept(places, tried))).alias("kept")), "licence-kept")

    best = F.get("kept", F.lit(0))
    return rows.join(kept, F.col("text_key") == F.col("kept_key"), "left").select(
        F.col("row_key").alias(key), F.coalesce(F.size("kept"), F.lit(0)).cast("long").alias("n_units"),
        F.coalesce(F.array_join(F.array_sort(F.array_distinct(F.transform("kept", lambda m: m["licence"]))), ","), F.lit(""))
        .alias("licences"), best["licence"].alias("licence"), (-best["order"]).alias("similarity"))
