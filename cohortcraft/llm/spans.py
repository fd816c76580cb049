"""Match positions from SQL functions alone."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<start:int,end:int,found:string>>"
#: Matches whose places are added up in one go.  An array is copied when it grows, so longer lists go in runs of
#: this length, whose beginnings are added up first; the work stays in proportion to the matches.
RUN = 64


def let(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, with the value computed once."""
    return F.get(F.transform(F.array(value), lambda x: use(x)), 0)


def find_all(text: Column, pattern: str, accept: Callable[[Column], Column] | None = None, context: int = 0) -> Column:
    """Leftmost non-overlapping matches of a Java pattern: array of (start, end, found), with ``before`` if asked.

    Positions are code points, the end is exclusive.  The matches and the
    pieces between them come from the same regular expression, so their
    lengths add up to the positions.  Matches that ``accept`` refuses are
    dropped but still consume their text.  ``before`` holds the ``context``
    (at most RUN) characters before a match, for patterns that match no empty text.
    """
    nothing = F.array().cast(SPAN if not context else SPAN.replace("found:string", "found:string,before:string"))

    def length(s: Column) -> Column:
        return F.length(s["gap"]) + F.coalesce(F.length(s["m"]), F.lit(0))

    def step(acc: Column, s: Column) -> Column:
        start = acc["at"] + F.length(s["gap"])
        end = start + F.coalesce(F.length(s["m"]), F.lit(0))
        fields = [start.alias("start"), end.alias("end"), s["m"].alias("found")]
        tail = []
        if context:
            before = F.right(F.concat(acc["tail"], s["gap"]), F.lit(context))
            fields.append(before.alias("before"))
            tail = [F.right(F.concat(acc["tail"], s["gap"], F.coalesce(s["m"], F.lit(""))), F.lit(context)).alias("tail")]
        good = s["m"].isNotNull()
        if accept is not None:
            good = good & accept(s["m"])
        return F.struct(end.alias("at"), F.when(good, F.concat(acc["out"], F.array(F.struct(*fields)))).otherwise(acc["out"]).alias("out"), *tail)

    def begin(at: Column, runs: Column, i: Column) -> Column:
        tail = []
        if context:  # the run before has RUN matches, so at least as many characters as are asked for
            whole = F.array_join(F.transform(F.get(runs, i - 1), lambda s: F.concat(s["gap"], F.coalesce(s["m"], F.lit("")))), "")
            tail = [F.when(i > 0, F.right(whole, F.lit(context))).otherwise("").alias("tail")]
        return F.struct(at.alias("at"), nothing.alias("out"), *tail)

    def placed(runs: Column) -> Column:
        lengths = F.transform(runs, lambda run: F.aggregate(run, F.lit(0), lambda n, s: n + length(s)))
        starts = F.aggregate(lengths, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("out")), lambda acc, n: F.struct(
            (acc["at"] + n).alias("at"), F.concat(acc["out"], F.array(acc["at"])).alias("out")), lambda acc: acc["out"])
        both = F.zip_with(runs, starts, lambda run, at: F.struct(run.alias("run"), at.alias("at")))
        return F.flatten(F.transform(both, lambda b, i: F.aggregate(b["run"], begin(b["at"], runs, i), step, lambda acc: acc["out"])))

    def positions(found: Column) -> Column:
        steps = F.zip_with(F.split(text, pattern, -1), found, lambda gap, m: F.struct(gap.alias("gap"), m.alias("m")))
        runs = let(steps, lambda every: F.transform(F.sequence(F.lit(0), F.size(found).cast("int"), F.lit(RUN)),
                                                    lambda i: F.slice(every, i + 1, RUN)))
        return F.when(F.size(found) > 0, let(runs, placed)).otherwise(nothing)

    return let(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), positions)


def touching(spans: Column, others: Column) -> Column:
    """For each of ``spans`` (in order, apart from each other), whether one of ``others`` overlaps it.

    As many of ``others`` as begin before the span's end, less those that end
    by its start.  A span's place in the sorted list of both, less its own
    number, counts the others before it.
    """
    def before(of_span: str, of_other: str, span_first: int) -> Column:
        marks = F.sort_array(F.concat(
            F.transform(spans, lambda s: F.struct(s[of_span].alias("at"), F.lit(1 - span_first).alias("order"), F.lit(True).alias("span"))),
            F.transform(others, lambda s: F.struct(s[of_other].alias("at"), F.lit(span_first).alias("order"), F.lit(False).alias("span")))))
        places = F.filter(F.transform(marks, lambda m, i: F.when(m["span"], i)), lambda i: i.isNotNull())
        return F.transform(places, lambda place, k: place - k)

    return F.zip_with(before("end", "start", 1), before("start", "end", 0), lambda begun, ended: begun > ended)


def labelled(spans: Column, kind: str, rank: int, by_start: bool) -> Column:
    """Spans as (first, second, end, text form), ready to be sorted by start then kind, or kind then start."""
    keys = (lambda s: (s["start"], F.lit(rank))) if by_start else (lambda s: (F.lit(rank), s["start"]))
    return F.transform(spans, lambda s: F.struct(
        keys(s)[0].alias("a"), keys(s)[1].alias("b"), s["end"].alias("end"),
        F.concat_ws(":", F.lit(kind), s["start"].cast("string"), s["end"].cast("string")).alias("form")))


def joined(*labelled_spans: Column) -> Column:
    """The text forms of all spans in order, comma-joined."""
    return F.concat_ws(",", F.transform(F.array_sort(F.concat(*labelled_spans)), lambda s: s["form"]))
