"""Ordered rules, closed evidence lists, caps and checks."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def first_match(rules: Sequence[tuple[Column, str]], default: str | None = None) -> Column:
    """The kind of the first rule (condition, kind) that holds."""
    out = F.lit(default).cast("string")
    for condition, kind in reversed(rules):
        out = F.when(condition, kind).otherwise(out)
    return out


def failures(checks: Sequence[tuple[Column, str]]) -> Column:
    """Names of the checks that do not hold, in order."""
    return F.filter(F.array(*[F.when(~c, F.lit(name)) for c, name in checks]), lambda x: x.isNotNull())


def capped(df: DataFrame, by: Sequence[str], order: Sequence[Column], most: int) -> DataFrame:
    """At most so many rows of each group, in order."""
    return df.withColumn("_n", F.row_number().over(Window.partitionBy(*by).orderBy(*order))).filter(F.col("_n") <= most).drop("_n")


def first_seen(df: DataFrame, by: Sequence[str], order: Sequence[Column]) -> DataFrame:
    """The first row of each key."""
    return capped(df, by, order, 1)


def closed_list(selected: DataFrame, offered: DataFrame, on: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """(rows that were offered, rows that were not)."""
    return selected.join(offered, list(on), "left_semi"), selected.join(offered, list(on), "left_anti")


def spoken(rows: DataFrame, keys: Sequence[str], place: str, word: str, lists: Mapping[str, Sequence[str]], phrases: Mapping[str, str]) -> DataFrame:
    """rows (one word each) with a column kind: why a word of a spoken question is left out, null where it stays.

    Seven passes, each over what the ones before left: fillers and politeness; two-word phrases (phrase to kind, where no
    phrase ends as another begins); listed words, question words only while nothing that stays is before; speech verbs
    (frame_verb) beside a question or a subject, with the subjects that follow; subjects before a removed word;
    prepositions after a removed word and not last; the word "lone" after a removed one. lists has the words of filler,
    polite, q, want, ask, frame_verb, subject, prep, lone. All passes are windows over one order of a text's words.
    """
    if {p.split(" ")[0] for p in phrases} & {p.split(" ")[-1] for p in phrases}:
        raise ValueError("a phrase ends as another begins")
    by = Window.partitionBy(*keys).orderBy(place)
    before, after = by.rowsBetween(Window.unboundedPreceding, -1), by.rowsBetween(1, Window.unboundedFollowing)
    is_in = lambda name: F.col(word).isin(*lists.get(name, []))
    own = lambda *names: F.coalesce(*[F.when(is_in(n), F.lit(n)) for n in names])
    live = F.col("kind").isNull()
    r = rows.repartition(*keys).withColumn("kind", own("filler", "polite"))  # one shuffle for all windows
    near = Window.partitionBy(*keys, live).orderBy(place)
    r = r.withColumns({"_next": F.lead(word).over(near), "_last": F.lag(word).over(near)})
    pairs = F.create_map(*[F.lit(x) for p in phrases.items() for x in p]) if phrases else F.create_map().cast("map<string,string>")
    r = r.withColumn("kind", F.coalesce("kind", F.when(live, F.coalesce(pairs[F.concat_ws(" ", "_last", word)], pairs[F.concat_ws(" ", word, "_next")]))))
    r = r.withColumn("_stays", F.coalesce(F.sum(F.when(live & own("want", "ask", "q").isNull(), 1).otherwise(0)).over(before), F.lit(0)))
    r = r.withColumn("kind", F.coalesce("kind", own("want", "ask"), F.when(is_in("q") & (F.col("_stays") == 0), F.lit("q"))))
    r = r.withColumns({"_a": F.lag("kind").over(by), "_b": F.lead("kind").over(by), "_s": F.lead(is_in("subject")).over(by)})
    framed = live & is_in("frame_verb") & (F.col("_a").isin("q", "polite", "filler", "want", "ask") | F.col("_b").isin("q", "ask") | F.col("_s"))
    r = r.withColumn("_frame", F.coalesce(framed, F.lit(False)))
    subject = live & is_in("subject") & ~F.col("_frame")
    r = r.withColumn("_run", F.last(F.when(~subject, F.col("_frame")), ignorenulls=True).over(before))
    r = r.withColumn("kind", F.when(F.col("_frame") | subject & F.coalesce("_run", F.lit(False)), F.lit("frame")).otherwise(F.col("kind")))
    r = r.withColumn("_run", F.first(F.when(~(live & is_in("subject")), F.coalesce("kind", F.lit(""))), ignorenulls=True).over(after))
    r = r.withColumn("kind", F.coalesce("kind", F.when(is_in("subject") & F.col("_run").isin("frame", "q"), F.lit("frame"))))
    r = r.withColumns({"_run": F.last(F.when(~(live & is_in("prep")), F.coalesce("kind", F.lit(""))), ignorenulls=True).over(before), "_b": F.lead(F.lit(True)).over(by)})
    r = r.withColumn("kind", F.coalesce("kind", F.when(is_in("prep") & (F.col("_run") != "") & F.col("_b"), F.lit("frame"))))
    r = r.withColumn("_run", F.last(F.when(~(live & is_in("lone")), F.coalesce("kind", F.lit(""))), ignorenulls=True).over(before))
    r = r.withColumn("kind", F.coalesce("kind", F.when(is_in("lone") & (F.col("_run") != ""), F.col("_run"))))
    return r.drop("_next", "_last", "_stays", "_a", "_b", "_s", "_frame", "_run")
