"""Answers from closed lists: ordered choices under rules, with companions, budgets and merged points; contained texts refused."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from itertools import groupby
from typing import NamedTuple

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import kept


class Limits(NamedTuple):
    """Points of an answer, items of a point, characters; the last two for points made of an answered question's parts."""

    points: int = 3
    per_point: int = 2
    chars: int = 1200
    per_answer: int = 3
    answer_chars: int = 1600


def letters(c: Column) -> Column:
    """A text's letters and digits in lower case: what two texts must share to count as the same."""
    return F.regexp_replace(F.lower(c), r"[^\p{L}\p{N}]", "")


def barred(kind: Column, ruling: Column, direct: Column, shares: Column, harsh: Column, gentle: Column, sensitive: Column, off_sense: Column, lead: Column) -> Column:
    """The first rule that bars an item whatever else is chosen, null if none does.

    R3: parts of answers for rulings and nothing else for them. R12: an answer without the sense that is asked for. R4: a
    note of an indirect source that shares no word with the query. R5: a harsh text where a gentle one is needed. R10: a
    sensitive source that is not put first.
    """
    is_answer = kind == "answer"
    rules = [(ruling != is_answer, "R3"), (is_answer & off_sense, "R12"), ((kind == "note") & ~direct & ~shares, "R4"), (gentle & harsh, "R5"), (sensitive & ~lead, "R10")]
    out = F.lit(None).cast("string")
    for condition, name in reversed(rules):
        out = F.when(condition, name).otherwise(out)
    return out


class Item(NamedTuple):
    sid: str
    kind: str
    ref: str
    part: str | None
    n: int
    length: int
    lead: bool
    auto: bool = False


class Answer:
    """One query's choices, taken one by one. State: what is used, the texts seen, the characters spent, the points so far."""

    def __init__(self, limits: Limits, balanced: bool):
        self.limits, self.balanced = limits, balanced
        self.used: set[str] = set()
        self.texts: list[str] = []
        self.spent = 0
        self.points: list[tuple[str, list[Item]]] = []
        self.dropped: list[tuple[str, str]] = []

    def is_copy(self, text: str) -> bool:
        return any(text == x or len(x) > 40 and (text in x or x in text) for x in self.texts)

    def take(self, rows: Iterable[dict]) -> list[tuple[Item, dict]]:
        """The items of one point in order of choice, with their rows."""
        out: list[tuple[Item, dict]] = []
        for r in rows:
            if r["sid"] in self.used:
                continue
            answer = r["kind"] == "answer"
            cap, most = (self.limits.answer_chars, self.limits.per_answer) if answer else (self.limits.chars, self.limits.per_point)
            why = r["barred"] or ("R1" if self.is_copy(r["letters"]) else None)
            if why is None and (self.spent and self.spent + r["length"] > cap or answer and out and out[0][0].ref != r["ref"]):
                why = "R6"
            if why:
                self.dropped.append((r["sid"], why))
                continue
            self.used.add(r["sid"])
            self.texts.append(r["letters"])
            self.spent += r["length"]
            out.append((Item(*(r[f] for f in Item._fields[:-1])), r))
            if len(out) >= most:
                break
        return out

    def add_point(self, concept: str, rows: Iterable[dict]) -> bool:
        """Takes one point's choices; whether more points may follow."""
        taken = self.take(rows)
        items = [i for i, _ in taken]
        for item, r in taken:  # R9: a text never stands without a note on it
            if item.kind != "text" or any(x.kind == "note" and x.ref == item.ref for x in items):
                continue
            note = next((x for x in r["notes"] or [] if x["sid"] not in self.used), None)
            if note and not note["harsh"] and self.spent + note["length"] <= self.limits.chars:
                self.used.add(note["sid"])
                self.spent += note["length"]
                items.insert(items.index(item) + 1, Item(note["sid"], "note", item.ref, None, 0, note["length"], note["lead"], True))
            else:
                items.remove(item)
                self.spent -= item.length
                self.dropped.append((item.sid, "R9"))
        if not items:
            return True
        answer = items[0].kind == "answer"
        if answer and not any(x.part == "question" for x in items):
            asked = taken[0][1]["question"]
            if asked and asked["sid"] not in self.used:
                self.used.add(asked["sid"])
                items.insert(0, Item(asked["sid"], "answer", items[0].ref, "question", 0, asked["length"], False, True))
            del items[self.limits.per_answer :]
        if answer:
            items.sort(key=lambda x: (x.part != "question", x.n))
        same = next((p for c, p in self.points if c == concept and p[0].kind != "answer" and not answer), None)
        if same is not None:
            same += items[: self.limits.per_point + 1 - len(same)]
        else:
            self.points.append((concept, items))
        return len(self.points) < self.limits.points

    def settled(self) -> list[tuple[str, list[Item]]]:
        """The points once all choices are taken: texts that merging left alone go (R9), and where a leading item is needed
        its point comes first, or nothing stays (R11)."""
        for _, items in self.points:
            alone = [x for x in items if x.kind == "text" and not any(y.kind == "note" and y.ref == x.ref for y in items)]
            for x in alone:
                items.remove(x)
                self.dropped.append((x.sid, "R9"))
        points = [(c, items) for c, items in self.points if items]
        if self.balanced and points:
            first = next((k for k, (_, items) in enumerate(points) if any(x.lead for x in items)), None)
            if first is None:
                self.dropped += [(x.sid, "R11") for _, items in points for x in items]
                return []
            points.insert(0, points.pop(first))
        return points


def answers(choices: DataFrame, listed: DataFrame, by: str, limits: Limits = Limits()) -> DataFrame:
    """(by, point, place, concept, sid, auto, rule): each query's answer, and what was refused with the rule's name.

    choices: (by, point, pick, concept, sid) in order of points and picks; listed: (by, place, sid, kind, ref, part, n,
    text, lead, balanced, harsh, barred), the closed list of each query in order of place, kinds being text, note, report
    and answer. Choices outside of the list, or taken before, are passed over. Items that were refused have no point and
    no place. Rows of a query follow each other in one sorted pass; what is held is one query's answer, bounded by limits.
    """
    items = listed.select(by, "place", "sid", "kind", "ref", "part", F.coalesce("n", F.lit(0)).alias("n"), F.length("text").alias("length"), letters(F.col("text")).alias("letters"), F.coalesce("lead", F.lit(False)).alias("lead"), "balanced", "harsh", "barred")
    noted = items.filter("kind = 'note'").groupBy(by, "ref").agg(F.array_sort(F.collect_list(F.struct("place", "sid", "length", "lead", "harsh"))).alias("notes"))
    asked = items.filter("kind = 'answer' and part = 'question'").groupBy(by, "ref").agg(F.min(F.struct("place", "sid", "length")).alias("question"))
    picks = choices.select(by, "point", "pick", F.substring(F.coalesce("concept", F.lit("")), 1, 40).alias("concept"), "sid").join(items.drop("place"), [by, "sid"])
    picks = picks.join(noted.withColumn("kind", F.lit("text")), [by, "ref", "kind"], "left").join(asked.withColumn("kind", F.lit("answer")), [by, "ref", "kind"], "left")
    kind = choices.schema[by].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = (r for batch in batches for r in batch.to_pylist())
        for key, own in groupby(rows, lambda r: r[by]):
            answer, out = None, []
            for _, of_point in groupby(own, lambda r: r["point"]):
                of_point = list(of_point)
                answer = answer or Answer(limits, bool(of_point[0]["balanced"]))
                if len(answer.points) < limits.points:
                    answer.add_point(of_point[0]["concept"], of_point)
            points = answer.settled()
            out += [(key, p, k, c, x.sid, x.auto, None) for p, (c, items) in enumerate(points, 1) for k, x in enumerate(items, 1)]
            out += [(key, None, None, None, sid, False, rule) for sid, rule in answer.dropped]
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out, strict=True), types, strict=True)], names=names)

    names = [by, "point", "place", "concept", "sid", "auto", "rule"]
    types = [pa.int64() if kind.simpleString() == "bigint" else pa.int32() if kind.simpleString() == "int" else pa.string(), pa.int32(), pa.int32(), pa.string(), pa.string(), pa.bool_(), pa.string()]
    return picks.repartition(by).sortWithinPartitions(by, "point", "pick", "sid").mapInArrow(run, f"`{by}` {kind.simpleString()}, point int, place int, concept string, sid string, auto boolean, rule string")


def answerable(found: DataFrame, concepts: DataFrame, by: str, shown: Column) -> DataFrame:
    """(by, answerable, uncovered): yes, partial or no for each query of concepts (by, concept, ...), and the shown concepts without a point."""
    covered = found.filter("point is not null").select(by, "concept").distinct().withColumn("has", F.lit(True))
    any_point = found.filter("point is not null").select(by).distinct().withColumn("any", F.lit(True))
    left = concepts.join(covered, [by, "concept"], "left").groupBy(by).agg(F.array_sort(F.collect_list(F.when(F.col("has").isNull() & shown, F.col("concept")))).alias("uncovered"))
    state = F.when(F.col("any").isNull(), "no").when(F.size("uncovered") > 0, "partial").otherwise("yes")
    return left.join(any_point, by, "left").select(by, state.alias("answerable"), F.when(F.col("any").isNull(), F.array().cast("array<string>")).otherwise(F.col("uncovered")).alias("uncovered"))


GRAM, LEAST = 24, 41


def _marks(texts: list[str], gram: int, window: int) -> list[np.ndarray]:
    """For each text the distinct hashes of the least gram of each window of so many neighbouring grams."""
    out = []
    for t in texts:
        code = np.frombuffer(t.encode("utf-32-le"), np.uint32).astype(np.uint64)
        n = len(code) - gram + 1
        h = np.zeros(n, np.uint64)
        for j in range(gram):
            h = h * np.uint64(0x9E3779B97F4A7C15) + code[j : j + n]
        h ^= h >> np.uint64(31)
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
        low = h[: n - window + 1]
        for j in range(1, window):
            low = np.minimum(low, h[j : j + n - window + 1])
        out.append(np.unique(low))
    return out


def without_contained(rows: DataFrame, by: str, order: str, text: Column, least: int = LEAST, gram: int = GRAM, rounds: int = 50) -> DataFrame:
    """rows with a column refused_by: the smallest order of an accepted row of the same group that stands before and is equal
    by letters or, both being of at least so many letters, holds the text or lies in it; null for accepted rows.

    Rows are taken in order, which is unique within a group; a refused row refuses nobody. A text is listed under the least
    gram of each of its windows of least letters. What holds another text has all marks of that, so the shorter text asks
    under its rarest mark only. Equal texts are one class, whose first row stands for it. The greedy choice settles in
    rounds: what has no earlier rival left is accepted, and what has an accepted one is refused. Null texts are accepted
    and refuse nobody.
    """
    named = kept(rows.withColumn("_k", letters(text)), "lettered")
    firsts = named.filter(F.col("_k").isNotNull()).select(by, order, "_k").withColumn("_first", F.min(order).over(Window.partitionBy(by, "_k")))
    copies = firsts.filter(F.col(order) > F.col("_first")).select(by, order, "_first")
    heads = kept(firsts.filter(F.col(order) == F.col("_first")).select(F.col(by).alias("g"), F.col(order).alias("o"), F.col("_k").alias("k")).filter(F.length("k") >= least), "heads")

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = _marks(batch.column(2).to_pylist(), gram, least - gram + 1)
            row = pa.array(np.repeat(np.arange(len(found)), [len(x) for x in found]))
            flat = np.concatenate([*found, np.zeros(0, np.uint64)]).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(flat)], names=["g", "o", "mark"])

    types = {f.name: f.dataType.simpleString() for f in heads.schema.fields}
    marks = kept(heads.mapInArrow(mark, f"g {types['g']}, o {types['o']}, mark long"), "marks")
    rare = marks.join(marks.groupBy("g", "mark").agg(F.count("*").alias("n")), ["g", "mark"]).groupBy("g", "o").agg(F.min(F.struct("n", "mark"))["mark"].alias("mark"))
    met = rare.select("g", "mark", F.col("o").alias("short")).join(marks.select("g", "mark", F.col("o").alias("long")), ["g", "mark"]).filter("short <> long").select("g", "short", "long").distinct()
    parts, wholes = (heads.select("g", F.col("o").alias(o), F.col("k").alias(k)) for o, k in (("short", "part"), ("long", "whole")))
    met = met.join(parts, ["g", "short"]).join(wholes, ["g", "long"]).filter((F.length("part") < F.length("whole")) & F.contains(F.col("whole"), F.col("part")))
    rivals = kept(met.select("g", F.least("short", "long").alias("a"), F.greatest("short", "long").alias("b")).distinct(), "rivals")
    state = kept(heads.select("g", "o").join(rivals.select("g", F.col("b").alias("o")).distinct(), ["g", "o"], "left_anti").withColumn("by_o", F.lit(None).cast(heads.schema["o"].dataType)), "settled")
    open_ones, most = kept(rivals.select("g", F.col("b").alias("o")).distinct(), "open"), rounds
    while open_ones.count():
        if not most:
            raise RuntimeError("the choice did not settle")
        most -= 1
        before = open_ones.join(rivals, (open_ones["g"] == rivals["g"]) & (open_ones["o"] == rivals["b"])).select(open_ones["g"], open_ones["o"], "a")
        known = before.join(state.select(F.col("g").alias("sg"), F.col("o").alias("so"), F.col("by_o").isNull().alias("in")), (F.col("g") == F.col("sg")) & (F.col("a") == F.col("so")), "left")
        seen = known.groupBy("g", "o").agg(F.min(F.when(F.col("in"), F.col("a"))).alias("by_o"), F.count_if(F.col("in").isNull()).alias("unknown"))
        new = kept(seen.filter("by_o is not null or unknown = 0").select("g", "o", "by_o"), "settled")
        state, open_ones = state.union(new), kept(open_ones.join(new, ["g", "o"], "left_anti"), "open")
    # a refused row's smallest accepted rival stands once all is settled
    accepted = state.filter("by_o is null").select(F.col("g").alias("ag"), F.col("o").alias("ao"))
    final = rivals.join(accepted, (F.col("g") == F.col("ag")) & (F.col("a") == F.col("ao"))).groupBy("g", "b").agg(F.min("a").alias("by_o"))
    refused = final.select(F.col("g").alias("rg"), F.col("b").alias("ro"), "by_o")
    # a copy is refused by its class's first row, or by what refused that
    of_copies = copies.join(refused, (F.col(by) == F.col("rg")) & (F.col("_first") == F.col("ro")), "left").select(F.col(by).alias("rg"), F.col(order).alias("ro"), F.coalesce("by_o", "_first").alias("by_o"))
    every = refused.union(of_copies)
    return named.drop("_k").join(every, (F.col(by) == F.col("rg")) & (F.col(order) == F.col("ro")), "left").drop("rg", "ro").withColumnRenamed("by_o", "refused_by")
