"""Answers under rules and refused texts, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from passagework.operators import dense, selection, spoken

LISTED = "q int, place int, sid string, kind string, ref string, part string, n int, text string, lead boolean, balanced boolean, harsh boolean, barred string"


def item(place, sid, kind, ref, text, part=None, n=0, lead=False, balanced=False, harsh=False, barred=None, q=1):
    return (q, place, sid, kind, ref, part, n, text, lead, balanced, harsh, barred)


def answered(spark, listed, picks, limits=selection.Limits()):
    choices = spark.createDataFrame([(q, p, k, c, s) for q, p, c, sids in picks for k, s in enumerate(sids)], "q int, point int, pick int, concept string, sid string")
    rows = selection.answers(choices, spark.createDataFrame(listed, LISTED), "q", limits).collect()
    points = [(r.concept, r.sid, r.auto) for r in sorted((r for r in rows if r.rule is None), key=lambda r: (r.q, r.point, r.place))]
    return points, sorted((r.sid, r.rule) for r in rows if r.rule)


def test_a_text_brings_its_note_or_goes(spark):
    listed = [item(0, "T1", "text", "1", "alpha beta"), item(1, "N1", "note", "1", "gamma delta"), item(2, "N2", "note", "1", "more words"), item(3, "T2", "text", "2", "no note here"), item(4, "R1", "report", "9", "a report")]
    points, dropped = answered(spark, listed, [(1, 0, "one", ["T1", "T2"]), (1, 1, "two", ["R1", "N1", "missing"])])
    assert points == [("one", "T1", False), ("one", "N1", True), ("two", "R1", False)] and dropped == [("T2", "R9")]


def test_budget_copies_and_caps(spark):
    long = "x y z " * 20
    listed = [item(0, "R1", "report", "1", long), item(1, "R2", "report", "2", long + "!"), item(2, "R3", "report", "3", "y z x " * 8), item(3, "R4", "report", "4", "q" * 1100), item(4, "R5", "report", "5", "five"), item(5, "R6", "report", "6", "six"), item(6, "R7", "report", "7", "bad", barred="R4")]
    points, dropped = answered(spark, listed, [(1, 0, "a", ["R7", "R1", "R2", "R3", "R4", "R5", "R6"]), (1, 1, "b", ["R6"]), (1, 2, "c", ["R5"])])
    assert points == [("a", "R1", False), ("a", "R5", False), ("b", "R6", False)]
    assert dropped == [("R2", "R1"), ("R3", "R1"), ("R4", "R6"), ("R7", "R4")]


def test_parts_of_one_answer_with_its_question_first(spark):
    listed = [item(0, "A1#q", "answer", "1", "ask", "question"), *(item(k, f"A1#{k}", "answer", "1", f"part {k}", "answer", k) for k in (1, 2, 3, 4)), item(9, "A2#1", "answer", "2", "other", "answer", 1)]
    points, dropped = answered(spark, listed, [(1, 0, "c", ["A1#3", "A2#1", "A1#1", "A1#2"])])
    assert points == [("c", "A1#q", True), ("c", "A1#1", False), ("c", "A1#3", False)] and dropped == [("A2#1", "R6")]


def test_a_leading_item_comes_first_or_nothing_stays(spark):
    listed = [item(0, "R1", "report", "1", "one", balanced=True), item(1, "R2", "report", "2", "two", lead=True, balanced=True)]
    assert answered(spark, listed, [(1, 0, "a", ["R1"]), (1, 1, "b", ["R2"])])[0] == [("b", "R2", False), ("a", "R1", False)]
    assert answered(spark, listed, [(1, 0, "a", ["R1"])]) == ([], [("R1", "R11")])


def test_merged_points_and_queries_apart(spark):
    listed = [item(k, f"R{q}{k}", "report", str(k), f"text {q} {k}", q=q) for q in (1, 2) for k in range(6)]
    points, _ = answered(spark, listed, [(q, p, c, [f"R{q}{p}"]) for q in (1, 2) for p, c in enumerate(["a", "b", "a", "c", "d", "e"])])
    assert points == [(c, f"R{q}{k}", False) for q in (1, 2) for c, k in (("a", 0), ("a", 2), ("b", 1), ("c", 3))]
    assert answered(spark, [], []) == ([], [])


def plain_refused(rows):
    out, taken = {}, {}
    for g, o, text in sorted(rows, key=lambda r: (str(r[0]), r[1])):
        k = None if text is None else "".join(c for c in text.lower() if c.isalnum())
        mine = taken.setdefault(g, [])
        hit = None if k is None else next((p for p, x in mine if x == k or min(len(x), len(k)) > 40 and (k in x or x in k)), None)
        out[g, o] = hit
        if hit is None and k is not None:
            mine.append((o, k))
    return out


@pytest.mark.parametrize("seed", [1, 2])
def test_contained_texts(spark, seed):
    rng = random.Random(seed)
    base = ["".join(rng.choice("abcdéf ") for _ in range(400)) for _ in range(4)]
    rows = [("g", 0, None), ("g", 1, ""), ("g", 2, " "), ("h", 1, base[0] * 300), ("h", 2, base[0])]
    for o in range(3, 160):
        b, at, n = rng.choice(base), rng.randrange(300), rng.choice([5, 39, 45, 60, 90, 300])
        rows.append((rng.choice("gh"), o, b[at : at + n] + rng.choice(["", "!", " the end"])))
    df = spark.createDataFrame([(*r, 1, 2, "k") for r in rows], "grp string, o int, text string, g int, mark int, _first string")
    got = {(r.grp, r.o): r.refused_by for r in selection.without_contained(df, "grp", "o", "text").collect()}
    want = plain_refused(rows)
    assert got == want and sum(v is not None for v in want.values()) > 30
    assert selection.without_contained(df.limit(0), "grp", "o", "text").count() == 0


def test_transcripts(spark):
    said = "array<struct<text: string, avg_logprob: double, no_speech_prob: double>>"
    rows = [
        (1, [("A clear  sentence", -0.1, 0.0), ("noise", -0.8, 0.7), ("mumble", -1.3, 0.0), ("and more.", None, None)], "prompt"),
        (2, [("one two three four.", -0.1, 0.0)], "zero one two three four five"), (3, [("one two.", -0.1, 0.0)], "one two"), (4, [(" The ... ", -0.1, 0.0)], None),
        (5, None, None), (6, [], None), (7, [("w " * 9000, -0.1, 0.0)], None), (8, [(None, -0.1, 0.0), ("kept", -0.1, 0.9)], None),
    ]
    df = spark.createDataFrame(rows, f"k int, s {said}, p string")
    got = {r.k: r.t for r in df.select("k", spoken.transcript(F.col("s"), F.col("p"), ["(?i)^[^a-z]*(the)[^a-z]*$", "^[^a-z]*$"]).alias("t")).collect()}
    assert got == {1: "A clear sentence and more.", 2: "", 3: "one two.", 4: "", 5: "", 6: "", 7: ("w " * 250), 8: "kept"}
    heard = spark.createDataFrame([(["pray", "rain", "x"], ["alpray", "terrain", "x"])], "k array<string>, h array<string>")
    assert heard.select(spoken.missed(F.col("k"), F.col("h"))).first()[0] == ["rain"]


def test_nearest_with_odd_vectors_and_ties(spark):
    rows = [(i, [1.0, 0.0]) for i in range(300)] + [(400, None), (401, []), (402, [0.0, 0.0]), (403, [float("nan"), 1.0]), (404, [1.0, None]), (405, [1.0, 2.0, 3.0]), (406, [0.0, 1.0])]
    df = spark.createDataFrame(rows, "id long, v array<double>")
    asked = df.filter("id in (0, 7, 400, 401, 402, 403, 404, 405, 406)").withColumnRenamed("id", "q0").select(F.col("q0").alias("id"), "v")
    got: dict = {}
    for r in dense.nearest(asked, df, "q", "id", "v", 3, 50, 2).collect():
        got.setdefault(r.q, []).append((r["rank"], r.id))
    assert {q: [i for _, i in sorted(x)] for q, x in got.items()} == {0: [1, 2, 3], 7: [0, 1, 2], 406: [0, 1, 2]}
