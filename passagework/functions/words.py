"""Functions of single words: affix stems, keys, forms, distances. Columns in, columns out; all lists are parameters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

PREFIXES, SUFFIXES = ("under", "un", "re"), ("ing", "ed", "es", "er", "s")


def ends_cut(w: Column, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """A word without the first of the suffixes that leaves three letters, or four for a suffix of one letter."""
    out = w
    for s in reversed(suffixes):
        left = F.length(w) - len(s)
        out = F.when(w.endswith(s) & (left >= (4 if len(s) == 1 else 3)), F.substring(w, F.lit(1), left)).otherwise(out)
    return F.when(F.length(w) > 3, out).otherwise(w)


def affix_stem(w: Column, prefixes: Sequence[str] = PREFIXES, suffixes: Sequence[str] = SUFFIXES) -> Column:
    """Light stem: one prefix goes if two letters stay, then suffixes as long as one can go."""
    bare = w
    for p in reversed(prefixes):
        bare = F.when(w.startswith(p) & (F.length(w) - len(p) >= 2), F.substring(w, F.lit(len(p) + 1), F.length(w))).otherwise(bare)
    return F.aggregate(F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(w))), bare, lambda acc, _: ends_cut(acc, suffixes))


def root_key(w: Column, articles: Sequence[str] = ("the", "an"), plurals: Sequence[str] = ("es", "s"), weak: str = "aeiou") -> Column:
    """Key of a word's root: article and plural off (three letters stay), then weak letters if two others remain."""
    bare = w
    for a in reversed(articles):
        bare = F.when(w.startswith(a) & (F.length(w) - len(a) >= 3), F.substring(w, F.lit(len(a) + 1), F.length(w))).otherwise(bare)
    cut = lambda x: F.coalesce(*(F.when(x.endswith(p) & (F.length(x) - len(p) >= 3), F.substring(x, F.lit(1), F.length(x) - len(p))) for p in plurals), x)
    hard = F.regexp_replace(cut(bare), f"[{weak}]", "")
    return F.when(F.length(hard) >= 2, hard).otherwise(cut(bare))


def base_forms(w: Column, prefixes: Sequence[str], suffixes: Sequence[str], least: int = 3) -> Column:
    """All forms that a word may come from: up to two of the prefixes and one suffix off, a last i also as y."""
    first = F.array(w, *(F.when(w.startswith(p), F.substring(w, F.lit(len(p) + 1), F.length(w))) for p in prefixes))
    again = lambda x: F.array(x, *(F.when(x.startswith(p), F.substring(x, F.lit(len(p) + 1), F.length(x))) for p in prefixes))
    ends = lambda x: F.array(x, *(F.when(x.endswith(s), F.substring(x, F.lit(1), F.length(x) - len(s))) for s in suffixes))
    spelled = lambda x: F.array(x, F.when(x.endswith("i"), F.concat(F.substring(x, F.lit(1), F.length(x) - 1), F.lit("y"))))
    forms = first
    for step in (again, ends, spelled):
        forms = F.flatten(F.transform(forms, step))
    return F.array_sort(F.array_distinct(F.filter(forms, lambda x: F.length(x) >= least)))


def attached_forms(w: Column, prefixes: Sequence[str], suffixes: Sequence[str]) -> Column:
    """A word and what it becomes with each prefix, and with each suffix."""
    return F.array(w, *(F.concat(F.lit(p), w) for p in prefixes), *(F.concat(w, F.lit(s)) for s in suffixes))


def sound_key(w: Column) -> Column:
    """Transliteration key: long vowels folded, doubled letters single."""
    for long, short in (("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u")):
        w = F.replace(w, F.lit(long), F.lit(short))
    return F.regexp_replace(w, "(.)\\1+", "$1")


def sound_forms(w: Column) -> Column:
    """Forms of a word for an index: its key, the key without a last vowel, and its consonants if there are three."""
    key = sound_key(w)
    hard = F.regexp_replace(key, "[aeiou]", "")
    return F.array_distinct(F.filter(F.array(key, F.regexp_replace(key, "[aeiou]\\z", ""), F.when(F.length(hard) >= 3, hard)), lambda x: F.length(x) > 0))


def counted(n: Column, one: str, two: str, many: str, digits: tuple[str, str] | None = None) -> Column:
    """A number with its noun: none, one, a pair, few (3 to 10), more; digits: (ASCII digits, those of a language)."""
    number = F.translate(n.cast("string"), *digits) if digits else n.cast("string")
    words = F.when(n == 0, F.lit(f"no {many}")).when(n == 1, F.lit(one)).when(n == 2, F.lit(two)).when(n <= 10, F.concat_ws(" ", number, F.lit(many)))
    return words.otherwise(F.concat_ws(" ", number, F.lit(one)))


def distance_free_end(a: Column, b: Column, alike: str) -> Column:
    """Edit distance where the two last letters may differ freely if both are among the letters alike."""
    last = lambda x: F.substring(x, -1, 1)
    bare = lambda x: F.substring(x, F.lit(1), F.greatest(F.lit(0), F.length(x) - 1))
    free = F.lit(alike).contains(last(a)) & F.lit(alike).contains(last(b)) & (F.length(a) > 0) & (F.length(b) > 0)
    return F.least(F.levenshtein(a, b), F.when(free, F.levenshtein(bare(a), bare(b))))


def subsequence(a: Column, b: Column) -> Column:
    """Whether the letters of a (letters and digits only) come in b in this order, as one pattern."""
    return F.regexp_like(b, F.array_join(F.split(a, ""), ".*"))


def reference(c: Column) -> Column:
    """(group, first, last) of a reference s:a or s:a-b in a text, ends in order; null fields where there is none."""
    at = lambda k: F.nullif(F.regexp_extract(c, r"(\d+) ?: ?(\d+)(?: ?- ?(\d+))?", k), F.lit("")).cast("int")
    last = F.coalesce(at(3), at(2))
    return F.struct(at(1).alias("group"), F.least(at(2), last).alias("first"), F.greatest(at(2), last).alias("last"))


def pieces(c: Column, most: int, continues: str = "^[a-z(,;:]", least: int = 30) -> Column:
    """Passage units: sentences in order, one that is short, starts as a continuation, or follows a short one is joined
    to the one before while both fit; every unit is a run of whole sentences."""
    parts = F.filter(F.transform(F.regexp_extract_all(c, F.lit("[^.!?;]+[.!?;]*"), F.lit(0)), lambda s: F.trim(s)), lambda s: F.length(s) >= 2)
    last = lambda acc: F.element_at(acc, -1)
    joins = lambda acc, s: ((F.length(s) < least) | s.rlike(continues) | (F.length(last(acc)) < least)) & (F.length(last(acc)) + 1 + F.length(s) <= most)
    step = lambda acc, s: F.when((F.size(acc) > 0) & joins(acc, s), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", last(acc), s)))).otherwise(F.concat(acc, F.array(s)))
    return F.aggregate(parts, F.array().cast("array<string>"), step)


def packed(words: Column, most: int) -> Column:
    """Words packed greedily into lines of at most so many characters; a longer word is a line of its own."""
    last = lambda acc: F.element_at(acc, -1)
    fits = lambda acc, w: (F.size(acc) > 0) & (F.length(last(acc)) + 1 + F.length(w) <= most)
    step = lambda acc, w: F.when(fits(acc, w), F.concat(F.slice(acc, 1, F.size(acc) - 1), F.array(F.concat_ws(" ", last(acc), w)))).otherwise(F.concat(acc, F.array(w)))
    return F.aggregate(words, F.array().cast("array<string>"), step)


def aligned(a: Column, b: Column, window: int = 4, most: float = 0.6) -> Column:
    """For each word of an array its place (from 1) in another, in order: the closest of the next few words by edit
    distance over the word's length, the first of equals; null where it is further than most. Null arrays give null."""
    kind = "struct<at:int,places:array<int>>"
    start = F.struct(F.lit(1).alias("at"), F.array().cast("array<int>").alias("places")).cast(kind)

    def step(s: Column, w: Column) -> Column:
        ahead = F.slice(b, s["at"], F.lit(window))
        found = F.array_min(F.transform(ahead, lambda x, i: F.struct((F.levenshtein(w, x) / F.greatest(F.length(w), F.lit(1))).alias("d"), (s["at"] + i).alias("j"))))
        hit = F.transform(F.array(found), lambda f: F.when(f["d"] <= most, f["j"]))
        return F.transform(hit, lambda j: F.struct(F.coalesce(j + 1, s["at"]).alias("at"), F.concat(s["places"], F.array(j)).alias("places")))[0].cast(kind)

    return F.when(a.isNotNull() & b.isNotNull(), F.aggregate(a, start, step, lambda s: s["places"]))
