"""Forms of words counted where texts lie: a word's forms are worked out once for a batch, and a text's forms are not shuffled."""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Forms and words that a task holds before it passes them on.
HELD = 300_000


def sound_forms(w: str) -> list[str]:
    """functions.words.sound_forms() of one word."""
    for long, short in (("aa", "a"), ("ee", "i"), ("ii", "i"), ("oo", "u"), ("uu", "u")):
        w = w.replace(long, short)
    key = re.sub(r"(.)\1+", r"\1", w)
    hard = re.sub("[aeiou]", "", key)
    return [x for x in dict.fromkeys((key, re.sub(r"[aeiou]\Z", "", key), hard if len(hard) >= 3 else "")) if x]


def of_texts(texts: DataFrame, key: str) -> DataFrame:
    """(form, docs, first_doc, words) of texts (key, ws: distinct words): how many texts have a form and the first of them,
    and from how many words it comes. Keys are unique or null; a null one is not counted."""
    kind = texts.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        docs, first, words = {}, {}, {}

        def out() -> pa.RecordBatch:
            pairs = [(f, w) for w, own in words.items() for f in own]
            lists = [[*docs, *(f for f, _ in pairs)], [*docs.values(), *[0] * len(pairs)], [*(first.get(f) for f in docs), *[None] * len(pairs)], [*[None] * len(docs), *(w for _, w in pairs)]]
            return pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(lists, (pa.string(), pa.int64(), id_type, pa.string()), strict=True)], names=["form", "docs", "first_doc", "w"])

        for batch in batches:
            id_type, ids = batch.column(0).type, batch.column(0).to_pylist()
            coded = batch.column(1).flatten().dictionary_encode()
            own = []
            for w in coded.dictionary.to_pylist():
                if w not in words:
                    words[w] = sound_forms(w)
                own.append(words[w])
            names = {f: k for k, f in enumerate(dict.fromkeys(f for x in own for f in x))}
            size = np.array([len(x) for x in own], np.int64)
            flat, begin = np.array([names[f] for x in own for f in x], np.int64), np.cumsum(size) - size
            code = coded.indices.to_numpy().astype(np.int64)
            row = np.repeat(np.arange(batch.num_rows), pc.fill_null(pc.list_value_length(batch.column(1)), 0).to_numpy(zero_copy_only=False))
            n = size[code]
            at = np.repeat(begin[code], n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            pair = np.unique(flat[at] * batch.num_rows + np.repeat(row, n)) if len(at) else np.zeros(0, np.int64)  # a form once for a text
            form, held = pair // max(1, batch.num_rows), pair % max(1, batch.num_rows)
            begins = np.flatnonzero(np.diff(form, prepend=-1))
            text = list(names)
            for f, lo, hi in zip(form[begins].tolist(), begins.tolist(), [*begins[1:].tolist(), len(form)], strict=True):
                there = [ids[k] for k in held[lo:hi].tolist() if ids[k] is not None]
                docs[text[f]] = docs.get(text[f], 0) + len(there)
                if there:
                    least = min(there)
                    first[text[f]] = min(least, first.get(text[f], least))
            if len(docs) + len(words) > HELD:
                yield out()
                docs, first, words = {}, {}, {}
        if docs:
            yield out()

    found = texts.mapInArrow(run, f"form string, docs long, first_doc {kind}, w string")
    return found.groupBy("form").agg(F.sum("docs").alias("docs"), F.min("first_doc").alias("first_doc"), F.count_distinct("w").alias("words"))
