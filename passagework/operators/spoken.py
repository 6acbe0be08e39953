"""What was heard: transcripts without what nobody said, and items scored by the key words that were heard."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def transcript(segments: Column, prompt: Column, ghosts: Sequence[str], most: int = 500, silent: float = 0.6, unsure: float = -0.7, lost: float = -1.2) -> Column:
    """The text of segments (text, avg_logprob, no_speech_prob), without those that are likely silence or too unsure; empty
    where nothing is left, where it is a ghost phrase, or where four words or more only echo the prompt. Null numbers keep a
    segment, and a null prompt echoes nothing."""
    bad = lambda s: ((s.no_speech_prob > silent) & (s.avg_logprob < unsure)) | (s.avg_logprob < lost)
    kept = F.filter(segments, lambda s: ~F.coalesce(bad(s), F.lit(False)))
    joined = F.coalesce(F.array_join(F.transform(kept, lambda s: F.coalesce(s.text, F.lit(""))), " "), F.lit(""))
    text = F.trim(F.regexp_replace(joined, "\\s+", " "))
    bare = F.regexp_replace(text, "[.,:;!?]+$", "")
    echo = (F.size(F.split(text, "\\s+")) >= 4) & F.coalesce(F.contains(prompt, bare), F.lit(False))
    ghost = F.lit(False)
    for g in ghosts:
        ghost = ghost | text.rlike(g)
    return F.when(echo | ghost, "").otherwise(F.substring(text, 1, most))


def missed(keys: Column, heard: Column, longer: int = 2) -> Column:
    """The key words that are no heard word, nor the end of one that is at most so many letters longer."""
    same = lambda k: F.exists(heard, lambda w: (w == k) | (F.endswith(w, k) & (F.length(w) <= F.length(k) + longer)))
    return F.filter(keys, lambda k: ~same(k))
