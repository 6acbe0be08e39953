"""Text functions: normalisers, tokens, stems, sentences, excerpts, HTML. Columns in, columns out; all run in the JVM."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Arabic-Indic and extended digits, and ASCII ones in the same order.
DIGITS = ("٠١٢٣٤٥٦٧٨٩۰۱۲۳۴۵۶۷۸۹", "0123456789" * 2)
ACCENTS = ("àáâãäåçèéêëìíîïñòóôõöùúûüýÿ", "aaaaaaceeeeiiiinooooouuuuyy")
#: Small default stop list; every operator takes another as a parameter.
STOP = ("the", "and", "of", "to", "in", "is", "on", "for", "with", "de", "la", "le", "der", "die", "und", "que", "el", "en", "un", "et")


def fold_digits(c: Column) -> Column:
    return F.translate(c, *DIGITS)


def latin(c: Column) -> Column:
    """Lower case, accents off, everything but letters and digits to one blank, trimmed."""
    return F.trim(F.regexp_replace(F.translate(F.lower(fold_digits(c)), *ACCENTS), "[^a-z0-9]+", " "))


def by_rules(c: Column, rules: Sequence[tuple[str, str]]) -> Column:
    """A normaliser from ordered rules (pattern, replacement); the order matters."""
    for pattern, replacement in rules:
        c = F.regexp_replace(c, pattern, replacement)
    return F.trim(c)


def stem(w: Column) -> Column:
    """Light stem: plural endings, then -ing with a doubled consonant undone; at least three letters stay."""
    plural = (
        F.when((F.length(w) > 4) & w.endswith("ies"), F.concat(w.substr(F.lit(1), F.length(w) - 3), F.lit("y")))
        .when((F.length(w) > 4) & w.endswith("es"), w.substr(F.lit(1), F.length(w) - 2))
        .when((F.length(w) > 3) & w.endswith("s") & ~w.endswith("ss"), w.substr(F.lit(1), F.length(w) - 1))
        .otherwise(w)
    )
    cut = plural.substr(F.lit(1), F.length(plural) - 3)
    twice = cut.substr(F.length(cut), F.lit(1)) == cut.substr(F.length(cut) - 1, F.lit(1))
    return F.when((F.length(plural) > 5) & plural.endswith("ing"), F.when(twice, cut.substr(F.lit(1), F.length(cut) - 1)).otherwise(cut)).otherwise(plural)


def tokens(c: Column, stop: Sequence[str] = STOP, least: int = 2, stemmed: bool = True) -> Column:
    """Tokens in order, duplicates kept: normalise, split, drop stop words and short ones, then stem."""
    words = F.filter(F.split(latin(F.coalesce(c, F.lit(""))), " "), lambda w: (F.length(w) >= least) & ~w.isin(*stop))
    return F.transform(words, stem) if stemmed else words


def script(c: Column, default: str = "none") -> Column:
    """The script a text is in by its first letters found: arabic, latin, other, or the default without letters."""
    return F.when(c.rlike("[\\x{0600}-\\x{06FF}]"), "arabic").when(c.rlike("[A-Za-z]"), "latin").when(c.rlike("\\p{L}"), "other").otherwise(default)


def sentences(c: Column, least: int = 12) -> Column:
    """Sentences as exact substrings: up to a full stop, mark or line end; short ones are left out."""
    return F.filter(F.regexp_extract_all(c, F.lit("[^.!?\\n]+[.!?]*"), F.lit(0)), lambda s: F.length(F.trim(s)) >= least)


def truncate(c: Column, most: int) -> Column:
    """At most so many characters, cut at the last blank before, with an ellipsis."""
    head = F.substring(c, 1, most)
    return F.when(F.length(c) <= most, c).otherwise(F.concat(F.regexp_replace(head, "\\s+\\S*\\z", ""), F.lit("…")))


def strip_html(c: Column) -> Column:
    """Text of HTML: scripts, styles, comments and tags out, the common entities decoded, blanks collapsed."""
    c = F.regexp_replace(c, "(?s)<script.*?</script>|<style.*?</style>|<!--.*?-->", " ")
    c = F.regexp_replace(c, "<[^>]+>", " ")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        c = F.replace(c, F.lit(entity), F.lit(char))
    return F.trim(F.regexp_replace(c, "[ \\t\\r\\n]+", " "))


def links(c: Column) -> Column:
    """Targets of links, in order."""
    return F.regexp_extract_all(c, F.lit('<a href="([^"]*)"'), F.lit(1))


#: Tags inside a line of a page, and the start of a heading or paragraph with its text up to the next tag of a block.
INLINE, LINE = r"</?(?:a|abbr|b|br|code|em|i|small|span|strong|sub|sup|u)(?:[ \t\r\n/][^>]*)?>", r"<(?:h[1-6]|p)(?:[ \t\r\n][^>]*)?>[^<]*"


def lines(c: Column) -> Column:
    """Headings and paragraphs in order, each as its tag and its whole text; tags inside a line count as a space."""
    return F.regexp_extract_all(F.regexp_replace(c, INLINE, " "), F.lit(LINE), F.lit(0))


def line_text(c: Column) -> Column:
    """The text of a line of lines()."""
    return F.trim(F.regexp_replace(F.regexp_replace(c, "^<[^>]*>", ""), "[ \\t\\r\\n]+", " "))


def squeeze(c: Column) -> Column:
    """Key for near-equal strings: lower case, letters and digits only."""
    return F.regexp_replace(F.lower(c), "[^a-z0-9]", "")


def clip(c: Column, most: int) -> Column:
    """Control characters out, at most so many characters."""
    return F.substring(F.regexp_replace(c, "[\\x00-\\x1f\\x7f]", " "), 1, most)


def json_in(c: Column) -> Column:
    """The outermost braces in noisy text."""
    return F.regexp_extract(c, "\\{[\\s\\S]*\\}", 0)


def subsequence(a: Column, b: Column) -> Column:
    """Whether the letters of a come in b in this order."""
    rest = F.aggregate(F.split(a, ""), b, lambda left, x: F.when(F.instr(left, x) > 0, F.substring(left, F.instr(left, x) + 1, F.length(left))))
    return rest.isNotNull()
