"""Operator 7: secret scans. DataFrame functions only.

Three base rules find assignments, access keys and long hexadecimal strings. To these come tokens of 12 characters and more
that a character Markov model of random strings explains better than one of ordinary identifiers; both models are bigram
tables trained on labelled samples, and a token's score is the log-likelihood ratio of its characters. Tokens without a
letter and UUIDs are names, not secrets.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import beside, table

#: The base rules, as the contract states them: kind, pattern, what a text must have at all.
ASSIGN = r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
ASSIGN_LEAST, ACCESS_LEAST, HEX_LEAST = 12, 18, 16

#: Symbols of the models: letters, one symbol for all digits, and signs.
ALPHABET = "abcdefghijklmnopqrstuvwxyzABCDEFGHIJKLMNOPQRSTUVWXYZ0+/_=-"
TOKEN, TOKEN_LEAST = "[A-Za-z0-9+/_=-]", 12
#: Tokens that name a thing by chance digits, as an identifier does.
UUID = "^[0-9A-Fa-f]{8}(-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}$"
#: Log-likelihood ratio a character pair from which a token counts as random, and over the whole token.
PER_CHARACTER, IN_ALL = 0.7, 12.0
#: Values that running() folds, and characters that cut() scans, at once.
BLOCK, TEXT_BLOCK = 128, 4096
#: Bounds of the training sample: documents whose words go into identifiers, identifiers of each, made ones, random strings.
SAMPLE_DOCS, FROM_EACH, MADE, RANDOM_STRINGS, SMOOTHING, BACK_OFF = 400, 10, 4000, 3000, 0.5, 20.0
#: Words that programs name things with, of which ordinary identifiers are made.
WORDS = """account action address admin agent allow apply archive async audit author base batch before binary block
board border bridge browser build button cache cancel card case cell center chain channel check child clean client
clone cluster code color command compare complete connect content context copy count create custom data date decode
default delete detail device digest display document domain draw driver email engine entry error example export
extract feature fetch field filter find flag format frame from general get global handle header history host image
import init input insert item job join key label language length level link load local lock main manager map match
memory message mode model name network next node number object offset option order output page panel parent password
path payload player plugin point pool port post print process product project property provider quantity quick quota
read record redirect region release remote render report reset return role route rule run save scan scope screen send
set shell size sort spec start state status stop sum sync table tag task text theme time token tool top tree trigger
type unique unit update user value version wait watch web width word wrap xml year zip""".split()


def symbols(text: Column) -> Column:
    """All digits as one symbol."""
    return F.translate(text, "123456789", "000000000")


def bigrams(labelled: DataFrame) -> DataFrame:
    """(random, pair, n) for labelled strings (text, random)."""
    pairs = F.transform(F.sequence(F.lit(1), F.length("text") - 1), lambda i: F.substring(symbols(F.col("text")), i, F.lit(2)))
    return labelled.filter(F.length("text") > 1).select("random", F.explode(pairs).alias("pair")).groupBy("random", "pair").agg(F.count("*").alias("n"))


def identifier(words: Column, by: Column) -> Column:
    """An identifier of up to six words: joined by a sign, in capitals, in camel case, as a path, or with a number; by chooses."""
    low = F.transform(words, F.lower)
    title = F.array_join(F.transform(low, F.initcap), "")
    camel = F.concat(F.element_at(low, 1), F.array_join(F.transform(F.slice(low, 2, 5), F.initcap), ""))
    shapes = [
        F.array_join(low, "_"), F.array_join(low, "-"), title, camel, F.upper(F.array_join(low, "_")), F.array_join(low, "/"),
        F.concat(F.lit("/"), F.array_join(low, "/"), F.lit("/"), title), F.concat(F.array_join(low, "-"), F.pmod(by, F.lit(2031)).cast("string")), F.array_join(low, ""),
    ]
    return F.when(F.size(words) > 0, F.element_at(F.array(*shapes), (F.pmod(by, F.lit(len(shapes))) + 1).cast("int")))


def labelled_strings(docs: DataFrame, sample_docs: int = SAMPLE_DOCS, random_strings: int = RANDOM_STRINGS, made: int = MADE) -> DataFrame:
    """(text, random): random strings in four alphabets; and identifiers of nine shapes, made of a list of words and of
    neighbouring words of the sample_docs distinct texts of least hash, whose base matches are taken out before."""
    spark = docs.sparkSession
    drawn = lambda *x: F.xxhash64(F.lit("secret"), *x)
    seed = F.sha2(F.concat(F.lit("secret:"), F.col("id").cast("string")).cast("binary"), 256)
    coded = F.translate(F.base64(F.unhex(F.concat(seed, seed.substr(1, 8)))), "=", "")
    low = F.lower(F.translate(coded, "+/", "q7"))
    strings = F.element_at(F.array(coded, F.translate(coded, "+/", "kW"), F.upper(low), low), (F.col("id") % 4 + 1).cast("int"))
    positive = spark.range(random_strings).select(F.substring(strings, F.lit(1), (F.pmod(drawn("id"), F.lit(33)) + 16).cast("int")).alias("text"), F.lit(True).alias("random"))

    n = lambda key: (F.pmod(drawn(*key, F.lit("n")), F.lit(5)) + 2).cast("int")
    word = lambda i: F.element_at(F.array(*map(F.lit, WORDS)), (F.pmod(F.xxhash64("id", i), F.lit(len(WORDS))) + 1).cast("int"))
    own = spark.range(made).select(identifier(F.transform(F.sequence(F.lit(1), n(["id"])), word), drawn("id", F.lit("shape"))).alias("text"), F.lit(False))

    texts = docs.select("text", F.xxhash64("text").alias("h")).filter("text <> ''")
    least = texts.select("h").distinct().orderBy("h").limit(sample_docs)  # copies count once; the texts themselves stay where they are
    some = texts.join(F.broadcast(least), "h", "left_semi").distinct().orderBy("h", "text").limit(sample_docs)
    bare = F.col("text")
    for rule in (ASSIGN, ACCESS, HEX.replace("+", f"{{{HEX_LEAST},}}")):
        bare = F.regexp_replace(bare, rule, " ")
    words = some.select("h", F.regexp_extract_all(bare, F.lit("[A-Za-z]{3,12}"), F.lit(0)).alias("w")).filter(F.size("w") > 0)
    words = words.select("w", F.explode(F.transform(F.sequence(F.lit(1), F.lit(FROM_EACH)), lambda k: F.xxhash64("h", k))).alias("at"))
    found = words.select(identifier(F.slice("w", (F.pmod("at", F.size("w")) + 1).cast("int"), n(["at"])), drawn("at", F.lit("shape"))).alias("text"), F.lit(False))
    return positive.union(own).union(found)


def train(labelled: DataFrame, smoothing: float = SMOOTHING) -> list[float]:
    """Log-likelihood ratio of each pair of characters (random over ordinary), row by row of ALPHABET.

    What reaches the driver is at most two counts for each pair of the alphabet.
    """
    size = len(ALPHABET)
    counts = {kind: [[0] * size for _ in range(size)] for kind in (True, False)}
    for kind, pair, n in bigrams(labelled).filter(F.col("pair").rlike(f"^{TOKEN}{TOKEN}$")).collect():
        counts[kind][ALPHABET.index(pair[0])][ALPHABET.index(pair[1])] += n
    chance = {}
    for kind, rows in counts.items():  # a pair's chance backs off to that of its second character
        single = [smoothing + sum(row[b] for row in rows) for b in range(size)]
        single = [x / sum(single) for x in single]
        chance[kind] = [[(n + BACK_OFF * p) / (sum(row) + BACK_OFF) for n, p in zip(row, single, strict=True)] for row in rows]
    return [math.log(chance[True][a][b] / chance[False][a][b]) for a in range(size) for b in range(size)]


def let(value: Column, then) -> Column:
    """then(value), with the value computed once."""
    return F.element_at(F.transform(F.array(value), then), 1)


def _folded(values: Column, join) -> Column:
    step = lambda acc, x: F.struct(join(acc["last"], x).alias("last"), F.concat(acc["all"], F.array(join(acc["last"], x))).alias("all"))
    return F.aggregate(values, F.struct(F.lit(0).alias("last"), F.array().cast("array<int>").alias("all")), step, lambda acc: acc["all"])


def running(values: Column, join) -> Column:
    """Results of an associative join of each value of array<int> with all before it; the first is joined with 0.

    Blocks are folded by themselves and then raised by what is before them, so that long arrays take little more than
    linear time.
    """
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(values) - 1) / BLOCK).cast("int")), lambda k: _folded(F.slice(values, k * BLOCK + 1, BLOCK), join))
    before = lambda own: _folded(F.transform(own, lambda b: F.element_at(b, -1)), join)
    raised = lambda own: let(before(own), lambda tops: F.flatten(F.transform(own, lambda b, k: F.transform(b, lambda x: join(F.coalesce(F.get(tops, k - 1), F.lit(0)), x)))))
    return F.when(F.size(values) > 0, let(blocks, raised)).otherwise(F.array().cast("array<int>"))


def ratio(text: Column, model: list[float]) -> Column:
    """Log-likelihood ratio of each character pair of a string, summed."""
    held = F.split(F.lit(" ".join(f"{x:.6f}" for x in model)), " ").cast("array<double>")
    places = F.transform(F.regexp_extract_all(symbols(text), F.lit("(?s)."), F.lit(0)), lambda c: F.instr(F.lit(ALPHABET), c))
    pair = lambda a, b: F.element_at(held, (a - 1) * len(ALPHABET) + b)
    pairs = lambda p: F.zip_with(F.slice(p, 1, F.size(p) - 1), F.slice(p, 2, F.size(p) - 1), pair)
    return F.aggregate(let(places, pairs), F.lit(0.0), lambda acc, x: acc + x)


SPANS = "array<struct<start:int,kind:int,end:int,word:string>>"


def matches(text: Column, pattern: str, kind: int, when: Column, word_group: int = 0) -> Column:
    """Spans of all matches of a pattern, left to right, in code points: what lies between them is what split leaves."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    word = found if word_group == 0 else F.regexp_extract_all(text, F.lit(pattern), F.lit(word_group))

    def spans(x: Column) -> Column:
        steps = F.zip_with(x["found"], F.slice(x["between"], F.lit(1), F.size(x["found"])), lambda m, gap: F.length(gap) + F.length(m))
        span = lambda ends: lambda m, i: F.struct((F.get(ends, i) - F.length(m)).alias("start"), F.lit(kind).alias("kind"), F.get(ends, i).alias("end"), F.get(x["word"], i).alias("word"))
        return let(running(steps, lambda a, b: a + b), lambda ends: F.transform(x["found"], span(ends)))

    parts = F.struct(found.alias("found"), word.alias("word"), F.split(text, pattern, -1).alias("between"))
    return F.when(when, let(parts, spans)).otherwise(F.array().cast(SPANS))


def apart(tokens: Column, base: Column) -> Column:
    """The tokens that overlap no base span: of the spans that begin before a token's end, none ends after its start."""
    of_token = F.transform(tokens, lambda t: F.struct(t["end"].alias("at"), F.lit(0).alias("is_base"), F.lit(0).alias("reach"), t.alias("span")))
    of_base = F.transform(base, lambda b: F.struct(b["start"].alias("at"), F.lit(1).alias("is_base"), b["end"].alias("reach"), b.alias("span")))

    def free(events: Column) -> Column:
        reach = running(F.transform(events, lambda e: e["reach"]), F.greatest)
        alone = lambda seen: F.filter(events, lambda e, i: (e["is_base"] == 0) & (F.get(seen, i) <= e["span"]["start"]))
        return F.transform(let(reach, alone), lambda e: e["span"])

    return F.when(F.size(base) == 0, tokens).otherwise(let(F.array_sort(F.concat(of_token, of_base)), free))


NAMES = ("assign", "access", "hex", "random")


def secrets_in(text: Column, model: list[float], per_character: float = PER_CHARACTER, in_all: float = IN_ALL) -> Column:
    """Array of (start, kind, end, word), by start, then kind; kind is a place in NAMES. Null and empty texts have none."""
    text = F.coalesce(text, F.lit(""))
    base = F.concat(
        F.filter(matches(text, ASSIGN, 0, text.rlike(r"(?i:passw|secret|token|api_?key)"), 2), lambda s: F.length(s.word) >= ASSIGN_LEAST),
        F.filter(matches(text, ACCESS, 1, text.contains("AKIA")), lambda s: s.end - s.start >= ACCESS_LEAST),
        matches(text, HEX.replace("+", f"{{{HEX_LEAST},}}"), 2, text.rlike(HEX.replace("+", f"{{{HEX_LEAST}}}"))),
    )
    tokens = matches(text, f"{TOKEN}{{{TOKEN_LEAST},}}", 3, text.rlike(f"{TOKEN}{{{TOKEN_LEAST}}}"))
    named = lambda t: ~t["word"].rlike("[A-Za-z]") | t["word"].rlike(UUID)
    high = lambda t: ~named(t) & let(ratio(t["word"], model), lambda r: (r >= in_all) & (r >= per_character * (F.length(t["word"]) - 1)))
    return let(F.struct(base.alias("base"), tokens.alias("tokens")), lambda x: F.array_sort(F.concat(x["base"], F.filter(apart(x["tokens"], x["base"]), high))))


def find_secrets(docs: DataFrame, model: list[float], per_character: float = PER_CHARACTER, in_all: float = IN_ALL) -> DataFrame:
    """docs and a column secrets, see secrets_in; docs must not have a column of that name.

    A random token that overlaps a base match is left out. Texts of any length are scanned whole, in time that follows
    their length; rows are independent, so repeated rows have repeated results. An empty table gives an empty result.
    """
    if "secrets" in [c.lower() for c in docs.columns]:
        raise ValueError("docs has a column secrets already")
    return docs.withColumn("secrets", secrets_in(F.col("text"), model, per_character, in_all))


def listed(spans: Column) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*map(F.lit, NAMES))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.element_at(names, s.kind + 1), s.start.cast("string"), s.end.cast("string"))), ",")


def cut(blocks: Column, begin: Column, end: Column) -> Column:
    """The characters from begin up to end of a text that was cut into blocks of TEXT_BLOCK characters."""
    first = F.floor(begin / TEXT_BLOCK).cast("int")
    own = F.slice(blocks, first + 1, F.greatest(F.lit(0), F.floor((end - 1) / TEXT_BLOCK).cast("int") - first + 1))

    def part(x: Column, i: Column) -> Column:
        at = (first + i) * TEXT_BLOCK
        return F.substring(x, F.greatest(begin - at, F.lit(0)) + 1, F.greatest(F.lit(0), F.least(end - at, F.lit(TEXT_BLOCK)) - F.greatest(begin - at, F.lit(0))))

    return F.array_join(F.transform(own, part), "")


def redacted(text: Column, secrets: Column, mark: str = "[SECRET]") -> Column:
    """A text with each run of overlapping secrets replaced by a mark."""

    def clean(x: Column) -> Column:
        before = lambda i: F.coalesce(F.get(x["reach"], i - 1), F.lit(0))
        kept = F.transform(x["secrets"], lambda s, i: F.when((i == 0) | (s["start"] >= before(i)), F.concat(cut(x["blocks"], before(i), s["start"]), F.lit(mark))).otherwise(""))
        return F.concat(F.array_join(kept, ""), cut(x["blocks"], F.element_at(x["reach"], -1), x["length"]))

    parts = F.struct(secrets.alias("secrets"), running(F.transform(secrets, lambda s: s["end"]), F.greatest).alias("reach"), F.regexp_extract_all(text, F.lit(f"(?s).{{1,{TEXT_BLOCK}}}"), F.lit(0)).alias("blocks"), F.length(text).alias("length"))
    return F.when(F.size(secrets) > 0, let(parts, clean)).otherwise(text)


def redact(found: DataFrame, mark: str = "[SECRET]") -> DataFrame:
    """Texts of find_secrets' result with each run of secrets replaced by a mark, n_chars counted anew; the column secrets goes."""
    changed = F.size("secrets") > 0
    out = beside(found, clean=redacted(F.col("text"), F.col("secrets"), mark), changed=changed)
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("changed"), F.length("clean")).otherwise(F.col("row.n_chars")) if "n_chars" in found.columns else None}
    return out.select(*(new.get(c, F.col("row")[c]).cast(found.schema[c].dataType).alias(c) for c in found.columns if c != "secrets"))


def op7_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Secrets of all documents; null and empty texts have none, and texts of any length are scanned whole."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_secrets(docs, train(labelled_strings(docs)))
    count = lambda k: F.size(F.filter("secrets", lambda s: s.kind == k)).cast("long")
    base = F.filter("secrets", lambda s: s.kind < 3)
    return found.select(
        F.col("doc_id").cast("long"), count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(listed(base).cast("binary"), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"),
    )


def secret_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced by a mark and n_chars counted anew; other columns stay as they are."""
    model = train(labelled_strings(docs))
    rows = beside(docs, text=F.col("text"))
    clean = beside(find_secrets(rows, model), clean=redacted(F.col("text"), F.col("secrets")), changed=F.size("secrets") > 0)
    own = F.col("row")["row"]
    new = {"text": F.col("clean"), "n_chars": F.when(F.col("changed"), F.length("clean")).otherwise(own["n_chars"]) if "n_chars" in docs.columns else None}
    return clean.select(*(new.get(c, own[c]).cast(docs.schema[c].dataType).alias(c) for c in docs.columns))
