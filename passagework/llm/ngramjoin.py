"""Operator 8: near copies by Jaccard similarity of five-word shingles, with signature trees.

Equal shingle sets become one class. Classes meet where they share a token of their prefixes (the least hashes of a set,
as many as make a common one certain at this similarity), so no link is lost. In such a bucket the classes' token
bitmaps are the leaves of a signature tree: a node holds the bits and the size range of what is below it, and a walk
over pairs of nodes drops those whose greatest possible overlap is too small. A bucket yields a spanning forest of its
candidates, the closest first, so a large group of copies costs as many pairs as it has members.

The forests join classes into families; no link leaves a family. A family's whole sets, in pairs of blocks if it is
large, are then the leaves of a second tree, whose bitmaps have a bit for each token and so are exact; it yields a
spanning forest of the family's links.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import connected_components, drop_table, materialize, release_shuffles, table
from .pretokens import distinct, text_runs

WORDS, NUMERATOR, DENOMINATOR, BLOCK, FAMILY, LEAF, FANOUT = 5, 4, 5, 2048, 256, 16, 8
#: Bits of an exact bitmap of the sets in a block.
MOST_BITS = 1 << 17
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def word_digests(data: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """64 bits of a cryptographic digest of each word data[begin:end]; equal words are told apart by their bytes first."""
    some, index = distinct(data, begin, end)
    raw, a, b = data.tobytes(), begin[some].tolist(), end[some].tolist()
    found = b"".join([hashlib.blake2b(raw[i:j], digest_size=8).digest() for i, j in zip(a, b, strict=True)])
    return np.frombuffer(found, np.uint64)[index]


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(hashes of all texts' distinct shingles, sorted within each text, where each text's end): a text of fewer words is one shingle."""
    data = _LOWER[np.frombuffer(b" ".join([*texts, b""]), np.uint8)]
    blank = _BLANK[data]
    edge = np.flatnonzero(np.diff(blank.astype(np.int8), prepend=1, append=1))
    begin, end = edge[::2], edge[1::2]
    w = word_digests(data, begin, end)
    stops = np.cumsum([len(t) + 1 for t in texts])
    owner = np.searchsorted(stops, begin, side="right")
    per = np.bincount(owner, minlength=len(texts))
    pad = np.concatenate([w, np.zeros(WORDS - 1, np.uint64)])
    first = np.cumsum(per) - per
    left = (first + per)[owner] - np.arange(len(w))  # words from here to the text's end
    h = np.zeros(len(w), np.uint64)
    for j in range(WORDS):
        h += np.where(left > j, pad[j : j + len(w)] * _ODD[j], np.uint64(0))
    short = per[owner] < WORDS
    h += np.where(short, per[owner].astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D), np.uint64(0))
    keep = (left >= WORDS) | (short & (np.arange(len(w)) == first[owner]))
    h, owner = _mix(h[keep]).view(np.int64), owner[keep]
    order = np.lexsort((h, owner))
    h, owner = h[order], owner[order]
    new = np.ones(len(h), bool)
    new[1:] = (h[1:] != h[:-1]) | (owner[1:] != owner[:-1])
    h, owner = h[new], owner[new]
    return h, np.cumsum(np.bincount(owner, minlength=len(texts)))


def prefix_size(n: int) -> int:
    """A set of n and one like enough to it share one of this many least hashes."""
    return n - (NUMERATOR * n + DENOMINATOR - 1) // DENOMINATOR + 1 if n else 0


def bitmap(h: np.ndarray) -> bytes:
    """Bits of a set: a power of two of them, between once and twice its size, 64 at least."""
    bits = np.zeros(max(64, 1 << max(0, len(h) - 1).bit_length()), np.uint8)
    bits[h & (len(bits) - 1)] = 1
    return np.packbits(bits, bitorder="little").tobytes()


def set_digests(h: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """128 bits that tell each set: two sums of mixed shingle hashes."""
    starts = np.concatenate([[0], ends[:-1]])
    sums = [np.concatenate([np.zeros(1, np.uint64), np.cumsum(_mix(h.view(np.uint64) + k))]) for k in (_ODD[0], _ODD[1])]
    return tuple((s[ends] - s[starts]).view(np.int64) for s in sums)


def sketches(docs: DataFrame) -> DataFrame:
    """(doc_id, n, h1, h2, prefix, bits) of each document: size and hash of its set, prefix tokens, bitmap."""

    def run(batches):
        for batch in batches:
            for first, texts in text_runs(batch.column(1)):
                h, ends = shingle_sets(texts)
                h1, h2 = set_digests(h, ends)
                starts = np.concatenate([[0], ends[:-1]])
                n = ends - starts
                p = np.array([prefix_size(k) for k in n.tolist()], np.int64)
                at = np.repeat(starts - (np.cumsum(p) - p), p) + np.arange(p.sum())
                prefix = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(p)]), pa.int32()), pa.array(h[at]))
                bits = [bitmap(h[a:b]) for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(texts)), pa.array(n, pa.int32()), pa.array(h1), pa.array(h2), prefix, pa.array(bits, pa.binary())], names=["doc_id", "n", "h1", "h2", "prefix", "bits"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n int, h1 long, h2 long, prefix array<long>, bits binary")


def fold(bits: np.ndarray, width: int) -> np.ndarray:
    """A bitmap of fewer bits: a hash's low bits stay its place."""
    while len(bits) > width:
        half = len(bits) // 2
        bits = bits[:half] | bits[half:]
    return bits


def reaches(common, size_a, size_b):
    """Whether so many common shingles make sets of these sizes alike enough."""
    return (NUMERATOR + DENOMINATOR) * common >= NUMERATOR * (size_a + size_b)


def walk(size: np.ndarray, bits: np.ndarray, excess: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(i, j, greatest possible overlap) of the pairs that may be alike enough, by a dual walk of a signature tree.

    Rows come by size. excess: by how much a row's bits are fewer than its tokens; without any, overlaps are exact.
    """
    tree, step = [(bits, size, size, excess)], LEAF  # of each level: bits, least and greatest size, greatest excess
    while len(tree[-1][0]) > LEAF:
        x, lo, hi, ex = tree[-1]
        cut = np.arange(0, len(x), step)
        tree.append((np.bitwise_or.reduceat(x, cut), np.minimum.reduceat(lo, cut), np.maximum.reduceat(hi, cut), np.maximum.reduceat(ex, cut)))
        step = FANOUT
    i, j = np.triu_indices(len(tree[-1][0]), 0 if len(tree) > 1 else 1)
    most = np.zeros(0, np.int64)
    for depth in range(len(tree) - 1, -1, -1):
        x, lo, hi, ex = tree[depth]
        fits = (DENOMINATOR * hi[i] >= NUMERATOR * lo[j]) & (DENOMINATOR * hi[j] >= NUMERATOR * lo[i])
        i, j = i[fits], j[fits]
        most, run = np.minimum(ex[i], ex[j]), max(1, (1 << 20) // max(1, x.shape[1]))
        for at in range(0, len(i), run):
            most[at : at + run] += np.bitwise_count(x[i[at : at + run]] & x[j[at : at + run]]).sum(1, dtype=np.int64)
        keep = reaches(most, lo[i], lo[j])
        i, j, most = i[keep], j[keep], most[keep]
        if depth:
            fan, below, k = LEAF if depth == 1 else FANOUT, len(tree[depth - 1][0]), np.arange(LEAF if depth == 1 else FANOUT)
            a = np.broadcast_to((i[:, None] * fan + k)[:, :, None], (len(i), fan, fan)).ravel()
            c = np.broadcast_to((j[:, None] * fan + k)[:, None, :], (len(i), fan, fan)).ravel()
            ok = (a < below) & (c < below) & ((a < c) if depth == 1 else (a <= c))
            i, j = a[ok], c[ok]
    return i, j, most


def candidates(size: np.ndarray, bits: list[bytes]) -> list[tuple[int, int, int]]:
    """(i, j, greatest possible overlap) of the pairs in a bucket that may be alike enough.

    Sets that link differ by less than a factor of two in size, so bitmaps are compared at the width of the smaller.
    """
    width = np.array([len(b) for b in bits])
    out = []
    for level in np.unique(width):
        rows = np.flatnonzero((width == level) | (width == 2 * level))
        if len(rows) < 2 or not (width[rows] == level).any():
            continue
        rows = rows[np.argsort(size[rows], kind="stable")]
        b = np.ascontiguousarray(np.stack([fold(np.frombuffer(bits[r], np.uint8), level) for r in rows])).view(np.uint64)
        s, wide = size[rows].astype(np.int64), width[rows] > level
        i, j, most = walk(s, b, s - np.bitwise_count(b).sum(1, dtype=np.int64))
        new = ~(wide[i] & wide[j])  # two wide ones meet at their own width
        out += zip(rows[i[new]].tolist(), rows[j[new]].tolist(), most[new].tolist(), strict=True)
    return out


def links(sets: list[np.ndarray], most_bits: int = MOST_BITS) -> list[tuple[int, int, int]]:
    """(i, j, overlap) of the sets that are alike enough, exactly: a bit for each token that two of them have.

    If that takes more than most_bits, several tokens share a bit; the pairs that are left are then counted one by one.
    """
    size = np.array([len(x) for x in sets], np.int64)
    order = np.argsort(size, kind="stable")
    every = np.concatenate([sets[r] for r in order])
    _, token, times = np.unique(every, return_inverse=True, return_counts=True)
    place = np.cumsum(times > 1) - 1
    shared = times[token] > 1
    needed = int((times > 1).sum())
    wide = -(-max(1, min(most_bits, needed)) // 64) * 64
    owner = np.repeat(np.arange(len(sets)), size[order])[shared]
    bit = place[token[shared]] % wide
    bits = np.zeros((len(sets), wide // 64), np.uint64)
    np.bitwise_or.at(bits, (owner, bit >> 6), np.uint64(1) << (bit & 63).astype(np.uint64))
    if needed <= wide:
        i, j, overlap = walk(size[order], bits, np.zeros(len(sets), np.int64))
        return list(zip(order[i].tolist(), order[j].tolist(), overlap.tolist(), strict=True))
    held = np.bincount(owner, minlength=len(sets)) - np.bitwise_count(bits).sum(1, dtype=np.int64)
    out = []
    for i, j in zip(*(order[x].tolist() for x in walk(size[order], bits, held)[:2]), strict=True):
        overlap = len(np.intersect1d(sets[i], sets[j], assume_unique=True))
        if reaches(overlap, len(sets[i]), len(sets[j])):
            out.append((i, j, overlap))
    return out


def forest(pairs: list[tuple[int, int, int]], n: int) -> list[tuple[int, int]]:
    """A spanning forest of the pairs, those of greatest possible overlap first."""
    root, out = list(range(n)), []

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    for i, j, _ in sorted(pairs, key=lambda p: -p[2]):
        a, b = find(i), find(j)
        if a != b:
            root[a] = b
            out.append((i, j))
    return out


def forests(rows: DataFrame, key: str, value: str, of_group) -> DataFrame:
    """(a, b): of_group's forest of each group (key, i, j) of rows (key, i, j, rep, value ...).

    of_group gets a table with distinct rep and their places; groups stream through the task one after the other.
    """
    columns = [key, "i", "j", "rep", *value.split()]

    def flush(t: pa.Table, cut):
        out = set()
        for a, b in zip([0, *cut], [*cut, t.num_rows], strict=True):
            if b - a > 1:
                ids, first = np.unique(t.column("rep").to_numpy()[a:b], return_index=True)
                if len(ids) > 1:
                    own = t.slice(a, b - a).take(pa.array(first))
                    out.update((int(ids[i]), int(ids[j])) for i, j in forest(of_group(own), len(ids)))
        if out:
            x, y = zip(*out, strict=True)
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()), pa.array(y, pa.int64())], names=["a", "b"])

    def run(batches):
        held = None
        for batch in batches:
            t = pa.Table.from_batches([batch])
            t = t if held is None else pa.concat_tables([held, t]).combine_chunks()
            keys = np.stack([t.column(k).to_numpy() for k in (key, "i", "j")])
            cut = (np.flatnonzero((keys[:, 1:] != keys[:, :-1]).any(0)) + 1).tolist()
            if cut:
                yield from flush(t.slice(0, cut[-1]), cut[:-1])
            held = t.slice(cut[-1]) if cut else t
        if held is not None and held.num_rows:
            yield from flush(held, [])

    keyed = rows.repartition(key, "i", "j").sortWithinPartitions(key, "i", "j")
    return keyed.select(*columns).mapInArrow(run, "a long, b long").distinct()


def in_blocks(members: DataFrame, key: str, count: str, block: int) -> DataFrame:
    """(key, i, j, rep): a large group is cut into blocks, and each pair of blocks becomes a group."""
    cut = members.withColumn("blocks", F.ceil(F.col(count) / block).cast("long")).withColumn("own", F.pmod(F.xxhash64("rep"), F.col("blocks")))
    pairs = F.transform(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1), lambda x: F.struct(F.least(x, F.col("own")).alias("i"), F.greatest(x, F.col("own")).alias("j")))
    return cut.select(key, "rep", F.explode(pairs).alias("p")).select(key, "p.i", "p.j", "rep")


def in_bands(met: DataFrame, block: int) -> DataFrame:
    """(token, rep, n, members) of buckets; those of more than block members are cut by size first.

    Sets that link differ in size by a factor of 1.25 at most, so they lie in the same or in neighbouring bands of that
    width. A row of a large bucket goes to its own band and to the one above, under a token of its own; a pair meets in
    the band of the larger. So a frequent passage, which texts of all sizes share, costs two rows a text.
    """
    band = F.floor(F.log(F.col("n").cast("double")) / F.log(F.lit(DENOMINATOR / NUMERATOR)) + 1e-9)
    large = met.filter(F.col("members") > block).withColumn("band", F.explode(F.array(band, band + 1)))
    large = large.select(F.xxhash64("token", "band").alias("token"), "rep", "n")
    sizes = large.groupBy("token").agg(F.count("*").alias("members")).filter("members > 1")
    return met.filter(F.col("members") <= block).select("token", "rep", "n", "members").union(large.join(sizes, "token").select("token", "rep", "n", "members"))


def whole_sets(docs: DataFrame, classes: DataFrame) -> DataFrame:
    """(rep, h): the sorted hashes of classes (rep, doc, n, h1, h2), from a document of that doc_id and that set."""

    def run(batches):
        for batch in batches:
            for first, texts in text_runs(batch.column(1)):
                h, ends = shingle_sets(texts)
                rep, h1, h2 = (batch.column(k).slice(first, len(texts)).to_numpy() for k in (0, 2, 3))
                own = set_digests(h, ends)
                right = np.flatnonzero((own[0] == h1) & (own[1] == h2))
                sets = [h[a:b].tobytes() for a, b in zip(np.concatenate([[0], ends[:-1]])[right].tolist(), ends[right].tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rep[right]), pa.array(sets, pa.binary())], names=["rep", "h"])

    named = docs.select(F.col("doc_id").cast("long").alias("doc"), "text").join(classes.select("doc", "rep", "h1", "h2"), "doc")
    return named.select("rep", "text", "h1", "h2").mapInArrow(run, "rep long, h binary").dropDuplicates(["rep"])


def near_copies(docs: DataFrame, block: int = BLOCK, family_block: int = FAMILY) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row.

    Two documents link at a similarity of 0.8 or more; component_id is the smallest doc_id reachable. Null, empty and
    blank texts have no shingles and link with nothing; rows with a null doc_id have a null component and link with
    nothing. Repeated rows are copies of each other; of rows that share a doc_id each is judged by its own text. Other
    columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    sketch = materialize(sketches(docs), "sketches")
    usable = sketch.filter("n > 0 and doc_id is not null")
    grouped = usable.groupBy("h1", "h2", "n").agg(F.min("doc_id").alias("doc"), F.first("prefix").alias("prefix"), F.first("bits").alias("bits"))
    classes = materialize(grouped.withColumn("rep", F.monotonically_increasing_id()), "classes")  # a number holds once it is written
    release_shuffles(spark)
    tokens = classes.select("rep", "n", F.explode("prefix").alias("token"))
    buckets = tokens.groupBy("token").agg(F.count("*").alias("members"), F.bit_xor(F.xxhash64("rep")).alias("x1"), F.bit_xor(F.xxhash64("rep", F.lit(1))).alias("x2")).filter("members > 1")
    buckets = buckets.groupBy("members", "x1", "x2").agg(F.min("token").alias("token"))  # of buckets with the same members one stays
    met = materialize(in_bands(tokens.join(buckets.select("token", "members"), "token"), block), "buckets")
    release_shuffles(spark)
    near = in_blocks(met.select("token", "rep", "members"), "token", "members", block).join(classes.select("rep", "n", "bits"), "rep")
    of_bucket = lambda t: candidates(t.column("n").to_numpy(), t.column("bits").to_pylist())
    first = materialize(forests(near, "token", "n bits", of_bucket), "pairs")
    release_shuffles(spark)
    family = materialize(connected_components(spark, first).withColumnsRenamed({"node": "rep", "component": "family"}), "families")
    sets = materialize(whole_sets(docs, classes.join(family.select("rep"), "rep", "left_semi")), "sets")
    release_shuffles(spark)
    sized = family.join(family.groupBy("family").agg(F.count("*").alias("members")), "family")
    whole = in_blocks(sized, "family", "members", family_block).join(sets, "rep")
    of_family = lambda t: links([np.frombuffer(h, np.int64) for h in t.column("h").to_pylist()])
    linked = materialize(forests(whole, "family", "h", of_family), "links")
    release_shuffles(spark)
    member = connected_components(spark, linked).withColumnRenamed("node", "rep").join(classes.select("rep", "doc"), "rep")
    component = materialize(member.select("rep", "component", "doc"), "components")
    for t in (met, first, family, sets, linked):
        drop_table(t)
    release_shuffles(spark)
    least = component.groupBy("component").agg(F.min("doc").alias("c"))
    of_class = classes.join(component.select("rep", "component").join(least, "component"), "rep", "left").select("h1", "h2", "n", F.coalesce("c", "doc").alias("c"))
    out = sketch.select("doc_id", "n", "h1", "h2").join(of_class, ["h1", "h2", "n"], "left")
    return out.select("doc_id", F.col("n").cast("long").alias("n_shingles"), F.when(F.col("doc_id").isNotNull(), F.coalesce("c", "doc_id")).alias("component_id"))


def op8_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_copies(table(spark, sf_dir, "documents"))


def near_copy_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near copies, that of the smallest doc_id; rows without doc_id stay.

    Of rows that share a doc_id all go if any of them does, else all stay.
    """
    gone = near_copies(docs).filter("doc_id <> component_id").select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)


SQL = {
    "op8_ngram_join": r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS g FROM w),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
o AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM o JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 80 * (p.n + q.n - c)),
reach AS (SELECT a, b FROM links UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a),
low AS (SELECT a, min(b) AS b FROM reach GROUP BY a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, least(d.doc_id, coalesce(low.b, d.doc_id)) AS component_id
FROM documents d LEFT JOIN n ON n.doc_id = d.doc_id LEFT JOIN low ON low.a = d.doc_id
"""
}
