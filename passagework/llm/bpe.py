"""Operator 2: byte-level BPE encoding and decoding."""

from __future__ import annotations

import base64
import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, worker_cache
from .pretokens import TwoGenerations, pieces, text_runs

SHORT = 64


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks of a file of base64 tokens and numbers."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class PairTable:
    """The token that two adjacent tokens merge into, looked up for many pairs at once."""

    def __init__(self, ranks: dict[bytes, int]):
        found = {}
        for token, rank in ranks.items():
            for cut in range(1, len(token)):
                a, b = ranks.get(token[:cut]), ranks.get(token[cut:])
                if a is not None and b is not None:
                    found[a << 32 | b] = rank
        keys = np.array(sorted(found), np.int64)
        self.bits = max(10, (2 * len(keys)).bit_length())
        self.key = np.full(1 << self.bits, -1, np.int64)
        self.rank = np.zeros(1 << self.bits, np.int32)
        left, ranked = keys, np.array([found[k] for k in keys.tolist()], np.int32)
        self.probes = 0
        while len(left):  # open addressing: whoever finds a free slot takes it, the rest tries the next
            slot = self._slot(left, self.probes)
            free = self.key[slot] < 0
            self.key[slot[free]], self.rank[slot[free]] = left[free], ranked[free]
            rest = self.key[slot] != left
            left, ranked, self.probes = left[rest], ranked[rest], self.probes + 1
        self.of_byte = np.array([ranks[bytes([i])] for i in range(256)], np.int64)

    def _slot(self, keys: np.ndarray, probe: int) -> np.ndarray:
        h = keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits)
        return ((h + np.uint64(probe)) & np.uint64((1 << self.bits) - 1)).astype(np.int64)

    def look(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Rank of each merged pair; NONE where there is none."""
        keys, out = a << 32 | b, np.full(len(a), NONE, np.int64)
        todo = np.arange(len(a))
        for probe in range(self.probes):
            slot = self._slot(keys[todo], probe)
            held = self.key[slot]
            hit = held == keys[todo]
            out[todo[hit]] = self.rank[slot[hit]]
            todo = todo[~hit & (held >= 0)]
            if not len(todo):
                break
        return out


NONE = 1 << 40


def merge_all(pieces_: list[bytes], ranks: dict[bytes, int], pairs: PairTable) -> list[list[int]]:
    """Token ids of each piece: the adjacent pair of lowest rank is merged first, the leftmost of equals.

    Short pieces merge together, one pair each a round; long ones one by one.
    """
    out: list = [None] * len(pieces_)
    short = []
    for i, p in enumerate(pieces_):
        whole = ranks.get(p)
        if whole is not None:
            out[i] = [whole]
        elif len(p) > SHORT:
            out[i] = _merge_long(p, ranks)
        else:
            short.append(i)
    if not short:
        return out
    sizes = np.array([len(pieces_[i]) for i in short], np.int64)
    ids = pairs.of_byte[np.frombuffer(b"".join([pieces_[i] for i in short]), np.uint8)]
    owner = np.repeat(np.arange(len(short)), sizes)
    done_ids, done_owner = [], []
    rank = np.full(len(ids), NONE, np.int64)  # of each token with the next of its piece
    same = np.flatnonzero(owner[1:] == owner[:-1])
    rank[same] = pairs.look(ids[same], ids[same + 1])
    while len(ids):
        begin = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
        least = np.minimum.reduceat(rank, begin)
        size = np.diff(np.append(begin, len(ids)))
        over = least == NONE
        if over.any():  # these pieces are final
            stay = ~np.repeat(over, size)
            done_ids.append(ids[~stay])
            done_owner.append(owner[~stay])
            ids, owner, rank = ids[stay], owner[stay], rank[stay]
            least, size = least[~over], size[~over]
            if not len(ids):
                break
            begin = np.cumsum(size) - size
        hits = np.flatnonzero(rank == np.repeat(least, size))
        at = hits[np.append(True, owner[hits[1:]] != owner[hits[:-1]])]
        ids[at] = rank[at]
        stay = np.ones(len(ids), bool)
        stay[at + 1] = False
        place = np.cumsum(stay) - 1
        ids, owner, rank, at = ids[stay], owner[stay], rank[stay], place[at]
        for spot in (at, at[at > 0] - 1):
            rank[spot] = NONE
            spot = spot[(spot + 1 < len(ids))]
            spot = spot[owner[spot] == owner[spot + 1]]
            rank[spot] = pairs.look(ids[spot], ids[spot + 1])
    ids, owner = np.concatenate(done_ids), np.concatenate(done_owner)
    flat = ids[np.argsort(owner, kind="stable")].tolist()
    at = 0
    for i, n in zip(short, np.bincount(owner, minlength=len(short)).tolist(), strict=True):
        out[i] = flat[at : at + n]
        at += n
    return out


def _merge_long(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The same by a heap over a linked list, for long pieces."""
    n = len(piece)
    end, after, before = list(range(1, n + 1)), [*range(1, n), -1], [-1, *range(n - 1)]
    alive = [True] * n
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, stop = heapq.heappop(heap)
        j = after[i] if alive[i] else -1
        if j < 0 or end[j] != stop:
            continue
        alive[j], end[i], after[i] = False, end[j], after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) >= 0 and (r := ranks.get(piece[a : end[b]])) is not None:
                heapq.heappush(heap, (r, a, end[b]))
    return [ranks[piece[i : end[i]]] for i in range(n) if alive[i]]


def encoded(column: pa.Array, path: str) -> Iterator[tuple[int, list, np.ndarray, np.ndarray]]:
    """For runs of texts: (number of the first, entry of each distinct piece, entry's number of each piece, number of pieces per text).

    An entry is (ids, decimal ids joined by commas, the bytes that the ids stand for).
    """
    cache = worker_cache()
    if ("ranks", path) not in cache:
        ranks = load_ranks(path)
        cache["ranks", path] = ranks, {i: t for t, i in ranks.items()}, TwoGenerations(), PairTable(ranks)
    ranks, tokens, known, pairs = cache["ranks", path]
    for at, texts in text_runs(column):
        distinct, index, per_text = pieces(texts)
        entries = [known[p] for p in distinct]
        new = [i for i, e in enumerate(entries) if e is None]
        for i, ids in zip(new, merge_all([distinct[i] for i in new], ranks, pairs), strict=True):
            back = b"".join([tokens[t] for t in ids])
            entry = ids, ",".join(map(str, ids)).encode(), distinct[i] if back == distinct[i] else back
            entries[i] = known.put(distinct[i], entry, 400 + 45 * len(ids) + len(back))
        yield at, entries, index, per_text


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and ids array<int>, token_bytes array<int>: each token's length in bytes.

    token_bytes gives the tokens' offsets in the text, in order. Null and empty texts have no tokens; texts of any
    length are encoded whole; rows are independent, so repeated rows give repeated results. Other columns are ignored.
    Kept columns must not be called ids or token_bytes.
    """

    def run(batches):
        for batch in batches:
            for first, entries, index, per_text in encoded(batch.column(len(keep)), path):
                tokens = worker_cache()["ranks", path][1]
                at, ids_out, lens_out = 0, [], []
                for n in per_text.tolist():
                    ids = [i for k in index[at : at + n].tolist() for i in entries[k][0]]
                    ids_out.append(ids)
                    lens_out.append([len(tokens[i]) for i in ids])
                    at += n
                own = [c.slice(first, len(per_text)) for c in batch.columns[: len(keep)]]
                yield pa.RecordBatch.from_arrays([*own, pa.array(ids_out, pa.list_(pa.int32())), pa.array(lens_out, pa.list_(pa.int32()))], names=[*keep, "ids", "token_bytes"])

    kinds = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep)
    return docs.select(*keep, "text").mapInArrow(run, f"{kinds}, ids array<int>, token_bytes array<int>")


def decode(tokens: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns named in keep, and text_bytes: what ids stand for. Null ids count as none."""

    def run(batches):
        cache = worker_cache()
        if ("tokens", path) not in cache:
            cache["tokens", path] = {i: t for t, i in load_ranks(path).items()}
        vocabulary = cache["tokens", path]
        for batch in batches:
            out = [b"".join([vocabulary[i] for i in ids or []]) for ids in batch.column(len(keep)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(keep)], pa.array(out, pa.binary())], names=[*keep, "text_bytes"])

    kinds = ", ".join(f"`{c}` {tokens.schema[c].dataType.simpleString()}" for c in keep)
    return tokens.select(*keep, "ids").mapInArrow(run, f"{kinds}, text_bytes binary")


def digests(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256): encodes each whole text, decodes its ids, and returns digests of both.

    Null and empty texts have no tokens and the digests of nothing. Rows are independent: repeated rows give repeated
    results, and a null doc_id stays null. Other columns are ignored; an empty table gives an empty result.
    """

    def run(batches):
        for batch in batches:
            for first, entries, index, per_text in encoded(batch.column(1), path):
                counts = np.array([len(e[0]) for e in entries], np.int64)
                sums = np.concatenate([[0], np.cumsum(counts[index])]) if len(entries) else np.zeros(1, np.int64)
                ends = np.cumsum(per_text)
                decimal, back = [e[1] for e in entries], [e[2] for e in entries]
                at, ids_out, text_out = 0, [], []
                for stop in ends.tolist():
                    own = index[at:stop].tolist()
                    ids_out.append(hashlib.sha256(b",".join([decimal[k] for k in own])).hexdigest())
                    text_out.append(hashlib.sha256(b"".join([back[k] for k in own])).hexdigest())
                    at = stop
                n_out = pa.array(sums[ends] - sums[ends - per_text], pa.int64())
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, len(per_text)), n_out, pa.array(ids_out, pa.string()), pa.array(text_out, pa.string())], names=["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def vocabulary_path(name: str = "byte_bpe_multi_50k.tiktoken") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def op2_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(table(spark, sf_dir, "documents"), vocabulary_path())


def bpe_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Digest and number of tokens of each document that is left."""
    return digests(docs, vocabulary_path())
