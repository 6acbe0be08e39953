"""Parts that need no Spark."""

import io
import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

from passagework.llm import bpe, capfilters, ngramjoin, pretokens, quality, suffixdedup, topk, warc

SOME = ["'", "'s", "'re", "'ll", " ", "  ", "\n", "\t", "a", "re", "ll", "1", "23", "é", "中", "!", "%%", "\x1c", "😀", "A", "''", " '", "\r\n"]


def texts(n, seed=1):
    rng = random.Random(seed)
    out = ["".join(rng.choice(SOME) for _ in range(rng.randint(0, 40))) for _ in range(n)]
    out += ["".join(chr(rng.choice([rng.randint(1, 0xD7FF), rng.randint(32, 126)])) for _ in range(rng.randint(0, 30))) for _ in range(n // 4)]
    return [*out, "", " ", "\n \n", "abc" * 5000, "a" * 3000, "'"]


def test_bpe_equals_tiktoken_and_decodes():
    tiktoken = pytest.importorskip("tiktoken")
    import public_tokenizers

    path = bpe.vocabulary_path()
    own = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=bpe.load_ranks(path), special_tokens={})
    all_texts = texts(2000)
    for first, entries, index, per in bpe.encoded(pa.array(all_texts), path):
        at = 0
        for r, n in enumerate(per.tolist(), first):
            mine = [entries[k] for k in index[at : at + n]]
            at += n
            assert [i for e in mine for i in e[0]] == own.encode_ordinary(all_texts[r])
            assert b"".join(e[2] for e in mine) == all_texts[r].encode()


def test_long_piece_equals_short_way(monkeypatch):
    ranks = bpe.load_ranks(bpe.vocabulary_path())
    pieces = [bytes(random.Random(i).choice(b"abcetion ") for _ in range(40)) for i in range(50)]
    pairs = bpe.PairTable(ranks)
    assert bpe.merge_all(pieces, ranks, pairs) == [ranks.get(p) and [ranks[p]] or bpe._merge_long(p, ranks) for p in pieces]


def test_token_ids_equal_the_library():
    Tokenizer = pytest.importorskip("tokenizers").Tokenizer
    from passagework.llm import tokenfile

    path = bpe.vocabulary_path("byte_bpe_50k.json")
    all_texts = texts(300, 3)
    got = {}
    for first, ids, counts in tokenfile.token_ids(pa.array(all_texts), path, np.uint16):
        for r, part in enumerate(np.split(ids, np.cumsum(counts)[:-1]), first):
            got[r] = part.tolist()
    want = Tokenizer.from_file(path).encode_batch(all_texts, add_special_tokens=False)
    assert [got[i] for i in range(len(all_texts))] == [e.ids for e in want]


def test_words_that_come_again_are_encoded_once(monkeypatch):
    pytest.importorskip("tokenizers")
    from passagework.llm import tokenfile

    fresh, path, asked = {}, bpe.vocabulary_path("byte_bpe_50k.json"), []
    monkeypatch.setattr(tokenfile, "worker_cache", lambda: fresh)
    real, known, marks = tokenfile.encoder(path)

    class Counting:
        def encode_batch_fast(self, some, **how):
            asked.extend(some)
            return real.encode_batch_fast(some, **how)

    fresh["tokenizer", path] = Counting(), known, marks
    letters = "abcdefghijklmnopqrstuvwxyz"
    words = [a + b + c + d for a in letters for b in letters for c in letters for d in letters[:23]]
    column = pa.array(["", None, *(" " + " ".join(words[i : i + 500]) for i in range(0, len(words), 500)), ""])
    runs = [[(first, ids.tobytes(), counts.tolist()) for first, ids, counts in tokenfile.token_ids(column, path, np.uint16)] for _ in range(2)]
    assert runs[0] == runs[1] and len(asked) == len(set(asked)) == len(words)
    assert [len(ids) for _, ids, _ in tokenfile.token_ids(pa.array(["", None]), path, np.uint16)] == [0]


def test_warc_ranges_own_each_record_once():
    rng = random.Random(1)
    payloads = [bytes(rng.choice([0x1F, 0x8B, 8, 65]) for _ in range(rng.choice([0, 10, 5000]))) for _ in range(100)]
    records = [warc.record(i if i else None, f"http://x/{i}\n%", p, None if i % 3 else 5) for i, p in enumerate(payloads)]
    data = b""
    for r in records:
        c = zlib.compressobj(1, zlib.DEFLATED, 31)
        data += c.compress(r) + c.flush()
    for step in (97, 1000, len(data) + 1):
        got = [x for b in range(0, len(data), step) for x in warc.records_in(io.BytesIO(data), len(data), b, b + step, 700)]
        assert got == records
    row = warc.parse(records[4])
    assert (row["page_id"], row["url"], row["payload"], row["record_type"]) == (4, "http://x/4\n%", payloads[4], "response")


def test_difference_cover():
    for period in (7, 13, 57):
        d = suffixdedup.cover(period)
        assert {int(a - b) % period for a in d for b in d} == set(range(period))


def test_cover_tree_search_equals_brute_force():
    rng = np.random.default_rng(0)
    base = rng.integers(-50, 50, (40, 8))
    data = np.concatenate([base, np.repeat(base[:3], 200, 0) + rng.integers(-1, 2, (600, 8)), np.repeat(base[:1], 100, 0)]).astype(float)
    ids = rng.permutation(len(data)).astype(np.int64)
    q = ids % 5 == 0
    row, found, score = topk.search(data[q], ids[q], data, ids, 5)
    s = data[q] @ data.T
    s[ids[q][:, None] == ids[None, :]] = -np.inf
    for i in range(q.sum()):
        assert ids[np.lexsort((ids, -s[i]))[:5]].tolist() == found[row == i].tolist()


@pytest.mark.parametrize("n", [1_000, 1_000_000, 1_000_000_000])
def test_cap_filters_recall(n):
    """Of pairs at cosine 0.9 exactly, with the codes that so many vectors get."""
    rng = np.random.default_rng(1)
    x = capfilters.unit(rng.standard_normal((200, 64)))
    y = rng.standard_normal((200, 64))
    y = capfilters.unit(y - (y * x).sum(1, keepdims=True) * x)
    near = 0.9 * x + np.sqrt(0.19) * y
    words, n_codes = capfilters.words_for(n), capfilters.codes_for(n)
    a, b = (set(zip(*(c.tolist() for c in capfilters.filters_of(v, words, n_codes)), strict=True)) for v in (x, near))
    met = {row for row, _ in a & b}
    assert len(met) >= 0.95 * 200


def test_filters_are_all_above_the_threshold():
    rng = np.random.default_rng(2)
    u = capfilters.unit(rng.standard_normal((50, 8)))
    row, number = capfilters.filters_of(u, 4, 1, 5)
    (turn, parts), height, full = capfilters.codes(8, 4, n=1)[0], capfilters.height_for(8, 4), np.zeros((50, 1))
    for where, w in parts:
        full = (full[:, :, None] + ((u @ turn)[:, where] @ w)[:, None, :]).reshape(50, -1)
    for i in range(50):
        least = min(height, np.sort(full[i])[-5])
        assert set(number[row == i].tolist()) == set(np.flatnonzero(full[i] >= least - 1e-12).tolist())


def test_ordinal_regression_learns_and_survives_one_grade():
    rng = random.Random(2)
    plain = ["oak", "elm", "ash", "fir", "yew"]
    make = lambda g: " ".join(rng.choice(plain) + ("" if g == 2 else "%%%" if g == 1 else " scum") for _ in range(20))
    grades = [rng.randrange(3) for _ in range(600)]
    row, number, value = quality.features([make(g).encode() for g in grades])
    rows = [(g, number[row == i], value[row == i]) for i, g in enumerate(grades)]
    model = quality.fit(rows[:400])
    right = [int(model.tails(np.array([(v * model.weights[n]).sum()]))[0, -1] >= 0.5) == (g == 2) for g, n, v in rows[400:]]
    assert np.mean(right) > 0.95 and model.cuts[0] <= model.cuts[1]
    assert quality.fit([]).tails(np.zeros(1))[0, -1] > 0.99


def test_starts_of_empty():
    assert len(pretokens.starts_of(np.zeros(0, np.uint32), np.zeros(0, bool))) == 0


def test_distinct_slices_by_content():
    values = np.frombuffer(b"abcabdabcxab", np.uint8)
    begin, end = np.array([0, 3, 6, 9, 10]), np.array([3, 6, 9, 10, 12])
    for hashes in (pretokens.slice_hashes, lambda v, a, b: np.zeros(len(a), np.uint64)):
        some, index = pretokens.distinct(values, begin, end, hashes)
        assert [values[begin[some[k]] : end[some[k]]].tobytes() for k in index] == [b"abc", b"abd", b"abc", b"x", b"ab"]
        assert len(some) >= 4
    begin, end = np.array([0, 4, 6]), np.array([2, 5, 8])
    some, index = pretokens.distinct(values, begin, end, lambda v, a, b: np.zeros(len(a), np.uint64))
    assert [values[begin[some[k]] : end[some[k]]].tobytes() for k in index] == [b"ab", b"b", b"ab"]


def test_links_with_shared_bits_equal_exact_ones():
    rng = np.random.default_rng(4)
    base = [rng.choice(1 << 40, 400, replace=False) for _ in range(6)]
    sets = [np.unique(np.concatenate([b[: 400 - k], rng.integers(0, 1 << 40, k)])) for b in base for k in (0, 10, 30, 60, 200)]
    key = lambda x: sorted((min(i, j), max(i, j), n) for i, j, n in x)
    assert key(ngramjoin.links(sets)) == key(ngramjoin.links(sets, 128))


def test_a_cache_is_bounded_by_size():
    cache = pretokens.TwoGenerations(100_000)
    for i in range(5000):
        cache.put(b"%d" % i, i, 90)
    assert len(cache) + len(cache.old) <= 2 * 100_000 // 90 and cache[b"4999"] == 4999
