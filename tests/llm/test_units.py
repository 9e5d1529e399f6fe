"""The parts of the operators that run without Spark, against the libraries or brute force."""

import base64
import random

import numpy as np
import public_tokenizers as P
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from millrace.llm import ann, language_id, near_dup, passages, shingles, url_filter, wavelet
from millrace.llm.bpe import ByteBPE
from millrace.llm.token_counts import OverlapCounter

ALPHABET = ["a", "b", "the", " ", "  ", "\n", "\t", "é", "中", "𠮷", "🎉", "ing", "<s>", "<|endoftext|>", "▁", "0", "'s", "\x1c", "\x85", "　", "!!", "X"]


def texts(n, lengths=(0, 1, 3, 30, 300), seed=1):
    rnd = random.Random(seed)
    for _ in range(n):
        own = rnd.sample(ALPHABET, rnd.randint(1, len(ALPHABET)))
        yield "".join(rnd.choice(own) for _ in range(rnd.choice(lengths)))


@pytest.fixture(scope="module")
def bpe():
    return ByteBPE.from_file(P.path("byte_bpe_50k.tiktoken"), P.PATTERN)


@pytest.fixture(scope="module")
def tiktoken_encoding():
    import tiktoken

    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(P.path("byte_bpe_50k.tiktoken"), "rb"))}
    return tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library(bpe, tiktoken_encoding):
    for t in texts(1500):
        assert bpe.encode(t) == tiktoken_encoding.encode_ordinary(t)
    assert bpe.encode(None) == bpe.encode("") == []


@settings(max_examples=200, deadline=None)
@given(st.text())
def test_bpe_round_trip(bpe, text):
    assert bpe.decode(bpe.encode(text)) == text.encode()


def test_bpe_very_long_pre_token(bpe, tiktoken_encoding):
    for t in ("ab" * 20_000, "a" * 30_000, "".join(random.Random(3).choices("abcdeth", k=20_000))):
        assert bpe.encode(t) == tiktoken_encoding.encode_ordinary(t)


@pytest.mark.parametrize("chunk, overlap", [(32, 8), (64, 16), (200, 50), (16384, 512)])
def test_counts_equal_the_library(chunk, overlap):
    counter = OverlapCounter(P.path("piece_bpe_32k.model"), chunk, overlap)
    for t in texts(400, (0, 3, 30, 300, 900), seed=chunk):
        assert counter.count(t) == len(counter.library.encode(t))
    assert counter.count(None) == 0
    assert counter.count("=" * 5000) == len(counter.library.encode("=" * 5000))  # no stable place at all


def test_wavelet_matrix():
    rnd = np.random.default_rng(5)
    for n, top in ((0, 1), (1, 1), (7, 2), (64, 5), (1000, 40), (5000, 49_408), (130, 1 << 20)):
        ids = rnd.integers(0, top, n).astype(np.uint32)
        ends = [n // 2, n] if n else []
        m = wavelet.WaveletMatrix.from_bytes(wavelet.WaveletMatrix.build(ids, range(len(ends)), ends).to_bytes())
        assert (m.to_array() == ids).all()
        for i in rnd.integers(0, n, min(n, 50)) if n else []:
            assert m.access(int(i)) == ids[i]
        for v in set(ids[:10].tolist()) | {top + 1}:
            at = np.flatnonzero(ids == v).tolist()
            assert m.count(v) == len(at) and m.occurrences(v) == at
            assert m.count(v, n // 3, n // 2) == sum(n // 3 <= x < n // 2 for x in at)


def test_wavelet_file(tmp_path):
    m = wavelet.WaveletMatrix.build(np.array([3, 1, 3, 0], np.uint32), [10, 11], [3, 4])
    m.save(str(tmp_path / "x"))
    again = wavelet.WaveletMatrix.load(str(tmp_path / "x"))
    assert again.document(0).tolist() == [3, 1, 3] and again.document(1).tolist() == [0] and again.doc_ids.tolist() == [10, 11]
    image = bytearray(m.to_bytes())
    image[-1] ^= 255
    with pytest.raises(Exception):
        wavelet.WaveletMatrix.from_bytes(bytes(image))


def test_word_encoder_equals_the_library():
    encoder = wavelet.WordEncoder(P.path("word_bpe_49k.json"))
    assert encoder.by_piece
    all_texts = list(texts(800)) + ["", "Σας ΣΣ", "é ́x", "I'LL don't", "<|startoftext|>x <|endoftext|> y"]
    for text, ids in zip(all_texts, encoder.encode(all_texts), strict=True):
        assert ids.tolist() == encoder.library.encode(text, add_special_tokens=False).ids
    assert not wavelet._drops_space(P.path("byte_bpe_50k.json"))


def test_url_terms():
    v = url_filter.Vocabulary(["casino"], ["free", "bets", "win"])
    assert v.hits("http://Casino-win.example/") == {"casino", "win"}
    assert v.hits("http://casinos.example/freebets/windows") == set()
    assert v.hits("http://free-bets.example/free") == {"free", "bets"}
    assert v.hits(None) == v.hits("") == set() and url_filter.Vocabulary([], []).hits("x") == set()


def test_language_model():
    model = language_id.Model([("en", "the", 10), ("en", "house", 3), ("fr", "maison", 4), ("fr", "le", 9)])
    p = language_id.Predictor(model)
    assert p.predict("The house")[0] == "en" and p.predict("le maisonnette")[0] == "fr"
    assert p.predict(None) == p.predict("12 !") == p.predict("²") == ("und", 0.0)
    assert p.predict("中")[0] == "en"  # nothing known: a tie, the smaller name
    assert all(0 <= p.predict(t)[1] <= 1 for t in ("x", "housle", "le the"))
    assert language_id.Predictor(language_id.Model([])).predict("the") == ("und", 0.0)


def test_int8_bounds():
    rnd = np.random.default_rng(2)
    x = rnd.normal(size=(200, 64)) * rnd.lognormal(size=(200, 1))
    codes, scales, norms, errors = ann.quantise(x)
    near = ann.products(codes, codes) * np.outer(scales, scales)
    bound = np.outer(norms, errors) + np.outer(errors, norms + errors)
    assert (np.abs(x @ x.T - near) <= bound * (1 + 1e-9) + 1e-12).all()
    wide = rnd.integers(-127, 128, (3, 5000)).astype(np.int8)
    assert (ann.products(wide, wide) == wide.astype(np.int64) @ wide.astype(np.int64).T).all()


@pytest.mark.parametrize("hot", [False, True])
def test_index_loses_no_similar_pair(hot):
    rnd = np.random.default_rng(7 + hot)
    for _ in range(3000):
        n = int(rnd.choice([1, 2, 3, 4, 5, 6, 7, 9, 14, 15, 30, 31, 62, 63, 126, 127, 260]))
        x = np.unique(rnd.integers(0, 2**63, n, dtype=np.uint64))
        for _ in range(20):
            a, b = int(rnd.integers(0, n // 4 + 1)), int(rnd.integers(0, n // 4 + 1))
            if 100 * (n - a) >= 80 * (n + b) and n > a:
                break
        else:
            a = b = 0
        y = np.unique(np.concatenate([x[rnd.permutation(n)[a:]], rnd.integers(0, 2**63, b, dtype=np.uint64)]))
        levels = lambda z: (z % np.uint64(3) == 0).astype(np.int16) * 9 if hot else np.zeros(len(z), np.int16)
        assert len(np.intersect1d(near_dup.index_keys(x, levels(x)), near_dup.index_keys(y, levels(y))))


def test_wide_sketches_differ_in_no_more_bits_than_sets_in_shingles():
    rnd = np.random.default_rng(11)
    assert near_dup.wide_sketch(np.arange(512, dtype=np.uint64)) is None and len(near_dup.wide_sketch(np.arange(513, dtype=np.uint64))) == 128
    for _ in range(300):
        n, d = int(rnd.integers(520, 5000)), int(rnd.integers(0, 260))
        x = rnd.integers(0, 2**63, n, dtype=np.uint64)
        y = np.concatenate([x[d:], rnd.integers(0, 2**63, int(rnd.integers(0, 2 * d + 1)), dtype=np.uint64)])
        if len(y) > 512:
            a, b = near_dup.wide_sketch(x), near_dup.wide_sketch(y)
            assert near_dup.bits_apart(a, b) == near_dup.bits_apart(b, a) <= len(np.setxor1d(x, y))
    far = [near_dup.wide_sketch(rnd.integers(0, 2**63, 3000, dtype=np.uint64)) for _ in range(2)]
    assert near_dup.bits_apart(*far) > near_dup.most_different(3000, 3000)


def test_shingler_has_as_many_as_there_are():
    s = shingles.Shingler()
    for t in texts(300):
        assert len(s.distinct(t)) == len(shingles.exact_shingles(t))
    assert len(s.sequence(None)) == 0


def test_compact_windows_partition_all_passages():
    rnd = np.random.default_rng(4)
    for n, least in ((0, 3), (2, 3), (3, 3), (20, 3), (60, 7)):
        h = rnd.permutation(n)
        cover = {}
        for l, c, r in passages.compact_windows(h, least):
            for i in range(l, c + 1):
                for j in range(c, r + 1):
                    if j - i + 1 >= least:
                        assert (i, j) not in cover
                        cover[i, j] = c
        want = {(i, j): i + int(h[i : j + 1].argmin()) for i in range(n) for j in range(i + least - 1, n)}
        assert cover == want


def test_windows_of_a_repeating_text_are_few():
    x = shingles.Shingler().sequence("one two three four five six " * 2000)
    assert len(passages.text_windows(x)[0]) < 8 * 4 * len(x) / passages._SPAN


def test_verified_passage():
    base = [f"w{i}" for i in range(70)]
    a, b = ["x"] * 5 + base + ["y"] * 9, ["p"] * 40 + base + ["q"] * 3
    assert [x[:4] for x in passages.verified(a, b, 45, 50, 35, 35)] == [(5, 75, 40, 110)]
    assert passages.verified(a, ["z"] * 200, 45, 50, 35, 35) == []


def test_passages_inside_dissimilar_regions():
    """A candidate that spans two copied passages with edits and a shift between them gives both."""
    one, two = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(70)]
    a, b = one + [f"x{i}" for i in range(80)] + two, ["lead"] * 9 + one + [f"y{i}" for i in range(95)] + two
    found = passages.verified(a, b, 9, 9 + 60 + 95 + 20, 9, 24)
    assert sorted(x[2:4] for x in found) == [(9, 69), (164, 234)] and all(x[4] == 1.0 for x in found)


def test_windows_are_cut_at_known_passages():
    """Against every start looked up by itself."""
    rnd = random.Random(5)
    ids, spots, islands = [], [], []
    for text in (3, 4, 9):
        x = shingles.Shingler().sequence(" ".join(f"w{rnd.randrange(400)}" for _ in range(300)))
        k, w = passages.text_windows(x)
        ids += [text] * len(w)
        spots += list(w)
        if text != 4:
            islands += [(text, 20, 90, 7), (text, 90, 150, 8), (text, 200, 280, 7)]
    ids, spots = np.array(ids), np.array(spots)
    i_ids, begin, end, classes = (np.array(x) for x in zip(*islands))
    which, cut, of = passages.pieces(ids, spots, i_ids, begin, end, classes)

    def by_start(windows, owner, known):
        first, c, last = passages.starts(windows)
        return {(int(o), int(p), int(w >> 58), s): known(i, s) for i, (o, w, a, p, b) in enumerate(zip(owner, windows, first, c, last)) for s in range(a, b + 1)}

    def class_at(text, s):
        held = [k for t, a, b, k in islands if t == text and a - 45 <= s <= b - 5]
        return held[0] if held else passages.ALONE

    want = by_start(spots, ids, lambda i, s: class_at(ids[i], s))
    assert by_start(cut, ids[which], lambda i, s: int(of[i])) == want


def test_windows_that_too_few_orders_share():
    x = shingles.Shingler().sequence(" ".join(f"w{i}" for i in range(200)))
    _, w = passages.text_windows(x)
    first, _, last = passages.starts(w)
    rnd = np.random.default_rng(2)
    some = w[rnd.random(len(w)) < 0.5]
    f, _, l = passages.starts(some)
    count = [sum((f <= s) & (l >= s)) for s in range(200)]
    want = [any(count[s] >= passages.ENOUGH for s in range(a, b + 1)) for a, b in zip(f, l)]
    assert passages.covered(np.full(len(some), 3), some).tolist() == want
