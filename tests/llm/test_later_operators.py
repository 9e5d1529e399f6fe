"""Vector codes, rolling features and fingerprints against brute force in plain Python."""

import hashlib
import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import fingerprints, rolling, vector_codes

VECTORS = "vec_id bigint, embedding array<float>, label int, id string, n int, codes string, error int"
DOCS = "doc_id bigint, text string, lang string, source string, n_chars bigint, at string, n int, bucket int, mark string, features int, event_s string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, "x", 0, "", 0) for i, v, label in rows], VECTORS).repartition(5)


def brute_codes(rows, parts=4, k=256, rounds=4):
    """Plain integers, one vector at a time."""
    dim = max((len(v) for _, v, _ in rows), default=0)
    dim = -(-max(dim, 1) // parts) * parts
    limit = int((2**62 / dim) ** 0.5) // 2
    ints = [(i, [max(-limit, min(limit, math.floor(1024 * x))) for x in v] + [0] * (dim - len(v)), label) for i, v, label in sorted(rows, key=lambda r: (r[0] is None, r[0] or 0, r[1]))]
    w = dim // parts
    books = [[list(x[p * w : p * w + w]) for _, x, _ in ints[:k]] for p in range(parts)]

    def near(x, book):
        return min((sum((a - b) ** 2 for a, b in zip(x, e, strict=True)), i) for i, e in enumerate(book))

    for _ in range(rounds):
        for p in range(parts):
            groups = {}
            for _, x, _ in ints:
                part = x[p * w : p * w + w]
                groups.setdefault(near(part, books[p])[1], []).append(part)
            for i, g in groups.items():
                books[p][i] = [sum(c) // len(g) for c in zip(*g, strict=True)]
    out = []
    for i, x, label in ints:
        found = [near(x[p * w : p * w + w], books[p]) for p in range(parts)]
        out.append((i, "".join(f"{e:02x}" for _, e in found), sum(d for d, _ in found), label))
    errors = Counter()
    for _, _, e, label in out:
        errors[label] += e
    digest = hashlib.sha256(",".join(str(c) for book in books for e in book for c in e).encode()).hexdigest()
    return sorted((str(i), code, e, errors[label]) for i, code, e, label in out), digest


def test_vector_codes(spark):
    rnd = random.Random(3)
    rows = [(i, [float(np.float32(rnd.gauss(0, 1))) for _ in range(16)], rnd.choice([None, 0, 0, 0, 1, 2, i])) for i in range(400)]
    rows += [(7, rows[9][1], 1), (7, rows[9][1], 1), (7, rows[10][1], None), (None, rows[3][1], 0), (1000, [1e30, -1e30] + [0.0] * 14, 5), (1001, [0.5, 0.25, -0.125], 5), (1002, [], 6)]
    broken = [(5000, None, 0), (5001, [float("nan")] * 16, 0), (5002, [None] + [0.0] * 15, 1), (5003, [float("inf")] * 16, 2)]
    table = vectors(spark, rows + broken)
    coded, books = vector_codes.compress(table)
    want, digest = brute_codes(rows)
    assert sorted((str(r.vec_id), r.code, r.error, r.label_error) for r in coded.collect()) == want
    assert books.digest() == digest
    code = next(r.code for r in coded.collect() if r.vec_id == 1001)
    assert len(books.vector(code)) == 16 and abs(books.vector(code)[0] - 0.5) < 0.6


def test_vector_codes_of_few_rows(spark):
    coded, books = vector_codes.compress(vectors(spark, [(2, [0.5] * 6, None), (1, [0.25] * 6, None)]))
    assert sorted(map(tuple, coded.collect())) == [(1, "00000000", 0, 0), (2, "01010100", 0, 0)]  # the last part is padding: a tie
    assert books.entries.shape == (4, 2, 2)
    coded, books = vector_codes.compress(vectors(spark, [(2, None, None)]))
    assert coded.count() == 0 and books.digest() == hashlib.sha256(b"").hexdigest()


def test_labels_beyond_the_hot_ones(spark):
    rows = [(i, [float(i % 13), 1.0, 0.0, float(i % 7)], i % 3 if i % 2 else i + 10) for i in range(3000)]
    rows = [(i, v, None if i % 11 == 0 else label) for i, v, label in rows]
    coded, _ = vector_codes.compress(vectors(spark, rows), entries=4)
    got = coded.collect()
    of, errors = {i: label for i, _, label in rows}, Counter()
    for r in got:
        errors[of[r.vec_id]] += r.error
    assert len(got) == 3000 and all(r.label_error == errors[of[r.vec_id]] for r in got) and sum(errors.values()) > 0


def test_distances_as_doubles_and_as_integers():
    rnd = np.random.default_rng(1)
    small, books = rnd.integers(-2000, 2000, (8, 1500)), rnd.integers(-2000, 2000, (4, 256, 2))
    big = 1 << 16
    for a, b in zip(vector_codes.assign(small, books), vector_codes.assign(small * big, books * big), strict=True):
        assert (a * (1 if a.ndim == 2 else big * big) == b).all()


def brute_windows(rows, w):
    out = []
    for doc_id, text, lang, source, t in rows:
        inside = [r for r in rows if t is not None and r[4] is not None and r[3] == source and t - w <= r[4] < t]
        lengths = sorted(len(r[1]) for r in inside if r[1] is not None)
        m = len(lengths)
        rank = lambda p: lengths[-(-p * m // 100) - 1] if m else None  # noqa: E731, B023
        out.append((str(doc_id), w, t, len(inside), sum(lengths), len({r[2] for r in inside if r[2] is not None}), rank(50), rank(90)))
    return out


def event_s(i):
    return None if i is None else 60 * ((i + zlib.crc32(str(i).encode()) % 10000) // 6)


@pytest.mark.parametrize("seed", [1, 2])
def test_rolling_features(spark, seed):
    rnd = random.Random(seed)
    ids = [rnd.randrange(-3000, 3000) for _ in range(500)] + [None, None] + [5] * 20
    rows = [(i, rnd.choice([None, "", "é" * rnd.randrange(9), "x" * rnd.randrange(400)]), rnd.choice(["en", "fr", None, "de"]), rnd.choice([None, "", "a", "a", "a", "b"])) for i in ids]
    docs = spark.createDataFrame([(i, t, lang, s, -1, "", 0, 0, "", 0, "") for i, t, lang, s in rows], DOCS).repartition(4)
    got = rolling.roll(rolling.document_events(docs)).collect()
    timed = [(*r, event_s(r[0])) for r in rows]
    want = [x for w in rolling.WINDOWS for x in brute_windows(timed, w)]
    assert sorted((str(r[0]), *r[1:]) for r in got) == sorted(want, key=str) or sorted(map(str, ((str(r[0]), *r[1:]) for r in got))) == sorted(map(str, want))


def test_rolling_features_of_other_tables(spark):
    docs = spark.createDataFrame([], DOCS)
    assert rolling.roll(rolling.document_events(docs)).count() == 0
    far = spark.createDataFrame([((1 << 63) - 1, "a", "en", "s", 0, "", 0, 0, "", 0, ""), (-(1 << 63), "b", "en", "s", 0, "", 0, 0, "", 0, "")], DOCS)
    assert {(r.event_s, r.n_events, r.median_chars) for r in rolling.roll(rolling.document_events(far)).collect()} == {(None, 0, None)}
    dense = spark.range(4000).select((F.col("id") % 3).alias("doc_id"), F.lit("s").alias("source"), (F.col("id") % 4 * 10).alias("event_s"), (F.col("id") % 5).alias("length"), F.lit("en").alias("lang"))
    got = {(r.event_s, r.window_s): r for r in rolling.roll(dense, windows=(10, 25)).collect()}
    assert got[(30, 25)].n_events == 2000 and got[(30, 10)].n_events == 1000 and got[(0, 25)].n_events == 0
    lengths = sorted(i % 5 for i in range(4000) if i % 4 in (1, 2))
    assert got[(30, 25)].median_chars == lengths[999] and got[(30, 25)].high_chars == lengths[1799] and got[(30, 25)].sum_chars == sum(lengths)


def brute_features(data, width, span, least):
    """One window at a time: entropies by counting, points by looking at each run."""
    ranks = fingerprints.default_ranks()
    unit = lambda c: round(c * math.log2(c) * 4096) if c else 0
    windows = [data[i : i + width] for i in range(len(data) - width + 1)]
    levels = [1000 - sum(unit(c) for c in Counter(x).values()) * 1000 // unit(width) for x in windows]
    points = Counter()
    for a in range(max(len(windows) - span, 0) + 1):
        run = range(a, min(a + span, len(windows)))
        if run:
            points[min(run, key=lambda i: (ranks[levels[i]], i))] += 1
    most = max(points.values(), default=0)
    chosen = [i for i in range(len(windows)) if points[i] >= min(least, most) and points[i]]
    mask = (1 << 64) - 1
    out = []
    for i in chosen:
        h = width
        for j in range(0, width, 8):
            h = (h ^ int.from_bytes(windows[i][j : j + 8], "little")) * 0x9E3779B97F4A7C15 & mask
            h ^= h >> 29
        h = h * 0x9E3779B97F4A7C15 & mask
        h ^= h >> 32
        if h not in out:
            out.append(h)
    return out


def brute_print(text):
    data = text.encode()
    chains = {"w": brute_features(data, 32, 32, 8)}
    if len(data) < 256:
        chains = {"s": brute_features(data, 8, 4, 1) or ([int.from_bytes(hashlib.sha256(data).digest()[:8], "little")] if data else []), **chains}
    out = []
    for kind, hashes in chains.items():
        bits = set()
        for k, h in enumerate(hashes):
            bits |= {2048 * (k // 160) + (h >> 11 * p) % 2048 for p in range(5)}
        n = -(-len(hashes) // 160) * 256
        out.append((kind, len(hashes), int.from_bytes(bytes(n)) | sum(1 << (8 * n - 1 - b) for b in bits)))
    return out


def parsed(written):
    return [(kind, n, int.from_bytes(code)) for kind, (n, code) in fingerprints.Digest.parse(written).chains.items()]


TEXTS = ["", "a", "ab cd", "short one here", "x" * 40, "x" * 600, "long " * 90, "é中🎉 mixed <b>bytes</b> " * 9]


def prose(seed, n):
    rnd = random.Random(seed)
    return " ".join(rnd.choice(["alpha", "river", "of", "the", "stone", "Zürich", "42", "(or)", "quick,", "brown.", "and", f"w{rnd.randrange(900)}"]) for _ in range(n))


def test_fingerprints_by_brute_force(monkeypatch):
    texts = TEXTS + [prose(i, n) for i, n in enumerate((5, 12, 30, 45, 60, 150, 400, 1500))]
    got = [str(d) for d in fingerprints.digests(texts)]
    assert [parsed(g) for g in got] == [brute_print(t) for t in texts]
    monkeypatch.setattr(fingerprints, "PIECE", 300)
    monkeypatch.setattr(fingerprints, "BATCH", 200)
    assert [str(d) for d in fingerprints.digests(texts)] == got == [fingerprints.fingerprint(t) for t in texts]


def test_likeness():
    a, b = prose(1, 3000), prose(2, 3000)
    like = lambda x, y: fingerprints.likeness(fingerprints.fingerprint(x), fingerprints.fingerprint(y))
    assert like(a, a) == 1 and like("", "") == 1 and like("", "a") == 0 and like(a, "") == 0
    assert like(a, b) < 0.15 and like(a, b) == like(b, a)
    assert like(a, fingerprints.edit(a, b)) > 0.6
    assert 0.5 < like(a, a[:600] + " inserted words " + a[600:]) < 1
    assert fingerprints.edit("abcdefgh", "x") == "abcdefx" and fingerprints.edit("abc", "x") == "abc" and fingerprints.edit("abcdefgh", "xyz") == "abcdefxy"


def brute_edited(rows):
    """Distinct (id, text), ordered by id; of one id by the hash that Spark gives."""
    out = []
    for i, (doc_id, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        made = fingerprints.edit(text, after)
        prints = [fingerprints.fingerprint(t) for t in (text, made, after)]
        out.append((str(doc_id), len(text), hashlib.sha256(made.encode()).hexdigest(), prints[0], prints[1], fingerprints.likeness(prints[0], prints[1]), fingerprints.likeness(prints[0], prints[2])))
    return out


@pytest.mark.parametrize("bucket", [1, 1 << 10, 1 << 20])
def test_edited_documents(spark, bucket, monkeypatch):
    monkeypatch.setattr(fingerprints, "BUCKET_BYTES", bucket)
    monkeypatch.setattr(fingerprints, "LEAST_BUCKET", 1)
    rnd = random.Random(5)
    pairs = [(i, t) for i, t in enumerate(TEXTS)] + [(100 + 7 * i, prose(i, rnd.randrange(1, 300))) for i in range(60)]
    pairs += [(None, "no id"), (None, None), (300, "same id, another text"), (9, None), (5000, "word " * 20_000)]
    copies = [(107, pairs[len(TEXTS) + 1][1])] * 3 + [(None, "no id")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0, "", 0, 0, "", 0, "") for i, t in pairs + copies], DOCS).repartition(3)
    marks = {r.text: r.h for r in docs.select(F.coalesce("text", F.lit("")).alias("text"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("h")).collect()}
    order = sorted({(i, t or "") for i, t in pairs}, key=lambda p: (p[0] is not None, p[0] or 0, marks[p[1]]))
    want = brute_edited(order)
    times = Counter((str(i), t or "") for i, t in pairs + copies)
    expected = sorted(w for w, (i, t) in zip(want, order, strict=True) for _ in range(times[(str(i), t)]))
    got = fingerprints.edited(docs).collect()
    assert sorted((str(r[0]), *r[1:]) for r in got) == expected


def test_edited_documents_of_small_tables(spark):
    nothing = spark.createDataFrame([], DOCS)
    assert fingerprints.edited(nothing).count() == 0 and fingerprints.fingerprint_documents(nothing).count() == 0
    one = spark.createDataFrame([(1, "abcdefgh", "en", "s", 0, "", 0, 0, "", 0, "")], DOCS)
    (row,) = fingerprints.edited(one).collect()
    assert row.edited_sha256 == hashlib.sha256(b"abcdefab").hexdigest() and row.near_next == 1


def test_ranks_of_a_corpus(spark):
    docs = spark.createDataFrame([(i, prose(i, 200)) for i in range(20)] + [(50, None)], "doc_id bigint, text string")
    ranks = fingerprints.fit_ranks(docs)
    seen = Counter()
    for r in docs.collect():
        if r.text:
            seen.update(fingerprints.entropy_levels(np.frombuffer(r.text.encode(), np.uint8), 32).tolist())
    text = [v for v in seen if v >= fingerprints.LOW]
    assert sorted(text, key=lambda v: ranks[v]) == sorted(text, key=lambda v: (seen[v], v))
    made = {r.doc_id: r.fingerprint for r in fingerprints.fingerprint_documents(docs, ranks=ranks).collect()}
    assert made[3] == fingerprints.fingerprint(prose(3, 200), ranks) and made[50] == fingerprints.fingerprint("")
