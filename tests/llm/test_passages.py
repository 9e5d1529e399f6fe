"""Windows of many texts at once, and passages of few distinct shingles."""

from __future__ import annotations

import random

import numpy as np

from millrace.llm import passages, shingles


def test_windows_of_many_texts_are_those_of_each():
    rnd, shingler = random.Random(3), shingles.Shingler()
    texts = [" ".join(f"w{rnd.randrange(top)}" for _ in range(n)) for n, top in ((46, 9), (50, 900), (300, 900), (700, 20), (120, 1), (400, 5000))]
    texts += ["lead " * 70 + texts[2], " ".join(f"v{i}" for i in range(90))]
    own = [shingler.sequence(t) for t in texts]
    which, key, spot = passages.many_windows(own)
    want = [(i, *x) for i, t in enumerate(own) for x in zip(*(c.tolist() for c in passages.text_windows(t)))]
    assert sorted(zip(which.tolist(), key.tolist(), spot.tolist())) == sorted(want) and any(i == 0 for i, *_ in want) is (len(own[0]) >= passages._SPAN)


def test_interval_joins_against_every_start():
    """Starts that windows of ENOUGH orders hold on diagonals that are near, each start looked up by itself."""
    rnd, shingler = random.Random(4), shingles.Shingler()
    shared = [f"s{i}" for i in range(90)]
    pairs, want = [], []
    for n in range(12):
        copy = list(shared)
        copy[rnd.randrange(90)] = "new"
        texts = [[f"{n}{side}{i}" for i in range(rnd.randrange(40))] + part for side, part in (("a", shared), ("b", copy))]
        (ka, wa), (kb, wb) = (passages.text_windows(shingler.sequence(" ".join(t))) for t in texts)
        met = [(n, x, y) for k, x in zip(ka.tolist(), wa.tolist()) for j, y in zip(kb.tolist(), wb.tolist()) if k == j]
        pairs += met
        at = {}
        for _, x, y in met:
            order, la, ca, ra = passages.unpacked(x)
            _, lb, cb, rb = passages.unpacked(y)
            for s in range(max(lb, cb - 45, la + cb - ca), min(cb, rb - 45, ra + cb - ca - 45) + 1):
                at.setdefault(s, set()).add(order)
        want += [(n, s) for s, orders in at.items() if len(orders) >= passages.ENOUGH]
    found = passages.candidate_passages(*(np.array(x, np.int64) for x in zip(*pairs)))
    assert sorted(want) == sorted((n, s) for n, first, last, *_ in found.tolist() for s in range(first, last + 1)) and want


def test_runs_are_the_passages_of_few_shingles():
    x = shingles.Shingler().sequence(" ".join([f"a{i}" for i in range(60)] + ["the"] * 70 + [f"b{i}" for i in range(30)] + ["x", "y"] * 30))
    keys, spots = passages.text_runs(x)
    y = shingles.Shingler().sequence(" ".join(["y", "x"] * 40 + ["c"] + ["the"] * 50))
    others = passages.text_runs(y)[0]
    assert [tuple(passages.unpacked(s)[i] for i in (0, 2, 3)) for s in spots.tolist()] == [(passages.RUN, 60, 60 + 70 - 50), (passages.RUN, 160, 160 + 60 - 50)]
    assert keys.tolist() == others.tolist()[::-1]


def test_repetitive_passages_meet_in_pairs_of_a_number_like_theirs(spark, monkeypatch):
    """Texts with a long run of one word among their own, half of them with a shorter run: all long ones are of one class, and
    not every pair of them is compared."""
    verify, pairs = passages._verify, []

    def counted(candidates, texts):
        pairs.append(candidates.select("a", "b").distinct().count())
        return verify(candidates, texts)

    monkeypatch.setattr(passages, "_verify", counted)
    rows = [(i, " ".join([f"l{i}w{j}" for j in range(30)] + ["the"] * ((60 if i < 40 else 25) + i % 7) + [f"r{i}w{j // 9}" for j in range(60)])) for i in range(80)]
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    assert {r.doc_id for r in found} == set(range(40)) and {(r.class_id, r.class_docs) for r in found} == {("0:30", 40)}
    assert sum(pairs) <= 5 * 80


def test_passages_with_other_words_at_their_ends():
    """49 words and one more that differs: 45 of 47 shingles of the passages of 50 words are the same."""
    shared = [b"s%d" % i for i in range(49)]
    a, b = ([b"%s%d" % (side, i) for i in range(60)] + shared + [b"%s%d" % (side, i) for i in range(60, 120)] for side in (b"a", b"b"))
    ((a1, a2, b1, b2, similarity),) = passages.verified(a, b, 55, 65, 0, 0)
    assert (a2 - a1, b2 - b1) == (50, 50) and a1 == b1 and a1 in (59, 60) and similarity == 45 / 47
    assert not passages.verified(a[:60] + shared[:44] + a[109:], b[:60] + shared[:44] + b[109:], 55, 65, 0, 0)


def test_rarest_shingles_leave_no_similar_passage_out():
    """Any passage with 41 shingles of a least one has one of those taken; where more than five are nobody's, it is like none."""
    rnd = random.Random(6)
    for _ in range(60):
        own = np.arange(46) if rnd.random() < 0.7 else np.array([rnd.randrange(20) for _ in range(46)])
        others = np.array([rnd.choice([0, 1, 2, 900, 900, 900, 900, 900]) for _ in range(46)])[own]
        alive, taken = passages.rarest(own, others, np.array([0]))
        distinct = len(set(own.tolist()))
        lacking = 5 if distinct == 46 else distinct // 5
        nobody = set(own[others == 0].tolist())
        assert alive.tolist() == [len(nobody) <= lacking]
        if alive[0]:
            assert len(set(own[taken].tolist())) + len(nobody) == lacking + 1 and not set(own[taken].tolist()) & nobody


def test_many_edits_of_one_text_meet_few_others(spark, monkeypatch):
    """Edits of one text, some unlike it at most places: all that have a least passage of it are of its class, without the pairs of all."""
    verify, pairs = passages._verify, []

    def counted(candidates, texts):
        pairs.append(candidates.select("a", "b").distinct().count())
        return verify(candidates, texts)

    monkeypatch.setattr(passages, "_verify", counted)
    rnd, base, rows, like = random.Random(9), [f"b{j}" for j in range(160)], [(0, " ".join(f"b{j}" for j in range(160)))], {0}
    for i in range(1, 240):
        text = list(base)
        for at in (places := rnd.sample(range(160), rnd.randrange(2, 6))):
            text[at] = f"e{i}x{at}"
        if max(np.diff(sorted([-1, *places, 160]))) > 50:
            like.add(i)
        rows.append((i, " ".join(text)))
    found = passages.repeated_passages(spark.createDataFrame(rows, "doc_id long, text string").repartition(3)).collect()
    (largest,) = {r.class_id for r in found if r.class_docs == max(r.class_docs for r in found)}
    assert len(like - {r.doc_id for r in found if r.class_id == largest}) <= 0.02 * len(like)
    assert sum(pairs) <= 12 * 240
