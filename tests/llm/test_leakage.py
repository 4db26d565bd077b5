import random

import pytest

from tidegate.llm.leakage import in_order, judged, leaks, tiles, with_words

RNG = random.Random(11)
VOCAB = [a + b for a in ("ka", "lo", "mi", "nu", "re", "so") for b in ("dan", "fel", "gor", "hit", "jun", "kep", "lum")]
PASSAGE = [f"{RNG.choice(VOCAB)}{k}" for k in range(40)]


def other(n):
    return [f"{RNG.choice(VOCAB)}x{RNG.randrange(999)}" for _ in range(n)]


def run(spark, texts, passages, where="in_order"):
    docs = spark.createDataFrame([(i, t, "c") for i, t in enumerate(texts)], "doc_id long, text string, passage string")
    items = spark.createDataFrame([(i, p, "c") for i, p in enumerate(passages)], "item_id long, passage string, text string")
    return sorted((r.item_id, r.doc_id) for r in leaks(docs, items).where(where).collect())


def changed(ws, at):
    return [w if i not in at else f"zz{i}" for i, w in enumerate(ws)]


CASES = [
    (PASSAGE, True), (PASSAGE[10:30], True), (changed(PASSAGE[5:25], {7, 14}), True), (changed(PASSAGE[5:25], {5, 10, 15}), False),
    (changed(PASSAGE, {9, 18, 27, 36}), True), (changed(PASSAGE, {3, 7, 11, 15, 19, 23, 27, 31, 35}), False),
    ([w for i, w in enumerate(PASSAGE[:22]) if i not in (8, 15)], True), (PASSAGE[:10] + ["extra"] + PASSAGE[10:20], True),
    (PASSAGE[12:22], False), (PASSAGE[20:] + PASSAGE[:20], True), (PASSAGE[:10] + other(30) + PASSAGE[10:20], False), (PASSAGE[10:20] + PASSAGE[:10], False),
]


def aligned(a, b, least=20, one_in=10):
    """Brute force: words of the longest piece of a that some stretch of b holds within the edits."""
    least, best = min(least, len(a)), 0
    for p in range(len(a) - least + 1):
        row = [0] * (len(b) + 1)
        for i, w in enumerate(a[p:], 1):
            left, row[0] = row[0], i
            for j, v in enumerate(b, 1):
                left, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, left + (w != v))
            if i >= least and min(row) * one_in <= i:
                best = max(best, i)
    return best


@pytest.mark.parametrize("piece,holds", CASES)
def test_pieces(piece, holds):
    text = other(50) + piece + other(30)
    assert (judged(PASSAGE, text)[1] > 0) == holds == (aligned(PASSAGE, text) > 0)
    # a second, shorter quotation elsewhere takes nothing away
    assert (judged(PASSAGE, other(3) + PASSAGE[:9] + text)[1] > 0) == holds
    assert (judged(PASSAGE, text + PASSAGE[30:38] + other(2) + PASSAGE[16:24])[1] > 0) == holds


@pytest.mark.parametrize("vocabulary", [40, 6])
def test_tiles_and_alignment_agree(vocabulary):
    """Pieces with random edits, of a passage of different words and of one that repeats few words."""
    rng = random.Random(4)
    passage = PASSAGE if vocabulary == 40 else [rng.choice(PASSAGE[:vocabulary]) for _ in range(40)]
    for _ in range(150):
        piece = list(passage[rng.randrange(15) :][: rng.randrange(16, 40)])
        for _ in range(rng.randrange(6)):
            at = rng.randrange(len(piece))
            piece[at : at + rng.choice([0, 1])] = other(rng.choice([0, 1]))
        text = other(9) + piece + other(9)
        assert (judged(passage, text)[1] > 0) == (aligned(passage, text) > 0), piece


def test_long_pieces_are_found_by_a_half():
    rng = random.Random(9)
    passage = other(120)
    for _ in range(40):
        piece = list(passage)
        for at in rng.sample(range(120), rng.randrange(16)):
            piece[at] = "changed"
        assert (in_order(passage, piece) > 0) == (aligned(passage, piece) > 0), piece


def test_coverage_catches_reordered_passages(spark):
    """Whole, halves swapped, thirds in another order; and two covered thirds too few words."""
    swapped, thirds = PASSAGE[20:] + other(5) + PASSAGE[:20], PASSAGE[12:22] + PASSAGE[:12] + PASSAGE[22:34]
    texts = [" ".join(other(40) + t + other(20)) for t in (PASSAGE, swapped, PASSAGE[10:20] + PASSAGE[:10], thirds, PASSAGE[:6] + other(9) + PASSAGE[20:26])]
    assert run(spark, texts, [" ".join(PASSAGE)], "true") == [(0, 0), (0, 1), (0, 2), (0, 3)]
    assert run(spark, texts, [" ".join(PASSAGE)]) == [(0, 0), (0, 1)]
    assert judged(PASSAGE, PASSAGE[10:20] + PASSAGE[:10]) == (20, 0)


def test_a_threshold_on_the_coverage_decides(monkeypatch):
    piece = PASSAGE[10:20] + PASSAGE[:10]
    assert judged(PASSAGE, piece, cover=1.0)[0] == 20 and judged(PASSAGE, piece, cover=1.01) == (0, 0)


def test_a_passage_across_blocks_and_far_apart(spark):
    """Stretches are cut from the document around the seeds: at a block's edge, in several blocks, at either end."""
    texts = [" ".join(other(k) + PASSAGE + other(10)) for k in (0, 216, 250, 256, 500)]
    texts += [" ".join(PASSAGE + other(700) + PASSAGE), " ".join(PASSAGE[:12] + other(700) + PASSAGE[12:24])]
    assert run(spark, texts, [" ".join(PASSAGE)]) == [(0, i) for i in range(6)]


def test_the_join_finds_the_same(spark):
    texts = [" ".join(other(50) + piece + other(30)) for piece, _ in CASES]
    assert run(spark, texts, [" ".join(PASSAGE)]) == [(0, i) for i, (_, holds) in enumerate(CASES) if holds]


def test_tiles_are_greedy_and_disjoint():
    rng = random.Random(0)
    for _ in range(60):
        a, b = ([rng.choice("abcd") for _ in range(rng.randrange(30))] for _ in range(2))
        got = tiles(a, b)
        assert all(a[i : i + k] == b[j : j + k] and k >= 2 for i, j, k in got)
        for side in (0, 1):
            used = [t[side] + x for t in got for x in range(t[2])]
            assert len(used) == len(set(used))
        longest = max((k for i in range(len(a)) for j in range(len(b)) for k in range(1, 31) if a[i : i + k] == b[j : j + k] and len(a[i : i + k]) == k and len(b[j : j + k]) == k), default=0)
        assert max((k for _, _, k in got), default=0) == (longest if longest >= 2 else 0)


def test_disguises_do_not_count(spark):
    p = "Café Zedhar logs 9513 alarms; Umbbrator blames the tunnelled relay at 28.37 while Torharpel blames drop quota above the other office limit twice."
    forms = [p.upper(), p.replace(" ", "\n\t "), p.replace(" ", " "), p.replace("a", "а").replace("o", "ο"), "​".join(p), p.replace("é", "é"),
             "<p>" + p.replace("alarms", "<b>alarms</b>").replace("relay", '<a href="x y">relay</a>') + "</p>", '{"prompt": "' + p.replace(" blames", "\\nblames") + '"}',
             p.replace(";", "").replace(".", ""), "".join(chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else c for c in p), "**" + p + "** _x_"]
    assert run(spark, forms, [p, None, "", "too short", p]) == [(i, d) for i in (0, 4) for d in range(len(forms))]


def test_whole_short_passage(spark):
    p = "seven words make one very short passage"
    assert run(spark, ["so " + p + " ends", p.replace("one", "two")], [p]) == [(0, 0)]


def test_nulls_empty_long(spark):
    long = " ".join(other(60_000) + PASSAGE + other(10))
    assert run(spark, [None, "", long, long], [" ".join(PASSAGE)]) == [(0, 2), (0, 3)]
    assert run(spark, [], ["a b c d e f"]) == [] and run(spark, ["a b c d e f"], []) == []


def test_words(spark):
    def said(t):
        return spark.createDataFrame([(t,)], "t string").transform(with_words, "t", "w").select("w").first()[0]

    assert said("A-b  c's 1,234.5 &amp; <i>x</i>y <br/>z!") == "a b cs 12345 xy z"
    assert said("re&eacute;ntry &#233;t&#xE9; &frac12; &CounterClockwiseContourIntegral; caf\\u00e9 a\\nb") == "reentry ete ½ cafe a b"
    assert said('x <a href="' + "q" * 5000 + '">y</a> <p ' + "w " * 3000 + ">z") == "x y z"
    assert said("a < b and c > d") == "a b and c d" and said("&lt;p&gt;x&lt;/p&gt; AT&T") == "x at t"
