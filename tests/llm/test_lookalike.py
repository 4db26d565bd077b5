import unicodedata as U

from pyspark.sql import functions as F

from tidegate.llm import lookalike
from tidegate.llm.lookalike import canonical_texts, look_alike_pairs, tables

SAME = ["Café office fine pace 10 x", "Café office fine pace 10 x", "Café oﬃce ﬁne pace 10 x", "Café office fine pace 10　x", "Ca­f​é of﻿fice fi⁠ne pace 10 x",
        "Café оffiсе finе расе 10 х", "Ｃａｆé office fine ｐａｃｅ １０ x", "Сafе́ office fine pace 10 x", "Cafе́ office fine pace 10 x"]
OTHER = ["café office fine pace 10 x", "Cafe office fine pace 10 x", "Café office fine pace 1⁰ x", "Café office fine pace 11 x", "Café office  fine pace 10 x",
         "Café office fine pace ١٠ x", "Café office fine pace 1o x", "Café office\tfine pace 10 x", "Cafȩ́ office fine pace 10 x"]


def frame(spark, texts):
    return spark.createDataFrame([(i, t, "c", 0) for i, t in enumerate(texts)], "doc_id long, text string, form string, id int")


def pairs(spark, texts):
    return sorted((r.doc_a, r.doc_b) for r in look_alike_pairs(frame(spark, texts)).collect())


def test_same_and_different(spark):
    n = len(SAME)
    assert pairs(spark, SAME + OTHER) == [(a, b) for a in range(n) for b in range(a + 1, n)]


def test_copies_nulls_and_marks_in_any_order(spark):
    texts = [None, "", "a", "a", "а", "a​", "ạ́b", "ạ́b", "ё", "ë", "й", "й", "​", "­"]
    want = {(a, b) for g in ((2, 4, 5), (3, 4, 5), (6, 7), (8, 9), (10, 11), (12, 13)) for a in g for b in g if a < b and texts[a] != texts[b]}
    assert pairs(spark, texts) == sorted(want)


def test_canonical_member(spark):
    got = {r.id: (r.class_id, r.canonical) for r in canonical_texts(frame(spark, SAME + OTHER + [None, "", SAME[0], "solo ﬁ é"])).collect()}
    n, m = len(SAME), len(OTHER)
    assert {got[i] for i in [*range(n), n + m + 2]} == {(0, "Café office fine pace 10 x")}
    assert len({got[n + i][1] for i in range(m)} | {got[0][1]}) == m + 1
    assert n + m not in got and n + m + 1 not in got and got[n + m + 3] == (n + m + 3, "solo fi é")


def test_long_and_empty(spark):
    long = "наука и техника " * 40_000
    assert pairs(spark, [long, long.replace(" ", " "), long + "!"]) == [(0, 1)]
    assert pairs(spark, []) == []


def test_tables_follow_unicode():
    single, joined, bare = tables()
    assert single["Ａ"] == "A" and single[" "] == " " and single["‍"] == "" and single["ё"] == "ë" and joined["ﬃ"] == "ffi"
    assert not {"²", "½", "①", "é", "ß", "д", "\n", "\t"} & (set(single) | set(joined))
    assert bare["é"] == "e" and bare["ё"] == "e" and all(U.category(v)[0] == "L" or v for v in bare.values())


def test_the_collation_decides(spark, monkeypatch):
    """Without it, or with one class or canonical member for all, the results are others."""
    texts = ["Café x", "Cafe\u0301 x", "cafe x", "Café y"]
    assert pairs(spark, texts) == [(0, 1)]
    monkeypatch.setattr(lookalike, "COLLATION", "UTF8_BINARY")
    assert pairs(spark, texts) == []
    monkeypatch.setattr(lookalike, "_collated", lambda forms: forms.select("s0", "s1", "t0", "t1", F.lit(0).cast("long").alias("class_id"), F.lit("zzz").alias("canonical")))
    assert pairs(spark, texts[:2] + ["Cafe x"]) == [(0, 1), (0, 2), (1, 2)]  # one class for all
    assert {r.canonical for r in canonical_texts(frame(spark, texts[:2])).collect()} == {"zzz"}


def test_what_the_collation_equates_but_looks_different(spark):
    """Digits of other scripts, circled forms, raised letters, ignored marks and swapped vowels stay apart."""
    stems = [("1", "١"), ("①", "❶"), ("º", "ᵒ"), ("ⅽ", "\u0368"), ("ab", "aـb"), ("เก", "กเ"), ("⑪", "⓫"), ("\u0591a", "a")]
    texts = [f"é{v}" for pair in stems for v in pair]
    assert pairs(spark, texts) == []
    assert pairs(spark, texts + ["e\u0301" + t[1:] for t in texts]) == [(i, i + len(texts)) for i in range(len(texts))]


def test_composed_look_alikes_without_a_composed_partner(spark):
    assert pairs(spark, ["ўa", "y\u0306a", "у\u0306a", "ya", "Ὀ", "O\u0313"]) == [(0, 1), (0, 2), (1, 2), (4, 5)]
