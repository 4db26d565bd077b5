"""Held-out passages that stand, wholly or in a substantial piece, in a large corpus.

Texts become word sequences that case, punctuation, markup and disguised characters do not change. Passages and
documents that share enough word seeds are compared by greedy string tiling: the longest common runs of words that
are still unmarked are marked, again and again, found by running Karp-Rabin with a shrinking window. What share of
the passage the tiles cover decides, in whatever order they stand; whether the covered words also stand in order,
with few enough edits, is a second test, whose result is reported beside the coverage.

Seeds are five words. A window of L words with e changed keeps at least L - 4 - 5e of its seeds, so with at least 20
words and one change in ten a true case shares six of them: the filter on the number of seeds loses nothing. Of its
L - e unchanged words at most e stand alone, so tiles of two words and more cover L - 2e, four fifths of it; the
threshold of 0.7 leaves room for tiles that greed placed otherwise.

In order: a piece of L >= 20 words with e edits, 10 e <= L. If there is one of 40 words or more, one of its halves
is another, so looking for pieces with at most three edits finds every case; that takes one pass over the passage,
which keeps, for every place in the text and number of edits, the earliest start of a piece that ends there.

Seeds of all documents are joined with those of the passages: the passages are a stated query set, sent to every
executor as long as its seeds number at most ``MAX_SEEDS``, else joined by a shuffle. Of documents with enough seeds
only the stretches around them are compared; whole texts are neither shuffled nor sent to Python.

Defined cases: null or empty texts and passages of fewer than five words match nothing; a passage listed twice is
found under each id; a document that holds a passage twice is found once; empty tables give empty results.
"""

from __future__ import annotations

import html
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegate.llm.lookalike import PLAIN, with_skeleton
from tidegate.scratch import materialize
from tidegate.sources.tables import bounded

SEED = 5
LEAST, ONE_IN = 20, 10  # words of a piece, and words per edit
COVER = 0.7  # of the least piece that tiles must cover
BLOCK = 256  # words of a document whose seeds are compared together
MAX_SEEDS = 2_000_000
MAX_PAIRS = 1_000_000  # pairs with enough seeds, and their passages, that are sent to every executor
INLINE = "b|i|u|s|em|strong|span|a|code|mark|small|font|tt|sup|sub"
ESCAPED = r"&#?[A-Za-z0-9]+;|\\u[0-9a-fA-F]{4}"


def _unescaped(text: Column) -> Column:
    """Character references of markup and of JSON decoded; only texts that have one leave the JVM."""

    @F.pandas_udf(T.StringType())
    def decode(texts: pd.Series) -> pd.Series:
        code = re.compile(r"\\u([0-9a-fA-F]{4})")
        lone = lambda m: c if not 0xD800 <= ord(c := chr(int(m[1], 16))) <= 0xDFFF else " "
        return texts.map(lambda t: code.sub(lone, html.unescape(t)), na_action="ignore")

    has = text.rlike(ESCAPED)
    return F.when(has, decode(F.when(has, text))).otherwise(text)


def with_words(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: lower-case words without accents, punctuation and markup, joined by single blanks.

    One column per step, so that a step that names the text twice does not compute the steps before it twice."""
    c = F.col("_w")
    df = with_skeleton(df.withColumn("_u", _unescaped(F.col(text_col))), "_u", "_w").withColumn("_w", F.lower("_w"))
    plain = F.regexp_replace(F.regexp_replace(c, rf"</?(?:{INLINE})(?:\s[^<>]*+)?>", ""), r"</?[a-z!][^<>]*+>", " ")
    df = df.withColumn("_w", F.when(F.contains(c, F.lit("<")), plain).otherwise(c))
    df = df.withColumn("_w", F.when(F.contains(c, F.lit("\\")), F.regexp_replace(c, r"\\[nrt]", " ")).otherwise(c))
    df = df.withColumn("_w", F.regexp_replace(F.translate(c, "'’`´", ""), r"[.,](?<=[0-9][.,])(?=[0-9])", ""))
    only = lambda kept: F.btrim(F.regexp_replace(c, f"[^{kept}]+", " "))
    return df.withColumn(out, F.when(c.rlike(PLAIN), only("a-z0-9")).otherwise(only(r"\p{L}\p{N}"))).drop("_w", "_u")


def seeds(spoken: Column) -> Column:
    """Hash of every five successive words, in order of position."""
    h = F.transform(F.split(spoken, " "), lambda w: F.xxhash64(w))

    def at(hashes: Column) -> Column:
        n = F.size(hashes) - (SEED - 1)
        places = F.when(n > 0, F.sequence(F.lit(1), n)).otherwise(F.array().cast("array<int>"))
        return F.transform(places, lambda i: F.xxhash64(*(F.get(hashes, i + (k - 1)) for k in range(SEED))))

    # The hashes are bound once, as the single element of an array, not once per position.
    return F.flatten(F.transform(F.array(h), at))


# -- greedy string tiling ---------------------------------------------------------------------------------------

_BASE, _MASK = 1_000_003, (1 << 61) - 1


def _windows(ids: list[int], free: list[bool], s: int) -> Iterator[tuple[int, int]]:
    """(position, running hash) of every window of s unmarked words."""
    top = pow(_BASE, s - 1, _MASK)
    h = run = 0
    for i, x in enumerate(ids):
        if not free[i]:
            h = run = 0
            continue
        if run == s:
            h = (h - ids[i - s] * top) % _MASK
            run -= 1
        h, run = (h * _BASE + x) % _MASK, run + 1
        if run == s:
            yield i - s + 1, h


def tiles(a: list[str], b: list[str], least: int = 2, start: int = 16) -> list[tuple[int, int, int]]:
    """Greedy string tiling: (position in a, position in b, length), longest first, none overlapping."""
    number: dict[str, int] = {}
    x = [number.setdefault(w, len(number) + 1) for w in a]
    y = [number.get(w, 0) for w in b]
    free_x, free_y = [True] * len(x), [w > 0 for w in y]
    found: list[tuple[int, int, int]] = []
    s = max(least, min(start, len(x)))
    while True:
        table: dict[int, list[int]] = {}
        for i, h in _windows(x, free_x, s):
            table.setdefault(h, []).append(i)
        matches = []
        for j, h in _windows(y, free_y, s):
            for i in table.get(h, ()):
                if i and j and free_x[i - 1] and free_y[j - 1] and x[i - 1] == y[j - 1]:
                    continue  # part of a match that began earlier
                k = 0
                while i + k < len(x) and j + k < len(y) and free_x[i + k] and free_y[j + k] and x[i + k] == y[j + k]:
                    k += 1
                if k >= s:
                    matches.append((k, i, j))
        again = False
        for k, i, j in sorted(matches, key=lambda m: (-m[0], m[1], m[2])):
            if all(free_x[i : i + k]) and all(free_y[j : j + k]):
                free_x[i : i + k] = free_y[j : j + k] = [False] * k
                found.append((i, j, k))
            else:
                again = True  # a part of it may still be free
        if again:
            continue
        if s == least:
            return found
        s = max(least, s // 2)


def in_order(a: list[str], b: list[str], least: int = LEAST, one_in: int = ONE_IN) -> int:
    """Words of passage ``a`` that lie in pieces which ``b`` holds in order: pieces of at least ``least`` words (the
    whole passage, if shorter) with at most one word in ``one_in`` changed, dropped or added, and at most three."""
    least = min(least, len(a))
    most = min(3, len(a) // one_in)
    number = {w: i for i, w in enumerate(dict.fromkeys(a))}
    y = np.array([number.get(w, -1) for w in b], dtype=np.int64)
    start = np.zeros((most + 1, len(y) + 1), dtype=np.int64)  # by edits and place in b: where the piece began
    inside = np.zeros(len(a), dtype=bool)
    never = len(a) + 1
    for i, w in enumerate(a, 1):
        same = y == number[w]
        new = np.full_like(start, i)
        np.minimum(new[:, 1:], np.where(same, start[:, :-1], never), out=new[:, 1:])
        for e in range(1, most + 1):
            np.minimum(new[e], start[e - 1], out=new[e])  # dropped
            np.minimum(new[e, 1:], start[e - 1, :-1], out=new[e, 1:])  # changed
            np.minimum(new[e, 1:], new[e - 1, :-1], out=new[e, 1:])  # added
        start = new
        spans = i - start.min(axis=1)
        fit = spans[(spans >= least) & (np.arange(most + 1) * one_in <= spans)]
        if len(fit):
            inside[i - int(fit.max()) : i] = True
    return int(inside.sum())


def judged(a: list[str], b: list[str], cover: float = COVER) -> tuple[int, int]:
    """(words of ``a`` that tiles cover, words of it in order); both 0 where the coverage is below the threshold."""
    found = tiles(a, b)
    covered = sum(n for _, _, n in found)
    if covered < cover * min(LEAST, len(a)):
        return 0, 0
    return covered, len(a) if found[0][2] == len(a) else in_order(a, b)  # one tile may be the whole passage


def _judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        got = [judged(p.split(" "), t.split(" ")) for p, t in zip(pdf["passage"], pdf["stretch"])]
        out = pdf[["item_id", "doc_id"]].assign(
            covered=[n for n, _ in got], n_words=[n for _, n in got], coverage=[n / len(p.split(" ")) for (n, _), p in zip(got, pdf["passage"])]
        )
        yield out[out["covered"] > 0]


def shared_seeds(documents: DataFrame, passages: DataFrame) -> DataFrame:
    """(doc_id, item_id, blocks): pairs that share enough seeds, and the blocks of the document where they stand."""
    n = F.size(F.split("passage", " "))
    enough = F.when(n >= 20, 6).otherwise(F.greatest(F.lit(1), n - 4 - 5 * F.floor(n / 10)))
    needles = passages.select("item_id", enough.alias("enough"), F.posexplode(seeds(F.col("passage"))).alias("place", "seed"))
    hay = with_words(documents.where(F.length("text") > 0).select("doc_id", "text"), "text", "_spoken")
    # Outer, since for the inner form the optimiser computes the whole normalisation once more to filter empty arrays.
    hay = hay.select("doc_id", F.posexplode_outer(seeds(F.col("_spoken"))).alias("at", "seed")).where("seed is not null")
    hits = hay.join(bounded(needles, MAX_SEEDS), "seed").groupBy("doc_id", "item_id", "enough", "place").agg(
        F.collect_set(F.floor(F.col("at") / BLOCK).cast("int")).alias("blocks")
    )
    pairs = hits.groupBy("doc_id", "item_id", "enough").agg(F.count(F.lit(1)).alias("n"), F.array_distinct(F.flatten(F.collect_list("blocks"))).alias("blocks"))
    return pairs.where("n >= enough").select("doc_id", "item_id", "blocks")


def leaks(documents: DataFrame, items: DataFrame) -> DataFrame:
    """(item_id, doc_id, covered, coverage, n_words, in_order): documents whose tiles cover enough of a passage.

    ``covered`` words stand in tiles, ``n_words`` of the passage in pieces that also keep its order."""
    passages = with_words(items.where("item_id is not null").select("item_id", "passage"), "passage", "passage")
    passages = materialize(passages, "passages").where("passage <> ''")
    pairs = materialize(shared_seeds(documents, passages), "pairs")
    wanted = bounded(pairs.join(passages, "item_id"), MAX_PAIRS)
    texts = documents.where(F.length("text") > 0).select("doc_id", "text").join(wanted, "doc_id")

    # A piece has at most 11 words for 10 of the passage, so one that has a seed in the block lies in the stretch.
    spoken = with_words(texts, "text", "_spoken").select("doc_id", "item_id", "passage", "blocks", F.split("_spoken", " ").alias("_words"))
    margin = F.ceil(F.size(F.split("passage", " ")) * 1.1).cast("int")

    def stretch(block: Column) -> Column:
        low = F.greatest(block * BLOCK - margin, F.lit(0))
        return F.array_join(F.slice("_words", low + 1, (block + 1) * BLOCK + SEED + margin - low), " ")

    parts = spoken.select("item_id", "doc_id", "passage", F.explode_outer(F.transform("blocks", stretch)).alias("stretch")).where("stretch is not null")
    found = parts.mapInPandas(_judge, f"item_id {dict(items.dtypes)['item_id']}, doc_id {dict(documents.dtypes)['doc_id']}, covered long, n_words long, coverage double")
    best = found.groupBy("item_id", "doc_id").agg(F.max("covered").alias("covered"), F.max("coverage").alias("coverage"), F.max("n_words").alias("n_words"))
    return best.withColumn("in_order", F.col("n_words") > 0)
