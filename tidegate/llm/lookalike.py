"""One form for texts that look the same.

Characters are mapped by built-in expressions: width forms, blanks, joined letter forms and look-alike letters to
their plain counterparts, invisible characters to nothing. The mapped texts are grouped in SQL under the
accent-sensitive, case-sensitive Unicode collation: its classes, in which composed and combining accents are equal,
are the classes of equal-looking texts. Each gets a canonical member (its shortest text, the first of those in
binary order), joined back to all its documents.

The collation also equates characters that look different (digits of other scripts, circled and squared forms) and
ignores some visible marks. Which of the characters at hand it does so for is asked of the collation itself, and
these are shielded by private-use characters, which it tells apart, before texts are collated.

Only texts that can have a partner are grouped: documents are first reduced to hashes of their text and of its
accent-free skeleton, and whole texts are read again, once per distinct text, where one skeleton has several texts.

Defined cases: null and empty texts have no class and no row; equal stored texts share a class but are no pair of
different texts; a text of invisible characters only has the form ''; letter case, accents, raised digits and the
number of blanks are visible. A tab or line end is layout and not a kind of blank. Any other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata as U
from functools import lru_cache

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tidegate.scratch import materialize
from tidegate.sources.tables import bounded

COLLATION = "UNICODE"  # accent- and case-sensitive
MAX_BROADCAST = 200_000  # skeletons and first documents that are sent to every executor

# Letters of other scripts that look like a Latin letter, and that letter.
CYRILLIC = ("АВЕКМНОРСТУХІЈЅҮԌԚԜӀаеорсухіјѕһԁԛԝҽӏү", "ABEKMHOPCTYXIJSYGQWIaeopcyxijshdqwely")
GREEK = ("ΑΒΕΖΗΙΚΜΝΟΡΤΥΧοϲϳ", "ABEZHIKMNOPTYXocj")
ARMENIAN = ("Օօսհ", "Oouh")
# Vowels written before the consonant they follow, which the collation swaps with it.
PREFIXED_VOWELS = "เแโใไເແໂໃໄᦵᦶᦷᦺꪵꪶꪹꪻꪼ"
VISIBLE_FORMATS = ("ARABIC", "SYRIAC", "KAITHI", "EGYPTIAN", "SHORTHAND", "MUSICAL")


def _is_blank(c: str) -> bool:
    return c != " " and U.category(c) == "Zs"


def _is_invisible(c: str) -> bool:
    """Format characters, variation selectors, fillers, joiners and control characters that are not layout."""
    n, category = ord(c), U.category(c)
    if category == "Cf":
        return not U.name(c, "").startswith(VISIBLE_FORMATS)
    if category == "Cc":
        return c not in "\t\n\v\f\r\x85"
    return "VARIATION SELECTOR" in U.name(c, "") or "FILLER" in U.name(c, "") or n in (0x034F, 0x17B4, 0x17B5)


@lru_cache
def tables() -> tuple[dict[str, str], dict[str, str], dict[str, str]]:
    """(one character to one or none, one to several, composed letter to its bare base).

    Built by rule from the Unicode database: width forms and joined forms by their decomposition, blanks and
    invisible characters by category, composed look-alikes by their base.
    """
    letters = dict(zip(*CYRILLIC)) | dict(zip(*GREEK)) | dict(zip(*ARMENIAN))
    single, joined, bare = dict(letters), {}, {}
    for n in range(0x80, sys.maxunicode + 1):
        if 0xD800 <= n <= 0xDFFF or 0xAC00 <= n <= 0xD7A3 or 0xE000 <= n <= 0xF8FF or 0xF0000 <= n:
            continue
        c = chr(n)
        kind, _, rest = U.decomposition(c).partition(" ")
        if _is_blank(c):
            single[c] = " "
        elif _is_invisible(c):
            single[c] = ""
        elif kind in ("<wide>", "<narrow>"):
            single[c] = chr(int(rest, 16))
        elif kind == "<compat>" and (" LIGATURE " in U.name(c, "") or " DIGRAPH" in U.name(c, "")) and " " in rest:
            if n < 0x2000 or 0xFB00 <= n <= 0xFB17:
                joined[c] = U.normalize("NFKC", c)
        elif kind and not kind.startswith("<"):
            parts = U.normalize("NFD", c)
            if all(U.combining(x) for x in parts[1:]):
                base = letters.get(parts[0], parts[0])
                bare[c] = base
                whole = U.normalize("NFC", base + parts[1:])
                if base != parts[0] and len(whole) == 1:
                    single[c] = whole
                elif base != parts[0]:
                    joined[c] = whole
    single |= {chr(n): "" for n in range(0x80) if _is_invisible(chr(n))}
    return single, joined, bare


def _translate(text: Column, table: dict[str, str]) -> Column:
    kept = [k for k, v in table.items() if v]
    gone = [k for k, v in table.items() if not v]
    return F.translate(text, "".join(kept + gone), "".join(table[k] for k in kept))


PLAIN = r"\A[\x20-\x7e\t\n\r]*\z"


def _any_of(chars: list[str]) -> str:
    """Class of the characters, wider where that makes it short: it only decides what is looked at closer."""
    low, high = [c for c in chars if c < "\u1e00"], [c for c in chars if c >= "\u1e00"]
    return "[" + "".join(low) + (f"{min(high)}-{max(high)}" if high else "") + "]"


def _spread(text: Column) -> Column:
    """Composed look-alikes whose Latin counterpart has no composed form, written out as base and marks. They are rare
    and many, so the texts that have one leave the JVM instead of a chain of replacements running over all."""
    wide = {k: v for k, v in tables()[1].items() if not U.decomposition(k).startswith("<")}

    @F.pandas_udf(T.StringType())
    def write_out(texts: pd.Series) -> pd.Series:
        return texts.str.translate(str.maketrans(wide))

    has = ~text.rlike(PLAIN) & text.rlike(_any_of(list(wide)))
    return F.when(has, write_out(F.when(has, text))).otherwise(text)


def with_mapped(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: the text with look-alikes, width forms, blanks and joined forms made plain and invisible characters
    removed. One column per step, so that a step that names the text twice does not compute the steps before twice."""
    single, several, _ = tables()
    c = joined = F.col(out)
    forms = {k: v for k, v in several.items() if U.decomposition(k).startswith("<")}
    for form, letters in forms.items():
        joined = F.replace(joined, F.lit(form), F.lit(letters))
    df = df.withColumn(out, _spread(F.col(text_col)))
    df = df.withColumn(out, F.when(~c.rlike(PLAIN) & c.rlike(_any_of(list(forms))), joined).otherwise(c))
    return df.withColumn(out, F.when(c.rlike(PLAIN), c).otherwise(_translate(c, single)))


def with_skeleton(df: DataFrame, text_col: str, out: str) -> DataFrame:
    """Add ``out``: the mapped text without any accent, equal for texts that look the same, and for some others."""
    c = F.col(out)
    bare = F.regexp_replace(_translate(c, tables()[2]), r"\p{M}+", "")
    return with_mapped(df, text_col, out).withColumn(out, F.when(c.rlike(PLAIN), c).otherwise(bare))


def _normalized(text: Column, form: str) -> Column:
    """The text in a Unicode normal form; only texts with a combining mark leave the JVM."""

    @F.pandas_udf(T.StringType())
    def normal(texts: pd.Series) -> pd.Series:
        return texts.str.normalize(form)

    marked = text.rlike(r"\p{M}")
    return F.when(marked, normal(F.when(marked, text))).otherwise(text)


def shields(forms: DataFrame) -> dict[str, str]:
    """The characters of ``forms`` that the collation equates with another or ignores though they are visible, each
    with a private-use character of its own. There are no more rows here than characters in Unicode."""
    groups = forms.sparkSession.sql(
        r"""
        WITH chars AS (
          SELECT DISTINCT explode(regexp_extract_all(form, '[^\\x00-\\x7f]', 0)) AS c FROM {forms}
          UNION SELECT explode(split(:ascii, '')) AS c)
        SELECT collect_list(c) AS equal, collate(c, :collation) = '' AS ignored FROM chars GROUP BY collate(c, :collation)
        """,
        args={"ascii": "".join(map(chr, range(0x20, 0x7F))), "collation": COLLATION},
        forms=forms,
    ).collect()
    present = {c for g in groups for c in g.equal}
    apart = {c for g in groups if g.ignored or len({U.normalize("NFC", c) for c in g.equal}) > 1 for c in g.equal}
    apart |= present & set(PREFIXED_VOWELS)
    free = (chr(n) for n in range(0x100000, 0x10FFFE) if chr(n) not in present)
    return dict(zip(sorted(c for c in apart if c >= "\x80"), free))


def look_alikes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> tuple[DataFrame, DataFrame]:
    """(classes, hashes): ``classes`` (s0, s1, t0, t1, class_id, canonical) for every distinct text of a skeleton with
    several texts; ``hashes`` (id, s0, s1, t0, t1) for every document with a text. A class id is the smallest id of
    a document with one of its texts."""
    own = df.where(F.length(text_col) > 0).select(F.col(id_col).alias("id"), F.col(text_col).alias("_text"))
    text, bone = F.col("_text"), F.col("_bone")
    hashes = with_skeleton(own, "_text", "_bone").select(
        "id", F.xxhash64(bone).alias("s0"), F.xxhash64(F.lit(7), bone).alias("s1"), F.xxhash64(text).alias("t0"), F.xxhash64(F.lit(7), text).alias("t1")
    )
    hashes = materialize(hashes, "hashes")
    many = hashes.groupBy("s0", "s1").agg(F.min("t0").alias("a"), F.max("t0").alias("b"), F.min("t1").alias("c"), F.max("t1").alias("d"))
    many = bounded(materialize(many.where("a <> b or c <> d").select("s0", "s1"), "skeletons"), MAX_BROADCAST)
    first = hashes.join(many, ["s0", "s1"]).groupBy("s0", "s1", "t0", "t1").agg(F.min("id").alias("id"))
    first = bounded(materialize(first, "firsts"), MAX_BROADCAST)
    texts = with_mapped(own.join(first, "id"), "_text", "form").drop("_text")
    # Marks in canonical order, as the collation expects them; composing them is left to it.
    forms = materialize(texts.withColumn("form", _normalized(F.col("form"), "NFD")), "forms")
    seen = _translate(F.col("form"), shields(forms))
    return materialize(_collated(forms.withColumn("shielded", seen)), "classes"), hashes


def _collated(forms: DataFrame) -> DataFrame:
    """(s0, s1, t0, t1, class_id, canonical): the classes of the collation, each with its canonical member."""
    classes = forms.sparkSession.sql(
        """
        WITH members AS (SELECT *, collate(shielded, :collation) AS seen FROM {forms}),
        canonical AS (
          SELECT seen, min(id) AS class_id, min(struct(length(form), form)).form AS canonical FROM members GROUP BY seen)
        SELECT m.s0, m.s1, m.t0, m.t1, c.class_id, c.canonical FROM members m JOIN canonical c ON m.seen = c.seen
        """,
        args={"collation": COLLATION},
        forms=forms,
    )
    return classes.withColumn("canonical", _normalized(F.col("canonical"), "NFC"))


def look_alike_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_a, doc_b): documents whose stored texts differ and look the same.

    Distinct texts of a class are paired first and their documents joined to the pairs, so copies of one text are
    never compared with each other, however many there are."""
    classes, hashes = look_alikes(df, id_col, text_col)
    texts = classes.select("class_id", "s0", "s1", "t0", "t1")
    other = texts.withColumnsRenamed({"s0": "r0", "s1": "r1", "t0": "u0", "t1": "u1"})
    differ = texts.join(other, "class_id").where("t0 <> u0 or t1 <> u1").drop("class_id")
    left = hashes.withColumnRenamed("id", "doc_a")
    right = hashes.withColumnsRenamed({"id": "doc_b", "s0": "r0", "s1": "r1", "t0": "u0", "t1": "u1"})
    pairs = differ.join(left, ["s0", "s1", "t0", "t1"]).join(right, ["r0", "r1", "u0", "u1"])
    return pairs.where("doc_a < doc_b").select("doc_a", "doc_b")


def canonical_texts(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, class_id, canonical) of every document with a text; a text without look-alikes is its own class, in its
    own normal form. Equal stored texts have equal rows but for the id."""
    classes, hashes = look_alikes(df, id_col, text_col)
    alone = hashes.join(classes.select("s0", "s1").distinct(), ["s0", "s1"], "left_anti")
    grouped = hashes.join(classes, ["s0", "s1", "t0", "t1"]).select("id", "class_id", "canonical")
    firsts = alone.groupBy("s0", "s1", "t0", "t1").agg(F.min("id").alias("class_id"))
    singles = alone.join(firsts, ["s0", "s1", "t0", "t1"]).select("id", "class_id")
    texts = df.select(F.col(id_col).alias("id"), F.col(text_col).alias("_text")).join(singles, "id")
    plain = with_mapped(texts, "_text", "canonical").select("id", "class_id", _normalized(F.col("canonical"), "NFC").alias("canonical"))
    return grouped.unionByName(plain)
