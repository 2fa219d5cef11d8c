"""Texts that look the same brought to the same characters: script-aware repair.

Width, presentation forms, invisible characters, kinds of blanks, dashes and apostrophes are folded
first. Then every token gets its dominant script; look-alike letters of other scripts are replaced
only in tokens of mixed script, and only where the corpus vocabulary holds the result.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from voxelake.session import cut_lineage

#: Letters that look like a Latin one, by script.
CYRILLIC_LATIN = dict(zip("аеорсухіѕјһԁԛԝӧӓӱАВЕКМНОРСТХІЅЈУӦӒЁё", "aeopcyxisjhdqwöäÿABEKMHOPCTXISJYÖÄËë", strict=True))
GREEK_LATIN = dict(zip("οαινρυκγχτΑΒΕΖΗΙΚΜΝΟΡΤΥΧϊΪΫ", "oaivpukyxtABEZHIKMNOPTYXïÏŸ", strict=True))
#: Kana and ideographs of one look, and kana of both syllabaries of one look.
KATAKANA_HAN = dict(zip("ニロカエハタトオーム", "二口力工八夕卜才一厶", strict=True))
KATAKANA_HIRAGANA = dict(zip("ヘベペリ", "へべぺり", strict=True))
_APOSTROPHES, _DASHES = "’ʼ＇", "‐‑‒–﹣－"
_SPLIT = re.compile(r"([\^= ]+)")


def _reverse(d: dict[str, str]) -> dict[str, str]:
    return {v: k for k, v in reversed(d.items())}


#: (from script, to script) -> letters
LIKE = {
    ("CYRILLIC", "LATIN"): CYRILLIC_LATIN,
    ("GREEK", "LATIN"): GREEK_LATIN,
    ("LATIN", "CYRILLIC"): _reverse(CYRILLIC_LATIN),
    ("LATIN", "GREEK"): _reverse(GREEK_LATIN),
    ("CYRILLIC", "GREEK"): {k: _reverse(GREEK_LATIN)[v] for k, v in CYRILLIC_LATIN.items() if v in _reverse(GREEK_LATIN)},
    ("GREEK", "CYRILLIC"): {k: _reverse(CYRILLIC_LATIN)[v] for k, v in GREEK_LATIN.items() if v in _reverse(CYRILLIC_LATIN)},
    ("KATAKANA", "CJK"): KATAKANA_HAN,
    ("CJK", "KATAKANA"): _reverse(KATAKANA_HAN),
    ("KATAKANA", "HIRAGANA"): KATAKANA_HIRAGANA,
    ("HIRAGANA", "KATAKANA"): _reverse(KATAKANA_HIRAGANA),
}


@lru_cache(20_000)
def script(ch: str) -> str:
    """The script of a letter; empty for everything else."""
    if ch == "ー":
        return "KATAKANA"
    if unicodedata.category(ch)[0] != "L":
        return ""
    return unicodedata.name(ch, "?").split()[0].split("-")[0]


@lru_cache(20_000)
def _fold(ch: str) -> str:
    """One character folded: nothing for invisible ones, the plain one for forms of width and shape."""
    o, kind = ord(ch), unicodedata.category(ch)
    if kind == "Cf" or o == 0x34F or 0xFE00 <= o <= 0xFE0F or 0xE0100 <= o <= 0xE01EF or o in (0x115F, 0x1160, 0x3164, 0xFFA0, 0x17B4, 0x17B5, 0x180B, 0x180C, 0x180D):
        return ""
    if kind == "Zs":
        return " "
    if ch in _APOSTROPHES:
        return "'"
    if ch in _DASHES:
        return "-"
    form = unicodedata.decomposition(ch).split(" ")[0]
    if form in ("<wide>", "<narrow>", "<small>") or 0x2E80 <= o < 0x2FE0 or 0xFB00 <= o < 0xFB07 or 0xF900 <= o < 0xFB00:
        return unicodedata.normalize("NFKC", ch)
    return ch


def fold(text: str) -> str:
    """Width, shape, invisible characters, blanks, dashes and composition folded; blanks at the
    ends dropped. Case and accents stay."""
    if text.isascii():
        return text.strip(" ")
    t = unicodedata.normalize("NFC", "".join(map(_fold, unicodedata.normalize("NFC", text))))
    return unicodedata.normalize("NFC", "".join(map(_fold, t))).strip(" ")


def substituted(token: str, around: Counter) -> str | None:
    """The token in its dominant script, or None where it has but one script or can't be so written.

    around: letters per script of the whole text; it breaks ties, and a token wholly of look-alikes
    from another script than its text's counts as mixed with it.
    """
    own = Counter(s for c in token if (s := script(c)))
    if not own:
        return None
    chief = max(own, key=lambda s: (own[s], around[s], s))
    if len(own) == 1:
        main = max(around, key=lambda s: (around[s], s))
        if main == chief or (chief, main) not in LIKE or chief in ("KATAKANA", "CJK", "HIRAGANA"):
            return None
        chief = main
    for target in dict.fromkeys((chief, *sorted(own, key=lambda s: (-own[s], -around[s], s)))):
        out = []
        for c in token:
            s = script(c)
            out.append(c if not s or s == target else LIKE.get((s, target), {}).get(c))
        if None not in out:
            return "".join(out)
        if {"CJK", "KATAKANA"} <= own.keys() or {"CJK", "HIRAGANA"} <= own.keys():  # lawfully mixed: replace what can be
            part = "".join(o or c for o, c in zip(out, token, strict=True))
            if part != token:
                return part
    return None


def analyse(text: str) -> tuple[str, list[str], list[str | None]]:
    """(folded text, its tokens and separators in turn, per token its substitution or None)."""
    folded = fold(text)
    parts = _SPLIT.split(folded)
    if folded.isascii():
        return folded, parts, [None] * len(parts)
    around = Counter(s for c in folded if (s := script(c)))
    return folded, parts, [None if i % 2 else substituted(p, around) for i, p in enumerate(parts)]


def canonical_texts(names: DataFrame, *, components: tuple[str, ...] = ("alphabetic", "ideographic")) -> DataFrame:
    """(component, text, canonical): each distinct text of the components in its one form.

    The vocabulary is every token of one script in the whole corpus, of the same component, and
    every result that at least two different mixed tokens lead to (the corpus may hold a name in mixed
    spellings only). Texts are made distinct before anything else is shuffled, so copies of one text,
    however many, cost one row; each is analysed once and the analysis written to the shared folder. Null texts have no
    row; empty texts stay empty. Whole texts are treated, whatever their length.
    """
    stacked = names.select(F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("text")) for c in components))).alias("x"))
    texts = stacked.select("x.component", "x.text").where("text IS NOT NULL").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            folded, parts, subs = [], [], []
            for t in batch.column(1).to_pylist():
                f, p, s = analyse(t)
                folded.append(f)
                parts.append(p)
                subs.append(s if any(s) else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(1), pa.array(folded, pa.string()), pa.array(parts, pa.list_(pa.string())), pa.array(subs, pa.list_(pa.string()))],
                names=["component", "text", "folded", "parts", "subs"],
            )

    read = cut_lineage(texts.mapInArrow(run, "component string, text string, folded string, parts array<string>, subs array<string>"))
    mixed = read.where("subs IS NOT NULL")
    proposals = (
        mixed.select("component", F.explode(F.arrays_zip("parts", "subs")).alias("p"))
        .select("component", F.col("p.parts").alias("token"), F.col("p.subs").alias("result"))
        .where("result IS NOT NULL")
        .distinct()
    )
    plain = (
        read.select("component", F.explode(F.arrays_zip("parts", F.coalesce("subs", F.transform("parts", lambda _: F.lit(None).cast("string")))).alias("p")).alias("p"))
        .toDF("component", "p")
        .where(F.col("p").getField("1").isNull())
        .select("component", F.col("p.parts").alias("result"))
        .distinct()
    )
    twice = proposals.groupBy("component", "result").agg(F.count("*").alias("n")).where("n > 1").select("component", "result")
    known = proposals.join(plain.union(twice).distinct().hint("merge"), ["component", "result"], "left_semi")
    placed = mixed.select("component", "text", F.posexplode("parts").alias("at", "token"))
    repaired = (
        placed.join(known.hint("merge"), ["component", "token"], "left")
        .groupBy("component", "text")
        .agg(F.sort_array(F.collect_list(F.struct("at", F.coalesce("result", "token").alias("token")))).alias("ps"))
        .select("component", "text", F.array_join(F.transform("ps", lambda p: p["token"]), "").alias("canonical"))
    )
    return read.where("subs IS NULL").select("component", "text", F.col("folded").alias("canonical")).unionByName(repaired)


def unify(names: DataFrame, *, key: str = "name_id", components: tuple[str, ...] = ("alphabetic", "ideographic")) -> DataFrame:
    """`key` and each component in canonical form; null stays null."""
    canon = canonical_texts(names, components=components)
    out = names.select(key, *components)
    for c in components:
        one = canon.where(F.col("component") == c).select(F.col("text").alias(c), F.col("canonical").alias(f"__{c}"))
        out = out.join(one.hint("merge"), c, "left")
    return out.select(key, *(F.col(f"__{c}").alias(c) for c in components))


def look_alike_pairs(names: DataFrame, *, key: str = "name_id", components: tuple[str, ...] = ("alphabetic", "ideographic")) -> DataFrame:
    """Pairs (smaller key first) of rows with a component that looks the same but differs in code points.

    Pairs are found between distinct texts of one canonical form, then carried to the rows that
    hold them, so copies of one text meet only through texts that differ.
    """
    canon = cut_lineage(canonical_texts(names, components=components))
    x, y = (canon.select("component", "canonical", F.col("text").alias(f"text_{n}")) for n in "ab")
    pairs = x.join(y.hint("merge"), ["component", "canonical"]).where("text_a < text_b").select("component", "text_a", "text_b")
    stacked = names.select(key, F.explode(F.array(*(F.struct(F.lit(c).alias("component"), F.col(c).alias("text")) for c in components))).alias("x"))
    rows = stacked.where(f"x.text IS NOT NULL AND {key} IS NOT NULL").select(key, "x.component", "x.text")
    a = rows.select(F.col(key).alias("a"), "component", F.col("text").alias("text_a"))
    b = rows.select(F.col(key).alias("b"), "component", F.col("text").alias("text_b"))
    met = pairs.join(a.hint("merge"), ["component", "text_a"]).join(b.hint("merge"), ["component", "text_b"]).where("a <> b")
    return met.select(F.least("a", "b").alias(f"{key}_a"), F.greatest("a", "b").alias(f"{key}_b")).distinct()
