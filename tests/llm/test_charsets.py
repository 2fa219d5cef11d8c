from __future__ import annotations

import pickle
import random

from voxelake.llm.charsets import count_bigrams, damage, from_bytes, label, plausible, repair, restore, states, to_bytes, train, trained_models, wrongly_decoded

FAMILIES = ["Müller", "Castaño", "Brontë", "Lefèvre", "Hernández", "Gómez", "Straßer", "Açores", "Novák", "Piñeiro", "Sørensen", "Zoëga"]
PLAIN = ["Miller", "Baker", "Smith", "Weber", "Klein", "Moreau", "Rossi", "Novotny", "Larsen", "Hughes"]
GIVEN = ["José", "Renée", "Anna", "Peter", "Jörg", "Inés", "Robert", "Susan", "Zoë", "Agnès", "Lucía", "Thomas"]


def names(n, seed):
    rng = random.Random(seed)
    return [f"{rng.choice(FAMILIES + PLAIN)}{rng.choice(['', 'dorf', 'ton', 'ez', 'ard'])}^{rng.choice(GIVEN)}" for _ in range(n)]


def test_transforms_round_trip():
    for r, w in states():
        for t in ("Müller^José", "Иванов^Пётр", "Παπάς^Νίκος", "山田^太郎", "박^민우"):
            d = damage(t, r, w)
            if d is not None and d != t and r != "lost" and "�" not in d:
                assert restore(d, r, w) == t, (r, w, t)
    assert from_bytes(b"\x81", "cp1252") == "\x81" and to_bytes("\x81é", "cp1252") == b"\x81\xe9" and to_bytes("中", "cp1252") is None


def test_held_out_names():
    """Trained on one set of names with a tenth damaged, tried on another."""
    rng = random.Random(1)
    some = [("utf-8", "latin-1"), ("utf-8", "cp1252"), ("utf-8*2", "cp1252"), ("utf-8", "iso8859-2"), ("lost", "?")]

    def mixture(seed):
        out = []
        for t in names(1500, seed):
            d = damage(t, *rng.choice(some)) if rng.random() < 0.1 else None
            out.append((d, t, True) if d and d != t else (t, t, False))
        return out

    train_set, test_set = mixture(2), mixture(3)
    model = train(sorted({t for t, _, _ in train_set}), "alphabetic")
    texts = [t for t, _, _ in test_set]
    hits = wrong = missed = restored = 0
    for (text, orig, bad), f in zip(test_set, label(model, texts), strict=True):
        found = repair(model, text, f) if f.any() else None
        hits += bool(found) and bad
        wrong += bool(found) and not bad
        missed += not found and bad
        restored += bool(found) and found[0] == orig
    assert missed <= 0.03 * (hits + missed) and wrong <= 0.03 * hits, (hits, wrong, missed)
    assert restored >= 0.7 * hits


def test_tables(spark):
    clean = [(i, t, None, None, "x") for i, t in enumerate(names(400, 5))]
    more = [(900, damage("Müllerdorf^José", "utf-8", "latin-1"), None, None, "x"), (901, None, None, None, "x"), (902, "", "", "", "x"), (None, damage("Gómezton^Inés", "utf-8", "latin-1"), None, None, "x")]
    more += [(903, "Baker^" + "Anna " * 20_000, None, None, "x")]
    df = spark.createDataFrame(clean + more, "name_id bigint, alphabetic string, ideographic string, phonetic string, component string")
    got = sorted(((r.name_id, r.component, r.restored) for r in wrongly_decoded(df).collect()), key=repr)
    assert got == [(900, "alphabetic", "Müllerdorf^José"), (None, "alphabetic", "Gómezton^Inés")]
    assert wrongly_decoded(df.limit(0)).count() == 0


def test_all_texts_train(spark):
    """Every distinct text counts, in whatever task it is, and only once; so a letter counts that no
    sample of a few thousand texts holds often enough."""
    texts = [f"Weber{a}{b}^Anna {c}" for a in "abcdefghijklmnop" for b in "aeiou" for c in ["Maria", "Susan", "Peter", *(f"Jo{x}" for x in "abcdefghijklmnopqrstuvwxyzäöü" * 2)]]
    texts = sorted({*texts, *(f"Ła{x}" for x in "bcdfghjk"), *(damage(f"Jörg{x}^José", "utf-8", "latin-1") for x in "abcdefgh")})
    df = spark.createDataFrame([(i, t) for i, t in enumerate([*texts, *texts])], "name_id bigint, alphabetic string").repartition(7)
    got, want = pickle.loads(trained_models(df, ("alphabetic",))["alphabetic"]), train(texts, "alphabetic")
    assert got.symbols == want.symbols and "Ł" in got.symbols
    assert abs(got.start - want.start).max() < 1e-9
    seen = [("a", "\x03"), ("\x02", "Ł"), ("Ł", "a"), ("A", "ö"), ("ö", "a"), ("Ã", "\xb6")]
    assert max(abs(got.emission(*p) - want.emission(*p)).max() for p in seen) < 1e-5
    ends = sum(n for b, n in count_bigrams([t for t in texts if plausible(t, "alphabetic")], "alphabetic")[0].items() if b[1] == "\x03")
    assert len(texts) > 2000 and ends >= len(texts) - 8
