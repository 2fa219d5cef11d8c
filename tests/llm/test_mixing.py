from __future__ import annotations

import random

from voxelake.llm.mixing import mix, mixture_shares, running_total

TARGETS = "source string, target_share double, max_repeats int"


def test_running_total(spark):
    rng = random.Random(3)
    data = [(rng.choice("ab"), rng.randint(0, 9), i, rng.randint(0, 5)) for i in range(500)]
    df = spark.createDataFrame(data, "s string, o int, i int, v int")
    got = {r.i: r.t for r in running_total(df, ["s", "o", "i"], "v", "t").collect()}
    total, want = 0, {}
    for s, o, i, v in sorted(data):
        total += v
        want[i] = total
    assert got == want


def make(spark, counts, size=(5, 15)):
    rng, data = random.Random(5), []
    for s, n in counts.items():
        data += [(len(data) + i, s, rng.randint(*size)) for i in range(n)]
    return spark.createDataFrame(data, "doc_id bigint, source string, tokens bigint"), data


def test_shares_and_caps(spark):
    sizes, data = make(spark, {"a": 2000, "b": 300, "c": 500, "other": 900, None: 50})
    targets = spark.createDataFrame([("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2), ("none", 0.1, 2), (None, 0.4, 1)], TARGETS)
    m = mix(sizes, targets)
    got = {r.doc_id: r for r in m.collect()}
    source = {d: (s, t) for d, s, t in data}
    assert all(source[d] == (r.source, r.tokens) for d, r in got.items()) and {r.source for r in got.values()} == {"a", "b", "c"}
    shares = {r.source: r for r in mixture_shares(m, sizes, targets).collect()}
    assert set(shares) == {"a", "b", "c", "none"} and shares["none"].used_tokens == 0
    total = sum(r.used_tokens for r in shares.values())
    for s, share, cap in (("a", 0.5, 1), ("b", 0.3, 3), ("c", 0.2, 2)):
        assert abs(shares[s].used_tokens - share * total) <= 2 * 15  # within a document each way
        assert shares[s].most_uses <= cap
        assert shares[s].used_tokens == sum(r.tokens * r.uses for r in got.values() if r.source == s)
        # a pass over a source is complete before any document is used again
        uses = [got[d].uses if d in got else 0 for d, (q, _) in source.items() if q == s]
        assert max(uses) - min(uses) <= 1
    # the total is the largest that the scarcest source allows
    have = {s: sum(t for _, q, t in data if q == s) for s in "abc"}
    best = min(have["a"] / 0.5, 3 * have["b"] / 0.3, 2 * have["c"] / 0.2)
    assert abs(total - best) <= 60
    half = {r.source: r.used_tokens for r in mixture_shares(mix(sizes, targets, budget=int(best / 2)), sizes, targets).collect()}
    assert best / 2 - 60 <= sum(half.values()) <= best / 2


def test_odd_input(spark):
    sizes = spark.createDataFrame([(1, "a", 0), (2, "a", 5), (2, "a", 5), (3, None, 7)], "doc_id bigint, source string, tokens bigint")
    targets = spark.createDataFrame([("a", 1.0, 2), ("z", -1.0, 2), ("y", 1.0, 0)], TARGETS)
    assert [tuple(r) for r in mix(sizes, targets).collect()] == [(2, "a", 10, 2)]
    assert mix(sizes.limit(0), targets).count() == 0
    assert mix(sizes, targets.limit(0)).count() == 0
