"""Near pairs of fingerprints, also where very many share their bits."""

import random

from gazeloom.operators import dedup


def pairs(spark, prints, **more):
    df = spark.createDataFrame([(x - (1 << 64) if x >= 1 << 63 else x, n) for n, x in enumerate(prints)], "simhash long, seq long")
    return sorted(map(tuple, dedup.near_pairs(df, 3, **more).collect()))


def brute(prints):
    return sorted((i, j) for i in range(len(prints)) for j in range(i + 1, len(prints)) if (prints[i] ^ prints[j]).bit_count() <= 3)


def flipped(r, x, n):
    for b in r.sample(range(64), n):
        x ^= 1 << b
    return x


def test_near_pairs(spark):
    r = random.Random(3)
    prints = [r.getrandbits(64) for _ in range(60)]
    prints = list(dict.fromkeys(prints + [flipped(r, r.choice(prints), r.randint(1, 5)) for _ in range(400)]))
    want = brute(prints)
    assert len(want) > 200
    assert pairs(spark, prints) == want
    for hot, block in ((8, 5), (2, 2), (1, 1000)):
        assert pairs(spark, prints, hot=hot, block=block) == want


def test_many_fingerprints_of_one_key(spark):
    """Twenty thousand fingerprints that share 40 bits, and so four keys: they are compared in blocks, and no near pair is lost."""
    r = random.Random(4)
    prints = list(dict.fromkeys((0xABCDEF0123 << 24) | r.getrandbits(24) for _ in range(20_000)))
    found = pairs(spark, prints)
    at = {x: n for n, x in enumerate(prints)}
    masks = [1 << a for a in range(24)]
    masks += [m | 1 << b for m in masks for b in range(m.bit_length(), 24)]
    masks += [m | 1 << c for m in masks[24:] for c in range(m.bit_length(), 24)]
    want = sorted({(min(n, at[x ^ m]), max(n, at[x ^ m])) for n, x in enumerate(prints[:200]) for m in masks if x ^ m in at})
    assert sorted(p for p in found if p[0] < 200 or p[1] < 200) == want
    assert dedup.near_pairs(spark.createDataFrame([], "simhash long, seq long"), 3).count() == 0


def test_keys_are_not_broadcast(spark, monkeypatch):
    """Each fingerprint has twenty keys, which Spark's estimate leaves out: the join of the keys must not broadcast them."""
    plans, stage = [], dedup.stage
    monkeypatch.setattr(dedup, "stage", lambda df, name: (plans.append((name, df._jdf.queryExecution().executedPlan().toString())), stage(df, name))[1])
    assert pairs(spark, [1, 3, 1 << 40 | 7 << 20]) == [(0, 1)]
    joins = [plan for name, plan in plans if name == "near-pairs"]
    assert joins and all("SortMergeJoin" in p and "BroadcastHashJoin" not in p for p in joins)
