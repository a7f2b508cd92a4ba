"""The driver holds no table that grows with the data: joins of sides above SMALL_ROWS rows are shuffled."""

import random

from cloakwork.llm import _shared, simhash


def test_large_sides_are_not_broadcast(spark, monkeypatch):
    rng, plans = random.Random(5), []

    def recorded(df, name):
        plans.append((name, df._jdf.queryExecution().executedPlan().toString()))
        return _shared.stored(df, name)

    monkeypatch.setattr(simhash, "stored", recorded)
    monkeypatch.setattr(_shared, "SMALL_ROWS", -1)
    fps = [rng.getrandbits(64) for _ in range(20)]
    for k in range(20):  # chains, and pairs two components apart
        fps.append(fps[k] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
        fps.append(fps[-1] ^ (1 << rng.randrange(64)) ^ (1 << rng.randrange(64)))
    signed = [f - (1 << 64) if f >> 63 else f for f in dict.fromkeys(fps)]
    root = {f: f for f in signed}

    def find(f):
        while root[f] != f:
            f = root[f]
        return f

    for f in signed:
        for g in signed:
            if ((f ^ g) & (1 << 64) - 1).bit_count() <= 3:
                root[find(f)] = find(g)
    nodes = spark.createDataFrame([(f, k) for k, f in enumerate(signed)], "fp bigint, id bigint")
    named = simhash.named_components(nodes, simhash.roots(nodes.select("fp")))
    plans.append(("named", named._jdf.queryExecution().executedPlan().toString()))
    least = {}
    for k, f in enumerate(signed):
        least[find(f)] = min(least.get(find(f), k), k)
    assert {r.fp: r.component_id for r in named.collect()} == {f: least[find(f)] for f in signed}
    assert [name for name, p in plans if "BroadcastHashJoin" in p] == []
