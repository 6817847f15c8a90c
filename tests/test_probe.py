"""The probe that gives up hopeless sets makes the choice that trying everything makes."""

import random

from tallyglass.operators import matching


def test_probe_equals_a_search_of_everything(spark):
    r = random.Random(6)
    sets = [(f"s{i}", k, r.random() < 0.7) for i in range(7) for k in r.sample(range(200), r.choice([5, 40, 90]))]
    sets += [("twin", k, x) for s, k, x in sets if s == "s2"]  # a tie, but for the name
    counts = []
    for g in range(12):
        base = [k for s, k, _ in sets if s == f"s{g % 7}"] if g % 2 else list(range(200))
        counts += [(f"g{g}", k, r.choice([1, 2, 30, 400])) for k in r.sample(base, min(len(base), r.choice([3, 25, 80])))]
    counts += [("strange", 1000 + k, 5 if k else 1000) for k in range(20)]
    known = {}
    for s, k, x in sets:
        known.setdefault(s, {})[k] = x
    asked = []

    def near(keys, have):
        asked.append({x["key"] for x in keys.collect()})
        beside = keys.selectExpr("key", "explode(array(key - 1, key + 1)) as _k")
        return beside.join(have.withColumnRenamed("key", "_k"), "_k").select("key", "name", "readable")

    got = {x["track"]: tuple(x)[1:] for x in matching.probe(spark.createDataFrame(counts, "track string, key long, n long"), spark.createDataFrame(sets, "name string, key long, readable boolean"), "track", "name", "key", near, 400, (50_000, 5_000, 0)).collect()}
    want = {}
    for g in {c[0] for c in counts}:
        mine = {k: n for t, k, n in counts if t == g}
        total, found = sum(mine.values()), []
        for s, have in known.items():
            exact = sum(n for k, n in mine.items() if k in have)
            beside = {k: any(have.get(j, False) for j in (k - 1, k + 1)) for k in mine if k not in have and (k - 1 in have or k + 1 in have)}
            covered = exact + sum(mine[k] for k in beside)
            reads = sum(n for k, n in mine.items() if have.get(k)) + sum(mine[k] for k, x in beside.items() if x)
            if 1000 * covered >= 400 * total:
                found.append((-covered, -reads, -exact, s))
        b = min(found, default=None)
        want[g] = (b[3], -b[0], -b[1], -b[2], total) if b else (None, 0, 0, 0, total)
    assert got == want and sum(x[0] is None for x in want.values()) >= 1 and sum(x[0] is not None for x in want.values()) >= 3
    untried = {k for _, k, _ in counts} - set().union(*asked)
    assert len(asked) == 3 and untried  # keys of tracks without a hope left aren't searched
