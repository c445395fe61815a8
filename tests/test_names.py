import random

from propspark.operators import names as N


def brute(names, dims):
    """First of equal, dim within name, name within dim, over all pairs; empty texts equal each other only."""
    out = {}
    for a in names:
        met = []
        for b, i in dims:
            if a is None or b is None or (a == "") != (b == ""):
                continue
            if a == b or b in a or a in b:
                met.append((0 if a == b else 1 if b in a else 2, i))
        if met:
            out[a] = min(met)[1]
    return out


def test_substrings_equal_all_pairs(spark):
    rng = random.Random(3)
    word = lambda n: "".join(rng.choice("abc") for _ in range(n))
    names = [word(rng.randint(1, 12)) for _ in range(300)] + ["", None, "ab", "é", "zé z", "z" * 5000, "a"]
    dims = [(word(rng.randint(1, 9)), i) for i in range(150)] + [("", 900), (None, 901), ("é", 902), ("ab", 903), ("b", 904), ("zz", 905), ("ab", 3)]
    left = spark.createDataFrame([(a, k) for k, a in enumerate(names)], "name string, k int").repartition(3)
    dim = spark.createDataFrame(dims, "dim string, id int")
    got = N.fuzzy_match(left, dim, "name", "dim", "id").collect()
    want = brute(names, dims)
    assert {r["name"]: r["id"] for r in got} == want
    assert len(got) == sum(a in want for a in names)
    assert N.fuzzy_match(left.limit(0), dim, "name", "dim", "id").count() == 0 == N.fuzzy_match(left, dim.limit(0), "name", "dim", "id").count()


def test_no_name_is_held_against_all_others(spark):
    left = spark.createDataFrame([("the falcons team",)], "name string")
    dim = spark.createDataFrame([("falcons", 1)], "dim string, id int")
    plan = N.fuzzy_match(left, dim, "name", "dim", "id")._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "Cartesian" not in plan
