import random

from tidemark.llm import groups


def brute(pairs):
    root = {}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in pairs:
        if a is None or b is None or a == b:
            continue
        root.setdefault(a, a)
        root.setdefault(b, b)
        x, y = sorted((find(a), find(b)))
        root[y] = x
    return sorted((find(v), v) for v in root)


def run(spark, pairs):
    df = spark.createDataFrame(pairs, "a string, b string")
    return sorted((r.group_id, r.id) for r in groups.groups(df).select("group_id", "id").collect())


def test_empty_nulls_and_loops(spark):
    assert run(spark, []) == []
    assert run(spark, [("a", None), (None, "b"), ("c", "c")]) == []


def test_long_chain_stars_and_repeats(spark):
    names = [f"n{i:03d}" for i in range(150)]
    random.Random(1).shuffle(names)
    chain = list(zip(names, names[1:]))
    star = [("z", f"s{i}") for i in range(40)]
    small = [("p", "q"), ("q", "p"), ("q", "r"), ("x1", "x2")]
    pairs = chain + star + small + small
    assert run(spark, pairs) == brute(pairs)


def test_thin_giant_is_contracted(spark, monkeypatch):
    monkeypatch.setattr(groups, "LEVELS", 3)
    pairs = [("h", f"m{i}") for i in range(20)] + [("m3", "t0")] + [(f"t{i}", f"t{i + 1}") for i in range(30)] + [("t30", "a"), ("u", "v")]
    assert run(spark, pairs) == brute(pairs)


def test_random_graphs(spark):
    for seed in range(3):
        rng = random.Random(seed)
        pairs = [(f"v{rng.randrange(60)}", f"v{rng.randrange(60)}") for _ in range(45)]
        assert run(spark, pairs) == brute(pairs)


def test_key_pairs_null_keys_and_clashing_columns(spark):
    rows = spark.createDataFrame([("k", "r2", 1), ("k", "r1", 1), ("k", "r3", 2), (None, "r9", 3), (None, "r8", 3), ("l", "r4", 1)], "key string, rec string, n int")
    assert sorted(map(tuple, groups.key_pairs(rows, ["key"], "rec").select("a", "b").collect())) == [("r1", "r2"), ("r1", "r3")]
