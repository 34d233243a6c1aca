"""The pipeline's near duplicates: what the pigeonhole finds is in its groups, and sets are exchanged no more than needed."""

import random

from sigmaspark.llm import simhash


def _family(n: int, words: int, changes: int, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    base = [f"w{r.randrange(10**6)}" for _ in range(words)]
    out = []
    for _ in range(n):
        own = [*base]
        for _ in range(changes):
            own[r.randrange(words)] = f"x{r.randrange(10**6)}"
        out.append(" ".join(own))
    return out


def test_the_pigeonhole_comes_first(spark, monkeypatch):
    texts = _family(12, 2000, 1) + _family(40, 120, 0, seed=5)[:1] + _family(3, 300, 300, seed=7)
    allocated, linked = [], []
    allocate, compare = simhash.allocate, simhash._linked
    monkeypatch.setattr(simhash, "allocate", lambda *a: allocated.append(allocate(*a)) or allocated[-1])
    monkeypatch.setattr(simhash, "_linked", lambda *a: linked.append((a[0].collect(), compare(*a))) or linked[-1][1])
    kept = simhash.drop_near_duplicates(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()
    assert sorted(x.doc_id for x in kept) == [0, 12, 13, 14, 15]
    assert len(allocated) == 1 and allocated[0]
    # its pairs are compared, and their sets decide
    assert linked[0][0] and linked[0][1].count()


def test_linked_by_bits_but_not_similar(spark):
    """Two nodes of one fingerprint are paired, and stay apart if their shingles differ."""
    nodes = spark.createDataFrame([(1, [5, 0]), (2, [5, 9]), (3, [4, 0]), (4, [-1, 0])], "node long, fp array<long>")
    assert sorted(map(tuple, simhash._within(nodes).collect())) in ([(1, 3), (2, 1)], [(2, 1), (3, 1)])
    sets = spark.createDataFrame([(1, [1, 2, 3]), (2, [4, 5, 6]), (3, [1, 2, 3, 7])], "node long, hashes array<long>")
    assert [sorted(x) for x in simhash._linked(simhash._within(nodes), sets, 0.7).collect()] == [[1, 3]]


def test_few_pairs_leave_the_first_sets_at_home(spark):
    sets = spark.range(100).selectExpr("id as node", "array(id, id + 1) as hashes")
    pairs = spark.createDataFrame([(n, n % 3) for n in range(3, 60)], "a long, b long")
    both = simhash._with_sets(pairs, sets)
    assert sorted((r.a, r.b, r.x[0], r.y[1]) for r in both.collect()) == [(n, n % 3, n, n % 3 + 1) for n in range(3, 60)]
    plan = both._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(a#" not in plan
