import random

import pytest

from kgspark.operators import merging


def one_by_one(nodes, edges, merges):
    """The same with dictionaries, one merge after another."""
    aliases, into, came = {n: {*a} for n, (_, a) in nodes.items()}, {}, {n: set() for n in nodes}
    edges = {i: list(e) for i, e in edges.items()}
    for _, s, p in sorted((at, s, p) for p, s, at in merges):
        if s == p or s not in nodes or p not in nodes:
            continue
        aliases[p] |= aliases[s] | {nodes[s][0]}
        came[p] |= came[s] | {s}
        into[s] = p
        for e in edges.values():
            if e[0] == s and e[1] == s:
                e[:] = [p, p]
            elif e[0] == s and e[1] != p:
                e[0] = p
            elif e[1] == s and e[0] != p:
                e[1] = p
    return {n: (sorted(aliases[n]), into.get(n), n in came[n]) for n in nodes}, {i: tuple(e) for i, e in edges.items()}


@pytest.mark.parametrize("seed", range(3))
def test_merges_are_those_of_one_after_another(spark, seed):
    rng = random.Random(seed)
    names = [f"n{k}" for k in range(12 if seed else 40)]
    nodes = {n: (f"name {n}", [f"a{n}"] if rng.random() < 0.5 else []) for n in names}
    edges = {f"e{k}": (rng.choice(names), rng.choice(names)) for k in range(120)}
    if seed:
        merges = [(rng.choice([*names, "gone"]), rng.choice(names), t) for t in range(14)]
    else:  # a chain of 25, one in falling order, and a cycle
        merges = [(names[k + 1], names[k], k) for k in range(25)] + [(names[k + 1], names[k], 200 - k) for k in range(27, 33)] + [("n37", "n36", 300), ("n38", "n37", 301), ("n36", "n38", 302)]
    a, b = merging.merge_in_order(
        spark.createDataFrame([("c", n, *v) for n, v in nodes.items()], "case_id string, id string, name string, aliases array<string>"),
        spark.createDataFrame([("c", i, *e, 1.0) for i, e in edges.items()], "case_id string, id string, source_id string, target_id string, confidence double"),
        spark.createDataFrame([("c", *m) for m in merges], "case_id string, primary_id string, secondary_id string, at long"),
    )
    want, moved = one_by_one(nodes, edges, merges)
    assert {r.id: (r.aliases, r.merged_into, r.in_cycle) for r in a.collect()} == want
    assert {r.id: (r.source_id, r.target_id) for r in b.collect()} == moved
    assert seed or {n for n, v in want.items() if v[2]} == {"n36"}


def test_edges_of_a_chain_longer_than_a_row_of_it(spark):
    n = merging.AHEAD + 40
    names = [f"n{k:03}" for k in range(n)]
    nodes = {k: (k.upper(), []) for k in names}
    # One chain, then a pair of nodes that are merged both ways and on.
    merges = [(names[k + 1], names[k], k) for k in range(n - 4)] + [(names[n - 3], names[n - 2], 2 * n), (names[n - 2], names[n - 3], 2 * n + 1), (names[n - 1], names[n - 2], 2 * n + 2)]
    edges = {"long": (names[0], names[n - 5]), "near": (names[0], names[1]), "end": (names[3], names[n - 1]), "loop": (names[5], names[5]), "pair": (names[n - 2], names[n - 3])}
    rows = spark.createDataFrame([("c", *m) for m in merges], "case_id string, primary_id string, secondary_id string, at long")
    own = spark.createDataFrame([("c", k, *v) for k, v in nodes.items()], "case_id string, id string, name string, aliases array<string>")
    events = merging.merge_events(own, rows)
    assert {"n", "road", "more", "root", "back"} <= set(merging.chains(events).columns)
    moved = merging.merged_edges(spark.createDataFrame([("c", i, *e) for i, e in edges.items()], "case_id string, id string, source_id string, target_id string"), events)
    assert {r.id: (r.source_id, r.target_id) for r in moved.collect()} == one_by_one(nodes, edges, merges)[1]
