"""Plans for all skills at once, and shortest cycles, against brute force."""

import random

import pytest

from graphwright.operators import closure, planner

WIDE = "id string, qualified_id string, requires_state array<string>, yields_state array<string>, depends_on array<string>, contradicts array<string>"


def wide(spark, rows):
    return spark.createDataFrame([(i, f"p/{i}", needs, makes, [], []) for i, needs, makes in rows], WIDE)


def priced(spark, rows, had):
    costs, states = planner.least_costs(wide(spark, rows), spark.createDataFrame([(s,) for s in had], "state string"))
    return {r.id: r.cost for r in costs.collect()}, {r.state: (r.cost, r.producer) for r in states.collect()}


def brute(rows, had):
    states, costs = {s: (0, None) for s in had}, {}
    while True:
        new = {i: 1 + sum(states[s][0] for s in set(needs)) for i, needs, _ in rows if all(s in states for s in needs)}
        better = {}
        for i, _, makes in rows:
            for s in makes if i in new else ():
                if s not in had:
                    better[s] = min(better.get(s, (new[i], i)), (new[i], i))
        if new == costs and all(states.get(s) == v for s, v in better.items()):
            return costs, states
        costs, states = new, {s: (0, None) for s in had} | better


@pytest.mark.parametrize("seed", range(3))
def test_least_costs_are_brute_force(spark, seed):
    random.seed(seed)
    names = [f"s{i}" for i in range(12)]
    rows = [(f"k{i:02}", random.choices(names, k=random.randint(0, 3)) if i % 5 else [], random.choices(names[2:], k=random.randint(0, 2))) for i in range(25)]
    had = ["s0", "s1"]
    # a current state costs nothing even if a skill yields it
    assert priced(spark, rows, had) == brute(rows, had)


def test_least_costs_equal_single_plans(spark):
    """Where no step is shared, a plan's cost is its number of steps."""
    rows = [("a", [], ["A"]), ("b", ["A"], ["B"]), ("c", ["B", "X"], ["C"]), ("d", ["H"], ["X"]), ("e", ["C"], []), ("f", ["never"], ["Z"]), ("g", ["Z"], []), ("a2", ["B"], ["A"])]
    costs, states = priced(spark, rows, ["H"])
    single = planner.Skills([planner.Skill(i, f"p/{i}", needs, makes) for i, needs, makes in rows])
    for i, _, _ in rows:
        plan = planner.build(single, i, {"H"})
        assert (len(plan.steps) if not plan.unresolved else None) == costs.get(i)
    assert states["C"] == (4, "c") and states["A"] == (1, "a") and "Z" not in states


def test_costs_of_nothing(spark):
    assert priced(spark, [], ["H"]) == ({}, {"H": (0, None)})
    assert priced(spark, [("a", None, None), ("b", [], ["B", None, "B"])], []) == ({"a": 1, "b": 1}, {"B": (1, "b")})


def test_costs_that_double_stop_growing(spark):
    rows = [("k00", [], ["s00"])] + [(f"k{i:02}", [f"s{i - 1:02}", f"t{i - 1:02}"], [f"s{i:02}"]) for i in range(1, 6)] + [(f"l{i:02}", [f"s{i:02}"], [f"t{i:02}"]) for i in range(6)]
    costs, _ = priced(spark, rows, [])
    assert costs == brute(rows, [])[0] and costs["k05"] > 60


def brute_cycles(edges):
    nodes = {x for e in edges for x in e}
    reach = {n: set() for n in nodes}
    for n in nodes:
        left = [n]
        while left:
            for a, b in edges:
                if a == left[-1] and b not in reach[n]:
                    reach[n].add(b)
                    left.insert(0, b)
            left.pop()
    lengths = {}
    for n in nodes:
        if n in reach[n] and n == min(m for m in nodes if m in reach[n] and n in reach[m]):
            level, d = {n}, 0
            while d == 0 or n not in level:
                level, d = {b for a, b in edges if a in level}, d + 1
            lengths[n] = d
    return lengths


@pytest.mark.parametrize("seed", range(3))
def test_shortest_cycles(spark, seed):
    random.seed(seed)
    names = [f"n{i:02}" for i in range(14)]
    edges = {(random.choice(names), random.choice(names)) for _ in range(20 + 2 * seed)} | {("x", "x"), ("y1", "y2"), ("y2", "y3"), ("y3", "y1"), ("y2", "y1")}
    ways = {}
    for r in closure.shortest_cycles(spark.createDataFrame(sorted(edges), "src string, dst string")).collect():
        ways.setdefault(r.root, {})[r.n] = r.node
    assert {root: len(way) - 1 for root, way in ways.items()} == brute_cycles(edges)
    for root, way in ways.items():
        assert way[0] == way[len(way) - 1] == root and all((way[i], way[i + 1]) in edges for i in range(len(way) - 1))


def test_no_cycles(spark):
    for edges in ([("a", "b"), ("b", "c")], []):
        assert closure.shortest_cycles(spark.createDataFrame(edges, "src string, dst string")).collect() == []


def test_plan_makes_no_pairs_of_a_state(spark, monkeypatch):
    """Skills of two states that lead to each other: each round of a search keeps rows by semi-joins, and pairs no skill with another."""
    rows = [(f"k{i:02}", [f"oc:{i % 2}"], [f"oc:{(i + 1) % 2}"]) for i in range(40)] + [("goal", ["oc:0"], ["oc:G"]), ("start", ["oc:H"], ["oc:1"])]
    plans, keep = [], closure.stored
    for module in (closure, planner):
        monkeypatch.setattr(module, "stored", lambda df: plans.append(df._jdf.queryExecution().optimizedPlan().toString()) or keep(df))
    assert len(planner.reachable(wide(spark, rows), ["goal"], 4).known) == 42
    assert plans and not any("Join Inner" in x for x in plans)
    assert planner.reachable(wide(spark, rows), ["goal"], 1).known.keys() == {"goal", *(i for i, _, makes in rows if makes == ["oc:0"])}


def test_states_that_are_there_need_no_producers(spark):
    rows = [("goal", ["oc:A", "oc:B"], []), ("a", ["oc:X"], ["oc:A"]), ("x", [], ["oc:X"]), ("b", ["oc:A"], ["oc:B"])]
    skills = wide(spark, rows)
    assert planner.reachable(skills, ["goal"], 0, ["oc:A"]).known.keys() == {"goal", "b"}
    steps = lambda had: [s["skill_id"] for s in planner.evaluate(skills, had, skill_id="goal")["plan_steps"]]
    assert steps(["oc:A"]) == ["b", "goal"] and steps([]) == ["x", "a", "b", "goal"]
