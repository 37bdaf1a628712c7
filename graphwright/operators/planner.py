"""Backward chaining over states: which skills to run, in order, to reach a goal.

A plan's search is bounded in depth and looks at the producers of the states it needs, so the graph's adjacency, not its texts, is what a
search needs. A search runs on the driver, as the answer to one request, over the part of the graph that a few rounds of joins
reach from its targets; what is collected is checked against MOST. `least_costs` plans for all skills at once, in rounds of joins, without a driver's search.
"""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphwright.functions.terms import BASE
from graphwright.sources.scratch import drop, stored

MAX_DEPTH = 10
#: Skills that one request may reach; more is an error, not a cut.
MOST = 1_000_000


@dataclass
class Skill:
    id: str
    qualified_id: str
    requires: list[str]
    yields: list[str]
    depends_on: list[str] = field(default_factory=list)
    contradicts: list[str] = field(default_factory=list)


@dataclass
class Plan:
    target: str
    steps: list[str] = field(default_factory=list)
    unresolved: set[str] = field(default_factory=set)

    @property
    def rank(self) -> tuple[int, int, str]:
        return len(self.unresolved), len(self.steps), self.target


class Skills:
    """Skills by id, and the ids of producers by state, in order of qualified ids."""

    def __init__(self, skills: list[Skill]):
        self.known = {s.id: s for s in skills}
        self.producers: dict[str, list[str]] = {}
        for s in sorted(skills, key=lambda s: s.qualified_id):
            for state in s.yields:
                self.producers.setdefault(state, []).append(s.id)


def depth_limit(depth: int) -> int:
    """0 is the most."""
    return min(depth or MAX_DEPTH, MAX_DEPTH)


def normalised_states(states: list[str], base: str = BASE) -> list[str]:
    """`oc:` terms and http(s) addresses as compact terms, sorted and distinct; anything else is an error."""
    out = set()
    for state in states:
        if not state.startswith(("oc:", "http://", "https://")):
            raise ValueError(f"not a state: {state!r}")
        out.add("oc:" + state[len(base) :] if state.startswith(base) else state)
    return sorted(out)


def build(skills: Skills, target: str, current: set[str], depth: int = 0) -> Plan:
    """The best plan for a skill from some states.

    For each required state that isn't there yet, its producers' plans are tried and the best is taken over, with what its steps yield: the one with
    the fewest unresolved states, then the fewest steps, then the first id. Producers already on the way are skipped. A skill at the limit of
    depth still runs; what it lacks is unresolved.
    """
    limit = depth_limit(depth)

    def plan_of(name: str, states: frozenset[str], level: int, way: frozenset[str]) -> Plan:
        skill, had, plan = skills.known[name], set(states), Plan(name)
        for state in skill.requires:
            if state in had:
                continue
            best: Plan | None = None
            if level < limit:
                for producer in skills.producers.get(state, ()):
                    if producer not in way:
                        tried = plan_of(producer, frozenset(had), level + 1, way | {producer})
                        best = tried if best is None or tried.rank < best.rank else best
            if best is not None:
                plan.unresolved |= best.unresolved
                for step in best.steps:
                    had.update(skills.known[step].yields)
                    if step not in plan.steps:
                        plan.steps.append(step)
            if state not in had:
                plan.unresolved.add(state)
        plan.steps.append(name)
        return plan

    return plan_of(target, frozenset(current), 0, frozenset([target]))


def reachable(skills_wide: DataFrame, targets: list[str], depth: int = 0, current: Iterable[str] = ()) -> Skills:
    """The skills that plans for some targets can use: those that paths of at most `depth` steps from a need to its producers reach. States that are there need no producer.

    Breadth first, from skills to the states they need and on to those that yield them. A state is asked for once, and no pair of a skill and a producer is made: a state of many skills on both sides
    would have their product.
    """
    wide, limit = stored(skills_wide.select("id", "qualified_id", "requires_state", "yields_state", "depends_on", "contradicts")), depth_limit(depth)
    needs = wide.select("id", F.explode("requires_state").alias("state"))
    makers = wide.select("id", F.explode("yields_state").alias("state"))
    spark = skills_wide.sparkSession
    asked = spark.createDataFrame([(s,) for s in sorted(set(current))], "state string")
    known = front = spark.createDataFrame([(t,) for t in sorted(set(targets))], "id string")
    for _ in range(limit):
        wanted = stored(needs.join(front, "id", "left_semi").select("state").distinct().join(asked, "state", "left_anti"))
        if wanted.isEmpty():
            break
        asked = asked.union(wanted)
        front = stored(makers.join(wanted, "state", "left_semi").select("id").distinct().join(known, "id", "left_anti"))
        known = known.union(front)
    rows = wide.join(known, "id", "left_semi").limit(MOST + 1).collect()
    if len(rows) > MOST:
        raise ValueError(f"the plan reaches over {MOST} skills")
    drop(wide)
    return Skills([Skill(r.id, r.qualified_id, sorted(r.requires_state), sorted(r.yields_state), list(r.depends_on), list(r.contradicts)) for r in rows])


#: Costs stop growing here, far beyond any plan that can be run.
UNPAYABLE = 10**15


def least_costs(skills_wide: DataFrame, current: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(id, cost) of the skills that can be run from some states (one column), and (state, cost, producer) of the states that can be had.

    A skill costs 1 and what each of its required states costs; a state that is there costs nothing, any other what its cheapest producer does, of equals the one with
    the least id. So shared steps count each time they are needed. Rounds are semi-naive: only skills are priced again that need a state which the last round made
    cheaper, and only such states go on; a cost only falls, so cycles end. Skills that lack a state for good have no row. A skill's repeated states count once.
    """
    needs = stored(skills_wide.select("id", F.explode(F.array_distinct("requires_state")).alias("state")).where("state is not null").distinct())
    makes = stored(skills_wide.select("id", F.explode(F.array_distinct("yields_state")).alias("state")).where("state is not null").distinct())
    number = needs.groupBy("id").agg(F.count("*").alias("n"))
    free = skills_wide.select("id").distinct().join(number, "id", "left_anti").select("id", F.lit(1).cast("long").alias("cost"))
    states = stored(current.toDF("state").distinct().select("state", F.lit(0).cast("long").alias("cost"), F.lit(None).cast("string").alias("producer")))
    priced, changed = stored(free), None
    while True:
        if changed is None:  # those that need nothing, and those that need what is there
            touched = needs.join(states.select("state"), "state", "left_semi").select("id").distinct()
        else:
            touched = needs.join(changed.select("state"), "state", "left_semi").select("id").distinct()
        paid = needs.join(touched, "id", "left_semi").join(states, "state").groupBy("id").agg(F.count("*").alias("have"), F.least(F.sum("cost") + 1, F.lit(UNPAYABLE)).alias("cost"))
        again = paid.join(number, "id").where("have = n").select("id", "cost")
        new = stored(again if changed is not None else again.union(priced))
        offers = makes.join(new, "id").groupBy("state").agg(F.min(F.struct("cost", "id")).alias("offer")).select("state", F.col("offer.cost").alias("cost"), F.col("offer.id").alias("producer"))
        better = offers.join(states.select("state", F.col("cost").alias("had"), F.col("producer").alias("by")), "state", "left")
        better = better.where("had is null or (by is not null and (cost < had or (cost = had and producer < by)))").select("state", "cost", "producer")
        changed = stored(better)
        last, priced = priced, stored(priced.join(new, "id", "left_anti").union(new))
        drop(last, new)
        if changed.isEmpty():
            return priced, states
        last, states = states, stored(states.join(changed.select("state"), "state", "left_anti").union(changed))
        drop(last)


def evaluate(skills_wide: DataFrame, current: list[str], intent: str | None = None, skill_id: str | None = None, depth: int = 0) -> dict:
    """Plans for an intent or a skill, exactly one of them, the best first: fewest unresolved, fewest steps, then by id.

    An unknown skill is an error (LookupError); an intent that nothing resolves gives a result without a recommendation.
    """
    if (intent is None) == (skill_id is None):
        raise ValueError("give an intent or a skill id, and not both")
    limit, states = depth_limit(depth), normalised_states(current)
    found = skills_wide.where(F.exists("intents", lambda i: F.lower(i) == intent.lower()) if intent is not None else F.col("id") == skill_id)
    targets = [r.id for r in found.select("id", "qualified_id").orderBy("qualified_id").collect()]
    if skill_id is not None and not targets:
        raise LookupError(f"unknown skill {skill_id!r}")
    out = {"intent": intent, "requested_skill": skill_id, "matching_skills": targets, "current_states": states}
    if not targets:
        return out | {"recommended_skill": None, "applicable": False, "required_states": [], "missing_states": [], "dependency_warnings": [], "conflict_warnings": [], "plan_steps": [], "reasoning_summary": f"No skills resolve intent '{intent}'."}
    skills = reachable(skills_wide, targets, limit, states)
    best = min((build(skills, t, set(states), limit) for t in dict.fromkeys(targets)), key=lambda p: p.rank)
    chosen, missing = skills.known[best.target], sorted(best.unresolved)
    begin = f"Evaluated {len(targets)} skills for intent '{intent}'." if intent is not None else f"Evaluated requested skill '{skill_id}'."
    why = f"but these states remain unresolved within depth {limit}: {', '.join(missing)}." if missing else f"because all required states can be satisfied within depth {limit}."
    return out | {
        "recommended_skill": best.target,
        "applicable": not missing,
        "required_states": sorted(chosen.requires),
        "missing_states": missing,
        "dependency_warnings": [f"Skill '{chosen.id}' declares dependencies on: {', '.join(chosen.depends_on)}"] if chosen.depends_on else [],
        "conflict_warnings": [f"Skill '{chosen.id}' contradicts '{c}'" for c in chosen.contradicts],
        "plan_steps": [{"skill_id": s, "purpose": f"Execute skill '{s}'", "requires_state": skills.known[s].requires, "yields_state": skills.known[s].yields} for s in best.steps],
        "reasoning_summary": f"{begin} Recommended '{best.target}' {why}",
    }


def direct_plans(skills_wide: DataFrame, current: list[str]) -> DataFrame:
    """(id, state, producer): for every skill and each state that it requires and that isn't there, the first producer, by id, that can run at once; null if
    there is none. Plans of depth one for all skills at the same time, by joins."""
    had = F.array(*map(F.lit, normalised_states(current)))
    needs = skills_wide.select("id", F.explode("requires_state").alias("state")).where(~F.array_contains(had, F.col("state")))
    ready = skills_wide.where(F.forall("requires_state", lambda s: F.array_contains(had, s))).select(F.col("id").alias("producer"), F.explode("yields_state").alias("state"))
    first = ready.groupBy("state").agg(F.min("producer").alias("producer"))
    return needs.join(first, "state", "left").select("id", "state", "producer")


def first_steps(skills_wide: DataFrame, current: list[str], rounds: int = MAX_DEPTH) -> DataFrame:
    """(id, depth): skills whose required states can all be had from some states in so many rounds: a set-based, forward form of planning.

    Each state gets the round that first yields it; a skill's is that of its latest state. A round looks only at skills that the states of the
    last one complete. Stops when nothing is new.
    """
    from graphwright.sources.scratch import stored

    spark = skills_wide.sparkSession
    needs = skills_wide.select("id", F.explode("requires_state").alias("state")).distinct()
    counts = skills_wide.select("id", F.size(F.array_distinct("requires_state")).alias("wanted"))
    yields = skills_wide.select("id", F.explode("yields_state").alias("state")).distinct()
    had = spark.createDataFrame([(s, 0) for s in normalised_states(current)], "state string, round int")
    done = None
    for depth in range(rounds + 1):
        met = needs.join(had, "state").groupBy("id").agg(F.count("*").alias("n"))
        able = counts.join(met, "id", "left").where(F.coalesce("n", F.lit(0)) == F.col("wanted")).select("id")
        new = able if done is None else able.join(done, "id", "left_anti")
        new = stored(new.select("id", F.lit(depth).alias("depth")))
        done = new if done is None else done.union(new)
        more = yields.join(new, "id").select("state").distinct().join(had, "state", "left_anti")
        had = stored(had.union(more.select("state", F.lit(depth + 1))))
        if new.isEmpty():
            break
    return done
