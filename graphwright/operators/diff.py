"""Semantic differences of two graphs: (skill, category, change_type, value)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: predicate: (category, change if removed, change if added)
RULES = {
    "oc:resolvesIntent": ("intent", "breaking", "additive"),
    "oc:requiresState": ("requires_state", "breaking", "additive"),
    "oc:yieldsState": ("yields_state", "breaking", "additive"),
    "oc:hasRequirement": ("requirement", "additive", "breaking"),
    "oc:impartsKnowledge": ("knowledge", "cosmetic", "cosmetic"),
}


INTENT = "oc:resolvesIntent"


def _marked(old: DataFrame, new: DataFrame, *predicates: str) -> DataFrame:
    """(skill, p, value, mask, has): mask is 1 for a fact of the old graph, 2 for one of the new, 3 for one of both; has is the same for the skill,
    which is in a graph if it has an intent there. One shuffle, by skill, serves the aggregation and the window."""
    wanted = {*predicates, INTENT}
    side = lambda t, bit: t.where(F.col("p").isin(*wanted)).select(F.col("s").alias("skill"), "p", F.col("o").alias("value"), F.lit(bit).alias("side"))
    facts = side(old, 1).union(side(new, 2)).repartition("skill").groupBy("skill", "p", "value").agg(F.bit_or("side").alias("mask"))
    return facts.withColumn("has", F.bit_or(F.when(F.col("p") == INTENT, F.col("mask"))).over(Window.partitionBy("skill")))


def _values(marked: DataFrame, *predicates: str) -> DataFrame:
    category, lost, gained = (F.create_map(*[F.lit(x) for p, rule in RULES.items() for x in (p, rule[i])])[F.col("p")] for i in range(3))
    rows = marked.where((F.col("has") == 3) & (F.col("mask") < 3) & F.col("p").isin(*predicates))
    was = F.col("mask") == 1
    return rows.select("skill", category.alias("category"), F.when(was, lost).otherwise(gained).alias("change_type"), F.when(was, "removed").otherwise("added").alias("action"), "value")


def _whole(marked: DataFrame) -> DataFrame:
    rows = marked.where("has < 3").select("skill", "has").distinct()
    gone = F.col("has") == 1
    return rows.select("skill", F.lit("skill").alias("category"), F.when(gone, "breaking").otherwise("additive").alias("change_type"), F.when(gone, "removed").otherwise("added").alias("action"), F.col("skill").alias("value"))


def skill_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """Skills (subjects with intents) that are gone, which breaks, and that are new."""
    return _whole(_marked(old, new))


def value_changes(old: DataFrame, new: DataFrame, *predicates: str) -> DataFrame:
    """Values that skills of both graphs have lost or gained, of some predicates or of all in RULES."""
    wanted = predicates or tuple(RULES)
    return _values(_marked(old, new, *wanted), *wanted)


def compute_diff(old: DataFrame, new: DataFrame) -> DataFrame:
    """All changes."""
    marked = _marked(old, new, *RULES)
    return _whole(marked).union(_values(marked, *RULES))


#: Breaking changes that call for a migration: its name, by category and action; the pattern that finds who is affected; what to do. %1$s is the value as a term or text, %2$s the skill.
MIGRATIONS: dict[tuple[str, str], tuple[str, str, str]] = {
    ("skill", "removed"): ("skill-removed", "{ ?s oc:dependsOnSkill %1$s } UNION { ?s oc:dependsOn %1$s }", "Nothing is %1$s any more: point what depends on it to a skill with the same intents, or drop the dependency."),
    ("intent", "removed"): ("intent-renamed", '?s oc:resolvesIntent "%1$s"', "%2$s no longer resolves '%1$s': ask for one of its other intents, or for a skill that still has this one."),
    ("requires_state", "removed"): ("state-removed", "?s oc:requiresState %1$s", "%2$s no longer waits for %1$s: plan without it, and check what used to come before."),
    ("yields_state", "removed"): ("state-removed", "?s oc:requiresState %1$s", "%2$s no longer leads to %1$s: find another producer for the skills that require it."),
    ("requirement", "added"): ("requirement-added", "?s oc:hasRequirement %1$s", "%2$s now needs %1$s: have it ready wherever the skill runs."),
}


def suggestions(changes: DataFrame) -> DataFrame:
    """What to do about each breaking change: its kind of migration, a query for what it affects, and advice."""
    table = F.create_map(*[x for (category, action), texts in MIGRATIONS.items() for x in (F.lit(f"{category} {action}"), F.array(*map(F.lit, texts)))])
    texts = table[F.concat_ws(" ", "category", "action")]
    broken = changes.where("change_type = 'breaking'").withColumn("_texts", texts).where("_texts is not null")
    told = lambda i: F.replace(F.replace(F.col("_texts")[i], F.lit("%1$s"), F.col("value")), F.lit("%2$s"), F.col("skill"))
    pattern = F.concat(F.lit("SELECT ?s WHERE { "), told(1), F.lit(" }"))
    return broken.select(*changes.columns, F.col("_texts")[0].alias("migration"), pattern.alias("query"), told(2).alias("suggestion"))


def summary(changes: DataFrame) -> DataFrame:
    """How many changes there are of each type."""
    return changes.groupBy("change_type").agg(F.count("*").alias("n"))
