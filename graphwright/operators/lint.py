"""Checks of a skill graph and of skill documents, as tables of issues (severity, code, skill_id, detail)."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphwright.functions.terms import local_name
from graphwright.operators.closure import on_cycles, shortest_cycles
from graphwright.operators.triples import facts

# Words in an intent that mark a way in.
ENTRY_WORDS = ("create", "import", "load", "init", "start", "open", "new")
# Words and phrases in the first or second person.
PERSON = ("I", "I'm", "I'll", "I've", "me", "my", "mine", "we", "our", "You can", "You should", "Your")
WORD, EDGE = "[\\p{L}\\p{N}_]", "[^\\p{L}\\p{N}_]"
MOST_LINES = 500


def _issues(rows: DataFrame, severity: str, code: str, skill: Column, detail: Column) -> DataFrame:
    return rows.select(F.lit(severity).alias("severity"), F.lit(code).alias("code"), skill.alias("skill_id"), detail.alias("detail")).distinct()


def dead_states(t: DataFrame) -> DataFrame:
    """A required state that nothing yields: one issue for each state and skill."""
    rows = facts(t, "oc:requiresState", "skill", "state").join(facts(t, "oc:yieldsState", "x", "state").select("state"), "state", "left_anti")
    return _issues(rows, "warning", "dead-state", local_name(F.col("skill")), local_name(F.col("state")))


def unreachable(t: DataFrame) -> DataFrame:
    """As dead states, but of skills without an intent that marks a way in."""
    ways_in = facts(t, "oc:resolvesIntent", "skill", "intent").where(F.lower("intent").rlike("|".join(ENTRY_WORDS))).select("skill")
    rows = facts(t, "oc:requiresState", "skill", "state").join(facts(t, "oc:yieldsState", "x", "state").select("state"), "state", "left_anti").join(ways_in, "skill", "left_anti")
    return _issues(rows, "warning", "unreachable-state", local_name(F.col("skill")), local_name(F.col("state")))


def circular(t: DataFrame) -> DataFrame:
    """Every skill on a cycle of dependsOnSkill."""
    rows = on_cycles(facts(t, "oc:dependsOnSkill", "src", "dst"))
    return _issues(rows, "error", "circular-dep", local_name(F.col("node")), local_name(F.col("node")))


def duplicate_intents(t: DataFrame) -> DataFrame:
    """Every skill whose intent another has too; the detail is the intent and how many have it.

    The others aren't listed: an intent that a third of all skills share would make a list of them for each.
    """
    uses = facts(t, "oc:resolvesIntent", "skill", "intent").distinct()
    shared = uses.groupBy("intent").agg(F.count("*").alias("n")).where("n > 1")
    return _issues(uses.join(shared, "intent"), "error", "duplicate-intent", local_name(F.col("skill")), F.concat_ws(":", "intent", F.col("n").cast("string")))


def workflow_cycles(t: DataFrame) -> DataFrame:
    """A circle of steps in a skill's workflow, `a -> b -> a`: the shortest through the least step of each set of steps that need each other. A step names what it depends on by its node or by its id."""
    owners = facts(t, "oc:hasWorkflow", "skill", "workflow").join(facts(t, "dcterms:identifier", "skill", "name"), "skill", "left")
    owners = owners.groupBy("workflow").agg(F.min(F.coalesce("name", local_name(F.col("skill")))).alias("skill"))
    steps = facts(t, "oc:hasStep", "workflow", "step")
    named = steps.join(facts(t, "oc:stepId", "step", "id"), "step")
    needs = named.join(facts(t, "oc:stepDependsOn", "step", "need"), "step").select("workflow", F.col("step").alias("src"), "need")
    by_node = needs.join(named.select("workflow", F.col("step").alias("need")), ["workflow", "need"], "left_semi").select("src", F.col("need").alias("dst"))
    by_id = needs.join(named.select("workflow", F.col("id").alias("need"), F.col("step").alias("dst")), ["workflow", "need"]).select("src", "dst")
    ways = shortest_cycles(by_node.union(by_id)).withColumnRenamed("node", "step").join(named, "step")
    ways = ways.groupBy("workflow", "root").agg(F.array_sort(F.collect_list(F.struct("n", "id"))).alias("way"))
    rows = ways.join(owners, "workflow", "left")
    return _issues(rows, "error", "workflow-cycle", F.coalesce("skill", local_name(F.col("workflow"))), F.array_join("way.id", " -> "))


def person_pattern(phrase: str) -> str:
    """A phrase as a whole, in any case of ASCII letters; for Java and RE2 alike."""
    return f"(?i)(^|{EDGE}){phrase}($|{EDGE})"


def third_person(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Texts in the first or second person: the phrases found, in any case of letters and as whole words, in the order of PERSON."""
    text = F.col(text_column)
    # one pass finds whole phrases, the longest at each place; what they have within them is there too
    longest = "|".join(sorted(PERSON, key=len, reverse=True))
    whole = f"(?i)(?:^|{EDGE})({longest})(?!{WORD})"
    places = {q.lower(): [i for i, p in enumerate(PERSON, 1) if re.search(rf"(?i)(?<!\w){p}(?!\w)", q)] for q in PERSON}
    of = F.create_map(*[x for q, at in places.items() for x in (F.lit(q), F.array(*map(F.lit, at)))])
    at = F.array_sort(F.array_distinct(F.flatten(F.transform(F.regexp_extract_all(text, F.lit(whole), F.lit(1)), lambda m: of[F.lower(m)]))))
    found = F.transform(at, lambda i: F.element_at(F.array(*map(F.lit, PERSON)), i))
    rows = docs.where(text.rlike(whole)).select(F.col(id_column).cast("string").alias("id"), found.alias("found"))
    return _issues(rows, "warning", "third-person", F.col("id"), F.array_join("found", ","))


def body_length(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text", most: int = MOST_LINES) -> DataFrame:
    """Texts of more than `most` lines after their front matter."""
    body = F.regexp_replace(text_column, "^---\\n(?s:.*?)\\n---\\n", "")
    rows = docs.withColumn("n", F.size(F.split(body, "\n"))).where(F.col("n") > most)
    return _issues(rows, "warning", "body-length", F.col(id_column).cast("string"), F.col("n").cast("string"))


def reference_depth(paths: DataFrame, id_column: str, path_column: str, most: int = 1) -> DataFrame:
    """Paths with more than `most` slashes."""
    depth = F.length(path_column) - F.length(F.replace(F.col(path_column), F.lit("/"), F.lit("")))
    rows = paths.withColumn("n", depth).where(F.col("n") > most)
    return _issues(rows, "info", "reference-depth", F.col(id_column).cast("string"), F.col("n").cast("string"))


def lint(t: DataFrame) -> DataFrame:
    """All checks of a graph."""
    out = dead_states(t)
    for check in (circular, duplicate_intents, unreachable, workflow_cycles):
        out = out.unionByName(check(t))
    return out


def failed(issues: DataFrame) -> bool:
    """Whether there is an error, which makes a run fail."""
    return not issues.where("severity = 'error'").isEmpty()
