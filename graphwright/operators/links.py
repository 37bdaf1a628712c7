"""Links inferred between knowledge, sections and steps."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from graphwright.operators.closure import reached_from
from graphwright.operators.triples import facts
from graphwright.sources.scratch import stored

# Titles of sections that tell what to do instead.
ALTERNATIVES = ("correct", "recommended", "proper", "instead", "best practice", "right way", "should")


def _words(df: DataFrame, text: str, key: str) -> DataFrame:
    return df.select(key, *[c for c in df.columns if c not in (key, text)], F.explode(F.array_distinct(F.filter(F.split(F.lower(text), "[^\\p{L}\\p{N}_]+"), lambda w: w != ""))).alias("word"))


def best_sections(contexts: DataFrame, titles: DataFrame, least: int = 2) -> DataFrame:
    """(node, section, shared): for each context the title it shares most words with, if `least` or more; the first of equals.

    contexts: (node, scope, context); titles: (section, scope, title). Only titles of the same scope count, which the join on scope and word ensures.
    """
    a, b = _words(contexts, "context", "node"), _words(titles, "title", "section")
    shared = a.join(b, ["scope", "word"]).groupBy("node", "section").agg(F.countDistinct("word").alias("shared")).where(F.col("shared") >= least)
    order = Window.partitionBy("node").orderBy(F.desc("shared"), "section")
    return shared.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")


def derived_from_section(t: DataFrame) -> DataFrame:
    """(s, p, o): each knowledge node's section of its skill, at any depth, by the words of its context; nodes that have one already are left out."""
    nodes = facts(t, "oc:impartsKnowledge", "scope", "node").join(facts(t, "oc:appliesToContext", "node", "context"), "node")
    nodes = nodes.join(facts(t, "oc:derivedFromSection", "node", "x").select("node"), "node", "left_anti")
    sections = reached_from(facts(t, "oc:hasSubsection", "src", "dst"), facts(t, "oc:hasSection", "scope", "section")).toDF("scope", "section")
    titles = sections.join(facts(t, "oc:sectionTitle", "section", "title"), "section")
    return best_sections(nodes, titles).select(F.col("node").alias("s"), F.lit("oc:derivedFromSection").alias("p"), F.col("section").alias("o"))


#: The predicates that `correct_alternative` reads.
ALTERNATIVE_FACTS = ("rdf:type", "oc:correctAlternative", "oc:derivedFromSection", "oc:hasSection", "oc:hasSubsection", "oc:sectionTitle", "oc:hasContent")


def correct_alternative(t: DataFrame) -> DataFrame:
    """(s, p, o): an anti-pattern's only sibling section that tells what to do instead; else the only code example in its own section. Those that have an alternative already are left out.

    The facts it reads are stored once. Of a section's children that tell it three are looked at, which is enough to see whether a sibling of one of them is the only one; of a section's examples the
    first and the last. So a section of many notes and many children isn't paired with itself."""
    p, o = F.col("p"), F.col("o")
    t = stored(t.where(p.isin(*ALTERNATIVE_FACTS) & ((p != "rdf:type") | o.isin("oc:AntiPattern", "oc:CodeExample"))).select("s", "p", "o"))
    said = t.where((o == "oc:AntiPattern") & (p == "rdf:type") | (p == "oc:correctAlternative"))
    anti = said.groupBy(F.col("s").alias("node")).agg(F.max(p == "oc:correctAlternative").alias("has"), F.max(p == "rdf:type").alias("anti")).where("anti and not has").select("node")
    own = facts(t, "oc:derivedFromSection", "node", "section").join(anti, "node")
    parents = t.where(p.isin("oc:hasSection", "oc:hasSubsection")).select(F.col("s").alias("parent"), o.alias("section"))
    good = facts(t, "oc:sectionTitle", "other", "title").where(reduce(or_, [F.contains(F.lower("title"), F.lit(w)) for w in ALTERNATIVES])).select("other")
    kids = parents.withColumnRenamed("section", "other").join(good, "other").select("parent", "other").distinct()
    kids = kids.withColumn("i", F.row_number().over(Window.partitionBy("parent").orderBy("other"))).where("i <= 3").drop("i")
    only = lambda rows, least, last: rows.groupBy("node").agg(F.min(least).alias("o"), F.max(last).alias("last")).where("o = last").select("node", "o")
    first = only(own.join(parents, "section").select("node", "section", "parent").join(kids, "parent").where("other <> section"), "other", "other")
    code = facts(t, "rdf:type", "block", "kind").where("kind = 'oc:CodeExample'").select("block")
    examples = facts(t, "oc:hasContent", "section", "block").join(code, "block").groupBy("section").agg(F.min("block").alias("least"), F.max("block").alias("last"))
    second = only(own.join(examples, "section"), "least", "last").join(first, "node", "left_anti")
    return first.union(second).select(F.col("node").alias("s"), F.lit("oc:correctAlternative").alias("p"), "o")


# How a context names a step by number.
STEP_NUMBER = "(?i)step\\s+(\\d+)|#(\\d+)|(\\d+)(?:st|nd|rd|th)\\s+step"


def applies_to_step(t: DataFrame) -> DataFrame:
    """(s, p, o): the step that a node's context names (`step 2`, `#2`, `2nd step`): of the numbers in the order in which they stand, the first that
    is the order of exactly one workflow step of the graph; else the one step whose label stands in the context. Nodes that have a step already are left out. Each graph
    of the table, as a module is one, has its own steps."""
    of = lambda p, s, o: t.where(F.col("p") == p).select(F.coalesce("graph_id", F.lit("")).alias("graph"), F.col("s").alias(s), F.col("o").alias(o))
    has = facts(t, "oc:appliesToStep", "node", "x").select("node")
    nodes = of("oc:impartsKnowledge", "skill", "node").select("graph", "node").distinct().join(facts(t, "oc:appliesToContext", "node", "context"), "node").join(has, "node", "left_anti")
    nodes = nodes.groupBy("graph", "node").agg(F.min("context").alias("context"))
    steps = of("rdf:type", "step", "kind").where("kind = 'oc:WorkflowStep'").select("graph", "step").distinct()
    orders = steps.join(of("oc:stepOrder", "step", "number"), ["graph", "step"]).select("graph", "step", F.col("number").try_cast("int").alias("number"))
    unique = orders.groupBy("graph", "number").agg(F.countDistinct("step").alias("n"), F.min("step").alias("o")).where("n = 1 and number is not null").select("graph", "number", "o")
    found = nodes.select("graph", "node", F.posexplode(F.regexp_extract_all("context", F.lit(STEP_NUMBER), F.lit(0))).alias("at", "text"))
    found = found.select("graph", "node", "at", F.regexp_extract("text", "\\d+", 0).try_cast("int").alias("number"))
    by_number = found.join(unique, ["graph", "number"]).groupBy("graph", "node").agg(F.min_by("o", "at").alias("o"))
    labels = steps.join(of("oc:stepLabel", "step", "label"), ["graph", "step"]).where("label <> ''").select("graph", "step", F.lower("label").alias("label"))
    labels = labels.groupBy("graph", "label").agg(F.min("step").alias("first"), F.max("step").alias("last"))
    # where the first letters of labels stand in a context, what stands there in the lengths of those labels is joined to whole labels
    lengths = labels.groupBy("graph", F.substring("label", 1, 3).alias("start")).agg(F.collect_set(F.length("label")).alias("lengths"))
    letters = lambda n: F.transform(F.sequence(F.lit(1), F.length("context")), lambda i: F.struct(F.substr("context", i, F.lit(n)).alias("start"), i.alias("i")))
    spelled = nodes.where("context <> ''").join(by_number, ["graph", "node"], "left_anti").withColumn("context", F.lower("context"))
    places = spelled.select("graph", "node", "context", F.inline(F.array_distinct(F.concat(letters(1), letters(2), letters(3))))).join(lengths, ["graph", "start"])
    words = places.select("graph", "node", F.explode(F.transform("lengths", lambda n: F.substr("context", F.col("i"), n))).alias("label")).distinct()
    both = words.join(labels, ["graph", "label"])
    by_label = both.groupBy("graph", "node").agg(F.min("first").alias("o"), F.max("last").alias("last")).where("o = last")
    return by_number.union(by_label.select("graph", "node", "o")).select(F.col("node").alias("s"), F.lit("oc:appliesToStep").alias("p"), "o").distinct()


def infer_links(t: DataFrame) -> DataFrame:
    """All three kinds, each seeing what the ones before it found."""
    found = derived_from_section(t)
    as_triples = lambda x: x.select(F.lit(None).cast("string").alias("graph_id"), "s", F.lit("iri").alias("s_kind"), "p", "o", F.lit("iri").alias("o_kind"), F.lit(None).cast("string").alias("o_dt"), F.lit(None).cast("string").alias("o_lang"))
    wider = t.unionByName(as_triples(found))
    return found.union(correct_alternative(wider)).union(applies_to_step(wider))
