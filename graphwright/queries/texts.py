"""Queries that SQL can't express, or that run on fixture texts."""

from __future__ import annotations

from pyspark.sql import functions as F

from graphwright.operators import catalog, planner, render
from graphwright.queries.graph import query, skills, table
from graphwright.sources import markdown
from graphwright.sources import star_graph as sg
from graphwright.sources.scratch import stored


def as_markdown(spark, sf_dir):
    """Pages as Markdown: headings of their HTML, and under each a paragraph of the page's address."""
    heads = markdown.html_headings(table(spark, sf_dir, "pages"))
    lines = heads.groupBy("page_id").agg(F.array_sort(F.collect_list(F.struct("n", "level", "title"))).alias("h"))
    text = F.array_join(F.transform("h", lambda x: F.concat(F.repeat(F.lit("#"), x["level"]), F.lit(" "), x["title"], F.lit("\n\npara "), x["n"].cast("string"), F.lit("\n"))), "\n")
    return lines.select(F.col("page_id").alias("doc_id"), text.alias("text"))


@query()
def md_blocks(spark, sf_dir):
    """Blocks of pages turned to Markdown."""
    return markdown.blocks(as_markdown(spark, sf_dir)).drop("variables")


@query()
def md_sections(spark, sf_dir):
    """Their section trees."""
    return markdown.sections(markdown.blocks(as_markdown(spark, sf_dir)))


@query()
def md_coverage(spark, sf_dir):
    """Lines of documents that blocks cover."""
    docs = table(spark, sf_dir, "documents")
    return markdown.coverage(docs, markdown.blocks(docs))


@query()
def html_sections(spark, sf_dir):
    """Headings of pages."""
    return markdown.html_headings(table(spark, sf_dir, "pages"))


_EVEN = [0, 2, 4, 6, 8]


def _even_states(brand: int) -> list[str]:
    return [f"oc:S_Brand_{brand}_{n}" for n in _EVEN]


@query(""", had AS (SELECT 'oc:S_Brand_' || b || '_' || n AS state FROM range(1, 26) r(b), (VALUES (0), (2), (4), (6), (8)) v(n)),
first AS (SELECT yields AS state, min(id) AS producer FROM k WHERE requires IN (SELECT state FROM had) GROUP BY yields)
SELECT id, requires AS state, producer FROM k LEFT JOIN first ON first.state = requires WHERE requires NOT IN (SELECT state FROM had)""")
def plan_direct(spark, sf_dir):
    """For every skill each state missing, and the skill to run for it."""
    return planner.direct_plans(skills(spark, sf_dir), [s for b in range(1, 26) for s in _even_states(b)])


@query(""", me AS (SELECT * FROM k WHERE id = 'part-7'), had AS (SELECT replace(requires, regexp_extract(requires, '[0-9]+$'), '') || n AS state FROM me, (VALUES (0), (2), (4), (6), (8)) v(n)),
maker AS (SELECT min(id) AS id FROM k WHERE yields = (SELECT requires FROM me) AND requires IN (SELECT state FROM had) AND id <> 'part-7')
SELECT CAST(row_number() OVER (ORDER BY o) - 1 AS INTEGER) AS n, step, (SELECT requires IN (SELECT state FROM had) OR maker.id IS NOT NULL FROM me, maker) AS applicable FROM (
  SELECT 0 AS o, maker.id AS step FROM maker, me WHERE me.requires NOT IN (SELECT state FROM had) AND maker.id IS NOT NULL UNION ALL SELECT 1, id FROM me)""")
def plan_bounded(spark, sf_dir):
    """A plan for one skill, with the default depth, from the even states of its brand; a row for each step."""
    t = sg.old_graph(spark, sf_dir).where(F.col("p").isin("dcterms:identifier", "oc:nature", "oc:inPackage", "oc:requiresState", "oc:yieldsState", "oc:dependsOnSkill", "oc:contradicts"))
    wide = stored(catalog.skills(t).select("id", "qualified_id", "requires_state", "yields_state", "depends_on", "contradicts"))
    brand = wide.where("id = 'part-7'").first().requires_state[0].split("_")[2]
    plan = planner.evaluate(wide, _even_states(brand), skill_id="part-7")
    return spark.createDataFrame([(i, s["skill_id"], plan["applicable"]) for i, s in enumerate(plan["plan_steps"])], "n int, step string, applicable boolean")


_WANTS = ", wants AS (SELECT id, requires AS state FROM k UNION SELECT id, regexp_replace(requires, '[0-9]+$', '') || ((p_size + 7) % 12) FROM k WHERE p_partkey % 3 = 0), numbers AS (SELECT id, count(*) AS n FROM wants GROUP BY id)"
_WANTS += ", s0 AS MATERIALIZED (SELECT 'oc:S_Brand_' || b || '_' || n AS state, 0::HUGEINT AS cost, NULL::VARCHAR AS producer FROM range(1, 26) r(b), (VALUES (0), (5)) v(n))"
for _i in range(1, 16):
    _WANTS += f""", k{_i} AS MATERIALIZED (SELECT id, sum(cost) + 1 AS cost FROM wants JOIN s{_i - 1} USING (state) JOIN numbers USING (id) GROUP BY id, n HAVING count(*) = n),
s{_i} AS MATERIALIZED (SELECT * FROM s0 UNION ALL SELECT yields, min(k{_i}.cost), min(struct_pack(c := k{_i}.cost, i := k.id)).i FROM k{_i} JOIN k USING (id) WHERE yields NOT IN (SELECT state FROM s0) GROUP BY yields)"""


@query(_WANTS + " SELECT id, requires AS state, CAST(coalesce(k15.cost, -1) AS BIGINT) AS cost, s15.producer FROM k LEFT JOIN k15 USING (id) LEFT JOIN s15 ON s15.state = requires")
def plan_costs(spark, sf_dir):
    """What each skill costs from two states of each brand, -1 if it can't be run, and who yields its first state most cheaply; every third skill needs another state too."""
    size, brand = F.col("p_size"), F.regexp_replace("p_brand", "#", "_")
    other = table(spark, sf_dir, "part").where("p_partkey % 3 = 0").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.concat(F.lit("oc:S_"), brand, F.lit("_"), ((size + 7) % 12).cast("string")).alias("more"))
    wide = skills(spark, sf_dir).join(other, "id", "left")
    first = F.col("requires_state")[0]
    wide = wide.select("id", first.alias("state"), F.when(F.col("more").isNull(), F.col("requires_state")).otherwise(F.concat("requires_state", F.array("more"))).alias("requires_state"), "yields_state")
    had = spark.createDataFrame([(f"oc:S_Brand_{b}_{n}",) for b in range(1, 26) for n in (0, 5)], "state string")
    costs, states = planner.least_costs(wide, had)
    return wide.select("id", "state").join(costs, "id", "left").join(states.select("state", "producer"), "state", "left").select("id", "state", F.coalesce("cost", F.lit(-1).cast("long")).alias("cost"), "producer")


@query(""", had(state, depth) AS (SELECT 'oc:S_Brand_' || b || '_0', 0 FROM range(1, 26) r(b) UNION SELECT yields, depth + 1 FROM had JOIN k ON requires = state WHERE depth < 10)
SELECT id, CAST(min(depth) AS INTEGER) AS depth FROM had JOIN k ON requires = state GROUP BY id""")
def plan_forward(spark, sf_dir):
    """When each skill can run, from the first state of each brand."""
    return planner.first_steps(skills(spark, sf_dir), [f"oc:S_Brand_{b}_0" for b in range(1, 26)])


@query(""", n AS (SELECT count(*) AS n FROM part),
kn AS (SELECT doc_id % n AS p_partkey, 'oc:kn_' || doc_id AS node, doc_id % 5 AS kind, source, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'CRITICAL' WHEN quality = 0 THEN 'HIGH' ELSE 'LOW' END AS severity FROM documents LEFT JOIN labels l USING (doc_id), n),
told AS (SELECT *, sum(strlen(text) + 80) OVER (PARTITION BY p_partkey ORDER BY CASE kind WHEN 4 THEN 0 WHEN 1 THEN 3 ELSE 99 END, node) AS used, row_number() OVER (PARTITION BY p_partkey ORDER BY CASE kind WHEN 4 THEN 0 WHEN 1 THEN 3 ELSE 99 END, node) AS place FROM kn WHERE text <> ''),
lines AS (SELECT p_partkey, string_agg('  ' || ['STANDARD', 'HEURISTIC', 'KNOWN ISSUE', 'SIDE EFFECT', 'PROCEDURE'][kind + 1] || CASE WHEN source <> '' THEN ' (' || source || ')' ELSE '' END || CASE WHEN severity IN ('CRITICAL', 'HIGH') THEN ' [' || severity || ']' ELSE '' END || ':' || chr(10) || '  ' || text, chr(10) ORDER BY place) AS body FROM told WHERE used <= 12000 GROUP BY p_partkey)
SELECT s AS uri, '## ' || id || chr(10) || 'Intents: ' || (SELECT string_agg(intent, '; ' ORDER BY intent) FROM intents i WHERE i.p_partkey = k.p_partkey) || chr(10) || 'Requires: ' || p_brand
  || CASE WHEN k.p_partkey IN (SELECT p_partkey FROM told) THEN chr(10) || coalesce(chr(10) || body, '') ELSE '' END AS text FROM k LEFT JOIN lines USING (p_partkey)""")
def ctx_compact(spark, sf_dir):
    """Each skill's context as text within the budget: intents, requirements and its own knowledge."""
    t = sg.graph(spark, sf_dir)
    needs = catalog.requirements(t).groupBy("uri").agg(F.array_sort(F.collect_set("value")).alias("requirements"))
    heads = catalog.skills(t).join(needs, "uri", "left").select("uri", "id", "genus", "differentia", "intents", "requirements")
    return render.contexts(heads, catalog.knowledge(t, inherited=False))
