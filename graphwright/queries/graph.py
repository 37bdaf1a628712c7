"""Queries over the derived skill graph and over the tables, each with the SQL that DuckDB runs on the same tables."""

from __future__ import annotations

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


from graphwright.functions import terms
from graphwright.operators import bench, catalog, diff, graphs, impacts, lint, nearest, search
from graphwright.operators.closure import closure
from graphwright.operators.triples import facts, star, store
from graphwright.sources import star_graph as sg
from graphwright.sources.scratch import fresh, sized_at_run_time, spread, stored

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}

#: The skills as SQL sees them.
SKILLS = """
k AS (SELECT *, 'oc:skill_' || p_partkey AS s, 'part-' || p_partkey AS id,
  ['official', 'local', 'verified', 'community'][p_partkey % 4 + 1] AS tier,
  CASE WHEN p_size % 2 = 0 THEN 'executable' ELSE 'declarative' END AS skill_type,
  'oc:S_' || replace(p_brand, '#', '_') || '_' || (p_size % 12) AS requires,
  'oc:S_' || replace(p_brand, '#', '_') || '_' || ((p_size + 1) % 10) AS yields,
  'oc:req_' || (p_size % 3) || '_' || replace(p_brand, '#', '_') AS requirement,
  p_brand || '/part-' || p_partkey AS qualified_id FROM part),
intents AS (SELECT DISTINCT p_partkey, s, id, unnest(string_split(p_name, ' ')) AS intent FROM k),
deps AS (SELECT s AS src, 'oc:skill_' || (CASE WHEN p_partkey % 20 < 5 THEN p_partkey - p_partkey % 5 + (p_partkey + 1) % 5 ELSE p_partkey - 1 END) AS dst FROM k),
ups AS (SELECT s AS src, 'oc:skill_' || (p_partkey // 2) AS dst FROM k WHERE p_partkey > 0)"""


def query(sql: str | None = None, skills: bool = True):
    """Register a query under its function's name, with its SQL."""

    def keep(f):
        QUERIES[f.__name__] = wraps(f)(lambda spark, sf_dir: f(sized_at_run_time(spark), sf_dir))
        if sql:
            ORACLE_SQL[f.__name__] = (f"WITH RECURSIVE {SKILLS} {sql}" if skills else sql)
        return f

    return keep


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return spread(rows, "p_partkey") if name == "part" else rows


def skills(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.skills(sg.old_graph(spark, sf_dir))


# --- patterns ---------------------------------------------------------------------------------------------


@query("SELECT s, id AS identifier, p_name AS nature, p_type AS category FROM k")
def sp_bgp_star(spark, sf_dir):
    """A star of three patterns on one subject: one aggregation."""
    t = sg.old_graph(spark, sf_dir)
    return star(t, ["dcterms:identifier", "oc:nature", "oc:hasCategory"]).where("identifier is not null and nature is not null and hasCategory is not null").select("s", "identifier", "nature", F.col("hasCategory").alias("category"))


@query("SELECT s, id AS identifier, dst AS parent FROM k LEFT JOIN ups ON src = s")
def sp_optional(spark, sf_dir):
    """An identifier, and a parent where there is one."""
    t = sg.old_graph(spark, sf_dir)
    return facts(t, "dcterms:identifier", "s", "identifier").join(facts(t, "oc:extends", "s", "parent"), "s", "left").select("s", "identifier", "parent")


@query("SELECT s, requires AS state, 'requires' AS role FROM k UNION ALL SELECT s, yields, 'yields' FROM k")
def sp_union(spark, sf_dir):
    """Two patterns, each with a constant bound."""
    t = sg.old_graph(spark, sf_dir)
    return facts(t, "oc:requiresState", "s", "state").withColumn("role", F.lit("requires")).union(facts(t, "oc:yieldsState", "s", "state").withColumn("role", F.lit("yields")))


@query("SELECT s, p_type AS category FROM k WHERE p_type IN ('ECONOMY', 'PROMO') AND tier <> 'community'")
def sp_filter_in(spark, sf_dir):
    """Filters on objects reach the scan."""
    t = sg.old_graph(spark, sf_dir)
    some = facts(t, "oc:hasCategory", "s", "category").where(F.col("category").isin("ECONOMY", "PROMO"))
    return some.join(facts(t, "oc:trustTier", "s", "tier").where("tier <> 'community'"), "s", "left_semi").select("s", "category")


@query("SELECT intent, CAST(count(*) AS BIGINT) AS n FROM intents GROUP BY intent")
def sp_count_group(spark, sf_dir):
    """How many skills resolve each intent."""
    return facts(sg.old_graph(spark, sf_dir), "oc:resolvesIntent", "s", "intent").groupBy("intent").agg(F.count("*").alias("n"))


@query("SELECT DISTINCT requires AS state FROM k ORDER BY state LIMIT 50")
def sp_distinct_order_limit(spark, sf_dir):
    """The first 50 distinct states."""
    return facts(sg.old_graph(spark, sf_dir), "oc:requiresState", "s", "state").select("state").distinct().orderBy("state").limit(50)


# --- catalogue --------------------------------------------------------------------------------------------


@query("""SELECT k.s AS uri, k.id, qualified_id, p_brand AS package_id, tier AS trust_tier, skill_type, p_name AS nature, p_type AS category,
  (SELECT string_agg(intent, ',' ORDER BY intent) FROM intents i WHERE i.p_partkey = k.p_partkey) AS intents, requires AS requires_state, yields AS yields_state FROM k""")
def cat_list_skills(spark, sf_dir):
    """All skills, wide."""
    joined = lambda c: F.array_join(c, ",").alias(c)
    return skills(spark, sf_dir).select("uri", "id", "qualified_id", "package_id", "trust_tier", "skill_type", "nature", "category", joined("intents"), joined("requires_state"), joined("yields_state"))


@query("SELECT k.s AS uri, qualified_id FROM k JOIN intents USING (p_partkey) WHERE lower(intent) = 'widget'")
def cat_find_by_intent(spark, sf_dir):
    """Skills that resolve an intent, in any case of letters."""
    return catalog.find_by_intent(skills(spark, sf_dir), "Widget").select("uri", "qualified_id")


@query("SELECT s AS uri, qualified_id, 'skill_type,category' AS matched_by FROM k WHERE skill_type = 'executable' AND p_type = 'ECONOMY' ORDER BY qualified_id LIMIT 25")
def cat_search_filters(spark, sf_dir):
    """Skills by two filters."""
    found = catalog.search(skills(spark, sf_dir), skill_type="executable", category="ECONOMY")
    return found.select("uri", "qualified_id", F.array_join("matched_by", ",").alias("matched_by"))


@query("SELECT s AS uri, qualified_id FROM k WHERE yields = 'oc:S_Brand_7_3'")
def cat_yielding_state(spark, sf_dir):
    """Skills that yield a state."""
    return catalog.yielding(skills(spark, sf_dir), "oc:S_Brand_7_3").select("uri", "qualified_id")


@query("""SELECT ref, uri, CAST(level AS INTEGER) AS level FROM (
  SELECT ref, s AS uri, CASE WHEN lower(qualified_id) = lower(ref) THEN 1 ELSE 3 END AS level,
    row_number() OVER (PARTITION BY ref ORDER BY CASE WHEN lower(qualified_id) = lower(ref) THEN 1 ELSE 3 END) AS n
  FROM (SELECT CASE WHEN s_suppkey % 2 = 0 THEN 'PART-' || s_suppkey ELSE 'Brand#' || (s_suppkey % 25 + 1) || '/part-' || s_suppkey END AS ref FROM supplier)
  JOIN k ON lower(id) = lower(ref) OR lower(qualified_id) = lower(ref)) WHERE n = 1""")
def cat_resolve_ref(spark, sf_dir):
    """A reference for each supplier, short or qualified."""
    key = F.col("s_suppkey")
    refs = table(spark, sf_dir, "supplier").select(F.when(key % 2 == 0, F.concat(F.lit("PART-"), key.cast("string"))).otherwise(F.concat(F.lit("Brand#"), (key % 25 + 1).cast("string"), F.lit("/part-"), key.cast("string"))).alias("ref"))
    return catalog.resolve(refs, skills(spark, sf_dir))


@query("SELECT src AS uri, 'part-' || substr(dst, 10) AS related FROM deps")
def cat_related_ids(spark, sf_dir):
    """The identifier of what each skill depends on."""
    return catalog.related_ids(sg.old_graph(spark, sf_dir), "oc:dependsOnSkill")


@query("SELECT s AS uri, requirement, ['Tool', 'File', 'Env'][p_size % 3 + 1] AS requirement_type, p_brand AS value, p_size % 3 = 2 AS optional FROM k")
def cat_requirements(spark, sf_dir):
    """Each skill's requirements."""
    return catalog.requirements(sg.old_graph(spark, sf_dir))


# --- closure and knowledge --------------------------------------------------------------------------------


@query(", p(src, dst) AS (SELECT src, dst FROM ups UNION SELECT p.src, ups.dst FROM p JOIN ups ON p.dst = ups.src) SELECT src, dst FROM p")
def clo_extends_plus(spark, sf_dir):
    """All ancestors of all skills."""
    return closure(facts(sg.old_graph(spark, sf_dir), "oc:extends", "src", "dst"))


_SUBCLASS = ", sub(sub, sup) AS (VALUES " + ", ".join(
    [f"('oc:{a}', 'oc:{b}')" for a, b in [("ExecutableSkill", "Skill"), ("DeclarativeSkill", "Skill")] + [(d, "KnowledgeNode") for d in catalog.DIMENSIONS] + [(k, d) for d, kinds in catalog.DIMENSIONS.items() for k in kinds] + [(k, "KnowledgeNode") for k in catalog.OPERATIONAL]]
) + ")"


@query(_SUBCLASS + """, c(src, dst) AS (SELECT sub, sup FROM sub UNION SELECT sub, sub FROM sub UNION SELECT sup, sup FROM sub UNION SELECT c.src, sub.sup FROM c JOIN sub ON c.dst = sub.sub),
typed AS (SELECT s, 'oc:Skill' AS kind FROM k UNION SELECT s, CASE WHEN p_size % 2 = 0 THEN 'oc:ExecutableSkill' ELSE 'oc:DeclarativeSkill' END FROM k
  UNION SELECT 'oc:kn_' || doc_id, ['oc:Standard', 'oc:Heuristic', 'oc:KnownIssue', 'oc:SideEffect', 'oc:Procedure'][doc_id % 5 + 1] FROM documents)
SELECT src, dst, CAST(count(DISTINCT s) AS BIGINT) AS nodes FROM c JOIN typed ON kind = src GROUP BY src, dst""")
def clo_subclass_star(spark, sf_dir):
    """Classes and all they fall under, themselves included, with the number of nodes of each class that so fall under another."""
    pairs = closure(catalog.subclass_edges(spark), "sub", "super", reflexive=True)
    typed = facts(sg.graph(spark, sf_dir), "rdf:type", "s", "src")
    return pairs.join(typed, "src").groupBy("src", "dst").agg(F.count_distinct("s").alias("nodes"))


_KNOWLEDGE = f"""
, n AS (SELECT count(*) AS n FROM part),
own AS (SELECT 'oc:skill_' || (doc_id % n) AS owner, 'oc:kn_' || doc_id AS node, doc_id, source, d.text FROM documents d, n),
anc(src, dst) AS (SELECT src, dst FROM ups UNION SELECT anc.src, ups.dst FROM anc JOIN ups ON anc.dst = ups.src),
held AS (SELECT owner AS uri, owner, node, false AS inherited FROM own UNION ALL SELECT src, owner, node, true FROM anc JOIN own ON dst = owner),
best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY uri, node ORDER BY inherited, owner) AS i FROM held) WHERE i = 1),
kn AS (SELECT node, ['standard', 'heuristic', 'known_issue', 'side_effect', 'procedure'][doc_id % 5 + 1] AS kind,
  ['NormativeRule', 'StrategicInsight', 'ResilienceTactic', 'ExecutionPhysics', NULL][doc_id % 5 + 1] AS dimension, source AS applies_to_context,
  CASE WHEN l.doc_id IS NULL THEN NULL WHEN toxic = 1 THEN 'CRITICAL' WHEN quality = 0 THEN 'HIGH' ELSE 'LOW' END AS severity_level
  FROM own LEFT JOIN labels l USING (doc_id))"""


@query(_KNOWLEDGE + " SELECT uri, owner, node, inherited, kind, dimension FROM best JOIN kn USING (node)")
def kn_inherited(spark, sf_dir):
    """Each skill's knowledge, its ancestors' included."""
    return catalog.knowledge(sg.graph(spark, sf_dir)).select("uri", "owner", "node", "inherited", "kind", "dimension")


@query(_KNOWLEDGE + " SELECT uri, node, kind, dimension, severity_level, applies_to_context FROM best JOIN kn USING (node) WHERE NOT inherited AND severity_level = 'HIGH' AND dimension = 'NormativeRule' ORDER BY kind NULLS FIRST, dimension NULLS FIRST, owner, node LIMIT 100")
def epistemic_rules(spark, sf_dir):
    """The first hundred own rules of a severity and a dimension."""
    nodes = catalog.knowledge(sg.graph(spark, sf_dir), inherited=False)
    return catalog.epistemic_rules(nodes, dimension="normative_rule", severity=" high ", limit=100).select("uri", "node", "kind", "dimension", "severity_level", "applies_to_context")


# --- lint, diff, graphs -----------------------------------------------------------------------------------

_DEAD = "SELECT 'warning' AS severity, '{}' AS code, substr(s, 4) AS skill_id, substr(requires, 4) AS detail FROM k WHERE requires NOT IN (SELECT yields FROM k)"


@query(_DEAD.format("dead-state"))
def lint_dead_states(spark, sf_dir):
    """Required states that nothing yields."""
    return _plain(lint.dead_states(sg.old_graph(spark, sf_dir)))


@query(_DEAD.format("unreachable-state") + " AND NOT regexp_matches(lower(p_name), 'create|import|load|init|start|open|new')")
def lint_unreachable(spark, sf_dir):
    """The same, of skills that aren't a way in."""
    return _plain(lint.unreachable(sg.old_graph(spark, sf_dir)))


def _plain(issues: DataFrame) -> DataFrame:
    """Local names without the prefix of compact terms."""
    cut = lambda c: F.regexp_replace(c, "^oc:", "").alias(c)
    return issues.select("severity", "code", cut("skill_id"), cut("detail"))


@query("SELECT 'error' AS severity, 'circular-dep' AS code, substr(s, 4) AS skill_id, substr(s, 4) AS detail FROM k WHERE p_partkey % 20 < 5")
def lint_cycles(spark, sf_dir):
    """Skills on a cycle of dependencies."""
    return _plain(lint.circular(sg.old_graph(spark, sf_dir)))


@query("SELECT 'error' AS severity, 'duplicate-intent' AS code, substr(s, 4) AS skill_id, intent || ':' || n AS detail FROM intents JOIN (SELECT intent, count(*) AS n FROM intents GROUP BY intent HAVING count(*) > 1) USING (intent)")
def lint_dup_intents(spark, sf_dir):
    """Skills that share an intent."""
    return _plain(lint.duplicate_intents(sg.old_graph(spark, sf_dir)))


_SPOKEN = "(SELECT doc_id, CASE doc_id % 9 WHEN 0 THEN 'You can ' || text WHEN 1 THEN text || ' as i said' WHEN 2 THEN 'Wei ' || text || ' ours' WHEN 3 THEN 'so we, and my' || chr(10) || text ELSE text END AS text FROM documents)"


@query(
    "SELECT 'warning' AS severity, 'third-person' AS code, CAST(doc_id AS VARCHAR) AS skill_id, array_to_string(f, ',') AS detail FROM (SELECT doc_id, list_filter(["
    + ", ".join("CASE WHEN regexp_matches(text, '{}') THEN '{}' END".format(lint.person_pattern(p).replace("'", "''"), p.replace("'", "''")) for p in lint.PERSON)
    + f"], lambda x: x IS NOT NULL) AS f FROM {_SPOKEN}) WHERE len(f) > 0",
    skills=False,
)
def lint_third_person(spark, sf_dir):
    """Documents that speak in the first or second person; some are made to, and some nearly."""
    turn, text = F.col("doc_id") % 9, F.col("text")
    spoken = F.when(turn == 0, F.concat(F.lit("You can "), text)).when(turn == 1, F.concat(text, F.lit(" as i said"))).when(turn == 2, F.concat(F.lit("Wei "), text, F.lit(" ours"))).when(turn == 3, F.concat(F.lit("so we, and my\n"), text)).otherwise(text)
    return lint.third_person(table(spark, sf_dir, "documents").withColumn("text", spoken))


@query("SELECT 'warning' AS severity, 'body-length' AS code, CAST(doc_id AS VARCHAR) AS skill_id, CAST(n AS VARCHAR) AS detail FROM (SELECT doc_id, len(string_split(text, chr(10))) AS n FROM documents) WHERE n > 20", skills=False)
def lint_body_length(spark, sf_dir):
    """Documents of more than 20 lines (they have no front matter)."""
    return lint.body_length(table(spark, sf_dir, "documents"), most=20)


@query("SELECT 'info' AS severity, 'reference-depth' AS code, CAST(page_id AS VARCHAR) AS skill_id, CAST(n AS VARCHAR) AS detail FROM (SELECT page_id, len(url) - len(replace(url, '/', '')) AS n FROM pages) WHERE n > 3", skills=False)
def lint_ref_depth(spark, sf_dir):
    """Pages whose address goes deeper than three slashes."""
    return lint.reference_depth(table(spark, sf_dir, "pages"), "page_id", "url", 3)


_OLDNEW = """
, i1 AS (SELECT s AS skill, intent AS value FROM intents), i2 AS (SELECT s AS skill, intent || CASE WHEN p_partkey % 7 = 0 THEN '_v2' ELSE '' END AS value FROM intents WHERE p_partkey % 50 <> 0),
v1 AS (SELECT s AS skill, requires AS value, 'requires_state' AS category FROM k UNION ALL SELECT s, yields, 'yields_state' FROM k UNION ALL SELECT s, requirement, 'requirement' FROM k)"""


@query(_OLDNEW + ", both_ AS (SELECT DISTINCT skill FROM i1 SEMI JOIN i2 USING (skill)) SELECT skill, 'intent' AS category, 'breaking' AS change_type, 'removed' AS action, value FROM i1 SEMI JOIN both_ USING (skill) ANTI JOIN i2 USING (skill, value) UNION ALL SELECT skill, 'intent', 'additive', 'added', value FROM i2 ANTI JOIN i1 USING (skill, value)")
def diff_intents(spark, sf_dir):
    """Intents lost and gained."""
    return diff.value_changes(sg.old_graph(spark, sf_dir), sg.new_graph(spark, sf_dir), "oc:resolvesIntent")


_SHIFT = """, n2 AS (SELECT s, CASE WHEN p_partkey % 11 = 0 THEN {old} || '_x' ELSE {old} END AS value, {old} AS old FROM k WHERE p_partkey % 50 <> 0)
SELECT s AS skill, '{cat}' AS category, '{lost}' AS change_type, 'removed' AS action, old AS value FROM n2 WHERE old <> value UNION ALL SELECT s, '{cat}', '{gained}', 'added', value FROM n2 WHERE old <> value"""


def _shifted(spark, sf_dir, predicate: str) -> DataFrame:
    """The new graph with the objects of a predicate changed for every 11th skill."""
    t = sg.new_graph(spark, sf_dir)
    hit = (F.col("p") == predicate) & (F.when(F.startswith("s", F.lit("oc:skill_")), F.substring_index("s", "_", -1)).try_cast("bigint") % 11 == 0)
    return t.withColumn("o", F.when(hit, F.concat("o", F.lit("_x"))).otherwise(F.col("o")))


@query(_SHIFT.format(old="requires", cat="requires_state", lost="breaking", gained="additive"))
def diff_states(spark, sf_dir):
    """Required states lost and gained."""
    return diff.value_changes(sg.old_graph(spark, sf_dir), _shifted(spark, sf_dir, "oc:requiresState"), "oc:requiresState", "oc:yieldsState")


@query(_SHIFT.format(old="requirement", cat="requirement", lost="additive", gained="breaking"))
def diff_requirements(spark, sf_dir):
    """Requirements lost and gained: a gained one breaks."""
    return diff.value_changes(sg.old_graph(spark, sf_dir), _shifted(spark, sf_dir, "oc:hasRequirement"), "oc:hasRequirement")


@query(_OLDNEW + """, both_ AS (SELECT DISTINCT skill FROM i1 SEMI JOIN i2 USING (skill)), ch AS (
SELECT 'breaking' AS change_type FROM (SELECT DISTINCT skill FROM i1) ANTI JOIN i2 USING (skill)
UNION ALL SELECT 'breaking' FROM i1 SEMI JOIN both_ USING (skill) ANTI JOIN i2 USING (skill, value)
UNION ALL SELECT 'additive' FROM i2 ANTI JOIN i1 USING (skill, value)) SELECT change_type, CAST(count(*) AS BIGINT) AS n FROM ch GROUP BY change_type""")
def diff_summary(spark, sf_dir):
    """Changes by type."""
    return diff.summary(diff.compute_diff(sg.old_graph(spark, sf_dir), sg.new_graph(spark, sf_dir)))


@query(_OLDNEW + """, both_ AS (SELECT DISTINCT skill FROM i1 SEMI JOIN i2 USING (skill))
SELECT skill, 'skill-removed' AS migration, 'SELECT ?s WHERE { { ?s oc:dependsOnSkill ' || skill || ' } UNION { ?s oc:dependsOn ' || skill || ' } }' AS query, 'Nothing is ' || skill || ' any more: point what depends on it to a skill with the same intents, or drop the dependency.' AS suggestion FROM (SELECT DISTINCT skill FROM i1) ANTI JOIN i2 USING (skill)
UNION ALL SELECT skill, 'intent-renamed', 'SELECT ?s WHERE { ?s oc:resolvesIntent "' || value || '" }', skill || ' no longer resolves ' || chr(39) || value || chr(39) || ': ask for one of its other intents, or for a skill that still has this one.' FROM i1 SEMI JOIN both_ USING (skill) ANTI JOIN i2 USING (skill, value)
UNION ALL SELECT s, 'requirement-added', 'SELECT ?s WHERE { ?s oc:hasRequirement ' || requirement || '_x }', s || ' now needs ' || requirement || '_x: have it ready wherever the skill runs.' FROM k WHERE p_partkey % 11 = 0 AND p_partkey % 50 <> 0""")
def diff_suggestions(spark, sf_dir):
    """Advice for skills that are gone, intents that were renamed and requirements that were added."""
    changes = diff.compute_diff(sg.old_graph(spark, sf_dir), _shifted(spark, sf_dir, "oc:hasRequirement"))
    return diff.suggestions(changes).select("skill", "migration", "query", "suggestion")


_EDGES = ", e AS (SELECT DISTINCT substr(a.s, 4) AS producer, substr(b.s, 4) AS consumer, substr(a.yields, 4) AS state FROM k a JOIN k b ON a.yields = b.requires)"


def _edges(spark, sf_dir) -> DataFrame:
    return graphs.state_edges(sg.old_graph(spark, sf_dir), lambda c: F.regexp_replace(terms.local_name(c), "^oc:", ""))


@query(_EDGES + " SELECT * FROM e")
def graph_state_edges(spark, sf_dir):
    """Who yields what another requires."""
    return _edges(spark, sf_dir)


@query(_EDGES + ", near AS (SELECT producer AS n FROM e WHERE producer = 'skill_7' OR consumer = 'skill_7' UNION SELECT consumer FROM e WHERE producer = 'skill_7' OR consumer = 'skill_7') SELECT * FROM e WHERE producer IN (SELECT n FROM near) AND consumer IN (SELECT n FROM near)")
def graph_one_hop(spark, sf_dir):
    """The edges around one skill."""
    cut = lambda c: F.regexp_replace(c, "^oc:", "").alias(c)
    t = sg.old_graph(spark, sf_dir).where("p in ('oc:yieldsState', 'oc:requiresState')")
    return graphs.states_around(t, "oc:skill_7").select(cut("producer"), cut("consumer"), cut("state"))


@query(", c AS (SELECT s, CASE WHEN count(*) OVER (PARTITION BY p_brand || '/' || p_size) >= 2 THEN 'cluster:' || p_brand || '/' || p_size ELSE s END AS c FROM k) SELECT DISTINCT a.c AS src, b.c AS dst FROM ups JOIN c a ON a.s = src JOIN c b ON b.s = dst WHERE a.c <> b.c")
def graph_cluster(spark, sf_dir):
    """Inheritance among clusters of a brand and a size."""
    nodes = table(spark, sf_dir, "part").select(F.concat(F.lit("oc:skill_"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws("/", "p_brand", F.col("p_size").cast("string")).alias("category"))
    return graphs.cluster(nodes, facts(sg.old_graph(spark, sf_dir), "oc:extends", "src", "dst"))


# --- search -----------------------------------------------------------------------------------------------

_BM25 = """WITH d AS (SELECT doc_id, list_filter(string_split(regexp_replace(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^a-z0-9]+', ' ', 'g'), ' '), lambda w: w <> '') AS words FROM documents),
c AS (SELECT doc_id, len(words) AS l, len(list_filter(words, lambda w: w = 'mit')) AS a, len(list_filter(words, lambda w: w = 'license')) AS b FROM d),
t AS (SELECT count(*) AS n, avg(l) AS m, count(*) FILTER (a > 0) AS da, count(*) FILTER (b > 0) AS db FROM c)
SELECT doc_id AS id, round(ln(1 + (n - da + 0.5) / (da + 0.5)) * a * 2.2 / (a + 1.2 * (0.25 + 0.75 * l / m)) + ln(1 + (n - db + 0.5) / (db + 0.5)) * b * 2.2 / (b + 1.2 * (0.25 + 0.75 * l / m)), 6) AS score
FROM c, t WHERE a > 0 OR b > 0 ORDER BY score DESC, id LIMIT 20"""


@query(_BM25, skills=False)
def bm25_topk(spark, sf_dir):
    """The best 20 documents for two words."""
    scored = search.bm25(table(spark, sf_dir, "documents"), "MIT license")
    return scored.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query(_BM25, skills=False)
def bm25_indexed_topk(spark, sf_dir):
    """The same from postings, written once and read by term."""
    path = fresh(spark)
    search.store_index(search.postings(table(spark, sf_dir, "documents")), path)
    return search.bm25_indexed(spark, path, "MIT license").select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


@query("SELECT 'oc:hasCategory' AS p, p_type AS category, CAST(count(*) AS BIGINT) AS n FROM part GROUP BY p_type", skills=False)
def sp_stored(spark, sf_dir):
    """A pattern over a stored table, clustered by predicate, of a graph that two files have."""
    path = fresh(spark)
    t = sg.old_graph(spark, sf_dir)
    store(t.union(t.withColumn("graph_id", F.lit("copy"))), path)
    return facts(spark.read.parquet(path), "oc:hasCategory", "s", "category").groupBy("category").agg(F.count("*").alias("n")).select(F.lit("oc:hasCategory").alias("p"), "category", "n")


@query()
def bm25_stemmed_topk(spark, sf_dir):
    """The same with stems and without stop words."""
    scored = search.bm25(table(spark, sf_dir, "documents"), "released licenses", stemmed=True)
    return scored.select("id", F.round("score", 6).alias("score")).orderBy(F.desc("score"), "id").limit(20)


_VEC = "SELECT vec_id AS id, round(list_cosine_similarity(embedding::DOUBLE[], (SELECT embedding::DOUBLE[] FROM embeddings ORDER BY vec_id LIMIT 1)), 6) AS score FROM embeddings"


def _first_vector(spark, sf_dir) -> list[float]:
    return list(table(spark, sf_dir, "embeddings").orderBy("vec_id").limit(1).collect()[0].embedding)


@query(_VEC + " ORDER BY score DESC, id LIMIT 20", skills=False)
def vec_topk(spark, sf_dir):
    """The 20 vectors nearest to the first."""
    found = search.vector_search(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 20)
    return found.select("id", F.round("score", 6).alias("score"))


@query(f"WITH s AS ({_VEC} ORDER BY score DESC, id LIMIT 20), r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, lag(score) OVER (ORDER BY score DESC, id) AS b FROM s) SELECT id, score, CAST(rank AS INTEGER) AS rank FROM r WHERE (SELECT max(score) FROM s) >= 0.4 AND rank <= coalesce((SELECT min(rank) FROM r WHERE b - score > 0.15 AND score < 0.4) - 1, (SELECT count(*) FROM s WHERE score >= 0.4))", skills=False)
def vec_cutoff(spark, sf_dir):
    """The same, cut off where scores fall away."""
    found = search.vector_search(table(spark, sf_dir, "embeddings"), _first_vector(spark, sf_dir), 20).select("id", F.round("score", 6).alias("score"))
    return search.cutoff(found, 0.4, 0.15)


@query("""WITH v AS (SELECT vec_id AS id, embedding, sqrt(list_sum(list_transform(embedding, lambda x: x::DOUBLE * x))) AS norm FROM embeddings),
s AS (SELECT q.id AS query, v.id, round(list_sum(list_transform(list_zip(q.embedding, v.embedding), lambda x: (x[1]::DOUBLE / q.norm) * (x[2]::DOUBLE / v.norm))), 9) AS score FROM v q JOIN v ON q.id % 20 = 0 AND v.id <> q.id)
SELECT query, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query ORDER BY score DESC, id) AS rank FROM s) WHERE rank <= 10""", skills=False)
def vec_neighbours_exact(spark, sf_dir):
    """The ten nearest vectors of every 20th, from all cells."""
    vectors = table(spark, sf_dir, "embeddings")
    centres = nearest.fit_cells(vectors, 16)
    found = nearest.neighbours(nearest.file_vectors(vectors, centres), centres, vectors.where("vec_id % 20 = 0"), 10)
    return found.select("query", "rank", "id", F.round("score", 6).alias("score"))


@query()
def vec_neighbours(spark, sf_dir):
    """The same from a stored index, out of the nearest cells."""
    vectors, path = table(spark, sf_dir, "embeddings"), fresh(spark)
    centres = nearest.fit_cells(vectors, 32)
    nearest.store_cells(nearest.file_vectors(vectors, centres), path)
    found = nearest.neighbours(spark.read.parquet(path), centres, vectors.where("vec_id % 20 = 0"), 10, probes=20)
    return found.select("query", "rank", "id", F.round("score", 6).alias("score"))


_SKILL_TEXTS = """, n AS (SELECT count(*) AS n FROM part), own AS (SELECT doc_id % n AS p_partkey, string_agg(text, ' ' ORDER BY doc_id) AS said FROM documents, n GROUP BY ALL),
x AS (SELECT id, list_filter(regexp_split_to_array(lower(p_name || ' ' || p_type || ' ' || coalesce(said, '')), '[^a-z0-9]+'), lambda w: w <> '') AS words FROM k LEFT JOIN own USING (p_partkey)),
w AS (SELECT id, len(words) AS l, unnest(words) AS term FROM x), tf AS (SELECT id, l, term, count(*) AS tf FROM w GROUP BY ALL), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
g AS (SELECT count(*) AS docs, avg(len(words)) AS mean FROM x),
part_ AS (SELECT term, id, round(ln(1 + (docs - df + 0.5) / (df + 0.5)) * (tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * l / mean))) * 1000000)::BIGINT AS impact FROM tf JOIN df USING (term), g)"""


def skill_texts(spark, sf_dir) -> DataFrame:
    """(id, text): each skill's name, category and the texts of its knowledge."""
    part, docs = table(spark, sf_dir, "part"), table(spark, sf_dir, "documents")
    said = docs.groupBy((F.col("doc_id") % max(part.count(), 1)).alias("p_partkey")).agg(F.array_sort(F.collect_list(F.struct("doc_id", "text"))).alias("d"))
    said = said.select("p_partkey", F.array_join("d.text", " ").alias("said"))
    return part.join(said, "p_partkey", "left").select(F.concat(F.lit("part-"), F.col("p_partkey").cast("string")).alias("id"), F.concat_ws(" ", "p_name", "p_type", "said").alias("text"))


@query(_SKILL_TEXTS + """, q AS (SELECT DISTINCT intent AS query, intent AS term FROM intents UNION SELECT DISTINCT p_name || ' ' || p_type, unnest(string_split(lower(p_name || ' ' || p_type), ' ')) FROM part)
SELECT query, CAST(rank AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT query, id, sum(impact) / 1000000 AS score, row_number() OVER (PARTITION BY query ORDER BY sum(impact) DESC, id) AS rank FROM q JOIN part_ USING (term) GROUP BY query, id) WHERE rank <= 5""")
def search_all_intents(spark, sf_dir):
    """The five best skills for every intent, and for every name with its category, by all their texts."""
    path = fresh(spark)
    names = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_name", "p_type").alias("query"))
    asked = stored(facts(sg.old_graph(spark, sf_dir), "oc:resolvesIntent", "s", "query").select("query").union(names).distinct()).withColumn("text", F.col("query"))
    impacts.store_impacts(skill_texts(spark, sf_dir), path, "id", block=32, asked=asked)
    found = impacts.search_all(spark, path, asked, 5)
    return found.withColumn("score", F.round("score", 6))


@query("""WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings), q AS (SELECT list_transform(range(1, 65), lambda i: list_sum(list_transform(l, lambda x: x[i]))) AS q FROM (SELECT list(e ORDER BY vec_id) AS l FROM v WHERE vec_id < 3)),
s AS (SELECT 'v' || vec_id AS id, list_dot_product(e, q) / sqrt(list_dot_product(e, e)) / sqrt(list_dot_product(q, q)) * CASE vec_id % 4 WHEN 0 THEN 1.2 WHEN 3 THEN 0.8 ELSE 1.0 END AS score FROM v, q),
r AS (SELECT *, row_number() OVER (ORDER BY score DESC, id) AS rank, lag(score) OVER (ORDER BY score DESC, id) AS b FROM s)
SELECT id, round(score, 6) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 2 AND (SELECT max(score) FROM r) >= 0.4 AND rank <= coalesce((SELECT min(rank) FROM r WHERE b - score > 0.15 AND score < 0.4) - 1, (SELECT count(*) FROM r WHERE score >= 0.4))""", skills=False)
def search_semantic(spark, sf_dir):
    """The two best intents for a query: cosines times the weights of their skills' tiers, cut off over all, then shortened."""
    vectors = table(spark, sf_dir, "embeddings")
    intents = vectors.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("intent"), "embedding", F.array(F.concat(F.lit("part-"), F.col("vec_id").cast("string"))).alias("skills"))
    tiers = F.element_at(F.array(*map(F.lit, sg.TIERS)), (F.col("vec_id") % 4 + 1).cast("int"))
    wide = vectors.select(F.concat(F.lit("part-"), F.col("vec_id").cast("string")).alias("id"), tiers.alias("trust_tier"))
    few = [r.embedding for r in vectors.where("vec_id < 3").orderBy("vec_id").collect()]
    found = search.semantic_search(intents, [sum(map(float, x)) for x in zip(*few, strict=True)], wide, top_k=2)
    return found.select("id", F.round("score", 6).alias("score"), "rank")


@query("SELECT intent, string_agg(DISTINCT id, ',' ORDER BY id) AS skills FROM intents GROUP BY intent")
def intent_index(spark, sf_dir):
    """Intents and their skills."""
    return search.intent_index(sg.old_graph(spark, sf_dir)).select("intent", F.array_join("skills", ",").alias("skills"))


# --- benchmark statistics ---------------------------------------------------------------------------------


def _results(spark, sf_dir) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.concat(F.lit("agent"), (F.col("user_id") % 2).cast("string")).alias("agent"), F.col("event_type").alias("bench"), F.col("value").alias("latency"), "event_id")


_RES = "WITH r AS (SELECT 'agent' || (user_id % 2) AS agent, event_type AS bench, value AS latency, event_id FROM events)"


@query(_RES + " SELECT agent, bench, CAST(count(*) AS BIGINT) AS n_tasks, round(avg(latency), 6) AS avg_latency FROM r GROUP BY ALL", skills=False)
def bench_metrics(spark, sf_dir):
    """Means by agent and benchmark."""
    return bench.agent_metrics(_results(spark, sf_dir)).withColumn("avg_latency", F.round("avg_latency", 6))


@query(_RES + ", m AS (SELECT agent, bench, avg(latency) AS v FROM r GROUP BY ALL), a AS (SELECT bench, v FROM m WHERE agent = 'agent0'), b AS (SELECT bench, v FROM m WHERE agent = 'agent1') SELECT bench, round(a.v, 6) AS base_value, round(b.v, 6) AS other_value, round(b.v - a.v, 6) AS delta, round((b.v - a.v) * 100 / nullif(a.v, 0), 6) AS change_pct FROM a FULL JOIN b USING (bench)", skills=False)
def bench_compare(spark, sf_dir):
    """Two agents compared."""
    out = bench.compare(bench.agent_metrics(_results(spark, sf_dir)), "agent0", "agent1", "avg_latency")
    return out.select("bench", *[F.round(c, 6).alias(c) for c in ("base_value", "other_value", "delta", "change_pct")])


_WILSON = "greatest(0, least(1, ((p + 3.8416 / (2 * n)) {} 1.96 * sqrt((p * (1 - p) + 3.8416 / (4 * n)) / n)) / (1 + 3.8416 / n)))"


@query(f"WITH g AS (SELECT source, count(*)::DOUBLE AS n, sum(quality)::DOUBLE AS k FROM documents JOIN labels USING (doc_id) GROUP BY source), h AS (SELECT *, k / n AS p FROM g) SELECT source, CAST(n AS BIGINT) AS n, CAST(k AS BIGINT) AS passed, round({_WILSON.format('-')}, 4) AS low, round({_WILSON.format('+')}, 4) AS high FROM h", skills=False)
def bench_wilson(spark, sf_dir):
    """Intervals of the share of good documents of each source."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    scored = bench.score(rows, "source", reward="quality")
    low, high = bench.wilson(F.col("passed"), F.col("n"))
    return scored.select("source", "n", "passed", low.alias("low"), high.alias("high"))


@query(_RES + " SELECT bench, latency, event_id FROM (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY agent, event_id) AS i FROM r) WHERE i = 1", skills=False)
def bench_dedup(spark, sf_dir):
    """The first result of each benchmark."""
    return bench.merge_first(_results(spark, sf_dir), "bench", "agent", "event_id").select("bench", "latency", "event_id")


@query(_RES + ", o AS (SELECT *, row_number() OVER (PARTITION BY bench ORDER BY latency) - 1 AS i, count(*) OVER (PARTITION BY bench) AS n FROM r) SELECT bench, CAST(n AS BIGINT) AS n, round(avg(latency), 6) AS avg, min(latency) AS min, max(latency) AS max, max(CASE WHEN i = n * 50 // 100 THEN latency END) AS p50, max(CASE WHEN i = n * 99 // 100 THEN latency END) AS p99 FROM o GROUP BY bench, n", skills=False)
def bench_percentiles(spark, sf_dir):
    """Latencies by benchmark."""
    return bench.percentiles(_results(spark, sf_dir), "latency", "bench").withColumn("avg", F.round("avg", 6))


@query("SELECT o_orderkey, (n * CASE WHEN n > 200000 THEN 6 ELSE 3 END + o_custkey * CASE WHEN n > 200000 THEN 22 ELSE 15 END)::DOUBLE / 1000000 AS cost FROM (SELECT *, floor(o_totalprice)::BIGINT AS n FROM orders)", skills=False)
def bench_cost(spark, sf_dir):
    """Prices of tokens with a tier, on orders as requests."""
    price = bench.cost(F.floor("o_totalprice"), F.col("o_custkey"), F.lit(3), F.lit(15), F.lit(6), F.lit(22))
    return table(spark, sf_dir, "orders").select("o_orderkey", price.cast("double").alias("cost"))
