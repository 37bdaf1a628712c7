"""The calls that a client makes, each answered by a record and a compact text: search, context, plan, rules, prefetch, and one that does what fits.

A call is about one skill or a few; what it collects is bounded by its limits.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from graphwright.operators import catalog, planner, render, search

# Results of a search unless a caller says otherwise; skills fetched ahead, and the most of them.
TOP_K, AHEAD, MOST_AHEAD = 5, 3, 5


@dataclass
class Tools:
    """Calls over one triple table. intents: (intent, embedding, skills) for semantic search; embed: from a text to its vector."""

    t: DataFrame
    intents: DataFrame | None = None
    embed: object = None

    @cached_property
    def skills(self) -> DataFrame:
        return catalog.skills(self.t)

    def find(self, query: str, top_k: int = TOP_K) -> dict:
        """Skills for a query: by vectors if there are any and they find something, else by words."""
        if self.intents is not None and self.embed is not None:
            cut = query.encode()[:512].decode(errors="ignore")
            matches = search.semantic_search(self.intents, self.embed(cut), self.skills, top_k).orderBy("rank").collect()
            if matches:
                return {"mode": "semantic", "query": query, "matches": [{"intent": r.id, "score": r.score, "skills": list(r.skills or [])} for r in matches]}
        found = search.search_skills(self.skills, query, top_k).join(self.skills.select(F.col("qualified_id").alias("id"), F.col("id").alias("skill_id"), "intents"), "id").orderBy("rank").collect()
        return {"mode": "bm25", "query": query, "results": [{"skill_id": r.skill_id, "score": r.score, "trust_tier": r.trust_tier, "intents": list(r.intents)} for r in found]}

    def search(self, query: str | None = None, alias: str | None = None, top_k: int = TOP_K, **filters) -> dict:
        """A search by query or by alias, not both, or else by the filters of `catalog.search`."""
        if query is not None and alias is not None:
            raise ValueError("query and alias exclude each other")
        if query is not None:
            found = self.find(query, top_k)
        elif alias is not None:
            named = catalog.aliases(self.t, alias).select("uri").distinct()
            found = {"mode": "alias", "alias": alias, "skills": [r.asDict() for r in self.skills.join(named, "uri", "left_semi").select("id", "trust_tier").orderBy("id").collect()]}
        else:
            found = {"mode": "structured", "skills": [r.asDict() for r in catalog.search(self.skills, **filters).select("id", "nature", "matched_by").collect()]}
        return render.envelope(found, render.search_text(found))

    def _context(self, skill_id: str, inherited: bool, query: str | None) -> tuple[dict, str]:
        found = catalog.context(self.t, self.skills, skill_id, inherited)
        nodes, sections = found["knowledge_nodes"], found["sections"]
        spark = self.t.sparkSession
        if query and nodes:
            rows = spark.createDataFrame([(skill_id, n["node"], n["directive_content"], n["applies_to_context"], n["rationale"]) for n in nodes], "uri string, node string, directive_content string, applies_to_context string, rationale string")
            best = [r.node for r in search.rank_nodes(rows, query).orderBy(F.desc("score"), "node").collect()]
            by = {n["node"]: n for n in nodes}
            nodes = [by[b] for b in best] or nodes
        if not query or nodes is found["knowledge_nodes"]:
            step = lambda n: render.LAST_STEP if n["step_order"] is None else n["step_order"]
            nodes = sorted(nodes, key=lambda n: (step(n), render.PRIORITY.get(n["kind"], render.LAST_KIND)))
        if query and sections:
            rows = spark.createDataFrame([(i, f"{s['section_title'] or ''} {s['content']}") for i, s in enumerate(sections)], "id int, text string")
            scored = [r.id for r in search.bm25(rows, query, "id", "text", True).orderBy(F.desc("score"), "id").collect()]
            sections = [sections[i] for i in [*scored, *(i for i in range(len(sections)) if i not in scored)]]
        head = found["skill"] | {"requirements": [r["value"] for r in found["skill"]["requirements"]]}
        return found, render.context_text(head | {"id": skill_id}, nodes, sections)

    def context(self, skill_id: str, inherited: bool = True, query: str | None = None) -> dict:
        """A skill with all that is known of it; with a query the knowledge and the sections that fit it come first."""
        return render.envelope(*self._context(skill_id, inherited, query))

    def plan(self, current: list[str], intent: str | None = None, skill_id: str | None = None, depth: int = 0) -> dict:
        found = planner.evaluate(self.skills, current, intent, skill_id, depth)
        return render.envelope(found, render.plan_text(found))

    def rules(self, skill_id: str | None = None, inherited: bool = True, **filters) -> dict:
        """Knowledge by filters: of one skill, with what it inherits, or what each skill imparts itself."""
        nodes = catalog.knowledge(self.t, inherited=inherited and skill_id is not None)
        if skill_id is not None:
            uri = catalog.resolve(self.t.sparkSession.createDataFrame([(skill_id,)], "ref string"), self.skills).select("uri")
            nodes = nodes.join(uri, "uri", "left_semi")
        rows = [r.asDict(recursive=True) for r in catalog.epistemic_rules(nodes, **filters).collect()]
        return render.envelope({"nodes": rows}, render.rules_text(rows))

    def prefetch(self, query: str | None = None, skill_ids: list[str] | None = None, max_skills: int = AHEAD) -> dict:
        """Contexts of some skills, or of those that a query finds by words, at once."""
        if skill_ids is None and query is None:
            raise ValueError("give a query or skill ids")
        most = min(max_skills, MOST_AHEAD)
        ids = skill_ids[:most] if skill_ids is not None else [r["skill_id"] for r in Tools(self.t).find(query, most).get("results", [])]
        if not ids:
            return render.envelope({"skills": []}, "No matching skills found.")
        texts, found = [], []
        for name in ids:
            try:
                record, text = self._context(name, True, query)
            except LookupError:
                texts.append(f"## {name}\nSkill not found.")
            else:
                found.append(record)
                texts.append(text)
        return render.envelope({"prefetched_skills": ids, "results": found}, "\n\n".join(texts))

    def ask(self, q: str, top_k: int = TOP_K) -> dict:
        """A skill's context if q names one, else a search for q."""
        try:
            return self.context(q)
        except LookupError:
            return self.search(query=q, top_k=top_k)
