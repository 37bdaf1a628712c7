"""Compact texts of search results, skills, plans and rules, within byte budgets."""

from __future__ import annotations

import json
from collections.abc import Iterable, Mapping

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

# Bytes for the knowledge of a skill, for what a node takes besides its text, and for its sections.
NODE_BUDGET, LINE_EXTRA, SECTION_BUDGET = 12_000, 80, 3_000
# Which kinds of knowledge come first where no step order tells; others come last, as nodes without a step order do.
PRIORITY = {"procedure": 0, "constraint": 1, "design_principle": 2, "heuristic": 3, "anti_pattern": 4, "recovery_tactic": 5, "best_practice": 6, "rule": 7}
LAST_KIND, LAST_STEP = 99, 999
SEVERE = ("CRITICAL", "HIGH")
# How many results, intents and skills a search shows, and warnings a plan.
RESULTS, RESULT_INTENTS, MATCHES, MATCH_SKILLS, WARNINGS = 5, 2, 3, 3, 3
ARROW = "→"


def search_text(found: Mapping) -> str:
    """A search's result as text: its mode, then a line for each of the first results (skills), matches (intents) or skills."""
    mode = found.get("mode") or ""
    lines = [f"- {r.get('skill_id', '')} [{r.get('trust_tier', '')}]: {'; '.join((r.get('intents') or [])[:RESULT_INTENTS])}" for r in (found.get("results") or [])[:RESULTS]]
    lines += [f"- {m.get('intent', '')} (score={m.get('score', 0.0):.2f}): {', '.join((m.get('skills') or [])[:MATCH_SKILLS])}" for m in (found.get("matches") or [])[:MATCHES]]
    skills = (found.get("skills") or [])[:RESULTS]
    if mode == "alias":
        lines += [f"- {s.get('id') or s.get('skill_id') or ''} [{s.get('trust_tier') or ''}]" for s in skills]
    elif mode != "bm25":
        lines += [f"- {s.get('id') or ''} ({s.get('nature') or ''})" for s in skills]
    return "\n".join([f"Search mode: {mode}", *lines]) if lines else "No results found."


def node_head(node: Mapping) -> str:
    """A node's kind, its context, and its severity where that is high."""
    parts = [node["kind"].replace("_", " ").upper()]
    if node.get("applies_to_context"):
        parts.append(f"({node['applies_to_context']})")
    if node.get("severity_level") in SEVERE:
        parts.append(f"[{node['severity_level']}]")
    return f"  {' '.join(parts)}:"


def link_lines(node: Mapping) -> list[str]:
    forms = {"correctAlternative": '  {} Correct: "{}"', "appliesToStep": "  {} Applies to: {}"}
    return [forms[x["property"]].format(ARROW, x["target_title"]) for x in node.get("links") or [] if x["property"] in forms]


def context_text(skill: Mapping, nodes: Iterable[Mapping], sections: Iterable[Mapping] = ()) -> str:
    """A skill's context. Nodes come in the order given; the first that would pass the budget ends them, and the rationale of a severe one
    is added, and counted, after that test. Sections, in the order given, are skipped where they don't fit."""
    lines = [f"## {skill['id']}"]
    if skill.get("differentia") is not None:
        lines.append(f"{skill.get('genus') or ''} — {skill['differentia']}")
    if len(skill.get("intents") if skill.get("intents") is not None else []):
        lines.append("Intents: " + "; ".join(skill["intents"]))
    if len(skill.get("requirements") if skill.get("requirements") is not None else []):
        lines.append("Requires: " + "; ".join(skill["requirements"]))
    used, told = 0, []
    any_node = False
    for node in nodes:
        any_node = True
        text = (node["directive_content"] or "").strip()
        if not text:
            continue
        size = len(text.encode()) + LINE_EXTRA
        if used + size > NODE_BUDGET:
            break
        used += size
        told += [node_head(node), f"  {text}"]
        if node.get("severity_level") in SEVERE and node.get("rationale"):
            told.append(f"  Why: {node['rationale']}")
            used += len(node["rationale"].encode())
        told += link_lines(node)
    if any_node:
        lines += ["", *told]
    left, shown = SECTION_BUDGET, []
    for section in sections:
        size = len(section["content"].encode())
        if size > left:
            continue
        left -= size
        if section.get("section_title"):
            shown.append(f"[{section['section_title']}]")
        body = section["content"].splitlines()
        shown += [f"```{section.get('language') or ''}", *body, "```"] if section["content_type"] == "code_example" else body
        if left <= 0:
            break
    if shown:
        lines += ["", "Examples & Reference Tables:", *shown]
    return "\n".join(lines)


def ranked_nodes(nodes: DataFrame) -> DataFrame:
    """Knowledge rows with `place` in their skill's context: by score where a column of it has any above zero, else by step order, kind, and node.

    Only rows that a context can show at all are kept: each takes more than LINE_EXTRA bytes of the budget, so that places beyond its quotient are never
    reached. A skill with very many nodes is cut before its rows meet in one task.
    """
    kinds = F.create_map(*[F.lit(x) for pair in PRIORITY.items() for x in pair])
    order = [F.coalesce("step_order", F.lit(LAST_STEP)), F.coalesce(kinds[F.col("kind")], F.lit(LAST_KIND)), F.col("node")]
    if "score" in nodes.columns:
        order = [F.col("score").desc_nulls_last(), *order]
    window = Window.partitionBy("uri").orderBy(*order)
    return nodes.where(F.trim("directive_content") != "").withColumn("place", F.row_number().over(window)).where(F.col("place") <= NODE_BUDGET // (LINE_EXTRA + 1))


def contexts(skills: DataFrame, nodes: DataFrame, sections: DataFrame | None = None) -> DataFrame:
    """(uri, text): each skill's context (see `context_text`).

    skills: (uri, id, genus, differentia, intents, requirements), nodes: rows of `catalog.knowledge`, sections: rows of `catalog.section_content`. Sections
    longer than the budget go before rows meet.
    """
    heads = skills.select("uri", F.struct(*[c for c in ("id", "genus", "differentia", "intents", "requirements") if c in skills.columns]).alias("skill"))
    node = F.struct(*[c for c in ("kind", "directive_content", "rationale", "applies_to_context", "severity_level", "links") if c in nodes.columns])
    rows = ranked_nodes(nodes).select("uri", F.lit(0).alias("part"), F.col("place").cast("long").alias("place"), F.to_json(node).alias("row"))
    rows = rows.union(heads.select("uri", F.lit(-1), F.lit(0).cast("long"), F.to_json("skill")))
    if sections is not None:
        order = Window.partitionBy("uri").orderBy(F.coalesce("section_order", F.lit(LAST_STEP)), "block")
        fit = sections.where(F.octet_length("content") <= SECTION_BUDGET).withColumn("place", F.row_number().over(order))
        rows = rows.union(fit.select("uri", F.lit(1), F.col("place").cast("long"), F.to_json(F.struct("content_type", "section_title", "language", "content"))))

    def texts(groups: pd.Series) -> pd.Series:
        out = []
        for group in groups:
            parts: dict[int, list] = {-1: [], 0: [], 1: []}
            for row in group:
                parts[row["part"]].append(json.loads(row["row"]))
            out.append(context_text(parts[-1][0], parts[0], parts[1]))
        return pd.Series(out, dtype=object)

    texts.__annotations__ = {"groups": pd.Series, "return": pd.Series}
    # a batch of many skills goes to Python at once: a call for each would take longer than its text
    whole = rows.groupBy("uri").agg(F.array_sort(F.collect_list(F.struct("part", "place", "row"))).alias("rows")).where(F.col("rows")[0]["part"] == -1)
    return whole.select("uri", F.pandas_udf(texts, "string")("rows").alias("text"))


def plan_text(plan: Mapping) -> str:
    """A plan as text, with at most three warnings."""
    lines = [f"Applicable: {'Yes' if plan['applicable'] else 'No'}"]
    if plan["recommended_skill"] is not None:
        lines.append(f"Recommended: {plan['recommended_skill']}")
    if plan["plan_steps"]:
        lines += ["Plan:", *(f"  {i}. {s['skill_id']}: {s['purpose']}" for i, s in enumerate(plan["plan_steps"], 1))]
    if plan["missing_states"]:
        lines.append("Missing states: " + ", ".join(plan["missing_states"]))
    if plan["dependency_warnings"]:
        lines.append("Warnings: " + "; ".join(plan["dependency_warnings"][:WARNINGS]))
    return "\n".join(lines)


def rules_text(rules: Iterable[Mapping]) -> str:
    """Rules, already limited, as text."""
    lines: list[str] = []
    for rule in rules:
        if text := (rule["directive_content"] or "").strip():
            lines += [node_head(rule), f"  {text}", *link_lines(rule)]
    return "\n".join(lines) if lines else "No knowledge nodes found."


def envelope(structured, text: str, error: bool = False) -> dict:
    """A response; structured content that is no object is wrapped in one."""
    return {"content": [{"type": "text", "text": text}], "structuredContent": structured if isinstance(structured, Mapping) else {"result": structured}, "isError": error}
