"""Markdown documents as blocks and sections, in adjacency rows.

A document is tokenised where it lies by a line-based reader of the block grammar: front matter, headings, fences, tables, lists, quotes,
HTML and paragraphs. Nesting is kept in `parent_block_id`, since rows can't recur.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Generator, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from graphwright.sources.scratch import stored

# Fence languages that are flowcharts, and those that may hold a template.
CHARTS = {"dot": "graphviz", "graphviz": "graphviz", "mermaid": "mermaid"}
NEUTRAL = ("", "text", "markdown", "md", "prompt", "jinja", "j2", "jinja2", "template")
#: Characters of what a block's id begins with.
LONGEST = 400
VARIABLE = re.compile(r"\{([A-Za-z_]\w*)\}")

BLOCKS = "block_id string, parent_block_id string, block_type string, line_start int, line_end int, content_order int, level int, language string, content string, caption string, row_count int, attribution string, variables array<string>, position int"


@dataclass
class Block:
    block_id: str
    block_type: str
    line_start: int
    line_end: int
    content: str = ""
    parent_block_id: str | None = None
    level: int | None = None
    language: str | None = None
    caption: str | None = None
    row_count: int | None = None
    attribution: str | None = None
    variables: list[str] = field(default_factory=list)
    position: int | None = None
    content_order: int = 0


_HEADING = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})\s*([^`\s]*)[^`]*$")
_ITEM = re.compile(r"( *)([-*+]|\d{1,9}[.)])(?:[ \t]+(.*)|$)")
_RULE = re.compile(r" {0,3}([-*_])(?:[ \t]*\1){2,}[ \t]*$")
_TABLE_LINE = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_HTML = re.compile(r" {0,3}<(?:/?[A-Za-z][\w-]*[\s>/]|/?[A-Za-z][\w-]*$|!--|\?|![A-Z])")


def fence_block(number: str, language: str, content: str, start: int, end: int) -> Block:
    """A fence is a flowchart, a template (a neutral language and variables in braces) or code."""
    name = language.lower()
    if name in CHARTS:
        return Block(number, "flowchart", start, end, content, language=CHARTS[name])
    found = list(dict.fromkeys(VARIABLE.findall(content)))
    if name in NEUTRAL and found:
        return Block(number, "template", start, end, content, language=name or None, variables=found)
    return Block(number, "code_block", start, end, content, language=name or None)


class Reader:
    """Blocks of one text, ids blk_1, blk_2 and so on in order; children of items are blk_n_item_k, and blocks in them begin with that.

    Items are texts of their own. Reading one asks for its reader's blocks and waits for them on a stack of readers, so lists may be nested to any depth. What ids begin with is
    replaced by its hash where lists are nested so deep that it has more than LONGEST characters.
    """

    def __init__(self, text: str, item: str | None = None, above: int = 0):
        self.lines = text.replace("\r\n", "\n").replace("\r", "\n").split("\n")
        self.blocks: list[Block] = []
        self.made, self.item, self.above = 0, item, above
        self.begin = "" if item is None else f"{item}_"
        if len(self.begin) > LONGEST:
            self.begin = f"blk_{hashlib.sha256(item.encode()).hexdigest()[:32]}_"

    def _new(self) -> str:
        """The id of the next top-level block."""
        self.made += 1
        return f"{self.begin}blk_{self.made}"

    def _filled(self, at: int, step: int) -> str | None:
        """The next line that isn't blank, from a place on, forwards or backwards."""
        while 0 <= at < len(self.lines):
            if self.lines[at].strip():
                return self.lines[at]
            at += step
        return None

    def read(self) -> list[Block]:
        waiting, found = [self._steps()], None
        while waiting:
            try:
                waiting.append(waiting[-1].send(found)._steps())
                found = None
            except StopIteration as done:
                waiting.pop()
                found = done.value
        return found

    def _steps(self) -> Generator[Reader, list[Block], list[Block]]:
        """Yields the readers of items, and is sent their blocks."""
        at = 0
        if self.lines and self.lines[0].strip() == "---":
            end = next((i for i in range(1, len(self.lines)) if self.lines[i].strip() == "---"), None)
            if end is not None:
                self.blocks.append(Block(self._new(), "frontmatter", 1, end + 1, "\n".join(self.lines[1:end])))
                at = end + 1
        while at < len(self.lines):
            at = yield from self._block(at)
        for b in self.blocks:
            if b.parent_block_id is None:
                b.parent_block_id, b.line_start, b.line_end = self.item, b.line_start + self.above, b.line_end + self.above
        if self.item is None:
            for i, b in enumerate(self.blocks):
                b.content_order = i + 1
        return self.blocks

    def _starts(self, line: str) -> bool:
        return not line.strip() or bool(_HEADING.match(line) or _FENCE.match(line) or _RULE.match(line) or line.lstrip().startswith(">") or _HTML.match(line)) or bool((m := _ITEM.match(line)) and (m[3] or "") and len(m[1]) < 4)

    def _block(self, at: int) -> Generator[Reader, list[Block], int]:
        line = self.lines[at]
        if not line.strip() or _RULE.match(line):
            return at + 1
        if m := _HEADING.match(line):
            self.blocks.append(Block(self._new(), "heading", at + 1, at + 1, (m[2] or "").strip(), level=len(m[1])))
            return at + 1
        if m := _FENCE.match(line):
            end = next((i for i in range(at + 1, len(self.lines)) if re.match(rf" {{0,3}}{re.escape(m[2][0])}{{{len(m[2])},}}[ \t]*$", self.lines[i])), len(self.lines))
            cut = re.compile(f" {{0,{len(m[1])}}}")
            body = "\n".join(cut.sub("", x, count=1) for x in self.lines[at + 1 : end])
            self.blocks.append(fence_block(self._new(), m[3], body, at + 1, min(end + 1, len(self.lines))))
            return end + 1
        if self._table_at(at):
            return self._table(at)
        if line.lstrip().startswith(">") and len(line) - len(line.lstrip()) < 4:
            return self._quote(at)
        if (m := _ITEM.match(line)) and len(m[1]) < 4:
            return (yield from self._list(at, m))
        if _HTML.match(line):
            end = at
            while end < len(self.lines) and self.lines[end].strip():
                end += 1
            self.blocks.append(Block(self._new(), "html_block", at + 1, end, "\n".join(self.lines[at:end]).strip()))
            return end
        end = at + 1
        while end < len(self.lines) and not self._starts(self.lines[end]) and not self._table_at(end) and not re.match(r" {0,3}(=+|-+)[ \t]*$", self.lines[end]):
            end += 1
        text = "\n".join(x.strip() for x in self.lines[at:end])
        if end < len(self.lines) and re.match(r" {0,3}(=+|-+)[ \t]*$", self.lines[end]):
            self.blocks.append(Block(self._new(), "heading", at + 1, end + 1, text, level=1 if "=" in self.lines[end] else 2))
            return end + 1
        tags = sum(map(len, re.findall(r"</?[A-Za-z][^<>]*>|<!--.*?-->", text)))
        kind = "html_block" if tags and tags >= len(text) - tags else "paragraph"
        self.blocks.append(Block(self._new(), kind, at + 1, end, text))
        return end

    def _table_at(self, at: int) -> bool:
        return "|" in self.lines[at] and at + 1 < len(self.lines) and "-" in self.lines[at + 1] and bool(_TABLE_LINE.match(self.lines[at + 1]))

    def _table(self, at: int) -> int:
        end = at + 2
        while end < len(self.lines) and "|" in self.lines[end] and self.lines[end].strip():
            end += 1
        before = self._filled(at - 1, -1)
        caption = None if before is None or before.strip().startswith("|") else before.strip().rstrip(":")
        self.blocks.append(Block(self._new(), "table", at + 1, end, "\n".join(self.lines[at:end]), caption=caption, row_count=end - at - 2))
        return end

    def _quote(self, at: int) -> int:
        end = at
        while end < len(self.lines) and self.lines[end].strip() and (self.lines[end].lstrip().startswith(">") or not self._starts(self.lines[end])):
            end += 1
        inner = [re.sub(r"^ {0,3}> ?", "", x) for x in self.lines[at:end]]
        attribution = inner[-1].strip().lstrip("—").strip() if inner[-1].strip().startswith("—") else None
        self.blocks.append(Block(self._new(), "blockquote", at + 1, end, "\n".join(inner[:-1] if attribution is not None else inner).strip(), attribution=attribution))
        return end

    def _list(self, at: int, first: re.Match[str]) -> Generator[Reader, list[Block], int]:
        ordered = first[2][0].isdigit()
        indent = len(first[1])
        items: list[tuple[int, int, list[str]]] = []
        end = at
        while end < len(self.lines):
            line = self.lines[end]
            m = _ITEM.match(line)
            inside = len(line) - len(line.lstrip()) > indent
            if m and len(m[1]) <= indent + 1 and not _RULE.match(line):
                if m[2][0].isdigit() != ordered:
                    break
                items.append((end, len(m[1]) + len(m[2]) + 1, [m[3] or ""]))
            elif not line.strip():
                ahead = self._filled(end + 1, 1)
                m = _ITEM.match(ahead) if ahead is not None else None
                same = m and len(m[1]) <= indent + 1 and m[2][0].isdigit() == ordered
                if not same and (ahead is None or len(ahead) - len(ahead.lstrip()) <= indent):
                    break
                items[-1][2].append("")
            elif inside or not self._starts(line):
                cut = items[-1][1]
                items[-1][2].append(line[cut:] if not line[:cut].strip() else line.lstrip())
            else:
                break
            end += 1
        number = self._new()
        texts = []
        children: list[Block] = []
        for k, (start, _, lines) in enumerate(items, 1):
            item = f"{number}_item_{k}"
            inner = yield Reader("\n".join(lines), item, self.above + start)
            head = inner[0].content if inner and inner[0].block_type == "paragraph" else ""
            texts.append(head)
            children.append(Block(item, "procedure_step" if ordered else "bullet_item", self.above + start + 1, self.above + start + len(lines), head, parent_block_id=number, position=k))
            children += inner[1:] if head else inner
        last = max(i for i in range(at, end) if self.lines[i].strip())
        self.blocks.append(Block(number, "ordered_procedure" if ordered else "bullet_list", at + 1, last + 1, "\n".join(texts)))
        self.blocks += children
        return end


def parse(text: str | None) -> list[Block]:
    """The blocks of a text; none of a null or blank one."""
    return Reader(text).read() if text and text.strip() else []


def blocks(docs: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each block of each document, with the document's id."""
    kind = docs.schema[id_column].dataType.simpleString()
    names = [c.split()[0] for c in BLOCKS.split(", ")]

    def batches(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            found = [(i, b) for i, t in enumerate(batch.column(1).to_pylist()) for b in parse(t)]
            types = {"variables": pa.list_(pa.string())} | {n: pa.int32() for n in ("line_start", "line_end", "content_order", "level", "row_count", "position")}
            columns = {n: pa.array([getattr(b, n) for _, b in found], types.get(n, pa.string())) for n in names}
            yield pa.RecordBatch.from_pydict({"doc_id": batch.column(0).take(pa.array([i for i, _ in found], pa.int64()))} | columns)

    return docs.select(id_column, text_column).mapInArrow(batches, f"doc_id {kind}, {BLOCKS}")


def sections(found: DataFrame) -> DataFrame:
    """(doc_id, section_id, parent_section_id, title, level, ord): the tree of headings; level 0 is what stands before the first, if anything does.

    A heading's parent is the last one before it of a lower level. That is one window for each level, six at most.
    """
    order = Window.partitionBy("doc_id").orderBy("line_start").rowsBetween(Window.unboundedPreceding, -1)
    heads = found.where("block_type = 'heading' and parent_block_id is null").select("doc_id", F.col("block_id").alias("section_id"), F.col("content").alias("title"), "level", "line_start")
    nearest = [F.last(F.when(F.col("level") == n, F.struct("line_start", "section_id")), True).over(order) for n in range(1, 6)]
    parent = F.greatest(F.lit(None).cast(heads.select(F.struct("line_start", "section_id").alias("x")).schema["x"].dataType), *[F.when(F.col("level") > n, x) for n, x in enumerate(nearest, 1)])
    rows = heads.select("*", parent.alias("parent")).select("doc_id", "section_id", F.col("parent.section_id").alias("parent_section_id"), "title", "level", "line_start")
    first = heads.groupBy("doc_id").agg(F.min("line_start").alias("first"))
    before = found.where("parent_block_id is null and block_type not in ('heading', 'frontmatter')").join(first, "doc_id", "left").where("first is null or line_start < first").select("doc_id").distinct()
    rows = rows.union(before.select("doc_id", F.lit("preamble"), F.lit(None).cast("string"), F.lit(""), F.lit(0), F.lit(0)))
    return rows.withColumn("ord", F.row_number().over(Window.partitionBy("doc_id").orderBy("line_start"))).drop("line_start")


def in_sections(found: DataFrame) -> DataFrame:
    """Top-level blocks other than headings, with their section and their order in it."""
    order = Window.partitionBy("doc_id").orderBy("line_start", "block_id")
    marked = found.where("parent_block_id is null").withColumn("section_id", F.coalesce(F.last(F.when(F.col("block_type") == "heading", F.col("block_id")), True).over(order), F.lit("preamble")))
    rows = marked.where("block_type <> 'heading'")
    return rows.withColumn("content_order", F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy("line_start", "block_id")))


def coverage(docs: DataFrame, found: DataFrame, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """(doc_id, lines, covered, share): lines that blocks cover, of those that aren't blank or rules; 100 percent of none."""
    lines = docs.select(F.col(id_column).alias("doc_id"), F.posexplode(F.split(F.coalesce(F.col(text_column), F.lit("")), "\n")).alias("n", "line"))
    lines = lines.where((F.trim("line") != "") & ~F.trim("line").isin("---", "***", "___")).select("doc_id", (F.col("n") + 1).alias("n"))
    held = found.where("parent_block_id is null").select("doc_id", F.explode(F.sequence("line_start", "line_end")).alias("n")).distinct().withColumn("hit", F.lit(1))
    counts = lines.join(held, ["doc_id", "n"], "left").groupBy("doc_id").agg(F.count("*").alias("lines"), F.count("hit").alias("covered"))
    return docs.select(F.col(id_column).alias("doc_id")).join(counts, "doc_id", "left").select("doc_id", F.coalesce("lines", F.lit(0)).alias("lines"), F.coalesce("covered", F.lit(0)).alias("covered"), F.coalesce(F.col("covered") * 100.0 / F.col("lines"), F.lit(100.0)).alias("share"))


def frontmatter(raw: Column) -> Column:
    """map<string, string> of the `key: value` lines of front matter, quotes taken off."""
    pairs = F.filter(F.transform(F.split(raw, "\n"), lambda x: F.struct(F.regexp_extract(x, "^([\\w-]+):\\s*(.*)$", 1).alias("k"), F.trim(F.regexp_replace(F.regexp_extract(x, "^([\\w-]+):\\s*(.*)$", 2), "^[\"']|[\"']$", "")).alias("v"))), lambda p: p["k"] != "")
    keys = F.array_distinct(F.transform(pairs, lambda p: p["k"]))
    return F.map_from_arrays(keys, F.transform(keys, lambda k: F.element_at(F.filter(pairs, lambda p: p["k"] == k), -1)["v"]))


def html_headings(pages: DataFrame, id_column: str = "page_id", html_column: str = "html") -> DataFrame:
    """(page_id, n, level, title): headings of HTML pages in order. An extension."""
    found = F.regexp_extract_all(html_column, F.lit("(?is)<h([1-6])[^>]*>.*?</h[1-6]>"), 0)
    rows = pages.select(F.col(id_column).alias("page_id"), F.posexplode(found).alias("n", "h"))
    return rows.select("page_id", "n", F.regexp_extract("h", "(?i)^<h([1-6])", 1).cast("int").alias("level"), F.trim(F.regexp_replace("h", "(?s)<[^>]*>", "")).alias("title"))


# The lists that content of sections is sorted into, by kind of block.
LISTS = {"code_block": "code_blocks", "table": "tables", "flowchart": "flowcharts", "ordered_procedure": "procedures", "template": "templates"}


def flat_lists(found: DataFrame) -> DataFrame:
    """(doc_id, list, idx, block_id, content, language, caption, row_count, variables, line_start, line_end): blocks of typed lists in the order of the section tree,
    which is that of the text, numbered from 0 in each list."""
    names = F.create_map(*[F.lit(x) for pair in LISTS.items() for x in pair])
    rows = found.where(F.col("block_type").isin(*LISTS) & F.col("parent_block_id").isNull()).withColumn("list", names[F.col("block_type")])
    order = Window.partitionBy("doc_id", "list").orderBy("line_start", "block_id")
    return rows.select("doc_id", "list", (F.row_number().over(order) - 1).alias("idx"), "block_id", "content", "language", "caption", "row_count", "variables", "line_start", "line_end")


def hydrate(skeleton: DataFrame, found: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Sections and their content from a skeleton of block ids and the blocks.

    skeleton: (doc_id, node, parent_node, ord, block_id), ord giving the order of a document's nodes in the walk of the tree. Nodes whose block is missing or is a child
    of a list item are left out with all below them. A heading is a section under its parent's; whatever stands at the root without being one goes to a preamble of
    level 0. Returns (doc_id, section_id, parent_section_id, title, level, ord) and (doc_id, section_id, block_id, content_order). One join to blocks, then a
    join for each level of the tree.
    """
    blocks_ = found.select("doc_id", "block_id", "block_type", "parent_block_id", F.col("content").alias("title"), "level")
    nodes = skeleton.join(blocks_, ["doc_id", "block_id"]).where("parent_block_id is null").drop("parent_block_id")
    heading = F.col("block_type") == "heading"
    here = F.when(heading, F.col("block_id"))
    front = nodes.where("parent_node is null").select("doc_id", "node", "block_id", "ord", "title", "level", heading.alias("heading"), F.coalesce(here, F.lit("preamble")).alias("section_id"), F.when(heading, F.lit(None).cast("string")).otherwise(F.lit("preamble")).alias("within"))
    front = every = stored(front)
    while not front.isEmpty():
        below = nodes.join(front.select("doc_id", F.col("node").alias("parent_node"), F.col("section_id").alias("up")), ["doc_id", "parent_node"])
        front = stored(below.select("doc_id", "node", "block_id", "ord", "title", "level", heading.alias("heading"), F.coalesce(here, F.col("up")).alias("section_id"), F.col("up").alias("within")))
        every = every.union(front)
    order = Window.partitionBy("doc_id", "parent_section_id").orderBy("ord")
    heads = every.where("heading").select("doc_id", "section_id", F.col("within").alias("parent_section_id"), "title", "level", "ord").withColumn("ord", F.row_number().over(order))
    preamble = every.where("not heading and section_id = 'preamble'").select("doc_id").distinct()
    sections_ = heads.union(preamble.select("doc_id", F.lit("preamble"), F.lit(None).cast("string"), F.lit(""), F.lit(0), F.lit(0)))
    content = every.where("not heading").withColumn("content_order", F.row_number().over(Window.partitionBy("doc_id", "section_id").orderBy("ord"))).select("doc_id", "section_id", "block_id", "content_order")
    return sections_, content
