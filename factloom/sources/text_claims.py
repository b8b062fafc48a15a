"""Path and structure claims in Markdown, wiki and HTML pages."""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from functools import reduce
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.paths import ancestors, collapse, glob_folder, glob_pattern, glob_regex, parent, under
from ..functions.text import numbered
from ..operators import fences as N

#: What makes a reference a path, where claims are not read, sections and their meaning, the fence of structural claims.
EXTENSIONS = (".md", ".py", ".html", ".yml", ".yaml", ".json", ".toml", ".txt")
SECTIONS = {"canonical sources": "canonical_source", "concepts": "concept_page", "required synchronization": "sync_target"}
EVIDENCE = "evidence:"
KINDS = ("defines", "calls", "contains")


def _known(path: Column) -> Column:
    out = F.lit(False)
    for e in EXTENSIONS:
        out = out | path.endswith(e)
    return out


def candidates(lines: DataFrame) -> DataFrame:
    """lines (text, ...) with kind and candidate of every link that is no image and every code span."""
    link = r"(!?)\[[^\]]*\]\(([^)]+)\)"
    pairs = F.arrays_zip(F.regexp_extract_all("text", F.lit(link), 1).alias("image"), F.regexp_extract_all("text", F.lit(link), 2).alias("to"))
    links = F.transform(F.filter(pairs, lambda p: p["image"] == ""), lambda p: F.struct(F.lit("link").alias("kind"), F.regexp_replace(F.regexp_extract(p["to"], r"^\s*(\S+)", 1), r"^[<>]+|[<>]+$", "").alias("candidate")))
    codes = F.transform(F.regexp_extract_all("text", F.lit("`([^`]+)`"), 1), lambda c: F.struct(F.lit("code").alias("kind"), F.trim(c).alias("candidate")))
    return lines.withColumn("c", F.explode(F.concat(links, codes))).select("*", "c.kind", "c.candidate").drop("c")


def references(found: DataFrame, wiki: bool = False) -> DataFrame:
    """candidates with path and fragment, only of those that are shaped like a path; wiki pages are more permissive."""
    text = F.replace(F.trim("candidate"), F.lit("\\"), F.lit("/"))
    head = F.substring_index(text, "#", 1)
    split = found.withColumn("t", text).withColumn("path", F.substring_index(head, "?", 1)).withColumn("fragment", F.when(F.instr(text, "#") > 0, F.regexp_replace(text, "^[^#]*#", "")).otherwise(""))
    shaped = F.col("path").rlike(r"(?U)^[\w./*-]+$" if wiki else r"(?U)^[\w./-]+$") & ~F.col("t").contains("://") & ~F.col("t").startswith("#") & ~F.col("t").startswith("mailto:")
    slash, known = F.col("path").contains("/"), _known(F.col("path"))
    code = slash if wiki else slash & known
    return split.where(shaped & F.when(F.col("kind") == "code", code).otherwise(slash | known)).drop("t", "candidate")


def resolved(found: DataFrame, disk: DataFrame, derived: Sequence[str] = ("wiki",)) -> DataFrame:
    """references with path from the root and exists: links from their page, code spans from the root or else their page.

    Paths that leave the root are dropped; derived output counts as absent.
    """
    is_derived = lambda p: reduce(lambda a, d: a | under(p, F.lit(d)), derived, F.lit(False))
    from_root = collapse(F.regexp_replace("path", "^/+", ""))
    from_page = collapse(F.concat_ws("/", parent(F.col("source")), F.col("path")))
    there = disk.select(F.col("path").alias("p")).distinct()
    placed = found.withColumn("a", from_root).withColumn("b", from_page)
    placed = placed.join(there.select(F.col("p").alias("a"), F.lit(True).alias("a_there")), "a", "left").join(there.select(F.col("p").alias("b"), F.lit(True).alias("b_there")), "b", "left")
    a_there = F.coalesce("a_there", F.lit(False)) & ~is_derived(F.col("a"))
    own = F.when(F.col("path").startswith("/"), F.col("a")).when(F.col("kind") == "link", F.col("b")).when(a_there, F.col("a")).when(F.coalesce("b_there", F.lit(False)), F.col("b")).otherwise(F.col("a"))
    full = placed.withColumn("to", own).where("to is not null and to <> ''")
    exists = ~is_derived(F.col("to")) & F.when(F.col("to") == F.col("a"), F.coalesce("a_there", F.lit(False))).otherwise(F.coalesce("b_there", F.lit(False)))
    return full.withColumn("exists", exists).withColumn("path", F.col("to")).drop("a", "b", "a_there", "b_there", "to")


def _prose(pages: DataFrame) -> DataFrame:
    """Lines outside of fences."""
    return N.blocks(numbered(pages), N.toggles(F.col("text"))).where("role = 'text' and block is null").select("source", "line", "text")


def doc_claims(contents: DataFrame, disk: DataFrame, skip: Sequence[str] = (), derived: Sequence[str] = ("wiki",)) -> DataFrame:
    """source, line, path, fragment, kind, exists of the references of .md files outside fences."""
    pages = contents.where("endswith(path, '.md') and content is not null")
    for prefix in skip:
        pages = pages.where(~F.col("path").startswith(prefix))
    return resolved(references(candidates(_prose(pages))), disk, derived).select("source", "line", "path", "fragment", "kind", "exists").distinct()


def wiki_claims(contents: DataFrame, disk: DataFrame, root: str, derived: Sequence[str] = ("wiki",)) -> DataFrame:
    """source, line, concept, kind, path, path_kind, exists: what a wiki page says of paths by section."""
    lines = _prose(contents.where(under(F.col("path"), F.lit(root)) & F.col("path").endswith(".md") & F.col("content").isNotNull()))
    text = F.trim("text")
    heading = F.when(text.startswith("#"), F.lower(F.trim(F.regexp_replace(text, r"^#+|#+$", ""))))
    meaning = F.create_map(*[F.lit(x) for kv in SECTIONS.items() for x in kv])
    above = W.partitionBy("source").orderBy("line").rowsBetween(W.unboundedPreceding, W.currentRow)
    mark = F.when(heading.isNotNull(), F.coalesce(meaning[heading], F.lit(""))).when(F.lower(text) == EVIDENCE, "evidence")
    stated = lines.withColumn("mark", mark).withColumn("section", F.last("mark", ignorenulls=True).over(above)).where("mark is null and section <> ''").drop("mark")
    want = F.when(F.col("section") == "concept_page", "link").otherwise("code")
    found = resolved(references(candidates(stated).where(F.col("kind") == want), wiki=True), disk, derived)
    globbed = F.col("path").contains("*")
    claims = found.select("source", "line", F.regexp_replace(F.substring_index("source", "/", -1), r"\.[^.]*$", "").alias("concept"), F.col("section").alias("kind"), "path", F.when(globbed, "glob").otherwise("literal").alias("path_kind"), "exists").distinct()
    # a pattern meets what lies below the folder it names, and its expression decides
    patterns = claims.where("path_kind = 'glob'").select("path").distinct().select(F.col("path").alias("pattern"), glob_folder(F.col("path")).alias("folder"), glob_pattern(F.col("path"), crosses=False).alias("meant"))
    below = disk.select("path", F.explode(ancestors(parent(F.col("path")))).alias("folder"))
    hit = patterns.join(below, "folder").where(F.expr("path rlike meant")).select(F.col("pattern").alias("path"), F.lit(True).alias("hit")).distinct()
    claims = claims.join(hit, "path", "left").withColumn("exists", F.when(F.col("path_kind") == "glob", F.coalesce("hit", F.lit(False))).otherwise(F.col("exists"))).select(*claims.columns)
    return claims.where(_known(F.col("path")) | (F.col("path_kind") == "glob") | F.col("exists"))


class _Page(HTMLParser):
    """code texts and link targets with their places, and closed pre ranges."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[int, int, str, str]] = []
        self.closed: list[tuple[tuple[int, int], tuple[int, int]]] = []
        self.open: list[tuple[int, int]] = []
        self.code: list[tuple[int, int, list[str]]] = []

    def handle_starttag(self, tag: str, attrs: list) -> None:
        line, at = self.getpos()
        if tag == "pre":
            self.open.append((line, at))
        elif tag == "code":
            self.code.append((line, at, []))
        elif tag == "a" and (to := dict(attrs).get("href")):
            self.found.append((line, at, "link", to))

    def handle_endtag(self, tag: str) -> None:
        if tag == "pre" and self.open:
            self.closed.append((self.open.pop(), self.getpos()))
        elif tag == "code" and self.code:
            line, at, parts = self.code.pop()
            self.found.append((line, at, "code", "".join(parts).strip()))

    def handle_data(self, data: str) -> None:
        for _, _, parts in self.code[-1:]:
            parts.append(data)


def html_candidates(contents: DataFrame) -> DataFrame:
    """source, line, kind, candidate of code texts and links outside closed pre ranges."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                page = _Page()
                page.feed(content or "")
                page.close()
                out += [(path, line, kind, text) for line, at, kind, text in page.found if not any(a <= (line, at) <= b for a, b in page.closed)]
            yield pd.DataFrame(out, columns=["source", "line", "kind", "candidate"])

    return contents.select("path", "content").mapInPandas(run, "source string, line int, kind string, candidate string")


def html_claims(contents: DataFrame, disk: DataFrame, patterns: Sequence[str], derived: Sequence[str] = ("wiki",)) -> DataFrame:
    governed = F.lit(False)
    for p in patterns:
        governed = governed | F.col("path").rlike(glob_regex(p))
    pages = contents.where(F.col("path").endswith(".html") & governed)
    return resolved(references(html_candidates(pages)), disk, derived).select("source", "line", "path", "fragment", "kind", "exists").distinct()


def _node(text: Column) -> Column:
    """A node address, '' if malformed: a path, or path::class::symbol; no way out of the root."""
    node = F.regexp_replace(F.replace(F.trim(text), F.lit("\\"), F.lit("/")), r"^(\./)+", "")
    colons = F.size(F.split(node, "::")) - 1
    inside = collapse(F.substring_index(node, "::", 1))
    return F.when(colons.isin(0, 2) & inside.isNotNull() & (inside != "") & ~node.startswith("::"), node).otherwise("")


def structural_claims(contents: DataFrame, strict: bool = False) -> tuple[DataFrame, DataFrame]:
    """Claims inside claims fences of .md files, and the lines there that are none; a block that does not end is one of these if ``strict``.

    Claims: source, line, kind, subject, object, concept. A claim of two parts is split at its last arrow. A fence ends at a bare one that is
    at least as long; claims shown inside another fence are no claims.
    """
    lines = N.blocks(numbered(contents.where("endswith(path, '.md') and content is not null")), N.nested(F.col("text")))
    claims, wrong = _claims_of(lines.where("role = 'text' and block = 'claims'"))
    if strict:
        endless = N.left_open(lines).where("block = 'claims'").select("source", "line", F.lit(f"unterminated {N.CLAIMS} block").alias("detail"))
        wrong = wrong.unionByName(endless)
    return claims, wrong


#: The attribute of a block of claims in a page, which documents can be live, and the folders whose documents never are.
CLAIMS_ATTRIBUTE = "data-atlas-claims"
LIVE = (".md", ".html")
NEVER_LIVE = (".trellis/tasks/archive/", ".trellis/workspace/")


class _ClaimsBlocks(HTMLParser):
    """Numbered lines of closed pre elements that carry claims."""

    def __init__(self) -> None:
        super().__init__()
        self.lines: list[tuple[int, str]] = []
        self.block: list[tuple[int, str]] | None = None

    def handle_starttag(self, tag: str, attrs: list) -> None:
        if tag == "pre" and CLAIMS_ATTRIBUTE in dict(attrs):
            self.block = []

    def handle_endtag(self, tag: str) -> None:
        if tag == "pre" and self.block is not None:
            self.lines, self.block = self.lines + self.block, None

    def handle_data(self, data: str) -> None:
        if self.block is not None:
            first = self.getpos()[0]
            self.block += [(first + i, line) for i, line in enumerate(data.splitlines())]


def _html_blocks(contents: DataFrame) -> DataFrame:
    """source, line, text inside the blocks of claims of pages."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                page = _ClaimsBlocks()
                page.feed(content or "")
                page.close()
                out += [(path, line, text) for line, text in page.lines]
            yield pd.DataFrame(out, columns=["source", "line", "text"])

    return contents.select("path", "content").mapInPandas(run, "source string, line int, text string")


def live_documents(files: DataFrame, patterns: Sequence[str]) -> DataFrame:
    """files (path, ...) that a pattern names as live documents; patterns of other endings name none."""
    wanted = reduce(lambda a, p: a | F.col("path").rlike(glob_regex(p)), [p for p in patterns if p.endswith(LIVE)], F.lit(False))
    for prefix in NEVER_LIVE:
        wanted = wanted & ~F.col("path").startswith(prefix)
    return files.where(wanted & (F.col("path").endswith(LIVE[0]) | F.col("path").endswith(LIVE[1])))


def live_claims(contents: DataFrame, patterns: Sequence[str]) -> tuple[DataFrame, DataFrame]:
    """Claims of live documents (.md, .html), and what is wrong with them: lines that are no claims and blocks that do not end."""
    live = live_documents(contents, patterns)
    claims, wrong = structural_claims(live, strict=True)
    more, others = _claims_of(_html_blocks(live.where("endswith(path, '.html')")))
    return claims.unionByName(more), wrong.unionByName(others)


def _claims_of(lines: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The grammar of a claim over lines (source, line, text): claims, and lines (source, line, detail) that are none; empty lines are neither."""
    inside = lines.where(F.trim("text") != "")
    kind = F.trim(F.substring_index("text", ":", 1))
    rest = F.trim(F.regexp_replace("text", "^[^:]*:", ""))
    left, right = F.regexp_extract(rest, r"^(.*) -> (.*)$", 1), F.regexp_extract(rest, r"^(.*) -> (.*)$", 2)
    parsed = inside.select(
        "source",
        "line",
        "text",
        F.when(F.col("text").contains(":") & kind.isin(*KINDS), kind).alias("kind"),
        F.when(kind == "defines", _node(right)).when(kind == "calls", _node(left)).otherwise(_node(rest)).alias("subject"),
        F.when(kind == "calls", _node(right)).otherwise("").alias("object"),
        F.when(kind == "defines", F.trim(left)).otherwise("").alias("concept"),
    )
    good = F.col("kind").isNotNull() & (F.col("subject") != "") & ((F.col("kind") != "calls") | (F.col("object") != "")) & ((F.col("kind") != "defines") | (F.col("concept") != ""))
    return parsed.where(good).drop("text"), parsed.where(~good).select("source", "line", F.trim("text").alias("detail"))


def generated_claims(contents: DataFrame) -> tuple[DataFrame, DataFrame]:
    """unit: and roadmap: lines (source, line, kind, subject, value) of claims fences, and pages (source, has_block)."""
    pages = contents.where("endswith(path, '.md') and content is not null")
    lines = N.blocks(numbered(pages), N.generated(F.col("text")))
    inside = lines.where("role = 'text' and block = 'claims'")
    found = inside.select("source", "line", *[F.regexp_extract("text", r"^\s*(unit|roadmap):\s*(.*?) -> (.*?)\s*$", i).alias(n) for i, n in ((1, "kind"), (2, "subject"), (3, "value"))]).where("kind <> ''")
    blocks = lines.where("role = 'open'").select("source").distinct().withColumn("has_block", F.lit(True))
    return found, pages.select(F.col("path").alias("source")).join(blocks, "source", "left").select("source", F.coalesce("has_block", F.lit(False)).alias("has_block"))
