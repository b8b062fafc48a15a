"""Path predicates and rewrites as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def under(path: Column, root: Column) -> Column:
    """Whether path is root or below it; the empty root holds everything. Siblings such as a/bc of a/b are not."""
    return (root == "") | (path == root) | path.startswith(F.concat(root, F.lit("/")))


def ancestors(path: Column) -> Column:
    """The path, its parents, and the root '' last. An equi-join on these replaces a prefix join."""
    parts = F.split(path, "/")
    full = F.transform(F.sequence(F.size(parts), F.lit(1), F.lit(-1)), lambda n: F.call_function("substring_index", path, F.lit("/"), n))
    return F.array_distinct(F.concat(full, F.array(F.lit(""))))


def normalise(path: Column) -> Column:
    """Trimmed, slashes forward, '.' and './' to '', one leading './' and trailing '/' dropped."""
    cleaned = F.replace(F.trim(path), F.lit("\\"), F.lit("/"))
    return F.when(cleaned.isin(".", "./"), F.lit("")).otherwise(F.regexp_replace(F.regexp_replace(cleaned, r"^\./", ""), r"/+$", ""))


def collapse(path: Column) -> Column:
    """'.' and '..' steps resolved; null where the path leaves the root."""
    start = F.struct(F.array().cast("array<string>").alias("kept"), F.lit(False).alias("left"))

    def step(state: Column, part: Column) -> Column:
        kept = state["kept"]
        up = F.struct(F.slice(kept, F.lit(1), F.greatest(F.size(kept) - 1, F.lit(0))).alias("kept"), (state["left"] | (F.size(kept) == 0)).alias("left"))
        same = F.struct(kept.alias("kept"), state["left"].alias("left"))
        more = F.struct(F.concat(kept, F.array(part)).alias("kept"), state["left"].alias("left"))
        return F.when(part == "..", up).when(part.isin("", "."), same).otherwise(more)

    return F.aggregate(F.split(path, "/"), start, step, lambda s: F.when(~s["left"], F.array_join(s["kept"], "/")))


def parent(path: Column) -> Column:
    return F.when(F.instr(path, "/") > 0, F.regexp_replace(path, r"/[^/]*$", "")).otherwise(F.lit(""))


def literal_head(pattern: Column) -> Column:
    """What stands before the first glob character."""
    return F.regexp_extract(pattern, r"^[^*?\[]*", 0)


def is_glob(pattern: Column) -> Column:
    return pattern.rlike(r"[*?\[]")


def glob_regex(pattern: str, crosses: bool = True) -> str:
    """A Java regular expression for a glob; ``crosses`` says whether * and ? match a slash."""
    out, i = "(?s)", 0
    any_char = "." if crosses else "[^/]"
    while i < len(pattern):
        c = pattern[i]
        i += 1
        if c == "*" and not crosses and pattern[i : i + 1] == "*":
            i += 1
            if pattern[i : i + 1] == "/":
                i += 1
                out += "(?:.*/)?"
            else:
                out += ".*"
        elif c == "*":
            out += any_char + "*"
        elif c == "?":
            out += any_char
        elif c == "[" and (end := pattern.find("]", i + 1 + (pattern[i : i + 1] == "!"))) > 0:
            body = pattern[i:end].replace("\\", "\\\\").replace("[", "\\[").replace("&", "\\&")
            out += "[" + ("^" + body[1:] if body.startswith("!") else body) + "]"
            i = end + 1
        else:
            out += c if c.isalnum() or c in "/_- " else "\\" + c
    return f"^(?:{out})\\z" if not out.startswith("(?s)") else f"(?s)^(?:{out[4:]})\\z"


def matches(path: Column, pattern: str, crosses: bool = True) -> Column:
    return path.rlike(glob_regex(pattern, crosses))


def shared_head(a: Column, b: Column) -> Column:
    """How many leading components two paths share."""
    pairs = F.zip_with(F.split(a, "/"), F.split(b, "/"), lambda x, y: F.coalesce(x == y, F.lit(False)))
    return F.array_position(F.concat(pairs, F.array(F.lit(False))), False) - 1


def _glob_pieces(pattern: Column, crosses: bool = True) -> Column:
    """The stars, single wild characters, classes and literal characters of a glob, in order."""
    deep = "" if crosses else r"\*\*/?|"
    return F.regexp_extract_all(pattern, F.lit(rf"(?s)({deep}\[!?+\]?+[^\]]*\]|.)"), 1)


def glob_anchor(pattern: Column) -> Column:
    """Where a text that a glob (* crosses slashes) matches must hold the glob's longest literal run before its first star or after its last.

    run; back (counted from the end), skip (characters between that side and the run), size (of the run); whole (how long the text is, -1: any).
    """
    pieces = _glob_pieces(pattern)
    first, last = (F.array_position(p, "*").cast("int") for p in (pieces, F.reverse(pieces)))
    # a literal NUL counts as wild, which only leaves the run shorter
    fixed = lambda own: F.array_join(F.transform(own, lambda p: F.when((p == "?") | (F.length(p) > 1), "\x00").otherwise(p)), "")
    longest = lambda side: F.aggregate(F.split(side, "\\x00"), F.lit(""), lambda a, x: F.when(F.length(x) > F.length(a), x).otherwise(a))
    head = fixed(F.when(first > 0, F.slice(pieces, F.lit(1), first - 1)).otherwise(pieces))
    tail = fixed(F.when(last > 0, F.slice(pieces, F.size(pieces) - last + 2, last - 1)).otherwise(pieces))

    def place(side: Column, back: bool) -> Column:
        run = longest(side)
        before = F.call_function("instr", side, run) - 1
        skip = F.length(side) - before - F.length(run) if back else before
        skip = F.when(F.length(run) > 0, skip).otherwise(0)
        return F.struct(run.alias("run"), F.lit(back).alias("back"), skip.cast("int").alias("skip"), F.length(run).alias("size"), F.when(first > 0, -1).otherwise(F.size(pieces)).alias("whole"))

    ahead, behind = place(head, False), place(tail, True)
    return F.when(ahead["size"] >= behind["size"], ahead).otherwise(behind)


def glob_pattern(pattern: Column, crosses: bool = True) -> Column:
    """``glob_regex`` for a column of patterns: for tables of rules."""
    pieces = _glob_pieces(pattern, crosses)

    def said(piece: Column) -> Column:
        inner = F.substr(piece, F.lit(2), F.length(piece) - 2)
        negated = inner.startswith("!")
        body = F.regexp_replace(F.when(negated, F.substr(inner, F.lit(2))).otherwise(inner), r"([\\\[\]&^])", r"\\$1")
        listed = F.concat(F.lit("["), F.when(negated, "^").otherwise(""), body, F.lit("]"))
        plain = F.when(piece.rlike(r"[A-Za-z0-9/_\- ]"), piece).when(piece.rlike(r"[\x00-\x7F]"), F.concat(F.lit("\\"), piece)).otherwise(piece)
        some = "." if crosses else "[^/]"
        said = F.when(piece == "*", some + "*").when(piece == "?", some)
        if not crosses:
            said = said.when(piece == "**/", "(?:.*/)?").when(piece == "**", ".*")
        return said.when(F.length(piece) > 2, listed).otherwise(plain)

    return F.concat(F.lit("(?s)^(?:"), F.array_join(F.transform(pieces, said), ""), F.lit(r")\z"))


def glob_folder(pattern: Column) -> Column:
    """The folders that everything a pattern matches lies below: what stands before the last slash of its literal head."""
    head = literal_head(pattern)
    return F.when(F.instr(head, "/") > 0, F.regexp_replace(head, r"/[^/]*$", "")).otherwise(F.lit(""))
