"""Languages as entries of one table: each gives events, and one pass over the contents deals files to them by extension."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import code as K
from .python_events import EVENTS, events_of

FAILED, UNREADABLE, PARSED = (("failed", "", "", 0, None, None, None, 0, False), ("unreadable", "", "", 0, None, None, None, 0, False), ("parsed", "", "", 0, None, None, None, 0, False))

#: What a schema file is made of: comments, texts, words, and signs that matter. A text or comment that does not end is none of these.
_PROTO = re.compile(r"//[^\n]*|/\*.*?\*/|(?P<text>\"(?:\\.|[^\"\\\n])*\"|'(?:\\.|[^'\\\n])*')|(?P<word>[A-Za-z_][\w.]*)|(?P<sign>[{};=])|(?P<bad>/\*|[\"'])|\s+|.", re.S)
_DEFINES = ("message", "enum", "service")


def proto_events(source: str) -> Iterator[tuple]:
    """Events of a protocol buffer schema: its outermost messages, enums and services, and the files it imports.

    Braces that do not match, texts and comments that do not end make the file a failed one, with no other event.
    """
    out, line, depth, statement = [PARSED], 1, 0, []
    for m in _PROTO.finditer(source):
        kind, text, at = m.lastgroup, m.group(), line
        line += text.count("\n")
        if kind == "bad":
            return iter([FAILED])
        if kind == "sign" and text in "{};":
            words = [w for _, w, _ in statement]
            if depth == 0 and text == "{" and len(words) == 2 and words[0] in _DEFINES:
                out.append((words[0], "", words[1], statement[0][2], words[1], None, None, 0, False))
            elif depth == 0 and text == ";" and words[:1] == ["import"] and statement[-1][0] == "text":
                out.append(("import", "", "", statement[0][2], words[-1][1:-1], None, None, 0, False))
            depth += (text == "{") - (text == "}")
            statement = []
            if depth < 0:
                return iter([FAILED])
        elif kind:
            statement.append((kind, text, at))
    return iter(out if depth == 0 else [FAILED])


def proto_imports(events: DataFrame) -> DataFrame:
    """module, target, target_path, line: the listed file that ends in the imported path; of several the shortest, then the smallest.

    What is imported lies below any of the roots a compiler is given, so each file is known by all its tails and met by equality.
    """
    made = events.where("kind = 'import'").groupBy(F.col("path").alias("module"), F.col("name").alias("target")).agg(F.min("line").alias("line"))
    parts = F.split("path", "/")
    tails = events.select("path").distinct().select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "/"))).alias("target"))
    known = tails.join(made.select("target").distinct(), "target", "left_semi").groupBy("target").agg(F.min(F.struct(F.length("path"), "path"))["path"].alias("target_path"))
    return made.join(known, "target", "left").select("module", "target", "target_path", "line")


@dataclass(frozen=True)
class Language:
    """What a language brings: its extensions, the events of a text, the kinds of its symbols, and joins that resolve imports and calls."""

    extensions: tuple[str, ...]
    events: Callable[[str], Iterator[tuple]]
    symbols: tuple[str, ...]
    imports: Callable[[DataFrame], DataFrame] | None = None
    calls: Callable[[DataFrame], DataFrame] | None = None


LANGUAGES = {
    "python": Language((".py",), events_of, ("class", "function"), K.imports, K.calls),
    "proto": Language((".proto",), proto_events, _DEFINES, proto_imports),
}


def chosen(names: Sequence[str] | None) -> dict[str, Language]:
    """The named languages, Python alone if none are named; an unknown name is an error."""
    if names is not None and (isinstance(names, str) or not isinstance(names, Sequence)):
        raise KeyError("languages must be a list of names")
    wanted = ["python"] if names is None else [str(n) for n in names]
    if unknown := [n for n in wanted if n not in LANGUAGES]:
        raise KeyError(f"unknown language {unknown[0]!r}; there are {', '.join(LANGUAGES)}")
    return {n: LANGUAGES[n] for n in wanted}


def extensions(languages: dict[str, Language]) -> tuple[str, ...]:
    return tuple(e for x in languages.values() for e in x.extensions)


def written_in(language: Language, path: Column) -> Column:
    out = F.lit(False)
    for e in language.extensions:
        out = out | path.endswith(e)
    return out


def events(contents: DataFrame, languages: dict[str, Language]) -> DataFrame:
    """Events of every file (path, content) that some language reads: each file is read once, by the first that takes its extension.

    A file without content is unreadable, one that cannot be parsed failed. Files of other extensions give nothing.
    """
    readers = [(e, x.events) for x in languages.values() for e in x.extensions]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"], strict=True):
                read = next(r for e, r in readers if path.endswith(e))
                out += [(path, *e[:4], i, *e[4:]) for i, e in enumerate(read(content) if content is not None else [UNREADABLE])]
            yield pd.DataFrame(out, columns=["path", "kind", "class", "symbol", "line", "ord", "name", "attr", "module", "level", "shadowed"])

    read = F.lit(False)
    for x in languages.values():
        read = read | written_in(x, F.col("path"))
    return contents.where(read).select("path", "content").mapInPandas(run, EVENTS)


def _merged(events: DataFrame, languages: dict[str, Language], family: str) -> DataFrame:
    """One relation of all languages that have the family; a language sees its own files' events only."""
    parts = [getattr(x, family)(events.where(written_in(x, F.col("path")))) for x in languages.values() if getattr(x, family)]
    if not parts:
        parts = [getattr(LANGUAGES["python"], family)(events.limit(0))]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def symbols(events: DataFrame, languages: dict[str, Language]) -> DataFrame:
    """module, name, kind, line of outermost definitions in every language; repeated ones are kept."""
    own = F.lit(False)
    for x in languages.values():
        own = own | (written_in(x, F.col("path")) & F.col("kind").isin(*x.symbols))
    return events.where(own).select(F.col("path").alias("module"), F.col("symbol").alias("name"), "kind", "line")


def imports(events: DataFrame, languages: dict[str, Language]) -> DataFrame:
    return _merged(events, languages, "imports")


def calls(events: DataFrame, languages: dict[str, Language]) -> DataFrame:
    return _merged(events, languages, "calls")


def skipped(events: DataFrame) -> DataFrame:
    """family, entry of files that could not be read or parsed, whatever their language."""
    return K.skipped(events, "symbols")
