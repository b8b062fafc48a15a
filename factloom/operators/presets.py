"""Presets of a structure: validated as rows, resolved by precedence, rendered to planned units and rules.

Presets come as text (place, name, body in JSON), so a thousand repositories' presets are one table. ``place`` is 0 for a repository's own,
which goes before a shared one of the same name.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: The files that tell an ecosystem.
MARKERS = {
    "python": ("pyproject.toml", "setup.py", "setup.cfg"),
    "node": ("package.json",),
    "go": ("go.mod",),
    "rust": ("Cargo.toml",),
    "java": ("pom.xml", "build.gradle"),
    "ruby": ("Gemfile",),
}
_TEXTS = ("name", "description", "top_level")
_ROLE = "id string, must_not_depend_on string, purpose string, canonical_placement string"
_TOP = f"name string, description string, top_level string, enforceable_for string, roles array<struct<{_ROLE.replace(' string', ': string')}>>, layers array<struct<{_ROLE.replace(' string', ': string')}>>, _bad string"


def _list(text: Column) -> tuple[Column, Column]:
    """The strings of a JSON list, none for null, and whether it is a list of strings that say something."""
    found = F.coalesce(F.from_json(text, "array<string>"), F.array().cast("array<string>"))
    return found, text.isNull() | (F.ltrim(text).startswith("[") & ~F.exists(found, lambda x: x.isNull() | (F.trim(x) == "")))


def presets(texts: DataFrame) -> DataFrame:
    """place, name, description, top_level, enforceable_for, roles and ``wrong`` (null if the preset is sound) of texts (place, name, body).

    Unsound are: a body that is no JSON mapping, a missing text, another name than the file's, a top level other than contexts or layers, nothing it
    is enforceable for, no roles (contexts keep theirs as ``layers``), and roles that are repeated, lack a text, or exclude themselves or unknown ones.
    """
    read = texts.select("place", F.col("name").alias("stem"), F.from_json("body", _TOP, {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"}).alias("p")).select("place", "stem", "p.*")
    given = F.coalesce(F.when(F.col("top_level") == "contexts", F.col("layers")).otherwise(F.col("roles")), F.array().cast(f"array<struct<{_ROLE.replace(' string', ': string')}>>"))
    enforced, sound_list = _list(F.col("enforceable_for"))
    blank = lambda c: c.isNull() | (F.trim(c) == "")
    ids = F.transform(given, lambda r: r["id"])
    roles = F.transform(given, lambda r: F.struct(r["id"].alias("id"), _list(r["must_not_depend_on"])[0].alias("must_not_depend_on"), r["purpose"].alias("purpose"), r["canonical_placement"].alias("canonical_placement")))
    out = read.select("place", "stem", "name", "description", "top_level", enforced.alias("enforceable_for"), roles.alias("roles"), given.alias("given"), ids.alias("ids"), sound_list.alias("listed"), "_bad")
    reasons = [
        (F.col("_bad").isNotNull(), F.lit("is no mapping of texts and lists")),
        *[(blank(F.col(c)), F.lit(f"lacks {c}")) for c in _TEXTS],
        (F.col("name") != F.col("stem"), F.lit("has another name than its file")),
        (~F.col("top_level").isin("contexts", "layers"), F.lit("has an unknown top level")),
        (~F.col("listed") | (F.size("enforceable_for") == 0), F.lit("is enforceable for nothing")),
        (F.size("roles") == 0, F.lit("has no roles")),
        (F.exists("given", lambda r: r.isNull() | blank(r["id"]) | blank(r["purpose"]) | blank(r["canonical_placement"])), F.lit("has a role that lacks a text")),
        (F.size(F.array_distinct("ids")) < F.size("ids"), F.lit("repeats a role")),
        (F.exists("given", lambda r: ~_list(r["must_not_depend_on"])[1]), F.lit("has a role whose exclusions are no list")),
        (F.exists("roles", lambda r: F.array_contains(r["must_not_depend_on"], r["id"])), F.lit("has a role that excludes itself")),
        (F.exists("roles", lambda r: F.size(F.array_except(r["must_not_depend_on"], F.col("ids"))) > 0), F.lit("has a role that excludes an unknown one")),
    ]
    wrong = F.coalesce(*[F.when(when, said) for when, said in reasons])
    return out.select("place", F.col("stem").alias("name"), "description", "top_level", "enforceable_for", "roles", wrong.alias("wrong"))


def listed(found: DataFrame) -> DataFrame:
    """The sound preset of each name that goes first; unsound ones are passed over."""
    own = F.struct("place", "description", "top_level", "enforceable_for", "roles")
    return found.where("wrong is null").groupBy("name").agg(F.min_by(own, "place").alias("p")).select("name", "p.*")


def chosen(found: DataFrame, name: str) -> DataFrame:
    """The one row of a name that goes first, sound or not: an unsound one of the repository does not let a shared one through."""
    return found.where(F.col("name") == name).groupBy("name").agg(F.min_by(F.struct("place", "description", "top_level", "enforceable_for", "roles", "wrong"), "place").alias("p")).select("name", "p.*")


def ecosystems(disk: DataFrame) -> DataFrame:
    """ecosystem of every marker file that stands at the root."""
    marks = F.create_map(*[F.lit(x) for tag, names in MARKERS.items() for n in names for x in (n, tag)])
    return disk.select(marks[F.col("path")].alias("ecosystem")).where("ecosystem is not null").distinct()


def with_advisory(found: DataFrame, there: DataFrame) -> DataFrame:
    """presets with ``advisory``: nothing they can be enforced for is there."""
    tags = there.agg(F.collect_set("ecosystem").alias("there"))  # one row of at most six
    return found.crossJoin(F.broadcast(tags)).withColumn("advisory", ~F.arrays_overlap("enforceable_for", "there")).drop("there")


def rendered(found: DataFrame, context: str = "example", base: str = "src") -> tuple[DataFrame, DataFrame]:
    """Planned units (id, path, kind, owner, purpose, canonical_placement, status, ord) and rules (unit, forbidden) of presets with ``advisory``.

    Units come in the order of the preset's roles; a path owns nothing until files lie below it.
    """
    roles = found.select("advisory", F.posexplode("roles").alias("ord", "r"))
    named = F.concat(F.lit(f"{context}-"), F.col("r.id"))
    note = F.when(F.col("advisory"), " ADVISORY: no check enforces this preset here.").otherwise("")
    units = roles.select(named.alias("id"), F.concat(F.lit(f"{base}/{context}/"), F.col("r.id")).alias("path"), F.lit("layer").alias("kind"), F.lit("maintainers").alias("owner"), F.col("r.purpose").alias("purpose"), F.concat(F.col("r.canonical_placement"), note).alias("canonical_placement"), F.lit("planned").alias("status"), "ord")
    rules = roles.select(named.alias("unit"), F.explode("r.must_not_depend_on").alias("to")).select("unit", F.concat(F.lit(f"{context}-"), F.col("to")).alias("forbidden"))
    return units, rules
