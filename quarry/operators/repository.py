"""A typed metadata store as a DataFrame: filters, look-ups, roll-ups and upserts of type rows.

A type row has id, name, alt_name, source (Platform, Configuration or UserDefined), category_path,
methods, properties and facets (arrays of strings), and documentation.
"""

from __future__ import annotations

import re

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Filter:
    """What a type must be; None asks for nothing. Text is sought without regard to case."""

    source: str | None = None
    category: str | None = None
    name_contains: str | None = None
    facet: str | None = None
    has_methods: bool | None = None
    has_properties: bool | None = None

    def predicate(self) -> Column:
        out = F.lit(True)
        if self.source is not None:
            out &= F.col("source") == self.source
        if self.category is not None:
            out &= F.exists("category_path", lambda c: F.lower(c).contains(self.category.lower()))
        if self.name_contains is not None:
            out &= F.lower("name").contains(self.name_contains.lower()) | F.lower("alt_name").contains(self.name_contains.lower())
        if self.facet is not None:
            out &= F.array_contains("facets", self.facet)
        if self.has_methods is not None:
            out &= (F.size("methods") > 0) == self.has_methods
        if self.has_properties is not None:
            out &= (F.size("properties") > 0) == self.has_properties
        return out


def find(types: DataFrame, text: str) -> DataFrame:
    return types.where(F.lower("name").contains(text.lower()))


def with_all_facets(types: DataFrame, facets: list[str]) -> DataFrame:
    return types.where(F.size(F.array_except(F.array(*map(F.lit, facets)), "facets")) == 0)


def with_any_facet(types: DataFrame, facets: list[str]) -> DataFrame:
    return types.where(F.arrays_overlap("facets", F.array(*map(F.lit, facets))))


def in_category(types: DataFrame, category: str) -> DataFrame:
    return types.where(F.array_contains("category_path", category))


def look_up(types: DataFrame, name: str) -> DataFrame:
    """Rows of that id or name; only without any, rows whose name holds it or is held by it. ``priority`` tells which."""
    exact = (F.col("id") == name) | (F.col("name") == name)
    held = F.lower("name").contains(name.lower()) | F.lit(name.lower()).contains(F.lower("name"))
    ranked = types.withColumn("priority", F.when(exact, 1).when(held, 2)).where("priority IS NOT NULL")
    best = ranked.agg(F.min("priority").alias("best"))
    return ranked.join(F.broadcast(best), F.col("priority") == F.col("best")).drop("best")


def bilingual(wanted: DataFrame, types: DataFrame, name: str = "wanted") -> DataFrame:
    """For each wanted name the least id by name, else by the other language's name, else null."""
    by = {c: types.groupBy(F.col(c).alias(f"_{c}")).agg(F.min("id").alias(f"_id_{c}")) for c in ("name", "alt_name")}
    joined = wanted.join(by["name"], F.col(name) == F.col("_name"), "left").join(by["alt_name"], F.col(name) == F.col("_alt_name"), "left")
    return joined.select(name, F.coalesce("_id_name", "_id_alt_name").alias("id"))


def completions(types: DataFrame, prefix: str) -> DataFrame:
    """Labels that begin with the text: type names, or after a dot the members of the type before it."""
    base, dot, member = prefix.rpartition(".")
    if not dot:
        return types.where(F.col("name").startswith(prefix)).select(F.col("name").alias("label"), F.lit("type").alias("kind")).distinct()
    of = types.where(F.col("name") == base)
    parts = [of.select(F.explode(c).alias("label")).select("label", F.lit(kind).alias("kind")) for c, kind in (("methods", "method"), ("properties", "property"))]
    return parts[0].union(parts[1]).where(F.col("label").startswith(member)).groupBy("label").agg(F.min("kind").alias("kind"))


def display(types: DataFrame) -> DataFrame:
    """name, category and a line of description."""
    category = F.when(F.col("source") == "Platform", "Platform").when(F.col("source") == "Configuration", F.get("category_path", F.lit(0))).otherwise("Unknown")
    text = F.format_string("%s: %d methods, %d properties", F.col("name"), F.size("methods"), F.size("properties"))
    return types.select("id", "name", category.alias("category"), text.alias("description"))


def stats(types: DataFrame) -> DataFrame:
    n = lambda s: F.count_if(F.col("source") == s)
    return types.agg(F.count(F.lit(1)).alias("total"), n("Platform").alias("platform"), n("Configuration").alias("configuration"), n("UserDefined").alias("user_defined"))


def category_rollup(types: DataFrame, default: str = "Без категории") -> DataFrame:
    """Types, methods and properties by the first element of the category path; the least name stands for it."""
    first = F.coalesce(F.try_element_at("category_path", F.lit(1)), F.lit(default))
    return types.groupBy(first.alias("category")).agg(F.count(F.lit(1)).alias("types"), F.sum(F.size("methods")).alias("methods"), F.sum(F.size("properties")).alias("properties"), F.min("name").alias("example"))


def hierarchy(types: DataFrame) -> DataFrame:
    """Types by every element of their paths."""
    return types.select(F.explode("category_path").alias("category")).groupBy("category").agg(F.count(F.lit(1)).alias("types"))


def facet_report(types: DataFrame, examples: int = 3) -> DataFrame:
    """Types of each facet and the first names. Names are pre-aggregated by rank, so no facet gathers in one list."""
    each = types.select(F.explode("facets").alias("facet"), "name")
    counts = each.groupBy("facet").agg(F.count(F.lit(1)).alias("n"))
    rank = F.expr("row_number() OVER (PARTITION BY facet ORDER BY name)")
    first = each.distinct().withColumn("_r", rank).where(F.col("_r") <= examples).groupBy("facet").agg(F.array_sort(F.collect_list("name")).alias("examples"))
    return counts.join(first, "facet").select("facet", "n", F.array_join("examples", ", ").alias("examples"))


def upsert(old: DataFrame, new: DataFrame, keys: list[str], order: list[str]) -> DataFrame:
    """Old and new rows with one row per key: the last in ``order``, new over old where equal."""
    both = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    rest = [c for c in old.columns if c not in keys]
    last = both.groupBy(*keys).agg(F.max_by(F.struct(*rest), F.struct(*order, "_new")).alias("_row"))
    return last.select(*keys, "_row.*").select(*old.columns)


def cache_key(content: Column, version: str) -> Column:
    """The key of a cached result: the first 16 hex digits of the content's SHA-256, and the version that made it."""
    return F.concat(F.left(F.sha2(content, 256), F.lit(16)), F.lit(f":{version}"))


def cache_put(cache: DataFrame, fresh: DataFrame, keys: list[str]) -> DataFrame:
    """The cache with new entries in place of those of their keys; ``fresh`` holds a key once."""
    return cache.join(fresh.select(*keys), keys, "left_anti").unionByName(fresh)


def cache_drop(cache: DataFrame, gone: DataFrame) -> DataFrame:
    """The cache without the given keys."""
    return cache.join(gone.distinct(), gone.columns, "left_anti")


#: Written forms that give an output its name: an alias, a field's path, a function.
ALIASED, FIELD, FUNCTION = r"(?is)^.*\s(?:AS|КАК)\s+(\w+)\s*$", r"(?s)^(?:\w+\.)*(\w+)$", r"(?s)^(\w+)\(.*\)$"


def output_name(text: Column) -> Column:
    """What an output is called by its written form: its alias, a field's last part, a function's name, else Expression."""
    t = F.trim(text)
    return F.when(t.rlike(f"(?u){ALIASED}"), F.regexp_extract(t, f"(?u){ALIASED}", 1)).when(t.rlike(f"(?u){FIELD}"), F.regexp_extract(t, f"(?u){FIELD}", 1)).when(t.rlike(f"(?u){FUNCTION}"), F.regexp_extract(t, f"(?u){FUNCTION}", 1)).otherwise("Expression")


def output_names(outputs: DataFrame, keys: list[str], place: str = "place", text: str = "text") -> DataFrame:
    """``outputs``, the written outputs of queries (told by ``keys``, in order of ``place``), with name: a repeat within a query gets its number."""
    told = outputs.withColumn("_n", output_name(F.col(text)))
    again = F.row_number().over(Window.partitionBy(*keys, "_n").orderBy(place)) - 1
    return told.withColumn("_a", again).withColumn("name", F.when(F.col("_a") > 0, F.concat("_n", F.col("_a").cast("string"))).otherwise(F.col("_n"))).drop("_n", "_a")


def project(df: DataFrame, texts: list[str]) -> DataFrame:
    """Columns of ``df`` by their written forms, named as ``output_names`` does."""
    seen: dict[str, int] = {}
    out = []
    for text in texts:
        found = next((m for p in (ALIASED, FIELD, FUNCTION) if (m := re.match(p, text.strip()))), None)
        name = found[1] if found else "Expression"
        seen[name] = seen.get(name, -1) + 1
        out.append(F.expr(re.sub(r"(?is)\s(?:AS|КАК)\s+\w+\s*$", "", text)).alias(f"{name}{seen[name]}" if seen[name] else name))
    return df.select(*out)


def link_by_path(members: DataFrame, folders: DataFrame, path: str = "path", folder: str = "folder", name: str = "name", few: int = 1 << 16) -> DataFrame:
    """path, folder and name for each distinct path: the folder with the longest path that leads to it; null for none.

    A folder deeper on the way takes what lies below it from those above. Paths that no folder
    leads to take, in a second pass, the folder whose own last name stands deepest among their
    steps (of several folders of that name the least path). Every folder on a path's way is one
    key, joined by equality; the longest is a maximum with partial aggregation, so no folder
    gathers what lies below it.
    """
    told = members.select(F.col(path).alias("path")).where("path IS NOT NULL").distinct()
    known = folders.select(F.regexp_replace(folder, "/+$", "").alias("folder"), F.col(name).alias("name")).where("folder <> ''").groupBy("folder").agg(F.min("name").alias("name"))
    sized = F.broadcast(known) if known.limit(few + 1).count() <= few else known
    steps = F.split("path", "/")
    way = told.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.greatest(F.size(steps) - 1, F.lit(1))), lambda n: F.struct(n.alias("depth"), F.array_join(F.slice(steps, F.lit(1), n), "/").alias("folder"), F.element_at(steps, n).alias("step")))).alias("w")).select("path", "w.*")
    first = way.join(sized, "folder").groupBy("path").agg(F.max_by(F.struct("folder", "name"), "depth").alias("_f"))
    last_names = known.groupBy(F.substring_index("folder", "/", -1).alias("step")).agg(F.min(F.struct("folder", "name")).alias("_g"))
    left = way.join(first.select("path"), "path", "left_anti")
    second = left.join(F.broadcast(last_names) if known.limit(few + 1).count() <= few else last_names, "step").groupBy("path").agg(F.max_by("_g", "depth").alias("_f"))
    return told.join(first.unionByName(second), "path", "left").select("path", "_f.folder", "_f.name")
