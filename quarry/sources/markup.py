"""Fields of help pages and configuration files, by column expressions on their whole text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Metadata kinds by root tag (others are data processors; the system's own tags are none).
KINDS = {
    "Catalog": "Catalog", "Document": "Document", "InformationRegister": "Register", "AccumulationRegister": "Register",
    "AccountingRegister": "Register", "CalculationRegister": "Register", "Enum": "Enum", "Report": "Report", "DataProcessor": "DataProcessor",
    "ChartOfAccounts": "ChartOfAccounts", "ChartOfCharacteristicTypes": "ChartOfCharacteristicTypes", "ChartOfCalculationTypes": "ChartOfCharacteristicTypes",
}
SYSTEM_TAGS = ("Language", "Configuration", "ConfigDumpInfo")

#: Written type prefixes and names and what they stand for.
TYPE_PREFIXES = {"cfg:CatalogRef.": "СправочникСсылка.", "cfg:DocumentRef.": "ДокументСсылка.", "cfg:EnumRef.": "ПеречислениеСсылка.", "cfg:InformationRegisterRecordKey.": "КлючЗаписиРегистраСведений."}
TYPE_NAMES = {"xs:string": "Строка", "xs:decimal": "Число", "xs:boolean": "Булево", "xs:dateTime": "Дата"}

#: Facets of each metadata kind, standard attributes (name, type) by kind.
FACETS = {"Catalog": ["Manager", "Object", "Reference", "Constructor"], "Document": ["Manager", "Object", "Reference", "Constructor"], "Register": ["Manager", "Object", "Reference"], "Enum": ["Manager", "Reference"]}
STANDARD = {"Catalog": [("Код", "Строка"), ("Наименование", "Строка")], "Document": [("Номер", "Строка"), ("Дата", "Дата"), ("Проведен", "Булево")], "Register": [("Период", "ДатаВремя"), ("Активность", "Булево")]}

_SCRIPT = r"(?is)<(script|style)\b.*?</\1\s*>|<!--.*?-->"


def _plain(text: Column) -> Column:
    """Markup left out, common references decoded, white space as single spaces."""
    return F.trim(F.regexp_replace(_decoded(F.regexp_replace(text, r"(?s)<[^>]*>", " ")), r"\s+", " "))


def _decoded(text: Column) -> Column:
    for ref, c in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&")):
        text = F.replace(text, F.lit(ref), F.lit(c))
    return text


def body(html: Column) -> Column:
    """The page without scripts, styles and comments."""
    return F.regexp_replace(html, _SCRIPT, "")


def title(html: Column, stripped: bool = False) -> Column:
    """The first heading; ``stripped`` says that ``html`` is a ``body`` already."""
    return _plain(F.regexp_extract(html if stripped else body(html), r"(?is)<h1[^>]*>(.*?)</h1>", 1))


def bilingual_title(name: Column) -> tuple[Column, Column]:
    """The name before the first bracket and the one within; without brackets the whole name and an empty one."""
    return F.trim(F.regexp_extract(name, r"^([^(]*)", 1)), F.trim(F.regexp_extract(name, r"\(([^)]*)\)", 1))


def texts(html: Column, tag: str, stripped: bool = False) -> Column:
    """Texts of all elements of one tag, empty ones left out."""
    found = F.regexp_extract_all(html if stripped else body(html), F.lit(rf"(?is)<{tag}(?:\s[^>]*)?>(.*?)</{tag}>"), F.lit(1))
    return F.filter(F.transform(found, _plain), lambda t: t != "")


def description(html: Column) -> Column:
    return F.array_join(texts(html, "p"), "\n")


def links(html: Column) -> Column:
    return F.regexp_extract_all(body(html), F.lit(r"""(?is)<a\b[^>]*?\bhref\s*=\s*["']([^"']*)["']"""), F.lit(1))


def parameters(html: Column) -> Column:
    """Rows of tables after the first, with name, type, description and optional; rows of one cell are left out."""
    rows = F.slice(F.regexp_extract_all(body(html), F.lit(r"(?is)<tr(?:\s[^>]*)?>(.*?)</tr>"), F.lit(1)), 2, 1 << 20)
    cells = F.transform(rows, lambda r: F.transform(F.regexp_extract_all(r, F.lit(r"(?is)<t[dh](?:\s[^>]*)?>(.*?)</t[dh]>"), F.lit(1)), _plain))
    wide = F.filter(cells, lambda c: F.size(c) >= 2)
    return F.transform(wide, lambda c: F.struct(F.get(c, F.lit(0)).alias("name"), F.get(c, F.lit(1)).alias("type_name"), F.get(c, F.lit(2)).alias("description"), F.coalesce(F.get(c, F.lit(2)).rlike("(?i)необязательный|optional"), F.lit(False)).alias("is_optional")))


def examples(html: Column) -> Column:
    """Texts of code examples as they stand: markup left out, references decoded, white space kept; empty ones are left out."""
    found = F.regexp_extract_all(body(html), F.lit(r"(?is)<(?:pre|code)(?:\s[^>]*)?>(.*?)</(?:pre|code)>"), F.lit(1))
    return F.filter(F.transform(found, lambda t: F.trim(_decoded(F.regexp_replace(t, r"(?s)<[^>]*>", "")))), lambda t: t != "")


def categories(pages: DataFrame, path: str = "path", title_: str = "title", about: str = "about", longest: int = 200) -> DataFrame:
    """node, parent, depth, title, about and pages of a tree of paths of any depth.

    Each page counts in every folder on its way; a folder takes title and description (its first
    ``longest`` characters) from the least page that is its own index, if there is one.
    """
    parts = F.filter(F.split(F.col(path), "/"), lambda p: p != "")
    told = pages.select(parts.alias("_p"), F.col(title_).alias("_t"), F.left(F.col(about), F.lit(longest)).alias("_a")).where(F.size("_p") > 0)
    on_way = told.select("_p", "_t", "_a", F.explode(F.sequence(F.lit(1), F.size("_p"))).alias("_d"))
    name = lambda d: F.concat(F.lit("/"), F.array_join(F.slice("_p", F.lit(1), d), "/"))
    own = F.when(F.col("_d") == F.size("_p"), F.struct("_t", "_a"))
    grouped = on_way.groupBy(name(F.col("_d")).alias("node"), F.when(F.col("_d") > 1, name(F.col("_d") - 1)).alias("parent"), F.col("_d").alias("depth")).agg(F.min(own).alias("_own"), F.count(F.lit(1)).alias("pages"))
    return grouped.select("node", "parent", "depth", F.col("_own._t").alias("title"), F.col("_own._a").alias("about"), "pages")


def return_type(text: Column) -> tuple[Column, Column]:
    """``type: description`` at the first colon."""
    return F.trim(F.regexp_extract(text, r"(?s)^([^:]*)", 1)), F.trim(F.regexp_extract(text, r"(?s)^[^:]*:(.*)$", 1))


#: Words that say where a thing can be used, and where it can if none does.
PLACES = {"Server": ("Сервер", "Server"), "Client": ("Клиент", "Client"), "Mobile": ("Мобильный", "Mobile")}
DEFAULT_PLACES = ("Server", "Client")


def _any(text: Column, words: tuple[str, ...]) -> Column:
    return F.exists(F.array(*map(F.lit, words)), lambda w: text.contains(w))


def availability(text: Column) -> Column:
    """Where a thing can be used; server and client where the text says nothing."""
    found = F.array_compact(F.array(*[F.when(_any(text, words), place) for place, words in PLACES.items()]))
    return F.when(F.size(found) > 0, found).otherwise(F.array(*map(F.lit, DEFAULT_PLACES)))


#: Words whose presence sets a flag.
FLAGS = {
    "readonly": ("Только чтение", "Read only"),
    "iterable": ("Для каждого", "For each", "итерация", "iteration"),
    "indexable": ("индекс", "index", "[]"),
    "serializable": ("Сериализуемый", "Serializable", "XML", "JSON"),
    "exchangeable": ("Обмен данными", "Data exchange", "XDTO"),
}


def flags(text: Column) -> dict[str, Column]:
    return {name: F.greatest(*[text.contains(w) for w in words]) for name, words in FLAGS.items()}


#: By facet, ends of a name, words in a name and words in a description that suggest it.
SUGGESTED = {
    "Manager": (("Manager",), ("Менеджер",), ()),
    "Object": (("Object",), ("Объект",), ()),
    "Reference": (("Ref",), ("Ссылка",), ()),
    "Collection": ((), ("Таблица", "Table", "Массив", "Array"), ("коллекция", "collection", "Для каждого")),
    "Constructor": ((), (), ("создать", "create", "конструктор")),
}


def facets(name: Column, about: Column) -> Column:
    """Facets that a type's name and description suggest."""
    ends = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: name.endswith(w)) if words else F.lit(False)
    holds = lambda c, words: _any(c, words) if words else F.lit(False)
    return F.array_compact(F.array(*[F.when(ends(e) | holds(name, n) | holds(about, d), facet) for facet, (e, n, d) in SUGGESTED.items()]))


def page_kind(path: Column, name: Column) -> Column:
    """Method, property, constructor, category, global function or type, by path and title."""
    folder = F.regexp_extract(path, r"([^/]+)/[^/]*$", 1)
    title_of = name.contains("(") & name.contains(")")
    return (
        F.when(path.contains("Global context") & path.contains("methods") & (name.startswith("Глобальный контекст.") | name.startswith("Global context.")), "GlobalFunction")
        .when((folder == "objects") & path.rlike(r"/(catalog[^/]*|Global context)\.html$"), "Category")
        .when(folder == "methods", "Method")
        .when(folder == "properties", "Property")
        .when(folder == "constructors", "Constructor")
        .when(title_of, "Type")
        .when(name.contains(".") & ~name.contains("..."), "Method")
        .otherwise("Type")
    )


def metadata_kind(tag: Column) -> Column:
    known = F.create_map(*[F.lit(x) for pair in KINDS.items() for x in pair])
    return F.when(~tag.isin(*SYSTEM_TAGS), F.coalesce(F.try_element_at(known, tag), F.lit("DataProcessor")))


def type_name(written: Column) -> Column:
    out = written
    for prefix, name in TYPE_PREFIXES.items():
        out = F.when(written.startswith(prefix), F.concat(F.lit(name), F.substring(written, F.lit(len(prefix) + 1), F.length(written)))).otherwise(out)
    for word, name in TYPE_NAMES.items():
        out = F.when(written == word, name).otherwise(out)
    return out


def write_files(files: DataFrame, folder: str) -> None:
    """Write each row (path below the folder, content) as a file of its own; rows are dealt to all tasks, which write them, and again the same if they run again."""
    from collections.abc import Iterator

    import pyarrow as pa
    from pyarrow import fs

    uri = folder if "://" in folder or folder.startswith("file:") else f"file://{folder}"

    def put(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, base = fs.FileSystem.from_uri(uri)
        made = set()
        for batch in batches:
            for path, content in zip(batch.column("path").to_pylist(), batch.column("content").to_pylist(), strict=True):
                at = f"{base}/{path}"
                parent = at.rpartition("/")[0]
                if parent not in made:
                    store.create_dir(parent, recursive=True)
                    made.add(parent)
                with store.open_output_stream(at) as out:
                    out.write(content.encode())
            yield batch.select(["path"])

    # A number of parts is given, as few bytes would else be put together into one task; what costs is the number of files.
    parts = int(files.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    files.select("path", "content").repartition(parts, "path").mapInArrow(put, "path string").count()


def xml_files(spark: SparkSession, folder: str) -> DataFrame:
    """path and content of all XML files below a folder, one row a file."""
    return spark.read.option("recursiveFileLookup", "true").option("pathGlobFilter", "*.xml").text(folder, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))


def root_kind(files: DataFrame) -> DataFrame:
    """path, tag and kind by the first element within the metadata root."""
    tag = F.regexp_extract("content", r"(?s)<MetaDataObject\b[^>]*>\s*<([A-Za-z]+)", 1)
    return files.select("path", tag.alias("tag")).where("tag <> ''").withColumn("kind", metadata_kind(F.col("tag")))


def references(files: DataFrame) -> DataFrame:
    """tag, name and kind of what the root index lists; system tags are left out."""
    index = files.where(F.col("content").rlike(r"(?s)<MetaDataObject\b[^>]*>\s*<Configuration\b"))
    listed = F.regexp_extract("content", r"(?s)<ChildObjects>(.*?)</ChildObjects>", 1)
    each = index.select(F.explode(F.regexp_extract_all(listed, F.lit(r"(<[A-Za-z]+>[^<]+</[A-Za-z]+>)"), F.lit(1))).alias("x"))
    out = each.select(F.regexp_extract("x", "<([A-Za-z]+)>", 1).alias("tag"), F.trim(F.regexp_extract("x", ">([^<]+)<", 1)).alias("name"))
    return out.withColumn("kind", metadata_kind(F.col("tag"))).where("kind IS NOT NULL")


def attributes(files: DataFrame) -> DataFrame:
    """owner, kind, section, name, types, type and is_composite of all attributes in object files.

    Sections of tables carry the section's name. No type reads as any type; several make a composite.
    """
    owner = F.regexp_extract("content", r"(?s)<Properties>.*?<Name>([^<]+)</Name>", 1)
    kind = metadata_kind(F.regexp_extract("content", r"(?s)<MetaDataObject\b[^>]*>\s*<([A-Za-z]+)", 1))
    section = r"(?s)<TabularSection\b.*?</TabularSection>"
    field = r"(?s)<(?:Attribute|Dimension|Resource)\b.*?</(?:Attribute|Dimension|Resource)>"
    base = files.select(owner.alias("owner"), kind.alias("kind"), "content").where("owner <> ''")
    own = base.select("owner", "kind", F.lit("").alias("section"), F.regexp_replace("content", section, "").alias("part"))
    tables = base.select("owner", "kind", F.explode(F.regexp_extract_all("content", F.lit(section), F.lit(0))).alias("part"))
    tables = tables.select("owner", "kind", F.regexp_extract("part", r"(?s)<Name>([^<]+)</Name>", 1).alias("section"), "part")
    each = own.unionByName(tables).select("owner", "kind", "section", F.explode(F.regexp_extract_all("part", F.lit(field), F.lit(0))).alias("a"))
    types = F.transform(F.regexp_extract_all("a", F.lit(r"<v8:Type>([^<]+)</v8:Type>"), F.lit(1)), lambda t: type_name(F.trim(t)))
    out = each.select("owner", "kind", "section", F.regexp_extract("a", r"(?s)<Name>([^<]+)</Name>", 1).alias("name"), types.alias("types"))
    one = F.when(F.size("types") == 0, "Произвольный").when(F.size("types") == 1, F.get("types", F.lit(0))).otherwise(F.concat(F.lit("Составной("), F.array_join("types", ", "), F.lit(")")))
    return out.withColumn("type", one).withColumn("is_composite", F.size("types") > 1)


def expand_facets(objects: DataFrame, kind: str = "kind") -> DataFrame:
    """A row for each facet of each object's kind; kinds without facets of their own are objects."""
    known = F.create_map(*[x for k, v in FACETS.items() for x in (F.lit(k), F.array(*map(F.lit, v)))])
    return objects.withColumn("facet", F.explode(F.coalesce(F.try_element_at(known, F.col(kind)), F.array(F.lit("Object")))))


def standard_attributes(objects: DataFrame, name: str = "name", kind: str = "kind") -> DataFrame:
    """owner, name and type of the attributes that every object of a kind has."""
    known = F.create_map(*[x for k, v in STANDARD.items() for x in (F.lit(k), F.array(*[F.struct(F.lit(n).alias("name"), F.lit(t).alias("type")) for n, t in v]))])
    return objects.select(F.col(name).alias("owner"), F.explode(F.try_element_at(known, F.col(kind))).alias("a")).select("owner", "a.*")
