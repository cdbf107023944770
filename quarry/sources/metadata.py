"""Configuration files by Spark's XML reader: comments, character data, attributes and namespaces are read as XML means them.

One scan reads all kinds of objects. A file has one root, which is a ``MetaDataObject`` or holds any
number of them; one task reads it as a stream, an object at a time, so a file may be larger than
memory. Spark's reader doesn't cut one file between tasks.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .markup import KINDS, TYPE_NAMES, TYPE_PREFIXES

_FIELD = "STRUCT<Properties: STRUCT<Name: STRING, Type: STRUCT<Type: ARRAY<STRING>>>>"
_OBJECT = f"""STRUCT<_uuid: STRING, Properties: STRUCT<Name: STRING, Synonym: STRUCT<item: ARRAY<STRUCT<lang: STRING, content: STRING>>>,
 CodeLength: STRING, CodeType: STRING, DescriptionLength: STRING, Hierarchical: STRING, Owners: STRUCT<Item: ARRAY<STRING>>, NumberLength: STRING, NumberType: STRING, Posting: STRING>,
 ChildObjects: STRUCT<Attribute: ARRAY<{_FIELD}>, Dimension: ARRAY<{_FIELD}>, Resource: ARRAY<{_FIELD}>,
 TabularSection: ARRAY<STRUCT<Properties: STRUCT<Name: STRING>, ChildObjects: STRUCT<Attribute: ARRAY<{_FIELD}>>>>>>"""


def read_objects(spark: SparkSession, folder: str, glob: str = "*.xml") -> DataFrame:
    """path, tag, kind, object and bad: an object of each metadata element below a folder.

    What isn't well-formed comes with its text in ``bad`` and no object; tags of no known kind are
    left out (the root index among them).
    """
    tags = ", ".join(f"{tag}: {_OBJECT}" for tag in KINDS)
    schema = T._parse_datatype_string(f"{tags}, _bad: STRING")
    rows = spark.read.schema(schema).format("xml").options(rowTag="MetaDataObject", ignoreNamespace="true", mode="PERMISSIVE", columnNameOfCorruptRecord="_bad", recursiveFileLookup="true", pathGlobFilter=glob).load(folder)
    each = F.filter(F.array(*[F.struct(F.lit(tag).alias("tag"), F.lit(kind).alias("kind"), F.col(tag).alias("object")) for tag, kind in KINDS.items()]), lambda o: o["object"].isNotNull())
    told = rows.select(F.col("_metadata.file_path").alias("path"), F.when(F.col("_bad").isNull(), each).alias("_each"), F.col("_bad").alias("bad"))
    return told.select("path", F.explode_outer("_each").alias("_o"), "bad").select("path", "_o.tag", "_o.kind", "_o.object", "bad").where("object IS NOT NULL OR bad IS NOT NULL")


def _written(types) -> tuple:
    """The type as written out and whether it is made of several."""
    def one(t):
        t = F.trim(t)
        plain = F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in TYPE_NAMES.items() for x in p]), t), t)
        return reduce(lambda out, p: F.when(t.startswith(p[0]), F.concat(F.lit(p[1]), F.substring(t, F.lit(len(p[0]) + 1), F.length(t)))).otherwise(out), TYPE_PREFIXES.items(), plain)

    names = F.transform(F.coalesce(types, F.array().cast("array<string>")), one)
    text = F.when(F.size(names) == 0, "Произвольный").when(F.size(names) == 1, names[0]).otherwise(F.concat(F.lit("Составной("), F.array_join(names, ", "), F.lit(")")))
    return text, F.size(names) > 1


def attributes(objects: DataFrame) -> DataFrame:
    """path, owner, kind, role, section, name, type and is_composite of attributes, dimensions and resources, those of tables with their section."""
    child = F.col("object.ChildObjects")
    told = lambda fields, role, section: F.transform(F.coalesce(fields, F.array()), lambda f: F.struct(F.lit(role).alias("role"), section.alias("section"), f.alias("field")))
    own = [told(child[role], role.lower(), F.lit("")) for role in ("Attribute", "Dimension", "Resource")]
    tables = F.flatten(F.transform(F.coalesce(child["TabularSection"], F.array()), lambda t: told(t["ChildObjects"]["Attribute"], "attribute", t["Properties"]["Name"])))
    # All fields of an object at once: its file is read once.
    each = objects.where("object IS NOT NULL").select("path", F.col("object.Properties.Name").alias("owner"), "kind", F.explode(F.concat(*own, tables)).alias("_f"))
    text, several = _written(F.col("_f.field.Properties.Type.Type"))
    return each.select("path", "owner", "kind", "_f.role", "_f.section", F.col("_f.field.Properties.Name").alias("name"), text.alias("type"), several.alias("is_composite"))


def standard_attributes(objects: DataFrame) -> DataFrame:
    """owner, kind, name, type and mandatory of the attributes that an object has by its kind and its own properties.

    Catalogs have a code and a name of the given lengths, a parent if they are hierarchical, and
    the owners that they list; documents a number, a date, and a mark of posting if they say how
    they post; registers a period and an activity.
    """
    p = lambda name: F.trim(F.col(f"object.Properties.{name}"))
    sized = lambda kind, length: F.when(length.isNotNull(), F.when(kind == "Number", F.concat(F.lit("Число("), length, F.lit(", 0)"))).otherwise(F.concat(F.lit("Строка("), length, F.lit(")"))))
    owners = F.transform(F.col("object.Properties.Owners.Item"), lambda o: F.concat(F.lit("СправочникСсылка."), F.substring_index(F.trim(o), ".", -1)))
    owned = F.when(F.size(owners) == 1, owners[0]).when(F.size(owners) > 1, F.concat(F.lit("Составной("), F.array_join(owners, ", "), F.lit(")")))
    kind = F.col("kind")
    is_ = lambda k, type_: F.when(kind == k, type_)
    # Names, whether they must be given, and types of standard attributes.
    made = [
        ("Код", False, is_("Catalog", sized(F.coalesce(p("CodeType"), F.lit("String")), p("CodeLength")))),
        ("Наименование", True, is_("Catalog", sized(F.lit("String"), p("DescriptionLength")))),
        ("Родитель", False, is_("Catalog", F.when(F.lower(p("Hierarchical")) == "true", F.concat(F.lit("СправочникСсылка."), p("Name"))))),
        ("Владелец", True, is_("Catalog", owned)),
        ("Номер", False, is_("Document", sized(F.coalesce(p("NumberType"), F.lit("String")), p("NumberLength")))),
        ("Дата", True, is_("Document", F.lit("Дата"))),
        ("Проведен", False, is_("Document", F.when(p("Posting").isNotNull(), "Булево"))),
        ("Период", True, is_("Register", F.lit("ДатаВремя"))),
        ("Активность", False, is_("Register", F.lit("Булево"))),
    ]
    rows = F.array(*[F.struct(F.lit(name).alias("name"), type_.alias("type"), F.lit(must).alias("mandatory")) for name, must, type_ in made])
    own = objects.where("object IS NOT NULL").select(F.col("object.Properties.Name").alias("owner"), "kind", F.explode(F.filter(rows, lambda r: r["type"].isNotNull())).alias("_a"))
    return own.select("owner", "kind", "_a.*")
