"""Secret scans with multipart credential linking.

Three base patterns report on their own. Weak parts (opaque strings, endpoints, access names)
report only when a complementary part lies in the same scope, which is a block of a text (blank
lines part blocks) or a few hundred code points across its border: parts are rows of intervals, and
an interval join of parts decides. Offsets count code points, ends are exclusive.
"""

from __future__ import annotations

import hashlib
import itertools
import re
from bisect import bisect_left, bisect_right
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import claim, materialize, split_join

#: Base kinds in the order that breaks ties between spans with one start.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{24,}")

#: Weak parts. An identifier, a secret and an endpoint complement each other.
IDENTIFIER = re.compile(r"(?:user|username|login|client_id|account|access_key_id)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.@-]{4,})", re.ASCII | re.IGNORECASE)
OPAQUE = re.compile(r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[0-9])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}={0,2}(?![A-Za-z0-9+/_=-])")
ENDPOINT = re.compile(r"\b(?:https?|ftp|jdbc:[a-z]+|postgres(?:ql)?|mysql|mongodb|redis|amqp)://[A-Za-z0-9._~:@/?#&=+%-]+")

#: What parts the blocks of a text.
BORDER = re.compile(r"\n[\x20\t\r]*\n")

#: Texts with linked spans, and spans, that are broadcast.
BROADCAST_ROWS, BROADCAST_SPANS = 1 << 16, 1 << 19

SPANS = "array<struct<kind:string,start:int,stop:int>>"
PART = "array<struct<part:string,start:int,stop:int,strong:boolean,block:int>>"


def base_spans(text: str) -> list[tuple[int, int, str, int]]:
    """(start, rank of the kind, kind, end) of the base matches, in the order of their digest."""
    spans = [(m.start(), 0, "assign", m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    spans += [(m.start(), 1, "access", m.end()) for m in ACCESS.finditer(text) if m.end() - m.start() >= 20] if "AKIA" in text else []
    spans += [(m.start(), 2, "hex", m.end()) for m in HEX.finditer(text)]
    return sorted(spans)


def parts(text: str, base: list[tuple[int, int, str, int]]) -> list[dict]:
    """What may belong to one credential: base spans are strong, the other parts are weak."""
    role = {"assign": "secret", "access": "identifier", "hex": "secret"}
    found = [{"part": role[kind], "start": start, "stop": end, "strong": True} for start, _, kind, end in base]
    # A match meets a base span if, of those that begin before its end, the farthest end lies past its start.
    starts, ends = [x[0] for x in base], [0, *itertools.accumulate((x[3] for x in base), max)]
    for part, pattern in (("identifier", IDENTIFIER), ("secret", OPAQUE), ("endpoint", ENDPOINT)):
        for m in pattern.finditer(text):
            if ends[bisect_left(starts, m.end())] <= m.start():
                found.append({"part": part, "start": m.start(), "stop": m.end(), "strong": False})
    if all(x["strong"] for x in found) or len({x["part"] for x in found}) < 2:
        return []
    borders = [m.end() for m in BORDER.finditer(text)]
    return [x | {"block": bisect_right(borders, x["start"])} for x in found]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    claim()
    for batch in batches:
        out: dict[str, list] = {k: [] for k in ("base", "parts", "scope")}
        for i, text in enumerate(batch.column("_text")):
            text = text.as_py() or ""
            base = base_spans(text)
            out["base"].append([{"kind": kind, "start": start, "stop": end} for start, _, kind, end in base])
            out["parts"].append(parts(text, base))
            out["scope"].append(hashlib.sha256(text.encode()).digest() if out["parts"][-1] else None)
        kept = [batch.column(c) for c in batch.schema.names if c != "_text"]
        names = [c for c in batch.schema.names if c != "_text"]
        yield pa.RecordBatch.from_arrays(
            [*kept, pa.array(out["base"], pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("stop", pa.int32())]))), pa.array(out["parts"], pa.list_(pa.struct([("part", pa.string()), ("start", pa.int32()), ("stop", pa.int32()), ("strong", pa.bool_()), ("block", pa.int32())]))), pa.array(out["scope"], pa.binary())],
            names=[*names, "base", "parts", "scope"],
        )


def scan(docs: DataFrame, key: str = "doc_id", text: str = "text", reach: int = 200) -> DataFrame:
    """One row per document: key, base and linked spans.

    ``base`` is the base matches; ``linked`` the weak parts with a complementary part (another
    role among identifier, secret, endpoint) in the same block of the text, or whose interval begins
    or ends within ``reach`` code points of theirs across its border. Both are arrays of (kind, start, stop), by start. Two
    weak endpoints and identifiers alone, without a secret, are not reported. The scan is written
    once to scratch, without texts; only texts with weak and complementary parts join, in buckets
    of ``reach`` code points. Null and empty texts have no spans; repeated rows stay, each with
    the same spans.
    """
    slim = docs.select(F.col(f"`{key}`").alias("_key"), F.col(f"`{text}`").alias("_text"))
    kind = slim.schema["_key"].dataType.simpleString()
    found = materialize(slim.mapInArrow(_scan, f"_key {kind}, base {SPANS}, parts {PART}, scope binary"))
    linked = _links(found, reach)
    none = F.array().cast(SPANS)
    alone = found.where("scope is null").select(F.col("_key").alias(key), "base", none.alias("linked"))
    joined = found.where("scope is not null").join(linked, "scope", "left")
    return alone.unionByName(joined.select(F.col("_key").alias(key), "base", F.coalesce("linked", none).alias("linked")))


def _links(found: DataFrame, reach: int) -> DataFrame:
    """scope and linked: the parts of each text that are complementary within a block or by an interval join, in buckets of ``reach`` code points."""
    flat = found.where("scope is not null").dropDuplicates(["scope"]).select("scope", F.explode("parts").alias("p")).select("scope", "p.*")
    touched = F.explode(F.sequence(F.floor((F.col("start") - reach) / reach), F.floor((F.col("stop") + reach) / reach))).alias("bucket")
    # Within a block only the roles that occur matter, however many parts there are.
    secret = F.col("part") == "secret"
    roles = flat.groupBy("scope", "block").agg(F.max(secret).alias("_secret"), F.max(~secret).alias("_other"))
    own = flat.where(~F.col("strong")).join(roles, ["scope", "block"]).where(F.when(secret, F.col("_other")).otherwise(F.col("_secret"))).select("scope", "part", "start", "stop")
    weak, other = flat.where(~F.col("strong")).drop("strong", "block"), flat.select("scope", F.col("part").alias("o_part"), F.col("start").alias("o_start"), F.col("stop").alias("o_stop"))
    close = f"part <> o_part AND (part = 'secret' OR o_part = 'secret') AND o_start <= stop + {reach} AND o_stop >= start - {reach}"
    # One of two near intervals starts inside the other once that is widened by reach, so two joins find all pairs.
    after = weak.select("*", touched).join(other.withColumn("bucket", F.floor(F.col("o_start") / reach)), ["scope", "bucket"])
    touched = F.explode(F.sequence(F.floor((F.col("o_start") - reach) / reach), F.floor((F.col("o_stop") + reach) / reach))).alias("bucket")
    before = weak.withColumn("bucket", F.floor(F.col("start") / reach)).join(other.select("*", touched), ["scope", "bucket"])
    links = after.where(close).select("scope", "part", "start", "stop").union(before.where(close).select("scope", "part", "start", "stop")).union(own).distinct()
    grouped = links.groupBy("scope").agg(F.sort_array(F.collect_list(F.struct("start", F.concat(F.lit("linked_"), "part").alias("kind"), "stop"))).alias("links"))
    return grouped.select("scope", F.expr("transform(links, x -> struct(x.kind AS kind, x.start AS start, x.stop AS stop))").alias("linked"))


def digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts by kind, the SHA-256 of the base spans and all spans written kind:start:end."""
    text = "array_join(transform({0}, x -> concat(x.kind, ':', x.start, ':', x.stop)), ',')"
    rank = "CASE kind WHEN 'assign' THEN 0 WHEN 'access' THEN 1 WHEN 'hex' THEN 2 ELSE 3 END"
    merged = f"transform(sort_array(transform(concat(base, linked), x -> struct(x.start AS start, {rank.replace('kind', 'x.kind')} AS rank, x.kind AS kind, x.stop AS stop))), x -> struct(x.kind AS kind, x.start AS start, x.stop AS stop))"
    counts = [F.expr(f"CAST(size(filter(base, x -> x.kind = '{k}')) AS LONG)").alias(f"n_{k}") for k in KINDS]
    return found.withColumn("_all", F.expr(merged)).select(key, *counts, F.sha2(F.expr(text.format("base")), 256).alias("base_sha256"), F.expr(text.format("_all")).alias("spans"))


def _redact(batches: Iterator[pa.RecordBatch], text: str, length: str, mask: str) -> Iterator[pa.RecordBatch]:
    claim()
    for batch in batches:
        texts, sizes = [], []
        at = batch.schema.get_field_index(text)
        n = batch.schema.get_field_index(length)
        links = batch.column(batch.schema.get_field_index("_spans")).to_pylist()
        had = batch.column(n).to_pylist() if n >= 0 else [None] * len(batch)
        for whole, spans, size in zip(batch.column(at), links, had, strict=True):
            whole = whole.as_py()
            spans = sorted([(a, b) for a, _, _, b in base_spans(whole or "")] + [(x["start"], x["stop"]) for x in spans or ()])
            if spans:
                out, done = [], 0
                for a, b in spans:
                    if b > done:
                        out += [whole[done:a], mask] if a >= done else []
                        done = b
                whole, size = "".join([*out, whole[done:]]), None
                size = len(whole)
            texts.append(whole)
            sizes.append(size)
        columns = {c: batch.column(i) for i, c in enumerate(batch.schema.names) if c != "_spans"}
        columns[text] = pa.array(texts, batch.column(at).type)
        if n >= 0:
            columns[length] = pa.array(sizes, batch.column(n).type)
        yield pa.RecordBatch.from_arrays(list(columns.values()), names=list(columns))


def redact(docs: DataFrame, text: str = "text", length: str = "n_chars", mask: str = "[SECRET]", reach: int = 200) -> DataFrame:
    """``docs`` with each reported span replaced by ``mask`` and ``length`` made to fit.

    Overlapping spans become one mask. Rows without spans are unchanged, null texts included; a
    null length of an unchanged row stays null. Linked spans reach their texts by the text's
    SHA-256, so repeated keys do no harm: by broadcast while they are few, else by a shuffle in
    which null texts have no part and copies of one text are dealt out.
    """
    slim = docs.select(F.lit(0).alias("_key"), F.col(f"`{text}`").alias("_text"))
    found = materialize(slim.mapInArrow(_scan, f"_key int, base {SPANS}, parts {PART}, scope binary").where("scope is not null"))
    uses = found.groupBy("scope").agg(F.count(F.lit(1)).alias("_uses"))
    linked = materialize(_links(found, reach).join(uses, "scope").select(F.col("scope").alias("_scope"), F.col("linked").alias("_spans"), "_uses"))
    row = F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("_row")
    none = F.lit(None).cast(SPANS).alias("_spans")
    keyed = docs.select(row, F.unhex(F.sha2(F.col(f"`{text}`").cast("binary"), 256)).alias("_scope"))
    rows, spans = linked.agg(F.count(F.lit(1)), F.coalesce(F.sum(F.size("_spans")), F.lit(0))).first()
    if rows <= BROADCAST_ROWS and spans <= BROADCAST_SPANS:
        joined = keyed.join(F.broadcast(linked.drop("_uses")), "_scope", "left").select("_row.*", "_spans")
    else:
        some = split_join(keyed.where("_scope is not null"), linked, ["_scope"], "_uses", found.count(), "left").select("_row.*", "_spans")
        joined = some.unionByName(keyed.where("_scope is null").select("_row.*", none))
    return joined.mapInArrow(lambda batches: _redact(batches, text, length, mask), docs.schema)
