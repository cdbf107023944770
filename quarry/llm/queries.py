"""The registered queries of this subpackage: thin calls of its operators over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import decontamination, fim, mixing, near_dups, packing, pages, pieces, quality, secrets, sharding, simhash, token_counts, whitening

Query = Callable[[SparkSession, str], DataFrame]


def _documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet")


def op1_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = packing.write(_documents(spark, sf_dir), "word_bpe_49k.json")
    return packing.read_back(files)


def op2_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.shard_documents(_documents(spark, sf_dir))


def op3_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pages.extract(spark.read.parquet(f"{sf_dir}/pages.parquet"))


def op4_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_documents(spark, sf_dir))


def op5_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.compare_and_search(_documents(spark, sf_dir))


def op6_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.count_tokens(_documents(spark, sf_dir), "byte_bpe_50k.json")


def op7_pieces(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_documents(spark, sf_dir), "piece_bpe_32k.model")


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _documents(spark, sf_dir).select("doc_id", "text")
    return quality.judge(docs).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op9_near_dups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dups.cluster(_documents(spark, sf_dir), settings=near_dups.Settings(width=2))


def op10_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.digest(secrets.scan(_documents(spark, sf_dir)))


def op11_fim(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fim.digest(fim.transform(_documents(spark, sf_dir)))


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    made = whitening.whiten(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
    return made.withColumn("deviation", F.col("deviation").try_cast("long"))


def op13_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination.check(_documents(spark, sf_dir), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


QUERIES: dict[str, Query] = {
    f.__name__: f
    for f in (
        op1_packing, op2_sharding, op3_pages, op4_mixing, op5_simhash, op6_token_counts, op7_pieces, op8_quality, op9_near_dups, op10_secrets,
        op11_fim, op12_whitening, op13_decontamination,
    )
}

#: The mix in plain windows: sizes, targets by water level, and documents in hash order up to the nearest cut.
_MIX = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || left(md5('29/' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '/' || md5(coalesce(text, ''))), 12) AS BIGINT) AS h
  FROM documents),
s AS (SELECT source, size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM (SELECT source, CAST(sum(size) AS BIGINT) AS size FROM d GROUP BY source)),
o AS (
  SELECT *, (SELECT sum(size) FROM s) * 3 / 2 AS total,
    coalesce(sum(2 * size) OVER (ORDER BY 2 * size / w, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before,
    sum(w) OVER (ORDER BY 2 * size / w, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS still
  FROM s),
c AS (SELECT *, (total - before) * w / still > 2 * size AS capped FROM o),
t AS (
  SELECT source, size, CASE WHEN capped THEN CAST(2 * size AS DOUBLE)
    ELSE (total - (SELECT coalesce(sum(2 * size), 0) FROM c WHERE capped)) * w / (SELECT sum(w) FROM c WHERE NOT capped) END AS target
  FROM c),
q AS (SELECT *, CASE WHEN size > 0 THEN CAST(floor(target) AS BIGINT) // size ELSE 0 END AS uses, CASE WHEN size > 0 THEN CAST(floor(target) AS BIGINT) % size ELSE 0 END AS rest FROM t)
SELECT d.doc_id, d.size, q.size AS source_size, q.target,
  CAST(d.size * (q.uses + CASE WHEN 2 * sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size ROWS UNBOUNDED PRECEDING) - d.size <= 2 * q.rest THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM d JOIN q ON d.source IS NOT DISTINCT FROM q.source
"""

#: The tree's draws by MD5, and CRC-32 by its table, a byte at a time.
def _draw(path: str, weight: float) -> str:
    return f"-ln((CAST('0x' || left(md5('17/{path}/' || k), 13) AS BIGINT) + 0.5) / 4503599627370496.0) / {weight}"


def _descent(added: bool) -> str:
    regions = [(f"/region{r}", 4.0) for r in range(2)] + [("/region-of-shard8", 1.0)] * added
    region = f"list_position([{', '.join(_draw(p, w) for p, w in regions)}], list_min([{', '.join(_draw(p, w) for p, w in regions)}])) - 1"
    racks = {r: [_draw(f"/region{r}/rack{2 * r + x}", 2.0) for x in range(2)] for r in range(2)}
    leaves = {x: [_draw(f"/region{x // 2}/rack{x}/shard{2 * x + y}", 1.0) for y in range(2)] for x in range(4)}
    pick = lambda d, x: f"CASE WHEN {d[0]} <= {d[1]} THEN {x[0]} ELSE {x[1]} END"
    below = {r: pick(racks[r], [pick(leaves[2 * r + x], (4 * r + 2 * x, 4 * r + 2 * x + 1)) for x in range(2)]) for r in range(2)}
    return f"CASE {region} WHEN 0 THEN {below[0]} WHEN 1 THEN {below[1]} ELSE 8 END"


_SHARDS = f"""
WITH table_of AS (
  SELECT list(v ORDER BY i) AS t FROM (SELECT i, list_reduce(list_prepend(i, [0, 0, 0, 0, 0, 0, 0, 0]::BIGINT[]), lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v FROM range(256) r(i))),
d AS (
  SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size,
    CAST(xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) AS BIGINT) AS text_crc32
  FROM documents, table_of),
p AS (SELECT doc_id, size, text_crc32, CAST({_descent(False)} AS INTEGER) AS shard, CAST({_descent(True)} AS INTEGER) AS grown_shard FROM d)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, CAST(row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS BIGINT) AS slot, grown_shard FROM p
"""

_FIM = r"""
WITH t AS (
  SELECT doc_id, coalesce(text, '') AS s, sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), 'null')) AS x,
    regexp_extract_all(coalesce(text, ''), '[\x20\x09-\x0D]*[^\x20\x09-\x0D]+|[\x20\x09-\x0D]+') AS k FROM documents),
h AS (SELECT *, len(k) AS n, [CAST('0x' || x[8 * i + 1 : 8 * i + 8] AS BIGINT) FOR i IN range(4)] AS h FROM t),
c AS (SELECT *, least(h[1] % (n + 1), h[2] % (n + 1)) AS a, greatest(h[1] % (n + 1), h[2] % (n + 1)) AS b,
    CASE WHEN s = '' OR contains(s, '<P>') OR contains(s, '<S>') OR contains(s, '<M>') OR h[3] % 100 >= 50 THEN 'plain' WHEN h[4] % 100 < 80 THEN 'spm' ELSE 'psm' END AS form FROM h),
p AS (SELECT *, coalesce(array_to_string(k[1 : a], ''), '') AS p, coalesce(array_to_string(k[a + 1 : b], ''), '') AS m, coalesce(array_to_string(k[b + 1 : n], ''), '') AS f FROM c)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form <> 'plain' THEN CAST(length(p) AS BIGINT) END AS prefix_chars, CASE WHEN form <> 'plain' THEN CAST(length(m) AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN s WHEN 'psm' THEN '<P>' || p || '<S>' || f || '<M>' || m ELSE '<S>' || f || '<P>' || p || '<M>' || m END) AS output_sha256, sha256(s) AS restored_sha256 FROM p
"""

#: Windows and the documents' own windows of the same lengths as lists; proximity by the rarest two words.
_LEAKS = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM documents),
b AS (SELECT coalesce(CAST(item_id AS VARCHAR), 'null') AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+') AS w FROM benchmark),
v AS (SELECT DISTINCT item, w[i + 1 : i + 10] AS win FROM (SELECT item, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)),
g AS (SELECT r, i, l, w[i + 1 : i + l] AS win FROM (SELECT r, w, l, unnest(range(len(w) - l + 1)) AS i FROM d, (SELECT DISTINCT len(win) AS l FROM v) WHERE len(w) >= l)),
e AS (SELECT r, i, l, win FROM g WHERE win IN (SELECT win FROM v)),
hit AS (SELECT r, count(DISTINCT spot) AS n_hit FROM (SELECT r, unnest(range(i, i + l)) AS spot FROM e) GROUP BY r),
it AS (SELECT r, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM e JOIN v USING (win) GROUP BY r),
p AS (SELECT r, generate_subscripts(w, 1) - 1 AS spot, unnest(w) AS word FROM d),
q AS (SELECT win, generate_subscripts(win, 1) - 1 AS place, unnest(win) AS word FROM (SELECT DISTINCT win FROM v)),
n AS (SELECT word, count(*) AS n FROM p WHERE word IN (SELECT word FROM q) GROUP BY word),
k AS (SELECT win, list(struct_pack(word := word, place := place) ORDER BY n, place) AS parts FROM q JOIN n USING (word) GROUP BY win HAVING count(*) = len(win)),
c AS (SELECT r, win, parts, spot - parts[1].place AS start FROM k JOIN p ON p.word = k.parts[1].word),
m AS (SELECT DISTINCT c.r, win, start FROM c JOIN p ON p.r = c.r AND p.word = c.parts[2].word AND abs(p.spot - c.start - c.parts[2].place) <= 2 WHERE len(win) > 1
  UNION ALL SELECT DISTINCT r, win, start FROM c WHERE len(win) = 1),
z AS (SELECT m.r, win, start FROM m JOIN q USING (win) JOIN p ON p.r = m.r AND p.word = q.word AND abs(p.spot - m.start - q.place) <= 2
  GROUP BY m.r, win, start HAVING count(DISTINCT q.place) * 100 >= len(win) * 80),
ni AS (SELECT r, count(DISTINCT item) AS n_near_items FROM (SELECT DISTINCT r, win FROM z) JOIN v USING (win) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated, CAST(coalesce(n_near_items, 0) AS BIGINT) AS n_near_items
FROM d LEFT JOIN hit USING (r) LEFT JOIN it USING (r) LEFT JOIN ni USING (r)
"""

ORACLE_SQL: dict[str, str] = {"op2_sharding": _SHARDS, "op4_mixing": _MIX, "op11_fim": _FIM, "op13_decontamination": _LEAKS}
