"""Very long texts of one kind, through every operator on documents, against plain rules or the libraries."""

from __future__ import annotations

import hashlib
import re

import pytest
from pyspark.sql import functions as F

from quarry.llm import mixing, near_dups, packing, pieces, quality, secrets, sharding, simhash, token_counts

from .test_texts import counts, shingles
from .test_tokens import library

TEXTS = [
    "a" * 100_000, "secret" * 20_000, "=:" * 50_000, " " * 100_000, "\n" * 50_000, "AKIA" * 20_000, "0123456789abcdef" * 6_000, "é" * 50_000, "▁" * 20_000,
    "<|endoftext|>" * 4_000, "'" * 60_000, "\x00" * 20_000, "https://" * 10_000, "a b " * 20_000, "token=" * 10_000 + "x", "user:" * 10_000, "🫠" * 5_000, "İ]." * 5_000,
]


@pytest.fixture(scope="module")
def table(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string").withColumn("source", F.lit("s")).repartition(6).cache()


def test_counts_and_ids(table):
    want = library("byte_bpe_50k.json", TEXTS)
    assert {r.doc_id: r.n_tokens for r in token_counts.count_tokens(table, "byte_bpe_50k.json").collect()} == {k: len(ids) for k, ids in enumerate(want)}
    got = {r.doc_id: r.n_tokens for r in packing.read_back(packing.write(table, "word_bpe_49k.json")).collect()}
    assert got == {k: len(ids) + 1 for k, ids in enumerate(library("word_bpe_49k.json", TEXTS))}
    assert all(r.lossless and r.n_bytes == len(TEXTS[r.doc_id].encode()) for r in pieces.encode(table, "piece_bpe_32k.model").collect())


def test_rules_and_spans(table):
    got = {r.doc_id: (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in quality.judge(table).collect()}
    assert got == {k: counts(t) for k, t in enumerate(TEXTS)}
    found = {r.doc_id: [(s.start, s.stop, s.kind) for s in r.base] for r in secrets.scan(table).collect()}
    for k, t in enumerate(TEXTS):
        want = [(m.start(), m.end(), "assign") for m in re.finditer(r"""(?ai:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t) if len(m[2]) >= 6]
        want += [(m.start(), m.end(), "access") for m in re.finditer("AKIA[A-Z0-9]+", t) if len(m[0]) >= 20] + [(m.start(), m.end(), "hex") for m in re.finditer("[0-9a-f]+", t) if len(m[0]) >= 24]
        assert sorted(found[k]) == sorted(want)


def test_sets_prints_and_shards(table):
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in near_dups.cluster(table, settings=near_dups.Settings(width=2)).collect()}
    assert got == {k: (len(shingles(t, 2)), k) for k, t in enumerate(TEXTS)}
    edited = [t[: len(t) - len(t) // 4] + f[: len(t) // 4] for t, f in zip(TEXTS, TEXTS[1:] + TEXTS[:1], strict=True)]
    assert {r.doc_id: r.edited_sha256 for r in simhash.compare_with_next(table).collect()} == {k: hashlib.sha256(t.encode()).hexdigest() for k, t in enumerate(edited)}
    assert {r.doc_id: r["size"] for r in sharding.shard_documents(table).collect()} == {k: len(t.encode()) + 1 for k, t in enumerate(TEXTS)}
    assert {r.doc_id: r["size"] for r in mixing.mix(table).collect()} == {k: counts(t)[0] for k, t in enumerate(TEXTS)}
