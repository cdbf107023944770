"""The pipeline's stages, each against brute force on its own input."""

from __future__ import annotations

from collections import Counter

import duckdb
import numpy as np

import corpus_pipeline
from quarry.llm import common, pieces, quality, secrets
from quarry.llm.queries import ORACLE_SQL

from .test_texts import counts, near_dup_rows, shingles


def test_stages(spark, docs, empty, tmp_path):
    for table in (docs, empty):
        step = table
        for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
            out = stage(spark, step, str(tmp_path))
            if k < len(corpus_pipeline.STAGES) - 1:
                assert out.columns == table.columns, name
            out.write.mode("overwrite").parquet(f"{tmp_path}/{k}")
            step = spark.read.parquet(f"{tmp_path}/{k}")
        assert all(r.lossless for r in step.collect())


def test_stages_by_brute_force(spark, corpus, tmp_path):
    # Some documents with secrets, in words of another order so that they are no copies.
    rows = [r.asDict() for r in corpus.collect()]
    rows += [r | {"doc_id": 10_000 + r["doc_id"], "text": " ".join(r["text"].split()[::-1]) + f"\napi_key: abc{r['doc_id']}def9 and user: operator1 aB3dE6gH9kL2nP5qR8tU1w"} for r in rows[:40]]
    corpus = spark.createDataFrame(rows, corpus.schema).repartition(4)
    tables = [corpus]
    for k, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, tables[-1], "").write.parquet(f"{tmp_path}/{k}.parquet")
        tables.append(spark.read.parquet(f"{tmp_path}/{k}.parquet"))
    raw, good, single, clean, mixed, encoded = (t.collect() for t in tables)
    # Quality: the base rule by plain Python, the rest by the model's own posteriors.
    said = {r.doc_id: r.kept for r in quality.judge(corpus).collect()}
    assert sorted(map(str, good)) == sorted(str(r) for r in raw if not counts(r.text)[5] and said[r.doc_id])
    # Near duplicates: one of each group of five-word shingles, the one with the least key.
    want, _ = near_dup_rows([(r.doc_id, r.text) for r in good], 5)
    assert sorted(map(str, single)) == sorted(str(r) for r, w in zip(good, want, strict=True) if w[3] or not shingles(r.text, 5))
    assert len(single) < len(good)
    # Secrets: the same rows, no base span left, other texts as they were.
    before = {r.doc_id: r for r in single}
    assert sorted(before) == sorted(r.doc_id for r in clean)
    spans = {r.doc_id: r for r in secrets.scan(tables[2]).collect()}
    for r in clean:
        found = [(s.start, s.stop) for s in (*spans[r.doc_id].base, *spans[r.doc_id].linked)]
        text, out, done = before[r.doc_id].text, "", 0
        for a, b in sorted(found):
            if b > done:
                out += text[done:a] + "[SECRET]" if a >= done else ""
                done = b
        assert r.text == out + text[done:] and r.n_chars == len(r.text)
        assert not secrets.base_spans(r.text)
    assert any(r.text != before[r.doc_id].text for r in clean)
    # Mixing: the SQL of the mix over this stage's input.
    duck = duckdb.connect()
    duck.sql(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/2.parquet/*.parquet'")
    times = {k: taken // size for k, size, taken in duck.sql(f"SELECT doc_id, size, taken FROM ({ORACLE_SQL['op4_mixing']})").fetchall() if size}
    assert Counter(r.doc_id for r in mixed) == +Counter(times)
    assert {r.doc_id: r for r in mixed} == {r.doc_id: r for r in clean if times[r.doc_id]}
    # Pieces: each document of the mix comes back from its ids.
    model = pieces.PieceModel("piece_bpe_32k.model")
    assert Counter((r.doc_id, model.decode(np.array(r.ids))) for r in encoded) == Counter((r.doc_id, r.text) for r in mixed)


def test_run(spark, corpus):
    before = len(common.written)
    out = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    # Of all scratch tables the last stage's input is left.
    assert len(common.written) == before + 1
    assert out.count() > 0 and set(out.columns) == {"doc_id", "ids", "n_pieces", "n_bytes", "lossless"}
