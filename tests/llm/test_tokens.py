"""Packing, token counts and pieces against the libraries themselves."""

from __future__ import annotations

import zlib

import numpy as np
import pytest

pytest.importorskip("tokenizers")
pytest.importorskip("sentencepiece")

from quarry.llm import packing, pieces, token_counts
from quarry.llm.tokens import tokenizer_path

from .conftest import PROSE, ROWS


def library(name, texts):
    from tokenizers import Tokenizer

    return [e.ids for e in Tokenizer.from_file(tokenizer_path(name)).encode_batch([t or "" for t in texts], add_special_tokens=False)]


@pytest.mark.parametrize("width", [1, 5, 16, 17, 31, 32])
@pytest.mark.parametrize("count", [0, 1, 63, 64, 65, 4097])
def test_pack_round_trip(width, count):
    ids = np.random.default_rng(count).integers(0, 1 << width, count, dtype=np.uint64).astype(np.uint32)
    data = packing.pack(ids, width)
    assert len(data) == -(-count // 64) * 8 * width
    assert (packing.unpack(data, width, count) == ids).all()


def test_random_access(tmp_path):
    ids = np.arange(3 * packing.BLOCK + 777, dtype=np.uint32) % 50_000
    writer = packing.PackedWriter(f"file://{tmp_path}/x.bits", packing.width_for(50_000))
    cuts = [0, 5, 5, packing.BLOCK + 3, len(ids)]
    for k, (a, b) in enumerate(zip(cuts[:-1], cuts[1:], strict=True)):
        writer.add(k if k else None, ids[a:b])
    writer.close()
    file = packing.PackedFile(f"file://{tmp_path}/x.bits")
    assert file.keys == [None, 1, 2, 3] and file.starts.tolist() == cuts
    for a, b in ((0, 0), (0, 1), (65_530, 65_540), (100, 2 * packing.BLOCK), (len(ids) - 1, len(ids))):
        assert (file.ids(a, b) == ids[a:b]).all()


def packed(docs, rows):
    got = [tuple(r) for r in packing.read_back(packing.write(docs, tokenizer_path("word_bpe_49k.json"))).collect()]
    ordered = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] is not None, r[1] or ""))
    want, start = [], 0
    for (key, _), ids in zip(ordered, library("word_bpe_49k.json", [t for _, t in ordered]), strict=True):
        ids = [*ids, 2]
        want.append((key, start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        start += len(ids)
    assert sorted(got, key=str) == sorted(want, key=str)


def test_packed_edge_cases(docs):
    packed(docs, [r[:2] for r in ROWS])


def test_packed_corpus(corpus):
    packed(corpus, [(r[0], r[1]) for r in corpus.select("doc_id", "text").collect()])


def fuzzed(seed, n):
    """Short texts of letters, marks, digits and spaces, of characters with odd cases and of ones newer than the JVM."""
    rng = np.random.default_rng(seed)
    odd = [*"İıſßΣςÅéñaAzZ09_.,]'\"!?-–—…½²ⅧⅫ٣日本ǅﬁ", "\u0301", "\u0307", "\u200d", "\u00a0", " ", " ", "\n", "😀", "🫠", "\U0001df25", "\U00010d40", "\u1c89", "\ua7cb", "\U00011f04", "\U0001e030", "'s", "'ll", "'T", "<|endoftext|>", "].", "..."]
    return ["".join(rng.choice(odd, rng.integers(1, 14))) for _ in range(n)]


def test_words_equal_the_library_on_odd_texts():
    from quarry.llm.tokens import WordEncoder

    texts = ["İ].", *fuzzed(1, 20_000)]
    got = WordEncoder("word_bpe_49k.json").encode(t.encode() for t in texts)
    assert [g.tolist() for g in got] == library("word_bpe_49k.json", texts)


def test_counts_equal_the_library_on_odd_texts(spark):
    rows = list(enumerate(fuzzed(2, 20_000)))
    counted(spark.createDataFrame(rows, "doc_id long, text string").repartition(8), rows)


def test_counts_of_long_pre_tokens(spark):
    rows = [(k, f"{'=' * 500} {'long' * 99} {'=' * (500 + k % 3)}\n") for k in range(50)]
    counted(spark.createDataFrame(rows, "doc_id long, text string").repartition(3), rows)


def test_packed_empty(empty):
    assert packing.read_back(packing.write(empty, tokenizer_path("word_bpe_49k.json"))).count() == 0


def counted(docs, rows):
    got = sorted((tuple(r) for r in token_counts.count_tokens(docs, tokenizer_path("byte_bpe_50k.json")).collect()), key=str)
    want = [(k, len((t or "").encode()), len(ids), len(ids) > 1024) for (k, t), ids in zip(rows, library("byte_bpe_50k.json", [t for _, t in rows]), strict=True)]
    assert got == sorted(want, key=str)


def test_counts_edge_cases(docs):
    counted(docs, [r[:2] for r in ROWS])


def test_counts_corpus(corpus):
    counted(corpus, [(r[0], r[1]) for r in corpus.select("doc_id", "text").collect()])


def test_counts_without_broadcast(docs, monkeypatch):
    monkeypatch.setattr(token_counts, "BROADCAST_ROWS", 0)
    counted(docs, [r[:2] for r in ROWS])


def test_counts_empty(empty):
    assert token_counts.count_tokens(empty, tokenizer_path("byte_bpe_50k.json")).count() == 0


TEXTS = ["", " ", "a", "  a  b\n c", "trail  ", "\n\n a\n  \n", "ﬁ ½ Å é é", "x\x00y", "日本語 テキスト 🙂", "don't stop-me now!!"]


def test_pieces_equal_the_library_without_dropout(corpus):
    import sentencepiece

    path = tokenizer_path("piece_bpe_32k.model")
    library_ = sentencepiece.SentencePieceProcessor(model_file=path)
    model = pieces.PieceModel(path)
    for text in TEXTS + [r[0] for r in corpus.select("text").collect()]:
        assert model.encode(text).tolist() == library_.encode(text)


@pytest.mark.parametrize("dropout", [0.0, 0.1, 0.5, 1.0])
def test_pieces_are_lossless(dropout):
    model = pieces.PieceModel(tokenizer_path("piece_bpe_32k.model"), dropout, seed=3)
    for text in [*TEXTS, "▁ literal ▁▁ marks", *(r[1] or "" for r in ROWS)]:
        for variant in (0, 1):
            assert model.decode(model.encode(text, variant)) == text
    long = model.encode("running over the hills and far away " * 20).tolist()
    again = pieces.PieceModel(tokenizer_path("piece_bpe_32k.model"), dropout, seed=3).encode("running over the hills and far away " * 20).tolist()
    other = pieces.PieceModel(tokenizer_path("piece_bpe_32k.model"), dropout, seed=4).encode("running over the hills and far away " * 20).tolist()
    assert long == again and (long != other) == (dropout in (0.1, 0.5))


def test_encode_and_decode(docs, empty):
    path = tokenizer_path("piece_bpe_32k.model")
    encoded = pieces.encode(docs, path)
    rows = encoded.collect()
    assert len(rows) == len(ROWS) and all(r.lossless for r in rows) and all(r.n_pieces == len(r.ids) for r in rows)
    texts = sorted(str(r.text) for r in pieces.decode(encoded, path).collect())
    assert texts == sorted(str(r[1] or "") for r in ROWS)
    assert pieces.encode(empty, path).count() == 0


def test_each_occurrence_has_draws_of_its_own(spark):
    path, word = tokenizer_path("piece_bpe_32k.model"), "government"
    docs = spark.createDataFrame([(k, " ".join([word] * 20)) for k in range(100)], "doc_id long, text string")
    rows = {r.doc_id: r.ids for r in pieces.encode(docs, path).collect()}
    assert len({tuple(ids) for ids in rows.values()}) > 90
    assert rows == {r.doc_id: r.ids for r in pieces.encode(docs.repartition(7), path).collect()}
    model = pieces.PieceModel(path, 0.1)
    # Within one text too, and each merge is skipped in a tenth of the cases, also where nothing is remembered.
    text = " ".join([word] * 20_000)
    steps = model.segment(" " + word)[1]
    plain = (model.gaps(5, np.arange(20_000), 0) >= steps).sum() / 20_000
    assert abs(plain - 0.9**steps) < 0.02
    made = model.encode(text, 5)
    assert sum(key >> 6 == model.known[" " + word] for key in model.below) == steps
    assert made.tolist() == [i for k in range(20_000) for i in model.segment(" " + word, model._draws(5, k))[0]]


def test_long_units_have_the_same_draws(monkeypatch):
    path, text = tokenizer_path("piece_bpe_32k.model"), "internationalisation" * 30 + " over " + "hillsanddales" * 3
    some = pieces.PieceModel(path, 0.3).encode(text, 9).tolist()
    again = pieces.PieceModel(path, 0.3)
    again.encode(text, 8)
    assert some == again.encode(text, 9).tolist()
    for name, value in (("LONG", 60), ("SHORT", 0), ("SHORT", 100_000), ("REMEMBERED", 0)):
        monkeypatch.setattr(pieces, name, value)
        again = pieces.PieceModel(path, 0.3)
        again.encode(text, 8)
        assert some == again.encode(text, 9).tolist()


def test_many_units_at_once_are_as_one_by_one(corpus):
    model = pieces.PieceModel("piece_bpe_32k.model", 0.2)
    rng = np.random.default_rng(6)
    units = sorted({u for r in corpus.select("text").limit(60).collect() for u in model.units(" " + r[0])} | {"\n", "a", " ", "   ", "▁x", " 日本", "aaaaaaaaaaaa", " \x00y", "x" * 50})
    gaps = [rng.integers(0, 4, rng.integers(0, 4)).tolist() for _ in units]
    want = []
    for unit, g in zip(units, gaps, strict=True):
        ids, steps, _ = model.segment(unit, g)
        want.append((np.array(ids, model.dtype).tobytes(), steps))
    assert model.segment_all(units, gaps) == want


def test_copies_differ(spark):
    docs = spark.createDataFrame([(1, PROSE)] * 3 + [(None, PROSE)] * 2, "doc_id long, text string").repartition(2)
    path = tokenizer_path("piece_bpe_32k.model")
    got = [sorted(map(str, pieces.encode(d, path, copies=True).collect())) for d in (docs, docs.repartition(3))]
    assert got[0] == got[1] and len(set(got[0])) == 5


def test_copies_of_a_large_part_of_all_rows(spark, monkeypatch):
    """A text that many rows have isn't gathered; its rows have draws of their own all the same."""
    monkeypatch.setattr(pieces, "FEW_ROWS", 10)
    rows = [(1, PROSE)] * 60 + [(None, None)] * 20 + [(k, f"{PROSE} {k}") for k in range(5)]
    table = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got = pieces.encode(table, "piece_bpe_32k.model", copies=True).collect()
    assert len(got) == len(rows) and all(r.lossless for r in got)
    assert len({tuple(r["ids"]) for r in got if r.doc_id == 1 and r.n_bytes == len(PROSE)}) > 30


def test_scratch_lists_of_threads():
    import threading

    from quarry.llm.common import written

    def other():
        written.append("theirs")
        seen.append(list(written))

    seen: list = []
    written.append("mine")
    thread = threading.Thread(target=other)
    thread.start()
    thread.join()
    assert seen == [["theirs"]] and "theirs" not in written
    written.remove("mine")
