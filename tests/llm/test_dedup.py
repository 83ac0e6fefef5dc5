"""Exact dedup, line dedup and subwords."""

import hashlib
import random

import numpy as np
import pytest
from oracle import SMALL, assert_same
from pyspark.sql import functions as F

import corpus_pipeline
from tracemill.llm import dedup, lines, subwords
from tracemill.llm.queries import ORACLE, QUERIES

ROWS = [(1, "a"), (2, "a"), (3, None), (4, ""), (5, "é" * 100_000), (6, "é" * 100_000), (7, "b"), (7, "b"), (None, "a"), (8, "a ")]


@pytest.mark.parametrize("name", ["op3_ngram_jaccard_join", "op5_exact_dedup", "op8_line_dedup"])
def test_query_equals_its_sql(spark, name):
    assert_same(QUERIES[name](spark, SMALL), ORACLE[name])


def plain_dedup(rows):
    groups = {}
    for d, t in rows:
        groups.setdefault(t or "", []).append(d)
    best = {t: max((d for d in g if d is not None), default=None) for t, g in groups.items()}
    return sorted(((d, best[t or ""], len(groups[t or ""]), d == best[t or ""], hashlib.sha256((t or "").encode()).hexdigest()) for d, t in rows), key=repr)


@pytest.mark.parametrize("weak", [False, True])
def test_exact_dedup_with_colliding_digests(spark, tmp_path, weak):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([(d, t, 0, "x", "y") for d, t in ROWS], "doc_id long, text string, kept int, digest string, file string").repartition(3).write.parquet(path)
    path += "" if weak else "/"
    digest = (lambda t: (F.crc32(t.cast("binary")) % 2).cast("string").cast("binary")) if weak else dedup.sha256
    for part in (1000, 1):
        assert sorted(map(tuple, dedup.exact_duplicates(spark, path, digest, part).collect()), key=repr) == plain_dedup(ROWS)


def test_a_pattern_is_refused(spark):
    with pytest.raises(ValueError, match="pattern"):
        dedup.exact_duplicates(spark, "/tmp/a*/b")


def test_stream_goes_on_with_its_state(spark, tmp_path):
    path, folder = str(tmp_path / "docs.parquet"), str(tmp_path / "state")
    df = spark.createDataFrame(ROWS, "doc_id long, text string")
    df.where("doc_id < 5").coalesce(1).write.parquet(path)
    dedup.run_stream(spark, path, folder=folder)
    df.where("doc_id >= 5 OR doc_id IS NULL").coalesce(1).write.mode("append").parquet(path)
    groups = dedup.run_stream(spark, path, folder=folder).collect()
    assert sorted((r.group_size, r.keep_id) for r in groups) == [(1, 8), (2, 4), (2, 6), (2, 7), (3, 2)]


def test_empty_table(spark, tmp_path):
    path = str(tmp_path / "docs.parquet")
    spark.createDataFrame([], "doc_id long, text string").write.parquet(path)
    assert dedup.exact_duplicates(spark, path).count() == 0


@pytest.mark.parametrize("most", [lines.BROADCAST_ROWS, 0])
def test_line_dedup_edges(spark, most):
    menu, tail = "home | about", "all rights"
    rows = [(i, f"own text number {i} that is long enough\n {menu} \n\n{tail if i % 2 else ''}", f"s{i}", 0) for i in range(12)]
    rows += [(90 + i, "a whole copied page\nof two lines", f"s{i}", 0) for i in range(12)] + [(200, None, None, 0), (201, "", None, 0), (None, f"x of some length that stays\n{menu}", "s1", 0), (202, "z\n" * 100_000, "s", 0)]
    rows += [rows[3]]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_removed int")
    for taken in ("ident", "form", "lost", "own", "gone", "h", "pos", "_text", "_lost", "N_Lines"):
        df = df.withColumn(taken, F.lit(f"own {taken}"))
    got = lines.clean_lines(df, broadcast_rows=most).collect()
    assert len(got) == len(rows) and got[0].__fields__ == [*df.columns, "n_lines_", "n_removed_"]
    assert all(r.n_removed == 0 and r["_text"] == "own _text" and r.pos == "own pos" and r.N_Lines == "own N_Lines" for r in got)
    for r in got:
        if r.doc_id is not None and r.doc_id < 90:
            assert menu not in r.text and r.n_removed_ == 1 and (tail in r.text) == bool(r.doc_id % 2)
        if r.doc_id is None:
            assert r.text == "x of some length that stays"
        if r.doc_id is not None and 90 <= r.doc_id < 200:
            assert r.text == "a whole copied page\nof two lines" and r.n_removed_ == 0
    assert {r.doc_id: r.text for r in got}[200] is None
    assert lines.clean_lines(df.limit(0), broadcast_rows=most).count() == 0


def test_line_dedup_joined_by_shuffle_equals_its_sql(spark):
    cleaned = lines.clean_lines(spark.read.parquet(f"{SMALL}/documents.parquet"), broadcast_rows=0)
    assert_same(cleaned.select("doc_id", "n_lines", "n_removed", F.sha2("text", 256).alias("text_sha256")), lines.SQL)


def test_pipeline_takes_long_menus_out_of_short_pages(spark):
    menu = "home | about | contact | imprint | terms | help"
    rows = [(i, f"{menu}\nown {i}\n{menu}", f"s{i}", 0) for i in range(12)] + [(50 + i, f" {menu}\n\n{menu}", f"s{i}", 0) for i in range(3)] + [(90, None, "s1", 0), (91, "\n", "s1", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, n_chars int")
    got = {r.doc_id: (r.text, r.n_chars) for r in corpus_pipeline.dedup_lines(spark, df, SMALL).collect()}
    assert all(got[i] == (f"own {i}", len(f"own {i}")) for i in range(12))
    assert all(got[50 + i][0] == f" {menu}\n\n{menu}" for i in range(3)) and got[90][0] is None and got[91][0] == "\n"


TEXTS = ["", " ", "a", "hello world", "tab\tand\n\nlines\r\n", "lit ▁ mark ▁▁", "日本語 🎉 é", "x" * 1000, " " * 100, "w " * 200_000, "\x00\x7f", "\ufeffbom", None]


def test_round_trip_is_lossless_and_reproducible(spark):
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(TEXTS)] + [(None, "no id", 1), (1, " ", 1)], "doc_id long, text string, ids int")
    one = subwords.encode(df).orderBy("doc_id").collect()
    two = subwords.encode(df.repartition(5)).orderBy("doc_id").collect()
    assert one == two
    back = {r.doc_id: r.text for r in subwords.decode(subwords.encode(df)).collect()}
    assert all(back[i] == t for i, t in enumerate(TEXTS))
    told = subwords.round_trip(df).collect()
    assert all(r.lossless for r in told if r.lossless is not None) and sum(r.lossless is None for r in told) == 1
    assert subwords.round_trip(df.limit(0)).count() == 0


def test_pieces_are_drawn_in_proportion():
    vocabulary = subwords.Vocabulary((None, *"▁abc", "ab", "bc", "abc", "▁a", *([None] * 256)), tuple(range(9, 265)))
    sampler = subwords.Sampler(vocabulary, seed=1)
    weight = {p: 1 / (i + 10) for i, p in enumerate(vocabulary.pieces) if p}
    paths = {}

    def walk(rest, ids, w):
        if not rest:
            paths[ids] = w
        for i, p in enumerate(vocabulary.pieces):
            if p and rest.startswith(p):
                walk(rest[len(p) :], (*ids, i), w * weight[p])

    walk("▁abc", (), 1.0)
    n = 20_000
    drawn = {}
    for ids in sampler.encode(["abc"] * n, np.arange(n)):
        drawn[tuple(ids.tolist())] = drawn.get(tuple(ids.tolist()), 0) + 1
    assert set(drawn) == set(paths) and len(paths) > 4
    total = sum(paths.values())
    assert all(abs(drawn[p] / n - w / total) < 0.015 for p, w in paths.items())


def test_long_segments_are_one_lattice(monkeypatch):
    sampler = subwords.Sampler(subwords.Vocabulary.load())
    rng = random.Random(2)
    texts = ["".join(rng.choices("abcdefgh日本語 é🎉\n▁", k=rng.randrange(1, 40))) for _ in range(200)] + ["internationalization " * 3, "https://example.org/some/path?of=words"]
    keys = np.arange(len(texts))
    want = [x.tolist() for x in sampler.encode(texts, keys)]
    monkeypatch.setattr(subwords, "LONGEST_SEGMENT", 1)
    assert [x.tolist() for x in sampler.encode(texts, keys)] == want
    monkeypatch.undo()
    whole = "internationalization" * 30  # without a space: pieces lie across any cut
    drawn = [sampler.encode([whole], np.array([k]))[0].tolist() for k in range(40)]
    ends = {int(e) for ids in drawn for e in np.cumsum([len(sampler.bytes[i]) for i in ids])}
    assert all(sampler.decode(np.array(ids)).decode() == whole for ids in drawn) and len(ends) > 100
    inside = [49 not in np.cumsum([len(sampler.bytes[i]) for i in ids]).tolist() for ids in drawn]
    assert any(inside)
    monkeypatch.setattr(subwords, "_BLOCK", 64)
    assert sampler.encode([whole, whole + " a b" * 100], np.array([0, 1]))[0].tolist() == drawn[0]


def test_agrees_with_the_tokenizer_library():
    vocabulary = subwords.Vocabulary.load()
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=subwords.VOCABULARY)
    for text in ("hello world", "some text"):
        ids = subwords.Sampler(vocabulary).encode([text], np.array([3]))[0]
        assert model.decode(ids.tolist()) == text == vocabulary.decode(ids.tolist())


def test_query_covers_all_documents(spark):
    rng = random.Random(1)
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op4_sentencepiece"](spark, SMALL).collect()
    assert {r.doc_id for r in rows} == set(docs) and all(r.lossless for r in rows)
    r = rng.choice(rows)
    assert r.decoded_sha256 == hashlib.sha256(docs[r.doc_id].encode()).hexdigest()
