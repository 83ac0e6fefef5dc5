"""The pipeline against plain versions of its stages, and the driver's contract."""

import hashlib
from collections import defaultdict

import numpy as np
from oracle import SMALL
from pyspark.sql import functions as F
from test_shingles import brute_force

import __spark_entry__
import corpus_pipeline
from tracemill.llm import benchmark, lines, words
from tracemill.llm.words import ALNUM


def plain_lines(rows):
    sites = defaultdict(set)
    for _, text, source in rows:
        for line in text.split("\n"):
            if line.strip(" "):
                sites[line.strip(" ")].add(source)
    bad = {k for k, v in sites.items() if len(v) >= lines.MIN_SITES}
    out = []
    for d, text, source in rows:
        own = text.split("\n")
        if any(x.strip(" ") and x.strip(" ") not in bad for x in own):
            text = "\n".join(x for x in own if x.strip(" ") not in bad)
        out.append((d, text, source))
    return out


def test_pipeline_equals_plain_stages(spark):
    rows = [(r.doc_id, r.text, r.source) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    items = [ALNUM.hash_all(r.text) for r in spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()]
    rows = plain_lines([r for r in rows if any(c.isalpha() for c in r[1])])
    first = {d for d, _, c in brute_force([r[:2] for r in rows]) if d == c}
    rows = [r for r in rows if r[0] in first]

    def clean(text):
        words = ALNUM.hash_all(text)
        return not any(len(i) - np.isin(i, words).sum() <= 0.2 * len(i) and benchmark.edit_within(i, words)[0] <= 0.2 * len(i) for i in items)

    want = {d: hashlib.sha256(t.encode()).hexdigest() for d, t, _ in rows if clean(t)}
    got = corpus_pipeline.run(spark, SMALL).collect()
    assert {r.doc_id: r.decoded_sha256 for r in got} == want and all(r.lossless for r in got) and len(got) < 200


def test_stages_keep_the_columns(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").limit(30)
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SMALL)
        assert out.dtypes == docs.dtypes
    empty = docs.limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, SMALL).count() == 0


def test_odd_rows_and_clashing_names(spark, tmp_path):
    passage = " ".join(f"item{i}" for i in range(20))
    body, long = (" ".join(f"{w}{i % 97}x{i % 13}" for i in range(n)) for w, n in (("word", 400), ("long", 60_000)))
    rows = [(1, None), (2, ""), (3, " \n"), (4, "just letters"), (4, "just letters"), (5, body), (6, body + " more"), (None, body), (None, "some text of nobody"), (7, f"a {passage} b"), (None, f"c {passage}"), (8, long), (9, "12 34"), (10, "menu\nown words of ten"), *((20 + i, f"menu\nletters number {chr(97 + i)} of a page") for i in range(12))]
    docs = spark.createDataFrame([(d, t, "en", f"s{d}", len(t or "")) for d, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    names = ["gone", "n_lines", "n_removed", "number", "chosen", "c", "n", "key", "_id", "_row", "block", "held_out", "h", "pos"]
    for name in names:
        docs = docs.withColumn(name, F.lit(f"own {name}"))
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(1, passage), (None, "item1"), (3, None)], "item_id long, text string").where("item_id IS NOT NULL").write.parquet(f"{tmp_path}/benchmark.parquet")
    kept = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, kept, str(tmp_path))
        assert out.dtypes == docs.dtypes
        kept = words.settle(out)
        assert all(r[name] == f"own {name}" for r in kept.collect() for name in names)
    told = sorted(((r.doc_id, r.text, r.n_chars) for r in kept.collect()), key=repr)
    want = [(4, "just letters"), (5, body), (None, body), (None, "some text of nobody"), (8, long), (10, "own words of ten"), *((20 + i, f"letters number {chr(97 + i)} of a page") for i in range(12))]
    assert [t[:2] for t in told] == sorted(want, key=repr) and all(n == len(t) for _, t, n in told)
    out = corpus_pipeline.run(spark, str(tmp_path)).collect()
    assert sorted((r.doc_id for r in out), key=repr) == [t[0] for t in told] and all(r.lossless for r in out)


def test_all_queries_are_registered():
    names = set(__spark_entry__.queries())
    assert {f"op{n}_" for n in range(1, 11)} <= {f"{x.split('_')[0]}_" for x in names} and "pipeline" in names
    assert set(__spark_entry__.oracle_sql()) <= names
