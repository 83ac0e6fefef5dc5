"""Language ID, quality and toxicity: brute force for the rules, held-out accuracy for the models, edge cases."""

import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
from oracle import SMALL
from pyspark.sql import functions as F

from tracemill.llm import language, quality, toxicity
from tracemill.llm.queries import QUERIES

SF = "/root/testdata/sf0.01"
ODD = [(1, None), (2, ""), (3, " \n"), (4, "123 $$$"), (5, "a"), (6, "é" * 300_000), (7, "same"), (7, "same"), (None, "x y z")]


def tables(spark):
    return spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")


def odd(spark):
    return spark.createDataFrame([(d, t, "held") for d, t in ODD], "doc_id long, text string, held_out string").withColumn("lang", F.lit("xx"))


def plain_ngrams(text):
    table = language.letter_classes()
    c = [0, *(int(table[min(ord(x), len(table) - 1)]) for x in text), 0, 0]
    out = Counter()
    for i in range(len(text) + 1):
        a, b, d = c[i : i + 3]
        if a:
            out[a | 1 << 24] += 1
        if a or b:
            out[a << 8 | b | 2 << 24] += 1
        if b and (a or d):
            out[a << 16 | b << 8 | d | 3 << 24] += 1
    return dict(out)


def test_ngrams_equal_plain_counts(monkeypatch):
    for text in ("", "a", "Ab  c\n", "der Öl-Preis 12", "xyz" * 40):
        for chunk in (1 << 18, 7):
            monkeypatch.setattr(language, "_CHUNK", chunk)
            codes, counts = language.ngram_counts(text)
            assert dict(zip(codes.tolist(), counts.tolist(), strict=True)) == (plain_ngrams(text) if text else {})


def test_language_accuracy_on_held_out_rows(spark):
    docs, _ = tables(spark)
    rows = language.identify(docs).join(docs.select("doc_id", "lang"), "doc_id").collect()
    assert len(rows) == docs.count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) and 0 <= r.score <= 1 for r in rows)
    told = [r.lang_pred == r.lang for r in rows if r.held_out]
    assert sum(told) >= 0.97 * len(told)


def plain_ranking(counts, depth=400):
    return {code: place for place, (code, _) in enumerate(sorted(counts.items(), key=lambda x: (-x[1], x[0]))[:depth])}


def test_language_query_equals_plain_distances(spark):
    """The whole query against the rule written out: profiles of all training rows, out-of-place sums, ties by name."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    total, own = {}, {}
    for r in docs:
        own[r.doc_id] = plain_ngrams(r.text) if r.text else {}
        if zlib.crc32(str(r.doc_id).encode()) % 4 != 2 and r.lang is not None:
            total.setdefault(r.lang, Counter()).update(own[r.doc_id])
    profiles = {lang: plain_ranking(c) for lang, c in sorted(total.items())}
    got = {r.doc_id: r for r in QUERIES["op6_language_id"](spark, SMALL).collect()}
    assert len(got) == len(docs)
    for d, counts in own.items():
        ranks = plain_ranking(counts)
        if not ranks:
            assert (got[d].lang_pred, got[d].score) == ("und", 0.0)
            continue
        far = {lang: sum(min(abs(p.get(g, 10**6) - place), 400) for g, place in ranks.items()) / (400 * len(ranks)) for lang, p in profiles.items()}
        best, second = sorted(far, key=lambda x: (far[x], x))[:2]
        assert got[d].lang_pred == best and abs(got[d].score - (1 - far[best] / far[second])) < 1e-9
        assert got[d].held_out == (zlib.crc32(str(d).encode()) % 4 == 2)


def test_equal_profiles_are_told_apart_by_name(spark):
    rows = [(i, "one same text", lang) for i in range(40) for lang in ("zz", "aa")]
    assert {(r.lang_pred, r.score) for r in language.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()} == {("aa", 0.0)}


def test_language_edges(spark):
    got = sorted((str(r.doc_id), r.lang_pred) for r in language.identify(odd(spark)).collect())
    assert got == sorted((str(d), "xx" if any(c.isalpha() for c in t or "") else "und") for d, t in ODD)
    assert language.identify(odd(spark).limit(0)).count() == 0
    assert {r.lang_pred for r in language.identify(odd(spark).withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}
    assert language.keep_identified(odd(spark)).count() == 5


def accuracy(rows, label):
    told = [(r.predicted, r[label]) for r in rows if r.held_out]
    return sum(p == y for p, y in told) / len(told), told


def test_quality_on_held_out_rows(spark):
    docs, labels = tables(spark)
    rows = quality.score_quality(docs, labels).join(labels, "doc_id").collect()
    share, told = accuracy(rows, "quality")
    assert share >= 0.93 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in rows)


def test_context_vectors_equal_plain_sums(spark):
    texts = ["a b c a b", "B a. Cc 12", None, "", "x"]
    docs = spark.createDataFrame([(t,) for t in texts], "text string").repartition(3)
    size = 2 * quality.BUCKETS
    place, sign = quality._index(size)
    want = np.zeros((size, quality.DIMENSIONS))
    for t in texts:
        data = np.frombuffer((t or "").encode(), np.uint8)
        for tokens, _ in quality.streams(data, np.array([0, len(data)])):
            for i, x in enumerate(tokens):
                for j in (i - 2, i - 1, i + 1, i + 2):
                    if 0 <= j < len(tokens):
                        for k in (0, 1):
                            want[x, place[k][tokens[j]]] += sign[k][tokens[j]]
    got = quality.context_vectors(docs)
    assert np.allclose(got, want / np.maximum(np.linalg.norm(want, axis=1, keepdims=True), 1e-9), atol=1e-6) and np.abs(want).sum() > 20
    row = next(quality.features(pa.array([texts[0]]), got))[0]
    tokens = quality.streams(np.frombuffer(texts[0].encode(), np.uint8), np.array([0, len(texts[0])]))[0][0]
    held = np.array([got[x] for x in tokens], float)
    d = quality.DIMENSIONS
    assert np.allclose(row[:d], held.mean(0), atol=1e-6) and np.allclose(row[d : 2 * d], held.std(0), atol=1e-3)
    assert np.isclose(row[-2], 3 / 5) and np.isclose(row[-1], 1.0) and np.isclose(row[-3], np.log1p(len(texts[0])))


def test_queries_of_the_classifiers(spark):
    docs, labels = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/labels.parquet")
    for name, score, threshold in (("op7_quality", quality.score_quality, 0.7), ("op10_toxicity", toxicity.score_toxicity, 0.3)):
        got = {r.doc_id: r for r in QUERIES[name](spark, SF).collect()}
        again = {r.doc_id: r for r in score(docs.repartition(7), labels).collect()}
        assert set(got) == {r.doc_id for r in docs.select("doc_id").collect()} == set(again)
        assert all(abs(got[d].score - again[d].score) < 1e-6 and got[d].predicted == (got[d].score >= threshold) for d in got)
        assert all(r.held_out == (zlib.crc32(str(d).encode()) % 4 == 2) for d, r in got.items())


def test_clashing_names_null_and_repeated_ids(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    twice = docs.unionByName(docs.limit(20)).unionByName(docs.limit(5).withColumn("doc_id", F.lit(None).cast("long")))
    more = labels.unionByName(labels.limit(50)).unionByName(labels.limit(3).withColumn("doc_id", F.lit(None).cast("long")))
    for name in ("label", "id", "_id", "key", "taught", "score", "held_out", "predicted", "quality", "toxic", "x", "v", "sentence", "unit"):
        twice = twice.withColumn(name, F.lit("own"))
        more = more.withColumn(name, F.lit("own")) if name not in more.columns else more
    for rows in (language.identify(twice).collect(), quality.score_quality(twice, more).collect(), toxicity.score_toxicity(twice, more).collect()):
        assert len(rows) == docs.count() + 25 and all(r.held_out is False for r in rows if r.doc_id is None) and all(0 <= r.score <= 1 for r in rows)


def test_quality_and_toxicity_edges(spark):
    docs, labels = tables(spark)
    both = docs.select("doc_id", "text").unionByName(odd(spark).select(F.col("doc_id") + 10_000_000, "text").toDF("doc_id", "text"))
    for rows in (quality.score_quality(both, labels).collect(), toxicity.score_toxicity(both, labels).collect()):
        assert len(rows) == docs.count() + len(ODD) and all(0 <= r.score <= 1 for r in rows)
    none = labels.limit(0)
    assert {r.score for r in quality.score_quality(odd(spark), none).collect()} == {0.5}
    assert {r.score for r in toxicity.score_toxicity(odd(spark), none).collect()} == {0.0}
    assert quality.score_quality(docs.limit(0), labels).count() == 0 and toxicity.score_toxicity(docs.limit(0), labels).count() == 0


def test_toxicity_on_held_out_rows(spark):
    # A few dozen toxic rows to learn from; the README has figures of larger tables.
    docs, labels = tables(spark)
    rows = toxicity.score_toxicity(docs, labels).join(labels, "doc_id").collect()
    share, told = accuracy(rows, "toxic")
    assert share >= 0.93 and sum(p for p, y in told if y) >= 0.6 * sum(y for _, y in told)


def plain_kernel(s, t):
    """Common gapped subsequences by their definition."""
    def table(unit):
        c = [0, *(int(toxicity.letters()[ord(x)]) for x in unit), 0]
        out = Counter()
        for offsets in toxicity.PATTERNS:
            for i in range(len(c) - offsets[-1]):
                picked = tuple(c[i + o] for o in offsets)
                if 0 not in c[i + 1 : i + offsets[-1]]:
                    out[picked] += toxicity.DECAY ** (offsets[-1] + 1 - len(offsets))
        return out
    a, b = table(s), table(t)
    return sum(v * b[k] for k, v in a.items())


def test_kernel_equals_its_definition():
    names = ["idiot", "idxiot", "moron", "abc", "idiots"]
    rows, codes, weights = toxicity._features(names)
    for i, s in enumerate(names):
        for j, t in enumerate(names):
            a, b = Counter(), Counter()
            for r, c, w in zip(rows.tolist(), codes.tolist(), weights.tolist(), strict=True):
                if r == i:
                    a[c] += w
                if r == j:
                    b[c] += w
            norms = toxicity._norms()
            scale = norms[max(len(s), toxicity.SHORTEST)] * norms[max(len(t), toxicity.SHORTEST)]
            assert np.isclose(sum(v * b[k] for k, v in a.items()) * scale, plain_kernel(s, t))


def test_values_equal_the_sum_of_weights_by_definition():
    rng = np.random.default_rng(5)
    names = ["idiot", "moron", "loser", "stupid", "scums"]
    clean = ["".join(rng.choice(list("aeioulnrst"), rng.integers(3, 12))) for _ in range(200)]
    machine = toxicity.fit(dict.fromkeys([*names, *(v for n in names for v in toxicity.varied(n))], 1.0), clean)

    def value(unit):
        c = [0, *(int(toxicity.letters()[ord(x)]) for x in unit), 0]
        total = 0.0
        for offsets in toxicity.PATTERNS:
            for i in range(len(c) - offsets[-1]):
                code = 0
                for o in offsets:
                    code = code << 5 | c[i + o]
                total += float(machine.weight[code + ((1 << 15) if len(offsets) == 4 else 0)]) * toxicity.DECAY ** (offsets[-1] + 1 - len(offsets))
        return total / toxicity._norms()[min(max(len(unit), toxicity.SHORTEST), toxicity.STRETCH)] + machine.bias

    for text in ("an idxiot here", "mo-ron", "nothing at all", "i d i o t", "l o s e r is stupid"):
        assert np.isclose(machine.values([text])[0], max(map(value, toxicity.spelled(text))), atol=1e-4)
    assert min(machine.values(["idiot", "idxiot", "i.d.i.o.t", "morron"])) > max(machine.values(["ocean", "letter", "reason"]))


def test_units_join_letters_and_leave_marks_out():
    m = toxicity.Machine(np.random.default_rng(0).random(toxicity.SIZE), 0.0)
    want = m.values(["idiot"])[0]
    assert np.allclose(m.values(["i.d.i-o_t", "i d i o t", "42 Idiot!", "\nI D i o. T"]), want)
    assert np.isneginf(m.values(["", "12 ."])).all()
    long = "ab" * 300_000
    assert np.isfinite(m.values([long, "x"])).all()


def test_network_calibrates():
    rng = np.random.default_rng(1)
    x = rng.normal(size=(2000, 5))
    y = (x[:, 0] + rng.normal(size=2000) > 0).astype(float)
    net = quality.Network(x, y)
    p = net(x)
    assert abs(p.mean() - y.mean()) < 0.05 and ((p > 0.5) == y).mean() > 0.7
