"""The n-gram Jaccard join against brute force."""

import random
import re

import numpy as np
import pytest
from oracle import SMALL

from tracemill.llm import shingles
from tracemill.llm.queries import QUERIES
from tracemill.llm.words import U

SPLIT = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})


def plain_set(text):
    w = SPLIT.findall((text or "").translate(LOWER))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute_force(rows):
    """(id, set size, component) of each row."""
    sets = [plain_set(t) for _, t in rows]
    up = list(range(len(rows)))

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    index = {}
    for i, s in enumerate(sets):
        for g in s:
            index.setdefault(g, []).append(i)
    for i, s in enumerate(sets):
        for j in {j for g in s for j in index[g] if j < i}:
            both = len(s & sets[j])
            if 100 * both >= 75 * (len(s) + len(sets[j]) - both):
                up[find(i)] = find(j)
    least = {}
    for i, (d, _) in enumerate(rows):
        if d is not None:
            least[find(i)] = min(least.get(find(i), d), d)
    return sorted(((d, len(s), least[find(i)] if d is not None else None) for i, ((d, _), s) in enumerate(zip(rows, sets, strict=True))), key=repr)


def made(seed, n, ids=True):
    rng = random.Random(seed)
    bag = [f"w{i}" for i in range(60)]
    lines = [" ".join(rng.choices(bag, k=14)) for _ in range(6)]
    texts = [None, "", " \n", "one", "One", "a b c d", "a b c d e", "A b c d e"]
    for _ in range(n):
        kind = rng.random()
        if kind < 0.2:
            texts.append(" ".join(rng.choices(bag, k=rng.randrange(1, 80))))
        elif kind < 0.4:
            texts.append(" ".join([*rng.choices(lines, k=rng.randrange(1, 5)), *rng.choices(bag, k=rng.randrange(6))]))
        else:
            words = (rng.choice(texts) or "x y z q").split() or ["x"]
            for _ in range(rng.randrange(0, 4)):
                words[rng.randrange(len(words))] = rng.choice(bag)
            texts.append(rng.choice([" ", "\t", "  "]).join(words))
    order = list(range(len(texts)))
    rng.shuffle(order)
    return list(zip(order, texts, strict=True))


def run(spark, rows):
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, component_id int")
    return sorted((tuple(r) for r in shingles.near_duplicates(df).collect()), key=repr)


@pytest.mark.parametrize("seed", [1, 2])
def test_components_equal_brute_force(spark, seed, monkeypatch):
    for name, value in {"BLOCK": 12, "LIGHT": 3 if seed == 1 else 64, "CELL": 7}.items():
        monkeypatch.setattr(shingles, name, value)
    rows = made(seed, 500)
    assert run(spark, rows) == brute_force(rows)


def test_repeated_rows_and_ids(spark):
    rows = made(5, 60)
    rows += rows[:10] + [(rows[9][0], "quite another text than that one had"), (None, "a b c d e"), (None, None)]
    assert run(spark, rows) == brute_force(rows)
    assert run(spark, []) == []


def test_hot_group_of_near_copies(spark, monkeypatch):
    monkeypatch.setattr(shingles, "BLOCK", 16)
    rng = random.Random(6)
    body = [f"w{rng.randrange(50)}" for _ in range(200)]
    rows = []
    for d in range(400):
        words = body[:]
        for _ in range(rng.randrange(5)):
            words[rng.randrange(200)] = f"x{d}"
        rows.append((d, " ".join(words)))
    got = run(spark, rows)
    assert got == brute_force(rows) and sum(r[2] == 0 for r in got) > 300


def test_tree_join_equals_all_pairs():
    rng = random.Random(7)
    for _ in range(200):
        sets = [np.array(sorted(rng.sample(range(12), rng.randrange(1, 12))), U) for _ in range(rng.randrange(12))]
        links = shingles.tree_join(sets, list(range(len(sets))))
        root = list(range(len(sets)))

        def find(x, root=root):
            while root[x] != x:
                x = root[x]
            return x

        alike = [(i, j) for i in range(len(sets)) for j in range(i) if 4 * len({*sets[i]} & {*sets[j]}) >= 3 * len({*sets[i]} | {*sets[j]})]
        assert all((max(p), min(p)) in alike for p in links)
        for i, j in links:
            root[find(i)] = find(j)
        assert all(find(i) == find(j) for i, j in alike)


def test_very_long_texts(spark):
    rng = random.Random(12)
    words = [f"w{rng.randrange(5000)}" for _ in range(120_000)]
    near = words[:]
    for _ in range(1000):
        near[rng.randrange(len(near))] = "zz"
    rows = [(1, " ".join(words)), (2, " ".join(near)), (3, " ".join(words[:60_000])), (4, "x" * 3_000_000), (5, "x" * 3_000_000 + " y"), (6, "a b c d e f " * 50_000), (7, "a b c d e f " * 49_000)]
    assert run(spark, rows) == brute_force(rows)


def test_hot_shingles_without_links(spark, monkeypatch):
    """A passage that stands in most rows and makes up most of them, so that its shingles are hot and most pairs fall just short."""
    for name, value in {"BLOCK": 8, "LIGHT": 5, "CELL": 16}.items():
        monkeypatch.setattr(shingles, name, value)
    rng = random.Random(11)
    passage = " ".join(f"p{i}" for i in range(70))
    rows = [(d, f"{' '.join(f'x{rng.randrange(900)}' for _ in range(rng.randrange(8, 16)))} {passage} {' '.join(f'y{rng.randrange(900)}' for _ in range(rng.randrange(3)))}") for d in range(150)]
    rows += [(1000 + d, t + " " + rng.choice(["z", "z z"])) for d, t in rows[:40]]
    got = run(spark, rows)
    assert got == brute_force(rows) and 30 < len({r[2] for r in got}) < 190


def test_components_of_few_and_many_edges(spark):
    rng = random.Random(13)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(200)] + [(1000 + i, 1001 + i) for i in range(40)] + [(2000, 2000 + i) for i in range(1, 60)]
    df = spark.createDataFrame([e for e in edges if e[0] != e[1]], "a long, b long")
    one, two = (sorted(map(tuple, shingles.components(df, few).collect())) for few in (1000, 0))
    assert one == two and (1040, 1000) in one and (2059, 2000) in one
    assert shingles.components(df.limit(0)).count() == 0 == shingles.components(df.limit(0), 0).count()


def test_nested_sets_beyond_the_recursion_limit():
    sets = [np.arange(1, n + 1, dtype=U) for n in range(1, 1500)]
    assert len(shingles.tree_join(sets[-40:] + sets[:20], list(range(60)))) > 50
    shingles._tree(sets, list(range(len(sets))))


def test_long_words_of_two_letters_do_not_collide(spark):
    """Words that share every hash whose weights are powers of an odd number."""
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(8192))
    two = one.translate(str.maketrans("ab", "ba"))
    rows = [(k, " ".join([w] * 6)) for k, w in enumerate((one, two, one[:1024], two[:1024]))]
    assert run(spark, rows) == brute_force(rows) == [(k, 1, k) for k in range(4)]


def test_signatures_bound_the_difference():
    rng = np.random.default_rng(3)
    for _ in range(200):
        pool = rng.integers(0, 2**63, 300).astype(U)
        a, b = (np.unique(rng.choice(pool, rng.integers(1, 290))) for _ in range(2))
        x, y = (np.frombuffer(shingles.signature(s), U) for s in (a, b))
        assert shingles._differ(x, y) <= len(np.setxor1d(a, b))


def test_query_equals_brute_force(spark):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()]
    assert sorted((tuple(r) for r in QUERIES["op3_ngram_jaccard_join"](spark, SMALL).collect()), key=repr) == brute_force(rows)


def test_one_document_of_each_group_stays(spark):
    rows = made(8, 80) + [(None, "a")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in shingles.keep_one(df).where("doc_id is not null").collect()) == sorted({c for d, _, c in brute_force(rows) if d == c and d is not None})


def test_one_row_of_each_group_stays_where_ids_repeat(spark):
    body = " ".join(f"w{i}" for i in range(60))
    rows = [(1, body), (5, body + " tail"), (5, " ".join(f"v{i}" for i in range(60))), (7, "x y z q r s t"), (7, "x y z q r s t"), (3, ""), (3, ""), (None, body)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = sorted(((r.doc_id, r.text) for r in shingles.keep_one(df).collect()), key=repr)
    assert got == sorted([rows[0], rows[2], rows[3], rows[5], rows[6], rows[7]], key=repr)
    assert shingles.keep_one(df).columns == df.columns
    rows = made(9, 60)
    rows += [(d, t) for d, t in rows[:10]] + [(rows[k][0], rows[k + 1][1]) for k in range(20, 30)]
    kept = shingles.keep_one(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    told = brute_force([(k, t) for k, (_, t) in enumerate(sorted(rows, key=lambda r: r[0]))])
    assert sorted(r.doc_id for r in kept) == [sorted(rows, key=lambda r: r[0])[k][0] for k, _, c in sorted(told) if k == c]
