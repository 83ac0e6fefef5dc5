"""License, secret and benchmark scans against brute force."""

import hashlib
import random
import re
import time

import numpy as np
import pyarrow as pa
import pytest
from oracle import SMALL
from pyspark.sql import functions as F

from tracemill.llm import benchmark, licenses, secrets
from tracemill.llm.queries import QUERIES
from tracemill.llm.words import ALNUM, SPACED, U, words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
LOWER = str.maketrans({c: chr(c + 32) for c in range(65, 91)})
TEXTS = ["", None, " ", "MIT License", "a mit  license mit-license", "GNU General\nPublic license gnu general public license", "CC BY-NC apache\tlicense é", "x" * 3_000_000, "é" * 700_000 + " cc by", "word " * 700_000]


def fold(text):
    return WORD.findall((text or "").translate(LOWER))


def corpus(spark, texts):
    return spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, labels string")


def test_words_equal_the_pattern():
    texts = [t or "" for t in TEXTS] + ["Aa bB", "1 2", "\x00a\x7f"]
    data = np.frombuffer("".join(texts).encode(), np.uint8)
    offsets = np.cumsum([0] + [len(t.encode()) for t in texts])
    for alphabet, split in ((ALNUM, WORD.findall), (SPACED, re.compile(r"[^\x20\x09-\x0D]+").findall)):
        h, at, bounds = words_of(alphabet, data, offsets)
        for i, t in enumerate(texts):
            own = split(t.translate(LOWER))
            assert bounds[i + 1] - bounds[i] == len(own)
            if len(own) < 10:
                assert [int(x) for x in h[bounds[i] : bounds[i + 1]]] == [alphabet.hash(w) for w in own]


def told(own, theirs, block, threshold):
    """Whether a block that holds enough of ``own`` is not the other's."""
    if len(own & theirs) < threshold * len(own) - 1e-12:
        return True
    if own - theirs:
        return len(own - theirs & set(block)) >= threshold * len(own - theirs) - 1e-12
    return sorted(block.count(w) for w in own)[len(own) // 2] > min(block.count(w) for w in theirs - own)


def plain_licenses(text, threshold=0.8):
    words = fold(text)
    starts, labels = [], set()
    for phrase, label in licenses.PHRASES.items():
        p = phrase.split()
        own = [i for i in range(len(words) - len(p) + 1) if words[i : i + len(p)] == p]
        starts += own
        labels |= {label} if own else set()
    base, score = ",".join(sorted(labels)), 1.0 if labels else 0.0
    for label, template in licenses.TEMPLATES:
        t = fold(template)
        for lo in range(0, len(words), len(t)):
            block = words[lo : lo + 2 * len(t)]
            share = len(set(t) & set(block)) / len(set(t))
            if share >= threshold - 1e-12 and all(told(set(t), set(fold(o)), block, threshold) for other, o in licenses.TEMPLATES if other != label):
                labels.add(label)
                score = max(score, share)
    return (len(words), len(starts), min(starts, default=None), max(starts, default=None), base, ",".join(sorted(labels)), score)


def test_licenses_equal_brute_force(spark):
    rng = random.Random(1)
    texts = [*TEXTS[:7], "word " * 30_000 + licenses.TEMPLATES[0][1] + " word" * 30_000, *(f"{a} x y {b}" for _, a in licenses.TEMPLATES[3:11:3] for _, b in licenses.TEMPLATES)]
    for _, t in licenses.TEMPLATES:
        words = t.split()
        for drop in (0, 1, 3, 6):
            kept = [w for i, w in enumerate(words) if i not in rng.sample(range(len(words)), drop)]
            texts.append(" ".join(["pre the of"] * rng.randrange(30) + kept + ["post"] * rng.randrange(30)))
    df = corpus(spark, texts)
    got = {r.doc_id: tuple(r)[1:] for r in licenses.scan_licenses(df).collect()}
    assert got == {i: plain_licenses(t) for i, t in enumerate(texts)}
    assert licenses.scan_licenses(df.limit(0)).count() == 0


def test_each_template_gives_its_own_label_alone(spark):
    df = spark.createDataFrame([(i, f"some words before. {t} And some after.") for i, (_, t) in enumerate(licenses.TEMPLATES)] + [(None, licenses.TEMPLATES[0][1])] * 2, "doc_id long, text string")
    rows = licenses.scan_licenses(df).collect()
    assert {r.doc_id: (r.labels, r.score) for r in rows} == {i: (label, 1.0) for i, (label, _) in enumerate(licenses.TEMPLATES)} | {None: (licenses.TEMPLATES[0][0], 1.0)} and len(rows) == len(licenses.TEMPLATES) + 2
    both = " ".join(t for label, t in licenses.TEMPLATES if label.startswith("cc-by"))
    assert licenses.scan_licenses(spark.createDataFrame([(1, both)], "doc_id long, text string")).first().labels == "cc-by,cc-by-sa"


def test_license_query_on_documents(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    rows = QUERIES["op1_license_scan"](spark, SMALL).collect()
    assert {r.doc_id: tuple(r)[1:] for r in rows} == {i: plain_licenses(t) for i, t in docs.items()} and len(rows) == len(docs)


PATTERNS = (
    ("assign", re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.I | re.A), lambda m: len(m[2]) >= 8),
    ("access", re.compile(r"AKIA[A-Z0-9]+"), lambda m: len(m[0]) >= 16),
    ("hex", re.compile(r"[0-9a-f]+"), lambda m: len(m[0]) >= 32),
)


def plain_secrets(text):
    found = [(m.start(), k, f"{kind}:{m.start()}:{m.end()}") for k, (kind, p, ok) in enumerate(PATTERNS) for m in p.finditer(text or "") if ok(m)]
    counts = [sum(f[1] == k for f in found) for k in range(3)]
    return (*counts, hashlib.sha256(",".join(f[2] for f in sorted(found)).encode()).hexdigest())


def test_secrets_equal_regular_expressions(spark):
    rng = random.Random(2)
    parts = ["password", "Passwd", "SECRET", "token", "api_key", "apikey", "=", ":", " ", '"', "'", "é", "abcdefgh", "abc", "0123456789abcdef", "AKIA", "AKIAABCD", "QWERTYUI", "AK", "=x", "ſecret", "\n"]
    texts = [None, "", "a" * 200_000, "token" + " " * 9000 + "=" + "abcdefghi", "password=atoken: abcdefghij", "AKIAAKIAAKIAAKIA"] + ["".join(rng.choices(parts, k=rng.randrange(1, 25))) for _ in range(1500)]
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in secrets.scan_secrets(corpus(spark, texts)).collect()}
    assert got == {i: plain_secrets(t) for i, t in enumerate(texts)}


def test_secret_query_on_documents_and_own_rules(spark):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{SMALL}/documents.parquet").collect()}
    got = {r.doc_id: (r.n_assign, r.n_access, r.n_hex, r.base_sha256) for r in QUERIES["op2_secret_scan"](spark, SMALL).collect()}
    assert got == {i: plain_secrets(t) for i, t in docs.items()}
    text = "é -----BEGIN RSA PRIVATE KEY----- ghp_" + "z1" * 18 + " http://me:pass@host xoxb-0123456789ab"
    row = secrets.scan_secrets(corpus(spark, [text])).first()
    assert [s.split(":")[0] for s in row.spans.split(",")] == ["pem", "forge", "url", "chat"]
    assert row.spans.startswith("pem:2:33") and row.n_hex == 0


def test_long_tokens_are_whole_and_failing_attempts_cheap():
    scanner, by = secrets.Scanner(), {r.kind: k for k, r in enumerate(secrets.RULES)}
    for head, body, sign in ((9000, 9000, 43), (40, 40, 20_000), (30_000, 30_000, 30_000)):
        token = b"eyJ" + b"hZ" * (head // 2) + b".eyJ" + b"Qx" * (body // 2) + b"." + b"s-" * (sign // 2 + 1)
        assert (4, by["jwt"], 4 + len(token)) in scanner.spans(b"see " + token + b" end")
    forged = b"ghp_" + b"Zz" * 10_000
    assert scanner.spans(forged) == [(0, by["forge"], len(forged))]
    # Each of these 200,000 attempts would read the rest of the text.
    text = b"eyJ" * 100_000 + b" " + b"eyJx." + b"eyJ" * 100_000
    began = time.process_time()
    assert scanner.spans(text) == [] and time.process_time() - began < 60


@pytest.mark.parametrize("seed", range(3))
def test_marks_change_no_span(seed):
    rng = random.Random(seed)
    pattern = re.compile(rb"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+")
    scanner, k = secrets.Scanner(), [r.kind for r in secrets.RULES].index("jwt")
    for _ in range(200):
        text = b"".join(rng.choices([b"eyJ", b"eyJa", b".", b".eyJ", b"b" * 30, b"c" * 70, b" ", b"-"], [6, 6, 2, 3, 4, 3, 1, 2], k=rng.randrange(1, 80)))
        want = [(m.start(), k, m.end()) for m in pattern.finditer(text) if len(m[0]) - m[0].rindex(b".") - 1 >= 16]
        assert [s for s in scanner.spans(text) if s[1] == k] == want


def test_secret_edges(spark):
    rows = [(1, "password = hunter2hunter2"), (1, "password = hunter2hunter2"), (None, "AKIA" + "Z" * 16), (3, None), (4, ""), (5, "é" * 400_000 + " token:abcdefgh12")]
    df = spark.createDataFrame([(*r, "own", 7) for r in rows], "doc_id long, text string, spans string, n_hex int")
    got = sorted(((r.doc_id, r.n_assign, r.n_access, r.n_hex, r.spans) for r in secrets.scan_secrets(df).collect()), key=repr)
    assert got == sorted([(1, 1, 0, 0, "assign:0:25"), (1, 1, 0, 0, "assign:0:25"), (None, 0, 1, 0, "access:0:20"), (3, 0, 0, 0, ""), (4, 0, 0, 0, ""), (5, 1, 0, 0, "assign:400001:400017")], key=repr)
    assert secrets.scan_secrets(df.limit(0)).count() == 0


def test_automaton_is_minimal():
    a = secrets.compile_patterns(("ab|cb",), False)
    assert len(a.rows) == 3 and secrets.Scanner._longest(a, b"cbx", 0) == 2


def plain_edits(item, text):
    cost = [0] * (len(text) + 1)
    for i, w in enumerate(item, 1):
        last, cost = cost, [i]
        for j, x in enumerate(text, 1):
            cost.append(min(last[j - 1] + (w != x), last[j] + 1, cost[j - 1] + 1))
    return min(cost)


def test_edit_distance_equals_plain():
    rng = random.Random(3)
    for _ in range(300):
        item, text = ([rng.randrange(4) for _ in range(rng.randrange(1, 9))] for _ in range(2))
        d, a, b = benchmark.edit_within(np.array(item, U), np.array(text, U))
        assert d == plain_edits(item, text) and plain_edits(item, text[a:b]) == d


def test_decontamination_recall_and_precision(spark):
    rng = random.Random(4)
    bag = ["the", "of", "in"] + [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(bag, k=rng.randrange(12, 60)))) for i in range(40)] + [(97, "lone"), (98, None), (99, "")]
    texts, edits = ["", None, "short"], {}
    for n in range(400):
        item, words = rng.choice(items[:40])[0], rng.choices(bag, k=rng.randrange(0, 200))
        copy = items[item][1].upper().split()
        for _ in range(d := rng.randrange(0, int(0.15 * len(copy)) + 1)):
            at = rng.randrange(len(copy))
            copy[at : at + 1] = rng.choice([[], ["zz"], [copy[at], "yy"]])
        at = rng.randrange(len(words) + 1)
        edits[len(texts)] = (item, d)
        texts.append(" ".join(words[:at] + copy + words[at:]))
    rows = benchmark.contaminated(corpus(spark, texts), spark.createDataFrame(items, "item_id long, text string")).collect()
    got = {(r.doc_id, r.item_id): r for r in rows}
    assert len(got) == len(rows)
    assert all((i, k) in got for i, (k, d) in edits.items() if d == 0)
    assert sum((i, k) in got for i, (k, d) in edits.items()) >= 0.95 * len(edits)
    for (i, k), r in got.items():
        words, item = fold(texts[i]), fold(dict(items)[k])
        assert r.distance <= 0.2 * len(item) and plain_edits(item, words[r.first_word : r.last_word + 1]) == r.distance
    left = benchmark.decontaminate(corpus(spark, texts), spark.createDataFrame(items, "item_id long, text string"))
    assert {r.doc_id for r in left.collect()} == set(range(len(texts))) - {i for i, _ in got}
    assert benchmark.contaminated(corpus(spark, texts).limit(0), spark.createDataFrame(items, "item_id long, text string")).count() == 0
    assert benchmark.contaminated(corpus(spark, texts), spark.createDataFrame([], "item_id long, text string")).count() == 0


def found_in(items, texts):
    index = benchmark.Index(items, benchmark.Plan())
    return {(r, index.items[k][0]): told for r, k, told in benchmark._found(pa.array(texts, pa.string()), index)}


@pytest.mark.parametrize("length", [1, 2, 3, 4, 5, 6, 7, 8, 9, 10, 11, 12, 14, 15, 16, 19, 20, 25, 32, 40, 50, 60, 100])
def test_decontamination_recall_by_length(length):
    """With exactly a fifth of the words edited; copies without edits are all found."""
    rng = random.Random(length)
    bag = [f"w{i}" for i in range(400)]
    items = [(i, " ".join(rng.choices(bag, k=length))) for i in range(50)]
    texts = []
    for n in range(300):
        copy, kind = items[n % 50][1].split(), rng.randrange(4)
        places = rng.sample(range(length), int(0.2 * length))
        if kind == 0 and places:
            places = list(range(len(places)))
        for at in sorted(places, reverse=True):
            copy[at : at + 1] = [["zz"], [], [copy[at], "yy"], ["zz"]][kind if kind else 0]
        texts.append(" ".join(rng.choices(bag, k=rng.randrange(60)) + copy + rng.choices(bag, k=rng.randrange(60))))
    texts += [" ".join(rng.choices(bag, k=rng.randrange(60)) + t.split() + rng.choices(bag, k=rng.randrange(60))) for _, t in items]
    got = found_in(items, texts)
    assert sum((n, n % 50) in got for n in range(300)) >= 0.95 * 300
    assert all(got[300 + n, n][0] == 0 for n in range(50))


def test_decontamination_edges(spark):
    passage = " ".join(f"w{i}" for i in range(30))
    items = [(1, passage), (2, passage.upper()), (1, passage), (None, "only this one"), (5, "rest of it all")]
    rows = [(7, f"x y {passage} z"), (7, f"x y {passage} z"), (8, passage.replace("w3 ", "")), (None, "say ONLY this one."), (9, "w " * 200_000 + passage), (10, None), (None, "clean"), (None, None)]
    docs = spark.createDataFrame([(*r, "a", 1) for r in rows], "doc_id long, text string, item_id string, distance int")
    found = spark.createDataFrame(items, "item_id long, text string")
    got = sorted((tuple(r) for r in benchmark.contaminated(docs, found).collect()), key=repr)
    want = [(7, k, 0, 2, 31) for k in (1, 1, 2)] * 2 + [(8, k, 1, 0, 28) for k in (1, 1, 2)] + [(9, k, 0, 200_000, 200_029) for k in (1, 1, 2)] + [(None, None, 0, 1, 3)]
    assert got == sorted(want, key=repr)
    left = benchmark.decontaminate(docs, found)
    assert sorted(((r.doc_id, r.text) for r in left.collect()), key=repr) == sorted([(10, None), (None, "clean"), (None, None)], key=repr) and left.columns == docs.columns
    small = benchmark.Plan(block_bytes=100)
    assert sorted((tuple(r) for r in benchmark.contaminated(docs, found, small).collect()), key=repr) == got and benchmark.decontaminate(docs, found, small).count() == 3


def test_items_with_a_common_head_are_cheap():
    head = " ".join(f"h{i}" for i in range(12))
    items = [(i, f"{head} {' '.join(f'a{i}b{k}' for k in range(12))}") for i in range(500)]
    texts = [" x y z ".join([head] * 20) for _ in range(20)] + [items[9][1]]
    began = time.process_time()
    assert set(found_in(items, texts)) == {(20, 9)} and time.process_time() - began < 30


def test_long_words_of_two_letters_are_no_match():
    one = "".join("ab"[bin(i).count("1") & 1] for i in range(4096))
    two = one.translate(str.maketrans("ab", "ba"))
    assert set(found_in([(1, one), (2, two)], [one, two])) == {(0, 1), (1, 2)}


def test_decontamination_query_finds_every_exact_passage(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    items = spark.read.parquet(f"{SMALL}/benchmark.parquet").collect()
    exact = {(d.doc_id, i.item_id) for d in docs for i in items if " ".join(fold(i.text)) in " ".join(fold(d.text))}
    got = {(r.doc_id, r.item_id) for r in QUERIES["op9_benchmark_decontamination"](spark, SMALL).where(F.col("distance") == 0).collect()}
    assert exact <= got and len(exact) > 0
