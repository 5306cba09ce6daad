import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from sonaris.llm import common, near_dup
from sonaris.llm.near_dup import components, estimates, near_duplicates, sketch

WORD = re.compile(r"[^\x20\x09-\x0D]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def shingles(text, k):
    w = WORD.findall((text or "").translate(LOWER))
    return frozenset(zip(*(w[i:] for i in range(k)))) if len(w) >= k else frozenset([tuple(w)] if w else [])


def brute(rows, k, threshold=80):
    """{row: (n, component)} by comparing all pairs."""
    sets = [shingles(t, k) for _, t in rows]
    up = list(range(len(rows)))

    def find(i):
        while up[i] != i:
            i = up[i]
        return i

    inverted = {}
    for i, s in enumerate(sets):
        for x in s:
            inverted.setdefault(x, []).append(i)
    for i, s in enumerate(sets):
        near = {j for x in s for j in inverted[x] if j < i}
        for j in near:
            both = len(s & sets[j])
            if 100 * both >= threshold * (len(s) + len(sets[j]) - both):
                up[find(i)] = find(j)
    low = {}
    for i, (key, _) in enumerate(rows):
        if key is not None:
            low[find(i)] = min(low.get(find(i), key), key)
    return sorted((((key is None, key or 0), len(sets[i]), low.get(find(i)), key == low.get(find(i))) for i, (key, _) in enumerate(rows)), key=str)


def check(spark, rows, k):
    df = spark.createDataFrame(rows, "doc_id long, text string").repartition(5).withColumn("class", F.lit("clash")).withColumn("key", F.lit(0))
    got = sorted((((r.doc_id is None, r.doc_id or 0), r.n_shingles, r.component_id, r.kept) for r in near_duplicates(df, k=k).collect()), key=str)
    assert got == brute(rows, k)


def edited(words, n, rng):
    out = list(words)
    for _ in range(n):
        i = rng.randrange(len(out))
        kind = rng.random()
        if kind < 0.4:
            del out[i]
        elif kind < 0.7:
            out.insert(i, f"new{rng.randrange(10**9)}")
        else:
            out[i] = f"new{rng.randrange(10**9)}"
    return " ".join(out)


def test_groups_chains_and_edges(spark):
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(4000)]
    texts = [None, "", "  \n", "one", "one", "One", "one two", "one two three four five", "a b c d", "A  b\tc\nd", "é É x y z q"]
    shared = " ".join(rng.choices(vocabulary, k=60))
    for _ in range(25):
        base = rng.choices(vocabulary, k=rng.choice([8, 20, 60, 150, 400]))
        texts += [edited(base, rng.randrange(0, max(1, len(base) // 12) + 1), rng) for _ in range(rng.randint(1, 6))]
    texts += [shared + " " + " ".join(rng.choices(vocabulary, k=rng.choice([5, 20, 60]))) for _ in range(40)]
    chain = rng.choices(vocabulary, k=120)
    for _ in range(12):
        texts.append(" ".join(chain))
        chain = edited(chain, 3, rng).split()
    texts += [" ".join(rng.choices(vocabulary, k=12000))] * 3
    ids = list(range(len(texts)))
    rng.shuffle(ids)
    rows = list(zip(ids, texts)) + [(None, "one two three four five"), (None, "lonely null key text here"), (3, texts[30]), (ids[20], texts[20])]
    check(spark, rows, 4)


def test_one_large_group_of_near_copies(spark, monkeypatch):
    """More members than one step takes, most of them linked through the original alone."""
    monkeypatch.setattr(near_dup, "SMALL_GROUP", 20)
    monkeypatch.setattr(near_dup, "BLOCK", 40)
    monkeypatch.setattr(near_dup, "HUB_PAIRS", 50)
    rng = random.Random(6)
    base = [f"b{i}" for i in range(147)]
    rows = [(1000 - i, edited(base, rng.choice([0, 1, 2, 3, 4, 5, 6, 8]), rng)) for i in range(260)]
    rows += [(2000 + i, " ".join(base)) for i in range(300)]
    check(spark, rows, 4)


def test_documents(spark, sf):
    rows = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()]
    check(spark, rows, 5)


def test_tables_can_be_cleaned_up(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(common, "shared_dir", lambda spark: f"file://{tmp_path}")
    monkeypatch.setattr(common, "_tables", set())
    found = near_duplicates(spark.createDataFrame([(i, f"a b c d e {i // 2}") for i in range(20)], "doc_id long, text string"), k=4)
    assert found.where("kept").count() == 10 and any(tmp_path.iterdir())
    assert len(list(tmp_path.glob("*-*"))) == len(common._tables) < 12
    common.clean(spark)
    assert not any(tmp_path.glob("*-*")) and not common._tables


def test_a_cluster_needs_a_shared_folder():
    class Session:
        class conf:
            get = staticmethod(lambda name, default: default)

        class sparkContext:
            master = "spark://host:7077"
            getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(RuntimeError):
        common.shared_dir(Session)
    Session.sparkContext.master = "local[4]"
    assert common.shared_dir(Session) == common.LOCAL_CHECKPOINTS


def test_empty_table(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    assert near_duplicates(spark.createDataFrame([(1, None)], "doc_id long, text string")).first().kept


def test_estimates_are_near():
    rng = np.random.default_rng(0)
    for share in (0.0, 0.5, 0.8, 1.0):
        found = []
        for _ in range(200):
            pool = rng.integers(0, 1 << 64, 1000, dtype=np.uint64)
            inter = int(1000 * share)
            rest = (1000 - inter) // 2
            a = np.unique(np.concatenate([pool[:inter], pool[inter : inter + rest]]))
            b = np.unique(np.concatenate([pool[:inter], pool[inter + rest : inter + 2 * rest]]))
            n = np.array([len(a)])
            found.append(float(estimates(sketch(a)[None], sketch(b)[None], n, np.array([len(b)]))[0]))
        assert np.mean(found) == pytest.approx(share, abs=0.02)


def test_components(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(400), rng.randrange(400)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1060)]
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    low = {}
    for a, b in edges:
        low.setdefault(a, a), low.setdefault(b, b)
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(low[a], low[b])
            if low[a] != m or low[b] != m:
                low[a] = low[b] = m
                changed = True
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {k: v for k, v in low.items() if k in linked and k != v}
