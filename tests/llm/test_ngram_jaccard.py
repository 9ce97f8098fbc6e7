import random
import re

import numpy as np
import pyarrow as pa

from pyspark.sql import functions as F

from cloneloom.llm import ngram_jaccard as J
from cloneloom.llm import texts as tx


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set()


def brute(docs):
    sets = {i: shingles(t) for i, t in docs}
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    ids = sorted(sets)
    for k, a in enumerate(ids):
        for b in ids[:k]:
            if sets[a] and sets[b]:
                both = len(sets[a] & sets[b])
                if 100 * both >= 80 * (len(sets[a]) + len(sets[b]) - both):
                    x, y = find(a), find(b)
                    root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i)) for i in ids}


def words(rng, n):
    return [rng.choice("abcdefghij") + str(rng.randrange(500)) for _ in range(n)]


def mutated(rng, w, k):
    w = list(w)
    for _ in range(k):
        i = rng.randrange(len(w))
        w[i : i + rng.randrange(2)] = words(rng, rng.randrange(1, 3))
    return w


def family_docs():
    rng = random.Random(5)
    docs, n = [], 0
    for size in (3, 8, 40, 75, 150, 600):
        base = words(rng, size)
        passage = words(rng, 60)
        for _ in range(45):
            w = mutated(rng, base, rng.randrange(0, 1 + max(1, size // 12)))
            docs.append((n, " ".join(w)))
            n += 3
        for _ in range(10):  # other documents that share a passage
            docs.append((n, " ".join(words(rng, 80) + passage + words(rng, 40)).upper()))
            n += 1
    docs += [(n + 1, None), (n + 2, ""), (n + 3, " \t\n"), (n + 4, "one"), (n + 5, "ONE"), (n + 6, "one two"), (n + 7, docs[0][1]), (n + 8, docs[0][1])]
    rng.shuffle(docs)
    return docs


def test_components_match_brute_force(spark):
    docs = family_docs()
    df = spark.createDataFrame(docs, "doc_id long, text string").repartition(3)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.near_duplicates(df).collect()}
    assert got == brute(docs)


def test_empty_and_clashing_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert J.near_duplicates(empty).collect() == []
    odd = spark.createDataFrame([(1, "a b c d e f", 2, "x"), (None, "a b c d e f", 3, "y"), (4, "a b c d e f", 5, "z")], "doc_id long, text string, node long, component_id string")
    got = sorted(((r.doc_id, r.component_id) for r in J.near_duplicates(odd).collect()), key=str)
    assert got == [(1, 1), (4, 1), (None, None)]


def test_block_links_connect_what_brute_force_connects():
    rng = np.random.default_rng(1)
    base = rng.integers(0, 1 << 40, 60).astype(np.uint64)
    sets = []
    for _ in range(40):
        x = base.copy()
        x[rng.choice(60, rng.integers(0, 9), replace=False)] = rng.integers(0, 1 << 40, 1).astype(np.uint64)
        sets.append(np.unique(x))
    got = J.block_links(sets, np.zeros(40, int), np.arange(40))
    root = list(range(40))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, j in got:
        root[find(i)] = find(j)
    for i in range(40):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 80 * (len(sets[i]) + len(sets[j]) - both):
                assert find(i) == find(j)
    assert all(100 * len(np.intersect1d(sets[i], sets[j])) >= 80 * len(np.union1d(sets[i], sets[j])) for i, j in got)


def test_sketch_distance_bounds_symmetric_difference():
    rng = random.Random(2)
    a = words(rng, 300)
    b = mutated(rng, a, 6)
    col = pa.array([" ".join(a), " ".join(b)])
    (_, _, h, borders) = next(iter(J.shingle_sets(col)))
    s, rows, up = J._both(h, borders, True)
    own = [set(s[(rows == r) & (up == 0)].tolist()) for r in (0, 1)]
    x, y = (set(h[borders[r] : borders[r + 1]].tolist()) for r in (0, 1))
    if J.band(np.array([len(x)])) == J.band(np.array([len(y)])):
        assert len(own[0] - own[1]) <= len(x ^ y) and len(own[1] - own[0]) <= len(x ^ y)


def test_words_equal_the_regular_expression():
    texts = ["", None, " a  b\tc\n", "É à\x0b\x0cx", "no-break space", "z"]
    got = {}
    for at, n, raw, off in tx.slices(pa.array(texts)):
        h, rows = tx.words(raw, off)
        for i in range(n):
            got[at + i] = h[rows == i].tolist()
    for i, t in enumerate(texts):
        assert len(got[i]) == len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))


def test_a_flush_of_cells_is_small(spark):
    words = F.transform(F.sequence(F.lit(0), F.lit(39)), lambda x: F.concat(F.lit("w"), (F.col("id") * 40 + x).cast("string")))
    docs = spark.range(17000, numPartitions=1).select(F.col("id").alias("doc_id"), F.array_join(words, " ").alias("text"))
    J.ship(spark)
    sizes = [r.n for r in J.packed_cells(docs, 1, True).select((F.octet_length("sigs") + F.octet_length("nodes")).alias("n")).collect()]
    assert sum(sizes) == 17000 * 36 * 16
    assert max(sizes) <= 8 << 20
