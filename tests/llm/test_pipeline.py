"""Each stage of the corpus pipeline against a plain Python version, on a small table."""

import random
from collections import Counter

import pytest
from test_ngram_jaccard import brute, mutated, words

import corpus_pipeline
from cloneloom.llm import mixing

tokenizers = pytest.importorskip("tokenizers")
pytest.importorskip("public_tokenizers")
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def documents(spark):
    rng = random.Random(9)
    syllables = {"aa": "ka ta na ra ma".split(), "bb": "zil vop quex jud wyf".split()}
    rows = []
    for i in range(80):
        lang = ("aa", "bb")[i % 2]
        w = ["".join(rng.choice(syllables[lang]) for _ in range(rng.randrange(2, 5))) for _ in range(60)]
        rows.append((i, " ".join(w[:30]) + "\n" + " ".join(w[30:]), lang, f"s{i % 5}"))
    rows += [(100 + i, rows[i][1], rows[i][2], "s1") for i in range(10)]  # exact copies
    rows += [(200 + i, " ".join(mutated(rng, rows[i][1].replace("\n", " ").split(" "), 1)), rows[i][2], "s2") for i in range(10)]
    rows += [(300, None, "aa", "s1"), (301, "12 34 !!", "aa", "s1"), (302, "", None, None)]
    rows = [(*r, len(r[1]) if r[1] is not None else None) for r in rows]
    return spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")


def test_stages(spark, tmp_path):
    docs = documents(spark)
    stages = [f for _, f in corpus_pipeline.STAGES]

    def through(k, df):
        out = stages[k](spark, df, str(tmp_path))
        out.write.parquet(str(tmp_path / str(k)))
        return spark.read.parquet(str(tmp_path / str(k)))

    kept = through(0, docs)
    assert kept.columns == COLUMNS
    assert {r.doc_id for r in docs.collect()} - {r.doc_id for r in kept.collect()} == {300, 301, 302}

    lines = through(1, kept)
    assert lines.columns == COLUMNS
    got = {r.doc_id: r for r in lines.collect()}
    assert not set(got) & set(range(100, 110))  # nothing is left of exact copies
    assert all(got[i].text == r.text for r in kept.collect() if (i := r.doc_id) < 80)
    assert all(r.n_chars == len(r.text) for r in got.values())

    one = through(2, lines)
    want = brute([(r.doc_id, r.text) for r in got.values()])
    assert sorted(r.doc_id for r in one.collect()) == sorted(i for i, (_, c) in want.items() if c == i)
    again = stages[2](spark, kept, str(tmp_path))
    want = brute([(r.doc_id, r.text) for r in kept.collect()])
    assert sorted(r.doc_id for r in again.collect()) == sorted(i for i, (_, c) in want.items() if c == i)

    mixed = through(3, one)
    reps = {r.doc_id: r.reps for r in mixing.mix_sources(one.select("doc_id", "text", "source")).collect()}
    assert Counter(r.doc_id for r in mixed.collect()) == Counter({i: n for i, n in reps.items() if n})

    tokens = through(4, mixed)
    lib = tokenizers.Tokenizer.from_file(corpus_pipeline.word_bpe_path())
    text = {r.doc_id: r.text for r in mixed.collect()}
    assert tokens.count() == mixed.count()
    assert all(r.n_tokens == len(lib.encode(text[r.doc_id], add_special_tokens=False).ids) for r in tokens.collect())


def test_copies_that_share_an_id(spark, tmp_path):
    rng = random.Random(3)
    a, b, c, d = (" ".join(words(rng, 60)) for _ in range(4))
    near = " ".join(mutated(rng, d.split(" "), 1))
    rows = [(1, a), (2, a), (2, b), (3, b), (3, c), (3, c), (4, d), (4, near), (5, None), (5, ""), (5, ""), (None, a)]
    docs = spark.createDataFrame([(i, t, "aa", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    linked = brute([(1, d), (2, near)])[2][1] == 1
    got = [(r.doc_id, r.text) for r in corpus_pipeline.copies_stage(spark, docs, str(tmp_path)).collect()]
    want = [(1, a), (2, b), (3, c), (5, None), (5, ""), (None, a)]
    assert linked and Counter(x for x in got if x[0] != 4) == Counter(want)
    assert len([x for x in got if x[0] == 4]) == 1


def test_words_helper():
    assert len(words(random.Random(1), 3)) == 3
