"""Small tests of the operators: brute force, round trips, held-out accuracy, and the odd inputs that each docstring names."""

import hashlib
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneloom.llm import ann_permutation, bpe, common, langid, line_dedup, mixing, pii, topk_blocks, toxicity, url_filter
from cloneloom.llm.common import min_labels
from cloneloom.llm.queries import URL_RULES

tokenizers = pytest.importorskip("tokenizers")
public_tokenizers = pytest.importorskip("public_tokenizers")
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")


# encoding

ODD = ["", "a<|endoftext|>b <|startoftext|>", "It's ΣΑΣ İstanbul don't 123 ½ \x1c a\x1db 　x́ é ' s 's", "日本語テキスト 한국어 😀😀 ...!!! <|x|>", "A\u0085B\u00a0C\u2028D", "the" * 500, "<|endoftext|><|endoftext|>  \n", "\x00\ufeff\u200b"]


def test_encoding_equals_the_library(spark):
    rng = random.Random(1)
    texts = ODD + ["".join(rng.choice("abcdefghij éß'!?-_ \n19ΣİǅǺ") for _ in range(200)) for _ in range(60)] + ["".join(rng.choice("thinganererreonat") for _ in range(80)) for _ in range(40)]
    lib = tokenizers.Tokenizer.from_file(TOKENIZER)
    docs = spark.createDataFrame([(i, t, 1) for i, t in enumerate([*texts, None])], "doc_id long, text string, n_tokens int")
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    for r in bpe.encode_documents(docs, TOKENIZER, ids=True).collect():
        e = lib.encode(texts[r.doc_id] if r.doc_id < len(texts) else "", add_special_tokens=False)
        assert r.ids == e.ids and r.n_tokens == len(e.ids)
        assert r.ids_sha256 == sha(" ".join(map(str, e.ids)))
        assert r.decoded_sha256 == sha(lib.decode(e.ids, skip_special_tokens=False))
    assert bpe.encode_documents(docs.limit(0), TOKENIZER).count() == 0


def test_very_long_words_and_texts(spark):
    """Time and memory that grew with the square of a word's length would not end here."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("thinganererreonat") for _ in range(1_000_000)), "the cat's " * 100_000, "é" * 100_000]
    lib = tokenizers.Tokenizer.from_file(TOKENIZER)
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "doc_id long, text string")
    for r in bpe.encode_documents(docs, TOKENIZER, ids=True).collect():
        assert r.ids == lib.encode(texts[r.doc_id], add_special_tokens=False).ids


def test_compatible_pairs_are_those_that_merging_leaves():
    m = bpe.TrieBPE(open(TOKENIZER, encoding="utf-8").read())
    rng = random.Random(2)
    inner = [t for t, p in m.parts.items() if m.char[p[-1]] < chr(0xE000)]
    for _ in range(3000):
        a, b = rng.choice(inner), rng.choice(list(m.parts))
        assert m.compatible(a, b) == (m.merge(m.parts[a] + m.parts[b]) == [a, b])


def test_tokens_that_a_word_can_end_with_are_found_by_links():
    """Longest first, all of them, in few lookups a symbol, whatever word came before."""
    m = bpe.TrieBPE(open(TOKENIZER, encoding="utf-8").read())
    whole = {p: t for t, p in m.parts.items() if len(p) == 1 or m.merge(p) == [t]}
    number = {t: (ord(c) - 0xE000 + 256 if c >= chr(0xE000) else m.symbols.index(c)) for t, c in m.char.items()}
    rng = random.Random(4)
    inner = {t for t, i in number.items() if i < 256}
    for _ in range(500):
        text = [x for _ in range(4) for x in m.parts[rng.choice(list(m.parts))] if x in inner][:12]
        at = 0
        for x in text:
            at = m.step(at, number[x])
        found, node = [], m.first[at]
        while node:
            found.append(m.end[node])
            node = m.shorter[node]
        assert found == [whole[tuple(text[k:])] for k in range(len(text)) if tuple(text[k:]) in whole]

    class Counted(dict):
        asked = 0

        def get(self, key):
            Counted.asked += 1
            return super().get(key)

    m.pairs, m.steps = Counted(), Counted()
    lib = tokenizers.Tokenizer.from_file(TOKENIZER)
    words = {"".join(rng.choice(["th", "in", "ge", "rer", "eo", "nat", "é", "ß"]) for _ in range(rng.randrange(1, 6))) for _ in range(5000)}
    got = m.encode_words(words | {w + "s" for w in words})
    assert all(got[w].split() == list(map(str, lib.encode(w, add_special_tokens=False).ids)) for w in got)
    assert Counted.asked < 2.5 * sum(len(w.encode()) for w in got)


# URL filter

def judge(url):
    host, path = "", ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        host = re.match(r"[^/?#]*", rest)[0]
        path = re.match(r"[^?#]*", rest[len(host) :])[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
    fits = [(len(h + p), h + p, v) for h, p, v in URL_RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    best = max(fits, default=(0, None, "allow"))
    return host, path, best[1], best[2]


def test_urls(spark):
    urls = [None, "", "no scheme", "http://", "http://A.Example.COM/en/7x?q", "https://example.com/en/7", "https://xexample.com/en/8", "http://example.net/de/8#a", "http://notexample.net/de/9", "http://m.net/de", "http://org/es/", "http://a.b.org/es/1://x/en/", "http://com?x/en/", "http://É.com/en/\nx", "x://com/en/" + "y" * 5000, "http://" + "a." * 300 + "com/en/"]
    rows = [(i, u, "h") for i, u in enumerate(urls + urls[4:6])] + [(0, urls[4], "h")]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    got = sorted(map(tuple, url_filter.judge_urls(pages, rules).collect()), key=repr)
    assert got == sorted(((i, *judge(u)) for i, u, _ in rows), key=repr)
    assert {r.verdict for r in url_filter.judge_urls(pages, rules.limit(0)).collect()} == {"allow"}
    assert url_filter.judge_urls(pages.limit(0), rules).count() == 0


def test_filter_has_no_false_negatives(spark):
    keys = spark.range(5000).select(F.concat(F.lit("h"), "id", F.lit("/p")).alias("key"))
    blocks = url_filter.bloom_blocks(keys, 313)
    assert url_filter.bloom_pass(keys, blocks, 313).count() == 5000
    others = spark.range(5000).select(F.concat(F.lit("x"), "id").alias("key"))
    assert url_filter.bloom_pass(others, blocks, 313).count() < 500


# mixing

def test_mix(spark):
    rng = random.Random(3)
    docs = [(i, "w " * rng.randrange(0, 60), f"s{i % 7}" if i % 11 else None, "x") for i in range(3000)] + [(None, "a b", "s1", "x"), (5000, None, "s2", "x")]
    df = spark.createDataFrame(docs, "doc_id long, text string, source string, size string")
    rows = mixing.mix_sources(df).collect()
    assert len(rows) == len(docs)
    total = sum(r["size"] for r in rows)
    targets = {r.source: (r.target, r.source_size) for r in rows}
    assert abs(sum(t for t, _ in targets.values()) - 1.5 * total) < 1e-6
    for s, (t, n) in targets.items():
        assert t <= 2 * n + 1e-9
        taken = sum(r["size"] * r.reps for r in rows if r.source == s)
        assert abs(taken - t) <= max(r["size"] for r in rows if r.source == s)
    free = {s: t for s, (t, n) in targets.items() if t < 2 * n}
    order = sorted((s for s in targets if s is not None)) + [None]
    level = {round(t / (3, 1, 2)[order.index(s) % 3], 6) for s, t in free.items()}
    assert len(level) == 1 and all(r.reps <= 2 for r in rows)
    again = mixing.mix_sources(df.repartition(5)).collect()
    assert sorted(map(str, rows)) == sorted(map(str, again))
    assert mixing.mix_sources(df.limit(0)).count() == 0


# searches

def vectors(spark, n, extra=()):
    rng = np.random.default_rng(4)
    m = rng.normal(size=(n, 16)).astype(np.float32)
    m[::5] = m[0]  # one frequent vector
    rows = [(i, [float(x) for x in v], 0) for i, v in enumerate(m)] + list(extra)
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, seg int"), m


BAD = [(9001, None, 0), (9002, [0.0] * 16, 0), (9003, [float("nan")] * 16, 0), (9004, [None] + [1.0] * 15, 0), (9005, [float("inf")] * 16, 0), (9006, [], 0), (None, [1.0] * 16, 0), (9100, [1.0, 2.0], 0)]


def test_exact_products(spark):
    df, m = vectors(spark, 700, BAD)
    w = np.floor(64 * m.astype(float))
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_blocks.search_products(df).collect()}
    w = np.vstack([w, np.zeros(16)])
    ids = np.append(np.arange(700), 9002)  # a zero vector takes part
    for q in range(0, 700, 20):
        s = w @ w[q]
        order = [i for i in np.lexsort((ids, -s)) if ids[i] != q][:20]
        assert [got[q, k + 1] for k in range(20)] == [(int(ids[i]), int(s[i])) for i in order]
    assert topk_blocks.search_products(df.limit(0)).count() == 0


def test_large_products(spark):
    """Products beyond 2**53, some beyond a long, beside small ones; of equal ones the smaller id comes first."""
    rng = np.random.default_rng(5)
    m = rng.normal(size=(300, 8))
    m[::4] *= 1e7
    m[10], m[20], m[21], m[22] = 1e9, 2.0**30, 2.0**30, 2.0**30
    m[22][0] += 1 / 64
    df = spark.createDataFrame([(i, [float(x) for x in v]) for i, v in enumerate(m)], "vec_id long, embedding array<double>")
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk_blocks.search_products(df).collect()}
    w = [[int(x) for x in r] for r in np.floor(64 * m).tolist()]
    for q in range(0, 300, 20):
        s = sorted((-sum(a * b for a, b in zip(w[i], w[q], strict=True)), i) for i in range(300) if i != q)[:20]
        assert {got[q, k + 1] for k in range(20)} == {(i, min(2**63 - 1, -x)) for x, i in s}
        if -s[0][0] < 2**63:
            assert [got[q, k + 1] for k in range(20)] == [(i, -x) for x, i in s]


def test_nearest_of_several_lengths(spark):
    """The first length alone has more candidates for pivots than one limit for all lengths let through."""
    rng = np.random.default_rng(6)
    rows = [(i, [float(x) for x in rng.normal(size=4 if i < 6000 else 8)]) for i in range(6400)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = ann_permutation.search_nearest(df).collect()
    assert {(r.query_id, r["rank"]) for r in got} == {(q, k) for q in range(0, 6400, 100) for k in range(1, 11)}
    assert all((r.query_id < 6000) == (r.vec_id < 6000) for r in got)


def test_nearest(spark, monkeypatch):
    df, m = vectors(spark, 3000, BAD)
    rows = ann_permutation.search_nearest(df).collect()
    got = {}
    for r in rows:
        got.setdefault(r.query_id, {})[r["rank"]] = (r.vec_id, r.score)
    m = m.astype(float)
    hits = total = 0
    for q in range(0, 3000, 100):
        d = np.sqrt(((m - m[q]) ** 2).sum(1))
        order = [i for i in np.lexsort((np.arange(3000), d)) if i != q][:10]
        assert sorted(got[q]) == list(range(1, 11))
        for v, s in got[q].values():
            assert abs(s - d[v]) < 1e-9
        hits += len({v for v, _ in got[q].values()} & set(order))
        total += 10
    assert hits >= 0.95 * total
    assert not {r.vec_id for r in rows} & {9001, 9002, 9003, 9004, 9005, 9006}
    assert ann_permutation.search_nearest(df.limit(0)).count() == 0


# classifiers

def test_language(spark):
    rng = random.Random(5)
    syllables = {"aa": "ka ta na ra ma".split(), "bb": "zil vop quex jud wyf".split()}
    word = lambda l: "".join(rng.choice(syllables[l]) for _ in range(rng.randrange(1, 4)))
    docs = [(i, " ".join(word(l) for _ in range(30)), l, 0.5) for i in range(300) for l in [("aa", "bb")[i % 2]]] + [(1000, None, "aa", 0.5), (1001, "12 !?", "bb", 0.5), (1002, "", None, 0.5)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string, score double")
    got = {r.doc_id: r for r in langid.identify(df).collect()}
    assert len(got) == len(docs)
    held = [(i, l) for i, _, l, _ in docs[:300] if got[i].held_out]
    assert held and sum(got[i].lang_pred == l for i, l in held) >= 0.95 * len(held)
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (1000, 1001, 1002))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert langid.identify(df.limit(0)).count() == 0


def test_toxicity(spark):
    rng = random.Random(6)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(4))
    bad = ["scorn", "vilest", "rotter"]
    docs, labels = [], []
    for i in range(1500):
        toxic = i % 8 == 0
        w = [word() for _ in range(40)]
        if toxic:
            for _ in range(3):
                w[rng.randrange(40)] = rng.choice(bad)
        docs.append((i, " ".join(w), "en"))
        if i % 2 == 0:
            labels.append((i, int(toxic), 1))
    docs += [(3000, None, "en"), (3001, "", "en"), (3002, "x" * 100_000, "en")]
    d = spark.createDataFrame(docs, "doc_id long, text string, predicted string")
    l = spark.createDataFrame(labels, "doc_id long, toxic int, score int")
    got = {r.doc_id: r for r in toxicity.toxicity(d, l).collect()}
    assert len(got) == len(docs)
    held = [i for i in range(1500) if got[i].held_out]
    toxic = [got[i].predicted for i in held if i % 8 == 0]
    clean = [got[i].predicted for i in held if i % 8]
    assert sum(toxic) >= 0.9 * len(toxic) and sum(clean) <= 0.02 * len(clean)
    assert got[3000].score == got[3001].score
    assert {r.score for r in toxicity.toxicity(d, l.limit(0)).collect()} == {0.0}
    assert toxicity.toxicity(d.limit(0), l).count() == 0


# personal data

def test_repeated_ids_count_once_in_the_fit(spark, monkeypatch):
    docs = spark.createDataFrame([(1, f"word{i % 7}") for i in range(400)] + [(i, "other words") for i in range(2, 60)], "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 == 0)) for i in range(1, 60)] * 2, "doc_id long, toxic int")
    seen = []
    monkeypatch.setattr(toxicity, "nnpu", lambda pos, unl, prior: seen.append((len(pos), len(unl))) or (np.zeros(1 << toxicity.BITS), 0.0))
    toxicity.fit(docs, labels)
    learn = [r.doc_id for r in docs.distinct().select("doc_id").distinct().where(common.fold() != 0).collect()]
    assert seen == [(sum(i % 3 == 0 for i in learn), len(learn))]


def base(t):
    def luhn(s):
        x = [int(c) for c in s][::-1]
        return sum(v if i % 2 == 0 else (v * 2 - 9 if v * 2 > 9 else v * 2) for i, v in enumerate(x)) % 10 == 0

    forms = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(x) <= 255 for x in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 16 <= len(re.sub("[ -]", "", s)) <= 19 and luhn(re.sub("[ -]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 8 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    return [(k, m.start(), m.end()) for k, p, ok in forms for m in re.finditer(p, t) if ok(m[0])]


def test_personal_data(spark):
    texts = [
        None, "", "a@b.co_x@d.org x@y..z a@b.c. 1.2.3.4.5.6.7.8 256.1.1.1 001.002.003.004 +1 (23) 4-5 +12345678 +1234567",
        "4111 1111-1111 1111 4111111111111111 4111111111111112 " + "9" * 30 + " " + "1 2 3 4 5 " * 2000, "é😀 a@b.com " + "a." * 5000 + "@" + "b." * 5000 + "c", "+1 (269) 555-3296 55.63.178.142",
    ]
    texts += [f"write to dial {i}: +1 (269) 555-{1000 + i} now" for i in range(30)] + ["write to dial 9: 269-555-1234 now", "call 7: 269-555-1234 now"]
    df = spark.createDataFrame([(i, t, 1) for i, t in enumerate(texts)], "doc_id long, text string, spans int")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    for i, t in enumerate(texts):
        b = base(t or "")
        written = ",".join(f"{k}:{s}:{e}" for k, s, e in b)
        assert got[i].base_sha256 == hashlib.sha256(written.encode()).hexdigest(), i
        assert [got[i][f"n_{k}"] for k in ("email", "ip", "card", "phone")] == [sum(x[0] == k for x in b) for k in ("email", "ip", "card", "phone")]
        assert set(written.split(",")) <= set(got[i].spans.split(",")) or not b
    assert pii.personal_data(df.limit(0)).count() == 0


def test_texts_of_very_many_identifiers(spark):
    """Spans of more than one piece; instances that begin a seed, hold one's start, or lie within one."""
    n = 3000
    text = " ".join(f"a{i}@b.org" for i in range(n)) + " (+1 (269) 555-1000) " + "9" * 16 + " 4111 1111 1111 1111"
    df = spark.createDataFrame([(1, text, "x"), (2, "a@b.org", "y")], "doc_id long, text string, start string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    want = base(text)
    assert got[1].n_email == n and got[1].spans == ",".join(f"{k}:{s}:{e}" for k, s, e in want) and got[1].n_found == 0
    assert got[1].base_sha256 == hashlib.sha256(got[1].spans.encode()).hexdigest()


def test_contexts_find_what_the_forms_miss(spark):
    texts = [f"dial +1 (269) 555-{1000 + i} now" for i in range(30)] + ["dial 269-555-1234 now", "part 269-555-1234 now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r for r in pii.personal_data(df).collect()}
    assert got[30].spans == "phone:5:17" and got[30].n_found == 1 and got[30].n_phone == 0
    assert got[31].spans == ""


def test_found_instances_teach_other_contexts(spark):
    """"ring" has no seed: it is trusted for what "dial" found, and "buzz" for what "ring" found."""
    texts = [f"dial +1 (269) 555-{1000 + i} now" for i in range(400)] + [f"dial 269-555-{2000 + i} now" for i in range(10)]
    texts += [f"ring 269-555-{2000 + i} now" for i in range(10)] * 4 + [f"ring 269-555-{3000 + i} now" for i in range(3)]
    texts += [f"buzz 269-555-{3000 + i % 3} now" for i in range(60)] + ["buzz 269.555.4000 now", "part 269-555-2000 now"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = [r.n_found for r in pii.personal_data(df).orderBy("doc_id").collect()]
    assert got == [0] * 400 + [1] * (len(texts) - 401) + [0]


def test_contexts_skip_neighbours_and_candidates_have_several_tokens(spark):
    seeds = [f"tel +1 (269) 555-{1000 + i} {'xyz'[i % 3]}" for i in range(30)] + [f"write a{i}@b.org soon" for i in range(30)]
    seeds += [f"+1 (269) 555-{2000 + i} reaches me" for i in range(10)] + [f"lot +1 (269) 555-{3000 + i}, lot 17b" for i in range(6)]
    seeds += [f"ring +1 (269) 555-{4000 + i} now" for i in range(6)] + [f"ip 10.0.0.{i} is up" for i in range(10)]
    cases = {
        "tel 555-123-4567 555-123-4568": "phone:4:16,phone:17:29", "tel 2 269-555-1234": "phone:6:18", "tel : 269-555-1235": "phone:6:18",
        "tel 555 123 4567 x": "phone:4:16", "tel (269) 555-1234, x": "phone:4:18", "write joe at host dot com soon": "email:6:25",
        "write joe (at) host.com.": "email:6:23", "269-555-7777 reaches me": "phone:0:12", "ip 10 dot 0 dot 0 dot 1 is": "ip:3:23",
        "lot 269-555-1236": "", "part 269-555-1237 reaches me": "", "meet joe at host dot com": "", "269-555-7778": "",
    }
    cases |= {f"ring 269-555-{5000 + i} now": "phone:5:17" for i in range(20)}
    df = spark.createDataFrame(list(enumerate([*seeds, *cases])), "doc_id long, text string")
    got = {r.doc_id: r.spans for r in pii.personal_data(df).collect()}
    assert {t: got[len(seeds) + i] for i, t in enumerate(cases)} == cases


# lines

def edits(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        new = [i]
        for j, y in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
        row = new
    return row[-1]


def test_lines(spark):
    rng = random.Random(7)
    stems = ["the quick brown fox jumps over the lazy dog number %d" % i for i in range(3)]

    def changed(s):
        for _ in range(rng.randrange(5)):
            i = rng.randrange(len(s))
            kind = rng.choice("isd")
            s = s[:i] + ("" if kind == "d" else rng.choice("ZÉ")) + s[i + (kind != "i") :]
        return s

    docs = [(i, "\n".join(changed(rng.choice(stems)) for _ in range(3))) for i in range(40)]
    docs += [(100, None), (101, ""), (102, "\n\n \n"), (103, "short\nshort\nshorx"), (104, "é" * 60 + "\n" + "é" * 59), (105, docs[0][1]), (None, docs[0][1])]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, dropped int")
    first = {}
    for i, t in sorted(((i, t) for i, t in docs if t is not None), key=lambda x: (x[0] is not None, x[0] or 0)):
        for p, l in enumerate(t.split("\n")):
            if l.strip(" \t"):
                first.setdefault(l, (i is not None, i or 0, p))
    root = {l: l for l in first}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    long = [l for l in first if len(l) >= line_dedup.FUZZY]
    for k, a in enumerate(long):
        for b in long[:k]:
            if edits(a, b) <= line_dedup.TAU:
                root[find(a)] = find(b)
    best = {}
    for l, o in first.items():
        best[find(l)] = min(best.get(find(l), o), o)
    got = {r.doc_id: (r.n_lines, r.dropped) for r in line_dedup.dropped_lines(df.select("doc_id", "text")).collect()}
    for i, t in docs:
        if t is None:
            assert i not in got
            continue
        ls = t.split("\n")
        assert got[i] == (len(ls), [p for p, l in enumerate(ls) if l in first and best[find(l)] != (i is not None, i or 0, p)]), i
    kept = {r.doc_id: r.text for r in line_dedup.dedup_lines(df.select("doc_id", "text")).collect()}
    assert kept[100] is None and kept[101] == "" and kept[103] == "short\nshorx" and kept[105] == ""
    assert line_dedup.dropped_lines(df.limit(0).select("doc_id", "text")).count() == 0


def test_short_lines(spark):
    """Against brute force with limits of its own: 2 edits from 40 characters, 1 from 10, by the shorter line."""
    rng = random.Random(17)
    lines = ["The anhely eran.", "The, anhely eran.", "Thwhesnd esator whshing and hewh.", "Thwhesnd, esator whshing and hewh.", "y" * 39, "y" * 40, "z" * 38, "z" * 40, "abcdefghi", "abcdefghij", "abcdefghix"]
    for n in (9, 10, 11, 20, 38, 39, 40, 41):
        for _ in range(3):
            stem = "".join(rng.choice("abcdé ") for _ in range(n - 2)) + "xy"
            lines.append(stem)
            for k in (1, 1, 2):
                s = stem
                for _ in range(k):
                    i = rng.randrange(len(s))
                    kind = rng.choice("isd")
                    s = s[:i] + ("" if kind == "d" else rng.choice("ZÉ")) + s[i + (kind != "i") :]
                lines.append(s)
    lines = list(dict.fromkeys(lines))
    label = list(range(len(lines)))
    for i, a in enumerate(lines):
        for j, b in enumerate(lines[:i]):
            n = min(len(a), len(b))
            if edits(a, b) <= (2 if n >= 40 else 1 if n >= 10 else 0):
                x, y = sorted((label[i], label[j]))
                label = [x if l == y else l for l in label]
    df = spark.createDataFrame([(i, l) for i, l in enumerate(lines)], "doc_id long, text string")
    got = {r.doc_id: r.dropped for r in line_dedup.dropped_lines(df).collect()}
    assert got == {i: [0] if label[i] != i else [] for i in range(len(lines))}
    assert got[1] == got[3] == got[5] == [0] and got[7] == [] and got[9] == []


def test_finer_groups_keep_linked_pairs(spark):
    """Unlike lines with a common beginning, end or middle, numbered lines, and copies of some with one or two edits."""
    rng = random.Random(23)
    word = lambda n: "".join(rng.choice("abcdefgh ") for _ in range(n))
    stem, end = word(30) + "x", "x" + word(30)
    lines = [stem + word(rng.randrange(12, 40)) for _ in range(12)] + [word(25) + end for _ in range(10)] + [word(15) + stem + "é" + word(15) for _ in range(10)]
    lines += [f"{stem}{end} {n:04}" for n in rng.sample(range(10000), 15)]
    for s in rng.sample(lines, 30):
        for _ in range(rng.choice((1, 2, 2))):
            i = rng.randrange(len(s))
            kind = rng.choice("isd")
            s = s[:i] + ("" if kind == "d" else rng.choice("ab1")) + s[i + (kind != "i") :]
        lines.append(s)
    lines = list(dict.fromkeys(lines))
    linked = {(i, j) for j, b in enumerate(lines) for i, a in enumerate(lines[:j]) if abs(len(a) - len(b)) <= 2 and edits(a, b) <= 2}
    texts = common.cut(spark.createDataFrame(list(enumerate(lines)), "node long, line string").select("node", "line", F.length("line").alias("n"), (F.length("line") == F.octet_length("line")).alias("ascii")))
    groups = line_dedup.line_rows(texts, 2).select(F.col("key").alias("sig"), "node", "own", F.lit(None).cast("array<int>").alias("sketch"), F.lit(0).alias("place"), F.lit(None).cast("int").alias("long"), F.lit(None).cast("string").alias("rest"))
    sizes = []
    for level in range(3):
        groups = common.cut(groups)
        by = {}
        for r in groups.select("sig", "node", "own").collect():
            by.setdefault(r.sig, {}).setdefault(r.node, set()).add(r.own)
        met = {(i, j) for g in by.values() for i in g for j in g if i < j and (True in g[i] or True in g[j])}
        assert linked <= met, level
        sizes.append(len(met))
        groups = groups.where("place is null").unionByName(line_dedup.finer(groups.where("place is not null"), texts, 2))
    assert len(linked) > 10 and sizes[2] < sizes[1] < sizes[0]


def test_neighbourhood_keys(spark):
    """Two strings share a key that one owns if, and owned keys only if, they are within tau edits of the owner."""
    rng = random.Random(29)
    strings = list(dict.fromkeys("".join(rng.choice("ab") for _ in range(rng.randrange(7))) for _ in range(150)))
    df = spark.createDataFrame([(s,) for s in strings], "s string")
    for tau in (0, 1, 2):
        keys = {r.s: {k.key: any(x.own for x in r.k if x.key == k.key) for k in r.k} for r in df.select("s", line_dedup.near_keys(F.col("s"), tau).alias("k")).collect()}
        for a in strings:
            for b in strings:
                if a < b:
                    both = keys[a].keys() & keys[b].keys()
                    assert any(keys[a][k] or keys[b][k] for k in both) == (edits(a, b) <= tau), (a, b, tau)


def test_very_long_lines(spark):
    rng = random.Random(31)
    a = "".join(rng.choice("abcdefgh ") for _ in range(200_000))
    rows = [(1, a), (2, a[:100_000] + "Z" + a[100_001:]), (3, a[:50] + "ZZZ" + a[50:]), (4, "\n".join(map(str, range(20_000))) + "\n" + "\n".join(map(str, range(20_000))))]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: r for r in line_dedup.dedup_lines(df).collect()}
    assert [len(got[i].dropped) for i in (1, 2, 3, 4)] == [0, 1, 0, 20_000]
    assert got[4].text == "\n".join(map(str, range(20_000)))


def test_automaton_equals_edit_distance(spark):
    rng = random.Random(8)
    pairs = []
    for _ in range(150):
        a = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9)))
        b = "".join(rng.choice("ab") for _ in range(rng.randrange(0, 9)))
        pairs.append((a, b))
    rows = [(i, list(a), list(b)) for i, (a, b) in enumerate(pairs)]
    df = spark.createDataFrame(rows, "i int, a array<string>, b array<string>")
    for r in df.select("i", line_dedup.within(F.col("a"), F.col("b"), 2).alias("ok")).collect():
        assert r.ok == (edits(*pairs[r.i]) <= 2), pairs[r.i]


def test_components(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(60)] + [(100, 102), (102, 101)], "a long, b long")
    got = {r.node: r.label for r in min_labels(e).collect()}
    assert got == {**{i: 0 for i in range(1, 61)}, 101: 100, 102: 100}
