import hashlib
import math
import random
import time
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from cloneloom.functions import fields
from cloneloom.functions import sequence as S
from cloneloom.operators import abundance, align, cluster, diversity, filters, graph, overlap, preproc, qc, stats, tags
from cloneloom.plans import pipeline
from cloneloom.sources import reads, tables
from cloneloom.streaming import events


def clones(spark, rows=None):
    rng = random.Random(1)
    rows = rows or [(f"s{i % 3}", i // 3, float(rng.randrange(1, 50))) for i in range(90)]
    return spark.createDataFrame(rows, "sample string, key int, weight double")


def test_diversity_against_direct_formulas(spark):
    df = clones(spark)
    got = {r["sample"]: r for r in diversity.diversity(df).collect()}
    for s in ("s0", "s1", "s2"):
        w = np.array([r.weight for r in df.where(F.col("sample") == s).collect()])
        p = w / w.sum()
        assert got[s].observed == len(w)
        assert math.isclose(got[s].shannon_wiener, math.exp(-(p * np.log(p)).sum()), rel_tol=1e-9)
        assert math.isclose(got[s].inverse_simpson, 1 / (p * p).sum(), rel_tol=1e-9)
        f1, f2 = (w == 1).sum(), (w == 2).sum()
        assert math.isclose(got[s].chao1, len(w) + f1 * (f1 - 1) / (2 * (f2 + 1)))


def test_one_key_has_no_normalized_entropy(spark):
    assert diversity.diversity(clones(spark, [("a", 1, 5.0)])).first().normalized_shannon is None


def test_d50_counts_an_exact_half(spark):
    assert diversity.d50(clones(spark, [("a", 1, 5.0), ("a", 2, 3.0), ("a", 3, 2.0)]), ["key"]).first().d50 == 1


def test_overlap_of_disjoint_samples_is_zero(spark):
    r = overlap.overlap(clones(spark, [("a", 1, 1.0), ("a", 2, 1.0), ("b", 3, 1.0)]), ["key"]).first()
    assert (r.shared, r.f1, r.f2, r.jaccard, r.pearson) == (0, 0.0, 0.0, 0.0, 0.0)


def test_downsampling_keeps_the_total_and_stays_inside(spark):
    df = clones(spark)
    d = preproc.downsample(df, ["key"], 100)
    assert {r["s"] for r in d.groupBy("sample").agg(F.sum("weight").alias("s")).collect()} == {100.0}
    both = d.withColumnRenamed("weight", "d").join(df, ["sample", "key"], "left")
    assert both.where("weight is null or d > weight").count() == 0
    assert sorted(map(tuple, d.collect())) == sorted(map(tuple, preproc.downsample(df, ["key"], 100).collect()))


def drawn_by_hand(rows, n):
    units = {}
    for sample, key, weight in rows:
        units.setdefault(sample, []).extend((hashlib.md5(f"{sample or ''}:{key}:{i}".encode()).hexdigest(), key) for i in range(1, round(weight) + 1))
    return Counter((s, key) for s, u in units.items() for _, key in sorted(u)[:n])


@pytest.mark.parametrize("sigmas", [0.0, preproc.SIGMAS])
@pytest.mark.parametrize("n", [0, 1, 700, 4990, 5000, 9000])
def test_downsampling_takes_the_first_hashes_whatever_the_margin(spark, n, sigmas):
    rows = [("a", 1, 4500.0), ("a", 2, 499.6), ("a", 3, 0.4), ("b", 1, 6000.0), ("b", 4, 1.0), (None, 1, 5100.0)]
    got = preproc.downsample(clones(spark, rows), ["key"], n, sigmas=sigmas).collect()
    assert {(r.sample, r.key): r.weight for r in got} == drawn_by_hand(rows, n)


def test_downsampling_shuffles_no_units(spark):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    df, before = clones(spark, [("a", k, 60000.0) for k in range(10)] + [("b", k, 59000.0) for k in range(10)]), written()
    assert preproc.downsample(df, ["key"], 590000).agg(F.sum("weight")).first()[0] == 1180000.0
    assert written() - before < 2 << 20


def test_a_chain_of_preprocessors_shuffles_no_units(spark):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    rows = [(s, k, 30000.0 + k) for s in "ab" for k in range(10)]
    want = {(s, k): n for (s, k), n in drawn_by_hand(rows, 500).items()}
    before = written()
    got = preproc.chain(clones(spark, rows), ["key"], ["count-weight-fixed-500", "top-weight-3"]).collect()
    assert written() - before < 2 << 20
    assert sorted((r.sample, r.key) for r in got) == sorted((s, k) for s in "ab" for k in sorted(range(10), key=lambda k: (-want[s, k], k))[:3])


def counted(spark, rows):
    """Clones, and an accumulator of how many rows of them were made."""
    made = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            made.add(b.num_rows)
            yield b

    return clones(spark, rows).mapInArrow(run, "sample string, key int, weight double"), made


def shuffled(spark):
    """The numbers of the shuffles whose files Spark keeps."""
    blocks = spark.sparkContext._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager().getAllBlocks()
    return {b.split("_")[1] for b in map(str, spark.sparkContext._jvm.scala.jdk.javaapi.CollectionConverters.asJava(blocks)) if b.startswith("shuffle_")}


def test_a_chain_with_a_fixed_size_runs_its_input_once_and_keeps_no_shuffles(spark):
    rows = [(s, k, 30.0 + k) for s in "ab" for k in range(10)]
    df, made = counted(spark, rows)
    before = shuffled(spark)
    got = preproc.chain(df, ["key"], ["count-weight-fixed-100", "top-weight-3"])
    assert made.value == len(rows)
    assert not shuffled(spark) - before
    assert {r.sample for r in got.collect()} == {"a", "b"} and made.value == len(rows)


@pytest.mark.parametrize("how", ["auto", "min"])
def test_an_automatic_size_runs_the_input_once_and_keeps_no_shuffles(spark, how):
    rows = [(s, k, w) for s, w in (("a", 30.4), ("b", 40.0), (None, 50.0)) for k in range(10)]
    df, made = counted(spark, rows)
    before = shuffled(spark)
    got = preproc.parse(f"count-weight-{how}")(df, ["key"])
    assert made.value == len(rows)
    assert not shuffled(spark) - before
    assert {(r.sample, r.key): r.weight for r in got.collect()} == drawn_by_hand(rows, 300) and made.value == len(rows)


def test_downsampling_an_empty_table_or_to_no_size(spark):
    df = clones(spark, [("a", 1, 5.0), ("b", 2, 7.0)])
    assert preproc.parse("count-weight-auto")(df.limit(0), ["key"]).count() == 0
    got = preproc.downsample(df, ["key"], F.when(F.col("sample") == "a", 3)).collect()
    assert {(r.sample, r.weight) for r in got} == {("a", 3.0), ("b", 7.0)}


def test_automatic_size_ignores_tiny_samples(spark):
    for sizes, want in (([501, 200000, 300000, 400000], 200000.0), ([100, 100, 100], 100.0)):
        df = spark.createDataFrame([(float(s),) for s in sizes], "size double")
        assert preproc.automatic_size(df).first().n == want
    assert preproc.automatic_size(spark.createDataFrame([(7.0,)], "size double"), "fixed-3").first().n == 3.0


def test_unknown_preprocessor():
    with pytest.raises(ValueError):
        preproc.parse("middle-weight-3")


def test_p_adjustment(spark):
    p = [0.01, 0.02, 0.03, 0.04, 0.05]
    df = spark.createDataFrame([(x,) for x in p], "p double")
    want = {"bonferroni": [0.05, 0.1, 0.15, 0.2, 0.25], "holm": [0.05, 0.08, 0.09, 0.09, 0.09], "hochberg": [0.05] * 5, "bh": [0.05] * 5, "hommel": [0.05] * 5}
    for m, w in want.items():
        got = [r.p_adjusted for r in stats.adjust(df, m).orderBy("p").collect()]
        assert np.allclose(got, w), m
    assert [r.p for r in stats.holm_selection(spark.createDataFrame([(x,) for x in (1e-4, 0.2, 1e-3, 0.5)], "p double")).orderBy("p").collect()] == [1e-4, 1e-3]


def test_tails_of_tests():
    assert math.isclose(stats._t_tail(2.0, 10), 0.0733880, rel_tol=1e-5)
    assert math.isclose(stats._chi2_tail(3.841459, 1), 0.05, rel_tol=1e-5)
    assert math.isclose(stats._f_tail(4.964603, 1, 10), 0.05, rel_tol=1e-5)
    assert stats.wilcoxon([1, 2, 3, 4, 5], [11, 12, 13, 14, 15]) < 0.02
    assert stats.kolmogorov_smirnov(range(20), range(20)) == 1.0
    assert stats.anova([[1, 2, 3], [1, 2, 3]]) > 0.99


def test_linkage():
    merges = stats.linkage(np.array([[0.0], [1.0], [10.0]]))
    assert merges[0] == (0, 1, 1.0) and math.isclose(merges[1][2], 9.5)


def test_translate_and_flags(spark):
    df = spark.createDataFrame([("TGTGCCTAA",), ("ATGA",), ("",), (None,)], "nt string")
    got = [(r.aa, r.oof, r.stop) for r in df.select(S.translate(F.col("nt")).alias("aa"), S.is_out_of_frame(F.col("nt")).alias("oof"), S.has_stop(S.translate(F.col("nt"))).alias("stop")).collect()]
    assert got[:3] == [("CA*", False, True), ("M_", True, False), ("", False, False)]


def test_fields_and_airr(spark):
    df = spark.createDataFrame([(1, "TGTGCCTTT", "TRBV1-1*00", "IGHG2", 3.0)], "clone_id int, cdr3_nt string, v_gene string, c_gene string, count double")
    r = fields.export(df, ["cloneId", "aaFeature CDR3", "vFamily", "isotype", "topChains"]).first()
    assert tuple(r) == (1, "CAF", "TRBV1", "IgG", "TRB")
    a = fields.airr(df).first()
    assert (a.junction_aa, a.cdr3, a.productive) == ("CAF", "GCC", True)
    with pytest.raises(ValueError):
        fields.export(df, ["nonsense"])


def test_filters(spark):
    df = spark.createDataFrame([(1, "TRBV1", 5), (2, "IGHV1", 6), (3, None, 7)], "id int, v_gene string, n int")
    assert [r.id for r in df.where(filters.in_chains(["v_gene"], ["TRB"])).collect()] == [1]
    assert df.where(filters.in_chains(["v_gene"], ["ALL"])).count() == 3
    assert filters.metadata_filter(df, ["n>=6", "v_gene=IGHV1"]).count() == 1
    for bad in ("reflect('java.lang.System', 'exit', 0)", "n in (select 1)"):
        with pytest.raises(ValueError):
            filters.scripted(df, bad)
    assert filters.limited(df, ["id"], 1, 1).first().id == 2
    assert df.where(filters.feature_matches(F.lit("ACGTACGT"), "GTTC", 1)).count() == 3


def test_tags(spark):
    rx, names = tags.compile_pattern("^(CELL:N{4})(UMI:N{3})AC*")
    assert names == ["CELL", "UMI"]
    df = spark.createDataFrame([("ACGTTTTACGG",), ("TTTTTTTTTTT",)], "r string")
    assert [tuple(r) for r in tags.parse_tags(df, "r", "^(CELL:N{4})(UMI:N{3})AC").select("CELL", "UMI", "status").collect()] == [("ACGT", "TTT", "Good"), (None, None, "NotParsed")]
    b = spark.createDataFrame([("c", "AAAA", 100.0), ("c", "AAAT", 3.0), ("c", "GGGG", 2.0)], "cell string, umi string, weight double")
    got = {r.umi: r.w for r in tags.correct(b, ["cell", "umi"]).groupBy("umi").agg(F.sum("weight").alias("w")).collect()}
    assert got == {"AAAA": 103.0, "GGGG": 2.0}
    allowed = spark.createDataFrame([("AAAA",)], "umi string")
    assert sorted(r.umi for r in tags.whitelist(b, "umi", allowed, 1).collect()) == ["AAAA", "AAAA"]
    with pytest.raises(ValueError):
        tags.require_tags(b, ["sample"])


def test_otsu_separates_two_groups(spark):
    df = spark.createDataFrame([(float(x),) for x in [1, 1, 2, 2, 1, 2, 900, 1000, 1100, 950]], "metric double")
    assert 2 < tags.otsu_threshold(df) <= 900


def test_components_and_cells(spark):
    e = spark.createDataFrame([(i, i + 1) for i in range(50)] + [(100, 101)], "a int, b int")
    got = {r.node: r.component for r in graph.components(e).collect()}
    assert got == {**{i: 0 for i in range(51)}, 100: 100, 101: 100}
    cc = spark.createDataFrame([(1, "x"), (2, "x"), (1, "y"), (2, "y"), (3, "z")], "clone_id int, cell string")
    assert {r.clone_id: r.cell_group for r in cluster.group_cells(cc).collect()} == {1: "1", 2: "1", 3: "undefined"}


def test_clusters_consensus_contigs(spark):
    c = spark.createDataFrame([("s", "ACGT", 100.0), ("s", "ACGA", 2.0), ("s", "TTTT", 5.0)], "sample string, cdr3_nt string, count double")
    assert {r.cdr3_nt: r["count"] for r in cluster.cluster_errors(c).collect()} == {"ACGT": 102.0, "TTTT": 5.0}
    r = spark.createDataFrame([("u", "ACGT", "IIII"), ("u", "ACGT", "IIII"), ("u", "AGGT", "I#II"), ("u", "AC", "II")], "umi string, seq string, qual string")
    got = cluster.consensus(r, ["umi"]).first()
    assert (got.seq, got.reads) == ("ACGT", 4)
    a = spark.createDataFrame([("s", 0, "ACGT"), ("s", 2, "GTAA"), ("s", 20, "CC")], "sample string, start int, seq string")
    assert (cluster.contigs(a, ["sample"]).first().contig) == "ACGTAA"


def test_lineages_and_newick(spark):
    c = spark.createDataFrame([(1, "V", "J", "ACGTACGTAC", "ACGTACGTAA"), (2, "V", "J", "ACGTACGTAA", "ACGTACGTAA"), (3, "V", "J", "TTTTTTTTTT", "ACGTACGTAA")], "clone_id long, v_gene string, j_gene string, cdr3_nt string, germline string")
    g = cluster.lineages(c)
    assert {r.clone_id: r.tree_id for r in g.collect()} == {1: 1, 2: 1, 3: 3}
    nodes = cluster.lineage_trees(c.withColumnRenamed("cdr3_nt", "seq").join(g, "clone_id"))
    assert {r.tree_id: r.newick for r in cluster.newick(nodes).collect()}[1] == "(1:1,2:0)0:0;"


def mutants(seed, n, length, roots, letters="ACGT"):
    rng = random.Random(seed)
    heads = ["".join(rng.choice(letters) for _ in range(length)) for _ in range(roots)]
    return ["".join(rng.choice(letters) if rng.random() < 0.1 else c for c in rng.choice(heads)) for _ in range(n)]


@pytest.mark.parametrize("block", [2048, 40])
def test_lineages_against_all_pairs(spark, monkeypatch, block):
    monkeypatch.setattr(cluster, "BLOCK", block)
    rows = [(i, f"V{i % 2}" if i % 50 else None, "J", s) for i, s in enumerate(mutants(3, 500, 12, 3) + mutants(4, 100, 9, 9, "Aé") + ["", None, "A", "A", "C"])]
    best = {r[0]: r[0] for r in rows}

    def find(i):
        return i if best[i] == i else find(best[i])

    for i, vi, _, s in rows:
        for j, vj, _, t in rows[:i]:
            if s and t and vi and vi == vj and len(s) == len(t) and sum(x != y for x, y in zip(s, t, strict=True)) <= math.floor(0.15 * len(s) + 1e-9):
                x, y = find(i), find(j)
                best[max(x, y)] = min(x, y)
    df = spark.createDataFrame(rows, "clone_id long, v_gene string, j_gene string, cdr3_nt string")
    assert {r.clone_id: r.tree_id for r in cluster.lineages(df).collect()} == {r[0]: find(r[0]) for r in rows}


def test_lineages_write_no_pairs_of_copies(spark):
    written = lambda: spark.sparkContext._jsc.sc().statusStore().executorSummary("driver").totalShuffleWrite()
    df = spark.range(2000).select(F.col("id").alias("clone_id"), F.lit("V").alias("v_gene"), F.lit("J").alias("j_gene"), F.when(F.col("id") < 1999, "ACGTACGTAC").otherwise("ACGTACGTAA").alias("cdr3_nt"))
    before = written()
    assert cluster.lineages(df).select("tree_id").distinct().collect()[0].tree_id == 0
    assert written() - before < 1 << 20


def grown_by_hand(texts):
    dist = lambda x, y: sum(a != b for a, b in zip(x, y, strict=False)) + abs(len(x) - len(y))
    near, height, out = {i: (dist(texts[0], t), 0) for i, t in enumerate(texts) if i}, {0: 0}, set()
    while near:
        i = min(near, key=lambda j: (near[j][0], j))
        d, p = near.pop(i)
        height[i] = height[p] + 1
        out.add((i, p, d, height[i]))
        near = {j: min(x, (dist(texts[i], texts[j]), i)) for j, x in near.items()}
    return out


def test_trees_grow_as_by_hand():
    for seed in range(20):
        rng = random.Random(seed)
        texts = ["".join(rng.choice("ACGé") for _ in range(rng.choice([3, 4, 4, 5, 0]))) for _ in range(rng.randrange(1, 90))]
        got = cluster._grown(texts)
        assert len(got) == len(texts) - 1
        assert set(got) == grown_by_hand(texts)
    assert len(cluster._grown(mutants(5, 6000, 12, 40))) == 5999


def test_newick_of_a_deep_tree_and_of_ordered_children(spark):
    n = 20000
    nodes = spark.range(n).select(F.lit(7).alias("tree_id"), F.col("id").cast("int").alias("node_id"), F.when(F.col("id") > 0, F.col("id") - 1).cast("int").alias("parent_id"), F.lit(1).alias("distance"))
    began = time.time()
    assert cluster.newick(nodes).first().newick == "(" * (n - 1) + ")".join(f"{i}:1" for i in reversed(range(n))) + ";"
    assert time.time() - began < 20
    wide = spark.createDataFrame([(1, 0, None, 0), (1, 3, 0, 2), (1, 1, 0, 1), (1, 2, 1, 4)], "tree_id int, node_id int, parent_id int, distance int")
    assert cluster.newick(wide).first().newick == "((2:4)1:1,3:2)0:0;"


def test_tree_filter_runs_its_input_once(spark):
    runs = spark.sparkContext.accumulator(0)

    def run(batches):
        for b in batches:
            runs.add(b.num_rows)
            yield b

    nodes = spark.range(4, numPartitions=1).select(F.lit(1).alias("tree_id"), F.col("id").alias("node_id"), F.lit(2).alias("height")).mapInArrow(run, "tree_id int, node_id long, height int")
    assert cluster.tree_filter(nodes, min_nodes=3).count() == 4
    assert runs.value == 4


def test_reads(spark, tmp_path):
    (tmp_path / "a_R1.fastq").write_text("@r1 x\nACGTN\n+\n@IIII\n@r2\nGG\n+\nII\n")
    got = reads.read_fastq(spark, str(tmp_path / "a_R1.fastq"))
    assert [tuple(r)[1:] for r in got.orderBy("read_no").collect()] == [(0, "r1 x", "ACGTN", "@IIII"), (1, "r2", "GG", "II")]
    assert reads.file_tags(got, "{{SAMPLE}}_R1.fastq").first().SAMPLE == "a"
    (tmp_path / "b.fasta").write_text(">V1 desc\nACGT\nAC\n>V2\nGG\n")
    assert [tuple(r)[1:] for r in reads.read_fasta(spark, str(tmp_path / "b.fasta")).orderBy("descr").collect()] == [("V1 desc", "ACGTAC"), ("V2", "GG")]
    (tmp_path / "c.sam").write_text("@HD\tVN:1\nr\t16\tchr1\t5\t60\t4M\t*\t0\t0\tAACC\tABCD\n")
    s = reads.read_sam(spark, str(tmp_path / "c.sam")).first()
    assert (s.seq, s.qual, s.mate) == ("GGTT", "DCBA", 1)
    reads.write_fastq(got, str(tmp_path / "out"))
    assert reads.read_fastq(spark, str(tmp_path / "out")).count() == 2


def test_merge_and_align(spark):
    ref = "ACGTTGCAAGGCTTAACCGGTATCGATCGTACCATGCATGG"
    comp = str.maketrans("ACGT", "TGCA")
    r1, r2 = ref[:30], ref[10:].translate(comp)[::-1]
    df = spark.createDataFrame([(r1, "I" * 30, r2, "I" * len(r2)), ("ACGT", "IIII", "TTTT", "IIII")], "r1 string, q1 string, r2 string, q2 string")
    got = align.merge_pairs(df).collect()
    assert (got[0].merged, got[0].overlap, got[1].merged) == (ref, 20, None)
    lib = spark.createDataFrame([("V1", "V", ref), ("V2", "V", ref[::-1]), ("VN", "V", "NNNN")], "gene string, gene_type string, ref string")
    rd = spark.createDataFrame([(1, ref[5:35])], "read_id long, seq string")
    h = align.align_reads(rd, lib).first()
    assert h.hits[0].gene == "V1" and h.hits[0].score == 150.0
    assert {r.status for r in align.statuses(rd, align.align_reads(rd, lib)).collect()} == {"NoJHits"}


def test_errors_of_several_edits(spark):
    rng = random.Random(5)
    stem = "ACGTTGCAAGGCTTAACC"
    rows = {stem: 1000.0, "": 1.0, "A": 1.0}
    for _ in range(40):
        s = stem
        for _ in range(rng.randrange(1, 4)):
            i, kind = rng.randrange(len(s)), rng.choice("isd")
            s = s[:i] + ("" if kind == "d" else rng.choice("ACGT")) + s[i + (kind != "i") :]
        rows.setdefault(s, 1.0)

    def distance(a, b):
        row = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            new = [i]
            for j, y in enumerate(b, 1):
                new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (x != y)))
            row = new
        return row[-1]

    c = spark.createDataFrame([("s", k, n) for k, n in rows.items()], "sample string, cdr3_nt string, count double")
    for edits, indels in ((1, True), (2, False), (2, True)):
        far = distance if indels else (lambda a, b: sum(x != y for x, y in zip(a, b, strict=True)) if len(a) == len(b) else 99)
        gone = {k for k in rows if k != stem and far(k, stem) <= edits}
        assert gone
        want = {k: n for k, n in rows.items() if k not in gone} | {stem: 1000.0 + len(gone)}
        got = cluster.cluster_errors(c, edits=edits, indels=indels, depth=1).collect()
        assert {r.cdr3_nt: r["count"] for r in got} == want
    b = spark.createDataFrame([("ACGTACGT", 9.0), ("ACGACGT", 1.0)], "umi string, weight double")
    assert {r.umi for r in tags.correct(b, ["umi"], indels=True).collect()} == {"ACGTACGT"}


def test_alleles_that_differ_in_a_few_bases(spark):
    ref = "ACGTTGCAAGGCTTAACCGGTATCGATCGTACCATGCATGGTTCAGGACTTACGGATCCA"
    other = dict(zip("ACGT", "CGTA", strict=True))
    changed = lambda *at: "".join(other[c] if i in at else c for i, c in enumerate(ref))
    alleles = {f"A{i}": changed(0, 1, 2) for i in range(5)} | {f"B{i}": changed(20 + i) for i in range(5)} | {"Z": changed(58)}
    lib = spark.createDataFrame([(g, "V", r) for g, r in alleles.items()], "gene string, gene_type string, ref string")
    got = align.align_reads(spark.createDataFrame([(1, ref)], "read_id long, seq string"), lib).first().hits
    want = {g: max(0, align.local_score(ref, r, 0)[0]) for g, r in alleles.items()}
    assert min(want.values()) >= 0.9 * max(want.values()) and want["B0"] > want["A0"]
    assert [(h.gene, h.score) for h in got] == sorted(want.items(), key=lambda x: (-x[1], x[0]))


def test_metadata(spark, tmp_path):
    (tmp_path / "m.csv").write_text("Sample,Age,Group\na,3,x\nb,4,7\n")
    m = tables.read_metadata(spark, str(tmp_path / "m.csv"))
    assert dict(m.dtypes) == {"sample": "string", "age": "double", "group": "string"}
    s = spark.createDataFrame([("dir/a.clns",), ("b",)], "sample string")
    assert tables.match_metadata(s, m).count() == 2
    with pytest.raises(ValueError):
        tables.match_metadata(spark.createDataFrame([("zzz",)], "sample string"), m)


def test_qc(spark):
    c = spark.createDataFrame([("a", 100, 90, 30)], "sample string, total long, aligned long, off_target long")
    chosen = qc.checks(SuccessfullyAlignedReads=(0.6, 0.8), OffTargetReads=(0.25, 0.15), SpikeInControls=(0.5, 0.9))
    assert {r.check: r.status for r in qc.run_checks(c, chosen).collect()} == {"SuccessfullyAlignedReads": "OK", "OffTargetReads": "ALERT"}


def test_plan(spark):
    p = pipeline.resolve("bulk", pipeline.set_parameter("assemble.error_ratio", 5.0), pipeline.productive_only(), pipeline.add_fields("nFeature CDR3", first=True))
    assert pipeline.analyze(None, p, dry_run=True) == ["align", "assemble", "export"]
    r = spark.createDataFrame([("s", i, "TGTGCC" if i < 20 else "TGTGCA" if i < 22 else "TGTGC") for i in range(30)], "sample string, read_id long, cdr3_nt string")
    got = pipeline.analyze(r, p).collect()
    assert [(x.cdr3_nt, x.readCount, x.readFraction) for x in got] == [("TGTGCC", 22.0, 1.0)]
    with pytest.raises(ValueError):
        pipeline.resolve("nothing")


def test_merge_needs_a_table():
    with pytest.raises(ValueError):
        abundance.merge()


def test_stream_of_events(spark, tmp_path):
    e = spark.createDataFrame([(1, "2024-01-01 00:10:00", "a", 1.0), (1, "2024-01-01 00:50:00", "a", 2.0), (2, "2024-01-01 05:00:00", "b", 4.0)], "user_id long, t string, event_type string, value double").withColumn("ts", F.to_timestamp("t"))
    e.write.parquet(str(tmp_path / "in"))
    s = events.windowed_usage(events.read_events(spark, str(tmp_path / "in"), e.schema, 10))
    q = s.writeStream.outputMode("complete").format("memory").queryName("usage").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.event_type, r.n, r.total) for r in spark.table("usage").collect()) == [("a", 2, 3.0), ("b", 1, 4.0)]
    assert events.sessions(e).count() == 3


def test_scores_at_once_equal_single_scores():
    rng = random.Random(3)
    seq = lambda n: "".join(rng.choice("ACGT") for _ in range(n))
    reads_, refs, diagonals = [], [], []
    for _ in range(60):
        ref = seq(rng.randrange(1, 60))
        a = rng.randrange(len(ref))
        reads_.append(ref[a : a + 20] + seq(rng.randrange(1, 6)))
        refs.append(ref)
        diagonals.append(a + rng.randrange(-2, 3))
    assert align.local_scores(reads_, refs, diagonals).tolist() == [align.local_score(q, r, d)[0] for q, r, d in zip(reads_, refs, diagonals, strict=True)]
