"""Clonotype assembly: error clustering of sequences, consensus of reads, contigs, cell grouping, lineages, alleles.

Internals follow published definitions: parent-child merging by abundance ratio, majority consensus with quality, single
linkage in blocks of equal genes and length (Gupta et al., 2017), minimum spanning trees by mutation distance, and allele
candidates from mutations shared across many distinct clones (Corcoran et al., 2016).
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shipping import ship
from .graph import components, near_pairs, settle


def cluster_errors(clones: DataFrame, key: str = "cdr3_nt", by: Sequence[str] = ("sample",), weight: str = "count", ratio: float = 10.0, depth: int = 2, add_counts: bool = True, edits: int = 1, indels: bool = False) -> DataFrame:
    """Clones without those that look like errors of a `ratio` times larger one within `edits` mismatches, with `indels`
    insertions and deletions as well, followed up to `depth` steps; their counts are added to it if wanted."""
    by = list(by)
    out = clones
    for _ in range(depth):
        sums = out.groupBy(*by, key).agg(F.sum(weight).alias("_w"))
        pairs = near_pairs(sums, key, by, "_w", ratio, edits, indels)
        best = pairs.groupBy(*by, "child").agg(F.max_by("parent", F.struct("parent_weight", "parent")).alias("parent"))
        moved = out.join(best.withColumnRenamed("child", key), [*by, key], "left")
        if add_counts:
            out = moved.withColumn(key, F.coalesce("parent", key)).groupBy(*by, key).agg(F.sum(weight).alias(weight))
        else:
            out = moved.where("parent is null").drop("parent")
        out = settle(out)
    return out


def pre_cluster(clones: DataFrame, sequence: str, gene: str, by: Sequence[str] = ("sample",), weight: str = "count", ratio: float = 10.0) -> DataFrame:
    """Clones of one sequence that differ by gene: the smaller ones join the largest if it is `ratio` times larger."""
    w = Window.partitionBy(*by, sequence)
    order = w.orderBy(F.col(weight).desc(), gene)
    c = clones.withColumn("_top", F.first(weight).over(order)).withColumn("_gene", F.first(gene).over(order))
    to = F.when(F.col("_top") >= ratio * F.col(weight), F.col("_gene")).otherwise(F.col(gene))
    return c.withColumn(gene, to).groupBy(*by, sequence, gene).agg(F.sum(weight).alias(weight))


def consensus(reads: DataFrame, by: Sequence[str], seq: str = "seq", qual: str = "qual", least: int = 1, share: float = 0.5) -> DataFrame:
    """(by, seq, qual, reads): the most weighted base of each position among a group's reads of the commonest length,
    by summed quality; positions whose best base has less than `share` of it are N. All by aggregation, so a large group
    is combined before the shuffle."""
    by = list(by)
    lengths = reads.groupBy(*by, F.length(seq).alias("_len")).agg(F.count(F.lit(1)).alias("_n"))
    common = lengths.groupBy(*by).agg(F.max_by("_len", F.struct("_n", "_len")).alias("_len"), F.sum("_n").alias("reads")).where(F.col("reads") >= least)
    rows = reads.join(common, by).where(F.length(seq) == F.col("_len"))
    bases = rows.select(*by, "reads", F.posexplode(F.split(seq, "")).alias("pos", "base"), F.col(qual).alias("_q")).where("base <> ''")
    q = F.coalesce(F.ascii(F.substr("_q", F.col("pos") + 1, F.lit(1))) - 33, F.lit(0))
    votes = bases.groupBy(*by, "reads", "pos", "base").agg(F.sum(q).alias("q"))
    best = votes.groupBy(*by, "reads", "pos").agg(F.max(F.struct("q", "base")).alias("b"), F.sum("q").alias("t"))
    base = F.when(F.col("b.q") >= share * F.col("t"), F.col("b.base")).otherwise("N")
    one = best.select(*by, "reads", "pos", base.alias("base"), F.least(F.col("b.q"), F.lit(60)).alias("q"))
    chars = F.array_sort(F.collect_list(F.struct("pos", "base", "q")))
    return one.groupBy(*by, "reads").agg(chars.alias("c")).select(
        *by, F.array_join(F.transform("c", lambda x: x["base"]), "").alias("seq"), F.array_join(F.transform("c", lambda x: F.chr(x["q"] + 33)), "").alias("qual"), "reads"
    )


def contigs(alignments: DataFrame, by: Sequence[str], start: str = "start", seq: str = "seq", least_share: float = 0.5) -> DataFrame:
    """(by, start, contig, coverage): reads placed on a common coordinate, the majority base of each covered position, the
    longest run of positions that are all covered and clear."""
    by = list(by)
    bases = alignments.select(*by, F.col(start).alias("_s"), F.posexplode(F.split(seq, "")).alias("_p", "base")).where("base <> ''")
    votes = bases.groupBy(*by, (F.col("_s") + F.col("_p")).alias("pos"), "base").agg(F.count(F.lit(1)).alias("n"))
    best = votes.groupBy(*by, "pos").agg(F.max(F.struct("n", "base")).alias("b"), F.sum("n").alias("t")).where(F.col("b.n") >= least_share * F.col("t"))
    w = Window.partitionBy(*by).orderBy("pos")
    runs = best.withColumn("run", F.col("pos") - F.row_number().over(w))
    parts = runs.groupBy(*by, "run").agg(F.min("pos").alias("start"), F.array_sort(F.collect_list(F.struct("pos", F.col("b.base").alias("base")))).alias("c"), F.avg("t").alias("coverage"))
    text = parts.select(*by, "start", F.array_join(F.transform("c", lambda x: x["base"]), "").alias("contig"), "coverage")
    return text.groupBy(*by).agg(F.max_by(F.struct("start", "contig", "coverage"), F.struct(F.length("contig"), -F.col("start"))).alias("x")).select(*by, "x.*")


def group_cells(clone_cells: DataFrame, clone: str = "clone_id", cell: str = "cell", overlap: float = 0.5) -> DataFrame:
    """(clone, cell_group): clones that share at least `overlap` of the smaller one's cells are one group; clones linked
    with none are "undefined". Shared cells are counted from the cells' own clone lists, which are short."""
    cc = clone_cells.select(clone, cell).distinct()
    n = cc.groupBy(clone).agg(F.count(F.lit(1)).alias("n"))
    x, y = (cc.select(F.col(clone).alias(k), cell) for k in "ab")
    shared = x.join(y, cell).where("a < b").groupBy("a", "b").agg(F.count(F.lit(1)).alias("k"))
    sized = shared.join(n.select(F.col(clone).alias("a"), F.col("n").alias("na")), "a").join(n.select(F.col(clone).alias("b"), F.col("n").alias("nb")), "b")
    edges = sized.where(F.col("k") >= overlap * F.least("na", "nb")).select("a", "b")
    found = components(edges)
    return n.select(clone).join(found, F.col(clone) == F.col("node"), "left").select(clone, F.coalesce(F.col("component").cast("string"), F.lit("undefined")).alias("cell_group"))


def group_chains(clones: DataFrame, group: str = "cell_group", chain: str = "chain", weight: str = "count", key: str = "clone_id") -> DataFrame:
    """One row a group and chain: the heaviest and second heaviest clone, how many clones, and the total."""
    w = Window.partitionBy(group, chain).orderBy(F.col(weight).desc(), key)
    r = clones.withColumn("_r", F.row_number().over(w))
    pick = lambda i, c: F.max(F.when(F.col("_r") == i, F.col(c)))
    return r.groupBy(group, chain).agg(pick(1, key).alias("first"), pick(1, weight).alias("first_weight"), pick(2, key).alias("second"), F.count(F.lit(1)).alias("n_clones"), F.sum(weight).alias("total"))


#: Groups of at most this many sequences emit all their near pairs; larger ones only what spans their components, and those
#: of more than twice BLOCK are compared by pairs of blocks.
FEW, BLOCK = 32, 2048


def _codes(texts: list[str]) -> np.ndarray:
    """A row of small numbers a text, equal where the characters are; shorter texts are padded with a character of their own."""
    width = max(1, max(map(len, texts)))
    points = np.array([t.ljust(width, "\ud800") for t in texts], dtype=f"<U{width}").view(np.uint32).reshape(len(texts), width)
    values, codes = np.unique(points, return_inverse=True)
    return codes.reshape(points.shape).astype(np.uint8 if len(values) <= 256 else np.uint32)


def _differ(columns: list[np.ndarray], other: Sequence) -> np.ndarray:
    """In how many columns `other` differs, a scalar or an array a column."""
    total = None
    for c, o in zip(columns, other, strict=True):
        d = c != o
        total = d.astype(np.uint8 if len(columns) < 256 else np.int32) if total is None else np.add(total, d, out=total)
    return total


def _spanning(codes: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Pairs of rows that differ in at most `most` columns, as many as connect all that such pairs connect."""
    columns = list(codes.T)
    near = _differ([c[:, None] for c in columns], [c[None] for c in columns]) <= most
    free, out = np.ones(len(codes), bool), []
    for first in range(len(codes)):
        if free[first]:
            free[first], stack = False, [first]
            while stack:
                more = np.flatnonzero(near[stack.pop()] & free)
                free[more] = False
                out += [(first, j) for j in more.tolist()]
                stack += more.tolist()
    return out


def _near(batches):
    """(a, b): ids of sequences of a group that differ in at most k places, or are connected by such."""
    for batch in batches:
        lists = batch.column("rows")
        ids, seqs = lists.flatten().flatten()
        sizes = np.diff(lists.offsets.to_numpy())
        group, lengths, most = np.repeat(np.arange(len(sizes)), sizes), batch.column("n").to_numpy(), batch.column("k").to_numpy()
        a, b = [], []
        for n in np.unique(lengths).tolist():
            rows = np.flatnonzero(lengths[group] == n)
            k, g = int(most[group[rows[0]]]), group[rows]
            codes = _codes(seqs.take(pa.array(rows)).to_pylist())
            few = sizes[g] <= FEW
            for d in range(1, FEW):
                x = np.flatnonzero((g[d:] == g[:-d]) & few[:-d])
                if not len(x):
                    break
                x = x[(codes[x] != codes[x + d]).sum(axis=1) <= k]
                a += rows[x].tolist()
                b += rows[x + d].tolist()
            for many in np.unique(g[~few]).tolist():
                at = np.searchsorted(g, many)
                for x, y in _spanning(codes[at : at + sizes[many]], k):
                    a.append(int(rows[at + x]))
                    b.append(int(rows[at + y]))
        yield pa.RecordBatch.from_arrays([ids.take(pa.array(x, pa.int64())) for x in (a, b)], names=["a", "b"])


def lineages(clones: DataFrame, seq: str = "cdr3_nt", block: Sequence[str] = ("v_gene", "j_gene"), identity: float = 0.85, key: str = "clone_id") -> DataFrame:
    """(key, tree_id): single linkage, inside blocks of equal genes and length, of sequences that differ in at most
    1 - identity of their positions. Candidates share one of k + 1 pieces, so a block isn't compared all with all; equal
    sequences are one candidate, and a group of candidates gives the links that connect it, not its pairs."""
    n = F.length("s")
    c = clones.select(F.col(key).alias("id"), *block, F.col(seq).alias("s")).where("id is not null and s <> ''").dropna(subset=list(block))
    one = settle(c.groupBy(*block, "s").agg(F.min("id").alias("id")).select("id", *block, "s", n.alias("n"), F.floor(F.lit(1 - identity + 1e-9) * n).cast("int").alias("k")))
    size = F.floor(F.col("n") / (F.col("k") + 1)).cast("int")
    pieces = F.transform(F.sequence(F.lit(0), F.col("k")), lambda i: F.struct(i.alias("i"), F.substr("s", i * size + 1, F.when(i == F.col("k"), F.col("n")).otherwise(size)).alias("p")))
    rows = one.select("id", *block, "s", "n", "k", F.explode(pieces).alias("piece")).select("id", *block, "s", "n", "k", "piece.i", "piece.p")
    on = [*block, "n", "i", "p"]
    blocks = F.when(F.col("m") > 2 * BLOCK, F.ceil(F.col("m") / BLOCK)).otherwise(1).cast("int")
    groups = rows.groupBy(*on).agg(F.count(F.lit(1)).alias("m")).where("m > 1").select(*on, blocks.alias("blocks"))
    own = F.pmod(F.xxhash64("s"), F.col("blocks")).cast("int")
    dealt = rows.join(groups, on).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).where("own <> other or blocks = 1")
    held = dealt.groupBy(*on, "k", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi")).agg(F.collect_list(F.struct("id", "s")).alias("rows"))
    ship(clones.sparkSession)
    kind = clones.schema[key].dataType.simpleString()
    edges = held.select("n", "k", "rows").mapInArrow(_near, f"a {kind}, b {kind}")
    copies = c.join(one.select(F.col("id").alias("a"), *block, "s"), [*block, "s"]).where("id <> a").select("a", F.col("id").alias("b"))
    found = components(edges.unionByName(copies))
    return clones.select(key).join(found, F.col(key) == F.col("node"), "left").select(key, F.coalesce("component", key).alias("tree_id"))


def _grown(texts: list[str]) -> list[tuple[int, int, int, int]]:
    """(node, parent, distance, height) of the tree that grows from text 0: next comes the nearest text, the first of equally
    near ones, under the first of the nodes nearest to it. Equal texts hang under the first of them."""
    first: dict[str, int] = {}
    for i, t in enumerate(texts):
        first.setdefault(t, i)
    codes, nodes = _codes(list(first)), np.array(list(first.values()))
    bits = len(texts).bit_length()
    columns, near = [np.ascontiguousarray(c) for c in codes.T], np.full(len(nodes), np.iinfo(np.int64).max)
    height, out, node, row, at = {0: 0}, [], 0, codes[0], 0
    for left in range(len(nodes) - 1, 0, -1):
        near = np.minimum(near, (_differ(columns, row).astype(np.int64) << bits) | node)
        near[at] = -1  # in the tree; as an unsigned number the largest
        if 2 * left < len(near):
            kept = np.flatnonzero(near >= 0)
            codes, nodes, near = codes[kept], nodes[kept], near[kept]
            columns = [np.ascontiguousarray(c) for c in codes.T]
        at = int(np.argmin((near >> bits).view(np.uint64)))
        distance, parent = divmod(int(near[at]), 1 << bits)
        node, row = int(nodes[at]), codes[at]
        height[node] = height[parent] + 1
        out.append((node, parent, distance, height[node]))
    return out + [(i, first[t], 0, height[first[t]] + 1) for i, t in enumerate(texts) if first[t] != i]


def lineage_trees(members: DataFrame, germline: str = "germline", seq: str = "seq", tree: str = "tree_id", key: str = "clone_id") -> DataFrame:
    """(tree, node_id, parent_id, distance, height): a spanning tree of each lineage that grows from its germline, each
    next sequence hung under the nearest node. node 0 is the germline. Lineages are small next to the table; each is one
    group in pandas."""

    def run(pdf):
        pdf = pdf.sort_values([key])
        name, ids = pdf[tree].iloc[0], [-1, *pdf[key]]
        rows = [(name, 0, None, None, 0, 0)]
        rows += [(name, i, p, ids[i], d, h) for i, p, d, h in _grown([pdf[germline].iloc[0], *pdf[seq]])]
        return pd.DataFrame(rows, columns=["tree_id", "node_id", "parent_id", "clone_id", "distance", "height"])

    ship(members.sparkSession)
    kind = members.schema[tree].dataType.simpleString()
    return members.select(tree, key, seq, germline).groupBy(tree).applyInPandas(run, f"tree_id {kind}, node_id int, parent_id int, clone_id long, distance int, height int")


def newick(nodes: DataFrame) -> DataFrame:
    """(tree_id, newick) of node tables with node_id, parent_id and distance."""

    def run(pdf):
        kids: dict = {}
        rows = {int(r.node_id): r for r in pdf.itertuples()}
        for r in pdf.itertuples():
            if pd.notna(r.parent_id):
                kids.setdefault(int(r.parent_id), []).append(int(r.node_id))
        text, stack = [], [0]
        while stack:  # nodes to write, and texts that follow them
            n = stack.pop()
            if isinstance(n, str):
                text.append(n)
                continue
            end = f"{n}:{int(rows[n].distance)}"
            if n not in kids:
                text.append(end)
                continue
            text.append("(")
            stack.append(")" + end)
            for i, k in enumerate(sorted(kids[n], reverse=True)):
                stack += [",", k] if i else [k]
        return pd.DataFrame([(pdf.tree_id.iloc[0], "".join(text) + ";")], columns=["tree_id", "newick"])

    ship(nodes.sparkSession)
    return nodes.groupBy("tree_id").applyInPandas(run, f"tree_id {nodes.schema['tree_id'].dataType.simpleString()}, newick string")


def tree_filter(nodes: DataFrame, min_nodes: int = 0, min_height: int = 0) -> DataFrame:
    nodes = settle(nodes)
    ok = nodes.groupBy("tree_id").agg(F.count(F.lit(1)).alias("n"), F.max("height").alias("h")).where((F.col("n") >= min_nodes) & (F.col("h") >= min_height))
    return nodes.join(ok.select("tree_id"), "tree_id", "left_semi")


def allele_candidates(mutations: DataFrame, gene: str = "v_gene", least_clones: int = 5, least_share: float = 0.35, least_diversity: int = 3) -> DataFrame:
    """(gene, mutations, n_clones, share, diversity): sets of mutations that many clones of a gene have in common, in
    contexts (other gene and CDR3 length) that differ, which separates alleles from one expanded clone. mutations has one
    row a clone: gene, mutations (sorted array), context."""
    total = mutations.groupBy(gene).agg(F.count(F.lit(1)).alias("_t"))
    sets = mutations.groupBy(gene, F.array_join("mutations", ",").alias("mutations")).agg(F.count(F.lit(1)).alias("n_clones"), F.countDistinct("context").alias("diversity"))
    share = F.col("n_clones") / F.col("_t")
    return sets.join(total, gene).withColumn("share", share).where((F.col("n_clones") >= least_clones) & (F.col("share") >= least_share) & (F.col("diversity") >= least_diversity)).drop("_t")
