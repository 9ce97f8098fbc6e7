"""N-gram Jaccard join by parity sketches: documents whose sets of 5-word shingles have a Jaccard similarity of 0.8 or more.

Sketches. Documents are put into size bands, a factor of two wide. In a band the hash range is cut into a number of cells
fixed for the band, and a set's sketch holds for each cell the exclusive-or of its shingles' hashes. A shingle that only
one of two sets has changes one cell, so the number of cells that differ, the sketches' Hamming distance over cells, is
at most the size of the symmetric difference, and that is at most a quarter of the smaller set for linked pairs. Bands
have so many cells that every set fills more than that (checked; else all hashes are cells of their own). By the pigeonhole
principle a linked pair shares a filled cell, and meets in the band of the larger one, for which the smaller one makes a
second sketch where a partner may be there.

Join. Cells travel packed, 16 bytes each, to shards by value. A cell that no other set has is a single; a set with more
singles than a quarter of its size is linked with nothing and drops out. That leaves what is mostly copied. Those sets
keep, of their other cells, the rarest that together with the singles make a quarter of their size plus one: a linked
pair still shares one of them. In each group of sets that share a cell, all are verified against one hub, the set most of
whose cells are shared, and components are formed; groups of plain copies are done after that. Groups that still hold
several components are joined to families, and each family is compared block by block, inside tasks that count common
shingles of two blocks by matrix products and emit only what connects components. So no link between components is
missed, and no pairs of a group are written out.

Exact copies are one node from the start: a node is the hash of a set. Verification compares 51-bit hashes of
shingles within pairs. Nothing is capped, and nothing but ids of checked number is broadcast.

Defined results: null and empty texts have n_shingles 0 and are their own component; texts of fewer than five words are one
shingle; rows without an id take no part and have no component; rows with the same id are one document in components.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import texts as tx
from .common import cut, min_labels, ship, small, tidy

WORDS = 5
#: Cells of a band, as a share of its upper size; bands of sizes under SMALL are one, each hash a cell of its own.
CELLS, SMALL = 0.32, 64
#: Similarity: NUM * intersection >= DEN * union.
NUM, DEN = 100, 80
HASH_BITS = 51
SHARD_CELLS = 2_000_000
#: Cells a task holds before they are dealt to shards; a flush takes about 100 bytes for each.
FLUSH = 400_000
SALT_ROWS = 200
#: Sets in a block of a family, shingles in a block, and shingles counted at a time.
BLOCK, BLOCK_SHINGLES, TOKENS = 256, 250_000, 4096
U64 = np.uint64


def shingle_sets(column: pa.Array, n_words: int = WORDS):
    """Yields (first row, rows, hashes, borders): each text's distinct shingles as sorted HASH_BITS-bit hashes."""
    for at, n, raw, off in tx.slices(column):
        for a in range(0, n, 8192):
            b = min(n, a + 8192)
            h, rows = tx.words(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            cut_ = tx.runs(rows, b - a)
            size = np.diff(cut_)
            s = np.zeros(max(0, len(h) - n_words + 1), U64)
            for k in range(n_words):
                s = s * U64(0xD6E8FEB86659FD93) + h[k : k + len(s)]
            whole = rows[: len(s)] == rows[n_words - 1 :]
            got, where = tx.mix(s[whole]), rows[: len(s)][whole]
            short = np.flatnonzero((size > 0) & (size < n_words))
            if len(short):
                extra = np.zeros(len(short), U64)
                for k in range(n_words - 1):
                    there = size[short] > k
                    extra[there] = extra[there] * U64(0xA0761D6478BD642F) + h[cut_[short[there]] + k]
                got, where = np.concatenate([got, tx.mix(extra + size[short].astype(U64))]), np.concatenate([where, short])
            key = np.sort((where.astype(U64) << U64(HASH_BITS)) | (got >> U64(64 - HASH_BITS)))
            key = key[np.flatnonzero(np.diff(key, prepend=~key[:1]))] if len(key) else key
            r = (key >> U64(HASH_BITS)).astype(np.int64)
            yield at + a, b - a, key & U64((1 << HASH_BITS) - 1), np.searchsorted(r, np.arange(b - a + 1))


def band(n: np.ndarray) -> np.ndarray:
    """0 for sizes under SMALL, else the exponent of the power of two above the size."""
    return np.where(n < SMALL, 0, np.floor(np.log2(np.maximum(n, 1))).astype(np.int64) + 1)


def node_keys(h: np.ndarray, borders: np.ndarray) -> np.ndarray:
    """A 63-bit key of each set, as an even signed number; 0 for empty sets."""
    n = np.diff(borders)
    out = np.zeros(len(n), U64)
    full = np.flatnonzero(n)
    if len(full):
        m = tx.mix(h + U64(1))
        out[full] = tx.mix(np.add.reduceat(m, borders[full]) ^ tx.mix(np.bitwise_xor.reduceat(m, borders[full]) + n[full].astype(U64)))
    return (out & ~U64(1)).view(np.int64)


def sketch(h: np.ndarray, borders: np.ndarray, rows: np.ndarray, bands: np.ndarray, celled: bool):
    """(signature of each filled cell, its row) of the sketches of some rows in the given bands."""
    n = np.diff(borders)[rows]
    take = np.concatenate([np.arange(borders[r], borders[r + 1]) for r in rows]) if len(rows) else np.empty(0, np.int64)
    x, at = h[take], np.repeat(np.arange(len(rows)), n)
    b = np.repeat(bands, n)
    cells = np.ceil(CELLS * np.exp2(b))
    cell = np.where((b > 0) & celled, np.floor(x.astype(np.float64) * 2.0**-HASH_BITS * cells), x.astype(np.float64)).astype(np.int64)
    first = np.flatnonzero((np.diff(at, prepend=-1) != 0) | (np.diff(cell, prepend=-1) != 0))
    if not len(first):
        return np.empty(0, U64), np.empty(0, np.int64)
    parity = np.bitwise_xor.reduceat(tx.mix(x), first)
    return tx.mix(parity ^ tx.mix(cell[first].astype(U64) + ((b[first] + 1).astype(U64) << U64(56)))), rows[at[first]]


def _both(h, borders, celled):
    """(signatures, row, 1 if for the next band) of all sketches."""
    n = np.diff(borders)
    b = band(n)
    rows = np.flatnonzero(n)
    up = rows[(b[rows] != band(n * 5 // 4)[rows])]
    s0, r0 = sketch(h, borders, rows, b[rows], celled)
    s1, r1 = sketch(h, borders, up, band(n * 5 // 4)[up], celled)
    return np.concatenate([s0, s1]), np.concatenate([r0, r1]), np.concatenate([np.zeros(len(r0), np.int64), np.ones(len(r1), np.int64)])


def document_sets(docs: DataFrame, celled: bool = True) -> DataFrame:
    """(doc_id, th, n, node, cells, cells_up) of every document, th being its text's hash."""

    def run(batches):
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("th")
            for at, k, h, borders in shingle_sets(batch.column("text")):
                n = np.diff(borders)
                _, rows, up = _both(h, borders, celled)
                own, more = (np.bincount(rows[up == u], minlength=k) for u in (0, 1))
                yield pa.RecordBatch.from_arrays([ids.slice(at, k), texts.slice(at, k), *(pa.array(x.astype(np.int64)) for x in (n, node_keys(h, borders), own, more))], names=["doc_id", "th", "n", "node", "cells", "cells_up"])

    return docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"), F.xxhash64("text").alias("th")).mapInArrow(tidy(run), "doc_id long, th long, n long, node long, cells long, cells_up long")


def packed_cells(docs: DataFrame, shards: int, celled: bool) -> DataFrame:
    """(shard, sigs, nodes) with packed signatures and their nodes, the last bit of a node telling the next band's."""

    def run(batches):
        held, size, seen = [], 0, set()

        def flush():
            s, i = (np.concatenate(x) for x in zip(*held, strict=True))
            shard = (s >> U64(32)) % U64(shards)
            order = np.argsort(shard, kind="stable")
            borders = np.searchsorted(shard[order], np.arange(shards + 1).astype(U64))
            s, i = s[order], i[order]
            full = np.flatnonzero(np.diff(borders))
            cols = [[x[borders[j] : borders[j + 1]].tobytes() for j in full] for x in (s, i)]
            return pa.RecordBatch.from_arrays([pa.array(full, pa.int32()), *(pa.array(c, pa.binary()) for c in cols)], names=["shard", "sigs", "nodes"])

        for batch in batches:
            for _, k, h, borders in shingle_sets(batch.column(0)):
                nodes = node_keys(h, borders)
                fresh = np.zeros(k, bool)
                for j, x in enumerate(nodes.tolist()):  # a copy of a set in the same task is left out
                    if x not in seen:
                        seen.add(x)
                        fresh[j] = True
                s, rows, up = _both(h, borders, celled)
                keep = fresh[rows]
                held.append((s[keep], (nodes[rows] | up)[keep]))
                size += int(keep.sum())
                if size >= FLUSH:
                    yield flush()
                    held, size = [], 0
        if size:
            yield flush()

    return docs.select("text").mapInArrow(tidy(run), "shard int, sigs binary, nodes binary")


def shared_cells(packed: DataFrame) -> DataFrame:
    """(entry, sigs, counts): for each entry (node and band) of a shard its cells that other nodes have too."""

    def run(key, rows):
        s = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in rows.column("sigs")])
        i = np.concatenate([np.frombuffer(x.as_buffer(), np.int64) for x in rows.column("nodes")])
        order = np.argsort(s)
        s, i = s[order], i[order]
        same = np.flatnonzero(s[1:] == s[:-1])
        more = np.zeros(len(s), bool)
        more[same] = more[same + 1] = True
        s, i = s[more], i[more]
        order = np.lexsort((i, s))
        s, i = s[order], i[order]
        once = np.ones(len(s), bool)  # copies in several tasks
        once[1:] = (s[1:] != s[:-1]) | (i[1:] != i[:-1])
        s, i = s[once], i[once]
        first = np.flatnonzero(np.diff(s, prepend=~s[:1])) if len(s) else np.empty(0, np.int64)
        counts = np.repeat(np.diff(np.append(first, len(s))), np.diff(np.append(first, len(s))))
        s, i, counts = s[counts > 1], i[counts > 1], counts[counts > 1]
        order = np.argsort(i, kind="stable")
        s, i, counts = s[order], i[order], counts[order].astype(np.int32)
        first = np.flatnonzero(np.diff(i, prepend=~i[:1])) if len(i) else np.empty(0, np.int64)
        ends = np.append(first, len(i))
        cuts = list(zip(ends[:-1], ends[1:], strict=True))
        return pa.table({"entry": pa.array(i[first], pa.int64()), "cells": pa.array([int(b - a) for a, b in cuts], pa.int64()), "sigs": pa.array([s[a:b].tobytes() for a, b in cuts], pa.binary()), "counts": pa.array([counts[a:b].tobytes() for a, b in cuts], pa.binary())})

    return packed.groupBy("shard").applyInArrow(run, "entry long, cells long, sigs binary, counts binary")


def rare_cells(entries: DataFrame) -> DataFrame:
    """(sig, node, share): of each surviving entry's shared cells the rarest that the pigeonhole principle asks for.
    entries: node, n, own (filled cells), shared, sigs, counts."""

    def run(batches):
        for b in batches:
            out = [[], [], []]
            for node, n, own, shared, sigs, counts in zip(*(b.column(c) for c in ("node", "n", "own", "shared", "sigs", "counts")), strict=True):
                s = np.concatenate([np.frombuffer(x.as_buffer(), U64) for x in sigs.values])
                c = np.concatenate([np.frombuffer(x.as_buffer(), np.int32) for x in counts.values])
                need = n.as_py() // 4 + 1 - (own.as_py() - shared.as_py())
                s = s[np.lexsort((s, c))[:need]]
                out[0].append(s)
                out[1].append(np.full(len(s), node.as_py()))
                out[2].append(np.full(len(s), shared.as_py() / own.as_py()))
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(out[0]).view(np.int64)), pa.array(np.concatenate(out[1])), pa.array(np.concatenate(out[2]))], names=["sig", "node", "share"])

    return entries.select("node", "n", "own", "shared", "sigs", "counts").mapInArrow(tidy(run), "sig long, node long, share double")


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The linked ones of distinct pairs (a, b), b being a hub. sets: node, shingles (packed hashes)."""
    sizes = pairs.groupBy("b").agg(F.ceil(F.count("*") / SALT_ROWS).cast("int").alias("salts"))
    dealt = pairs.join(sizes, "b").select("a", "b", F.pmod(F.xxhash64("a"), F.col("salts")).cast("int").alias("salt"))
    members = dealt.join(sets, dealt.a == sets.node).select("b", "salt", F.lit(True).alias("member"), "a", "shingles")
    hubs = dealt.select("b", "salt").distinct().join(sets, F.col("b") == F.col("node")).select("b", "salt", F.lit(False).alias("member"), F.col("b").alias("a"), "shingles")
    rows = members.unionByName(hubs).repartition("b", "salt").sortWithinPartitions("b", "salt", "member", "a")

    def run(batches):
        hub = None
        for batch in batches:
            a, b = [], []
            for k, member, node, shingles in zip(batch.column("b").to_pylist(), batch.column("member").to_pylist(), batch.column("a").to_pylist(), batch.column("shingles"), strict=True):
                x = np.frombuffer(shingles.as_buffer(), U64)
                if not member:
                    hub = x
                    continue
                both = len(np.intersect1d(hub, x, assume_unique=True))
                if NUM * both >= DEN * (len(hub) + len(x) - both):
                    a.append(node)
                    b.append(k)
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], names=["a", "b"])

    return rows.mapInArrow(tidy(run), "a long, b long")


def packed_sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(node, shingles) of the wanted (doc_id, node)."""

    def run(batches):
        for batch in batches:
            want = batch.column("node").to_numpy()
            for at, k, h, borders in shingle_sets(batch.column("text")):
                ok = np.flatnonzero(node_keys(h, borders) == want[at : at + k])
                yield pa.RecordBatch.from_arrays([pa.array(want[at + ok]), pa.array([h[borders[r] : borders[r + 1]].tobytes() for r in ok], pa.binary())], names=["node", "shingles"])

    rows = docs.select("doc_id", "text").where("text is not null").join(small(wanted), "doc_id")
    return rows.mapInArrow(tidy(run), "node long, shingles binary")


def block_links(sets: list[np.ndarray], side: np.ndarray, labels: np.ndarray) -> list[tuple[int, int]]:
    """Linked pairs that connect the labels of sets of two blocks (side 0 and 1), or of one (all 0)."""
    sizes = np.array([len(x) for x in sets])
    rows = np.repeat(np.arange(len(sets)), sizes)
    _, token, count = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    common = np.flatnonzero(count > 1)
    number = np.full(len(count), -1)
    number[common] = np.arange(len(common))
    token = number[token]
    rows, token = rows[token >= 0], token[token >= 0]
    order = np.argsort(token, kind="stable")
    rows, token = rows[order], token[order]
    left = np.flatnonzero(side == 0)
    right = np.flatnonzero(side == 1) if side.any() else left
    both = np.zeros((len(left), len(right)), np.float32)
    for at in range(0, len(common), TOKENS):
        a, b = np.searchsorted(token, [at, at + TOKENS])
        m = np.zeros((len(sets), TOKENS), np.float32)
        m[rows[a:b], token[a:b] - at] = 1
        both += m[left] @ m[right].T
    both = both.astype(np.int64)
    linked = NUM * both >= DEN * (sizes[left][:, None] + sizes[right][None] - both)
    linked &= labels[left][:, None] != labels[right][None]
    root = {x: x for x in labels.tolist()}

    def find(x):
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    out = []
    for i, j in np.argwhere(linked):
        x, y = find(int(labels[left[i]])), find(int(labels[right[j]]))
        if x != y:
            root[max(x, y)] = min(x, y)
            out.append((int(left[i]), int(right[j])))
    return out


def family_links(members: DataFrame, sets: DataFrame) -> DataFrame:
    """(a, b): links that connect the labels of each family. members: family, node, label."""
    sized = members.join(sets.select("node", (F.octet_length("shingles") / 8).alias("n")), "node")
    size = F.greatest(F.count("*") / BLOCK, F.sum("n") / BLOCK_SHINGLES)
    blocks = sized.groupBy("family").agg(F.ceil(size).cast("int").alias("blocks"), F.countDistinct("label").alias("labels")).where("labels > 1")
    dealt = members.join(blocks, "family").select("family", "node", "label", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int").alias("own"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("other"))
    rows = dealt.join(sets, "node").select("family", F.least("own", "other").alias("lo"), F.greatest("own", "other").alias("hi"), (F.col("own") > F.col("other")).alias("second"), "node", "label", "shingles")
    rows = rows.repartition("family", "lo", "hi").sortWithinPartitions("family", "lo", "hi", "second", "node")

    def links(held):
        nodes, labels, side = (np.array([h[i] for h in held]) for i in (0, 1, 2))
        got = block_links([h[3] for h in held], side.astype(int), labels)
        return pa.RecordBatch.from_arrays([pa.array([int(nodes[i]) for i, _ in got], pa.int64()), pa.array([int(nodes[j]) for _, j in got], pa.int64())], names=["a", "b"])

    def run(batches):
        key, held = None, []
        for b in batches:
            cols = [b.column(b.schema.get_field_index(c)) for c in ("family", "lo", "hi", "node", "label", "second")]
            for family, lo, hi, node, label, second, x in zip(*(c.to_pylist() for c in cols), b.column(b.schema.get_field_index("shingles")), strict=True):
                if (family, lo, hi) != key:
                    if held:
                        yield links(held)
                    key, held = (family, lo, hi), []
                held.append((node, label, second, np.frombuffer(x.as_buffer(), U64).copy()))
        if held:
            yield links(held)

    return rows.mapInArrow(tidy(run), "a long, b long")


def connect(groups: DataFrame, sets: DataFrame) -> DataFrame | None:
    """(node, label) of the linked nodes of groups (sig, node, share); None if no two are linked."""
    hubs = groups.groupBy("sig").agg(F.max(F.struct("share", "node")).alias("hub"), F.min("node").alias("first"), F.count("*").alias("k")).where("k > 1").select("sig", "first", F.col("hub.node").alias("b"))
    met = groups.join(hubs, "sig")
    pairs = met.where("node <> b").select(F.col("node").alias("a"), "b").distinct()
    edges = cut(verified(pairs, sets))
    labels = min_labels(edges)
    labelled = met.join(labels, "node", "left").select("sig", "node", "first", F.coalesce("label", "node").alias("label"))
    mixed = labelled.groupBy("sig").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi").select("sig")
    rest = cut(labelled.join(mixed, "sig").select("node", "first", "label").distinct())
    if rest.limit(1).count():
        families = min_labels(rest.select(F.col("node").alias("a"), F.col("first").alias("b"))).withColumnRenamed("label", "family")
        members = rest.select("node", "label").distinct().join(families, "node", "left").select(F.coalesce("family", "node").alias("family"), "node", "label")
        more = cut(family_links(members, sets))
        if more.limit(1).count():
            edges = edges.unionByName(more)
            labels = min_labels(edges)
    return labels if edges.limit(1).count() else None


def near_duplicates(docs: DataFrame) -> DataFrame:
    """(doc_id, n_shingles, component_id) of docs (doc_id, text): component_id is the smallest id reachable by links."""
    return labelled(docs).select("doc_id", "n_shingles", "component_id")


def labelled(docs: DataFrame) -> DataFrame:
    """near_duplicates with th, the text's hash, and label, which linked texts share; null for a text without shingles."""
    spark = docs.sparkSession
    ship(spark)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    celled = True
    sets = cut(document_sets(docs))
    top = sets.agg(F.sum(F.expr("cells + cells_up")).alias("cells"), F.max(F.expr("n > 0 and (cells <= n div 4 or cells_up > 0 and cells_up <= n div 4)")).alias("thin")).first()
    if top.thin:  # a set fills too few cells of its band
        celled = False
        sets = cut(document_sets(docs, False))
    nodes = cut(sets.where("n > 0 and doc_id is not null").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n").alias("n"), F.first("cells").alias("cells"), F.first("cells_up").alias("cells_up")))
    shards = max(4 * int(spark.conf.get("spark.sql.shuffle.partitions")), (top.cells or 0) // SHARD_CELLS)
    shared = cut(shared_cells(packed_cells(docs.where("doc_id is not null and text is not null"), shards, celled)))
    totals = shared.groupBy("entry").agg(F.sum("cells").alias("shared")).withColumn("node", F.col("entry").bitwiseAND(F.lit(-2)))
    entries = totals.join(nodes, "node").withColumn("own", F.when(F.col("entry") == F.col("node"), F.col("cells")).otherwise(F.col("cells_up")))
    alive = cut(entries.where("own - shared <= n div 4").select("entry", "node", "n", "own", "shared"))
    lists = shared.join(alive, "entry").groupBy("entry").agg(*[F.first(c).alias(c) for c in ("node", "n", "own", "shared")], F.collect_list("sigs").alias("sigs"), F.collect_list("counts").alias("counts"))
    groups = cut(rare_cells(lists))
    known = cut(packed_sets(docs, alive.select("node").distinct().join(nodes, "node").select("doc_id", "node"))).dropDuplicates(["node"])
    labels = connect(groups, known)
    if labels is None:
        where = nodes.select("node", F.col("node").alias("label"), F.col("doc_id").alias("component"))
    else:
        named = nodes.select("node", "doc_id").join(labels, "node", "left").withColumn("label", F.coalesce("label", "node"))
        best = named.groupBy("label").agg(F.min("doc_id").alias("component"))
        where = named.join(best, "label").select("node", "label", "component")
    out = sets.join(where.withColumnRenamed("node", "of_node"), F.col("node") == F.col("of_node"), "left")
    alone = F.when(F.col("doc_id").isNotNull(), F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("doc_id")))
    return out.select("doc_id", F.col("n").alias("n_shingles"), alone.alias("component_id"), "th", "label")
