"""Reads: merging of overlapping mates, V/D/J/C assignment by k-mer seeds and banded scoring, statuses.

Candidate genes come from an equi-join of read k-mers with the library's k-mers (the library is small and its size is
checked before it is broadcast); every gene that shares a k-mer with a read is scored by dynamic programming, in Arrow
batches, since the order of scores can differ from that of k-mer counts. The scoring is Smith-Waterman with linear gaps (1981) in a band around the seeds' diagonal.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.sequence import kmers
from ..shipping import ship

LIBRARY_ROWS = 50_000


def merge_pairs(df: DataFrame, min_overlap: int = 17, min_identity: float = 0.9, max_quality: int = 50) -> DataFrame:
    """df (r1, q1, r2, q2) with merged, merged_qual and overlap (null where mates don't overlap). Mates point at each
    other. The longest overlap of enough identity counts; where mates agree qualities add, else the better base stays
    with the difference."""
    ship(df.sparkSession)
    comp = bytes.maketrans(b"ACGTN", b"TGCAN")

    def one(r1, q1, r2, q2):
        if not r1 or not r2:
            return None, None, None
        a, b = np.frombuffer(r1.encode(), np.uint8), np.frombuffer(r2.encode().translate(comp)[::-1], np.uint8)
        x, y = np.frombuffer(q1.encode(), np.uint8).astype(int) - 33, np.frombuffer(q2.encode(), np.uint8)[::-1].astype(int) - 33
        for n in range(min(len(a), len(b)), min_overlap - 1, -1):
            same = a[-n:] == b[:n]
            if same.mean() >= min_identity:
                base = np.where(same | (x[-n:] >= y[:n]), a[-n:], b[:n])
                q = np.where(same, np.minimum(max_quality, x[-n:] + y[:n]), np.abs(x[-n:] - y[:n]))
                seq, qual = np.concatenate([a[:-n], base, b[n:]]), np.concatenate([x[:-n], q, y[n:]])
                return seq.tobytes().decode(), (qual + 33).astype(np.uint8).tobytes().decode(), int(n)
        return None, None, None

    def run(batches):
        for b in batches:
            got = [one(*r) for r in zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("r1", "q1", "r2", "q2")), strict=True)]
            cols = [pa.array([g[i] for g in got], t) for i, t in enumerate((pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([*b.columns, *cols], names=[*b.schema.names, "merged", "merged_qual", "overlap"])

    schema = df.withColumns({"merged": F.lit(None).cast("string"), "merged_qual": F.lit(None).cast("string"), "overlap": F.lit(None).cast("int")}).schema
    return df.mapInArrow(run, schema)


def local_score(read: str, ref: str, diagonal: int, band: int = 8, match: int = 5, mismatch: int = -4, gap: int = -9) -> tuple[int, int, int]:
    """(score, end in read, end in reference) of the best local alignment near a diagonal (reference minus read start)."""
    best, width = (0, 0, 0), 2 * band + 1
    row = [0] * (width + 2)
    for i, c in enumerate(read):
        new = [0] * (width + 2)
        for k in range(width):
            j = i + diagonal + k - band
            if 0 <= j < len(ref):
                s = max(0, row[k + 1] + (match if c == ref[j] else mismatch), row[k + 2] + gap, new[k] + gap)
                new[k + 1] = s
                if s > best[0]:
                    best = (s, i + 1, j + 1)
        row = new
    return best


def local_scores(reads: list[str], refs: list[str], diagonals: list[int], band: int = 8, match: int = 5, mismatch: int = -4, gap: int = -9) -> np.ndarray:
    """The scores of local_score for many pairs at once: each cell of the band is one step over all pairs."""

    def padded(texts):
        out = np.zeros((len(texts), max(map(len, texts), default=0) + 1), np.uint8)
        for i, t in enumerate(texts):
            out[i, : len(t)] = np.frombuffer(t.encode("ascii", "replace"), np.uint8)
        return out

    q, t = padded(reads), padded(refs)
    n_q, n_t = (np.array([len(x) for x in xs]) for xs in (reads, refs))
    at, width, diag = np.arange(len(reads)), 2 * band + 1, np.array(diagonals, np.int64)
    best = np.zeros(len(reads), np.int64)
    row = np.zeros((width + 2, len(reads)), np.int64)
    for i in range(q.shape[1] - 1):
        new = np.zeros_like(row)
        live = i < n_q
        for k in range(width):
            j = i + diag + k - band
            ok = live & (j >= 0) & (j < n_t)
            same = q[:, i] == t[at, np.clip(j, 0, t.shape[1] - 1)]
            s = np.maximum(np.maximum(0, row[k + 1] + np.where(same, match, mismatch)), np.maximum(row[k + 2], new[k]) + gap)
            new[k + 1] = np.where(ok, s, 0)
        best = np.maximum(best, new.max(0))
        row = new
    return best


def align_reads(reads: DataFrame, library: DataFrame, read_id: str = "read_id", seq: str = "seq", k: int = 9, min_score: int = 40, relative: float = 0.9, max_hits: int | None = None) -> DataFrame:
    """(read_id, gene_type, hits): for each gene type the genes of a read whose score is at least `relative` of the best, hits being
    (gene, score) by falling score; the first `max_hits` of them if that is given.

    library: gene, gene_type, ref. Genes without a sequence or with wildcards are left out."""
    lib = library.where("ref is not null and not ref rlike '[^ACGT]'")
    ship(reads.sparkSession)
    n = lib.count()
    if n > LIBRARY_ROWS:
        raise ValueError("the library is too large to be broadcast")
    pos = lambda c: F.transform(kmers(F.col(c), k), lambda x, i: F.struct(x.alias("kmer"), i.alias("at")))
    index = lib.select("gene", "gene_type", F.explode(pos("ref")).alias("s")).select("gene", "gene_type", "s.kmer", F.col("s.at").alias("ref_at"))
    seeds = reads.select(read_id, F.explode(pos(seq)).alias("s")).select(read_id, "s.kmer", "s.at").join(F.broadcast(index), "kmer")
    near = seeds.groupBy(read_id, "gene_type", "gene", (F.col("ref_at") - F.col("at")).alias("diagonal")).agg(F.count(F.lit(1)).alias("n"))
    best = near.groupBy(read_id, "gene_type", "gene").agg(F.max_by("diagonal", F.struct("n", "diagonal")).alias("diagonal"))
    rows = best.join(F.broadcast(lib.select("gene", "ref")), "gene").join(reads.select(read_id, F.col(seq).alias("_seq")), read_id)

    def run(batches):
        for b in batches:
            c = {x: b.column(b.schema.get_field_index(x)) for x in (read_id, "gene_type", "gene", "_seq", "ref", "diagonal")}
            s = np.concatenate([local_scores(*(c[x].slice(at, 2048).to_pylist() for x in ("_seq", "ref", "diagonal"))) for at in range(0, b.num_rows, 2048)] or [np.empty(0)])
            yield pa.RecordBatch.from_arrays([c[read_id], c["gene_type"], c["gene"], pa.array(s.astype(float), pa.float64())], names=[read_id, "gene_type", "gene", "score"])

    kind = reads.schema[read_id].dataType.simpleString()
    scored = rows.select(read_id, "gene_type", "gene", "_seq", "ref", "diagonal").mapInArrow(run, f"{read_id} {kind}, gene_type string, gene string, score double").where(F.col("score") >= min_score)
    hits = scored.groupBy(read_id, "gene_type").agg(F.array_sort(F.collect_list(F.struct((-F.col("score")).alias("k"), "gene", "score"))).alias("h"))
    top = F.filter("h", lambda x: x["score"] >= relative * F.element_at("h", 1)["score"])
    top = top if max_hits is None else F.slice(top, 1, max_hits)
    return hits.select(read_id, "gene_type", F.transform(top, lambda x: F.struct(x["gene"].alias("gene"), x["score"].alias("score"))).alias("hits"))


def statuses(reads: DataFrame, hits: DataFrame, read_id: str = "read_id", need: Sequence[str] = ("V", "J")) -> DataFrame:
    """(read_id, status): Good, or the first needed gene type that has no hit, as No<type>Hits; NoHits without any."""
    got = hits.groupBy(read_id).agg(F.collect_set("gene_type").alias("types"))
    status = F.when(F.col("types").isNull(), "NoHits")
    for t in need:
        status = status.when(~F.array_contains("types", t), f"No{t}Hits")
    return reads.select(read_id).join(got, read_id, "left").select(read_id, status.otherwise("Good").alias("status"))


def partial_overlaps(left: DataFrame, right: DataFrame, by: Sequence[str], k: int = 12, min_overlap: int = 15, min_identity: float = 0.95) -> DataFrame:
    """(by, left_id, right_id, overlap): partial reads whose ends overlap, inside a tag group. left and right: by, id, seq.
    Candidates share the k-mer with which the right read begins."""
    a = left.select(*by, F.col("id").alias("left_id"), F.col("seq").alias("l"), F.explode(F.transform(kmers(F.col("seq"), k), lambda x, i: F.struct(x.alias("kmer"), i.alias("at")))).alias("s")).select(*by, "left_id", "l", "s.kmer", "s.at")
    b = right.select(*by, F.col("id").alias("right_id"), F.col("seq").alias("r"), F.substring("seq", 1, k).alias("kmer"))
    n = F.length("l") - F.col("at")
    both = a.join(b, [*by, "kmer"]).withColumn("overlap", n).where((n >= min_overlap) & (n <= F.length("r")))
    x, y = F.substr("l", F.col("at") + 1, n), F.substr("r", F.lit(1), n)
    differ = F.aggregate(F.zip_with(F.split(x, ""), F.split(y, ""), lambda p, q: (p != q).cast("int")), F.lit(0), lambda s, v: s + v)
    return both.where(differ <= (1 - min_identity) * F.col("overlap")).groupBy(*by, "left_id", "right_id").agg(F.max("overlap").alias("overlap"))


def extend(df: DataFrame, seq: str, v_germline: str, j_germline: str, v_score: str, j_score: str, least: float = 30.0) -> DataFrame:
    """Sequences extended to the anchors by germline on the sides whose score suffices; added bases are lower case."""
    v = F.when(F.col(v_score) >= least, F.lower(F.coalesce(F.col(v_germline), F.lit("")))).otherwise("")
    j = F.when(F.col(j_score) >= least, F.lower(F.coalesce(F.col(j_germline), F.lit("")))).otherwise("")
    return df.withColumn("extended", F.concat(v, seq, j))


def pretty(df: DataFrame, query: str, target: str) -> DataFrame:
    """Two aligned sequences as text: the reference, and the query with dots where it agrees."""
    marks = F.array_join(F.zip_with(F.split(query, ""), F.split(target, ""), lambda a, b: F.when(a == b, ".").otherwise(F.coalesce(a, F.lit("-")))), "")
    return df.withColumn("pretty", F.concat(F.lit("ref   "), F.col(target), F.lit("\nquery "), marks))


def build_library(fasta: DataFrame, species: str, gene_type: str) -> DataFrame:
    """Library rows of FASTA records whose description begins with the gene's name."""
    return fasta.select(F.lit(species).alias("species"), F.regexp_extract("descr", r"^([^\s|]+)", 1).alias("gene"), F.lit(gene_type).alias("gene_type"), F.upper("seq").alias("ref"), (~F.upper("seq").rlike("[^ACGT]")).alias("functional"))
