"""Column functions on nucleotide and amino-acid sequences; all are built-in expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The standard genetic code, the codons' bases running through T, C, A, G, the last fastest.
BASES = "TCAG"
AMINO_ACIDS = "FFLLSSSSYY**CC*WLLLLPPPPHHQQRRRRIIIMTTTTNNKKSSRRVVVVAAAADDEEGGGG"
CODONS = {a + b + c: AMINO_ACIDS[16 * i + 4 * j + k] for i, a in enumerate(BASES) for j, b in enumerate(BASES) for k, c in enumerate(BASES)}

# Kyte-Doolittle hydropathy (1982); side-chain volumes in cubic angstroms (Zamyatnin 1972); charge at pH 7.
HYDROPATHY = {"A": 1.8, "R": -4.5, "N": -3.5, "D": -3.5, "C": 2.5, "Q": -3.5, "E": -3.5, "G": -0.4, "H": -3.2, "I": 4.5, "L": 3.8, "K": -3.9, "M": 1.9, "F": 2.8, "P": -1.6, "S": -0.8, "T": -0.7, "W": -0.9, "Y": -1.3, "V": 4.2}
VOLUME = {"A": 88.6, "R": 173.4, "N": 114.1, "D": 111.1, "C": 108.5, "Q": 143.8, "E": 138.4, "G": 60.1, "H": 153.2, "I": 166.7, "L": 166.7, "K": 168.6, "M": 162.9, "F": 189.9, "P": 112.7, "S": 89.0, "T": 116.1, "W": 227.8, "Y": 193.6, "V": 140.0}
CHARGE = {"R": 1.0, "K": 1.0, "D": -1.0, "E": -1.0}
PROPERTIES = {"hydrophobicity": HYDROPATHY, "volume": VOLUME, "charge": CHARGE}


def _map(d: dict) -> Column:
    return F.create_map(*[F.lit(x) for kv in d.items() for x in kv])


def translate(nt: Column) -> Column:
    """Amino acids of a sequence read from its start: unknown codons are X, an incomplete one at the end is "_"."""
    n = F.length(nt)
    codons = F.when(n > 0, F.sequence(F.lit(0), F.floor((n - 1) / 3).cast("int"))).otherwise(F.array().cast("array<int>"))
    table = _map(CODONS)

    def one(i):
        codon = F.substr(F.upper(nt), i * 3 + 1, F.lit(3))
        return F.when(F.length(codon) < 3, "_").otherwise(F.coalesce(F.try_element_at(table, codon), F.lit("X")))

    return F.array_join(F.transform(codons, one), "")


def reverse_complement(nt: Column) -> Column:
    return F.reverse(F.translate(nt, "ACGTacgt", "TGCAtgca"))


def gc_content(nt: Column) -> Column:
    return F.try_divide(F.length(F.regexp_replace(nt, "[^GCgc]", "")), F.length(nt))


def is_out_of_frame(nt: Column) -> Column:
    return F.length(nt) % 3 != 0


def has_stop(aa: Column) -> Column:
    return F.contains(aa, F.lit("*"))


def is_productive(nt: Column, aa: Column) -> Column:
    """In frame and without a stop; an absent sequence is not productive."""
    return F.coalesce(~is_out_of_frame(nt) & ~has_stop(aa), F.lit(False))


def central(aa: Column, n: int = 5) -> Column:
    """The n residues in the middle; all of a shorter sequence; of an even number the middle lies one left of centre."""
    start = F.floor((F.length(aa) - n) / 2).cast("int") + 1
    return F.when(F.length(aa) <= n, aa).otherwise(F.substr(aa, start, F.lit(n)))


def residue_sum(aa: Column, table: dict[str, float]) -> Column:
    """Sum of a residue property; residues without one count 0."""
    values = _map(table)
    return F.aggregate(F.filter(F.split(aa, ""), lambda c: c != ""), F.lit(0.0), lambda s, c: s + F.coalesce(F.try_element_at(values, c), F.lit(0.0)))


def hamming(a: Column, b: Column) -> Column:
    """Positions that differ; null for unequal lengths."""
    differ = F.aggregate(F.zip_with(F.split(a, ""), F.split(b, ""), lambda x, y: (x != y).cast("int")), F.lit(0), lambda s, x: s + F.coalesce(x, F.lit(0)))
    return F.when(F.length(a) == F.length(b), differ)


def kmers(s: Column, k: int) -> Column:
    """All substrings of length k, in order."""
    n = F.length(s) - k + 1
    return F.when(n > 0, F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda i: F.substr(s, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))


def phred(quality: Column, offset: int = 33) -> Column:
    """array<int> of the qualities in a quality string."""
    return F.transform(F.filter(F.split(quality, ""), lambda c: c != ""), lambda c: F.ascii(c) - offset)


def mean_quality(quality: Column) -> Column:
    q = phred(quality)
    return F.try_divide(F.aggregate(q, F.lit(0), lambda s, x: s + x), F.size(q))


def trimmed_length(quality: Column, threshold: int, window: int = 6) -> Column:
    """How much of a read stays: all before the first window whose mean quality is below the threshold. A threshold of
    0 or less trims nothing."""
    if threshold <= 0:
        return F.length(quality)
    q = phred(quality)
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size(q) - window + 1))
    bad = F.filter(starts, lambda i: F.aggregate(F.slice(q, i, F.lit(window)), F.lit(0), lambda s, x: s + x) < F.lit(threshold) * F.least(F.lit(window), F.size(q)))
    return F.when(F.size(bad) > 0, F.element_at(bad, 1) - 1).otherwise(F.size(q))


def isotype(c_gene: Column) -> Column:
    """IgA, IgD, IgE, IgG or IgM from the name of a constant gene, else null."""
    letter = F.regexp_extract(c_gene, r"^IGH([ADEGM])", 1)
    return F.when(letter != "", F.concat(F.lit("Ig"), letter))


def chain(gene: Column) -> Column:
    """The chain that a gene's name begins with, e.g. TRB or IGH; null for others."""
    c = F.regexp_extract(gene, r"^(TR[ABDG]|IG[HKL])", 1)
    return F.when(c != "", c)


def substitutions(reference: Column, seq: Column) -> Column:
    """array of "S<from><position><to>" for two aligned sequences of one length, positions from 0."""
    pairs = F.zip_with(F.split(reference, ""), F.split(seq, ""), lambda x, y: F.struct(x.alias("x"), y.alias("y")))
    named = F.transform(pairs, lambda p, i: F.when(p["x"] != p["y"], F.concat(F.lit("S"), p["x"], i.cast("string"), p["y"])))
    return F.when(F.length(reference) == F.length(seq), F.array_compact(named))
