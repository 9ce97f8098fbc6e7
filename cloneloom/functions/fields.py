"""Registry of export fields: a name, with its arguments, gives a column. Tables are selected by lists of fields."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import sequence as S

FIELDS: dict[str, Callable[..., Column]] = {}


def field(name: str):
    def put(f):
        FIELDS[name] = f
        return f

    return put


for _name, _col in {"cloneId": "clone_id", "readCount": "count", "readFraction": "fraction", "cellGroup": "cell_group", "cellId": "cell", "readIds": "read_ids", "tags": "tags", "treeId": "tree_id", "nodeId": "node_id", "parentId": "parent_id"}.items():
    FIELDS[_name] = lambda c=_col: F.col(c)
for _g in "vdjc":
    FIELDS[f"{_g}Hit"] = lambda g=_g: F.col(f"{g}_gene")
    FIELDS[f"{_g}Family"] = lambda g=_g: F.regexp_extract(F.col(f"{g}_gene"), r"^([^-*#]+)", 1)
    FIELDS[f"{_g}HitsWithScore"] = lambda g=_g: F.array_join(F.transform(f"{g}_hits", lambda h: F.concat(h["gene"], F.lit("("), F.round(h["score"]).cast("long").cast("string"), F.lit(")"))), ",")


@field("nFeature")
def _n(feature: str) -> Column:
    return F.col(f"{feature.lower()}_nt")


@field("aaFeature")
def _aa(feature: str) -> Column:
    return S.translate(F.col(f"{feature.lower()}_nt"))


@field("nLength")
def _nl(feature: str) -> Column:
    return F.length(f"{feature.lower()}_nt")


@field("aaLength")
def _al(feature: str) -> Column:
    return F.floor(F.length(f"{feature.lower()}_nt") / 3).cast("int")


@field("isOOF")
def _oof(feature: str) -> Column:
    return S.is_out_of_frame(F.col(f"{feature.lower()}_nt"))


@field("hasStops")
def _stops(feature: str) -> Column:
    return S.has_stop(S.translate(F.col(f"{feature.lower()}_nt")))


@field("isProductive")
def _productive(feature: str) -> Column:
    nt = F.col(f"{feature.lower()}_nt")
    return S.is_productive(nt, S.translate(nt))


@field("biochemicalProperty")
def _property(feature: str, name: str, normalized: str = "yes") -> Column:
    aa = S.translate(F.col(f"{feature.lower()}_nt"))
    total = S.residue_sum(aa, S.PROPERTIES[name])
    return F.try_divide(total, F.length(aa)) if normalized == "yes" else total


@field("isotype")
def _isotype() -> Column:
    return S.isotype(F.col("c_gene"))


@field("topChains")
def _chains() -> Column:
    return S.chain(F.col("v_gene"))


@field("nMutations")
def _mutations(feature: str) -> Column:
    f = feature.lower()
    return F.array_join(S.substitutions(F.col(f"{f}_germline"), F.col(f"{f}_nt")), ",")


@field("nMutationsCount")
def _mutation_count(feature: str) -> Column:
    f = feature.lower()
    return F.size(S.substitutions(F.col(f"{f}_germline"), F.col(f"{f}_nt")))


@field("nMutationsRate")
def _mutation_rate(feature: str) -> Column:
    f = feature.lower()
    return F.try_divide(F.size(S.substitutions(F.col(f"{f}_germline"), F.col(f"{f}_nt"))), F.length(f"{f}_nt"))


@field("nFeatureImputed")
def _imputed(feature: str) -> Column:
    """The sequence, or the germline in lower case where it is missing."""
    f = feature.lower()
    return F.coalesce(F.col(f"{f}_nt"), F.lower(F.col(f"{f}_germline")))


def export(df: DataFrame, fields: list[str]) -> DataFrame:
    """One column for each "name arg ..." of fields, in order."""
    out = []
    for f in fields:
        name, *args = f.split()
        if name not in FIELDS:
            raise ValueError(f"unknown export field {name!r}")
        out.append(FIELDS[name](*args).alias(name + "".join(a[:1].upper() + a[1:] for a in args)))
    return df.select(*out)


# Column names of the AIRR rearrangement format, and where they come from.
AIRR = {
    "sequence_id": "clone_id", "sequence": "target_nt", "v_call": "v_gene", "d_call": "d_gene", "j_call": "j_gene", "c_call": "c_gene",
    "junction": "cdr3_nt", "cdr1": "cdr1_nt", "cdr2": "cdr2_nt", "cdr3": "cdr3_nt",
    "fwr1": "fr1_nt", "fwr2": "fr2_nt", "fwr3": "fr3_nt", "fwr4": "fr4_nt", "cell_id": "cell", "duplicate_count": "count", "umi_count": "umi_count",
}


def airr(df: DataFrame) -> DataFrame:
    """The AIRR rearrangement columns that the table has sources for; the rest are null. cdr3 is the junction without its
    conserved first and last codons."""
    have = set(df.columns)
    col = lambda c: F.col(c) if c in have else F.lit(None).cast("string")
    out = [col(src).cast("string").alias(name) for name, src in AIRR.items() if name != "cdr3"]
    j = col("cdr3_nt")
    aa = S.translate(j)
    out += [aa.alias("junction_aa"), F.length(j).alias("junction_length"), F.substr(j, F.lit(4), F.length(j) - 6).alias("cdr3"), S.is_productive(j, aa).alias("productive"), (F.length(j) % 3 == 0).alias("vj_in_frame"), S.has_stop(aa).alias("stop_codon")]
    return df.select(*out)
