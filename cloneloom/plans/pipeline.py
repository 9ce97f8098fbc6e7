"""Presets, mixins and the chain of steps that they make.

A preset is an immutable set of step parameters; a mixin returns a changed copy. A plan is an ordered list of steps on
DataFrames, run lazily; only steps that are marked reuse write their result to the shared folder.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import asdict, dataclass, field, replace

from pyspark.sql import DataFrame

from ..functions import fields as export_fields
from ..operators import abundance, cluster, filters, tags
from ..operators.graph import settle


@dataclass(frozen=True)
class Align:
    tag_pattern: str | None = None
    species: str | None = None
    library: str = "default"
    min_score: int = 40
    limit: int | None = None


@dataclass(frozen=True)
class Refine:
    tags: tuple[str, ...] = ()
    whitelists: dict = field(default_factory=dict)
    correct: bool = True
    ratio: float = 4.0
    filter: tuple | None = None


@dataclass(frozen=True)
class Assemble:
    features: tuple[str, ...] = ("cdr3_nt",)
    split_by: tuple[str, ...] = ()
    error_ratio: float = 10.0
    depth: int = 2


@dataclass(frozen=True)
class Export:
    fields: tuple[str, ...] = ("readCount", "readFraction")
    productive_only: bool = False
    split_files: tuple[str, ...] = ()
    group_by: tuple[str, ...] = ()


@dataclass(frozen=True)
class Preset:
    name: str
    steps: tuple[str, ...] = ("align", "refine", "assemble", "export")
    align: Align = Align()
    refine: Refine = Refine()
    assemble: Assemble = Assemble()
    export: Export = Export()
    qc: tuple[str, ...] = ()

    def to_json(self) -> str:
        return json.dumps(asdict(self), indent=1)


PRESETS: dict[str, Preset] = {
    "bulk": Preset("bulk", ("align", "assemble", "export")),
    "umi": Preset("umi", refine=Refine(tags=("umi",))),
    "single-cell": Preset("single-cell", ("align", "refine", "assemble", "cells", "export"), refine=Refine(tags=("cell", "umi"))),
}

Mixin = Callable[[Preset], Preset]


def set_parameter(address: str, value) -> Mixin:
    """Any parameter by its address, e.g. assemble.error_ratio."""
    step, _, name = address.partition(".")

    def mix(p: Preset) -> Preset:
        if not name:
            return replace(p, **{step: value})
        return replace(p, **{step: replace(getattr(p, step), **{name: value})})

    return mix


def add_step(step: str, after: str | None = None) -> Mixin:
    def mix(p: Preset) -> Preset:
        rest = [s for s in p.steps if s != step]
        at = rest.index(after) + 1 if after else len(rest)
        return replace(p, steps=(*rest[:at], step, *rest[at:]))

    return mix


def remove_step(step: str) -> Mixin:
    return lambda p: replace(p, steps=tuple(s for s in p.steps if s != step))


def remove_check(name: str) -> Mixin:
    return lambda p: replace(p, qc=tuple(c for c in p.qc if c != name))


def add_fields(*names: str, first: bool = False) -> Mixin:
    return lambda p: replace(p, export=replace(p.export, fields=(*names, *p.export.fields) if first else (*p.export.fields, *names)))


def species(name: str) -> Mixin:
    return set_parameter("align.species", name)


def library(name: str) -> Mixin:
    return set_parameter("align.library", name)


def tag_pattern(pattern: str) -> Mixin:
    tags.compile_pattern(pattern)
    return set_parameter("align.tag_pattern", pattern)


def limit_input(n: int) -> Mixin:
    return set_parameter("align.limit", n)


def whitelist(tag: str, values) -> Mixin:
    return lambda p: replace(p, refine=replace(p.refine, whitelists=p.refine.whitelists | {tag: tuple(values)}))


def reset_whitelist(tag: str) -> Mixin:
    return lambda p: replace(p, refine=replace(p.refine, whitelists={k: v for k, v in p.refine.whitelists.items() if k != tag}))


def dont_correct(tag: str) -> Mixin:
    return lambda p: replace(p, refine=replace(p.refine, tags=tuple(t for t in p.refine.tags if t != tag)))


def clonotypes_by(*features: str) -> Mixin:
    return set_parameter("assemble.features", features)


def split_clones_by(*genes: str) -> Mixin:
    return set_parameter("assemble.split_by", genes)


def productive_only(on: bool = True) -> Mixin:
    return set_parameter("export.productive_only", on)


def split_files_by(*cols: str) -> Mixin:
    return set_parameter("export.split_files", cols)


def group_clones_by(*cols: str) -> Mixin:
    return set_parameter("export.group_by", cols)


def resolve(name: str, *mixins: Mixin, presets: dict[str, Preset] = PRESETS) -> Preset:
    if name not in presets:
        raise ValueError(f"unknown preset {name!r}; there are {sorted(presets)}")
    p = presets[name]
    for m in mixins:
        p = m(p)
    if len(set(p.steps)) != len(p.steps) or p.steps[:1] != ("align",):
        raise ValueError("steps must be distinct and begin with align")
    return p


def analyze(reads: DataFrame, preset: Preset, dry_run: bool = False) -> DataFrame | list[str]:
    """Run the steps on a table of aligned reads (sample, features, genes, tags) up to the exported clone table; a dry run
    returns the steps."""
    if dry_run:
        return list(preset.steps)
    df = reads
    if preset.align.limit is not None:
        df = df.orderBy("read_id").limit(preset.align.limit)
    if preset.align.tag_pattern:
        df = tags.parse_tags(df, "seq", preset.align.tag_pattern).where("status = 'Good'")
    for step in preset.steps[1:]:
        if step == "refine":
            for tag, values in preset.refine.whitelists.items():
                allowed = df.sparkSession.createDataFrame([(v,) for v in values], f"`{tag}` string")
                df = tags.whitelist(df, tag, allowed, 1)
            if preset.refine.correct and preset.refine.tags:
                df = tags.correct(df.withColumn("weight", tags.F.lit(1.0)), preset.refine.tags, ratio=preset.refine.ratio)
        elif step == "assemble":
            by = [*preset.assemble.features, *preset.assemble.split_by]
            clones = abundance.aggregate(df, ["sample", *by], name="count")
            clones = cluster.cluster_errors(clones, by[0], ("sample", *by[1:]), ratio=preset.assemble.error_ratio, depth=preset.assemble.depth)
            df = settle(abundance.fractions(clones, ("sample",), "count"))
        elif step == "export":
            if preset.export.productive_only:
                df = filters.productive(df, [f for f in preset.assemble.features if f.endswith("_nt")])
                df = abundance.fractions(df.drop("fraction"), ("sample",), "count")
            if preset.export.group_by:
                df = abundance.fractions(df.drop("fraction"), ("sample", *preset.export.group_by), "count")
            keep = [c for c in ("sample", *preset.assemble.features, *preset.assemble.split_by)]
            df = df.select(*keep, *[export_fields.FIELDS[f.split()[0]](*f.split()[1:]).alias(f.replace(" ", "")) for f in preset.export.fields])
    return df
