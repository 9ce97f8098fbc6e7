"""Personal data by bootstrapped contextual extraction, with DataFrame functions only.

Seeds are the matches of four strict forms (email, ip, card, phone) that pass their checks. Instances are the places where a
kind is written loosely, in one token or several, and every other identifier-like token (one with a digit or an "@"). An
instance's patterns are the word before it, and that word with the one after it; where no word is before it, the word after.
Other instances and lone marks between are skipped. Patterns and instances make a bipartite
graph, an instance being a node for its kind and normalised writing, joined to the patterns of all its occurrences. A
pattern's confidence for a kind is the scores of its occurrences of that kind, over these, its wrong occurrences (of another
kind, or not even loosely of this one) and one; loose ones that are still unknown don't count. It is trusted
if that is high and known instances in several documents support it; an instance in a trusted pattern whose shape is one in
which the kind is written loosely gets the pattern's confidence as its score, wherever it occurs, and so may raise
other patterns. That goes on until no instance is new; scores stay and patterns only gain, so it ends. Found are the
occurrences in trusted patterns: a known string after a word that nothing else supports is left alone.

Positions come from cutting a text at the matches: a match starts after all pieces and matches before it. The forms are
written with possessive quantifiers and with \\G or a look-behind at the start, which match what the plain forms do
without deep recursion or restarts inside long runs.

Texts are read once, into a narrow table of spans and instances. Patterns are aggregated with partial sums, so a word
beside a third of all identifiers is no hot task. Seeds and instances of one text meet in a window over its identifiers.

Defined results: null and empty texts have no spans; repeated rows are judged each on their own; extra columns are
left out; very long texts are read whole, in time about linear in their length and identifiers; positions are code points, the end exclusive.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import cut, small

#: Fixed forms, in the order of their kinds.
FORMS = {
    "email": r"(?:(?<![A-Za-z0-9._%+-])|\G)[A-Za-z0-9._%+-]++@[A-Za-z0-9-]++(?:\.[A-Za-z0-9-]++)++",
    "ip": r"(?:(?<![0-9])|\G)[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++",
    "card": r"[0-9](?:[\x20-]?[0-9])++",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
}
KINDS = list(FORMS)
#: What a text must hold for a form to be looked for.
NEEDS = {"email": "@", "ip": ".", "card": None, "phone": "+"}
AT = r"(?:\x20?[(\[{]at[)\]}]\x20?|\x20?@\x20?|\x20at\x20)"
DOT = r"(?:\x20?(?:[(\[{]dot[)\]}]|[(\[]\.[)\]])\x20?|\x20dot\x20|\x20\.\x20)"
GAP = r"(?:\x20?[./-]\x20?|\x20)"
#: Loose shapes of each kind, without the punctuation around them; of one token or several.
LOOSE = {
    "email": rf"[A-Za-z0-9._%+-]++{AT}[A-Za-z0-9-]++(?:(?:\.|{DOT})[A-Za-z0-9-]++)++",
    "ip": rf"(?![0-9]+\.[0-9]+\.[0-9]+\.[0-9])[0-9]{{1,3}}(?:(?:\.|{DOT})[0-9]{{1,3}}){{3}}",
    "card": r"[0-9]{4}(?:[\x20._/-]?[0-9]{4}){3}",
    "phone": rf"(?:\([0-9]{{3}}\)\x20?|\(?[0-9]{{3}}\)?{GAP})[0-9]{{3}}{GAP}[0-9]{{4}}",
}
WS = r"\x20\x09-\x0D"
MANY = "|".join(LOOSE.values())
TOKEN = rf"(?<![^{WS}])(?:[\"'(<:;,]*(?i:{MANY})(?=[\"')>:;,.!?]*+(?:[{WS}]|$))|[^{WS}0-9@]*+[0-9@][^{WS}]*+)"
CONFIDENCE, SUPPORT = 0.8, 5
CHUNK = 256


def _scan(items: Column, zero: dict[str, Column], step) -> Column:
    """The array `out` that step appends to as it goes through items, from zero on. It grows in pieces of CHUNK, for an
    array is copied with each element that is appended to it."""
    of = lambda a: F.transform(F.sequence(F.lit(0), ((F.greatest(F.size(a), F.lit(1)) - 1) / CHUNK).cast("int")), lambda i: F.slice(a, i * CHUNK + 1, F.lit(CHUNK)))
    pieces = F.transform(F.array(items), of)[0]

    def piece(acc, one):
        last = F.element_at(acc, F.lit(-1))
        begun = F.struct(*[(zero[n] if n == "out" else last[n]).alias(n) for n in zero])
        return F.concat(acc, F.array(F.aggregate(one, begun, step)))

    done = F.aggregate(pieces, F.array(F.struct(*[c.alias(n) for n, c in zero.items()])), piece)
    return F.flatten(F.transform(done, lambda d: d["out"]))


def _spans(text: Column, form: str, words: bool = False) -> Column:
    """array<struct<start, end, hit, before, after>> of a form's matches; if wanted, before and after are the nearest words
    outside of matches."""
    hits = F.regexp_extract_all(text, F.lit(form), F.lit(0))
    gaps = F.split(text, form, -1)
    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,before:string,after:string>>)")
    last, first = (_last_word, _first_word) if words else ((lambda g: F.lit("")), (lambda g: F.lit("")))

    def step(acc, x):
        start = acc["at"] + F.length(x["gap"])
        end = start + F.length(x["hit"])
        word = F.coalesce(F.nullif(last(x["gap"]), F.lit("")), acc["word"])
        one = F.struct(start.alias("start"), end.alias("end"), x["hit"].alias("hit"), word.alias("before"), first(x["next"]).alias("after"))
        return F.struct(end.alias("at"), word.alias("word"), F.concat(acc["out"], F.array(one)).alias("out"))

    def back(acc, x):
        word = F.coalesce(F.nullif(x["after"], F.lit("")), acc["word"])
        one = F.struct(x["start"].alias("start"), x["end"].alias("end"), x["hit"].alias("hit"), x["before"].alias("before"), word.alias("after"))
        return F.struct(word.alias("word"), F.concat(acc["out"], F.array(one)).alias("out"))

    beside = F.arrays_zip(hits.alias("hit"), F.slice(gaps, F.lit(1), F.size(hits)).alias("gap"), F.slice(gaps, F.lit(2), F.size(hits)).alias("next"))
    out = _scan(beside, {"at": F.lit(0), "word": F.lit(""), "out": none}, step)
    if not words:
        return out
    return _scan(F.reverse(out), {"word": F.lit(""), "out": none}, back)


def _luhn(hit: Column) -> Column:
    d = F.regexp_replace(hit, r"[^0-9]", "")

    def add(acc, i):
        x = F.ascii(F.substr(d, F.length(d) - i + 1, F.lit(1))) - 48
        twice = F.when(x * 2 > 9, x * 2 - 9).otherwise(x * 2)
        return acc + F.when(i % 2 == 0, twice).otherwise(x)

    total = F.aggregate(F.sequence(F.lit(1), F.length(d)), F.lit(0), add)
    return F.when(F.length(d).between(16, 19), total % 10 == 0).otherwise(F.lit(False))


def _valid(kind: str, hit: Column) -> Column:
    if kind == "ip":
        part = lambda p: F.regexp_replace(p, "^0+", "")
        return F.forall(F.split(hit, r"\."), lambda p: F.when(F.length(part(p)) <= 3, F.coalesce(part(p).try_cast("int"), F.lit(0)) <= 255).otherwise(F.lit(False)))
    if kind == "card":
        return _luhn(hit)
    if kind == "phone":
        return F.length(F.regexp_replace(hit, r"[^0-9]", "")).between(8, 15)
    return F.lit(True)


def base_spans(text: Column, kind: str) -> Column:
    """array<struct<start, end>> of the seeds of a kind."""
    found = F.filter(_spans(text, FORMS[kind]), lambda s: _valid(kind, s["hit"]))
    there = F.contains(text, F.lit(NEEDS[kind])) if NEEDS[kind] else text.rlike("[0-9][ -]?[0-9]")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    return F.when(there, F.transform(found, lambda s: F.struct(s["start"].alias("start"), s["end"].alias("end")))).otherwise(none)


def _last_word(gap: Column) -> Column:
    """The last word of a piece of text, lower-cased and without punctuation; of at most the last 200 characters."""
    tail = F.regexp_replace(F.translate(F.substring(gap, -200, 200), "\t\n\x0b\x0c\r", "     "), r"[^\p{L}\p{N}]+$", "")
    return F.lower(F.regexp_replace(F.substring_index(tail, " ", -1), r"[^\p{L}\p{N}]+", ""))


def _first_word(gap: Column) -> Column:
    """The first word, in the same way."""
    head = F.regexp_replace(F.translate(F.substring(gap, 1, 200), "\t\n\x0b\x0c\r", "     "), r"^[^\p{L}\p{N}]+", "")
    return F.lower(F.regexp_replace(F.substring_index(head, " ", 1), r"[^\p{L}\p{N}]+", ""))


def instances(text: Column) -> Column:
    """array<struct<start, end, hit, before, after>> of loosely written identifiers and identifier-like tokens, punctuation at
    their ends left out."""
    raw = _spans(text, TOKEN, True)

    def trim(s):
        lead = F.length(s["hit"]) - F.length(F.regexp_replace(s["hit"], r"^(?:[\"'<:;,]|\((?![0-9]{3}\)))+", ""))
        trail = F.length(s["hit"]) - F.length(F.regexp_replace(s["hit"], r"[\"')>:;,.!?]+$", ""))
        start, end = s["start"] + lead, s["end"] - trail
        return F.struct(start.alias("start"), end.alias("end"), F.substr(s["hit"], lead + 1, F.greatest(F.lit(0), end - start)).alias("hit"), s["before"].alias("before"), s["after"].alias("after"))

    none = F.expr("cast(array() as array<struct<start:int,end:int,hit:string,before:string,after:string>>)")
    return F.when(text.rlike(rf"[0-9@]|(?i:{AT}[a-z0-9-]++(?:\.|{DOT})[a-z0-9-])"), F.filter(F.transform(raw, trim), lambda s: s["end"] > s["start"])).otherwise(none)


def _normal(hit: Column, kind: Column) -> Column:
    """What an identifier has in common with its other writings."""
    dots = F.regexp_replace(F.regexp_replace(F.lower(hit), AT, "@"), DOT, ".")
    return F.when(kind.isin("card", "phone"), F.regexp_replace(hit, "[^0-9]", "")).otherwise(dots)


def bootstrap(table: DataFrame) -> DataFrame:
    """(rid, kind, start, end) of identifiers found by patterns. table: rid, a span array for each kind, inst."""
    seen = table.select("rid", F.explode("inst").alias("i")).select("rid", "i.*", F.lit(None).cast("string").alias("seed"))
    of_kind = lambda k: F.transform(k, lambda b: F.struct(b["start"].alias("start"), b["end"].alias("end"), F.lit(k).alias("seed")))
    seeds = table.where(F.size("inst") > 0).select("rid", F.explode(F.concat(*[of_kind(k) for k in KINDS])).alias("s")).select("rid", "s.*")
    placed = seen.unionByName(seeds, allowMissingColumns=True)
    # the instance begins a seed, or a seed begins in it: the next seed from its start on is the one to look at
    onward = Window.partitionBy("rid").orderBy(F.col("start").desc()).rangeBetween(Window.unboundedPreceding, 0)
    earlier = Window.partitionBy("rid").orderBy("start").rangeBetween(Window.unboundedPreceding, -1)
    of = F.lit(None).cast("string")
    for k in reversed(KINDS):
        of = F.when(F.col(f"next_{k}") < F.col("end"), F.lit(k)).otherwise(of)
    inside = F.coalesce(F.col("upto") > F.col("start"), F.lit(False))
    placed = placed.select("*", *[F.min(F.when(F.col("seed") == k, F.col("start"))).over(onward).alias(f"next_{k}") for k in KINDS])
    one = placed.withColumn("upto", F.max(F.when(F.col("seed").isNotNull(), F.col("end"))).over(earlier)).where("seed is null and (before <> '' or after <> '')")
    shape = F.lit(None).cast("string")
    for k in reversed(KINDS):
        shape = F.when(F.col("hit").rlike(f"(?i)^(?:{LOOSE[k]})$"), F.lit(k)).otherwise(shape)
    one = one.where(~inside).select("rid", "start", "end", "hit", "before", "after", of.alias("kind"), shape.alias("shape"))
    kind = F.coalesce("kind", "shape")
    before, after = F.col("before"), F.col("after")
    pattern = lambda side, word, use: F.struct(F.concat(F.lit(side), word).alias("pattern"), use.alias("use"))
    # a word after an instance counts for all, but is not enough to find one that has a word before it
    sides = F.array(F.when(before != "", pattern("<", before, F.lit(True))), F.when((before != "") & (after != ""), pattern("=", F.concat_ws(" ", before, after), F.lit(True))), F.when(after != "", pattern(">", after, before == "")))
    graph = cut(one.select("rid", "start", "end", F.col("kind").isNotNull().alias("strict"), kind.alias("kind"), _normal(F.col("hit"), kind).alias("norm"), F.explode(F.filter(sides, lambda p: p.isNotNull())).alias("p")).select("*", "p.*").drop("p"))
    totals = graph.groupBy("pattern", "kind").agg(F.count("*").alias("n")).groupBy("pattern").agg(F.sum("n").alias("n"), *[F.sum(F.when(F.col("kind") == k, F.col("n")).otherwise(0)).alias(f"n_{k}") for k in KINDS])
    wrong = cut(totals.select("pattern", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), (F.col("n") - F.col(f"n_{k}")).alias("wrong")) for k in KINDS])).alias("w")).select("pattern", "w.*"))
    nodes = graph.where("kind is not null")
    scores = cut(nodes.where("strict").select("norm", "kind").distinct().withColumn("score", F.lit(1.0)))
    while True:
        near = nodes.join(small(scores), ["norm", "kind"])
        sums = near.groupBy("pattern", "kind", "rid").agg(F.sum("score").alias("score")).groupBy("pattern", "kind").agg(F.sum("score").alias("score"), F.count("*").alias("support"))
        patterns = sums.where(F.col("support") >= SUPPORT).join(wrong, ["pattern", "kind"]).select("pattern", "kind", (F.col("score") / (F.col("score") + F.col("wrong") + 1)).alias("confidence"))
        patterns = small(cut(patterns.where(F.col("confidence") >= CONFIDENCE)))
        reached = nodes.where("use").join(patterns, ["pattern", "kind"])
        best = reached.groupBy("norm", "kind").agg(F.max("confidence").alias("score"))
        new = cut(best.join(scores.select("norm", "kind"), ["norm", "kind"], "left_anti"))
        if not new.limit(1).count():
            return reached.where("not strict").select("rid", "kind", "start", "end").distinct()
        scores = cut(scores.unionByName(new))


def _written(spans: list[tuple[str, Column]]) -> Column:
    def of(kind, c):
        return F.transform(F.array_sort(c), lambda s: F.concat(F.lit(f"{kind}:"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")))

    return F.array_join(F.concat(*[of(k, c) for k, c in spans]), ",")


def personal_data(docs: DataFrame) -> DataFrame:
    """(doc_id, n_email, n_ip, n_card, n_phone, base_sha256, spans, n_found) of docs (doc_id, text). The counts are of the
    strict forms; spans has all, n_found how many of them patterns found."""
    text = F.coalesce(F.col("text"), F.lit(""))
    read = docs.select(F.monotonically_increasing_id().alias("rid"), "doc_id", text.alias("text"))
    table = cut(read.select("rid", "doc_id", *[base_spans(F.col("text"), k).alias(k) for k in KINDS], instances(F.col("text")).alias("inst")))
    more = bootstrap(table).groupBy("rid").agg(*[F.collect_list(F.when(F.col("kind") == k, F.struct("start", "end"))).alias(f"f_{k}") for k in KINDS])
    out = table.drop("inst").join(more, "rid", "left")
    none = F.expr("cast(array() as array<struct<start:int,end:int>>)")
    extra = {k: F.coalesce(F.col(f"f_{k}"), none) for k in KINDS}
    found = reduce(lambda a, b: a + b, [F.size(extra[k]) for k in KINDS])
    return out.select(
        "doc_id", *[F.size(k).cast("long").alias(f"n_{k}") for k in KINDS],
        F.sha2(_written([(k, F.col(k)) for k in KINDS]).cast("binary"), 256).alias("base_sha256"),
        _written([(k, F.concat(F.col(k), extra[k])) for k in KINDS]).alias("spans"),
        found.cast("long").alias("n_found"),
    )
