"""Line deduplication by a segment-partition edit join (Li et al., 2011), with DataFrame functions only.

Lines within TAU edits of each other are linked, as are equal ones; of each connected class the first line, in the order
of (id, text hash, line number), stays. How many edits link two lines depends on the shorter: TAU from FUZZY characters,
one from SHORT, none below, where one edit is over a tenth of a line and makes another word or number. Blank lines stay.

A line is cut into TAU + 1 segments; if two lines are within TAU edits, one segment of the shorter occurs in the longer,
near the same place. A line is indexed by its own segments, keyed by (number, length, segment), which tells the line's
length but for TAU, and probes the segments of each length down to TAU less at the few starts that the multi-match-aware rule
leaves; what several of those have in common is one key. One aggregation by key finds keys that two different lines share;
keys with more than two lines are joined back to their lines.

Groups of a key are settled by hubs (common.link), so a family of like lines costs a comparison a line. Unlike lines that
share a segment, such as a common beginning, would be compared all with all; where more than common.FEW are left, they are
grouped anew by the same index over what they have besides the segment, which is within TAU edits too, and so on. What is
left when a few characters are, is indexed by its neighbourhoods: each edit script of at most two edits has a key of its own,
under which all are linked, or linked to the hub. Each line has a sketch, its length and how often it has each of some
letters; an edit changes the counts by two at most, and pairs whose sketches are farther apart are left out inside the joins.
Candidates are verified with a banded bit-parallel automaton: common beginnings and ends are left out, and then one small
integer for each number of edits holds which diagonals can be reached.

Segments of short lines would be in too many lines. Lines of SHORT to FUZZY characters are indexed by the neighbourhoods of
one edit.

Distinct lines are shuffled once, after that only hashes and candidates are. Lines are equal if two 64-bit hashes are, and
are told apart by one of them in the join; of different lines that share it, one takes part.

Defined results: null texts have no lines (and no row in dropped_lines) and stay null, an empty text is one blank line; rows
with equal id and text are one document and get the same lines; null ids come first; very long lines are compared whole; extra
columns pass through; empty tables give no rows.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import cut, link, release, small

TAU = 2
FUZZY = 40
SHORT = 10
#: Letters that sketches count.
LETTERS = "etaoinshrdlucm"


def segments(tau: int, rest: int) -> dict[tuple[int, int, int, int], bool]:
    """The segments that a line of (tau + 1) * q + rest characters is indexed by (True) and probes, each as (number, times,
    add, more): q + more characters from position times * q + add. Of tau + 1 segments the last ones are longer if it can't
    be even."""
    k, out = tau + 1, {}
    for delta in range(k):
        less, odd = (rest - delta) // k, (rest - delta) % k
        for i in range(1, k + 1):
            start = (i - 1) * less + max(0, i - 1 - (k - odd)) + 1
            more = less + (i > k - odd)
            for shift in range(max(-(i - 1), delta - (k - i)), min(i - 1, delta + k - i) + 1):
                one = (i, i - 1, start + shift, more)
                out[one] = out.get(one, False) or (delta == 0 and shift == 0)
    return out


def line_keys(line: Column, n: Column, tau: int) -> Column:
    """array<struct<key, own, place, long>> of the keys that a line of n characters is indexed by (own) and probes, and the
    place and length of each segment."""
    k, out = tau + 1, None
    q = F.floor(n / k).cast("int")
    for rest in range(k):
        keys = []
        for (i, times, add, more), own in segments(tau, rest).items():
            start, size = q * times + add, q + more
            keys.append(F.struct(F.xxhash64(F.lit(i), size, F.substr(line, start, size)).alias("key"), F.lit(own).alias("own"), start.alias("place"), size.alias("long")))
        out = F.array(*keys) if out is None else F.when(n % k == rest, F.array(*keys)).otherwise(out)
    return out


def line_rows(lines: DataFrame, tau: int) -> DataFrame:
    """(node, key, own) of the keys of line_keys, for lines (node, line, n, ascii) in bulk: one slot for a segment of each
    remainder of n, so that one short expression serves all, and segments of ASCII lines cut from bytes."""
    k = tau + 1
    slots = []
    for i in range(1, k + 1):
        of = [[x for x in segments(tau, rest).items() if x[0][0] == i] for rest in range(k)]
        slots += [[o[j] if j < len(o) else None for o in of] for j in range(max(map(len, of)))]

    def by_rest(values):
        out = F.lit(values[0])
        for rest in range(1, k):
            out = F.when(F.col("rest") == rest, F.lit(values[rest])).otherwise(out)
        return out if len(set(values)) > 1 else F.lit(values[0])

    keys = []
    for slot in slots:
        i = next(x for x in slot if x)[0][0]
        start = F.col("q") * (i - 1) + by_rest([x[0][2] if x else 1 for x in slot])
        size = F.col("q") + by_rest([x[0][3] if x else 0 for x in slot])
        keys.append(F.xxhash64(F.lit(i), size, F.substr("text", start, size)))
    place = F.col("slot") * k + F.col("rest")
    there = [p * k + r for p, slot in enumerate(slots) for r, x in enumerate(slot) if x]
    owned = [p * k + r for p, slot in enumerate(slots) for r, x in enumerate(slot) if x and x[1]]

    def rows(part, text):
        cut_ = part.select("node", text.alias("text"), F.floor(F.col("n") / k).cast("int").alias("q"), (F.col("n") % k).alias("rest"))
        found = cut_.select("node", "rest", F.posexplode(F.array(*keys)).alias("slot", "key"))
        return found.where(place.isin(there)).select("node", "key", place.isin(owned).alias("own"))

    return rows(lines.where("ascii"), F.col("line").cast("binary")).unionByName(rows(lines.where("not ascii"), F.col("line")))


def without(line: Column, at: Column, size: Column | int = 1) -> Column:
    return F.concat(F.substr(line, F.lit(1), at - 1), F.substr(line, at + size, F.length(line)))


def near_keys(line: Column, tau: int) -> Column:
    """array<struct<key, own>> of neighbourhoods of up to two edits, for short strings: two strings within tau edits share a
    key that one of them owns, and strings that share one are linked to those that own it.

    w: a string, owned, and what others become without some characters; s: what is left without the characters at
    certain places, which strings that differ only there share; c: what is left without one character, whichever; d: what
    is left without one place, owned, and what longer strings become without any character and that place."""
    if tau > 2:
        raise ValueError("at most two edits are indexed")
    n = F.length(line)
    places = lambda m: F.when(m > 0, F.sequence(F.lit(1), m)).otherwise(F.array().cast("array<int>"))
    key = lambda kind, own, *parts: F.struct(F.xxhash64(F.lit(kind), *parts).alias("key"), F.lit(own).alias("own"))
    each = lambda body: F.transform(places(n), body)
    parts = [F.array(key("w", True, line))]
    if tau:
        parts += [each(lambda p: key("w", False, without(line, p))), each(lambda p: key("s", True, p, without(line, p)))]
    if tau > 1:
        two = lambda body: F.flatten(each(lambda p: F.transform(places(n - 1), lambda r: body(p, r))))
        # place r of a string without place p
        parts += [
            two(lambda p, r: key("w", False, without(without(line, p), r))),
            F.flatten(each(lambda p: F.transform(places(p - 1), lambda r: key("s", True, r, p, without(without(line, p), r))))),
            each(lambda p: key("c", True, without(line, p))),
            each(lambda p: key("d", True, p, without(line, p))),
            two(lambda p, r: key("d", False, r, without(without(line, p), r))),
        ]
    return F.concat(*parts)


def allowed(length: Column, tau: int, fuzzy: int) -> Column:
    """The edits that link two lines, of which the shorter has this length."""
    return F.when(length >= fuzzy, tau).when(length >= SHORT, min(tau, 1)).otherwise(0)


def _let(value: Column, body) -> Column:
    """body of value, which is worked out once: the optimizer would put a plain column's expression into every use."""
    return F.element_at(F.transform(F.array(value), body), 1)


def _common(a: Column, b: Column, most: Column) -> Column:
    """Length of the common beginning, at most `most`, by doubling steps."""
    steps = F.array(*[F.lit(1 << i) for i in range(24, -1, -1)])

    def step(p, s):
        same = F.substr(a, p + 1, s) == F.substr(b, p + 1, s)
        return F.when((p + s <= most) & same, p + s).otherwise(p)

    return F.aggregate(steps, F.lit(0), lambda p, s: step(p, s))


def within(a: Column, b: Column, tau: int, most: Column | None = None) -> Column:
    """Whether a and b, arrays of characters, are within tau edits, or `most` of up to tau, by a banded bit-parallel automaton.

    Bit d + tau of r[e] tells whether the first j characters of b and the first j + d of a are within e edits."""
    width = 2 * tau + 1
    full = (1 << width) - 1
    begin = F.struct(*[F.lit(sum(1 << (d + tau) for d in range(e + 1))).alias(f"r{e}") for e in range(tau + 1)])

    def step(r, j):
        same = F.lit(0)
        for d in range(-tau, tau + 1):
            same = same + F.when(F.get(a, j + d - 1) == F.get(b, j - 1), F.lit(1 << (d + tau))).otherwise(F.lit(0))
        rows = []
        for e in range(tau + 1):
            x = r[f"r{e}"].bitwiseAND(same)
            if e:
                old = r[f"r{e - 1}"]
                # a character replaced, one more in b, one more in a
                x = x.bitwiseOR(old).bitwiseOR(F.shiftright(old, 1)).bitwiseOR(F.shiftleft(rows[-1], 1)).bitwiseAND(F.lit(full))
            rows.append(x)
        return F.struct(*[x.alias(f"r{e}") for e, x in enumerate(rows)])

    end = F.aggregate(F.sequence(F.lit(1), F.size(b)), begin, step)
    bit = F.call_function("shiftleft", F.lit(1), F.size(a) - F.size(b) + tau)
    most = F.lit(tau) if most is None else most
    row = reduce(lambda r, e: F.when(most == e, end[f"r{e}"]).otherwise(r), range(tau), end[f"r{tau}"])
    reached = row.bitwiseAND(bit) != 0
    none = F.size(a) <= most  # b is empty: only what a has is an edit
    return F.when(F.abs(F.size(a) - F.size(b)) > most, F.lit(False)).when(F.size(b) == 0, none).otherwise(reached)


def sketch(line: Column) -> Column:
    """array<int>: the length, and how often each of LETTERS occurs."""
    n = F.length(line)
    return F.array(n, *[n - F.length(F.replace(line, F.lit(c), F.lit(""))) for c in LETTERS])


def sketches_near(a: Column, b: Column, tau: int, fuzzy: int = FUZZY) -> Column:
    """Whether lines with these sketches can be within the edits allowed."""
    apart = sum((F.abs(F.get(a, F.lit(i)) - F.get(b, F.lit(i))) for i in range(1, len(LETTERS) + 1)), F.lit(0))
    most = allowed(F.least(F.get(a, F.lit(0)), F.get(b, F.lit(0))), tau, fuzzy)
    return (F.abs(F.get(a, F.lit(0)) - F.get(b, F.lit(0))) <= most) & (apart <= 2 * most)


def edit_linked(pairs: DataFrame, texts: DataFrame, tau: int = TAU, fuzzy: int = FUZZY) -> DataFrame:
    """The pairs (a, b) whose lines are within the edits allowed. texts: node, line."""
    x, y = (texts.select(F.col("node").alias(n), F.col("line").alias(f"t{n}")) for n in "ab")
    both = pairs.join(x, "a").join(y, "b")
    most = allowed(F.least(F.length("ta"), F.length("tb")), tau, fuzzy)
    close = F.abs(F.length("ta") - F.length("tb")) <= most

    def tails(v):
        p = _common(v["a"], v["b"], F.least(F.length(v["a"]), F.length(v["b"])))
        cut_ = lambda t, n: F.reverse(F.substr(t, n + 1, F.length(t)))
        return _let(F.struct(v["a"].alias("a"), v["b"].alias("b"), p.alias("p")), lambda w: F.struct(cut_(w["a"], w["p"]).alias("a"), cut_(w["b"], w["p"]).alias("b")))

    def middles(v):
        q = _common(v["a"], v["b"], F.least(F.length(v["a"]), F.length(v["b"])))
        rest = lambda t, n: F.when(F.length(t) > n, F.split(F.substr(t, n + 1, F.length(t)), "")).otherwise(F.array().cast("array<string>"))
        return _let(F.struct(v["a"].alias("a"), v["b"].alias("b"), q.alias("q")), lambda w: F.struct(rest(w["a"], w["q"]).alias("a"), rest(w["b"], w["q"]).alias("b")))

    same = _let(F.struct(F.col("ta").alias("a"), F.col("tb").alias("b")), lambda v: _let(tails(v), lambda w: _let(middles(w), lambda c: within(c["a"], c["b"], tau, most))))
    return both.where(F.when(close, same).otherwise(F.lit(False))).select("a", "b")


def _lines(docs: DataFrame) -> DataFrame:
    """(doc_id, th, pos, line) of every line of every text."""
    return docs.where("text is not null").select("doc_id", F.xxhash64("text").alias("th"), F.posexplode(F.split("text", "\n", -1)).alias("pos", "line"))


def _hash(line: str = "line") -> list[Column]:
    return [F.xxhash64(line).alias("node"), F.xxhash64(line, F.lit(1)).alias("check")]


def finer(groups: DataFrame, texts: DataFrame, tau: int) -> DataFrame:
    """Finer groups (sig, node, own, sketch, place, long, rest), by keys of what lines have besides the segment, at `place`,
    that they share; place 0 is that of the line whose key is sig. rest: what a line has besides earlier segments, null at
    first. Keys of short rests have no place: these groups are as fine as can be."""
    rows = groups.join(texts.select("node", "line", F.length("line").alias("n")), "node")
    first = rows.where("place = 0").select("sig", "node", "own", "sketch", "line", "rest", F.explode(line_keys(F.col("line"), F.col("n"), tau)).alias("k")).where("k.key = sig").select("sig", "node", "own", "sketch", "line", "rest", "k.place", "k.long")
    rows = first.unionByName(rows.where("place > 0").select(first.columns))
    whole = rows.withColumn("rest", without(F.coalesce("rest", "line"), F.col("place"), F.col("long"))).withColumn("n", F.length("rest"))
    none = F.lit(None).cast("int")
    near = F.transform(near_keys(F.col("rest"), tau), lambda k: F.struct(k["key"], k["own"], none.alias("place"), none.alias("long")))
    far = line_keys(F.col("rest"), F.col("n"), tau)
    # rests of linked lines differ by tau characters at most, so they have one kind of keys in common
    least = 3 * (tau + 1)
    found = F.when(F.col("n") < least, near).when(F.col("n") < least + tau, F.concat(near, far)).otherwise(far)
    keys = whole.select("sig", "node", F.col("own").alias("was"), "sketch", "rest", F.explode(found).alias("k"))
    return keys.select(F.xxhash64("sig", "k.key").alias("sig"), "node", (F.col("was") & F.col("k.own")).alias("own"), "sketch", F.col("k.place").alias("place"), F.col("k.long").alias("long"), "rest")


def line_classes(docs: DataFrame, tau: int = TAU, fuzzy: int = FUZZY) -> tuple[DataFrame, DataFrame | None]:
    """Occurrences (doc_id, th, pos, node, check, blank), and (node, check, label) of lines linked with different ones, if
    any; label is one of the class's nodes."""
    lines = _lines(docs)
    found = cut(lines.select("doc_id", "th", "pos", *_hash(), (~F.col("line").rlike(r"[^\x20\t\r\x0b\x0c]")).alias("blank")))
    distinct = lines.where(F.length("line") >= min(SHORT, fuzzy)).select(F.xxhash64("line").alias("node"), "line").groupBy("node").agg(F.first("line").alias("line"))
    distinct = cut(distinct.withColumns({"n": F.length("line"), "ascii": F.length("line") == F.octet_length("line")}))
    rows = line_rows(distinct.where(F.col("n") >= fuzzy), tau).withColumn("place", F.lit(0))
    if tau:
        brief = distinct.where(F.col("n").between(SHORT, fuzzy)).select("node", F.explode(near_keys(F.col("line"), 1)).alias("k"))
        rows = rows.unionByName(brief.select("node", "k.*", F.lit(None).cast("int").alias("place")))
    rows = cut(rows, "none")  # read twice; hashes don't compress
    keys = rows.groupBy("key").agg(F.min("node").alias("lo"), F.max("node").alias("hi"), F.count("*").alias("n"), F.max(F.col("own").cast("int")).alias("own"))
    shared = cut(keys.where("lo <> hi and own = 1").select("key", "lo", "hi", "n"))
    none = F.lit(None).cast("int")
    two = shared.where("n = 2").select(F.col("key").alias("sig"), F.explode(F.array("lo", "hi")).alias("node"), F.lit(True).alias("own"), none.alias("place"))
    many = shared.where("n > 2").select("key")
    groups = cut(two.unionByName(rows.join(small(many), "key").select(F.col("key").alias("sig"), "node", "own", "place")))
    release(rows, shared)
    wanted = small(groups.select("node").distinct())
    texts = cut(distinct.join(wanted, "node").select("node", "line", F.xxhash64("line", F.lit(1)).alias("check"), sketch(F.col("line")).alias("sketch")))
    release(distinct)
    groups = groups.join(texts.select("node", "sketch"), "node").withColumns({"long": none, "rest": F.lit(None).cast("string")})

    near = lambda a, b: sketches_near(a, b, tau, fuzzy)
    labels = link(groups, lambda pairs: edit_linked(pairs, texts, tau, fuzzy), near, lambda rows: finer(rows, texts, tau), F.col("place").isNotNull())
    if labels is None:
        return found, None
    labels = labels.unionByName(labels.select(F.col("label").alias("node"), "label")).distinct()
    return found, labels.join(texts.select("node", "check"), "node")


def dropped_lines(docs: DataFrame, tau: int = TAU, fuzzy: int = FUZZY) -> DataFrame:
    """(doc_id, th, n_lines, dropped): for each document with a text the numbers of the lines that go, in order."""
    found, labels = line_classes(docs, tau, fuzzy)
    first = found.where("not blank").groupBy("node", "check").agg(F.min(F.struct("doc_id", "th", "pos")).alias("first"))
    if labels is not None:
        first = first.join(labels, ["node", "check"], "left").withColumn("apart", F.when(F.col("label").isNull(), F.col("check"))).withColumn("label", F.coalesce("label", "node"))
        best = first.groupBy("label", "apart").agg(F.min("first").alias("kept"))
        named = best.select(F.col("label").alias("l"), F.col("apart").alias("a"), "kept")
        first = first.join(named, (F.col("label") == F.col("l")) & F.col("apart").eqNullSafe(F.col("a"))).select("node", "check", F.col("kept").alias("first"))
    named = first.select(F.col("node").alias("of"), F.col("check").alias("of_check"), "first")
    judged = found.join(named, (F.col("node") == F.col("of")) & (F.col("check") == F.col("of_check")) & ~F.col("blank"), "left")
    goes = F.col("first").isNotNull() & ~F.struct("doc_id", "th", "pos").eqNullSafe(F.col("first"))
    return judged.groupBy("doc_id", "th").agg((F.max("pos") + 1).cast("long").alias("n_lines"), F.array_sort(F.collect_set(F.when(goes, F.col("pos")))).alias("dropped"))


def dedup_lines(docs: DataFrame, tau: int = TAU, fuzzy: int = FUZZY) -> DataFrame:
    """docs with dropped (line numbers) and the text without those lines; a text all of whose lines go is ""."""
    gone = dropped_lines(docs.select("doc_id", "text"), tau, fuzzy).where("size(dropped) > 0")
    gone = small(gone.select(F.col("doc_id").alias("_id"), F.col("th").alias("_th"), "dropped"))
    out = docs.join(gone, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_th")), "left")
    # numbers of the lines that stay, looked up one by one in the lines, which are split once
    stay = lambda ls: F.array_except(F.sequence(F.lit(0), F.size(ls) - 1), F.col("dropped"))
    kept = _let(F.split("text", "\n", -1), lambda ls: F.array_join(F.transform(stay(ls), lambda i: F.get(ls, i)), "\n"))
    text = F.when(F.col("dropped").isNull(), F.col("text")).otherwise(kept)
    return out.select(*[text.alias("text") if c == "text" else docs[c] for c in docs.columns], F.coalesce("dropped", F.array().cast("array<int>")).alias("dropped"))
