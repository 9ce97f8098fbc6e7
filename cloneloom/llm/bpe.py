"""BPE encoding and decoding of whole texts by a trie of distinct words that shares the work of common prefixes.

A byte-pair encoding is prefix-stable: for each prefix of a word there is exactly one token that can end its encoding, the
one that is compatible with the last token of what it leaves over. So a node of the trie needs only its last token,
and every word below a node reuses it. Two tokens are compatible if encoding their joined symbols by plain merging gives
the two back; those results are kept by pair. The last symbol of a word carries the end-of-word mark and has no node.

Distinct words are visited in order, which is depth-first, and only the path to the node at hand is held: its states, and
for each the place in a second trie, that of all tokens, whose suffix links (Aho and Corasick, 1975) list the tokens that a
prefix can end with, longest first. So time and memory grow with a word's length, not with its square. The words already
encoded, the pairs and the steps in the second trie are bounded by numbers of entries (CACHE_WORDS, MAX_PAIRS, MAX_STEPS) and
emptied when a task ends, for workers serve other stages afterwards.

The tokenizer file (JSON of the public `tokenizers` library) is read by the driver from the path given and sent to the
executors by broadcast: its size is that of the vocabulary, whatever the input. Tasks keep no state that matters: a lost
executor costs its tasks only.

Defined results: null and empty texts have no tokens and decode to ""; very long texts and words are encoded whole; repeated
rows are encoded each on their own; null ids and extra columns pass through, but for those named like a result, which
the result replaces; an empty table gives no rows.
"""

from __future__ import annotations

import gc
import hashlib
import json
import unicodedata

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from .common import ship, tidy

#: Words and chunks kept, if they have at most so many characters; compatible pairs; steps in the trie of tokens.
CACHE_WORDS, CACHED_LENGTH = 120_000, 10
MAX_PAIRS, MAX_STEPS = 120_000, 150_000
#: Texts are encoded so many, or about so many bytes of them, at a time.
BATCH_ROWS, BATCH_BYTES = 256, 1_000_000
#: What the normalizer's \s+ matches; Python's own notion of space has U+001C to U+001F besides.
SPACE = regex.compile("[\t-\r \x85\xa0  -     　]+")
ODD_SPACE = regex.compile("[\x1c-\x1f]")


def byte_symbols() -> list[str]:
    """The printable character that stands for each byte in byte-level vocabularies."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(shown)]
    table = {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(rest)}
    return [table[b] for b in range(256)]


class TrieBPE:
    """Encoder and decoder for a byte-level BPE with an end-of-word suffix."""

    def __init__(self, spec: str):
        j = json.loads(spec)
        model = j["model"]
        self.suffix: str = model["end_of_word_suffix"] or ""
        merges = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
        ids: dict[str, int] = model["vocab"]
        self.merges = {(ids[a], ids[b]): (r, ids[a + b]) for r, (a, b) in enumerate(merges)}
        self.special = {t["content"]: t["id"] for t in j["added_tokens"]}
        #: each token by its id as text
        self.token = {str(i): t for t, i in ids.items()} | {str(i): t for t, i in self.special.items()}
        split = next(p for p in j["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")["pattern"]["Regex"]
        self.words = regex.compile(split)
        self.specials = regex.compile("(" + "|".join(map(regex.escape, self.special)) + ")") if self.special else None
        self.symbols = byte_symbols()
        #: symbols of each token that merging can make
        self.parts: dict[int, tuple[int, ...]] = {}
        for s in {s for b in self.symbols for s in (b, b + self.suffix)}:
            if s in ids:
                self.parts[ids[s]] = (ids[s],)
        #: rank of the merge that makes a token, -1 for symbols, and what it joins
        self.made = {t: -1 for t in self.parts}
        self.halves: dict[int, tuple[int, int]] = {}
        for r, (a, b) in enumerate(merges):
            self.made.setdefault(ids[a + b], r)
            self.halves.setdefault(ids[a + b], (ids[a], ids[b]))
            left, right = self.parts.get(ids[a]), self.parts.get(ids[b])
            if left and right:
                self.parts.setdefault(ids[a + b], left + right)
        self.char = {ids[x]: x for x in self.symbols} | {ids[x + self.suffix]: chr(0xE000 + i) for i, x in enumerate(self.symbols)}
        #: each token's id as text, by id
        self.name = [""] * (1 + max(map(int, self.token)))
        for i in self.token:
            self.name[int(i)] = i
        self.sizes = {t: len(p) for t, p in self.parts.items()}
        self.plant()
        self.forget()

    def forget(self) -> None:
        """Empty all that grows with the texts."""
        #: whether two tokens are compatible, by both ids in one number
        self.pairs: dict[int, bool] = {}
        #: ids of white-space chunks and of words, joined by spaces
        self.cache: dict[str, str] = {}
        self.encoded: dict[str, str] = {}
        #: from a place in the trie of tokens and a symbol to the next place
        self.steps: dict[int, int] = {}

    def plant(self) -> None:
        """The trie of the tokens that merging makes, by numbered nodes. Symbols are numbered by their bytes, those that end a
        word 256 higher."""
        number = {x: i for i, x in enumerate(self.symbols)} | {chr(0xE000 + i): 256 + i for i in range(256)}
        #: a node's child by node and symbol in one number; a node's length; its token, if it is one
        self.child: dict[int, int] = {}
        self.depth, self.end = [0], [-1]
        for t, p in self.parts.items():
            if len(p) > 1 and self.merge(p) != [t]:
                continue
            at = 0
            for x in p:
                key = at << 9 | number[self.char[x]]
                if key not in self.child:
                    self.child[key] = len(self.depth)
                    self.depth.append(self.depth[at] + 1)
                    self.end.append(-1)
                at = self.child[key]
            self.end[at] = t
        #: the longest other node that a node ends with; the longest token that it ends with, itself included, and without
        self.suffix_of, self.first, self.shorter = ([0] * len(self.depth) for _ in range(3))
        for key, at in sorted(self.child.items(), key=lambda x: self.depth[x[1]]):
            if key >> 9:
                self.suffix_of[at] = self.step(self.suffix_of[key >> 9], key & 511)
            self.shorter[at] = self.first[self.suffix_of[at]]
            self.first[at] = at if self.end[at] >= 0 else self.shorter[at]

    def step(self, at: int, symbol: int) -> int:
        """The longest node that the text of a node and one more symbol end with."""
        while (to := self.child.get(at << 9 | symbol)) is None and at:
            at = self.suffix_of[at]
        return to or 0

    def merge(self, symbols) -> list[int]:
        """The plain definition: merge the leftmost pair of lowest rank until none is left."""
        out = list(symbols)
        while len(out) > 1:
            rank, at = min((self.merges[p][0], i) if (p := (out[i], out[i + 1])) in self.merges else (1 << 30, i) for i in range(len(out) - 1))
            if rank == 1 << 30:
                break
            out[at : at + 2] = [self.merges[out[at], out[at + 1]][1]]
        return out

    def compatible(self, a: int, b: int) -> bool:
        """Whether plain merging of a's and b's symbols gives a, b: no merge across the border comes before the merges
        inside that would have to have happened by then. Undoes those, latest first, and looks at the new border."""
        known = self.pairs.get(a << 32 | b)
        if known is None:
            if len(self.pairs) >= MAX_PAIRS:
                self.pairs.clear()
            known = self.pairs[a << 32 | b] = self._compatible(a, b)
        return known

    def _compatible(self, a: int, b: int) -> bool:
        merges, made, halves = self.merges, self.made, self.halves
        limit = 1 << 30  # the border's merge counts if its rank is under this
        while True:
            m = merges.get((a, b))
            if m is not None and m[0] < limit:
                return False
            ra, rb = made[a], made[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                limit, a = ra, halves[a][1]
            else:  # the left half's border merges come first at equal rank
                limit, b = rb + 1, halves[b][0]

    def encode_words(self, words) -> dict[str, str]:
        """Token ids of each distinct word, joined by spaces, the trie's nodes visited depth-first: a word starts from the
        deepest node that it shares with the word before it."""
        steps, pairs, sizes, name = self.steps, self.pairs, self.sizes, self.name
        first, shorter, depth, end = self.first, self.shorter, self.depth, self.end
        out: dict[str, str] = {}
        state, place, last = [-1], [0], b""  # of each prefix of the path, the empty one included
        for w in sorted(words):
            path = w.encode("utf-8", "surrogatepass")
            shared = min(len(state), len(path)) - 1  # the last symbol of a word has no node
            at = 0
            while at < shared and path[at] == last[at]:
                at += 1
            del state[at + 1 :], place[at + 1 :]
            here, last = place[at], path
            for symbol in (*path[at:-1], path[-1] + 256):
                at += 1
                key = here << 9 | symbol
                here = steps.get(key)
                if here is None:
                    if len(steps) >= MAX_STEPS:
                        steps.clear()
                    here = steps[key] = self.step(key >> 9, symbol)
                node = first[here]
                while True:
                    t, n = end[node], depth[node]
                    if n == at or n == 1:
                        break
                    before = state[at - n]
                    fits = pairs.get(before << 32 | t)
                    if fits is None:
                        fits = self.compatible(before, t)
                    if fits:
                        break
                    node = shorter[node]
                state.append(t)
                place.append(here)
            t = state.pop()
            place.pop()
            tokens = [name[t]]
            at -= sizes[t]
            while at:
                t = state[at]
                tokens.append(name[t])
                at -= sizes[t]
            tokens.reverse()
            out[w] = " ".join(tokens)
        return out

    def normal(self, text: str) -> str:
        if not text.isascii():
            text = unicodedata.normalize("NFC", text)
            if "Σ" in text:  # the final form of sigma isn't used
                return "".join(c.lower() for c in text)
        return text.lower()

    def chunks(self, text: str) -> list[str]:
        """text between white space, and special tokens on their own; no word crosses such a border."""
        if ODD_SPACE.search(text):
            cut = lambda t: [x for x in SPACE.split(t) if x]
        else:
            cut = str.split
        if self.specials is None or not self.specials.search(text):
            return cut(text)
        return [c for part in self.specials.split(text) for c in ([part] if part in self.special else cut(part))]

    def learn(self, chunks) -> None:
        """Put unseen chunks into the cache: their ids, joined by spaces."""
        special, normal, words = self.special, self.normal, self.words.findall
        fresh = {}
        for c in chunks:
            w = normal(c)
            fresh[c] = [w] if w.isalpha() and w.isascii() else [] if c in special else words(w)
        if len(self.encoded) > CACHE_WORDS:
            self.encoded.clear()
        cache, encoded = self.cache, self.encoded
        ids = self.encode_words({w for ws in fresh.values() for w in ws if w not in encoded})
        encoded.update((w, got) for w, got in ids.items() if len(w) <= CACHED_LENGTH)
        for c, ws in fresh.items():
            if len(ws) == 1:
                cache[c] = encoded.get(ws[0]) or ids[ws[0]]
            elif c in special:
                cache[c] = str(special[c])
            else:
                cache[c] = " ".join([encoded.get(w) or ids[w] for w in ws])

    def encode_batch(self, texts) -> list[tuple[str, int, str]]:
        """(ids joined by spaces, their number, decoded text) of each text."""
        cut = [self.chunks(t or "") for t in texts]
        if len(self.cache) > CACHE_WORDS:
            self.cache.clear()
        cache, token = self.cache, self.token.__getitem__
        fresh = set().union(*cut).difference(cache)
        self.learn(fresh)
        out = []
        for chunks in cut:
            ids = list(map(cache.__getitem__, chunks))
            joined = " ".join(filter(None, ids) if "" in ids else ids)
            each = joined.split()
            out.append((joined, len(each), " ".join(map(token, each))))
        for c in fresh:  # long words seldom come again
            if len(c) > CACHED_LENGTH:
                del cache[c]
        return out


_LOADED: dict[str, TrieBPE] = {}


def _model(spec: str) -> TrieBPE:
    key = hashlib.sha256(spec.encode()).hexdigest()
    if key not in _LOADED:
        _LOADED.clear()
        _LOADED[key] = TrieBPE(spec)
    return _LOADED[key]


def encode_documents(docs: DataFrame, tokenizer_path: str, text_col: str = "text", ids: bool = False) -> DataFrame:
    """docs without the text, plus n_tokens, ids_sha256, decoded_sha256 and, if wanted, ids (array<int>)."""
    with open(tokenizer_path, encoding="utf-8") as f:
        spec = f.read()
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(spec)
    added = [T.StructField("n_tokens", T.LongType()), T.StructField("ids_sha256", T.StringType()), T.StructField("decoded_sha256", T.StringType())]
    added += [T.StructField("ids", T.ArrayType(T.IntegerType()))] * ids
    names = {f.name for f in added}
    kept = [c for c in docs.columns if c != text_col and c not in names]
    schema = T.StructType([docs.schema[c] for c in kept] + added)

    def encoded(model, batches):
        sha = lambda s: hashlib.sha256(s.encode("utf-8", "surrogatepass")).hexdigest()
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("_text"))
            step = max(1, min(BATCH_ROWS, BATCH_BYTES * batch.num_rows // max(1, texts.nbytes)))
            for at in range(0, batch.num_rows, step):
                part = batch.slice(at, step)
                got = model.encode_batch(texts.slice(at, step).to_pylist())
                cols = [part.column(i) for i in range(len(kept))]
                cols += [pa.array([g[1] for g in got], pa.int64()), pa.array([sha(g[0]) for g in got]), pa.array([sha(g[2]) for g in got])]
                if ids:
                    cols.append(pa.array([[int(x) for x in g[0].split()] for g in got], pa.list_(pa.int32())))
                yield pa.RecordBatch.from_arrays(cols, names=[*kept, *[f.name for f in added]])

    def run(batches):
        model = _model(shared.value)
        gc.disable()  # the tables hold no cycles, and scanning them takes long
        try:
            yield from encoded(model, batches)
        finally:
            model.forget()
            gc.enable()

    return docs.select(*kept, docs[text_col].alias("_text")).mapInArrow(tidy(run), schema)
