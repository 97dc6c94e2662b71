"""Language identification by cross-parsing entropy over suffix automata.

Method. The labelled texts of a language make one suffix automaton. A text is parsed against it
greedily: each phrase is the longest match that occurs in the language's text, and a character
that cannot extend it starts the next one. ``phrases * log2(size of the language's text) /
characters`` estimates the cross entropy in bits; the language with the smallest wins.

Transitions of all automata lie in one array: those of a state are displaced to where its slots are
free and each says whose it is, so memory follows the number of transitions, not the alphabet.
Thousands of blocks of ``BLOCK`` characters advance together by array operations. A block starts in
the state that the ``WARM_UP`` characters before it lead to; where the block before ends in another
state, it is parsed again from that one, until all blocks fit together, which is the parse of the
whole text. Every character of every text is parsed.

A language is learnt from whole labelled texts: at most ``PARTS`` different ones, those with the smallest
hashes of the texts of up to ``ROW_CHARS`` characters, then longer ones, shortest first, as long as all have
at most ``PARTS * ROW_CHARS`` characters (but one text in any case). These bounds are the only sample.

Defined cases: null texts and texts without a letter (Unicode category L) are ``und`` with score 0;
with no labelled text at all every text is ``und``; ties go to the smaller label; null labels teach
nothing; other columns are ignored; repeated rows get equal rows. More than ``MOST_LANGUAGES`` labels raise
an error: every task holds all automata.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from docscreen.llm.common import cut_lineage, held_out, map_batches, read

PARTS = 40
ROW_CHARS = 2000
MOST_LANGUAGES = 500
BLOCK = 256
WARM_UP = 48
UNKNOWN = "und"
#: Characters times languages parsed at once.
_CELLS_AT_ONCE = 1 << 22

_LETTER = regex.compile(r"\p{L}")
_NOT_LETTERS = regex.compile(r"[^\p{L}\p{M}]+")


def folded(text: str) -> str:
    """Lower-case letters with their marks; everything between them is one space."""
    return _NOT_LETTERS.sub(" ", text.lower())


def suffix_automaton(text: str) -> list[dict[str, int]]:
    """Transitions of the states of all substrings of ``text``; state 0 is the empty one."""
    go: list[dict[str, int]] = [{}]
    link, size = [-1], [0]
    last = 0
    for c in text:
        new = len(go)
        go.append({})
        size.append(size[last] + 1)
        link.append(0)
        p = last
        while p >= 0 and c not in go[p]:
            go[p][c] = new
            p = link[p]
        if p >= 0:
            q = go[p][c]
            if size[p] + 1 == size[q]:
                link[new] = q
            else:
                copy = len(go)
                go.append(dict(go[q]))
                size.append(size[p] + 1)
                link.append(link[q])
                while p >= 0 and go[p].get(c) == q:
                    go[p][c] = copy
                    p = link[p]
                link[q] = link[new] = copy
        last = new
    return go


class _Slots:
    """Transitions of many states in one array, at ``place[state] + symbol``."""

    def __init__(self, width: int) -> None:
        self.width, self.place = width, []
        self.taken = bytearray(4 * width + 8)
        self.free = width  # so that no place is negative
        self.entries: list[tuple[int, int, int]] = []

    def add(self, edges: list[tuple[int, int]]) -> None:
        """The next state, with its (symbol, state) transitions."""
        state = len(self.place)
        if not edges:
            self.place.append(0)
            return
        low = min(s for s, _ in edges)
        at = self.free
        while any(self.taken[at - low + s] for s, _ in edges):
            at += 1
            if at + self.width >= len(self.taken):
                self.taken.extend(bytes(len(self.taken)))
        for s, to in edges:
            self.taken[at - low + s] = 1
            self.entries.append((at - low + s, state, to))
        self.place.append(at - low)
        while self.taken[self.free]:
            self.free += 1
        if self.free + 2 * self.width >= len(self.taken):
            self.taken.extend(bytes(len(self.taken)))

    def arrays(self) -> tuple[np.ndarray, np.ndarray]:
        """(place of a state, owner << 32 | next state of a slot; an owner of -1 for free slots)."""
        slots = np.full(len(self.taken) + self.width, -1, dtype=np.int64)
        if self.entries:
            at, owner, to = np.array(self.entries, dtype=np.int64).T
            slots[at] = (owner << 32) | to
        return np.array(self.place, dtype=np.int64), slots


class Parser:
    """Phrase counts of texts against the texts of all languages."""

    def __init__(self, texts: dict[str, str]) -> None:
        self.names = sorted(texts)
        letters = sorted(set("".join(texts.values())))
        #: Symbol 0 is a character that no language has.
        self.symbol = np.zeros(0x110000, dtype=np.int32)
        self.symbol[[ord(c) for c in letters]] = np.arange(1, len(letters) + 1)
        width = len(letters) + 1
        slots, roots = _Slots(width), []
        for name in self.names:
            go = suffix_automaton(texts[name])
            base = len(slots.place)
            roots.append(base)
            for edges in go:
                slots.add([(int(self.symbol[ord(c)]), base + to) for c, to in edges.items()])
        self.roots = np.array(roots, dtype=np.int64)
        self.place, self.slots = slots.arrays()
        # Where a character leads from each root, or the root itself.
        self.fresh = np.repeat(self.roots[:, None], width, axis=1)
        for i, root in enumerate(roots):
            own = self.slots[self.place[root] + np.arange(width)]
            self.fresh[i] = np.where(own >> 32 == root, own & 0xFFFFFFFF, root)
        self.log_size = np.array([np.log2(max(len(texts[n]), 2)) for n in self.names])

    def _advance(self, lang: np.ndarray, state: np.ndarray, symbols: np.ndarray, sizes: np.ndarray
                 ) -> tuple[np.ndarray, np.ndarray]:
        """End states and numbers of phrases that end on the way, for columns of ``symbols``.

        ``sizes`` (symbols of a column) must not rise; ``lang`` and ``state`` give each column's start.
        """
        state, root = state.copy(), self.roots[lang]
        count = np.zeros(len(state), dtype=np.int64)
        longest = int(sizes[0]) if len(sizes) else 0
        # Columns that are still going are the first ones.
        going = np.searchsorted(-sizes, -np.arange(longest), side="left")
        for i in range(longest):
            n = int(going[i])
            own, now = state[:n], symbols[i, :n]
            slot = self.slots[self.place[own] + now]
            on = (slot >> 32) == own
            fresh = self.fresh[lang[:n], now]
            # A phrase in progress ends; a character that the language lacks is one of its own.
            ended = ~on
            count[:n] += (ended & (own != root[:n])).astype(np.int64) + (ended & (fresh == root[:n]))
            state[:n] = np.where(on, slot & 0xFFFFFFFF, fresh)
        return state, count

    def phrases(self, texts: list[str]) -> np.ndarray:
        """(texts, languages) numbers of phrases."""
        languages = len(self.names)
        out = np.zeros((len(texts), languages), dtype=np.int64)
        most = max(BLOCK, _CELLS_AT_ONCE // max(1, languages))
        lo = 0
        while lo < len(texts):
            if len(texts[lo]) > most:  # alone, and in portions that hand on their states
                states = self.roots[None, :]
                for at in range(0, len(texts[lo]), most):
                    count, states = self._parsed([texts[lo][at:at + most]], states)
                    out[lo] += count[0]
                out[lo] += states[0] != self.roots
                lo += 1
                continue
            hi, size = lo, 0
            while hi < len(texts) and size + len(texts[hi]) <= most:
                size += len(texts[hi])
                hi += 1
            count, states = self._parsed(texts[lo:hi], np.repeat(self.roots[None, :], hi - lo, axis=0))
            out[lo:hi] = count + (states != self.roots)  # the end of a text ends its last phrase
            lo = hi
        return out

    def _parsed(self, texts: list[str], states: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(texts, languages) numbers of phrases that end within, and states at the end."""
        sizes = np.array([len(t) for t in texts], dtype=np.int64)
        languages = len(self.names)
        out, ends = np.zeros((len(texts), languages), dtype=np.int64), states.copy()
        points = self.symbol[np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)]
        begin = np.cumsum(sizes) - sizes
        blocks = -(-sizes // BLOCK)
        text = np.repeat(np.arange(len(texts)), blocks)
        if not len(text):
            return out, ends
        inside = np.arange(len(text)) - np.repeat(np.cumsum(blocks) - blocks, blocks)
        start = begin[text] + inside * BLOCK
        size = np.minimum(BLOCK, sizes[text] - inside * BLOCK)
        points = np.concatenate([points, np.zeros(BLOCK, dtype=points.dtype)])

        def run(lang: np.ndarray, state: np.ndarray, at: np.ndarray, length: np.ndarray):
            order = np.argsort(-length, kind="stable")
            symbols = np.ascontiguousarray(points[at[order][:, None] + np.arange(int(length.max()))].T)
            end, count = self._advance(lang[order], state[order], symbols, length[order])
            back = np.empty_like(order)
            back[order] = np.arange(len(order))
            return end[back], count[back]

        # One column for each block and language.
        lane = np.tile(np.arange(len(text)), languages)
        lang = np.repeat(np.arange(languages), len(text))
        assumed = states[text[lane], lang]
        later = np.flatnonzero(inside[lane] > 0)
        if len(later):
            warm = np.full(len(later), WARM_UP, dtype=np.int64)
            assumed[later] = run(lang[later], self.roots[lang[later]], start[lane[later]] - WARM_UP, warm)[0]
        end, count = run(lang, assumed, start[lane], size[lane])
        while len(later):
            # The block before stands one column earlier.
            later = later[assumed[later] != end[later - 1]]
            if not len(later):
                break
            assumed[later] = end[later - 1]
            end[later], count[later] = run(lang[later], assumed[later], start[lane[later]], size[lane[later]])
            later = later[later + 1 < len(lane)] + 1
            later = later[inside[lane[later]] > 0]
        np.add.at(out, (text[lane], lang), count)
        last = np.flatnonzero(inside[lane] == blocks[text[lane]] - 1)
        ends[text[lane[last]], lang[last]] = end[last]
        return out, ends

    def predict(self, texts: list[str | None]) -> list[tuple[str, float]]:
        out: list[tuple[str, float]] = [(UNKNOWN, 0.0)] * len(texts)
        known = [i for i, t in enumerate(texts) if t and self.names and _LETTER.search(t)]
        clean = [folded(texts[i]) for i in known]
        if known:
            bits = self.phrases(clean) * self.log_size
            best = bits.argmin(axis=1)
            # Share of the winner if each language counts by its inverse entropy.
            inverse = 1.0 / np.maximum(bits, 1e-9)
            score = inverse.max(axis=1) / inverse.sum(axis=1)
            for i, b, s in zip(known, best.tolist(), score.tolist(), strict=True):
                out[i] = (self.names[b], s)
        return out


_built: dict[tuple, Parser] = {}


def parser(texts: dict[str, str]) -> Parser:
    """The parser of a worker, built once."""
    key = tuple(sorted(texts.items()))
    if key not in _built:
        _built.clear()
        _built[key] = Parser(texts)
    return _built[key]


def learn(docs: DataFrame, parts: int = PARTS, row_chars: int = ROW_CHARS) -> dict[str, str]:
    """The bounded text of each language, from rows that are not held out."""
    own = (docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
           .select("lang", F.xxhash64("text").alias("h"), F.greatest(F.length("text"), F.lit(row_chars)).alias("size"),
                   "text"))
    # Equal texts have equal hashes and are one before any is chosen.
    keys = cut_lineage(own.select("lang", "h", "size").distinct())
    # Texts of up to row_chars characters count as one size, and a threshold on the hash keeps about
    # four times the parts wanted of them. The exact choice is made among those.
    sizes = cut_lineage(keys.groupBy("lang").agg(F.count_if(F.col("size") == row_chars).alias("n")))
    languages = sizes.count()
    if languages > MOST_LANGUAGES:
        raise ValueError(f"{languages} languages: at most {MOST_LANGUAGES} can be told apart at once")
    share = F.least(F.lit(1.0), F.lit(4.0 * parts) / F.greatest("n", F.lit(1)))
    fits = (F.col("size") > row_chars) | (F.pmod("h", F.lit(1 << 30)) < share * (1 << 30))
    # Longer texts are only wanted where the others are few, and then the shortest of them.
    wanted = fits & ((F.col("size") == row_chars) | (F.col("n") < parts))
    few = keys.join(F.broadcast(sizes), "lang").filter(wanted).select("lang", "h", "size")  # MOST_LANGUAGES rows at most
    part = F.pmod("h", F.lit(64))
    for group in (["lang", part], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*group).orderBy("size", "h"))
        few = few.withColumn("r", rank).filter(F.col("r") <= parts)
    total = F.sum("size").over(Window.partitionBy("lang").orderBy("r").rowsBetween(Window.unboundedPreceding, 0))
    chosen = few.withColumn("total", total).filter((F.col("r") == 1) | (F.col("total") <= parts * row_chars))
    cut = (own.select("lang", "h", "text").join(F.broadcast(chosen.select("lang", "h", "r")), ["lang", "h"])
           .groupBy("lang", "r").agg(F.min("text").alias("text")))
    texts: dict[str, str] = {}
    for row in cut.orderBy("lang", "r").collect():  # languages * (parts * row_chars) characters
        texts[row.lang] = texts.get(row.lang, " ") + folded(row.text) + " "
    return texts


def identify(docs: DataFrame, texts: dict[str, str] | None = None) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    known = learn(docs) if texts is None else texts
    shared = docs.sparkSession.sparkContext.broadcast(known)
    id_type = docs.schema["doc_id"].dataType

    def work(batch: pa.RecordBatch) -> list:
        made = parser(shared.value).predict(batch.column(2).to_pylist())
        return [batch.column(0), batch.column(1), [n for n, _ in made], [s for _, s in made]]

    return map_batches(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), work, T.StructType([
        T.StructField("doc_id", id_type), T.StructField("held_out", T.BooleanType()),
        T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())]))


def known_only(docs: DataFrame) -> DataFrame:
    """The documents that have a language, all columns as they were, in one pass over the texts."""
    shared = docs.sparkSession.sparkContext.broadcast(learn(docs))
    at = docs.columns.index("text")

    def work(batch: pa.RecordBatch) -> list:
        made = parser(shared.value).predict(batch.column(at).to_pylist())
        return batch.filter(pa.array([n != UNKNOWN for n, _ in made])).columns

    return map_batches(docs, work, docs.schema)


def query(spark, sf_dir: str) -> DataFrame:
    return identify(read(spark, sf_dir, "documents"))
