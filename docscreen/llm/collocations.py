"""Phrase collocations counted in quotient filters.

Method. Words that occur often enough in their language get dense ids, numbered over all languages
together, so an id says its language too. An n-gram is its word ids packed into n * bits bits. An
invertible permutation of that bit width spreads the packed values evenly; its leading bits are the
quotient, all other bits the remainder, and since the whole remainder is kept, a filter is a
lossless counter. Each task counts its part of the texts into such filters, cut into blocks by the
leading bits; a block holds the run lengths of its quotients in unary, remainders of as few bytes
as they need and counts of one byte (larger ones follow at the end). Filters of a block are merged
in sorted order wherever they come from. Permuted values are even and every filter has one entry
for a value, so neither a frequent phrase nor a large language makes a block large.

Lengths are counted one after the other: a phrase can only be frequent if both of its parts that
are one word shorter are, and the leading bits of those parts, a bitmap as the occupied bits of a
quotient filter and sized by their number, say which places of a text are worth counting. The
bitmap may let through more than needed and never less, so counts are exact.

The dictionary of frequent words is broadcast if its bytes are below ``DICTIONARY_BYTES``, else
words meet it in a shuffled join, text by text. At most 2^25 frequent words of all languages
together can be numbered (five ids are packed into 128 bits at most); more raise an error.

Defined cases: a null text has no words, a null language is ``und``; texts, rows and ids may repeat
and each row counts; a text of any length is cut whole; other columns are ignored; an empty table
gives an empty result; equal scores of two cuts go to the shorter first part, equal scores of two
phrases to the more frequent one and then to the smaller one in byte order.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docscreen.llm.common import cut_lineage, map_batches, read, runs
from docscreen.llm.words import chunks

MIN_COUNT = 100
LONGEST = 5
TOP = 2000
#: Largest dictionary of frequent words that is broadcast; beyond it words are joined.
DICTIONARY_BYTES = 128 << 20
#: Frequent words that can be numbered.
MAX_WORD_BITS = 25
#: Phrase occurrences of a task behind one filter.
FILTER_PLACES = 1 << 22
#: Occurrences of all tasks behind one block, and the most blocks.
BLOCK_PLACES, MOST_BLOCK_BITS = 1 << 17, 20
#: Leading bits of a permuted value that travel beside it, and the most a bitmap is addressed by.
TOP_BITS, BITMAP_BITS = 40, 28
#: UTF-8 bytes of texts cut at once.
CUT_BYTES = 4 << 20
#: Subgroups in which rows of a language are ranked first.
_RANK_PARTS = 16

_BREAKS = b".,;:!?\n\x0b\x0c\r"
#: Space and tab become a space, ends of pieces a line feed, A-Z lower case.
_BYTES = bytes(32 if b in b" \t" else 10 if b in _BREAKS else b + 32 if 65 <= b <= 90 else b for b in range(256))
_U = np.uint64
_ODD, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
_MARKS = (0x632BE59BD9B4E019, 0xD1342543DE82EF95)


# -- words ---------------------------------------------------------------------------------------

def cut_words(texts: list[bytes | None]) -> tuple[pa.Array, np.ndarray]:
    """Words of all texts, and whether each one opens a piece."""
    buffer = b"\n" + b"\n".join(t or b"" for t in texts).translate(_BYTES) + b"\n"
    data = np.frombuffer(buffer, dtype=np.uint8)
    inside = (data != 32) & (data != 10)
    edges = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    start, end = edges[::2], edges[1::2]
    ends = np.cumsum(data == 10)
    opens = np.ones(len(start), dtype=bool)
    opens[1:] = ends[start[1:]] != ends[end[:-1] - 1]
    offsets = np.zeros(len(start) + 1, dtype=np.int64)
    np.cumsum(end - start, out=offsets[1:])
    return pa.Array.from_buffers(pa.large_binary(), len(start), [
        None, pa.py_buffer(offsets), pa.py_buffer(data[inside])]), opens


def _by_language(batch: pa.RecordBatch) -> Iterator[tuple[str, list[bytes | None]]]:
    """(language, texts) of a batch with the columns lang and text, in portions of CUT_BYTES."""
    langs = batch.column(0).dictionary_encode()
    at = langs.indices.to_numpy(zero_copy_only=False)
    for i, lang in enumerate(langs.dictionary.to_pylist()):
        texts = batch.column(1).take(pa.array(np.flatnonzero(at == i))).to_pylist()
        for lo, hi in chunks(texts, CUT_BYTES):
            yield lang, texts[lo:hi]


def _sources(docs: DataFrame) -> DataFrame:
    return docs.select(F.coalesce("lang", F.lit("und")).alias("lang"), F.col("text").cast("binary").alias("text"))


def word_counts(docs: DataFrame) -> DataFrame:
    """lang, word (binary) and n, its occurrences."""
    def work(batch: pa.RecordBatch) -> list | None:
        out = []
        for lang, texts in _by_language(batch):
            found = cut_words(texts)[0].dictionary_encode()
            n = len(found.dictionary)
            out.append((pa.array([lang] * n, pa.string()), found.dictionary.cast(pa.binary()),
                        pa.array(np.bincount(found.indices.to_numpy(), minlength=n))))
        return [pa.concat_arrays(c) for c in zip(*out, strict=True)] if out else None

    return (map_batches(_sources(docs), work, "lang string, word binary, n long")
            .groupBy("lang", "word").agg(F.sum("n").alias("n")))


def numbered(words: DataFrame, buckets: int = 4096) -> DataFrame:
    """``words`` (lang, word, n) plus ``id`` from 1: dense, and the same however rows are dealt."""
    rows = words.withColumn("_bucket", F.pmod(F.xxhash64("lang", "word"), F.lit(buckets)))
    before = Window.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)  # at most ``buckets`` rows
    offsets = rows.groupBy("_bucket").agg(F.count(F.lit(1)).alias("_n")).select(
        "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    within = Window.partitionBy("_bucket").orderBy("lang", "word")
    return (rows.join(F.broadcast(offsets), "_bucket")
            .select("lang", "word", "n", (F.col("_before") + F.row_number().over(within)).cast("int").alias("id")))


# -- texts as word ids ------------------------------------------------------------------------------

def _coded(words: pa.Array, opens: np.ndarray, known: pa.Array, ids: np.ndarray) -> np.ndarray:
    """Ids in order; 0 stands between pieces and for words without an id, never twice in a row."""
    found = words.dictionary_encode()
    at = pc.index_in(found.dictionary.cast(pa.binary()), known).fill_null(-1).to_numpy()
    own = np.append(ids, 0)[at].astype(np.int32) if len(at) else np.zeros(0, dtype=np.int32)
    out = np.zeros(len(opens) + int(opens.sum()), dtype=np.int32)
    out[np.arange(len(opens)) + np.cumsum(opens)] = own[found.indices.to_numpy()] if len(opens) else 0
    keep = out != 0
    keep[1:] |= out[:-1] != 0
    return out[keep]


def coded_texts(docs: DataFrame, dictionary: DataFrame, dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """``ids`` (array<int>): the texts as ids, many texts to a row."""
    size = dictionary.agg(F.sum(F.octet_length("word") + F.octet_length("lang") + 12)).first()[0] or 0
    if size > dictionary_bytes:
        return _coded_by_join(docs, dictionary)
    own: dict[str, tuple[list, list]] = {}
    for row in dictionary.select("lang", "word", "id").collect():  # ``size`` bytes, just checked
        words, ids = own.setdefault(row.lang, ([], []))
        words.append(bytes(row.word))
        ids.append(row.id)
    shared = docs.sparkSession.sparkContext.broadcast(
        {k: (pa.array(w, pa.binary()), np.array(i, dtype=np.int32)) for k, (w, i) in own.items()})
    none = (pa.array([], pa.binary()), np.zeros(0, dtype=np.int32))

    def work(batch: pa.RecordBatch) -> list:
        return [[_coded(*cut_words(texts), *shared.value.get(lang, none)) for lang, texts in _by_language(batch)]]

    return map_batches(_sources(docs), work, "ids array<int>")


def _coded_by_join(docs: DataFrame, dictionary: DataFrame) -> DataFrame:
    """The same with each text's own part of the dictionary, found by a shuffled join."""
    rows = cut_lineage(_sources(docs).withColumn("row", F.monotonically_increasing_id()))

    def list_words(batch: pa.RecordBatch) -> list:
        out = [[], [], []]
        for row, lang, text in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            words = cut_words([text])[0].unique().cast(pa.binary()).to_pylist()
            for column, values in zip(out, ([row] * len(words), [lang] * len(words), words), strict=True):
                column += values
        return out

    met = (map_batches(rows.select("row", "lang", "text"), list_words, "row long, lang string, word binary")
           .join(dictionary, ["lang", "word"])
           .groupBy("row").agg(F.collect_list(F.struct("word", "id")).alias("known")))

    def work(batch: pa.RecordBatch) -> list:
        out = []
        for text, known in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            words = pa.array([k["word"] for k in known or []], pa.binary())
            out.append(_coded(*cut_words([text]), words, np.array([k["id"] for k in known or []], dtype=np.int32)))
        return [out]

    return map_batches(rows.join(met, "row", "left").select("text", "known"), work, "ids array<int>")


# -- packed values and their permutation ------------------------------------------------------------

def pack(ids: np.ndarray, at: np.ndarray, n: int, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(high, low) 64 bits of the n ids from each place of ``at``."""
    high, low = np.zeros(len(at), dtype=_U), np.zeros(len(at), dtype=_U)
    for i in range(n):
        high = (high << _U(bits)) | (low >> _U(64 - bits))
        low = (low << _U(bits)) | ids[at + i].astype(_U)
    return high, low


def unpack(high: np.ndarray, low: np.ndarray, n: int, bits: int) -> np.ndarray:
    out = np.empty((len(low), n), dtype=np.int32)
    for i in reversed(range(n)):
        out[:, i] = (low & _U((1 << bits) - 1)).astype(np.int32)
        low = (low >> _U(bits)) | (high << _U(64 - bits))
        high = high >> _U(bits)
    return out


def _stir(x: np.ndarray, width: int) -> np.ndarray:
    """A bijection of ``width``-bit values: odd factors, and shifts of at least half the width."""
    mask, shift = _U((1 << width) - 1), _U((width + 1) // 2)
    for _ in range(3):
        x = (x * _U(_ODD)) & mask
        x = x ^ (x >> shift)
    return x


def _unstir(x: np.ndarray, width: int) -> np.ndarray:
    mask, shift = _U((1 << width) - 1), _U((width + 1) // 2)
    for _ in range(3):
        x = x ^ (x >> shift)
        x = (x * _U(_INVERSE)) & mask
    return x


def permute(high: np.ndarray, low: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """(leading bits, other bits): all of them lead where ``width`` is at most 64, else 64 do."""
    if width <= 64:
        return _stir(low, width), high
    low = _stir(low, 64)
    high = high ^ (_stir(low ^ _U(_MARKS[0]), 64) >> _U(128 - width))
    return low ^ _stir(high ^ _U(_MARKS[1]), 64), high


def restore(lead: np.ndarray, rest: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Inverse of ``permute``: (high, low)."""
    if width <= 64:
        return rest, _unstir(lead, width)
    low = lead ^ _stir(rest ^ _U(_MARKS[1]), 64)
    return rest ^ (_stir(low ^ _U(_MARKS[0]), 64) >> _U(128 - width)), _unstir(low, 64)


# -- filters ---------------------------------------------------------------------------------------

def summed(lead: np.ndarray, rest: np.ndarray, count: np.ndarray | None, width: int):
    """Sorted distinct entries with the sums of their counts (None: one each)."""
    if width <= 64 and count is None:
        lead = np.sort(lead)
        first, length = runs(lead)
        return lead[first], rest[:len(first)], length
    order = np.argsort(lead, kind="stable") if width <= 64 else np.lexsort((rest, lead))
    lead, rest = lead[order], rest[order]
    first, length = runs(lead, rest)
    if count is None or not len(first):
        return lead[first], rest[first], length
    return lead[first], rest[first], np.add.reduceat(count[order], first)


def _narrow(values: np.ndarray, width: int) -> bytes:
    size = (width + 7) // 8
    return values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :size].tobytes() if len(values) else b""


def _widen(data: bytes, n: int, width: int) -> np.ndarray:
    size = (width + 7) // 8
    out = np.zeros((n, 8), dtype=np.uint8)
    out[:, :size] = np.frombuffer(data, dtype=np.uint8).reshape(n, size)
    return out.view("<u8").ravel().astype(_U)


def encode_block(lead: np.ndarray, rest: np.ndarray, count: np.ndarray, width: int, block_bits: int) -> dict:
    """Sorted entries of one block as a filter."""
    own = min(width, 64) - block_bits
    quotient_bits = min(own, max(1, len(lead) - 1).bit_length())
    inner = lead & _U((1 << own) - 1)
    quotient = (inner >> _U(own - quotient_bits)).astype(np.int64)
    unary = np.zeros(len(lead) + (1 << quotient_bits), dtype=np.uint8)
    unary[quotient + np.arange(len(lead))] = 1
    large = count >= 255
    return {"quotient_bits": quotient_bits, "entries": len(lead), "quotients": np.packbits(unary).tobytes(),
            "remainders": _narrow(inner & _U((1 << (own - quotient_bits)) - 1), own - quotient_bits)
            + _narrow(rest, max(0, width - 64)),
            "counts": np.where(large, 255, count).astype(np.uint8).tobytes()
            + count[large].astype("<i8").tobytes()}


def decode_block(block: int, row: dict, width: int, block_bits: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    own, n, quotient_bits = min(width, 64) - block_bits, row["entries"], row["quotient_bits"]
    unary = np.unpackbits(np.frombuffer(row["quotients"], dtype=np.uint8))[:n + (1 << quotient_bits)]
    quotient = (np.flatnonzero(unary) - np.arange(n)).astype(_U)
    split = n * ((own - quotient_bits + 7) // 8)
    lead = (quotient << _U(own - quotient_bits)) | _widen(row["remainders"][:split], n, own - quotient_bits)
    if block_bits:
        lead |= _U(block) << _U(own)
    rest = _widen(row["remainders"][split:], n, max(0, width - 64))
    count = np.frombuffer(row["counts"], dtype=np.uint8, count=n).astype(np.int64)
    count[count == 255] = np.frombuffer(row["counts"], dtype="<i8", offset=n)
    return lead, rest, count


_FILTER = "block long, quotient_bits int, entries int, quotients binary, remainders binary, counts binary"


def _filter_rows(places: list[tuple[np.ndarray, np.ndarray]], width: int, block_bits: int) -> pa.RecordBatch:
    lead, rest, count = summed(np.concatenate([p[0] for p in places]), np.concatenate([p[1] for p in places]),
                               None, width)
    block = (lead >> _U(min(width, 64) - block_bits)).astype(np.int64) if block_bits else np.zeros(len(lead), np.int64)
    first, length = runs(block)
    rows = [{"block": int(block[f]), **encode_block(lead[f:f + n], rest[f:f + n], count[f:f + n], width, block_bits)}
            for f, n in zip(first.tolist(), length.tolist(), strict=True)]
    return pa.RecordBatch.from_pylist(rows, schema=pa.schema([
        ("block", pa.int64()), ("quotient_bits", pa.int32()), ("entries", pa.int32()),
        ("quotients", pa.binary()), ("remainders", pa.binary()), ("counts", pa.binary())]))


def _places(ids: np.ndarray, n: int, bits: int, occupied: tuple[np.ndarray, int] | None) -> np.ndarray:
    """Where an n-gram starts whose shorter parts are worth it."""
    if len(ids) < n:
        return np.zeros(0, dtype=np.int64)
    ok = ids != 0
    if occupied is None:
        good = np.ones(len(ids) - n + 1, dtype=bool)
        for i in range(n):
            good &= ok[i:len(ids) - n + 1 + i]
        return np.flatnonzero(good)
    bitmap, address = occupied
    part = np.ones(len(ids) - n + 2, dtype=bool)
    for i in range(n - 1):
        part &= ok[i:len(part) + i]
    at = np.flatnonzero(part)
    width = (n - 1) * bits
    slot = permute(*pack(ids, at, n - 1, bits), width)[0] >> _U(min(width, 64) - address)
    part[at] = (bitmap[slot >> _U(3)] >> (slot & _U(7)).astype(np.uint8)) & 1
    return np.flatnonzero(part[:-1] & part[1:])


def count_phrases(coded: DataFrame, n: int, bits: int, min_count: int, places: int,
                  occupied: tuple[np.ndarray, int] | None = None) -> DataFrame:
    """ids, a (occurrences) and top (leading bits) of the n-grams with at least ``min_count``."""
    width = n * bits
    wanted = min(MOST_BLOCK_BITS, max(0, math.ceil(math.log2(max(places, 1) / BLOCK_PLACES))))
    block_bits = min(wanted, min(width, 64) - 1)
    shared = coded.sparkSession.sparkContext.broadcast(occupied)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0
        for batch in batches:
            lists = batch.column(0)
            offsets, flat = lists.offsets.to_numpy(), lists.values.to_numpy()
            for lo, hi in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True):
                ids = flat[lo:hi]
                at = _places(ids, n, bits, shared.value)
                for k in range(0, len(at), FILTER_PLACES):
                    held.append(permute(*pack(ids, at[k:k + FILTER_PLACES], n, bits), width))
                    size += len(held[-1][0])
                    if size >= FILTER_PLACES:
                        yield _filter_rows(held, width, block_bits)
                        held, size = [], 0
        if size:
            yield _filter_rows(held, width, block_bits)

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        block, held, size = None, [], 0

        def joined():
            return summed(*(np.concatenate(c) for c in zip(*held, strict=True)), width)

        def found() -> pa.RecordBatch:
            lead, rest, total = joined()
            keep = total >= min_count
            lead, rest, total = lead[keep], rest[keep], total[keep]
            ids = unpack(*restore(lead, rest, width), n, bits)
            top = lead >> _U(max(0, min(width, 64) - TOP_BITS))
            return pa.RecordBatch.from_arrays([
                pa.ListArray.from_arrays(pa.array(np.arange(0, ids.size + 1, n, dtype=np.int32)),
                                         pa.array(ids.ravel())),
                pa.array(total), pa.array(top.astype(np.int64))], names=["ids", "a", "top"])

        for batch in batches:
            for row in batch.to_pylist():
                if row["block"] != block and held:
                    yield found()
                    held, size = [], 0
                block = row["block"]
                held.append(decode_block(block, row, width, block_bits))
                size += row["entries"]
                if size >= 1 << 21 and len(held) > 1:
                    held = [joined()]
                    # What is distinct stays; the next merge waits for as much again.
                    size = -len(held[0][0]) if len(held[0][0]) > 1 << 20 else len(held[0][0])
        if held:
            yield found()

    filters = coded.mapInArrow(count, _FILTER)
    return (filters.repartition("block").sortWithinPartitions("block")
            .mapInArrow(merge, "ids array<int>, a long, top long"))


def _occupied(frequent: DataFrame, width: int) -> tuple[np.ndarray, int] | None:
    """Bitmap over the leading bits of ``frequent``, about 16 bits an entry; None without entries."""
    entries = frequent.count()
    if not entries:
        return None
    known = min(width, 64, TOP_BITS)
    address = min(known, BITMAP_BITS, max(3, math.ceil(math.log2(16 * entries))))
    slot = F.shiftrightunsigned("top", known - address) + 1  # the functions count from 1
    rows = frequent.groupBy(F.bitmap_bucket_number(slot).alias("bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position(slot)).alias("bits"))
    out = np.zeros(max(1 << address, 8 * 4096) // 8, dtype=np.uint8)
    for row in rows.collect():  # at most 2^BITMAP_BITS / 2^15 rows of 4 KB
        own = np.frombuffer(bytes(row.bits), dtype=np.uint8)
        at = (row.bucket - 1) * 4096
        out[at:at + len(own)] = own[:len(out) - at]
    return out, address


# -- collocations -----------------------------------------------------------------------------------

def phrase_counts(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST,
                  dictionary_bytes: int = DICTIONARY_BYTES) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(id, lang, word), (lang, n) and (ids, a) of all frequent phrases of 1 to ``longest`` words."""
    counted = cut_lineage(word_counts(docs))
    totals = cut_lineage(counted.groupBy("lang").agg(F.sum("n").alias("n")))
    dictionary = cut_lineage(numbered(counted.filter(F.col("n") >= min_count)))
    known = dictionary.count()
    bits = max(1, known.bit_length())
    if bits > MAX_WORD_BITS:
        raise ValueError(f"{known} frequent words: at most 2^{MAX_WORD_BITS} can be numbered; raise min_count")
    places = totals.agg(F.sum("n")).first()[0] or 0
    phrases = dictionary.select(F.array("id").alias("ids"), F.col("n").alias("a"))
    if known:
        coded, occupied = cut_lineage(coded_texts(docs, dictionary, dictionary_bytes)), None
        for n in range(2, longest + 1):
            found = cut_lineage(count_phrases(coded, n, bits, min_count, places, occupied))
            phrases = phrases.unionByName(found.select("ids", "a"))
            occupied = _occupied(found, n * bits)
            if occupied is None:
                break
    return dictionary, totals, phrases


def collocations(docs: DataFrame, min_count: int = MIN_COUNT, longest: int = LONGEST, top: int = TOP,
                 dictionary_bytes: int = DICTIONARY_BYTES) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the ``top`` phrases of each language."""
    dictionary, totals, phrases = phrase_counts(docs, min_count, longest, dictionary_bytes)
    phrases = cut_lineage(phrases)
    size = F.size("ids")
    several = phrases.filter(size > 1)
    # Phrases with as frequent a longer one around them: one word more is enough to find out.
    around = (several.filter(size > 2)
              .select(F.explode(F.array(F.slice("ids", F.lit(1), size - 1), F.slice("ids", F.lit(2), size - 1)))
                      .alias("ids"), "a").groupBy("ids").agg(F.max("a").alias("longer")))
    alone = cut_lineage(several.join(around, "ids", "left")
                        .filter(F.col("longer").isNull() | (F.col("longer") < F.col("a"))).select("ids", "a"))
    first, rest = (phrases.select(F.col("ids").alias(f"{x}_ids"), F.col("a").alias(x)) for x in "lr")
    cuts = (alone.select("ids", "a", F.explode(F.sequence(F.lit(1), size - 1)).alias("k"))
            .withColumn("l_ids", F.slice("ids", F.lit(1), F.col("k")))
            .withColumn("r_ids", F.slice("ids", F.col("k") + 1, size - F.col("k")))
            .join(first, "l_ids").join(rest, "r_ids").select("ids", "a", "k", "l", "r"))
    # One language and one text a phrase: words join by id.
    said = (alone.select("ids", F.posexplode("ids").alias("at", "id")).join(dictionary, "id")
            .groupBy("ids").agg(F.first("lang").alias("lang"), F.sort_array(F.collect_list(
                F.struct("at", F.col("word").cast("string").alias("word")))).alias("words")))
    whole = "decimal(19,0)"
    score = F.expr(f"(cast(1000 as decimal(4,0)) * cast(a as {whole}) * cast(n as {whole}))"
                   f" div (cast(l as {whole}) * cast(r as {whole}))")
    lowest = (cuts.join(said.select("ids", "lang"), "ids").join(totals, "lang")
              .groupBy("ids", "lang", "a", "n").agg(F.min(F.struct(score.alias("score"), "k", "l", "r")).alias("cut")))
    rows = (lowest.join(said.select("ids", F.array_join(F.transform("words", lambda w: w["word"]), " ")
                                    .alias("phrase")), "ids")
            .select("lang", "phrase", "a", "cut.l", "cut.r", "n", "cut.score",
                    F.pmod(F.xxhash64("ids"), F.lit(_RANK_PARTS)).alias("_part")))
    order = [F.desc("score"), F.desc("a"), "phrase"]
    for keys in (["lang", "_part"], ["lang"]):
        rows = rows.withColumn("rank", F.row_number().over(Window.partitionBy(*keys).orderBy(*order)).cast("long"))
        rows = rows.filter(F.col("rank") <= top)
    return rows.select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def query(spark, sf_dir: str) -> DataFrame:
    return collocations(read(spark, sf_dir, "documents"))


ORACLE = rf"""
with pieces as materialized (
  select lang, row_number() over () as id, regexp_extract_all(piece, '[^\x20\x09]+') as w from (
  select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[.,;:!?\x0A-\x0D]')) as piece from documents)),
words as (select lang, id, unnest(range(1, len(w) + 1)) as i, unnest(w) as w from pieces),
total as materialized (select lang, count(*)::bigint as n from words group by lang),
places as (select lang, w, lead(w, 1) over p as w2, lead(w, 2) over p as w3, lead(w, 3) over p as w4,
  lead(w, 4) over p as w5 from words window p as (partition by id order by i)),
grams as (
  select lang, 1 as m, w as phrase from places union all
  select lang, 2, w || ' ' || w2 from places where w2 is not null union all
  select lang, 3, w || ' ' || w2 || ' ' || w3 from places where w3 is not null union all
  select lang, 4, w || ' ' || w2 || ' ' || w3 || ' ' || w4 from places where w4 is not null union all
  select lang, 5, w || ' ' || w2 || ' ' || w3 || ' ' || w4 || ' ' || w5 from places where w5 is not null),
often as materialized (select lang, m, phrase, count(*) as f from grams group by all having count(*) >= {MIN_COUNT}),
inner_ones as (select s.lang, s.phrase from often s join often b on b.lang = s.lang and b.m > s.m
  and contains(' ' || b.phrase || ' ', ' ' || s.phrase || ' ') and 100 * b.f >= 100 * s.f group by all),
halves as materialized (select lang, phrase, m, f, k,
    array_to_string(string_split(phrase, ' ')[1:k], ' ') as one,
    array_to_string(string_split(phrase, ' ')[k + 1:], ' ') as two
  from often, (values (1), (2), (3), (4)) c(k) where m > k),
cuts as (select h.lang, h.phrase, h.f as a, k, l.f as l, r.f as r, n,
    ((1000::hugeint * h.f * n) // (l.f::hugeint * r.f))::bigint as score
  from halves h join total t on t.lang = h.lang join often l on l.lang = h.lang and l.phrase = h.one
  join often r on r.lang = h.lang and r.phrase = h.two),
lowest as (select *, row_number() over (partition by lang, phrase order by score, k) as place from cuts),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank
  from lowest where place = 1
  and not exists (select 1 from inner_ones i where i.lang = lowest.lang and i.phrase = lowest.phrase))
select lang, rank, phrase, a, l, r, n, score from ranked where rank <= {TOP}
"""
