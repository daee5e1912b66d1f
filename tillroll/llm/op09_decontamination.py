"""Benchmark decontamination by template canonicalisation.

Words are canonicalised: numbers, units after a number, and names (capitalised inside a sentence) become typed
placeholders, other words lose case and punctuation. Windows of ``WINDOW`` canonical words of the benchmark items are hash-joined with those of
all documents; a second set of windows keeps every word literally (lower-cased), for texts in capitals or title case. A match keeps
what its placeholders stood for: slots are consistent if, over all matched windows of an item in a document, one value of
the item always becomes one value of the document of the same type. Where they are not, each occurrence of the item is judged by itself
(windows of nearly equal distance from the item's, or in the item's order), since a document may ask one question several times. So a question asked again with other numbers and names is caught,
an accidental sentence frame is not.

A document leaks an item if consistent windows cover at least half of the item's words, or ``RUN`` words in a row.

Documents are scanned once; a bitmap of window names, of 16 bits a window of the benchmark (``2**BITS[0]`` bits, 512 kB, at least and ``2**BITS[1]``,
32 MB, at most; beyond that it only lets more windows through), lets only possible matches leave the task, and Spark joins those with the windows by their
64-bit names. Texts are named by a 64-bit hash, those whose hash another text shares by two.

Defined results: null or empty texts leak nothing; items of fewer than ``LEAST`` words are not looked for; those of fewer than ``WINDOW``
words are looked for as a whole; a window needs ``LITERAL`` literal words as a template; repeated rows and null ids are judged like any
other row; repeated items are each reported; empty tables give no rows; other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillroll.llm import kit, scan

WINDOW = 8
LEAST = 4
LITERAL = 4
COVER = 0.5
RUN = 13
CONSISTENT = 0.9
#: words that an occurrence may be shifted by from one window to the next
DRIFT = 4
BITS = (22, 28)
UNITS = ("km m cm mm mile miles ft feet inch inches kg g mg lb lbs pound pounds ton tons l ml liter liters litre litres gallon gallons s sec second seconds "
         "min minute minutes h hour hours day days week weeks month months year years usd eur gbp dollar dollars euro euros cent cents percent "
         "kmh mph kwh w kw v hz gb mb kb tb degrees celsius").split()
U = np.uint64
NUMBER, NAME, UNIT = U(0x6E756D6265720001), U(0x6E616D6500000003), U(0x756E697400000005)
PLAIN = U(0x5851F42D4C957F2D)

INK = np.zeros(256, bool)
INK[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
DIGIT = np.zeros(256, bool)
DIGIT[48:58] = True
STOP = np.zeros(256, bool)
STOP[[ord(x) for x in ".!?:;\n"]] = True
_UNIT_NAMES = None


def _units() -> np.ndarray:
    global _UNIT_NAMES
    if _UNIT_NAMES is None:
        _UNIT_NAMES = np.sort(np.concatenate([scan.words(b := np.frombuffer(u.encode(), np.uint8), np.array([0, len(b)]))[0] for u in UNITS]))
    return _UNIT_NAMES


def canonical(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(literal name, template name, is placeholder, first word of each row) of the words of rows buf[off[i]:off[i+1]].
    A word is a run of letters, digits and other non-ASCII bytes; . and , between digits belong to it."""
    if not len(buf):
        e = np.zeros(0, U)
        return e, e, np.zeros(0, bool), np.zeros(len(off), np.int64)
    ink, digit = INK[buf], DIGIT[buf]
    between = np.zeros(len(buf), bool)
    between[1:-1] = digit[:-2] & digit[2:] & ((buf[1:-1] == 46) | (buf[1:-1] == 44))
    ink |= between
    # a unit may stick to its number: 5km is two words
    first, last = ink.copy(), ink.copy()
    turn = np.zeros(len(buf), bool)
    turn[1:] = ink[1:] & ink[:-1] & ~digit[1:] & ~between[1:] & digit[:-1]
    first[1:] &= ~ink[:-1] | turn[1:]
    last[:-1] &= ~ink[1:] | turn[1:]
    inner = off[1:-1][(off[1:-1] > 0) & (off[1:-1] < len(buf))]
    first[inner], last[inner - 1] = ink[inner], ink[inner - 1]
    start, end = np.flatnonzero(first), np.flatnonzero(last) + 1
    c = scan.running(buf, scan.BYTE_LOWER)
    word = scan.span(c, start, end) + (end - start).astype(U)
    number = digit[start]
    row_first = np.searchsorted(start, off)
    opens = np.zeros(len(start), bool)
    opens[row_first[:-1][row_first[:-1] < len(start)]] = True
    stops = np.concatenate(([0], np.cumsum(STOP[buf] & ~between)))
    opens[1:] |= stops[start[1:]] > stops[end[:-1]]
    upper = (buf[start] >= 65) & (buf[start] <= 90)
    units = _units()
    unit = np.zeros(len(start), bool)
    k = np.minimum(np.searchsorted(units, word), len(units) - 1)
    unit[1:] = number[:-1] & (units[k[1:]] == word[1:]) & ~opens[1:]
    name = upper & ~opens & ~unit
    template = np.where(number, NUMBER, np.where(unit, UNIT, np.where(name, NAME, word)))
    return word, template, number | unit | name, row_first


def windows(word: np.ndarray, template: np.ndarray, slot: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(literal window name, template window name, whether the template has a slot and literal words enough) at each word."""
    n = len(word) - size + 1
    if n <= 0:
        return np.zeros(0, U), np.zeros(0, U), np.zeros(0, bool)
    slots = np.concatenate(([0], np.cumsum(slot)))
    inside = slots[size:] - slots[:-size]
    return scan.grams(word, size) ^ PLAIN, scan.grams(template, size), (inside > 0) & (size - inside >= min(LITERAL, size))


def bits_for(windows: int) -> int:
    """The bitmap's size, as a power of two, for a benchmark of so many windows."""
    return min(max((16 * windows - 1).bit_length(), BITS[0]), BITS[1])


def _held(bits: np.ndarray, names: np.ndarray) -> np.ndarray:
    """Whether the bitmap may hold the names: their first bits are the place."""
    at = names >> U(64 - (8 * len(bits)).bit_length() + 1)
    return (bits[(at >> U(3)).astype(np.int64)] >> (at & U(7)).astype(np.uint8)) & 1 > 0


def _matches(sizes: list[int], packed: bytes | None):
    """(text, kind, at, size, name, slots) of windows whose name may be one of the benchmark's; all windows if no bitmap is given."""
    slot_type = pa.list_(pa.int64())

    def run(batches):
        bits = None if packed is None else np.frombuffer(packed, np.uint8)
        for b in batches:
            data, off = scan.text_buffer(b.column("text"))
            for i, j in scan.slabs(off):
                lo = int(off[i])
                edge = off[i:j + 1] - lo
                word, template, slot, first = canonical(data[lo:int(off[j])], edge)
                row_of = np.searchsorted(first, np.arange(len(word)), side="right") - 1
                for size in sizes:
                    plain, form, usable = windows(word, template, slot, size)
                    if not len(plain):
                        continue
                    whole = row_of[:len(plain)] == row_of[size - 1:size - 1 + len(plain)]
                    for kind, names, ok in ((0, plain, whole), (1, form, whole & usable)):
                        at = np.flatnonzero(ok if bits is None else ok & _held(bits, names))
                        if not len(at):
                            continue
                        r = row_of[at]
                        slots = []
                        for a in at.tolist():
                            x = range(a, a + size) if kind else ()
                            slots.append([v for p in x if slot[p] for v in (int(template[p]) % 7, int(word[p].view(np.int64)))])
                        yield pa.RecordBatch.from_arrays(
                            [b.column("key").take(pa.array(i + r)), pa.array(np.full(len(at), kind, np.int32)), pa.array(at - first[r]),
                             pa.array(np.full(len(at), size, np.int32)), pa.array(scan.signed(names[at])), pa.array(slots, slot_type)],
                            names=["key", "kind", "at", "size", "name", "slots"])
    return run


def _steady(hits: list[dict], consistent: float) -> bool:
    """Whether one value of the item always becomes one value of the document in these windows."""
    votes: dict[tuple[int, int], dict[int, int]] = {}
    for h in hits:
        if h["kind"]:
            for q in range(0, len(h["slots"]), 2):
                seen = votes.setdefault((h["item_slots"][q], h["item_slots"][q + 1]), {})
                seen[h["slots"][q + 1]] = seen.get(h["slots"][q + 1], 0) + 1
    total = sum(sum(v.values()) for v in votes.values())
    return total == 0 or sum(max(v.values()) for v in votes.values()) >= consistent * total


def _occurrences(hits: list[dict]) -> list[list[dict]]:
    """The template windows of each place where a document may hold the item: those of nearly equal at - item_at, and those that
    follow one another in the document as they do in the item, whatever stands between them."""
    forms = [h for h in hits if h["kind"]]
    out: list[list[dict]] = []
    last = None
    for h in sorted(forms, key=lambda h: (h["at"] - h["item_at"], h["at"])):
        shift = h["at"] - h["item_at"]
        if last is None or shift - last > DRIFT:
            out.append([])
        out[-1].append(h)
        last = shift
    chains: list[list[dict]] = []
    places: dict[int, list[dict]] = {}
    for h in forms:
        places.setdefault(h["at"], []).append(h)
    for at in sorted(places):
        same = sorted(places[at], key=lambda h: h["item_at"])
        after = chains[-1][-1]["item_at"] if chains else 0
        h = next((h for h in same if chains and h["item_at"] > after), None)
        if h is None:
            chains.append([same[0]])
        else:
            chains[-1].append(h)
    return out + chains


def _judge(cover: float, run_words: int, consistent: float):
    """Leaks among (text, item) pairs with all their matched windows."""
    def measure(hits: list[dict], n: int) -> tuple[int, int]:
        good = set()
        for h in hits:
            good.update(range(h["item_at"], h["item_at"] + h["size"]))
        longest = now = 0
        for w in range(n):
            now = now + 1 if w in good else 0
            longest = max(longest, now)
        return len(good), longest

    def run(batches):
        for b in batches:
            out = []
            for key, item, n, hits in zip(b.column("key").to_pylist(), b.column("item").to_pylist(), b.column("n_words").to_pylist(), b.column("hits").to_pylist(), strict=True):
                literal = [h for h in hits if not h["kind"]]
                if _steady(hits, consistent):
                    tried = [hits]
                else:  # the values differ from one occurrence to the next: each is judged by itself
                    tried = [literal, *(literal + x for x in _occurrences(hits) if _steady(x, consistent))]
                best = None
                for some in tried:
                    good, longest = measure(some, n)
                    if good >= cover * n or longest >= run_words:
                        found = (good, longest, -min(h["at"] for h in some))
                        best = found if best is None else max(best, found)
                if best is not None:
                    out.append((key, item, best[0] / n, best[1], not literal, -best[2]))
            kinds = (pa.int64(), pa.int64(), pa.float64(), pa.int32(), pa.bool_(), pa.int64())
            yield pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(zip(*out, strict=True) if out else [[]] * 6, kinds, strict=True)],
                                             names=["key", "item", "covered", "longest_run", "changed", "first_word"])
    return run


def leaks(docs: DataFrame, benchmark: DataFrame) -> tuple[DataFrame, Column]:
    """(key, item_id, covered, longest_run, changed, first_word): pairs of a different text of ``docs`` (key: its name) and a leaked item; and the
    name of a text as a column."""
    spark = docs.sparkSession
    kit.small_batches(spark)
    items = kit.write(spark, benchmark.select("item_id", kit.text_name(benchmark).alias("key"), kit.text_of().alias("text")), "items")
    texts = items.select("key", "text").distinct()
    cols = "key long, kind int, at long, size int, name long, slots array<long>"
    lengths = kit.write(spark, texts.mapInArrow(_lengths, "key long, n_words int"), "lengths").where(F.col("n_words") >= LEAST)
    sizes = sorted({min(WINDOW, r.n_words) for r in lengths.select(F.least("n_words", F.lit(WINDOW)).alias("n_words")).distinct().collect()})
    theirs = kit.write(spark, texts.mapInArrow(_matches(sizes, None), cols).join(lengths, "key")
                       .where(F.col("size") == F.least("n_words", F.lit(WINDOW)))
                       .select(F.col("key").alias("item"), "n_words", "kind", "size", "name", F.col("at").alias("item_at"), F.col("slots").alias("item_slots")), "windows")
    size = bits_for(theirs.count())
    bits = kit.bit_rows(theirs.select(F.shiftrightunsigned("name", 64 - size).alias("b")), "b", size)
    named = kit.text_name(docs).alias("key")
    rows = docs.select(named, kit.text_of().alias("text"))
    hits = rows.mapInArrow(_matches(sizes, bits.tobytes()), cols).distinct()
    pairs = (hits.join(theirs, ["kind", "size", "name"])
             .groupBy("key", "item", "n_words").agg(F.collect_list(F.struct("kind", "size", "at", "slots", "item_at", "item_slots")).alias("hits")))
    found = kit.write(spark, pairs.mapInArrow(_judge(COVER, RUN, CONSISTENT), "key long, item long, covered double, longest_run int, changed boolean, first_word long"), "leaks")
    return found.join(items.select("item_id", F.col("key").alias("item")), "item").drop("item"), named


def _lengths(batches):
    for b in batches:
        data, off = scan.text_buffer(b.column("text"))
        n = []
        for i, j in scan.slabs(off):
            lo = int(off[i])
            n += np.diff(canonical(data[lo:int(off[j])], off[i:j + 1] - lo)[3]).tolist()
        yield pa.RecordBatch.from_arrays([b.column("key"), pa.array(n, pa.int32())], names=["key", "n_words"])


def decontamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """A row for each row of ``docs`` (doc_id, text) and item that it leaks: doc_id, item_id, covered (part of the item's words), longest_run (words),
    changed (slots differ: no window is literal), first_word."""
    found, named = leaks(docs, benchmark)
    return (docs.select("doc_id", named).join(found, "key")
            .select("doc_id", "item_id", "covered", "longest_run", "changed", "first_word"))


def without_leaks(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """``docs`` without the rows that leak an item."""
    found, named = leaks(docs, benchmark)
    bad = found.select(F.col("key").alias(kit.T1)).distinct()
    rows = docs.select(F.struct(*(F.col(f"`{c}`") for c in docs.columns)).alias("__row"), named.alias(kit.T1))
    return rows.join(bad, kit.T1, "left_anti").select("__row.*")


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontamination(kit.table(spark, sf_dir, "documents"), kit.table(spark, sf_dir, "benchmark"))
