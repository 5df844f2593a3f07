"""Benchmark decontamination by canonical templates, also for questions with other values put in.

Texts become tokens: words in lower case, and typed placeholders for numbers, units and names (capitalised
words within a sentence), whose own values are kept as slots.  Windows of ``WINDOW`` tokens of the
documents are hash-joined with those of the benchmark items.  The matches of a document and an item that lie on one
diagonal must fill the item's slots consistently: one value of the item always became the same value of
the document, and two names never the same name.  A document that covers ``LEAST_SHARE`` of an item's
windows in this way holds the item, whatever numbers and names were put in.

Templates need ``LEAST_WORDS`` plain words.  Items are also looked for as they stand, by windows of raw tokens
in lower case with one word at least, so a verbatim copy is found however many of its tokens are numbers or names, and
whatever stands before it or how it is capitalised.

Documents are read once; a Bloom filter of the benchmark's windows, of bounded size, keeps
almost all windows that cannot match from leaving the task, and windows with a token that is in no item aren't even looked up.
The join decides, on the template itself.
"""

from __future__ import annotations

import functools
from collections.abc import Iterator
from typing import Any

import numpy as np
import pandas as pd
import pyarrow as pa
import regex
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from tapewatch.llm.columns import Carried, pick, same
from tapewatch.session import scratch, ship_package, small_side

WINDOW = 8
LEAST_SHARE = 0.5
# Tokens of a template that must be words: tables of numbers and lists of names match anything.
LEAST_WORDS = 4
FILTER_BITS_PER_WINDOW, LARGEST_FILTER_BITS = 64, 1 << 28
REMEMBERED = 400_000
# Distinct tokens of the benchmark's windows up to which documents' tokens are compared with them first.
MOST_TOKENS = 500_000
# Templates up to which documents without all words of any window are passed over at once; a larger
# benchmark only takes longer.
ANCHORED = 200_000
# Windows of items that are broadcast at most; of more, those that documents have are shuffled.
BROADCAST_WINDOWS = 50_000

# Token and sentence patterns, and units of measure.
TOKEN = r"\p{L}+|\p{N}+(?:[.,]\p{N}+)*|[%$€£°]|[.!?\n]"
UNITS = (
    "%", "$", "€", "£", "°",
    "mm", "cm", "m", "km", "inch", "inches", "foot", "feet", "yard", "yards", "mile", "miles",
    "mg", "g", "kg", "ton", "tons", "ounce", "ounces", "pound", "pounds",
    "ml", "l", "liter", "liters", "litre", "litres", "gallon", "gallons",
    "second", "seconds", "minute", "minutes", "hour", "hours", "day", "days", "week", "weeks", "month", "months", "year", "years",
    "cent", "cents", "dollar", "dollars", "euro", "euros", "kmh", "mph", "watt", "watts", "volt", "volts", "degree", "degrees",
)
NUMBER, UNIT, NAME = "<number>", "<unit>", "<name>"

_TOKEN = regex.compile(TOKEN)
_LETTERS = regex.compile(r"\p{L}+")
_NAME = regex.compile(r"\p{Lu}\p{L}+")
_ENDS = frozenset(".!?\n")
# Marks that are no tokens, behind many words.
_NO_TOKENS = frozenset(",;:)'\"*&|#")
_UNITS = frozenset(UNITS)


def _canonical(raw: str, at_start: bool) -> str:
    if raw[0].isnumeric():
        return NUMBER
    low = raw.lower()
    if low in _UNITS:
        return UNIT
    if not at_start and not raw[0].islower() and _NAME.fullmatch(raw):
        return NAME
    return low


def tokens(text: str) -> list[tuple[str, str]]:
    """(canonical token, token as it stands) of a text."""
    found, start = [], True
    for match in _TOKEN.finditer(text):
        raw = match[0]
        if raw in _ENDS:
            start = True
            continue
        found.append((_canonical(raw, start), raw))
        start = False
    return found


def _window(part: list[tuple[str, str]]) -> tuple[str, list[str]] | None:
    """Template and slots of a window, None if it has too few words."""
    slots = [f"{canonical} {raw.lower()}" for canonical, raw in part if canonical in (NUMBER, UNIT, NAME)]
    if len(part) - len(slots) < min(LEAST_WORDS, len(part)):
        return None
    return " ".join(canonical for canonical, _ in part), slots


def _verbatim(raw: str) -> str:
    """A token in lower case, unlike any canonical one."""
    return f"={raw.lower()}"


def _verbatim_window(part: list[tuple[str, str]]) -> tuple[str, list[str]] | None:
    """Raw tokens of a window, which has no slots; None if it has no word."""
    if not any(_LETTERS.fullmatch(raw) for _, raw in part):
        return None
    return " ".join(_verbatim(raw) for _, raw in part), []


def item_windows(benchmark: DataFrame, item_id: str = "item_id", text: str = "text", window: int = WINDOW) -> DataFrame:
    """item_id, n_windows, size, at, template, slots, verbatim, anchor of each window of each item.

    Of items with equal tokens the smallest id stands for all.  An item shorter than a window is one
    window; a null or empty one has none.  n_windows counts those of its kind with enough words.  A verbatim window
    is no anchor if it has a template, whose words are among its own.
    """
    ship_package(benchmark.sparkSession)
    distinct = pick(benchmark, item_id=item_id, text=text).where("text is not null").groupBy("text").agg(F.min("item_id").alias("item_id"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for item, text in zip(batch.column("item_id").to_pylist(), batch.column("text").to_pylist(), strict=True):
                all_tokens = tokens(text)
                size = min(window, len(all_tokens))
                parts = [(i, all_tokens[i:i + size]) for i in range(len(all_tokens) - size + 1 if size else 0)]
                windows = {i: w for i, part in parts if (w := _window(part))}
                rows += [(item, len(windows), size, i, *w, False, True) for i, w in windows.items()]
                exact = {i: w for i, part in parts if (w := _verbatim_window(part))}
                rows += [(item, len(exact), size, i, *w, True, i not in windows) for i, w in exact.items()]
            kinds = (batch.column("item_id").type, pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()), pa.bool_(), pa.bool_())
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)],
                ["item_id", "n_windows", "size", "at", "template", "slots", "verbatim", "anchor"])

    kind = distinct.schema["item_id"].dataType.simpleString()
    return distinct.mapInArrow(run, f"item_id {kind}, n_windows int, size int, at int, template string, slots array<string>, verbatim boolean, anchor boolean")


class _Matcher:
    """The windows of documents that may match, within a worker."""

    def __init__(self, bits: np.ndarray, sizes: list[int], vocabulary: list[str] | None = None) -> None:
        """``vocabulary`` has all tokens of the items' windows, if they are few; then others have code 0."""
        self._bits, self._sizes = bits, sizes
        self._codes = None if vocabulary is None else {t: token_code(t) for t in vocabulary}
        self._known: dict[str, tuple] = {}
        self._shared: dict[tuple, tuple] = {}
        self._unit, self._name = self._code(UNIT), self._code(NAME)

    def _code(self, token: str) -> int:
        return token_code(token) if self._codes is None else self._codes.get(token, 0)

    @staticmethod
    def hashes(codes: np.ndarray, size: int, at: np.ndarray | None = None) -> np.ndarray:
        """A hash of each window of ``size`` tokens, or of those that begin ``at`` some places, from the tokens' hashes."""
        if at is None:
            at = np.arange(max(0, len(codes) - size + 1))
        total = np.zeros(len(at), dtype=np.uint64)
        for i in range(size if len(at) else 0):
            total = total * np.uint64(0x9E3779B97F4A7C15) + codes[at + i]
        total ^= total >> np.uint64(29)
        return total

    def _pieces(self, word: str) -> tuple[tuple[int, ...], tuple[int, ...], bool | None, tuple[int, ...]]:
        """Codes of a word's tokens within and at the start of a sentence; whether the next word is at one,
        None for a word without tokens; codes of the tokens as they stand."""
        if (core := word if word.isalpha() else word[:-1] if word[-1] in _NO_TOKENS else "").isalpha():
            within, begun, exact = self._letters_codes(core)
            return (within,), (begun,), False, (exact,)
        raws = _TOKEN.findall(word)
        within, exact, start = [], [], False
        for raw in raws:
            if raw in _ENDS:
                start = True
            else:
                within.append(self._code(_canonical(raw, start)))
                exact.append(self._code(_verbatim(raw)))
                start = False
        # only the first token tells a start from other places
        begun = tuple(within)
        if raws and raws[0] not in _ENDS:
            begun = (self._code(_canonical(raws[0], True)), *begun[1:])
        return tuple(within), begun, start if raws else None, tuple(exact)

    def _letters_codes(self, raw: str) -> tuple[int, int, int]:
        """Codes of a token of letters within a sentence, at its start and as it stands."""
        low = raw.lower()
        exact = self._code(f"={low}")
        if low in _UNITS:
            return self._unit, self._unit, exact
        begun = self._code(low)
        is_name = len(raw) > 1 and not raw[0].islower() and _NAME.fullmatch(raw)
        return self._name if is_name else begun, begun, exact

    def codes(self, text: str) -> np.ndarray:
        """The codes of ``tokens(text)``."""
        return self.both_codes(text)[0]

    def both_codes(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """The codes of ``tokens(text)``, canonical and as they stand; words are looked up as a whole."""
        if len(self._known) > REMEMBERED:
            self._known, self._shared = {}, {}
        known, shared, out, exact = self._known, self._shared, [], []
        for word in set(text.split()).difference(known):
            pieces = self._pieces(word)
            known[word] = shared.setdefault(pieces, pieces)  # most words have the codes of many others
        for line in text.split("\n"):
            start = True
            for word in line.split():
                within, begun, end, raw = known[word]
                out += begun if start else within
                exact += raw
                if end is not None:
                    start = end
        return np.array(out, dtype=np.uint64), np.array(exact, dtype=np.uint64)

    def places(self, text: str) -> list[tuple[int, int, bool]]:
        """(size, position, verbatim) of windows that the filter lets through."""
        found = []
        for verbatim, codes in enumerate(self.both_codes(text)):
            known = np.concatenate(([0], np.cumsum(codes != 0)))
            for size in self._sizes:
                at = np.flatnonzero(known[size:] - known[:-size] == size)
                if len(at):
                    hit = lookup(self._bits, self.hashes(codes, size, at))
                    found += [(size, i, bool(verbatim)) for i in at[hit].tolist()]
        return found


def token_code(canonical: str) -> int:
    return xxhash.xxh64_intdigest(canonical) or 1  # 0 is any token that no item has


def _places(bits: int, h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mask = np.uint64(bits - 1)
    return h & mask, (h >> np.uint64(32)) * np.uint64(0xC2B2AE3D27D4EB4F) >> np.uint64(17) & mask


def lookup(filter_bytes: np.ndarray, h: np.ndarray) -> np.ndarray:
    hit = np.ones(len(h), dtype=bool)
    for place in _places(8 * len(filter_bytes), h):
        hit &= filter_bytes[place >> np.uint64(3)] >> (place & np.uint64(7)).astype(np.uint8) & 1 == 1
    return hit


def window_filter(windows: DataFrame) -> tuple[np.ndarray, list[int]]:
    """Bloom filter and sizes of the items' windows.  Its size is bounded; a benchmark that fills it
    lets more windows through to the join, but loses none."""
    n = windows.select("template").distinct().count()
    bits = 1 << 16
    while bits < min(LARGEST_FILTER_BITS, n * FILTER_BITS_PER_WINDOW):
        bits <<= 1
    sizes = sorted(r.size for r in windows.select("size").distinct().collect())  # at most WINDOW of them

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = set()
        for batch in batches:
            for template in batch.column(0).to_pylist():
                codes = np.array([token_code(t) for t in template.split(" ")], dtype=np.uint64)
                for place in _places(bits, _Matcher.hashes(codes, len(codes))):
                    found.add(int(place[0]))
        # one row for each of 2**12 stretches of the filter, so the union is taken in tasks
        stretches: dict[int, bytearray] = {}
        width = bits >> 12
        for place in found:
            part = stretches.setdefault(place // width, bytearray(max(1, width // 8)))
            part[place % width >> 3] |= 1 << (place & 7)
        yield pa.RecordBatch.from_arrays(
            [pa.array(list(stretches), pa.int32()), pa.array([bytes(b) for b in stretches.values()], pa.binary())], ["at", "bits"])

    def union(key: tuple[Any, ...], frame: pd.DataFrame) -> pd.DataFrame:
        merged = np.zeros(len(frame["bits"].iloc[0]), dtype=np.uint8)
        for part in frame["bits"]:
            merged |= np.frombuffer(part, dtype=np.uint8)
        return pd.DataFrame({"at": [key[0]], "bits": [merged.tobytes()]})

    out = np.zeros(bits // 8, dtype=np.uint8)
    rows = windows.select("template").distinct().mapInArrow(run, "at int, bits binary").groupBy("at").applyInPandas(union, "at int, bits binary").collect()
    for row in rows:
        part = np.frombuffer(row.bits, dtype=np.uint8)
        out[row.at * len(part):(row.at + 1) * len(part)] |= part
    return out, sizes


def _letters(raw: str) -> set[str]:
    """The runs of letters of a token in lower case, which can hold marks that the token itself doesn't ("İ")."""
    low = raw.lower()
    return {low} if low.isalpha() else set(_LETTERS.findall(low))


def vocabulary(windows: DataFrame) -> list[str] | None:
    """The tokens of all windows, None if there are too many."""
    rows = windows.select(F.explode(F.split("template", " ")).alias("token")).distinct().limit(MOST_TOKENS + 1).collect()
    return None if len(rows) > MOST_TOKENS else [r.token for r in rows]


def anchors(windows: DataFrame) -> dict[str, list[frozenset[str]]] | None:
    """The words of each window under the longest of them, None if there are too many windows.

    A window without words stands under the empty one, which every text has.
    """
    templates = windows.where("anchor").select("template").distinct().limit(ANCHORED + 1).collect()
    if len(templates) > ANCHORED:
        return None
    found: dict[str, list[frozenset[str]]] = {}
    for row in templates:
        words = frozenset(w for t in row.template.split(" ") if not t.startswith("<") for w in _letters(t.removeprefix("=")))
        found.setdefault(max(words, key=lambda w: (len(w), w), default=""), []).append(words)
    return found


# ASCII letters in lower case, other ASCII characters as blanks; all others stay.
_ASCII_LETTERS = bytes(i + 32 if 65 <= i <= 90 else i if 97 <= i <= 122 or i >= 128 else 32 for i in range(256))


@functools.lru_cache(maxsize=REMEMBERED)
def _letters_beyond_ascii(part: bytes) -> frozenset[str]:
    return frozenset(w for raw in _LETTERS.findall(part.decode()) for w in _letters(raw))


def may_hold(text: str, anchored: dict[str, list[frozenset[str]]]) -> bool:
    """Whether a text has all words of some window."""
    return _may_hold(text, *_coded(anchored))


def _coded(anchored: dict[str, list[frozenset[str]]]) -> tuple[frozenset[bytes], dict[bytes, list[frozenset[bytes]]]]:
    """All longest words, and windows under them, in UTF-8."""
    coded = {anchor.encode(): [frozenset(w.encode() for w in words) for words in windows] for anchor, windows in anchored.items()}
    return frozenset(coded), coded


def _may_hold(text: str, longest: frozenset[bytes], anchored: dict[bytes, list[frozenset[bytes]]]) -> bool:
    words = set(text.encode().translate(_ASCII_LETTERS).split())
    if not text.isascii():
        for part in [w for w in words if not w.isascii()]:
            words.update(w.encode() for w in _letters_beyond_ascii(part))
    words.add(b"")
    return any(needed <= words for anchor in longest & words for needed in anchored[anchor])


def document_windows(docs: DataFrame, bits: np.ndarray, sizes: list[int], anchored: dict[str, list[frozenset[str]]] | None = None, doc_id: str = "doc_id", text: str = "text",
                     tokens_known: list[str] | None = None) -> DataFrame:
    """doc_id, t (hash of the text), size, at, template, slots of the windows that the filter lets through."""
    spark = docs.sparkSession
    ship_package(spark)
    shipped = spark.sparkContext.broadcast((bits, sizes, anchored, tokens_known))
    rows = pick(docs, doc_id=doc_id, text=text).select("doc_id", F.xxhash64("text").alias("t"), "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits, sizes, anchored, tokens_known = shipped.value
        matcher, coded = _Matcher(bits, sizes, tokens_known), None if anchored is None else _coded(anchored)
        for batch in batches:
            kinds = (batch.column("doc_id").type, pa.int64(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.string()))
            rows = []
            for i, text in enumerate(batch.column("text")):
                text = text.as_py() or ""
                places = matcher.places(text) if coded is None or _may_hold(text, *coded) else []
                if places:
                    all_tokens = tokens(text)
                    rows += [(batch.column("doc_id")[i].as_py(), batch.column("t")[i].as_py(), size, at, *w)
                             for size, at, verbatim in places
                             if (w := (_verbatim_window if verbatim else _window)(all_tokens[at:at + size]))]
            yield pa.RecordBatch.from_arrays(
                [pa.array([r[i] for r in rows], kind) for i, kind in enumerate(kinds)], ["doc_id", "t", "size", "at", "template", "slots"])

    kind = rows.schema["doc_id"].dataType.simpleString()
    return rows.mapInArrow(run, f"doc_id {kind}, t long, size int, at int, template string, slots array<string>")


def _consistent(pairs: Column) -> Column:
    """One value of the document for each value of the item, and for names one of the item for each of the document."""
    names = F.filter(pairs, lambda p: p["item"].startswith(NAME))
    return (
        (F.size(F.array_distinct(F.transform(pairs, lambda p: p["item"]))) == F.size(pairs))
        & (F.size(F.array_distinct(F.transform(names, lambda p: p["doc"]))) == F.size(names)))


def leaks(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, least_share: float = LEAST_SHARE,
          doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, t, item_id, n_windows (of the item), n_found (of them in the document), new_values (slots were
    filled otherwise) for each document that holds an item; windows are templates, or verbatim ones if only those tell.

    Null texts hold nothing; rows equal in id and text count as one.  An empty benchmark finds nothing.
    """
    spark, path = docs.sparkSession, scratch(docs.sparkSession, "item-windows")
    made = item_windows(benchmark, text="text", window=window)
    made.write.parquet(path)
    items = spark.read.schema(made.schema).parquet(path)
    bits, sizes = window_filter(items)
    found = document_windows(docs, bits, sizes, anchors(items), doc_id, text, vocabulary(items))
    right = items.select("item_id", "n_windows", "verbatim", F.col("at").alias("item_at"), F.col("size").alias("item_size"),
                         F.col("template").alias("item_template"), F.col("slots").alias("item_slots"))
    # windows overlap, so their files are far smaller than what is made of them
    matched = found.join(small_side(right, BROADCAST_WINDOWS), (F.col("template") == F.col("item_template")) & (F.col("size") == F.col("item_size")))
    pairs = F.transform(F.arrays_zip(F.col("item_slots").alias("item"), F.col("slots").alias("doc")),
                        lambda z: F.struct(z["item"].alias("item"), z["doc"].alias("doc")))
    diagonals = (
        matched.groupBy("doc_id", "t", "item_id", "verbatim", "n_windows", (F.col("at") - F.col("item_at")).alias("diagonal"))
        .agg(F.collect_set("item_at").alias("places"), F.array_distinct(F.flatten(F.collect_set(pairs))).alias("pairs"))
        .where(_consistent(F.col("pairs"))))
    held = (
        diagonals.groupBy("doc_id", "t", "item_id", "verbatim", "n_windows")
        .agg(F.size(F.array_distinct(F.flatten(F.collect_list("places")))).alias("n_found"),
             F.bool_or(F.exists("pairs", lambda p: p["item"] != p["doc"])).alias("new_values"))
        .where(F.col("n_found") >= F.col("n_windows") * least_share))
    return (
        held.groupBy("doc_id", "t", "item_id").agg(F.min(F.struct("verbatim", "n_windows", "n_found", "new_values")).alias("best"))
        .select("doc_id", "t", "item_id", "best.n_windows", "best.n_found", "best.new_values"))


def without_leaks(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The documents that hold no item, with all their columns, repeated rows included."""
    table = Carried(docs)
    marked = table.df.withColumns({"doc_id": table[doc_id], "t": F.xxhash64(table[text])})
    bad = leaks(docs, benchmark, doc_id=doc_id, text=text).select("doc_id", "t").distinct()
    return table.back(same(marked, bad, ["doc_id", "t"], "left_anti"))
