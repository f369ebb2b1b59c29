"""Benchmark decontamination by template windows.

Words become template tokens: a number, a capitalised word (a name, or a sentence's first word) and
a unit of measure each become a placeholder of their type, other words are lower-cased without the
signs around them. Windows of template tokens of documents and benchmark items are hash-joined. Windows that
line up along one shift are one alignment; it counts if its slots are consistent, that is, if every
value in the item stands for one value in the document and the other way round. So a copied question
is found, and also one whose numbers, names and units were exchanged throughout. Windows need one plain word; an alignment
needs LITERALS of them in all, so a window of placeholders counts where its neighbours bear it out.

Beside them stand literal windows: every token is its own value without regard to case, names and
numbers too. They find copies in another letter case, where names and plain words change places, and
copies of items with so many numbers and names that typed windows tell nothing. Scripts without
blanks between words are cut into characters.
"""

from __future__ import annotations

import array
import re

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lakeloom.llm.shared import text_batches, written

#: Tokens in a window (shorter items are one window), and how many plain words an alignment of typed windows must cover.
WINDOW, LITERALS = 8, 5
#: An item of fewer tokens than LITERALS identifies no passage and counts where it is a whole document, line or sentence; a character of a script without blanks counts as half a token.
#: Share of an item's tokens that consistent alignments must cover.
COVERED = 0.6
ROW = "_row_of_leaks"
#: Words whose codes a Python worker holds before it starts anew (about 200 bytes each).
WORDS = 500_000
#: With more window hashes than this in the benchmark (8 bytes each), documents' windows are joined without a filter.
FILTER_HASHES = 4_000_000

# Units of measure that aren't common words otherwise.
UNITS = frozenset(
    "km cm mm kg mg ml km/h mph kph meters metres meter metre kilometers kilometres kilometer kilometre miles mile inches inch feet yards yard"
    " grams gram kilograms kilogram pounds pound ounces ounce tons tonnes liters litres liter litre gallons gallon seconds second minutes minute"
    " hours hour days day weeks week months month years year dollars dollar euros euro cents cent usd eur percent degrees degree volts watts".split()
)
_WORD = re.compile(r"\S+").findall
# Thai, Lao, Tibetan, Burmese, Khmer, kana and Chinese characters, each with the marks that belong to it.
_UNSPACED = "\u0e00-\u0eff\u0f00-\u0fff\u1000-\u109f\u1780-\u17ff\u3040-\u30ff\u31f0-\u31ff\u3400-\u4dbf\u4e00-\u9fff\uf900-\ufaff\uff66-\uff9f\U00020000-\U0003ffff"
_HAS_UNSPACED = re.compile(f"[{_UNSPACED}]").search
_PIECE = re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}]+").findall
_WORD_AT, _PIECE_AT = re.compile(r"\S+").finditer, re.compile(f"[{_UNSPACED}]|[^\\s{_UNSPACED}]+").finditer
# What ends a line or a sentence, or quotes one.
_ENDS = frozenset('\n\r\u2028.!?:;。．！？；："“”„«»')
_NUMBER = re.compile(r"[$€£+-]?\d[\d.,:/]*(%|[^\W\d_]*)$")


def template_token(word: str) -> tuple[str, str]:
    """(type, value) of a word: ``num``, ``unit``, ``name``, or ``word`` with its lower-cased core; an empty type for signs alone."""
    if word.isascii() and word.isalpha() and word.islower():  # most words, told at once
        return ("unit" if word in UNITS else "word"), word
    core = word.strip("".join(c for c in {word[0], word[-1]} if not c.isalnum())) if word and not (word[0].isalnum() and word[-1].isalnum()) else word
    while core and not (core[0].isalnum() and core[-1].isalnum()):
        core = core[0 if core[0].isalnum() else 1 : len(core) if core[-1].isalnum() else -1]
    if not core:
        return "", ""
    low = core.lower()
    if core[0].isdigit() and (m := _NUMBER.match(core)):
        return ("num" if not m[1] or m[1] == "%" else "quantity" if m[1].lower() in UNITS else "num", low)
    if low in UNITS:
        return "unit", low
    if core[0].isupper() and not (len(core) > 1 and core.isupper()):
        return "name", low
    return "word", low


class _Codes(dict):
    """Word to the place of its two codes: of its template token (the lowest bit tells plain words; 0: no token) and of its value in any case."""

    def __init__(self):
        self.typed, self.literal = array.array("Q"), array.array("Q")

    def __missing__(self, word: str) -> int:
        import xxhash

        kind, value = template_token(word)
        self.typed.append(0 if not kind else xxhash.xxh64_intdigest(f"w {value}" if kind == "word" else f"<{kind}>") & ~1 | (kind == "word") or 2)
        self.literal.append(xxhash.xxh64_intdigest(f"v {value.casefold()}"))
        self[word] = at = len(self)
        return at

    def of(self, words: list[str]):
        """The codes of both kinds."""
        import numpy as np

        if len(self) > WORDS:
            self.clear()
            self.__init__()
        at = np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))
        return (np.frombuffer(c, dtype=np.uint64)[at] if len(words) else np.zeros(0, dtype=np.uint64) for c in (self.typed, self.literal))


_CODES = _Codes()


def words_of(text: str) -> list[str]:
    """What stands between white space; characters of scripts without blanks one by one."""
    return _WORD(text) if text.isascii() or not _HAS_UNSPACED(text) else _PIECE(text)


def identifying(words, here) -> float:
    """Tokens, a character of a script without blanks as half a one."""
    return len(here) - sum(bool(_HAS_UNSPACED(words[i])) for i in here) / 2


def template_codes(text: str | None):
    """Words with a token, their codes, and the codes of their values in any case."""
    import numpy as np

    words = words_of(text or "")
    codes, literal = _CODES.of(words)
    here = np.flatnonzero(codes)
    return words, here, codes[here], literal[here]


def window_hashes(codes, size: int, literal: int = 0):
    """A hash of every ``size`` codes in a row (never 0), or 0 where none is a plain word; ``literal`` windows (1; whole documents: 2) may hold any tokens and have other hashes."""
    import numpy as np

    n = len(codes) - size + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    h = np.full(n, size + 1000 * literal, dtype=np.uint64)
    for k in range(size):
        h = h * np.uint64(0x9E3779B97F4A7C15) + codes[k : k + n]
    h ^= h >> np.uint64(29)
    h = h * np.uint64(0xBF58476D1CE4E5B9) | np.uint64(1)
    if literal:
        return h
    plain = np.cumsum(np.r_[0, codes & np.uint64(1)].astype(np.int64))
    return np.where(plain[size:] > plain[:-size], h, np.uint64(0))


def _is_short(words, here) -> bool:
    return len(here) < 2 * LITERALS and identifying(words, here) < LITERALS  # a token is half a one at least


def _windows(words, here, codes, literal, sizes):
    """(size, hashes, codes) of the windows of an item; one of fewer tokens than LITERALS is one literal window under a negative size."""
    if _is_short(words, here):
        return [(-len(literal), window_hashes(literal, len(literal), 2), literal)] if len(literal) else []
    return [(size, window_hashes(own, size, own is literal), own) for size in sizes for own in (codes, literal)]


def _document_windows(words, here, codes, literal, sizes):
    """As ``_windows``, for a document: with literal windows of the short items' sizes (negative) at every place."""
    long = [] if _is_short(words, here) else [size for size in sizes if size > 0]
    return [(size, window_hashes(own, size, own is literal), own) for size in long for own in (codes, literal)] + [(size, window_hashes(literal, -size, 2), literal) for size in sizes if size < 0]


def _delimited(text: str, here, at: int, size: int) -> bool:
    """Whether tokens ``at`` to ``at + size`` are whole sentences or lines: before and after them the text begins, ends, or has a line feed, the end of a sentence or quotation marks."""
    spans = [m.span() for m in (_WORD_AT if text.isascii() or not _HAS_UNSPACED(text) else _PIECE_AT)(text)]

    def open_(left: int | None, right: int | None) -> bool:
        if left is None or right is None:
            return True
        a, b = spans[here[left]], spans[here[right]]
        last = max((k for k in range(*a) if text[k].isalnum()), default=a[0])
        first = min((k for k in range(*b) if text[k].isalnum()), default=b[1])
        return any(c in _ENDS for c in text[last + 1 : first])

    end = at + size
    return open_(at - 1 if at else None, at) and open_(end - 1, end if end < len(here) else None)


def _plain(codes, at: int, size: int) -> int:
    """The places of plain words in a window, a bit for each."""
    return sum((int(codes[at + k]) & 1) << k for k in range(size))


def _slots(words, here, codes, at: int, size: int) -> list[str]:
    return [":".join(template_token(words[here[i]])) for i in range(at, at + size) if not int(codes[i]) & 1]


HITS = "id long, size int, n int, at long, h long, slots array<string>, plain int"


def item_windows(items: DataFrame, key: str) -> DataFrame:
    """Every window of the items: id, size, tokens ``n`` in the item, place ``at``, hash, slot values and places of ``plain`` words."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for b in text_batches(batches):
            out = {c: [] for c in ("id", "size", "n", "at", "h", "slots", "plain")}
            for i, text in zip(b.column(key).to_pylist(), b.column("text").to_pylist(), strict=True):
                words, here, codes, literal = template_codes(text)
                for size, h, own in _windows(words, here, codes, literal, [min(WINDOW, len(codes))]):
                    for at in np.flatnonzero(h).tolist():
                        slots = [] if own is literal else _slots(words, here, codes, at, size)
                        plain = 0 if own is literal else _plain(codes, at, size)
                        for c, v in (("id", i), ("size", size), ("n", len(codes)), ("at", at), ("h", int(h[at].view(np.int64))), ("slots", slots), ("plain", plain)):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("id", pa.int64()), ("size", pa.int32()), ("n", pa.int32()), ("at", pa.int64()), ("h", pa.int64()), ("slots", pa.list_(pa.string())), ("plain", pa.int32())]))

    return items.select(key, "text").where(f"{key} is not null").mapInArrow(run, HITS)


def document_windows(docs: DataFrame, sizes: list[int], hashes) -> DataFrame:
    """Windows of the documents (``row``, ``at``, ``h``, ``slots``); with ``hashes`` (a sorted broadcast array) only those that are among them."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        known = hashes.value if hashes is not None else None
        if known is not None:
            seen = np.zeros(1 << 22, dtype=bool)  # a first test by 22 bits of the hash
            seen[(known >> np.uint64(42)).astype(np.int64)] = True
        for b in text_batches(batches):
            out = {c: [] for c in ("row", "size", "at", "h", "slots")}
            for row, text in zip(b.column(ROW).to_pylist(), b.column("text").to_pylist(), strict=True):
                words, here, codes, literal = template_codes(text)
                for size, h, own in _document_windows(words, here, codes, literal, sizes):
                    if known is None:
                        found = np.flatnonzero(h)
                    else:
                        found = np.flatnonzero(seen[(h >> np.uint64(42)).astype(np.int64)] & (h != 0))
                        if len(found):
                            among = h[found]
                            found = found[known[np.minimum(np.searchsorted(known, among), len(known) - 1)] == among]
                    for at in found.tolist():
                        if size < 0 and not _delimited(text, here, at, -size):
                            continue
                        slots = [] if own is literal else _slots(words, here, codes, at, size)
                        for c, v in (("row", row), ("size", size), ("at", at), ("h", int(h[at].view(np.int64))), ("slots", slots)):
                            out[c].append(v)
            yield pa.RecordBatch.from_pydict(out, schema=pa.schema([("row", pa.binary()), ("size", pa.int32()), ("at", pa.int64()), ("h", pa.int64()), ("slots", pa.list_(pa.string()))]))

    return docs.select(ROW, "text").mapInArrow(run, "row binary, size int, at long, h long, slots array<string>")


def leaks(docs: DataFrame, benchmark: DataFrame, key: str = "item_id") -> DataFrame:
    """``row`` of ``docs`` (their ROW) and ``item``, with the share of the item's tokens that consistent alignments cover."""
    import numpy as np

    items = written(item_windows(benchmark, key).dropDuplicates(["id", "at", "h"]), "item-windows")
    sizes = sorted(r["size"] for r in items.select("size").distinct().collect())  # at most WINDOW, and under 2 * LITERALS negative ones
    distinct = items.select("h").distinct()
    shared = None
    if distinct.count() <= FILTER_HASHES:
        own = np.sort(distinct.toArrow().column(0).to_numpy().view(np.uint64)) if items.head(1) else np.zeros(0, dtype=np.uint64)
        shared = docs.sparkSession.sparkContext.broadcast(own)
    found = written(document_windows(docs, sizes, shared), "document-windows").select("row", "size", F.col("at").alias("doc_at"), "h", F.col("slots").alias("doc_slots"))
    hits = found.join(items, ["h", "size"]).where(F.size("slots") == F.size("doc_slots")).withColumn("shift", F.col("doc_at") - F.col("at"))
    hits = written(hits.select("row", F.col("id").alias("item"), "n", "size", "at", "shift", "slots", "doc_slots", "plain"), "hits")
    pairs = hits.select("row", "item", "shift", F.explode(F.arrays_zip("slots", "doc_slots")).alias("p")).select("row", "item", "shift", "p.slots", "p.doc_slots").distinct()
    by = ["row", "item", "shift"]
    # A type and value of one side that meets two on the other makes the alignment inconsistent.
    wrong = pairs.groupBy(*by, "slots").count().where("count > 1").select(*by).unionByName(pairs.groupBy(*by, "doc_slots").count().where("count > 1").select(*by)).distinct()
    typed, literal = hits.where("plain > 0").join(wrong, by, "left_anti"), hits.where("plain = 0")
    places = lambda df: df.select(*by, "n", F.explode(F.sequence(F.lit(0), F.abs("size") - 1)).alias("k"), "at", "plain")
    covered = places(typed).select(*by, "n", (F.col("at") + F.col("k")).alias("token"), F.expr("(plain >> k) & 1").alias("plain")).distinct()
    borne = covered.groupBy(*by).agg(F.sum("plain").alias("words")).where(F.col("words") >= LITERALS).select(*by)
    # Literal windows hold the same words on both sides, whatever the rest of their alignment does.
    tokens = covered.join(borne, by, "left_semi").select("row", "item", "n", "token").unionByName(places(literal).select("row", "item", "n", (F.col("at") + F.col("k")).alias("token"))).distinct()
    return tokens.groupBy("row", "item", "n").agg((F.count("*") / F.first("n")).alias("share")).where(F.col("share") >= COVERED).select("row", "item", "share")


def with_row(docs: DataFrame) -> DataFrame:
    """The documents with ROW, 16 bytes that rows share only if doc_id and text are equal."""
    both = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("-")), F.lit("\x1f"), F.coalesce(F.col("text"), F.lit("")))
    return docs.withColumn(ROW, F.unhex(F.md5(both)))


def contamination(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """doc_id, ``contaminated``, ``items`` (the leaked items' ids, ascending) and the largest ``share`` covered.

    A document is contaminated if consistent alignments and literal windows cover COVERED of an item's tokens. An item of
    fewer than LITERALS tokens (twice as many characters in a script without blanks) contaminates documents of which it is a whole line or
    sentence, or more of them, in any letter case, and nothing else. Items without tokens, null items and items with null ids are passed over. Null and empty texts are clean.
    Repeated rows share one answer and keep their rows. Empty tables give clean documents, or no rows. Columns other than doc_id and text are left out.
    """
    rows = with_row(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"))
    found = leaks(rows, benchmark).groupBy("row").agg(F.array_sort(F.collect_set("item")).alias("items"), F.max("share").alias("share"))
    return rows.select("doc_id", ROW).join(found, F.col(ROW) == F.col("row"), "left").select(
        "doc_id", F.col("items").isNotNull().alias("contaminated"), F.coalesce("items", F.array().cast("array<bigint>")).alias("items"), F.coalesce("share", F.lit(0.0)).alias("share")
    )


def drop_contaminated(docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The documents that are not contaminated, with all their columns, whatever their names. Nulls, repeats and empty tables as in ``contamination``."""
    rows = with_row(docs)
    gone = written(leaks(rows, benchmark).select(F.col("row").alias(ROW)).distinct(), "contaminated")
    return rows.join(gone, ROW, "left_anti").select(*[F.col(f"`{c}`") for c in docs.columns])
