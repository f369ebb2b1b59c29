"""What several operators of this folder need: tables in the shared folder, and tokenizers.

Lineage is cut by writing a table into the folder that ``spark.checkpoint.dir`` names. All
executors share that folder, so a lost executor costs a re-run of its tasks and nothing else.
"""

from __future__ import annotations

import array
import gc
import re
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of ``spark.checkpoint.dir``; a temporary one only where that is unset and the master is local (tests)."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not folder:
        if not re.match(r"local(\[|$)", spark.sparkContext.master):
            raise ValueError("set spark.checkpoint.dir to a folder that driver and executors share")
        folder = "file://" + tempfile.mkdtemp(prefix="lakeloom-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder.rstrip("/")


def fresh(name: str, df: DataFrame) -> str:
    """A column name that ``df`` doesn't have, whatever the letter case: ``name``, with underscores behind it if need be."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


BATCH = "spark.sql.execution.arrow.maxRecordsPerBatch"


def written(df: DataFrame, name: str, compression: str = "zstd", rows: int = 1000) -> DataFrame:
    """Write ``df`` as Parquet into the shared folder and read it back.

    While it is written, Arrow batches hold at most ``rows`` rows: rows here are whole texts, or blocks of many.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    before = spark.conf.get(BATCH)
    try:
        spark.conf.set(BATCH, min(rows, int(before)) if int(before) > 0 else rows)
        df.write.option("compression", compression).parquet(path)
    finally:
        spark.conf.set(BATCH, before)
    return spark.read.schema(df.schema).parquet(path)


def counted(df: DataFrame, name: str, **sums: Column) -> DataFrame:
    """As ``written``; ``seen`` tells the rows of the result, and the sums (of numbers; 0 without rows), found while it is written.

    Every job leaves threads, plans and compiled code in the driver, so a table is not read once more only to be counted.
    """
    watch = Observation()
    out = written(df.observe(watch, F.count(F.lit(1)).alias("rows"), *[F.sum(c.cast("long")).alias(k) for k, c in sums.items()]), name)
    return known(out, **{k: watch.get[k] or 0 for k in ("rows", *sums)})


def known(df: DataFrame, **figures: int) -> DataFrame:
    """``df`` with figures for ``seen``."""
    df._seen_by_lakeloom = figures
    return df


def seen(df: DataFrame, what: str = "rows") -> int:
    """A figure of a table that was ``counted``; rows of others are counted now."""
    figures = getattr(df, "_seen_by_lakeloom", {})
    return df.count() if what == "rows" and "rows" not in figures else figures[what]


#: Characters that make a text take the plain path: white space other than blank and line feed, and
#: everything outside ASCII and the Latin-1 letters. Inside the rest, a run of letters is one piece.
_ODD = re.compile(r"[\t\r\x0b\x0c\x1c-\x1f\x7f-\xbf\xd7\xf7Ā-\U0010ffff]")
_LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
#: Those of them that ASCII has.
_ODD_ASCII = "\t\r\x0b\x0c\x1c\x1d\x1e\x1f\x7f"


def _is_odd(text: str) -> bool:
    return any(c in text for c in _ODD_ASCII) if text.isascii() else bool(_ODD.search(text))


class PieceEncoder:
    """Encode texts with a file of the ``tokenizers`` library, each different piece of text once.

    A BPE tokenizer never merges across its own pre-tokenizer's cuts. Where a text holds only
    blanks, line feeds, ASCII and Latin-1 letters, those cuts include every change between a run of
    letters and other characters (an apostrophe aside, which may take letters along), and every
    place where white space follows other text. So such a text is cut there, and the ids of pieces
    seen before come from a table. Other texts are encoded whole. The ids equal those of encoding
    the whole text. Strings of special tokens are ordinary text.

    ``keeps_blanks``: white space is part of the next piece, else the tokenizer drops it and lower-
    cases. ``keep``: pieces held, about. They are in two tables; when the younger is full it becomes
    the older one, and the next starts with what was met in both, so rare pieces go and memory stays bounded.
    """

    def __init__(self, path: str, keeps_blanks: bool, width: str = "I", keep: int = 1_200_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        self.width, self.half, self.young, self.old, self.again = width, keep // 2, {}, {}, {}
        self.glue = "" if keeps_blanks else " "
        blank, gap = ("[ \n]*", "|[ \n]*[^ \n{0}]+|[ \n]+") if keeps_blanks else ("", "|[^ \n{0}]+")
        self.fine = re.compile(f"{blank}[{_LETTERS}]+" + gap.format(_LETTERS)).findall
        self.coarse = re.compile(r"[ \n]*[^ \n]+|[ \n]+" if keeps_blanks else r"[^ \n]+").findall
        self.word = re.compile(f"{' ' if keeps_blanks else ''}[{_LETTERS}]+").fullmatch
        self.lower = not keeps_blanks

    @classmethod
    def shared(cls, path: str, keeps_blanks: bool, width: str = "I", keep: int = 600_000) -> PieceEncoder:
        """The encoder of this Python worker; its tables serve all tasks that the worker runs."""
        if (path, width) not in _ENCODERS:
            _ENCODERS[path, width] = cls(path, keeps_blanks, width, keep)
        return _ENCODERS[path, width]

    def _ids(self, texts: list[str]) -> list[bytes]:
        return [array.array(self.width, e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _words(self, words: list[str]) -> list[bytes]:
        """Ids of single words, encoded many in one text; the library tells which word a token is of."""
        import numpy as np

        out: list[bytes] = []
        kind, size = (np.uint16, 2) if self.width == "H" else (np.uint32, 4)
        groups = [words[k : k + 2000] for k in range(0, len(words), 2000)]
        for group, e in zip(groups, self.tokenizer.encode_batch([self.glue.join(g) for g in groups], add_special_tokens=False), strict=True):
            of = np.array(e.word_ids, dtype=np.int64)
            cuts = np.searchsorted(of, np.arange(len(group) + 1)).tolist()
            if not len(of) or of[-1] + 1 != len(group):  # not cut as expected: one by one
                out += self._ids(group)
                continue
            data = np.array(e.ids, dtype=kind).tobytes()
            out += [data[size * a : size * b] for a, b in zip(cuts, cuts[1:], strict=False)]
        return out

    def _learn(self, new: list[str]) -> None:
        """Ids of pieces that the younger table lacks, from the older one or the library."""
        young, old, words, others = self.young, self.old, [], []
        for w in dict.fromkeys(new):
            ids = old.get(w)
            if ids is not None:
                young[w] = self.again[w] = ids
            else:
                (words if self.word(w) else others).append(w)
        young.update(zip(words, self._words(words), strict=True))
        young.update(zip(others, self._ids(others), strict=True))

    def __call__(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text as little-endian integers of ``width``; None: as an empty text."""
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, and the collector would walk millions of strings' lists
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[bytes]:
        if len(self.young) > self.half:
            self.old, self.young = self.young, self.again if len(self.again) < self.half // 2 else {}
            self.again = {}
        get, out, odd, open_, new = self.young.get, [], [], [], []
        for t in texts:
            if not t:
                out.append([])
                continue
            if _is_odd(t):
                odd.append(len(out))
                out.append([])
                continue
            t = t.lower() if self.lower else t
            pieces = self.coarse(t) if "'" in t else self.fine(t)
            ids = list(map(get, pieces))
            at = -1
            try:
                while True:
                    at = ids.index(None, at + 1)
                    open_.append((ids, at, pieces[at]))
                    new.append(pieces[at])
            except ValueError:
                out.append(ids)
        self._learn(new)
        known = self.young
        for ids, at, piece in open_:
            ids[at] = known[piece]
        done = list(map(b"".join, out))
        for k, ids in zip(odd, self._ids([texts[k] for k in odd]), strict=True):
            done[k] = ids
        return done


_ENCODERS: dict[tuple[str, str], PieceEncoder] = {}


def text_batches(batches, rows: int = 500, chars: int = 8_000_000):
    """Record batches cut into slices of at most so many rows and about so many characters of ``text``."""
    import pyarrow as pa
    import pyarrow.compute as pc

    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.fill_null(pc.binary_length(pc.cast(batch.column("text"), pa.large_binary())), 0).to_numpy(zero_copy_only=False)
        start, total = 0, 0
        for i, n in enumerate(sizes.tolist()):
            if i > start and (i - start >= rows or total + n > chars):
                yield batch.slice(start, i - start)
                start, total = i, 0
            total += n
        yield batch.slice(start)
