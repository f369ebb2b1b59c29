"""Alignment of two tokenizers' ids through a dictionary of token groups.

A text's bytes are cut where tokens of both tokenizers end. What lies between two cuts is a group: some ids of A and some of B
for the same bytes. Texts share few different groups, so each block of documents interns its own, and only these leave it. Over the
corpus each different group is expanded once into its links (id of A, id of B) and gets the sums over them; the sums go back to
the blocks by the group's key and are multiplied there by how often each document has the group. A link's count is of documents: each
block sends, for each pair of ids, how many of its documents hold it.

A block tokenizes each different piece of its texts once, where neither tokenizer merges across the pieces' ends: both have an end there,
so a text's groups are those of its pieces, one after another.
"""

from __future__ import annotations

import gc
import hashlib
import re

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lakeloom.llm.shared import PieceEncoder, _is_odd, text_batches, written

#: A block ends beyond so many different groups, pairs of document and group, or different pieces.
GROUPS, ENTRIES, PIECES = 100_000, 1_000_000, 300_000
#: Texts encoded at once: documents and characters.
TEXTS, CHARS = 200, 1_000_000
#: Pieces that the tokenizers get at once.
TOGETHER = 20_000
#: Between the ids of A and of B in a group's key.
_BETWEEN = 0xFFFFFFFF


def _byte_alphabet() -> dict[str, int]:
    """The byte-level alphabet: printable Latin-1 characters stand for themselves, the other bytes for characters from 256 on."""
    own = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class _Vocabulary:
    """The bytes of all entries, end to end."""

    def __init__(self, entries: list[bytes]):
        import numpy as np

        self.sizes = np.array([len(e) for e in entries], dtype=np.int64)
        self.starts = np.cumsum(self.sizes) - self.sizes
        self.flat = np.frombuffer(b"".join(entries), dtype=np.uint8)

    def joined(self, ids):
        """The bytes of a sequence of entries."""
        import numpy as np

        sizes = self.sizes[ids]
        return self.flat[np.repeat(self.starts[ids] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())]


class Aligner:
    """Groups of texts by a byte-level file of the ``tokenizers`` library (A) and a ``sentencepiece`` model with byte fallback and a leading blank (B)."""

    def __init__(self, path_a: str, path_b: str):
        import sentencepiece

        self.a = PieceEncoder.shared(path_a, keeps_blanks=True, keep=200_000)
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        alphabet, held = _byte_alphabet(), self.a.tokenizer.get_vocab(with_added_tokens=False)
        entries = [b""] * (max(held.values()) + 1)
        for t, i in held.items():
            entries[i] = bytes(alphabet[c] for c in t) if all(c in alphabet for c in t) else b""
        pieces = [self._piece(self.b.id_to_piece(i)) for i in range(self.b.get_piece_size())]
        self.vocabularies = _Vocabulary(entries), _Vocabulary(pieces)
        self.bits = max(1, (len(entries) - 1).bit_length()), max(1, (len(pieces) - 1).bit_length())
        merged = [self.b.id_to_piece(i).replace("▁", " ") for i in range(self.b.get_piece_size()) if not (self.b.is_byte(i) or self.b.is_control(i) or self.b.is_unknown(i))]
        plain = [] if any(len(p) > 1 and "\n" in p for p in merged) else [p for p in merged if not _is_odd(p)]
        self.finds = [f if plain and all(len(f(p)) < 2 for p in plain) else None for f in (self.a.fine, self.a.coarse)]

    @classmethod
    def shared(cls, path_a: str, path_b: str) -> Aligner:
        """The aligner of this Python worker."""
        if (path_a, path_b) not in _ALIGNERS:
            _ALIGNERS[path_a, path_b] = cls(path_a, path_b)
        return _ALIGNERS[path_a, path_b]

    @staticmethod
    def _piece(piece: str) -> bytes:
        m = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
        return bytes([int(m[1], 16)]) if m else piece.replace("▁", " ").encode()

    def pieces(self, text: str) -> list[str] | None:
        """The pieces of a text, between which A cuts and no entry of B reaches; None where that isn't known."""
        fine, coarse = self.finds
        find = coarse if fine is None or "'" in text else fine
        return None if find is None or _is_odd(text) else find(text)

    def tokens(self, pieces: list[str]):
        """Ids of A and of B of pieces one after another, and how many of each piece; None where some bytes differ from the pieces'."""
        import numpy as np

        raw = [p.encode() for p in pieces]
        sizes, data = np.array(list(map(len, raw))), np.frombuffer(b"".join(raw), dtype=np.uint8)
        # Words with a blank before them stay apart in A; other pieces may not, so each is a text of its own.
        words = all(map(self.a.word, pieces))
        encoded = self.a.tokenizer.encode_batch_fast(["".join(pieces)] if words else pieces, add_special_tokens=False)
        a = np.array([i for e in encoded for i in e.ids], dtype=np.int64)
        # A line feed is in no longer entry of B, so it keeps the pieces apart; a blank comes before the first.
        b, joined = np.array(self.b.encode("\n" + "\n".join(pieces)), dtype=np.int64), np.frombuffer(b" \n" + b"\n".join(raw), dtype=np.uint8)
        if not all(v.sizes[x].sum() == len(y) and np.array_equal(v.joined(x), y) for v, x, y in zip(self.vocabularies, (a, b), (data, joined), strict=True)):
            return None
        ends_a, ends_b = (np.cumsum(v.sizes[x]) for v, x in zip(self.vocabularies, (a, b), strict=True))
        last = np.cumsum(sizes + 1) + 1  # byte ends of the pieces in what B got
        own = np.cumsum(sizes)
        last_a = np.searchsorted(ends_a, own)
        at = np.searchsorted(ends_b, last)
        before = np.searchsorted(ends_b, last - sizes)  # the line feeds before them
        if not (np.array_equal(ends_a[last_a], own) and np.array_equal(ends_b[at], last) and np.array_equal(ends_b[before], last - sizes)):
            return None
        apart = np.ones(len(b), dtype=bool)
        apart[0], apart[before] = False, False
        return a, np.diff(last_a, prepend=-1), b[apart], at - before

    def encoded(self, texts: list[str | None]):
        """Ids of A and of B for each text, as arrays; None where the text is null or empty or some bytes differ from a blank and the text."""
        import numpy as np

        present = [k for k, t in enumerate(texts) if t]
        own = [" " + texts[k] for k in present]
        out: list = [None] * len(texts)
        for k, text, a, b in zip(present, own, self.a(own), self.b.encode([t[1:] for t in own], num_threads=1), strict=True):
            a, b, data = np.frombuffer(a, dtype="<u4").astype(np.int64), np.array(b, dtype=np.int64), np.frombuffer(text.encode(), dtype=np.uint8)
            if all(v.sizes[ids].sum() == len(data) and np.array_equal(v.joined(ids), data) for v, ids in zip(self.vocabularies, (a, b), strict=True)):
                out[k] = a, b
        return out

    def cuts(self, a, b):
        """Of texts' ids one after another: first token and number of tokens of each group, in A and in B."""
        import numpy as np

        ends_a, ends_b = (np.cumsum(v.sizes[ids]) for v, ids in zip(self.vocabularies, (a, b), strict=True))
        at = np.searchsorted(ends_b, ends_a)  # the last ends agree, so there is always one
        last_a = np.nonzero(ends_b[at] == ends_a)[0]
        last_b = at[last_a]
        first_a, first_b = (np.concatenate([[0], last[:-1] + 1]) for last in (last_a, last_b))
        return first_a, last_a - first_a + 1, first_b, last_b - first_b + 1

    def keys(self, a, b, first_a, n_a, first_b, n_b):
        """Numbers of the groups among the different ones, and the keys of these."""
        import numpy as np

        number, keys = np.empty(len(n_a), dtype=np.int64), []
        bits_a, bits_b = self.bits
        key_of = lambda i: np.concatenate([a[first_a[i] : first_a[i] + n_a[i]], [_BETWEEN], b[first_b[i] : first_b[i] + n_b[i]]]).astype("<u4").tobytes()
        small = (n_a * bits_a + n_b * bits_b <= 63) & (n_b < 64)
        shapes = np.where(small, n_a * 64 + n_b, 0)
        for shape in np.unique(shapes).tolist():
            at = np.nonzero(shapes == shape)[0]
            if not shape:  # long groups one by one
                known: dict[bytes, int] = {}
                number[at] = [known.setdefault(key_of(i), len(keys) + len(known)) for i in at.tolist()]
                keys += known
                continue
            packed = np.zeros(len(at), dtype=np.int64)
            for ids, first, n, bits in ((a, first_a, shape // 64, bits_a), (b, first_b, shape % 64, bits_b)):
                for k in range(n):
                    packed = packed << bits | ids[first[at] + k]
            _, first, back = np.unique(packed, return_index=True, return_inverse=True)
            number[at] = back + len(keys)
            first = at[first]
            columns = [a[first_a[first] + k] for k in range(shape // 64)] + [np.full(len(first), _BETWEEN)] + [b[first_b[first] + k] for k in range(shape % 64)]
            data, size = np.stack(columns, axis=1).astype("<u4").tobytes(), 4 * len(columns)
            keys += [data[k : k + size] for k in range(0, len(data), size)]
        return number, keys


_ALIGNERS: dict[tuple[str, str], Aligner] = {}

_BLOCK = "block long, doc_id array<long>, n_a array<long>, n_b array<long>, n_groups array<long>, n_links array<long>, groups_sha256 array<string>, starts binary, groups binary, times binary, keys array<binary>, pairs binary, pair_documents binary"


def _split(key: bytes):
    """The ids of A and of B of a group."""
    import numpy as np

    ids = np.frombuffer(key, "<u4")
    between = int(np.nonzero(ids == _BETWEEN)[0][0])
    return ids[:between], ids[between + 1 :]


def links_of(key: bytes):
    """The different links of a group: ids of A, ids of B, and how often each pair of occurrences is that link."""
    import numpy as np

    (a, n), (b, m) = (np.unique(ids, return_counts=True) for ids in _split(key))
    return np.repeat(a, len(b)), np.tile(b, len(a)), np.outer(n, m).ravel()


class _Interned:
    """A block: its documents, their groups by number, and the groups' keys, texts and links; of each different piece the groups, text and figures."""

    def __init__(self):
        import numpy as np

        self.numbers: dict[bytes, int] = {}
        self.texts: list[str] = []
        self.pair_numbers: dict[int, int] = {}
        self.pairs: list[list[int]] = []  # of each group: numbers of its different pairs
        self.rows, self.of, self.entries = [], [], 0
        self.pieces: dict[str, int] = {}
        self.piece_texts: list[str] = []
        # Of each piece: tokens of A and of B, groups, links, and where its groups start in ``flat``.
        self.figures, self.flat = np.zeros((5, 0), dtype=np.int64), np.zeros(0, dtype=np.int64)

    def _number(self, key: bytes) -> int:
        n = self.numbers.get(key)
        if n is None:
            n = self.numbers[key] = len(self.pairs)
            ids = memoryview(key).cast("I").tolist()
            between = ids.index(_BETWEEN)
            a, b = ids[:between], ids[between + 1 :]
            self.pairs.append([self.pair_numbers.setdefault(x << 32 | y, len(self.pair_numbers)) for x in set(a) for y in set(b)])
            self.texts.append(f"{','.join(map(str, a))}|{','.join(map(str, b))}")
        return n

    def _grouped(self, aligner: Aligner, a, b):
        """Of texts' or pieces' ids one after another: the groups' numbers, first tokens in A, and links."""
        import numpy as np

        first_a, n_a, first_b, n_b = aligner.cuts(a, b)
        number, keys = aligner.keys(a, b, first_a, n_a, first_b, n_b)
        return np.array([self._number(k) for k in keys], dtype=np.int64)[number], first_a, n_a * n_b

    def _learn(self, aligner: Aligner, new: list[str]) -> None:
        """Tokens, groups and links of pieces that the block lacks."""
        import numpy as np

        figures, flat = [self.figures], [self.flat]
        sorts: tuple[list, list] = [], []
        for p in new:
            sorts[aligner.a.word(p) is None].append(p)
        for part in (x[k : k + TOGETHER] for x in sorts for k in range(0, len(x), TOGETHER)):
            found = aligner.tokens(part)
            if found is None:  # their texts are encoded whole
                self.pieces.update(dict.fromkeys(part, -1))
                continue
            a, n_a, b, n_b = found
            number, first_a, links = self._grouped(aligner, a, b)
            ends = np.searchsorted(first_a, np.cumsum(n_a))
            starts = np.concatenate([[0], ends[:-1]])
            self.pieces.update(zip(part, range(len(self.piece_texts), len(self.piece_texts) + len(part)), strict=True))
            texts = list(map(self.texts.__getitem__, number.tolist()))
            self.piece_texts += [texts[x] if y == x + 1 else ";".join(texts[x:y]) for x, y in zip(starts.tolist(), ends.tolist(), strict=True)]
            figures.append(np.stack([n_a, n_b, ends - starts, np.add.reduceat(links, starts), starts + sum(map(len, flat))]))
            flat.append(number)
        self.figures, self.flat = np.concatenate(figures, axis=1), np.concatenate(flat)

    def _of_pieces(self, held: list[list[int]]) -> list[tuple]:
        """Figures, digest, groups and how often each, of texts that are cut into pieces of these numbers."""
        import numpy as np

        sizes = np.array(list(map(len, held)))
        doc, piece = np.repeat(np.arange(len(held)), sizes), np.concatenate([np.array(x, dtype=np.int64) for x in held])
        sums = np.add.reduceat(self.figures[:4, piece], np.cumsum(sizes) - sizes, axis=1).T.tolist()
        both, times = np.unique(doc * len(self.piece_texts) + piece, return_counts=True)
        doc, piece = both // len(self.piece_texts), both % len(self.piece_texts)
        n, first = self.figures[2, piece], self.figures[4, piece]
        group = self.flat[np.repeat(first - (np.cumsum(n) - n), n) + np.arange(n.sum())]
        both, back = np.unique(np.repeat(doc, n) * len(self.pairs) + group, return_inverse=True)
        times = np.bincount(back, weights=np.repeat(times, n)).astype(np.int64)
        ends = np.searchsorted(both, np.arange(1, len(held) + 1) * len(self.pairs)).tolist()
        groups = both % len(self.pairs)
        digest = lambda x: hashlib.sha256(";".join(map(self.piece_texts.__getitem__, x)).encode()).hexdigest()
        return [(*s, digest(x), groups[i:j], times[i:j]) for s, x, i, j in zip(sums, held, [0, *ends], ends, strict=False)]

    def _of_whole(self, aligner: Aligner, texts: list[str]) -> list[tuple | None]:
        """The same of texts that are encoded whole; None for those without tokens."""
        import numpy as np

        encoded = aligner.encoded(texts)
        held = [x for x in encoded if x is not None]
        if not held:
            return encoded
        number, first_a, each = self._grouped(aligner, *(np.concatenate(x) for x in zip(*held, strict=True)))
        ends = np.searchsorted(first_a, np.cumsum([len(x) for x, _ in held])).tolist()  # groups up to each text's end
        links, out = np.concatenate([[0], np.cumsum(each)]), []
        for (a, b), start, end in zip(held, [0, *ends], ends, strict=False):
            own = number[start:end]
            digest = hashlib.sha256(";".join(map(self.texts.__getitem__, own.tolist())).encode()).hexdigest()
            out.append((len(a), len(b), len(own), int(links[end] - links[start]), digest, *np.unique(own, return_counts=True)))
        rest = iter(out)
        return [None if x is None else next(rest) for x in encoded]

    def add(self, aligner: Aligner, doc_ids: list, texts: list[str | None]) -> None:
        collects = gc.isenabled()
        gc.disable()  # nothing here is cyclic, as in PieceEncoder
        try:
            self._add(aligner, doc_ids, texts)
        finally:
            if collects:
                gc.enable()

    def _add(self, aligner: Aligner, doc_ids: list, texts: list[str | None]) -> None:
        import numpy as np

        known, out = self.pieces, [None] * len(texts)
        cut, open_ = {}, []
        for k, t in enumerate(texts):
            if t:
                pieces = aligner.pieces(" " + t)
                cut[k] = ids = pieces and list(map(known.get, pieces))
                if ids and None in ids:
                    open_ += [(ids, at, p) for at, (i, p) in enumerate(zip(ids, pieces, strict=True)) if i is None]
        self._learn(aligner, list(dict.fromkeys(p for *_, p in open_)))
        for ids, at, p in open_:
            ids[at] = known[p]
        whole = [k for k, x in cut.items() if x is None or -1 in x]
        for k in whole:
            del cut[k]
        for at, found in ((cut, self._of_pieces(list(cut.values())) if cut else []), (whole, self._of_whole(aligner, [texts[k] for k in whole]) if whole else [])):
            for k, x in zip(at, found, strict=True):
                out[k] = x
        none = np.zeros(0, dtype=np.int64)
        for doc_id, x in zip(doc_ids, out, strict=True):
            *figures, groups, times = x or (0, 0, 0, 0, "", none, none)
            self.rows.append((doc_id, *figures))
            self.of.append((groups, times))
            self.entries += len(groups)

    def batch(self, block: int):
        import numpy as np
        import pyarrow as pa

        sizes = np.array([len(g) for g, _ in self.of], dtype=np.int64)
        groups, times = (np.concatenate([x[k] for x in self.of]) if self.of else np.zeros(0, np.int64) for k in (0, 1))
        # Documents of each pair: pairs of the document's groups, each once.
        counts = np.array([len(p) for p in self.pairs], dtype=np.int64)
        flat, first = np.array([n for p in self.pairs for n in p], dtype=np.int64), np.concatenate([[0], np.cumsum(counts)])
        each = counts[groups]
        at = np.repeat(first[groups] - np.concatenate([[0], np.cumsum(each)])[: len(each)], each) + np.arange(each.sum())
        held = np.unique(np.repeat(np.repeat(np.arange(len(sizes)), sizes), each) * max(1, len(self.pair_numbers)) + flat[at]) % max(1, len(self.pair_numbers))
        documents = np.bincount(held, minlength=len(self.pair_numbers))
        columns = list(zip(*self.rows, strict=True))
        binary = lambda x, kind: pa.array([x.astype(kind).tobytes()], pa.binary())
        arrays = [pa.array([block]), *(pa.array([list(c)], pa.list_(pa.int64())) for c in columns[:5]), pa.array([list(columns[5])], pa.list_(pa.string()))]
        arrays += [binary(np.concatenate([[0], np.cumsum(sizes)]), "<u4"), binary(groups, "<u4"), binary(times, "<u4"), pa.array([list(self.numbers)], pa.list_(pa.binary()))]
        arrays += [binary(np.array(list(self.pair_numbers), dtype=np.uint64), "<u8"), binary(documents, "<u4")]
        return pa.RecordBatch.from_arrays(arrays, names=[c.split()[0] for c in _BLOCK.split(", ")])


def interned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """Blocks of documents with their dictionaries of groups."""

    def run(batches):
        from pyspark import TaskContext

        aligner, part, number, block = Aligner.shared(path_a, path_b), TaskContext.get().partitionId(), 0, _Interned()
        for batch in text_batches(batches, TEXTS, CHARS):
            block.add(aligner, batch.column("doc_id").to_pylist(), batch.column("text").to_pylist())
            if len(block.numbers) > GROUPS or block.entries > ENTRIES or len(block.pieces) > PIECES:
                yield block.batch((part << 32) + number)
                number, block = number + 1, _Interned()
        if block.rows:
            yield block.batch((part << 32) + number)

    return docs.selectExpr("cast(doc_id as long) doc_id", "cast(text as string) text").mapInArrow(run, _BLOCK)


def _pair_counts(blocks: DataFrame) -> DataFrame:
    """a, b, documents, and best: 1 if no other link of ``a`` is held by more documents."""

    def run(batches):
        import numpy as np
        import pyarrow as pa

        for batch in batches:
            for pairs, documents in zip(batch.column("pairs").to_pylist(), batch.column("pair_documents").to_pylist(), strict=True):
                p = np.frombuffer(pairs, "<u8")
                yield pa.RecordBatch.from_arrays([pa.array((p >> np.uint64(32)).astype(np.int32)), pa.array(p.astype(np.uint32).astype(np.int32)), pa.array(np.frombuffer(documents, "<u4").astype(np.int64))], names=["a", "b", "documents"])

    counts = blocks.select("pairs", "pair_documents").mapInArrow(run, "a int, b int, documents long").groupBy("a", "b").agg(F.sum("documents").alias("documents"))
    return counts.withColumn("best", (F.col("documents") == F.max("documents").over(Window.partitionBy("a"))).cast("long"))


def _expanded(batches):
    """For mapInArrow: the links of each different group."""
    import numpy as np
    import pyarrow as pa

    for batch in batches:
        keys = batch.column("key")
        links = [links_of(k) for k in keys.to_pylist()]
        if links:
            at = np.repeat(np.arange(len(links)), [len(x[0]) for x in links])
            a, b, n = (np.concatenate([x[k] for x in links]) for k in range(3))
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(at)), pa.array(a.astype(np.int32)), pa.array(b.astype(np.int32)), pa.array(n.astype(np.int64))], names=["key", "a", "b", "n"])


def _summed(batches):
    """For mapInArrow: each document's sums, from its block's groups and what the corpus says of them."""
    import numpy as np
    import pyarrow as pa

    names = ["doc_id", "n_a", "n_b", "n_groups", "n_links"]
    for batch in batches:
        for r in batch.to_pylist():
            groups, times, starts = (np.frombuffer(r[c], "<u4").astype(np.int64) for c in ("groups", "times", "starts"))
            of = {c: np.zeros(int(groups.max(initial=-1)) + 1, dtype=np.int64) for c in ("count", "best")}
            for x in r["sums"] or ():
                for c in of:
                    of[c][x["number"]] = x[c]
            total = lambda c: np.diff(np.concatenate([[0], np.cumsum(times * of[c][groups])])[starts])
            yield pa.RecordBatch.from_arrays([*(pa.array(r[c], pa.int64()) for c in names), pa.array(total("best")), pa.array(total("count")), pa.array(r["groups_sha256"], pa.string())], names=[*names, "n_best", "count_sum", "groups_sha256"])


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """doc_id, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of each document.

    Null and empty texts, and those whose tokens' bytes differ from a blank and the text, have no tokens: zeros and an empty digest. Each row is a document
    of its own, so repeated rows and null ids keep their rows and count each; other columns are left out. An empty table gives no rows.
    """
    blocks = written(interned(docs, path_a, path_b), "group-blocks", rows=200)
    pairs = _pair_counts(blocks)
    dictionary = blocks.select("block", F.posexplode("keys").alias("number", "key"))
    sums = dictionary.select("key").distinct().mapInArrow(_expanded, "key binary, a int, b int, n long").join(pairs, ["a", "b"])
    sums = sums.groupBy("key").agg(F.sum(F.col("documents") * F.col("n")).alias("count"), F.sum(F.col("best") * F.col("n")).alias("best"))
    back = dictionary.join(sums, "key").groupBy("block").agg(F.collect_list(F.struct("number", "count", "best")).alias("sums"))
    per_block = blocks.drop("keys", "pairs", "pair_documents").join(back, "block", "left")
    return written(per_block.mapInArrow(_summed, "doc_id long, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"), "group-sums", rows=2)


def links(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """a, b, documents and best of every pair of ids that some document holds linked."""
    return _pair_counts(written(interned(docs, path_a, path_b), "group-blocks", rows=200))
