import hashlib
from collections import Counter

import pytest

from lakeloom.llm import alignment
from lakeloom.llm.queries import tokenizer_path

A, B = tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model")


def plain(rows):
    """Whole texts by both libraries, cuts from all byte ends, all pairs of occurrences."""
    import sentencepiece
    from tokenizers import Tokenizer

    a, b = Tokenizer.from_file(A), sentencepiece.SentencePieceProcessor(model_file=B)
    a.encode_special_tokens = True
    alphabet = alignment._byte_alphabet()
    docs = []
    for i, text in rows:
        ids_a, ids_b = (a.encode(" " + text, add_special_tokens=False).ids, b.encode(text)) if text else ([], [])
        bytes_a = [bytes(alphabet[c] for c in a.id_to_token(t)) for t in ids_a]
        bytes_b = [bytes([int(p[3:5], 16)]) if (p := b.id_to_piece(t)).startswith("<0x") and len(p) == 6 else p.replace("▁", " ").encode() for t in ids_b]
        want = (" " + text).encode() if text else b""
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            docs.append((i, [], [], []))
            continue
        ends = lambda parts: [sum(map(len, parts[: k + 1])) for k in range(len(parts))]
        ends_a, ends_b = ends(bytes_a), ends(bytes_b)
        cuts = sorted(set(ends_a) & set(ends_b))
        groups, low = [], 0
        for cut in cuts:
            groups.append(([t for t, e in zip(ids_a, ends_a) if low < e <= cut], [t for t, e in zip(ids_b, ends_b) if low < e <= cut]))
            low = cut
        docs.append((i, ids_a, ids_b, groups))
    count = Counter(p for *_, groups in docs for p in {(x, y) for own_a, own_b in groups for x in own_a for y in own_b})
    highest = {}
    for (x, _), n in count.items():
        highest[x] = max(n, highest.get(x, 0))
    out = []
    for i, ids_a, ids_b, groups in docs:
        own = [(x, y) for own_a, own_b in groups for x in own_a for y in own_b]
        text = ";".join(f"{','.join(map(str, g))}|{','.join(map(str, h))}" for g, h in groups)
        out.append((i, len(ids_a), len(ids_b), len(groups), len(own), sum(count[p] == highest[p[0]] for p in own), sum(count[p] for p in own), hashlib.sha256(text.encode()).hexdigest() if groups else ""))
    return sorted(out, key=str)


def found(df):
    return sorted((tuple(r[c] for c in ("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")) for r in df.collect()), key=str)


def rows_of(df):
    return [(r["doc_id"], r["text"]) for r in df.select("doc_id", "text").collect()]


@pytest.mark.parametrize("groups, entries, texts", [(alignment.GROUPS, alignment.ENTRIES, alignment.TEXTS), (5, 5, 3)])
def test_edges_equal_whole_texts_in_blocks_of_any_size(spark, edge_docs, monkeypatch, groups, entries, texts):
    for name, n in (("GROUPS", groups), ("ENTRIES", entries), ("TEXTS", texts)):
        monkeypatch.setattr(alignment, name, n)
    more = ["a▁b", "▁", "x ▁ y", " ", "   ", "a ", "a  ", "\n", " \n a\n\n  b \t c", "<s> </s> <unk> <0x41>", "a  b  c", "\x1c \x1d d", "́ é", "don't  we'll\n's", "  two", "tab\t\tx \n", "﻿", "\U0001f600 \U0001f600"]
    docs = edge_docs.select("doc_id", "text", "start", "rank").unionByName(spark.createDataFrame([(1000 + i, t, "x", "y") for i, t in enumerate(more)], "doc_id long, text string, start string, rank string"))
    assert found(alignment.aligned(docs, A, B)) == plain(rows_of(docs))


def test_table_equals_whole_texts(spark, small_docs):
    docs = small_docs.where("length(text) < 20000")
    assert found(alignment.aligned(docs, A, B)) == plain(rows_of(docs))


def test_empty_tables_and_texts_without_tokens(spark, no_docs):
    assert found(alignment.aligned(no_docs, A, B)) == []
    docs = spark.createDataFrame([(1, None), (1, None), (None, "")], "doc_id long, text string")
    assert found(alignment.aligned(docs, A, B)) == sorted([(1, *[0] * 6, "")] * 2 + [(None, *[0] * 6, "")], key=str)


def test_links_count_documents_once(spark):
    docs = spark.createDataFrame([(1, "the the the"), (2, "the"), (3, "a the")], "doc_id long, text string")
    assert {r["documents"] for r in alignment.links(docs, A, B).collect() if r["best"]} == {3, 1}


def test_a_block_tokenizes_each_different_piece_once():
    aligner = alignment.Aligner(A, B)
    own, sent = aligner.b, []

    class Counting:
        def encode(self, text, **more):
            sent.extend([text] if isinstance(text, str) else text)
            return own.encode(text, **more)

    aligner.b = Counting()
    block = alignment._Interned()
    for k in range(40):
        block.add(aligner, [k, k], ["Many words, the same again: words of 12 lines.\nThe end " * 5, None])
    assert sum(map(len, sent)) < 200 and len(block.rows) == 80 and len({r[1:] for r in block.rows}) == 2


def test_texts_in_pieces_equal_whole_texts(monkeypatch):
    """Also where a piece's tokens don't give its bytes back, and where B is known to reach over pieces' ends."""
    texts = ["It's one text, of 2 words-and more…", "plain words,  with\n\n blanks ", "пример и text", "été\n\tune", "the the the -- (a) b_c x=1;\ny", "a", "x ▁ y", "broken piece here", None, ""] * 3

    def rows(finds=None, broken=False):
        aligner, block = alignment.Aligner(A, B), alignment._Interned()
        aligner.finds = finds or aligner.finds
        if broken:
            whole = aligner.tokens
            aligner.tokens = lambda pieces: None if " broken" in pieces else whole(pieces)
        for k in range(0, len(texts), 4):
            block.add(aligner, list(range(len(texts)))[k : k + 4], texts[k : k + 4])
        keys = list(block.numbers)
        return block.rows, [sorted((keys[g], n) for g, n in zip(groups.tolist(), times.tolist(), strict=True)) for groups, times in block.of]

    monkeypatch.setattr(alignment, "TOGETHER", 3)
    fine, coarse = alignment.Aligner(A, B).finds
    assert fine and coarse
    assert rows() == rows([None, None]) == rows([None, coarse]) == rows(broken=True)
