import array
import random

import pytest
from tokenizers import Tokenizer

from lakeloom.llm.queries import tokenizer_path
from lakeloom.llm.shared import PieceEncoder
from tests.llm.conftest import EDGE_TEXTS


@pytest.mark.parametrize("name,blanks,width", [("byte_bpe_50k.json", True, "H"), ("word_bpe_49k.json", False, "I")])
@pytest.mark.parametrize("keep", [40, 500_000])
def test_ids_equal_those_of_whole_texts(small_docs, name, blanks, width, keep):
    rnd = random.Random(1)
    made = ["".join(rnd.choice("ab  \n\n.,'é1A\tß-ÀsS'") for _ in range(rnd.randint(1, 60))) for _ in range(3000)]
    texts = [r["text"] for r in small_docs.collect()] + EDGE_TEXTS + made
    tok = Tokenizer.from_file(tokenizer_path(name))
    tok.encode_special_tokens = True
    encoder = PieceEncoder(tokenizer_path(name), blanks, width, keep)
    got = [x for k in range(0, len(texts), 50) for x in encoder(texts[k : k + 50])]
    for t, g in zip(texts, got, strict=True):
        assert array.array(width, g).tolist() == tok.encode(t or "", add_special_tokens=False).ids, repr(t)
