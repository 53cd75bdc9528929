"""Memory of one block's parse, and ids of words that skip the tokenizer's first steps."""
import random
import tracemalloc

import numpy as np
import public_tokenizers
import zstandard

from floetrack.llm import blocks as B
from floetrack.llm import packing, pfp


def test_a_parse_holds_one_word_a_byte():
    n = 2 << 20
    data = np.random.default_rng(1).integers(97, 123, n, dtype=np.uint8).tobytes()
    b = B.Block(0, [1], [True], [n], zstandard.compress(data))
    pfp.powers(n + 1)
    tracemalloc.start()
    p = pfp.Parse(b, 240, 16, 20)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert peak < 14 * n, peak / n
    assert p.hash(np.array([70_000]), np.array([70_400])) != p.hash(np.array([70_001]), np.array([70_401]))
    twice = B.Block(0, [1], [True], [2 * n], zstandard.compress(data * 2))
    q = pfp.Parse(twice, 240, 16, 20)
    at = np.array([0, 65_500, 65_536, n - 500])
    assert (q.hash(at, at + 400) == q.hash(at + n, at + n + 400)).all() and (q.hash(at, at + 400) == p.hash(at, at + 400)).all()


def test_plain_words_have_the_tokenizers_ids():
    path = public_tokenizers.path("word_bpe_49k.json")
    tok, known = packing._encoder(path)
    assert known
    rng = random.Random(3)
    ws = list({"".join(rng.choice("abcdet'éßöøÿ÷×ñ.,;:!?$0Á") for _ in range(rng.randint(1, 7))).encode() for _ in range(3000)}) + [b"it's", "ça.".encode(), b"$$$"]
    plain = [w for w in ws if packing.PLAIN.fullmatch(w)]
    assert 100 < len(plain) < len(ws)
    want = [np.array(e.ids, "<u4").tobytes() for e in tok.encode_batch_fast([w.decode() for w in ws], add_special_tokens=False)]
    assert packing.encode_words(path, ws) == want
