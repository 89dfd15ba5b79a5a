import numpy as np

from framewright.llm import packing
from framewright.llm.queries import word_tokenizer
from framewright.llm.shingles import PIECE, word_hashes


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n))


def test_words_that_fool_polynomials_differ():
    for n in (1024, 2048, 4096):
        x = thue_morse(n)
        y = x.translate(str.maketrans("ab", "ba"))
        h, _ = word_hashes(np.frombuffer(f"{x} {y}".encode(), np.uint8))
        assert len(set(h.tolist())) == 2
        both = packing.encode_words([x.encode(), y.encode()], word_tokenizer())
        assert both == [packing._whole(t.encode(), word_tokenizer()) for t in (x, y)] and both[0] != both[1]


def test_words_are_found_in_texts_longer_than_a_piece():
    words = ["w" * 70, "Éa", "abcdefgh", "abcdefghi", "x" * (PIECE + 5)] * 3 + [f"n{i}" for i in range(PIECE // 4)]
    data = np.frombuffer(" ".join(words).encode(), np.uint8)
    h, s = word_hashes(data)
    alone = {w: word_hashes(np.frombuffer(w.upper().replace("É", "É").encode(), np.uint8))[0][0] for w in set(words[:15])}
    assert len(h) == len(words) and s[0] == 0 and len(set(h.tolist())) == len(set(words))
    assert all(alone[w] == x for w, x in zip(words[:15], h, strict=False))
