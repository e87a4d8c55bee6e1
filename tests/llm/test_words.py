"""op9's encoder: words that a task encoded aren't encoded again, whatever stands after them."""

import numpy as np
import public_tokenizers
import pyarrow as pa

from linkspark.llm import tokens


def test_words_are_encoded_once_a_worker(monkeypatch):
    path = public_tokenizers.path(tokens.TOKENIZER)
    asked, together = [], tokens.Encoder.together
    monkeypatch.setattr(tokens.Encoder, "together", lambda self, words: asked.append(sorted(words)) or together(self, words))
    tokens._encoder.cache_clear()
    ends = ["\xa0", "\x85", "\x1c", "\t", "　", "́", "日", "ɐ", "ɏ", "é", "ª", "×", "'s", "1", "🙂", "\n", "<|endoftext|>"]
    odd = ["", " ", None, "a a. a, a., b", *(f"q {x}{y}{stop} z" for x in ("", "w", "é") for y in ends for stop in ("", ".", ".,", " "))]
    tokenizer = tokens._tokenizer(path)
    want = [np.array(tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in odd]
    assert tokens._encoder(path).encode(pa.array(odd)) == want and {"a", "b"} <= set(asked[0])
    assert "a." not in asked[0]
    assert tokens._encoder(path).encode(pa.array(odd)) == want and asked[1] == []  # as the worker's next task does
    known = len(tokens._encoder(path).known)
    monkeypatch.setattr(tokens, "MAX_KEPT", 0)
    more = ["x not kept", "x not. kept, a", *odd]
    want = [np.array(tokenizer.encode(x or "", add_special_tokens=False).ids, "<u4").tobytes() for x in more]
    assert tokens._encoder(path).encode(pa.array(more)) == want and len(tokens._encoder(path).known) == known
    assert tokens._encoder(path).encode(pa.array([], pa.string())) == []
    tokens._encoder.cache_clear()
