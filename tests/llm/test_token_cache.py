"""What the word encoder of op8 asks the library for: new words only, and runs of letters without its normalizer."""

import functools

import numpy as np
import pyarrow as pa
from tokenizers import Tokenizer

from trajspark.llm import queries, token_files


@functools.cache
def library():
    return Tokenizer.from_file(queries.tokenizer_path())


def whole(texts):
    return [library().encode(t, add_special_tokens=False).ids for t in texts]


def encoded(encoder, texts):
    ids, cut = encoder.texts(pa.array(texts))
    return [ids[a:b].tolist() for a, b in zip(cut, cut[1:])]


def test_a_full_cache_keeps_common_words(monkeypatch):
    rng = np.random.default_rng(7)
    words = ["".join(chr(97 + c) for c in rng.integers(0, 26, 7)) for _ in range(4100)]
    common, rare = words[:100], words[100:]
    encoder, learned = token_files.WordEncoder(queries.tokenizer_path(), most=512), []
    learn = encoder._learn
    monkeypatch.setattr(encoder, "_learn", lambda w, keys, example: (learned.append(len(keys)), learn(w, keys, example)))
    for i in range(0, 4000, 100):
        said = [" ".join(common), " ".join(rare[i : i + 100])]
        assert encoded(encoder, said) == whole(said)
    assert sum(learned) == len(set(words))  # none twice, though the cache was full ten times


def test_runs_of_letters_pass_by_the_normalizer():
    class Counted:
        def __init__(self, tokenizer):
            self.tokenizer, self.asked = tokenizer, []

        def encode_batch_fast(self, texts, **more):
            self.asked += texts
            return self.tokenizer.encode_batch_fast(texts, **more)

    encoder = token_files.WordEncoder(queries.tokenizer_path())
    encoder.tokenizer = counted = Counted(encoder.tokenizer)
    latin = [chr(c) for c in range(0xC0, 0x100) if c not in (0xD7, 0xF7)]
    said = ["".join(latin), " ".join(latin), " ".join(f"Ab{c}cD" for c in latin), "plain Words here"]
    assert encoded(encoder, said) == whole(said)
    assert counted.asked == []
    said = ["a1 İx ×÷ é É́ ſt don't", "42"]
    assert encoded(encoder, said) == whole(said)
    assert counted.asked


def test_a_word_without_ids_ends_the_pool():
    encoder = token_files.WordEncoder(queries.tokenizer_path())
    for said in (["\u2003"], ["\u2003 \u2003a", "\u2003"], ["\u2003 \u2002", "b"]):
        assert encoded(encoder, said) == whole(said) == encoded(encoder, said)


def test_many_random_texts(monkeypatch):
    rng = np.random.default_rng(11)
    marks = [*"abcAZ019 .,'-\n\t~^", *"éÉ÷×ßÀÿµª中\u2003\u0301", "<|", "<", "|", "'s", "x" * 9, "y" * 300, "É" * 5, "\x00"]
    monkeypatch.setattr(token_files, "_STRETCH", 64, raising=False)
    for most in (8, 200, 1 << 12):
        encoder = token_files.WordEncoder(queries.tokenizer_path(), most=most)
        for _ in range(150):
            said = ["".join(rng.choice(marks, rng.integers(0, 30))) for _ in range(rng.integers(1, 25))]
            assert encoded(encoder, said) == whole(said)
