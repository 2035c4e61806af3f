import hashlib
import random

import numpy as np
import pytest
from tokenizers import Tokenizer

from tidemark.llm import automaton
from tidemark.llm.tables import tokenizer

PATH = tokenizer("word_bpe_49k.json")
ODD = [
    None,
    "",
    "  ",
    "it's we're 'tis ''s 'stan !'s a's's I'LL don't 's' x 's y ab'",
    "<|endoftext|>hello <|startoftext|><|endoftext|> x<|endoftext",
    "ΣΑΣ ΟΔΟΣ İstanbul ǅ ﬁ é é ½ ² ١٢٣ 한국어 日本語 😀👍🏽 \x1c\x1d a\x85b\xa0c​d",
    "a" * 500,
    "1234567 12.5e-3 $$$$!!!???---___",
    "w" * 30_000,
    "hello\nworld\r\n\tand  more",
    "naïve Ünïcödé \u0000y",
]


def wanted(text, library):
    ids = library.encode(text or "", add_special_tokens=False).ids
    shown = library.decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(shown.encode()).hexdigest()


def test_encoding_is_the_librarys(spark):
    rng = random.Random(2)
    texts = ODD + ["".join(rng.choices("aehinorst 'é!9\n", k=rng.randrange(1, 200))) for _ in range(300)]
    rows = [(i, t, 1) for i, t in enumerate(texts)] + [(0, ODD[3], 1), (None, "null id", 1)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens int")
    library = Tokenizer.from_file(PATH)
    got = automaton.encode_and_decode(docs, PATH).collect()
    want = [(i, *wanted(t, library)) for i, t, _ in rows]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)


def thue_morse(n, letters):
    return "".join(letters[i.bit_count() % 2] for i in range(n))


def test_long_words_whose_polynomial_hashes_collide():
    library, encoder = Tokenizer.from_file(PATH), automaton.WordEncoder(PATH)
    texts = [thue_morse(n, x) for n in (1024, 2048, 4096, 8192) for x in ("ab", "ba", "tq", "qt")]
    for some in (texts, texts[::-1], [" ".join(texts)], *[[t] for t in texts]):
        want = [library.encode(t, add_special_tokens=False).ids for t in some]
        assert [ids.tolist() for ids, _ in encoder(some)] == want


def test_no_rows(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert automaton.encode_and_decode(docs, PATH, keep_ids=True).count() == 0


def test_gadgets_on_a_small_vocabulary():
    vocab = {t: i for i, t in enumerate(["a", "b", "a</w>", "b</w>", "aa", "ab", "aab", "aa</w>", "aab</w>"])}
    made = automaton.TokenAutomaton(vocab, [("a", "a"), ("a", "b"), ("aa", "b"), ("a", "a</w>"), ("aa", "b</w>")])

    def merge(word):
        parts = [*word[:-1], word[-1] + "</w>"]
        for pair in [("a", "a"), ("a", "b"), ("aa", "b"), ("a", "a</w>"), ("aa", "b</w>")]:
            i = 0
            while i + 1 < len(parts):
                if (parts[i], parts[i + 1]) == pair:
                    parts[i : i + 2] = ["".join(pair)]
                i += 1
        return parts

    for n in range(1, 9):
        for k in range(2**n):
            word = "".join("ab"[k >> i & 1] for i in range(n))
            ids = made.encode(word)
            assert [made.labels[i] for i in ids] == merge(word), word
            assert made.decode(ids) == " ".join(merge(word))


def test_a_path_is_needed():
    made = automaton.TokenAutomaton({"a": 0, "a</w>": 1}, [])
    with pytest.raises(ValueError):
        made.encode("ax")
