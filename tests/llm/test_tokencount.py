import random

import pytest
from tokenizers import Tokenizer

from tidemark.llm import tokencount
from tidemark.llm.tables import tokenizer

PATH = tokenizer("byte_bpe_50k.json")
ODD = [
    "",
    " ",
    "   ",
    "\n\n a  b\t\tc \n d\r\n\r\n  e  ",
    "it's we're 'tis ''s 'stan !'s a's's I'LL don't 's' x 's y ab' 've'll",
    "<|endoftext|>hello <|endoftext|><|endoftext|>  x <|endoftext|> ",
    "İstanbul ǅ ﬁ é ½ ² ١٢٣ 한국어 日本語 😀👍🏽 \x1c\x1d a\x85b\xa0c​d 　e",
    "  12 345 $$ !!  --\n--\n\n--",
    "a \nb\n c",
    "x" * 400,
]


@pytest.fixture(scope="module")
def counter():
    return tokencount.PretokenCounter(PATH)


def wanted(texts):
    library = Tokenizer.from_file(PATH)
    return [len(library.encode(t or "", add_special_tokens=False).ids) for t in texts]


def test_counts_are_the_librarys(counter):
    rng = random.Random(5)
    texts = ODD + ["".join(rng.choices("aehino rst'é!9 \n\t ", k=rng.randrange(1, 120))) for _ in range(800)]
    assert tokencount.count_tokens(texts, counter) == wanted(texts)


def test_chunks_splice_exactly(counter):
    rng = random.Random(6)
    texts = ["".join(rng.choices("aehino rst'é!9 \n\t ", k=2000)) for _ in range(20)]
    texts += ["".join(rng.choices("aehinorstlmd", k=3000)), "=" * 3000, "ab" * 1500, "日本語" * 800, "9" * 2500, "😀" * 900]
    texts += ["".join(rng.choices("aehinorst9!'", k=3000)), "".join(rng.choices("aehinorstlmd", k=900)) + " the " + "q" * 900]
    texts += [("word " * 30 + "<|endoftext|>") * 20, " " * 1500 + "x" + "\n" * 900]
    assert tokencount.count_tokens(texts, counter, chunk=100, overlap=16) == wanted(texts)
    assert tokencount.count_tokens(texts, counter, chunk=64, overlap=4) == wanted(texts)


def test_rows(spark):
    rows = [(i, t, "x") for i, t in enumerate([None, *ODD])] + [(1, "", "x"), (None, "a b", "x"), (50, "lorem ipsum " * 30_000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens string")
    got = tokencount.token_counts(docs, PATH).collect()
    n = wanted([r[1] for r in rows])
    want = [(r[0], len((r[1] or "").encode()), k, k > 1024) for r, k in zip(rows, n)]
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str)
    assert tokencount.token_counts(docs.limit(0), PATH).count() == 0


def test_long_words_whose_polynomial_hashes_collide(counter):
    thue = lambda n, x: "".join(x[i.bit_count() % 2] for i in range(n))
    texts = [thue(n, x) for n in (1024, 2048, 4096, 8192) for x in ("ab", "ba", "tq", "qt")]
    for some in (texts, texts[::-1], [" ".join(texts)]):
        assert tokencount.count_tokens(some, counter) == wanted(some)
