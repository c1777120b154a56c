"""Edit-aware counts against encoding the whole text again."""

import random

import pytest
from pyspark.sql import functions as F

from quern.llm import token_counts as T
from quern.llm.tokens import encoder

RNG = random.Random(11)
HAN = "".join(chr(RNG.randint(0x4E00, 0x4E00 + 600)) for _ in range(4000))
TEXTS = {
    "han": HAN,
    "lines": "word\n" * 800,
    "one letter": "x" * 4000,
    "letters": "".join(RNG.choices("etaoinshrdlu", k=4000)),
    "digits": "".join(RNG.choices("0123456789", k=3000)),
    "signs": "".join(RNG.choices("!#$%&()*+-=", k=3000)),
    "quotes": "'".join("ll" * 20 for _ in range(60)),
    "mixed": "".join(RNG.choice(["漢字", "かな", "abc", " ", "  ", "\n", "　", "é", "12", "'s", "!!", "한국", "\x1c", "\xa0", "ไทย"]) for _ in range(1500)),
    "marks": "".join(RNG.choice(["<|endoftext|>", "<|endof", "text|>", "aaaa" * 9, " "]) for _ in range(300)),
}


@pytest.mark.parametrize("name", TEXTS)
@pytest.mark.parametrize("leaf", [16, 64])
def test_equals_full_count(name, leaf):
    enc, rng, text = encoder(), random.Random(7), TEXTS[name]
    counted = T.CountedText(text, enc, leaf)
    assert counted.text == text and counted.n_tokens == len(enc.ids(text))
    for _ in range(150):
        a = rng.randint(0, len(text))
        b = min(len(text), a + rng.choice([0, 0, 1, 2, 9, 40]))
        k = rng.randint(0, len(HAN) - 9)
        new = rng.choice(["", " ", "  \n", "word", " don't", "'", "l", "é漢", HAN[k : k + 7], "xx", "7", "!", "\x1c", "<|endoftext|>", "<|", text[a : a + 20]])
        counted.edit(a, b, new)
        text = text[:a] + new + text[b:]
        assert counted.n_chars == len(text) and counted.n_tokens == len(enc.ids(text)), (name, a, b, new)
    assert counted.text == text


@pytest.mark.parametrize("name", ["han", "lines", "one letter", "letters", "digits", "signs"])
def test_edits_encode_little(name):
    """One character changed in 40,000 encodes again a few leaves, whatever the script; but in a run of one letter
    the tokens behind it all shift."""
    counted = T.CountedText(TEXTS[name] * 10, encoder())
    before = counted.encoded
    for k in range(20):
        counted.edit(1000 + 1500 * k, 1001 + 1500 * k, "z" if k % 2 else "字")
    share = (counted.encoded - before) / 20 / counted.n_chars
    print(name, "encoded again by an edit:", round(share, 4))
    assert share < (3 if name == 'one letter' else 0.08)


def test_emptied_and_filled_again():
    counted = T.CountedText("abc def", encoder())
    counted.edit(0, 99, "")
    assert (counted.n_chars, counted.n_tokens, counted.text) == (0, 0, "")
    counted.edit(5, 9, "new text")
    assert counted.text == "new text" and counted.n_tokens == 2
    assert T.CountedText("", encoder()).n_tokens == 0


def test_op4_whole_table(spark, sf_dir):
    enc = encoder()
    texts = {r["doc_id"]: r["text"] or "" for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    got = T.op4_token_counts(spark, sf_dir).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(texts)
    for r in got:
        text = texts[r["doc_id"]]
        n = len(text)
        assert (r["n_chars"], r["n_tokens"]) == (n, len(enc.ids(text)))
        for a, b, new in ((n // 4, n // 4 + 16, ""), (n // 2, n // 2, " [edited] "), (max(0, n - 32), n + 32, "The end.")):
            a = min(a, len(text))  # places are moved to the end of the text that earlier edits left
            text = text[:a] + new + text[max(a, min(b, len(text))) :]
        assert (r["edited_chars"], r["edited_tokens"]) == (len(text), len(enc.ids(text)))


def test_rows_and_edits(spark):
    docs = spark.createDataFrame([(1, "one two", "x"), (1, "one two", "y"), (2, None, "z"), (None, "no id", "w")], "doc_id long, text string, edits string")
    edits = spark.createDataFrame([(1, 2, 0, 3, "1"), (1, 1, 0, 0, "a "), (2, 1, 0, 9, "new"), (9, 1, 0, 0, "none")], "doc_id long, nth int, start long, end long, replacement string")
    got = T.edited_counts(T.with_edits(docs, edits)).collect()
    assert sorted(((r["doc_id"] or 0), r["n_chars"], r["edited_chars"]) for r in got) == [(0, 5, 5), (1, 7, 7), (1, 7, 7), (2, 0, 3)]
    empty = docs.limit(0).select("doc_id", "text", F.lit(None).cast("array<struct<start:long,end:long,replacement:string>>").alias("edits"))
    assert T.edited_counts(empty).collect() == []
