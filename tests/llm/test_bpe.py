"""BPE encoding against the library that defines the format."""

import gc
import random

import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from linkspark.llm import bpe

PATH = public_tokenizers.path("word_bpe_49k.json")
PIECES = [
    "a", "b", "E", "É", "é", "ß", "İ", "Σ", "ς", " ", "\n", "\t", "\x1c", "\x85", "\xa0", "'s", "'LL", "1", "½", "!", "</w>",
    "<|endoftext|>", "<|EndOfText|>", "<|", "中文", "😀", "é", "the", "ing", "ǅ", "\x00", "　", "token", "<|startoftext|>",
]


@pytest.fixture(scope="module")
def library():
    t = Tokenizer.from_file(PATH)
    t.no_truncation()
    t.no_padding()
    return t


@pytest.fixture(scope="module")
def vocabulary():
    with open(PATH, encoding="utf-8") as f:
        return bpe.Vocabulary(f.read())


def texts():
    pick = random.Random(3)
    out = ["", " ", "a" * 3000, "!" * 500, "ab" * 4000, "Don't stop"]
    out += ["".join(pick.choice(PIECES) for _ in range(pick.randint(0, 40))) for _ in range(1500)]
    return out + ["".join(pick.choice("abcdehinorst") for _ in range(pick.randint(1, 40))) for _ in range(4000)]


def test_ids_and_decoding_equal_the_library(library, vocabulary):
    for text in texts():
        want = library.encode(text, add_special_tokens=False).ids
        assert vocabulary.encode(text) == want, text
        assert vocabulary.decode(want) == library.decode(want, skip_special_tokens=False), text


def test_frame(spark, library):
    rows = [(1, "Hello world"), (1, "Hello world"), (2, None), (None, "x"), (3, ""), (4, "word " * 30_000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'x' AS n_tokens", "1 AS _text")
    got = bpe.digests(docs, PATH, ["doc_id"]).collect()
    assert sorted((str(r.doc_id), r.n_tokens) for r in got) == [("1", 2), ("1", 2), ("2", 0), ("3", 0), ("4", 30_000), ("None", 1)]
    assert {r.ids_sha256 for r in got if r.n_tokens == 0} == {bpe._sha("")}
    ids = bpe.encode(docs, PATH, ["doc_id"]).where("doc_id = 1").first().ids
    assert ids == library.encode("Hello world", add_special_tokens=False).ids
    assert bpe.digests(docs.limit(0), PATH, ["doc_id"]).count() == 0


def test_workers_keep_no_vocabulary(spark):
    docs = spark.createDataFrame([(i, f"some words {i}") for i in range(64)], "doc_id long, text string").repartition(8)
    assert bpe.digests(docs, PATH, ["doc_id"]).count() == 64
    assert len(bpe.encode(docs, PATH, ["doc_id"]).collect()) == 64

    def held(batches):
        for _ in batches:
            pass
        gc.collect()
        yield pa.RecordBatch.from_arrays([pa.array([sum(type(x).__name__ == "Vocabulary" for x in gc.get_objects())])], names=["n"])

    # other work, on the same worker processes
    assert {r.n for r in spark.range(64).repartition(8).mapInArrow(held, "n long").collect()} == {0}
