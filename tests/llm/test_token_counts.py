"""Token counts against the library's own encoding of whole texts."""

import collections

import numpy as np
import public_tokenizers
import pytest
from test_operators_llm import DOCS, corpus
from tokenizers import Tokenizer

from textmill.llm import token_counts

PATH = public_tokenizers.path("byte_bpe_50k.json")
END = "<|endoftext|>"
ODD = [
    f"{END}", f"a{END}", f" {END} b", f"{END}{END}\n{END}'s", f"<|endof{END}text|>", "<|endof", "text|>", f"don{END}'t  {END}   x",
    "can't'll 're  \t\n x", "a͸b Ᲊᲊx Ɤ1", "x y　 z  q", "᠎a \x1c\x1d b\x85c", "1²③ ४५ 12345", "​﻿😀👍🏽 é é", "a" * 5000, " " * 3000 + "b", "\n" * 999, "東京都 " * 40, "ab12" * 700,
]


def brute(rows, limit):
    library = Tokenizer.from_file(PATH)
    sizes = [len(library.encode(t or "", add_special_tokens=False).ids) for _, t in rows]
    return collections.Counter((i, len((t or "").encode()), n, n > limit) for (i, t), n in zip(rows, sizes, strict=True))


@pytest.fixture(scope="module")
def rows():
    return [r[:2] for r in corpus(11)] + [(1000 + i, t) for i, t in enumerate(ODD)] + [(5, END), (5, None), (None, END)]


@pytest.mark.parametrize("dictionary", [1_500_000, 60, 0])
def test_counts(spark, rows, dictionary):
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS).withColumnsRenamed({"lang": "n", "source": "at"}).repartition(3)
    got = token_counts.count_tokens(docs, PATH, 100, dictionary)
    assert got.columns == ["doc_id", "n_bytes", "n_tokens", "over_limit"]
    assert collections.Counter(map(tuple, got.collect())) == brute(rows, 100)


def test_hot_word_and_copies(spark):
    rows = [(i, "hot hot hot" if i % 3 == 0 else f"hot once{i}") for i in range(900)]
    docs = spark.createDataFrame([(*r, "en", "s", 0) for r in rows], DOCS).repartition(5)
    assert collections.Counter(map(tuple, token_counts.count_tokens(docs, PATH, 3, 2).collect())) == brute(rows, 3)


def test_empty_table(spark):
    assert token_counts.count_tokens(spark.createDataFrame([], DOCS), PATH).collect() == []


def test_frequencies_tell_words_with_one_equal_hash_apart():
    a, b = np.array([7, 7, 9, 7, 7], np.uint64), np.array([1, 2, 3, 1, 1], np.uint64)
    ka, kb, doc, word, times = token_counts.frequencies(np.array([0, 0, 0, 0, 1]), a, b)
    assert sorted(zip(doc.tolist(), ka[word].tolist(), kb[word].tolist(), times.tolist(), strict=True)) == [(0, 7, 1, 2), (0, 7, 2, 1), (0, 9, 3, 1), (1, 7, 1, 1)]


def test_other_files_are_refused():
    with pytest.raises(ValueError, match="byte-level"):
        token_counts.added_tokens(public_tokenizers.path("word_bpe_49k.json"))


def test_classes_are_the_library_s_own():
    table = token_counts.library_classes()
    assert table[ord("é")] == 0 and table[ord("²")] == 1 and table[ord("!")] == 2 and table[0x3000] == 3 and table[0x1C] == 2 and table[0x85] == 3
