import random
from collections import Counter

import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lodestone.llm import token_counts
from lodestone.llm.token_counts import Tokens, count_tokens, margin, op12_token_counts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer

    return Tokenizer.from_file(PATH)


def adversarial(n):
    rng = random.Random(n)
    parts = ["'s", "'re", "'", "re", " ", "  ", "\n", "\n\n \t", "<|endoftext|>", "<|endo", "ftext|>", "word", " Word", "é", "日本語", "😀", "12", "½", "a" * 90, "!" * 50, " " * 70, "'ll", "x", "́", " ", " ", "ǅ", "\x00"]
    return ["".join(rng.choice(parts) for _ in range(rng.randrange(80))) for _ in range(n)]


def frame(spark, rows):
    return spark.createDataFrame([(i, t, 3, "x") for i, t in rows], "doc_id long, text string, n_tokens long, row string").repartition(3)


@pytest.mark.parametrize(("huge", "chunk", "overlap"), [(0, 40, 40), (10, 64, 20), (0, 200, 30), (1 << 30, 64, 20)])
def test_counts_equal_the_library_s(spark, library, huge, chunk, overlap):
    rows = list(enumerate(adversarial(150))) + [(None, "a b"), (3, "again " * 90), (3, "again " * 90), (500, None), (501, ""), (502, "z" * 3000), (503, " " * 3000), (504, "<|endoftext|>" * 60), (505, "don't we'll " * 200)]
    found = count_tokens(frame(spark, rows), PATH, limit=50, huge=huge, chunk=chunk, overlap=overlap).collect()
    want = [(i, len((t or "").encode()), n := len(library.encode(t or "", add_special_tokens=False).ids), n > 50) for i, t in rows]
    assert Counter(map(tuple, found)) == Counter(want)


def test_texts_without_a_common_start_are_widened(spark, library):
    text = "ab" * 4000 + " and so on"
    huge = spark.createDataFrame([(1, 7, 8010, text)], "row long, doc_id long, n_bytes long, text string")
    once = token_counts._spliced(token_counts._summaries(token_counts._chunks(huge, 64, 20), PATH, 64, 20, margin(PATH))).first()
    assert once["n_tokens"] is None
    assert token_counts.huge_counts(huge, PATH, margin(PATH), 64, 20).first()["n_tokens"] == len(library.encode(text, add_special_tokens=False).ids)


def test_other_tokenizers_encode_whole_texts(spark):
    import sentencepiece
    from tokenizers import Tokenizer

    texts = [t for t in adversarial(40) if "\x00" not in t]
    words, model = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
    assert margin(words) is None and margin(model) is None and margin(PATH) == 17
    for path, count in ((words, lambda t, x=Tokenizer.from_file(words): len(x.encode(t, add_special_tokens=False).ids)), (model, lambda t, x=sentencepiece.SentencePieceProcessor(model_file=model): len(x.encode(t)))):
        found = count_tokens(frame(spark, list(enumerate(texts))), path, huge=5).collect()
        assert {r["doc_id"]: r["n_tokens"] for r in found} == {i: count(t) for i, t in enumerate(texts)}


def test_remembered_pre_tokens_equal_whole_texts(library):
    tokens, texts = Tokens(PATH), adversarial(400)
    assert tokens.counts(texts) == [len(e.ids) for e in library.encode_batch(texts, add_special_tokens=False)]
    every = ["".join(map(chr, range(a, a + 64))) for a in range(0, 0x3400, 64)]
    assert tokens.counts(every) == [len(e.ids) for e in library.encode_batch(every, add_special_tokens=False)]


def test_empty_table_and_whole_documents(spark, library):
    assert count_tokens(frame(spark, []), PATH).collect() == []
    docs = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    found = op12_token_counts(spark, SF)
    assert found.filter(F.col("over_limit") != (F.col("n_tokens") > 1024)).isEmpty()
    assert {r["doc_id"]: r["n_tokens"] for r in found.collect()} == {i: len(library.encode(t or "", add_special_tokens=False).ids) for i, t in docs.items()}
