"""The queries' token ids of texts that hold a special string of the vocabulary."""

import zlib
from array import array

from tokenizers import Tokenizer

from factlake.llm import packing, registry, token_output
from factlake.llm.common import DOCUMENTS
from factlake.llm.tokens import WordMemo, vocabulary

TEXTS = ["a <|endoftext|> b", "plain text", "x<|endoftext|>y  z", "<|startoftext|> one", "<|ENDOFTEXT|> <| endoftext|>", "", "tail <|endoftext|>"]


def plain_ids(name, text):
    return Tokenizer.from_file(vocabulary(name)).encode(text, add_special_tokens=False).ids


def test_memo_with_added_tokens():
    assert len(plain_ids("byte_bpe_50k.json", TEXTS[0])) == 4 and len(plain_ids("word_bpe_49k.json", TEXTS[0])) == 3
    for name, keeps in (("byte_bpe_50k.json", True), ("word_bpe_49k.json", False)):
        memo = WordMemo(vocabulary(name), keeps)
        for text, got in zip(TEXTS * 2, memo.encode(TEXTS * 2)):
            assert list(array("I", got)) == plain_ids(name, text), text


def test_queries_give_added_tokens(spark, tmp_path):
    spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(TEXTS)], DOCUMENTS).write.parquet(f"{tmp_path}/documents.parquet")
    crc = lambda ids, end: (len(ids) + 1, zlib.crc32(array("I", [*ids, end]).tobytes()))
    packed = {r["doc_id"]: (r["length"], r["ids_crc32"]) for r in registry.QUERIES["op1_pack"](spark, str(tmp_path)).collect()}
    assert packed == {i: crc(plain_ids("byte_bpe_50k.json", t), packing.END_ID) for i, t in enumerate(TEXTS)}
    written = {r["doc_id"]: (r["n_tokens"], r["ids_crc32"]) for r in registry.QUERIES["op5_token_output"](spark, str(tmp_path)).collect()}
    assert written == {i: crc(plain_ids("word_bpe_49k.json", t), token_output.END_ID) for i, t in enumerate(TEXTS)}
