"""Ids put together from the pieces of words equal those of the whole text."""

import random
from array import array

import pytest
from tokenizers import Tokenizer

from factlake.llm.tokens import WordMemo, vocabulary

ODD = [
    "don't They'RE 'sam it's' ''s DON'T we'll'd", "a  b", " a", "a ", "\n\na\n b \nc", "", " ", "\0 a \0\0b", "tab\tand\x0bmore \x85 x", "x y", "\x1c a\x1d",
    "12345 1a2b 3.14,15 -7%", "Größe ÉCOLE ñandú straße À·Ö×÷ªº", "é ́a ñ", "İstanbul ΑΣ ς", "漢字 かな 한글 x", "🙂🙂 ok🙂", "</w> a</w>b <w/>", "Ġx Ċ", "²³ Ⅷ ½", "a​b", "İ",
    "<|endoftext|> end", "<| endoftext |>", "x" * 5000 + " " + "ab1!" * 800, "word,word.word;word", "$$$ ### a$$$b",
]


@pytest.mark.parametrize("name, keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_pieces_give_the_ids_of_the_whole_text(name, keeps):
    draw = random.Random(7)
    some = "aeionrtslBCéèßñÖ'.,!-$#019 \n  ́ \té漢²"
    texts = ODD + ["".join(draw.choices(some, k=draw.randint(0, 60))) for _ in range(1500)]
    plain, memo = Tokenizer.from_file(vocabulary(name)), WordMemo(vocabulary(name), keeps)
    assert memo.edges is not None
    for text, got in zip(texts * 2, memo.encode(texts) + memo.encode(texts)):
        assert list(array("I", got)) == plain.encode(text, add_special_tokens=False).ids, text


@pytest.mark.parametrize("name, keeps", [("word_bpe_49k.json", False), ("byte_bpe_50k.json", True)])
def test_new_words_are_not_encoded_one_by_one(name, keeps, monkeypatch):
    memo, alone = WordMemo(vocabulary(name), keeps), []
    one_by_one = memo._ids
    monkeypatch.setattr(memo, "_ids", lambda strings: (alone.extend(strings), one_by_one(strings))[1])
    memo.encode([" ".join(f"wo{chr(97 + i % 26)}{chr(97 + i // 26)}, Größe." for i in range(600))])
    assert len(alone) < 10
