"""Token ids of whole texts by a public tokenizer, with the ids of words kept from text to text."""

from __future__ import annotations

import json
import os
import re
import sys
import types
from array import array
from collections.abc import Iterator

import numpy as np

VOCABULARY_FOLDER = "/opt/tokenizers"
#: Words kept by one Python worker, and how many of the latest go when that is full.
KEPT_WORDS, DROPPED_WORDS = 700_000, 200_000
#: The same of the pieces of words.
KEPT_PIECES, DROPPED_PIECES = 400_000, 100_000
#: Pieces encoded as one text.
PIECES_OF_A_TEXT = 128
#: Letters that no normalization changes or joins but for their case; with ASCII they make the words that are cut into pieces here.
LETTERS = "A-Za-zÀ-ÖØ-öø-ÿ"
PLAIN_WORD = re.compile(rf"[ \n]?[!-~{LETTERS}]+").fullmatch
#: How the vocabularies cut texts into pieces, and the same for such words.
CUTS_LOWER = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LOWER_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{LETTERS}]+|[0-9]|[^\s{LETTERS}0-9]+").findall
BYTE_PIECES = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{LETTERS}]+| ?[0-9]+| ?[^\s{LETTERS}0-9]+|\n").findall


def piece_edges(tokenizer, keeps_blanks: bool) -> np.ndarray | None:
    """By id: whether a token begins (byte-level: with the blank) or ends a piece; None if the vocabulary cuts texts otherwise
    than the patterns here."""
    told = json.loads(tokenizer.to_str())
    before = told["pre_tokenizer"] or {}
    if keeps_blanks:
        fits = told["normalizer"] is None and before.get("type") == "ByteLevel" and before["use_regex"] and not before["add_prefix_space"]
    else:
        first, second, *more = before.get("pretokenizers", []) + [{}, {}]
        steps = [x.get("type") for x in (told["normalizer"] or {}).get("normalizers", [])]
        fits = steps == ["NFC", "Replace", "Lowercase"] and first.get("pattern") == {"Regex": CUTS_LOWER} and second.get("type") == "ByteLevel" and not second["use_regex"] and told["model"].get("end_of_word_suffix") == "</w>" and len(more) == 2
    if not fits or told["post_processor"] or told["model"]["type"] != "BPE":
        return None
    edges = np.zeros(tokenizer.get_vocab_size(with_added_tokens=True), bool)
    for token, i in tokenizer.get_vocab(with_added_tokens=False).items():
        edges[i] = token.startswith("Ġ") if keeps_blanks else token.endswith("</w>")
    return edges


def vocabulary(name: str, folder: str | None = None) -> str:
    """Path of a public tokenizer's file."""
    if folder is None:
        try:
            import public_tokenizers

            return public_tokenizers.path(name)
        except ImportError:
            folder = VOCABULARY_FOLDER
    return f"{folder}/{name}"


class WordMemo:
    """``encode`` gives each text's ids as bytes of little-endian unsigned 32-bit integers, equal to those of
    ``Tokenizer.encode(text, add_special_tokens=False)`` on the whole text.

    A text is cut at single blanks or line ends between other characters, where neither tokenizer can join what stands
    before and after; each part is encoded once and kept. Of new parts that are plain words, the pieces that the vocabulary would
    cut them into are kept too; new pieces are encoded many at a time and told apart by their tokens. A text that has other white space at such places is encoded as a
    whole. ``keeps_blanks``: whether the blank before a word is part of its token (byte-level vocabularies) or dropped.
    A special string of the vocabulary in a text gives its own id, as that call does; a text that holds one is encoded as a
    whole.
    """

    def __init__(self, path: str, keeps_blanks: bool):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        strings = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        # in any case of letters, as some are looked up in the normalized text; what all begin with is looked for first, as that is quick
        search = re.compile("|".join(map(re.escape, strings)), re.I).search if strings else lambda text: None
        start = re.match(r"[^\w]*", os.path.commonprefix(strings))[0]
        self.holds_added = lambda text: start in text and search(text) is not None
        self.keeps_blanks = keeps_blanks
        self.kept: dict[str, bytes] = {"": b""}
        self.edges = piece_edges(self.tokenizer, keeps_blanks)
        self.pieces: dict[str, bytes] = {}

    def _ids(self, strings: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(strings, add_special_tokens=False)]

    def parts(self, text: str) -> list[str] | None:
        """A text cut at blanks and line ends; empty parts have no ids. None if byte-level ids depend on more: blanks side by side
        or at the end."""
        if not self.keeps_blanks:
            return text.replace("\n", " ").split(" ")
        if "\0" in text:
            parts = re.findall(r"[ \n]?[^ \n]+", text)
            return parts if sum(map(len, parts)) == len(text) else None
        parts = text.replace("\n", "\0\n").replace(" ", "\0 ").split("\0")
        return parts if " " not in parts and "\n" not in parts else None

    def _unsafe(self, part: str) -> bool:
        inner = part[1:] if part[0] in " \n" else part
        return inner[0].isspace() or inner[-1].isspace()

    def _keep_pieces(self, new: list[str]) -> None:
        """Keeps the ids of new pieces."""
        if self.keeps_blanks:
            alone = [p for p in new if p[0] != " "]
            self.pieces.update(zip(alone, self._ids(alone)))
            new = [p for p in new if p[0] == " "]
        groups = [new[at : at + PIECES_OF_A_TEXT] for at in range(0, len(new), PIECES_OF_A_TEXT)]
        texts = [("" if self.keeps_blanks else " ").join(g) for g in groups]
        for group, coded in zip(groups, self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)):
            ids = np.array(coded.ids, "<u4")
            at = np.flatnonzero(self.edges[ids])
            edges = [*(4 * at).tolist(), 4 * len(ids)] if self.keeps_blanks else [0, *(4 * at + 4).tolist()]
            if len(at) == len(group) and edges[0] == 0 and edges[-1] == 4 * len(ids):
                raw = ids.tobytes()
                self.pieces.update(zip(group, [raw[a:z] for a, z in zip(edges, edges[1:])]))
            else:  # a piece without a token of its own
                self.pieces.update(zip(group, self._ids(group)))

    def _keep_plain(self, new: list[str]) -> None:
        """Keeps the ids of new plain words."""
        pieces = self.pieces
        if len(pieces) > KEPT_PIECES:
            for _ in range(DROPPED_PIECES):
                pieces.popitem()
        cut = [BYTE_PIECES(w) for w in new] if self.keeps_blanks else [LOWER_PIECES(w.lower()) for w in new]
        self._keep_pieces(list({p for ps in cut for p in ps if p not in pieces}))
        self.kept.update(zip(new, [pieces[ps[0]] if len(ps) == 1 else b"".join([pieces[p] for p in ps]) for ps in cut]))

    def encode(self, texts: list[str]) -> list[bytes]:
        kept = self.kept
        if len(kept) > KEPT_WORDS:
            for _ in range(DROPPED_WORDS):  # the first seen are the most frequent
                kept.popitem()
        cut = [None if self.holds_added(t) else self.parts(t) for t in texts]
        new = list({p for parts in cut if parts for p in parts if p not in kept})
        if self.edges is not None:
            plain = [p for p in new if PLAIN_WORD(p)]
            self._keep_plain(plain)
            new = [p for p in new if p not in kept] if len(plain) < len(new) else []
        unsafe = {p for p in new if self._unsafe(p)} if self.keeps_blanks else set()
        if unsafe:
            new = [p for p in new if p not in unsafe]
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            kept.update(zip(some, self._ids(some)))
        out = []
        for text, parts in zip(texts, cut):
            if parts is None or unsafe and not unsafe.isdisjoint(parts):
                out.append(self._ids([text])[0])
            else:
                out.append(b"".join([kept[p] for p in parts]))
        return out


def memo(path: str, keeps_blanks: bool) -> WordMemo:
    """The worker's memo for a vocabulary; it lives as long as the Python worker, over all its tasks."""
    holder = sys.modules.setdefault("_factlake_word_memos", types.ModuleType("_factlake_word_memos"))
    if path not in holder.__dict__:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        holder.__dict__[path] = WordMemo(path, keeps_blanks)
    return holder.__dict__[path]


def in_slices(values: list, count: int = 256, chars: int = 1 << 20) -> Iterator[tuple[int, list]]:
    """(start, values) of slices that hold at most ``count`` texts and, but for the last of a slice, ``chars`` characters."""
    start, size = 0, 0
    for i, v in enumerate(values):
        size += len(v)
        if i + 1 - start >= count or size >= chars:
            yield start, values[start : i + 1]
            start, size = i + 1, 0
    if start < len(values):
        yield start, values[start:]
