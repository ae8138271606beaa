"""Token ids exactly as the ``tokenizers`` library gives them, with each distinct piece encoded once.

A byte-pair tokenizer first splits a text into pieces (words, digits, punctuation runs) and then encodes each piece on
its own. ``PieceEncoder`` splits a text itself, asks the library only for pieces it has not met, and joins the
remembered ids. It does so only for texts made of characters whose class, case and composition are the same in every
Unicode version (see ``_PLAIN``) and without strings of special tokens; all other texts go through the library whole.
Either way the ids are the library's.
"""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from collections.abc import Iterator

import numpy as np
from tokenizers import Tokenizer

#: Characters whose letter, number and space classes and lower case don't depend on the Unicode version.
_PLAIN = r"\t\n\r -~¡-¬®-įĲ-ž‐-―‘-„•…€"
_LETTER = r"A-Za-zªµºÀ-ÖØ-öø-ɏ"
_NUMBER = r"0-9²³¹¼-¾"

#: How the two kinds of public tokenizers split a text, over plain characters.
_SPLITS = {
    "byte": re.compile(
        rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_LETTER}]+| ?[{_NUMBER}]+| ?[^\s{_LETTER}{_NUMBER}]+|\s+(?!\S)|\s+"
    ),
    "word": re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+"),
}
_BYTE_LEVEL = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True}
_WORDS = {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}
_LOWER = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
#: The (normalizer, pre_tokenizer) entries of the files that have these splits.
_LAYOUTS = {
    "byte": [(None, _BYTE_LEVEL | {"use_regex": True})],
    "word": [
        (
            {"type": "Sequence", "normalizers": _LOWER},
            {"type": "Sequence", "pretokenizers": [{"type": "Split", "pattern": _WORDS, "behavior": "Removed", "invert": True}, _BYTE_LEVEL | {"use_regex": False}]},
        )
    ],
}
#: The letters in which byte-level tokenizers write bytes: visible ones as they are, the others from U+0100 on.
_VISIBLE = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
_LETTERS = {b: chr(b) for b in _VISIBLE} | {b: chr(0x100 + n) for n, b in enumerate(b for b in range(256) if b not in _VISIBLE)}
_ODD = re.compile(f"[^{_PLAIN}]")
#: Pieces of at most ``LONG`` characters are remembered, so many at most, and so many longer ones; then a worker forgets them and starts anew.
MAX_PIECES, LONG, MAX_LONG = 400_000, 10, 50_000


class _Known(dict):
    """The ids of each piece, packed; a piece that isn't known is encoded by the library's model."""

    def __init__(self, library: Tokenizer) -> None:
        self.tokenize, self.long = library.model.tokenize, {}

    def __missing__(self, piece: str) -> bytes:
        store, most = (self.long, MAX_LONG) if len(piece) > LONG else (self, MAX_PIECES)
        if (ids := store.get(piece)) is None:
            text = piece if piece.isascii() else piece.encode().decode("latin-1")
            ids = array("I", [t.id for t in self.tokenize(text.translate(_LETTERS))]).tobytes()
            if len(store) >= most:
                store.clear()
            store[piece] = ids
        return ids


class PieceEncoder:
    """Encodes texts with a tokenizer file; keeps the ids of each piece as packed little-endian unsigned 32-bit ints.

    A null text counts as an empty one and has no ids. No special tokens are added; special strings inside a text are
    what the library makes of them by default.
    """

    def __init__(self, path: str) -> None:
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        # only the two layouts above are split here, told by their whole entries; any other tokenizer always goes through the library
        plain_model = spec["model"].get("type") == "BPE" and not spec["model"].get("dropout") and not spec["model"].get("ignore_merges")
        layout = (spec.get("normalizer"), spec.get("pre_tokenizer"))
        self.kind = next((kind for kind, known in _LAYOUTS.items() if plain_model and layout in known), None)
        self.special = [x["content"] for x in spec.get("added_tokens", [])]
        self.known = _Known(self.library)

    def _plain(self, text: str) -> bool:
        return self.kind is not None and not _ODD.search(text) and not any(s in text for s in self.special)

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _pieces(self, text: str) -> list[str]:
        return _SPLITS[self.kind].findall(text.lower() if self.kind == "word" else text)

    def encode_many(self, texts: list[str | None]) -> list[bytes]:
        """The packed ids of each text."""
        get = self.known.__getitem__
        return [(b"".join(map(get, self._pieces(t))) if self._plain(t) else self._whole(t)) if t else b"" for t in texts]

    def encode(self, text: str | None) -> bytes:
        """The ids of one text, packed."""
        return self.encode_many([text])[0]

    def batches(self, texts: list[str | None], size: int = 128) -> Iterator[bytes]:
        """The packed ids of each text in turn, some texts at a time."""
        for at in range(0, len(texts), size):
            yield from self.encode_many(texts[at : at + size])


def id_width(path: str, *more: int) -> str:
    """``<u2`` if all ids of a tokenizer file (and ``more`` ids) fit in two bytes, else ``<u4``."""
    library = Tokenizer.from_file(path)
    largest = max([*library.get_vocab(with_added_tokens=True).values(), *more], default=0)
    return "<u2" if largest < 1 << 16 else "<u4"


_ENCODERS: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The encoder of this Python worker; built once."""
    if path not in _ENCODERS:
        _ENCODERS[path] = PieceEncoder(path)
    return _ENCODERS[path]


def file_digest(path: str) -> str:
    """Names the tokenizer's version: the digest of its file."""
    with open(path, "rb") as file:
        return hashlib.sha256(file.read()).hexdigest()
