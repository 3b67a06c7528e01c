"""Exact byte-level BPE for pre-tokens, driven by a tokenizers JSON file.

``PieceCoder`` gives the ids that the tokenizers library gives for a *piece*: a
part of a text that no pre-token leaves. A pre-token that is a vocabulary string
encoding alone as one token is looked up directly (the whole-token shortcut,
proved by ``whole_tokens`` with the library itself); the others are merged by a
rank table built from the same merges. Pieces that hold a special string, or a
character that is not of one class in all Unicode tables since 3.2 (the library's
tables and Python's are of different versions), go to the library.

The end-of-word suffix of word-end vocabularies is written as the byte 0xFF,
which no UTF-8 text holds; joining it to the last byte has the first rank, so
merging starts from the same symbols as the library's.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata
from functools import lru_cache

import regex

#: Pre-token patterns as the vocabulary files state them (fixed values).
BYTE_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def read_bytes(path: str) -> bytes:
    """The vocabulary file, read on the driver and sent to workers by broadcast: it has a fixed size."""
    with open(path, "rb") as f:
        return f.read()


def library_tokenizer(data: bytes):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    from tokenizers import Tokenizer

    return Tokenizer.from_str(data.decode("utf-8"))


def byte_letters() -> dict[str, int]:
    """The printable letter that stands for each byte in byte-level vocabularies, inverted."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {b: chr(b) for b in shown}
    letters |= {b: chr(256 + i) for i, b in enumerate(x for x in range(256) if x not in letters)}
    return {c: b for b, c in letters.items()}


@lru_cache(maxsize=1)
def young_characters() -> re.Pattern:
    """Finds a character that Unicode 3.2 did not know, or put into another class than today: tables may differ on it."""
    old = unicodedata.ucd_3_2_0.category
    ranges: list[list[int]] = []
    for c in range(0x80, 0x110000):
        if 0xD800 <= c < 0xE000:
            continue
        was = old(chr(c))
        if was == "Cn" or was[0] != unicodedata.category(chr(c))[0]:
            if ranges and ranges[-1][1] == c - 1:
                ranges[-1][1] = c
            else:
                ranges.append([c, c])
    return re.compile("[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]")


#: Marks an id among ranks; above every rank.
WHOLE_ID = 1 << 24


class PieceCoder:
    def __init__(self, data: bytes):
        import tiktoken

        spec = json.loads(data)
        model = spec["model"]
        self.library = library_tokenizer(data)
        self.suffix = model.get("end_of_word_suffix") or ""
        self.special = tuple(t["content"] for t in spec["added_tokens"])
        self.lower = "Lowercase" in json.dumps(spec["normalizer"])
        if self.suffix:
            self.pattern = regex.compile(spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"])
        else:
            self.pattern = regex.compile(BYTE_PATTERN)
        letters = byte_letters()
        end = b"\xff" if self.suffix else b""

        def as_bytes(symbol: str) -> bytes:
            if self.suffix and symbol.endswith(self.suffix):
                return bytes(letters[c] for c in symbol[: -len(self.suffix)]) + end
            return bytes(letters[c] for c in symbol)

        vocab: dict[str, int] = model["vocab"]
        inverse = {b: c for c, b in letters.items()}
        ranks: dict[bytes, int] = {bytes([b]): b for b in range(256)}
        ids: dict[int, int] = {b: vocab.get(inverse[b], 0) for b in range(256)}
        if self.suffix:
            for b in range(255):
                ranks[bytes([b]) + end] = 256 + b
                ids[256 + b] = vocab[inverse[b] + self.suffix]
        at = 512
        for pair in model["merges"]:
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            joined = as_bytes(left + right) if not (self.suffix and left.endswith(self.suffix)) else as_bytes(left) + as_bytes(right)
            if joined not in ranks:
                ranks[joined] = at
                ids[at] = vocab[left + right]
            at += 1
        self.ids = [0] * (at + 1)
        for rank, i in ids.items():
            self.ids[rank] = i
        self.end = end
        self._piece = tiktoken.Encoding("pieces", pat_str=r".+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece
        self.whole: dict[str, int] = {}
        self.young = young_characters().search

    def whole_tokens(self) -> dict[str, int]:
        """Vocabulary strings proved, by the library, to be one pre-token and one token; string -> id."""
        size = self.library.get_vocab_size(with_added_tokens=False)
        letters = byte_letters()
        found: list[tuple[int, str]] = []
        for i in range(size):
            symbol = self.library.id_to_token(i)
            if symbol is None or (self.suffix and not symbol.endswith(self.suffix)):
                continue
            body = symbol[: len(symbol) - len(self.suffix)]
            try:
                text = bytes(letters[c] for c in body).decode("utf-8")
            except (KeyError, UnicodeDecodeError):
                continue
            if text and self.pattern.findall(text) == [text]:
                found.append((i, text))
        coded = self.library.encode_batch_fast([s for _, s in found], add_special_tokens=False)
        return {s: i for (i, s), e in zip(found, coded, strict=True) if e.ids == [i]}

    def word_symbols(self, word: bytes) -> list[int]:
        """Ranks of a word without white space, for word-end vocabularies; ids from the general path come with ``WHOLE_ID`` added.

        Letters alone, and letters before one full stop or comma, are each one pre-token and need no pattern.
        """
        end, piece = self.end, self._piece
        if word.isascii():
            if word.isalpha():
                return piece(word.lower() + end)
            if word[-1] in b".," and word[:-1].isalpha():
                return [*piece(word[:-1].lower() + end), 256 + word[-1]]
        else:
            text = word.decode("utf-8")
            tail = text[-1] in ".,"
            body = text[:-1] if tail else text
            low = body.lower()
            if body.isalpha() and low.isalpha() and "Σ" not in body and unicodedata.is_normalized("NFC", text) and not self.young(text):
                ranks = piece(low.encode("utf-8") + end)
                return [*ranks, 256 + ord(text[-1])] if tail else ranks
        return [i + WHOLE_ID for i in self.encode(word.decode("utf-8"))]

    def encode(self, piece: str) -> list[int]:
        """Ids of one piece."""
        if ("<|" in piece and any(s in piece for s in self.special)) or (not piece.isascii() and self.young(piece)):
            return self.library.encode(piece, add_special_tokens=False).ids
        if self.lower:
            if not piece.isascii():
                piece = unicodedata.normalize("NFC", piece)
                piece = piece.lower() if "Σ" not in piece else "".join(c.lower() for c in piece)
            else:
                piece = piece.lower()
        pretokens = (piece,) if piece.isalpha() or (piece[:1] == " " and piece[1:].isalpha() and not self.suffix) else self.pattern.findall(piece)
        whole, ids, out = self.whole, self.ids, []
        for t in pretokens:
            one = whole.get(t)
            if one is not None:
                out.append(one)
            else:
                out.extend([ids[r] for r in self._piece(t.encode("utf-8") + self.end)])
        return out


@lru_cache(maxsize=4)
def _coder(data: bytes) -> PieceCoder:
    coder = PieceCoder(data)
    coder.whole = coder.whole_tokens()
    return coder


def piece_coder(data: bytes) -> PieceCoder:
    """The coder of a vocabulary file, built once for each Python worker."""
    return _coder(data)
