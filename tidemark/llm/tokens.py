"""Exact, cached encoding with a Hugging Face ``tokenizers`` file.

Encoding a corpus text by text repeats the work for every common word. The
pre-tokenizers of the supported files never join characters across certain
places, so a text is cut there and each piece's ids are kept, packed, in a
bounded cache. The ids are those of encoding the whole text: the string of an
added token (such as an end mark) in a text becomes that token, as the library
does by default, and parts a text.
"""

from __future__ import annotations

import os
import re
from array import array

#: The characters of \s in the tokenizers' pattern engine (Unicode White_Space).
SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_WORDS = re.compile(f"[^{SPACE}]+")
_PIECES = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")

# Texts of Latin characters alone are cut into pre-tokens here, as the files'
# own patterns do; Unicode's versions agree on these characters. U+0130 is left
# out: lower-casing makes it two characters.
_LATIN_TEXT = re.compile("[\\x00-\u012f\u0131-\u024f]*")
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\u024f", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_SHORT = "'(?:s|t|re|ve|m|ll|d)"
_WORD_PATTERN = "'s|'t|'re|'ve|'m|'ll|'d|[\\p{L}]+|[\\p{N}]|[^\\s\\p{L}\\p{N}]+"
_WORD_TOKENS = re.compile(f"{_SHORT}|[{_L}]+|[{_N}]|[^{_S}{_L}{_N}]+")
_BYTE_TOKENS = re.compile(f"{_SHORT}| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")

#: Pieces kept by one worker (about 200 bytes each), and the longest piece kept.
CACHE_PIECES = 600_000
CACHE_CHARS = 48


def _byte_letters() -> dict[int, str]:
    """The printable stand-in of each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Encoder:
    """Encodes texts to packed little-endian unsigned 32-bit ids."""

    def __init__(self, path: str, cache_pieces: int = CACHE_PIECES):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import json

        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.kind = _kind(spec)
        self.added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        if any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec.get("added_tokens") or []):
            self.kind = "whole"  # their places depend on more than the string
        longest_first = sorted(self.added, key=len, reverse=True)
        self.marks = re.compile("(" + "|".join(map(re.escape, longest_first)) + ")") if longest_first else None
        self.cache: dict[str, bytes] = {}
        self.cache_pieces = cache_pieces

    def _cut(self, text: str) -> tuple[list[str], bool]:
        """Pieces to encode one by one, and whether each is a pre-token."""
        latin = _LATIN_TEXT.fullmatch(text) is not None
        if self.kind == "words":
            return (_WORD_TOKENS.findall(text.lower()), True) if latin else (_WORDS.findall(text), False)
        if self.kind == "bytes":
            return (_BYTE_TOKENS.findall(text), True) if latin else (_PIECES.findall(text), False)
        return ([text] if text else []), False

    def _one(self, piece: str, whole: bool) -> list[int]:
        """Ids of a piece: of a pre-token straight from the model."""
        if whole:
            return [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The packed ids of each text."""
        if self.marks is None or self.kind == "whole":
            return self._encode_plain(texts)
        cut = [self.marks.split(t) for t in texts]
        if all(len(parts) == 1 for parts in cut):
            return self._encode_plain(texts)
        plain = iter(self._encode_plain([p for parts in cut for p in parts[::2]]))
        out = []
        for parts in cut:
            marks = [array("I", [self.added[m]]).tobytes() for m in parts[1::2]]
            out.append(b"".join(next(plain) if i % 2 == 0 else marks[i // 2] for i in range(len(parts))))
        return out

    def _encode_plain(self, texts: list[str]) -> list[bytes]:
        cache, out, long = self.cache, [], []
        for text in texts:
            pieces, whole = self._cut(text)
            found = [cache.get(p) for p in pieces]
            if None in found:
                for i, (piece, ids) in enumerate(zip(pieces, found, strict=True)):
                    if ids is None:
                        ids = cache.get(piece)
                        if ids is None:
                            ids = cache[piece] = array("I", self._one(piece, whole)).tobytes()
                            if len(piece) > CACHE_CHARS:
                                long.append(piece)
                        found[i] = ids
            out.append(b"".join(found))
            for piece in long:
                cache.pop(piece, None)
            long.clear()
            if len(cache) > self.cache_pieces:
                cache.clear()
        return out


def _kind(spec: dict) -> str:
    """How texts may be cut: "words" (lower-cased, white space leaves no id),
    "bytes" (byte-level pieces with their leading space), else not at all."""
    pre = spec.get("pre_tokenizer") or {}
    steps = pre.get("pretokenizers", [pre])
    normalizers = [n["type"] for n in (spec.get("normalizer") or {}).get("normalizers", [])]
    model = spec["model"]
    if model.get("type") != "BPE" or model.get("dropout") or model.get("continuing_subword_prefix"):
        return "whole"
    if (
        [s.get("type") for s in steps] == ["Split", "ByteLevel"]
        and steps[0].get("pattern", {}).get("Regex") == _WORD_PATTERN
        and steps[0].get("invert")
        and steps[0].get("behavior") == "Removed"
        and not steps[1].get("use_regex")
        and normalizers == ["NFC", "Replace", "Lowercase"]
    ):
        return "words"
    if pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space") and not spec.get("normalizer"):
        return "bytes"
    return "whole"


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """This process's encoder for a tokenizer file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def tokenizer_path(name: str) -> str:
    """Where an installed public tokenizer's file is, on the machine that asks."""
    import public_tokenizers

    return public_tokenizers.path(name)
