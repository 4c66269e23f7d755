"""Chunks of a text on which a tokenizer's work is independent, and the tokenizer's work on one chunk.

A chunk is a run of white space with the run of other characters after it. Pre-token patterns of the BPE tokenizers used
here never join a character to white space after it, so a cut before white space is never inside a pre-token, and each
distinct chunk has to be looked at once per task only.
"""

from __future__ import annotations

import array
import json
import os
import re
import sys
from collections.abc import Callable

#: Unicode white space, as the tokenizers' patterns have it (Python's own class has four control characters more).
_SPACE = r"\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
_EXACT = re.compile(f"[{_SPACE}]*[^{_SPACE}]+|[{_SPACE}]+$")
#: White space before a space, where a cut at every space would be inside a run; or the sign that marks cuts.
_RUNS = re.compile(f"[{_SPACE}] |\0")
#: The pattern of byte-level pre-tokenizers that bring their own.
BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def chunks_of(text: str) -> list[str]:
    """The text cut into chunks, in order; none for empty text."""
    if not text:
        return []
    if text[0] == " " or _RUNS.search(text):
        return _EXACT.findall(text)
    return text.replace(" ", "\0 ").split("\0")


class Memo(dict):
    """Values by key, computed on first sight and forgotten together at a bound, so that memory stays bounded."""

    def __init__(self, value: Callable[[str], object], most: int = 500_000):
        super().__init__()
        self.value, self.most = value, most

    def __missing__(self, key: str) -> object:
        if len(self) >= self.most:
            self.clear()
        out = self[key] = self.value(key)
        return out


def byte_letters() -> dict[int, str]:
    """The letter that byte-level BPE writes for each byte: printable bytes as themselves, others from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    others = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}


class Pieces:
    """Pre-tokens of a chunk and token ids of a pre-token, equal to the library's.

    Chunks of Latin-1 characters are split by the tokenizer's own pattern and handed to its model; all others, chunks
    with a special string, and all chunks of a tokenizer of another make are left to the library as a whole.
    """

    def __init__(self, path: str):
        import regex

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer, self.letters = Tokenizer.from_file(path), byte_letters()
        with open(path, encoding="utf-8") as file:
            made = json.load(file)
        self.specials = [t["content"] for t in made["added_tokens"]]
        self.special = regex.compile("(" + "|".join(map(regex.escape, self.specials)) + ")") if self.specials else None
        self.lead = os.path.commonprefix(self.specials)
        normalizers = (made["normalizer"] or {}).get("normalizers", [made["normalizer"]] if made["normalizer"] else [])
        steps = (made["pre_tokenizer"] or {}).get("pretokenizers", [made["pre_tokenizer"]])
        self.lower = any(n["type"] == "Lowercase" for n in normalizers)
        split = [s["pattern"].get("Regex") for s in steps if s["type"] == "Split" and s["behavior"] == "Removed" and s["invert"]]
        byte_level = [s for s in steps if s["type"] == "ByteLevel" and not s["add_prefix_space"]]
        known = {"NFC", "Replace", "Lowercase"} >= {n["type"] for n in normalizers} and len(byte_level) == 1 and len(split) + 1 == len(steps)
        if known and (split or byte_level[0]["use_regex"]):
            pattern = (split or [BYTE_LEVEL])[0].replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}")
            self.pattern = regex.compile(pattern)
        else:
            self.pattern = None

    def is_plain(self, chunk: str) -> bool:
        if self.pattern is None or not (chunk.isascii() or max(chunk) < "\u0100"):
            return False
        return self.special is None or self.lead not in chunk or not self.special.search(chunk)

    def split(self, chunk: str) -> list[str]:
        """Pre-tokens of a chunk of a tokenizer without a normalizer; a special string is one of its own."""
        if chunk[1:].isalpha() and chunk.isascii() and chunk[0] == " " and self.pattern is not None:
            return [chunk]
        if self.is_plain(chunk):
            return self.pattern.findall(chunk)
        out = []
        for i, part in enumerate(self.special.split(chunk) if self.special else [chunk]):
            out += [part] if i % 2 else [part[a:b] for _, (a, b) in self.tokenizer.pre_tokenizer.pre_tokenize_str(part)] if part else []
        return out

    def ids(self, piece: str) -> list[int]:
        """Ids of one pre-token."""
        if not self.is_plain(piece):
            return self.tokenizer.encode(piece, add_special_tokens=False).ids
        if not piece.isalpha() or not piece.isascii():
            piece = piece.encode("utf-8").decode("latin-1").translate(self.letters)
        return [t.id for t in self.tokenizer.model.tokenize(piece)]

    def encode(self, chunk: str, memo: Memo) -> bytes:
        """Ids of a chunk as unsigned 32-bit integers; ``memo`` has those of a pre-token."""
        if self.lower and chunk.isascii() and chunk[1:].isalpha() and chunk[0] == " " and self.pattern is not None:
            return memo[chunk[1:].lower()]
        if not self.is_plain(chunk):
            return packed(self.tokenizer.encode(chunk, add_special_tokens=False).ids)
        found = self.pattern.findall(chunk.lower() if self.lower else chunk)
        return memo[found[0]] if len(found) == 1 else b"".join([memo[p] for p in found])


def packed(ids: list[int]) -> bytes:
    return array.array("I", ids).tobytes()


def kept(name: str, make: Callable[[], object]) -> object:
    """A value that a Python worker keeps from task to task, such as a bounded memo of a tokenizer's work."""
    store = sys.__dict__.setdefault("_kept_by_worker", {})
    if name not in store:
        store[name] = make()
    return store[name]
