"""Byte-pair encoding by forced boundaries (operator 7), shared by the operators that need token ids.

A byte pair that never occurs inside a vocabulary token cannot be crossed by a merge, so a text may be cut there.
The vocabulary's own pre-tokenizer looks ahead over white space and matches contractions from their apostrophe, so
only those certain cuts are used at which its matching also starts anew: after a letter before another ASCII sign,
and before white space after anything else. Fragments between cuts are encoded independently, each distinct one once
while a bounded cache holds it, and their ids are joined.

A fragment that the pre-tokenizer leaves whole (letters, or ASCII signs, after at most one space) is merged by the ranks of the
merged bytes. That gives the same ids as merging by pairs if every token comes from one merge, later merges have larger ids, and
every token's own bytes merge to that token; a vocabulary for which this does not hold goes through the tokenizers library, as all
other fragments do.
"""

from __future__ import annotations

import functools
import json
import re
from array import array

import numpy as np
import public_tokenizers
import tiktoken
from tokenizers import Tokenizer

DEFAULT = "byte_bpe_50k.json"
WHITE = " \t\n\r\x0b\x0c"
#: Cached fragments of one worker, and the longest that is cached: longer ones seldom come again, and cost more to keep than to encode.
CACHE_ENTRIES, CACHE_CHARS = 300_000, 12


def byte_alphabet() -> dict[str, int]:
    """The sign that stands for each byte in byte-level vocabularies: printable Latin-1 as is, others from U+0100 on."""
    printable = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    others = [b for b in range(256) if b not in set(printable)]
    return {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(others)}


def vocabulary_bytes(path: str) -> dict[int, bytes]:
    """The bytes of each id; added tokens stand for their own text."""
    with open(path, encoding="utf-8") as f:
        data = json.load(f)
    signs = byte_alphabet()
    found = {i: bytes(signs[c] for c in token) for token, i in data["model"]["vocab"].items() if all(c in signs for c in token)}
    return found | {t["id"]: t["content"].encode() for t in data["added_tokens"]}


def inside_pairs(tokens) -> set[tuple[int, int]]:
    """Byte pairs that occur inside some token."""
    return {p for token in tokens for p in zip(token, token[1:], strict=False)}


def letters_and_signs(tokens) -> tuple[list[str], list[str]]:
    """Letters after which a cut before any ASCII sign is certain, and signs after which one before white space is."""
    inside = inside_pairs(tokens)
    signs = [c for c in map(chr, range(128)) if not c.isalpha()]
    never = lambda x, ys: all((x.encode()[-1], ord(y)) not in inside for y in ys)
    letters = [c for c in map(chr, [*range(128), *range(0xC0, 0x250)]) if c.isalpha() and c not in "ªº" and never(c, signs)]
    others = [c for c in signs if c >= " " and c not in WHITE and never(c, WHITE)]
    return letters, others


def fragment_pattern(tokens) -> str:
    """A pattern whose matches are a text's fragments, end to end; anything that is no such letter or sign stays within its fragment.

    The first branch is the common case, a word after a space, which the second one would match alike.
    """
    letters, others = letters_and_signs(tokens)
    letter, other, white = ("".join(f"\\u{ord(c):04x}" for c in x) for x in (letters, others, WHITE))
    unit = f"[{white}]*[{other}]*[{letter}]*"
    return f" [{letter}]+(?=[{other}{white}])|{unit}(?:[^{letter}{other}{white}]+{unit})*"


def whole_pattern(tokens) -> str:
    """Fragments of one pre-token, or of a newline and one: letters of fragment_pattern, or ASCII signs, after at most one space."""
    letter = "".join(f"\\u{ord(c):04x}" for c in letters_and_signs(tokens)[0])
    return f"(\n?)( ?(?:[{letter}]+|[!-/:-@\\[-`{{-~]+))"


def by_ranks(path: str, tokenizer: Tokenizer):
    """A function from a whole pre-token's bytes to its ids; None if ranks of merged bytes do not determine this vocabulary's merges."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    if model["type"] != "BPE" or model.get("dropout") or model.get("ignore_merges"):
        return None
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    ids = [model["vocab"][a + b] for a, b in pairs]
    ordered = all(x < y for x, y in zip(ids, ids[1:], strict=False)) and all(max(model["vocab"][a], model["vocab"][b]) < i for (a, b), i in zip(pairs, ids, strict=True))
    own = all([x.id for x in tokenizer.model.tokenize(token)] == [i] for token, i in model["vocab"].items())
    if not ordered or not own or len(ids) + 256 != len(model["vocab"]):
        return None
    signs = byte_alphabet()
    ranks = {bytes(signs[c] for c in token): i for token, i in model["vocab"].items()}
    return tiktoken.Encoding("own", pat_str=r"\s+|\S+", mergeable_ranks=ranks, special_tokens={})._core_bpe.encode_single_piece


class Fragments(dict):
    """The ids of fragments; one not yet known is encoded and, unless it is long, remembered."""

    def __init__(self, encode):
        self.encode = encode

    def __missing__(self, fragment: str) -> bytes:
        ids = self.encode(fragment)
        if len(fragment) <= CACHE_CHARS:
            self[fragment] = ids
        return ids


class Encoder:
    """Exact ids of a text, as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str, entries: int = CACHE_ENTRIES):
        self.entries = entries
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.bytes_of = vocabulary_bytes(path)
        special = [re.escape(t.content) for t in self.tokenizer.get_added_tokens_decoder().values()]
        # a cut inside an added token would lose it
        self.added = re.compile("|".join(special)) if special else None
        added = {t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()}
        self.cut = re.compile(fragment_pattern(set(self.bytes_of.values()) - added)).findall
        self.whole, self.merge = re.compile(whole_pattern(set(self.bytes_of.values()) - added)).fullmatch, by_ranks(path, self.tokenizer)
        self.size = max(self.bytes_of) + 1
        self.cache = Fragments(self._encode_fragment)

    def fragments(self, text: str) -> list[str]:
        if self.added is None or not self.added.search(text):
            return self.cut(text)
        found, at = [], 0
        for m in self.added.finditer(text):
            found += [*self.cut(text[at : m.start()]), m[0]]
            at = m.end()
        return found + self.cut(text[at:])

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        """The ids of each text; distinct fragments are encoded once while the cache holds them."""
        if len(self.cache) > self.entries:
            self.cache.clear()
        known = self.cache.__getitem__
        return [b"".join(map(known, self.fragments(t))) for t in texts]

    def _encode_fragment(self, fragment: str) -> bytes:
        whole = self.merge and self.whole(fragment)
        if not whole:
            return ids_bytes(self.tokenizer.encode(fragment, add_special_tokens=False).ids)
        ids = ids_bytes(self.merge(whole[2].encode()))
        return ids_bytes(self.merge(b"\n")) + ids if whole[1] else ids

    def decode(self, ids) -> str:
        """As the tokenizers library joins the bytes of the ids, special tokens included."""
        return b"".join(map(self.bytes_of.get, ids, [b""] * len(ids))).decode("utf-8", "replace")


def ids_bytes(ids) -> bytes:
    return array("I", ids).tobytes()


@functools.lru_cache(maxsize=4)
def encoder(name: str = DEFAULT, entries: int = CACHE_ENTRIES) -> Encoder:
    """One a worker; name: of a public vocabulary, or a path."""
    return Encoder(name if "/" in name else public_tokenizers.path(name), entries)
