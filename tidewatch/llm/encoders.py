"""Public tokenizers as encoders. Tasks get a file's content, never its place, and hold what they make of it."""

from __future__ import annotations

import json
import re
from functools import lru_cache

import numpy as np
import sentencepiece
import tiktoken
from tokenizers import Tokenizer

from .bpe import byte_letters

# the word pattern of byte-level tokenizer files
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


class ByteLevel:
    """A byte-level BPE file. special: do the strings of special tokens in a text count as these tokens?"""

    def __init__(self, content: str, special: bool):
        spec = json.loads(content)
        pre = spec["pre_tokenizer"]
        if spec["model"]["type"] != "BPE" or pre["type"] != "ByteLevel" or pre["add_prefix_space"] or spec.get("normalizer"):
            raise ValueError("not a plain byte-level BPE file")
        back = {c: b for b, c in byte_letters().items()}
        added = {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        ids = {bytes(back[c] for c in k): v for k, v in spec["model"]["vocab"].items() if k not in added}
        self.content, self.special, self.slow = content, special, None
        self.fast = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ids, special_tokens=added)
        self.allowed = set(added) if special else set()
        self.size = max([*ids.values(), *added.values()]) + 1
        self.bytes_of = [b""] * self.size
        for k, v in [*ids.items(), *((k.encode(), v) for k, v in added.items())]:
            self.bytes_of[v] = k

    def encode(self, text: str) -> np.ndarray:
        try:
            return self.fast.encode_to_numpy(text, allowed_special=self.allowed, disallowed_special=())
        except ValueError:  # its pattern gives up on very long white space
            if self.slow is None:
                self.slow = Tokenizer.from_str(self.content)
                self.slow.encode_special_tokens = not self.special
            return np.array(self.slow.encode(text, add_special_tokens=False).ids, np.uint32)


class Pieces:
    """A sentencepiece model."""

    def __init__(self, content: bytes):
        self.model = sentencepiece.SentencePieceProcessor(model_proto=content)
        self.size = self.model.vocab_size()
        self.bytes_of = []
        for i in range(self.size):
            piece = self.model.id_to_piece(i)
            byte = re.fullmatch(r"<0x([0-9A-F]{2})>", piece)
            self.bytes_of.append(bytes([int(byte[1], 16)]) if byte else piece.replace("▁", " ").encode())

    def encode(self, texts: list[str]) -> list[list[int]]:
        return self.model.encode(texts, num_threads=1)


@lru_cache(4)
def byte_level(content: str, special: bool) -> ByteLevel:
    """One of a kind in a worker, whatever it runs."""
    return ByteLevel(content, special)


@lru_cache(4)
def pieces(content: bytes) -> Pieces:
    return Pieces(content)


def content(path: str, binary: bool = False):
    with open(path, "rb") as f:
        return f.read() if binary else f.read().decode("utf-8")
