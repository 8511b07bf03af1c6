"""Two vocabularies as whole texts need them: ids as arrays, and the bytes of every id."""

from __future__ import annotations

import json

import numpy as np

# Fixed values of byte-level vocabularies: the pre-token pattern, and bytes that stand for
# themselves in an entry; the others are written as the characters from 256 on.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
SHOWN = [*range(33, 127), *range(161, 173), *range(174, 256)]

_loaded: dict[tuple, object] = {}


class ByteVocabulary:
    """Ids of a byte-level file of the tokenizers library.

    The entries of such a file, in order of id, are the ranks that the tiktoken
    library merges by; it gives the same ids several times as fast and in an
    array, without a table of what it has seen.
    """

    def __init__(self, path: str):
        import tiktoken

        with open(path, encoding="utf-8") as file:
            content = json.load(file)
        hidden = [b for b in range(256) if b not in SHOWN]
        byte = {chr(b): b for b in SHOWN} | {chr(256 + n): b for n, b in enumerate(hidden)}
        special = {t["content"]: t["id"] for t in content["added_tokens"]}
        entries = {k: v for k, v in content["model"]["vocab"].items() if k not in special}
        ranks = {bytes(byte[c] for c in entry): n for entry, n in entries.items()}
        self.special = set(special)
        self.bytes = {n: b for b, n in ranks.items()}
        self.encoding = tiktoken.Encoding(
            path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=special
        )

    @classmethod
    def of(cls, path: str) -> ByteVocabulary:
        """The vocabulary, read once per worker process."""
        if ("bytes", path) not in _loaded:
            _loaded["bytes", path] = cls(path)
        return _loaded["bytes", path]

    def ids(self, text: str) -> np.ndarray:
        """Ids of a text, special strings inside taken as special tokens."""
        return self.encoding.encode_to_numpy(text, allowed_special=self.special)

    def plain_ids(self, text: str) -> np.ndarray:
        """Ids of a text, special strings inside taken as any other text."""
        return self.encoding.encode_to_numpy(text, disallowed_special=()).astype(np.int64)


class PieceVocabulary:
    """Ids of a sentencepiece file, which puts a blank before a text."""

    def __init__(self, path: str):
        import sentencepiece

        self.processor = sentencepiece.SentencePieceProcessor(model_file=path)
        self.bytes = {n: self._bytes(n) for n in range(self.processor.get_piece_size())}

    def _bytes(self, n: int) -> bytes:
        piece = self.processor.id_to_piece(n)
        if self.processor.is_byte(n):
            return bytes([int(piece[3:5], 16)])
        return piece.replace("▁", " ").encode()

    @classmethod
    def of(cls, path: str) -> PieceVocabulary:
        if ("pieces", path) not in _loaded:
            _loaded["pieces", path] = cls(path)
        return _loaded["pieces", path]

    def plain_ids(self, text: str) -> np.ndarray:
        return np.array(self.processor.encode(text, num_threads=1), np.int64)
