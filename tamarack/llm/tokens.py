"""Byte-level BPE ids of whole texts."""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np

#: The published pre-tokenization of byte-level BPE vocabularies of this family (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _bytes_of_symbols() -> dict[str, int]:
    """The printable stand-in of each byte in the vocabulary file, reversed."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + k): b for k, b in enumerate(rest)}


#: White space as the pattern's ``\\s`` has it, and how long a run is cut out of a text by hand: its regular expression
#: walks back over the run, and fails on runs of about a million.
_SPACE = "\t-\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
RUN = 1 << 16
_RUN = re.compile(rf"[{_SPACE}]{{{RUN},}}")


class Ids:
    """Text -> little-endian unsigned 32-bit ids, equal to ``Tokenizer.encode(text, add_special_tokens=False)``.

    The vocabulary file is that of the ``tokenizers`` library; ``tiktoken`` applies it, several
    times faster and in linear time on texts without spaces. The strings of special tokens in a
    text become their ids, as the library does by default.
    """

    def __init__(self, path: str):
        import tiktoken

        symbols = _bytes_of_symbols()
        with open(path, encoding="utf-8") as file:
            model = json.load(file)
        self._special = {t["content"]: t["id"] for t in model.get("added_tokens", ())}
        ranks = {bytes(symbols[c] for c in token): rank for token, rank in model["model"]["vocab"].items() if token not in self._special}
        self._encoding = tiktoken.Encoding("bytes", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=self._special)
        self._whole = re.compile("(" + "|".join(map(re.escape, sorted(self._special, key=len, reverse=True))) + ")") if self._special else None

    def _ids(self, text: str) -> np.ndarray:
        if len(text) < RUN or not _RUN.search(text):
            return self._encoding.encode_to_numpy(text, allowed_special="all")
        parts = self._whole.split(text) if self._whole else [text]
        return np.concatenate([ids for part in parts for ids in self._around_runs(part)])

    def _around_runs(self, text: str) -> Iterator[np.ndarray]:
        """Ids of a text between special tokens. A run is one piece, but for its last character where another than white space follows."""
        if text in self._special:
            yield np.array([self._special[text]], np.uint32)
            return
        at = 0
        for m in _RUN.finditer(text):
            end = m.end() - (m.end() < len(text))
            yield self._encoding.encode_to_numpy(text[at : m.start()], allowed_special="all")
            yield np.array(self._encoding._encode_single_piece(text[m.start() : end]), np.uint32)
            at = end
        yield self._encoding.encode_to_numpy(text[at:], allowed_special="all")

    def encode(self, text: str) -> bytes:
        return self._ids(text).astype("<u4", copy=False).tobytes()

    def count(self, text: str) -> int:
        return len(self._ids(text))


_made: dict[str, Ids] = {}


def encoder(path: str) -> Ids:
    """One encoder per Python worker and path; loading takes a while."""
    if path not in _made:
        _made[path] = Ids(path)
    return _made[path]
