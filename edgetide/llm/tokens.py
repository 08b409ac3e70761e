"""Token ids of whole texts, by the tokenizers library with a memory of pieces already encoded.

The byte-level pre-tokenizer makes each run of letters, digits or other signs, with a single space before it, a piece
of its own, and pieces are encoded each by itself. Texts of nothing else (and single line ends) are cut so and each
distinct piece goes through the library's model once. In other texts (apostrophes, runs of white space, other
alphabets) cuts are made only before a space with a character other than white space at one side at least, and what
isn't plain between two cuts goes through the whole library. Any other kind of tokenizer gets whole texts.
"""

from __future__ import annotations

import json
import os
import re
from itertools import chain

import numpy as np
import pyarrow as pa

END_ID = 2
_LETTERS, _SIGNS = "A-Za-zÀ-ÖØ-öø-ÿ", r"!-&(-/:-@\[-`{-~"
_PART = re.compile(rf" ?(?:[{_LETTERS}]+|[0-9]+|[{_SIGNS}]+)|\n(?! ?\s| \Z)")
_NOT_CUTTABLE = re.compile(r"\s (?:\s|\Z)")
_LOADED: dict[str, "Pieces"] = {}


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def _byte_letters() -> dict[int, str]:
    """The characters that stand for bytes in a byte-level vocabulary: printable ones for themselves, others from 256 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or b >= 174]
    return {b: chr(b) for b in own} | {b: chr(256 + k) for k, b in enumerate(sorted({*range(256)} - {*own}))}


def _parts(text: str) -> list[str] | None:
    """The pieces of a plain text."""
    parts = _PART.findall(text)
    return parts if sum(map(len, parts)) == len(text) else None


def _cuts(text: str) -> list[str]:
    first, *rest = text.split(" ")
    return [first, *map(" ".__add__, rest)]


class Pieces(dict):
    """Piece -> its ids as little-endian unsigned 32-bit integers."""

    LIMIT = 800_000

    def __init__(self, path: str):
        super().__init__()
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        spec = json.loads(self.library.to_str())
        kind = spec["pre_tokenizer"] or {}
        self.plain = not spec["normalizer"] and kind.get("type") == "ByteLevel" and not kind["add_prefix_space"] and kind["use_regex"]
        if self.plain:
            self.model = Tokenizer.from_str(json.dumps(spec | {"pre_tokenizer": None, "post_processor": None, "added_tokens": []}))
            self.letters = _byte_letters()
            self.line = "\n".translate(self.letters)
            self.line_bytes = np.array([self.model.token_to_id(self.line)], "<u4").tobytes()
            # bytes of each id of the vocabulary
            vocabulary = self.model.get_vocab()
            self.sizes = np.zeros(max(vocabulary.values()) + 1, np.int64)
            for token, k in vocabulary.items():
                self.sizes[k] = len(token)
            self.special = tuple(x["content"] for x in spec["added_tokens"])

    def whole(self, text: str) -> bytes:
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, parts: set[str]) -> None:
        """Remember plain pieces, by one call of the library's model. No token crosses two of them, so sizes of tokens tell where each ends."""
        if len(self) > self.LIMIT:
            self.clear()
        self["\n"] = self.line_bytes
        new = [x for x in parts if x not in self]
        if not new:
            return
        # one pass for all: a byte is a letter then, and a line end parts the pieces
        words = "\n".join(new).encode().decode("latin-1").translate(self.letters).split(self.line)
        ids = np.array(self.model.encode_batch_fast([words], is_pretokenized=True, add_special_tokens=False)[0].ids, "<u4")
        upto, wanted = np.cumsum(self.sizes[ids]), np.cumsum(np.fromiter(map(len, words), np.int64, len(words)))
        ends = np.searchsorted(upto, wanted)
        if len(ids) == 0 or upto[-1] != wanted[-1] or (upto[ends] != wanted).any():
            raise AssertionError("a token crosses two pieces")
        ends = (ends + 1) * 4
        self.update(zip(new, map(ids.tobytes().__getitem__, map(slice, np.append(0, ends[:-1]).tolist(), ends.tolist())), strict=True))

    def encode_all(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes; null is an empty text."""
        out: list[bytes] = []
        at, size = 0, 0
        for k, text in enumerate(texts):
            size += len(text or "")
            if size > 1_000_000 or k + 1 == len(texts):
                out += self._some(texts[at : k + 1])
                at, size = k + 1, 0
        return out

    def _some(self, texts: list[str | None]) -> list[bytes]:
        if not self.plain:
            return [self.whole(x) if x else b"" for x in texts]
        parts = [(None if any(s in x for s in self.special) else _parts(x)) if x else [] for x in texts]
        cuts = {k: _cuts(texts[k]) for k, p in enumerate(parts) if p is None and not _NOT_CUTTABLE.search(texts[k])}
        of_cut = {x: (None if any(s in x for s in self.special) else _parts(x)) for y in cuts.values() for x in y}
        self.learn({*chain.from_iterable(p for p in (*parts, *of_cut.values()) if p)})
        of = self.__getitem__
        ids = {x: self.whole(x) if p is None else b"".join(map(of, p)) for x, p in of_cut.items()}
        return [
            b"".join(map(of, p)) if p is not None else b"".join(map(ids.__getitem__, cuts[k])) if k in cuts else self.whole(texts[k])
            for k, p in enumerate(parts)
        ]


def pieces(path: str) -> Pieces:
    """One memory for each Python worker."""
    if path not in _LOADED:
        _LOADED[path] = Pieces(path)
    return _LOADED[path]


def encoded(column: pa.Array, path: str, end_id: int = END_ID) -> list[bytes]:
    """Each text's ids with the end id."""
    end, memory = np.array([end_id], "<u4").tobytes(), pieces(path)
    return [x + end for x in memory.encode_all(column.to_pylist())]
