"""Token ids of whole texts, with a tokenizer of the tokenizers library on the executors.

Byte-level BPE never merges across the pieces that its pattern cuts a text into, so each distinct piece is encoded
once by the library and remembered; texts are the concatenation of their pieces' ids. This holds for characters
whose classes are the same in every Unicode version; a text with any other character, or with the tokenizer's
added tokens, is encoded by the library as a whole.
"""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterator
from itertools import chain
from unicodedata import category

import numpy as np

#: The id that ends every document.
END_ID = 0
END = np.array([END_ID], "<u4").tobytes()
# Code points whose classes don't change (Latin with its marks, punctuation), as first and last.
SETTLED = ((0x09, 0x0A), (0x0D, 0x0D), (0x20, 0x7E), (0xA0, 0x36F), (0x2010, 0x2027), (0x2030, 0x205E), (0x20AC, 0x20AC))


def patterns() -> tuple[re.Pattern, re.Pattern]:
    """What finds a character that isn't settled, and what cuts settled text into the pieces of byte-level pre-tokenization."""
    settled = [chr(c) for a, b in SETTLED for c in range(a, b + 1)]
    of = lambda test: "".join(re.escape(c) for c in settled if test(c))
    letters, numbers, spaces = of(lambda c: category(c)[0] == "L"), of(lambda c: category(c)[0] == "N"), of(str.isspace)
    pieces = rf"'(?:[stmd]|re|ve|ll)| ?[{letters}]+| ?[{numbers}]+| ?[^{spaces}{letters}{numbers}]+|[{spaces}]+(?![^{spaces}])|[{spaces}]+"
    return re.compile(f"[^{of(lambda c: True)}]"), re.compile(pieces)


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


class Encoder:
    """Encodes texts. Remembers at most `most` pieces in two generations, so that memory stays bounded and common pieces stay known."""

    def __init__(self, path: str, most: int = 2_000_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        os.environ.setdefault("RAYON_NUM_THREADS", "1")
        import json

        from tokenizers import Tokenizer

        self.tokenizer, self.most = Tokenizer.from_file(path), most
        kind = json.loads(self.tokenizer.to_str())
        plain = kind["normalizer"] is None and kind["model"]["type"] == "BPE" and (kind["pre_tokenizer"] or {}) | {"trim_offsets": 0} == {
            "type": "ByteLevel", "add_prefix_space": False, "trim_offsets": 0, "use_regex": True,
        }
        unsettled, pieces = patterns()
        self.unsettled, self.cut = unsettled.search if plain else lambda _: True, pieces.findall
        self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [array("I", e.ids).tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        """The ids of each text with the end id appended."""
        if len(self.known) > self.most // 2:
            self.known, self.older = {}, self.known
        cut = [None if self.unsettled(t) or any(a in t for a in self.added) else self.cut(t) for t in texts]
        unknown = set(chain.from_iterable(filter(None, cut))).difference(self.known)
        if self.older:
            self.known.update((p, self.older[p]) for p in unknown if p in self.older)
        if new := list(unknown.difference(self.known)):
            self.known.update(zip(new, self._whole(new)))
        ids = self.known.__getitem__
        return [np.frombuffer(b"".join([*(self._whole([t]) if pieces is None else map(ids, pieces)), END]), "<u4") for t, pieces in zip(texts, cut)]


_encoders: dict[str, Encoder] = {}


def encode(texts: list[str], path: str, most: int = 1 << 17) -> Iterator[np.ndarray]:
    """The ids of each text with the end id appended; about `most` characters at a time. One encoder for each worker."""
    encoder = _encoders.get(path) or _encoders.setdefault(path, Encoder(path))
    held, size = [], 0
    for text in texts:
        held.append(text)
        size += len(text)
        if size >= most:
            yield from encoder.encode(held)
            held, size = [], 0
    yield from encoder.encode(held)
