"""Token ids of texts by a tokenizers-library file, with each distinct word encoded once per Python worker.

For a byte-level tokenizer that splits words before it merges, a single space between two other characters always begins a new
piece, and so does a line feed between two other characters. Texts are cut there, each distinct piece is encoded by the library,
and the ids are joined. Texts with any other arrangement of white space go to the library whole.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from functools import lru_cache

#: Distinct pieces kept per worker (about 200 bytes each) and the longest piece kept.
KEPT, LONGEST = 700_000, 24

#: The parts of a tokenizer file for which cutting at single spaces is exact.
CUTTABLE = {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": True}


#: The printable characters that stand for the 256 bytes in a byte-level vocabulary: a fixed format.
_PLAIN = [*range(33, 127), *range(161, 173), *range(174, 256)]
BYTES = {b: chr(b) for b in _PLAIN} | {b: chr(256 + i) for i, b in enumerate(sorted(set(range(256)) - set(_PLAIN)))}


def _bytes(ids) -> bytes:
    return array("I", ids).tobytes()


class Irregular(Exception):
    """The text has white space at which it can't be cut."""


class _Pieces(dict):
    """piece -> ids as bytes; a piece stands for itself with `before` in front, or begins with a line feed."""

    def __init__(self, owner, before):
        super().__init__()
        self.owner, self.before, self.mapped = owner, before, BYTES[32] if before else ""

    def __missing__(self, piece):
        if piece.isalpha():  # one unit of the model, no further steps of the library apply
            word = piece if piece.isascii() else piece.encode().decode("latin-1").translate(BYTES)
            ids = _bytes([t.id for t in self.owner.model.tokenize(self.mapped + word)])
        elif not piece or piece[-1].isspace():
            raise Irregular
        elif piece[-1] in ",." and piece[:-1].isalpha():
            ids = self[piece[:-1]] + self.owner.mark[piece[-1]]
        elif piece[0] == "\n" and self.before:
            if piece[1].isspace():
                raise Irregular
            ids = self.owner.line_feed + self.owner.bare[piece[1:]]
        else:
            ids = self.owner.direct(self.before + piece)
        if len(piece) <= LONGEST:
            if len(self) >= KEPT:
                self.clear()
            self[piece] = ids
        return ids


class Encoder:
    """ids(text) gives native-order unsigned 32-bit token ids as bytes, without added begin or end tokens."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        spec = json.loads(self.lib.to_str())
        added = spec["added_tokens"]
        self.cuttable = spec.get("pre_tokenizer") == CUTTABLE and spec.get("normalizer") is None and spec["model"]["type"] == "BPE" and not spec["model"].get("dropout") and not any(t["lstrip"] or t["rstrip"] or t["normalized"] or t["single_word"] or re.search(r"\s|^[.,\w]|[.,\w]$", t["content"]) for t in added)
        self.special = max((len(t["content"]) for t in added), default=0)
        self.model = self.lib.model
        if self.cuttable:
            self.line_feed, self.mark = self.direct("\n"), {c: self.direct(c) for c in ",."}
            self.spaced, self.bare = _Pieces(self, " "), _Pieces(self, "")

    def direct(self, text: str) -> bytes:
        return _bytes(self.lib.encode(text, add_special_tokens=False).ids)

    def ids(self, text: str | None) -> bytes:
        if not text:
            return b""
        if self.cuttable and " \n" not in text:
            pieces = text.replace("\n", " \n").split(" ")
            try:
                return b"".join([self.bare[pieces[0]], *map(self.spaced.__getitem__, pieces[1:])])
            except Irregular:
                pass
        return self.direct(text)


@lru_cache(maxsize=2)
def encoder(path: str) -> Encoder:
    """One encoder per file and Python worker; workers are used again by later tasks."""
    return Encoder(path)
