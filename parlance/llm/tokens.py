"""Token ids of whole texts by a public tokenizer, in tasks.

Both tokenizers used here never join pieces over a space, so a text can be cut at its spaces, and the
ids of such a chunk, once encoded by the tokenizers library, are kept by a worker for the next time
the chunk occurs. Where a run of white space holds a space in its middle, the cut would tell; such
chunks stay together (see _chunks).
"""

from __future__ import annotations

import functools
import os
import re
from array import array

import numpy as np

#: Chunks whose ids a worker keeps (of either kind); then it starts afresh. This bounds memory, not results.
KEPT_CHUNKS = 700_000
#: A word whose pieces are plain: Latin letters (in composed form), then perhaps marks.
PLAIN = re.compile(r"([A-Za-zÀ-ÖØ-öø-ÿ]+)([.,;:!?%$#&*|]*)")
#: Byte-level BPE writes each byte as a character: printable ones as themselves, the others, in order, from 256 on.
_PRINTABLE = {*range(33, 127), *range(161, 173), *range(174, 256)}
BYTE_CHARS = {b: b if b in _PRINTABLE else 256 + sum(x not in _PRINTABLE for x in range(b)) for b in range(256)}
U32 = np.dtype("<u4")


def tokenizer_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


class Encoder:
    """ids(text) gives little-endian unsigned 32-bit ids as bytes.

    spaced: the tokenizer's pieces may begin with the space before them (byte-level BPE); otherwise
    white space is dropped by it.
    """

    def __init__(self, path: str, spaced: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.spaced = spaced
        self.parts: dict[str, bytes] = {}  # by what stands between two spaces
        self.strings: dict[str, bytes] = {}  # by the very string

    def _encode(self, strings: list[str]) -> list[bytes]:
        """Through self.strings."""
        known = self.strings
        if len(known) > KEPT_CHUNKS:
            known.clear()
        new = []
        for s in dict.fromkeys(strings):
            if s not in known:
                # One plain piece needs the model alone, not the splitting before it.
                if (m := PLAIN.fullmatch(s, 1 if self.spaced and s[0] == " " else 0)) and not m[2]:
                    known[s] = self._piece(s)
                else:
                    new.append(s)
        if new:
            known.update(zip(new, (np.array(e.ids, U32).tobytes() for e in self.tokenizer.encode_batch_fast(new, add_special_tokens=False)), strict=True))
        return [known[s] for s in strings]

    def _piece(self, s: str) -> bytes:
        s = s if self.spaced else s.lower()
        chars = s.replace(" ", "Ġ") if s.isascii() else s.encode().decode("latin1").translate(BYTE_CHARS)
        return array("I", [t.id for t in self.model.tokenize(chars)]).tobytes()

    @staticmethod
    def _chunks(parts: list[str]) -> list[str]:
        """parts: a text split at spaces. Chunks with their leading space, cut only where the space is the
        first or the last of its run of white space."""
        out, ends_open = [parts[0]], parts[0] == "" or parts[0][-1].isspace()
        for p in parts[1:]:
            if ends_open and (p == "" or p[0].isspace()):
                out[-1] += " " + p
            else:
                out.append(" " + p)
            ends_open = p == "" or p[-1].isspace()
        return out

    @staticmethod
    def _lines(part: str) -> list[str]:
        """A part after its space, cut around line breaks that stand alone between other characters: such a
        break is a piece of its own."""
        lines = part.split("\n")
        if len(lines) > 1 and all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
            return [" " + lines[0], *(y for x in lines[1:] for y in ("\n", x))]
        return [" " + part]

    def _pieces(self, part: str) -> list[str]:
        """Strings whose ids, one after another, are those of a part with the space before it."""
        out = []
        for s in self._lines(part) if self.spaced else [part]:
            m = PLAIN.fullmatch(s, 1 if s[:1] == " " else 0)
            out += [s[: m.end(1)], m[2]] if m and m[2] else [s]
        return out

    def ids(self, text: str) -> bytes:
        if not text:
            return b""
        if any(s in text for s in self.special):  # those are found before all else, over the whole text
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, U32).tobytes()
        if not self.spaced:
            text = text.replace("\n", " ")
        parts = text.split(" ")
        first, rest = (parts[0], parts[1:]) if self.spaced else ("", parts)
        known = self.parts
        try:
            found = [known[p] for p in rest]
        except KeyError:
            new = [p for p in dict.fromkeys(rest) if p not in known]
            if self.spaced and any(p == "" or p[0].isspace() for p in new):  # these are never kept
                return b"".join(self._encode([c for c in self._chunks(parts) if c]))
            if len(known) > KEPT_CHUNKS:
                known.clear()
                new = list(dict.fromkeys(rest))
            cut = [self._pieces(p) for p in new]
            each = iter(self._encode([s for c in cut for s in c]))
            known.update((p, b"".join([next(each) for _ in c])) for p, c in zip(new, cut, strict=True))
            found = [known[p] for p in rest]
        return (self._encode([first])[0] if first else b"") + b"".join(found)


@functools.cache
def encoder(path: str, spaced: bool) -> Encoder:
    """One for each Python worker, so what it knows serves later tasks too."""
    return Encoder(path, spaced)
