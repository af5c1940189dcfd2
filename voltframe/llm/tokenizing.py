"""Whole-text encoding with the tokenizers library, remembering words already encoded.

A byte-level BPE never merges across the boundary between a non-space character and a following space, and
a word-end BPE drops white space altogether, so the ids of a text are those of its space-separated parts in
order. Each distinct part goes through the library once per worker: plain words go to the library's BPE model
as the one piece that its pre-tokenizer makes of them, anything else through the whole tokenizer. Texts in
which a cut at a space could change the result (runs of white space, a leading space) go through it whole.
"""

from __future__ import annotations

import os
import re

from .common import worker_cache

#: A worker stops remembering when it holds this many words and letter runs (about 200 MB).
MAX_CACHED_WORDS, MAX_CACHED_PIECES = 700_000, 300_000
_UNSAFE = re.compile(r"\s ")
_TAIL = ".,;:!?"


def _byte_alphabet() -> dict[int, str]:
    """The printable stand-ins that byte-level models use: printable Latin-1 bytes stand for themselves."""
    shown = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    table = {b: chr(b) for b in shown}
    table.update({b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))})
    return table


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.words, self.pieces = worker_cache("tokenizing", "words", path), worker_cache("tokenizing", "pieces", path)
        held = worker_cache("tokenizing", "it", path)
        if not held:
            held["it"] = t = Tokenizer.from_file(path)
            t.encode_special_tokens = True  # their strings in a text are ordinary text
            ids = lambda x: t.encode(x, add_special_tokens=False).ids
            held["drops"] = ids("a") == ids(" a ")  # white space is dropped, so that any space is a safe cut
            held["bytes"] = _byte_alphabet()
        self.tokenizer, self.drops_space, self.alphabet = held["it"], held["drops"], held["bytes"]
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer

    def _whole(self, texts: list[str]) -> list[bytes]:
        import numpy as np

        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _piece(self, piece: str) -> bytes:
        """piece: what the pre-tokenizer would hand to the model, before bytes are replaced by their stand-ins."""
        found = self.pieces.get(piece)
        if found is None:
            shown = piece if piece.isascii() and piece[:1] > " " else "".join(map(self.alphabet.__getitem__, piece.encode()))
            found = b"".join(x.id.to_bytes(4, "little") for x in self.model.tokenize(shown))
            if len(self.pieces) < MAX_CACHED_PIECES:
                self.pieces[piece] = found
        return found

    def _word(self, word: str) -> bytes:
        """Ids of one part; for tokenizers that keep white space, word begins with its space unless it heads a text."""
        rest = word[1:] if word[:1] == " " else word
        core = rest.rstrip(_TAIL)
        tail = rest[len(core):]
        if core.isalpha():
            if self.drops_space:
                core = core.lower() if core.isascii() or self.normalizer is None else self.normalizer.normalize_str(core)
                if core.isalpha():
                    return self._piece(core) + (self._piece(tail) if tail else b"")
            else:
                return self._piece(word[: len(word) - len(tail)]) + (self._piece(tail) if tail else b"")
        if "\n" in rest:  # single line ends between words; before the space of the next word nothing may be white
            lines = rest.split("\n")
            if all(x and not x[0].isspace() and not x[-1].isspace() for x in lines):
                if self.drops_space:
                    return b"".join(map(self._known, lines))
                return self._known(word[: len(word) - len(rest)] + lines[0]) + b"".join(self._piece("\n") + self._word(x) for x in lines[1:])
        return self._whole([word])[0]

    def _known(self, word: str) -> bytes:
        key = word if self.drops_space else word[1:] if word[:1] == " " else None
        found = self.words.get(key)
        return self._word(word) if found is None else found

    def encode(self, texts: list[str]) -> list[bytes]:
        get, words, drops = self.words.get, self.words, self.drops_space
        out = []
        for t in texts:
            if not drops and (t[:1] == " " or _UNSAFE.search(t)):
                out += self._whole([t])
                continue
            parts = t.split(" ")
            ids = list(map(get, parts))
            if None in ids:
                for k, x in enumerate(ids):
                    if x is None:
                        x = get(parts[k])
                        if x is None:
                            x = self._word(parts[k] if drops else " " + parts[k]) if parts[k] or not drops else b""
                            if len(words) < MAX_CACHED_WORDS and "\n" not in parts[k]:
                                words[parts[k]] = x
                        ids[k] = x
            if not drops:
                ids[0] = self._word(parts[0]) if parts[0] else b""
            out.append(b"".join(ids))
        return out
