"""Token ids of whole texts, by the tokenizers library.

A byte-level BPE of this kind never joins what lies before and after a space that a visible character follows, so a text is cut there and
each distinct piece is encoded once a worker. Ids are those of the whole text (tests compare them).
"""

from __future__ import annotations

import gc
import re
from functools import cache

import numpy as np

VOCABULARY = "byte_bpe_50k.json"


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


#: Stands before a piece that no space leads.
_BARE = "\x01"
#: White space beside white space or at the end, where a cut could change ids.
_LOOSE = re.compile(r" (?:\s|\Z)")
_LOOSE_LINE = re.compile(r"\n(?:(?<!\S\n)|(?=\s|\Z))")
#: A stop or comma that doesn't follow a letter or digit may belong to a run of marks.
_LOOSE_STOP, _LOOSE_COMMA = re.compile(r"\.(?<![^\W_]\.)"), re.compile(r",(?<![^\W_],)")


class Encoder:
    """One a worker process. room: pieces remembered at most (some 200 bytes each)."""

    def __init__(self, path: str, room: int = 1_000_000):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True  # their strings in a text are ordinary text
        self.vocabulary = self.tokenizer.get_vocab_size()
        self.kind = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.room = room
        self.known: dict[str, bytes] = {}  # by piece, without the space that leads it
        self.newline = self._whole("\n")

    def _whole(self, text: str) -> bytes:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype=self.kind).tobytes()

    def _many(self, pieces: list[str], lead: str) -> list[bytes]:
        """Ids of lead + piece. Pieces without white space are encoded line by line in one go."""
        out: list[bytes] = [b""] * len(pieces)
        plain = [i for i, p in enumerate(pieces) if p.isprintable() and " " not in p and 0 < len(p) < 200] if len(self.newline) == self.kind.itemsize else []
        mark = np.frombuffer(self.newline, self.kind)[0]
        for k in range(0, len(plain), 2000):
            part = plain[k : k + 2000]
            ids = np.array(self.tokenizer.encode_batch_fast(["\n".join(lead + pieces[i] for i in part)], add_special_tokens=False)[0].ids, dtype=self.kind)
            cut = [-1, *np.flatnonzero(ids == mark).tolist(), len(ids)]
            for i, a, b in zip(part, cut, cut[1:], strict=False):
                out[i] = ids[a + 1 : b].tobytes()
            assert len(cut) == len(part) + 1
        done = set(plain)
        for i, p in enumerate(pieces):
            if i not in done:
                out[i] = self._whole(lead + p)
        return out

    def _pieces(self, text: str) -> list[str]:
        """The text cut before spaces and, where no run of marks or white space is in the way, around line breaks and before stops and commas."""
        if _BARE in text or _LOOSE.search(text):
            pieces = text.split(" ")
            merged = [pieces[0]]
            for p in pieces[1:]:
                if p and not p[0].isspace() and p[0] != _BARE:
                    merged.append(p)
                else:
                    merged[-1] += " " + p
            merged[0] = _BARE + merged[0]
            return merged
        if not _LOOSE_STOP.search(text) and not _LOOSE_COMMA.search(text):
            text = text.replace(".", " \x01.").replace(",", " \x01,")
        if not _LOOSE_LINE.search(text):
            text = text.replace("\n", " \x01\n \x01")
        return (_BARE + text).split(" ")

    def encode(self, texts: list[str | None]) -> list[np.ndarray]:
        """Ids of each text; null counts as empty."""
        if len(self.known) > self.room:
            self.known.clear()
        collects = gc.isenabled()
        gc.disable()  # strings and bytes form no cycles; scanning them again and again takes a tenth of the time
        try:
            return self._encode(texts)
        finally:
            if collects:
                gc.enable()

    def _encode(self, texts: list[str | None]) -> list[np.ndarray]:
        known = self.known.get
        cut = []
        missing: set[str] = set()
        for t in texts:
            pieces = self._pieces(t or "")
            ids = list(map(known, pieces))
            gaps = [(i, pieces[i]) for i, v in enumerate(ids) if v is None] if None in ids else []
            missing.update([p for _, p in gaps])
            cut.append((ids, gaps))
        led = [p for p in missing if p[:1] != _BARE]
        bare = [p for p in missing if p[:1] == _BARE]
        new = dict(zip(led, self._many(led, " "), strict=True)) | dict(zip(bare, self._many([p[1:] for p in bare], ""), strict=True))
        self.known.update((p, v) for p, v in new.items() if len(p) <= 40)
        out = []
        for ids, gaps in cut:
            for i, p in gaps:
                ids[i] = new[p]
            out.append(np.frombuffer(b"".join(ids), dtype=self.kind))
        return out


@cache
def encoder(path: str) -> Encoder:
    return Encoder(path)
