"""Exact, reuse-heavy encoding with public tokenizer files.

``Encoder`` gives the ids that the ``tokenizers`` library gives for a whole text. A text is cut at gaps
where the supported pre-tokenizers always start a new piece: white space after a character that is no white space.
The ids of a piece are found once while it stays in a bounded table. Plain Latin words take the merge ranks through
``tiktoken``, which applies the same merges; every other piece goes to ``tokenizers`` itself.
"""

from __future__ import annotations

import re
from array import array

import numpy as np
import tiktoken
from tokenizers import Tokenizer

#: White space on which libraries differ, and marks that may join a neighbour; texts with any of them are encoded whole.
_ODD = re.compile("[\x1c-\x1f\x85\xa0\u1680\u180e\u2000-\u200d\u2028\u2029\u202f\u205f\u2060\u3000\ufeff]")
_PIECE = re.compile(r"\s*\S+|\s+")
#: Pieces whose split into words and marks is the same for both pre-tokenizers.
_LETTER = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(f"\x00([ \n]?[{_LETTER}]+[.,;:!?]?)(?=\x00)")
_WORDS = f" ?[{_LETTER}]+\ue000?|[.,;:!?]\ue000?|\n|\x00"
_END = "\ue000"
#: The byte-level pre-tokenizer's pattern, a fixed value of the file format.
_BYTE_LEVEL = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: Entries of a worker's table; about 200 bytes each, so 60 MB.
PIECES = 300_000


def _byte_of() -> dict[str, int]:
    """Byte-level alphabet: printable Latin-1 characters stand for themselves, other bytes follow from 256 on."""
    kept = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(kept)]
    return {chr(b): b for b in kept} | {chr(256 + k): b for k, b in enumerate(rest)}


class Encoder:
    """Texts to ids as little-endian unsigned integers of ``width`` bytes."""

    def __init__(self, path: str, pieces: int = PIECES):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        vocab = self.tokenizer.get_vocab(with_added_tokens=True)
        self.width = 2 if max(vocab.values()) < 65536 else 4
        self.dtype = np.dtype("<u2" if self.width == 2 else "<u4")
        self.code = "H" if self.width == 2 else "I"
        #: Words end in a suffix and white space is dropped, or white space belongs to the word after it.
        self.suffix = any(t.endswith("</w>") for t in vocab)
        self.token = [""] * (max(vocab.values()) + 1)
        for t, i in vocab.items():
            self.token[i] = t
        special = {i for i, t in self.tokenizer.get_added_tokens_decoder().items()}
        of = _byte_of()
        ranks = {}
        for t, i in vocab.items():
            if i not in special:
                end = self.suffix and t.endswith("</w>")
                ranks[bytes(of[c] for c in (t[:-4] if end else t)) + _END.encode() * end] = i + 2
        if self.suffix:  # the bytes of the end mark join first, then the mark joins the letter before it
            ranks |= {_END.encode()[:2]: 0, _END.encode(): 1}
        self.merge = tiktoken.Encoding("words", pat_str=_WORDS, mergeable_ranks=ranks, special_tokens={})
        self.gap = self.merge.encode_ordinary("\x00")[0]
        if not self.suffix:  # the library's own pattern over whole texts
            self.whole = tiktoken.Encoding("texts", pat_str=_BYTE_LEVEL, mergeable_ranks={k: v - 2 for k, v in ranks.items()}, special_tokens={})
            self.special = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.pieces, self.known, self.older = pieces // 2, {}, {}

    def plain(self, text: str) -> bytes:
        """The library's own answer for the whole text."""
        return array(self.code, self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def split(self, text: str) -> list[str]:
        """Pieces whose ids can be joined; a text with unusual white space stays whole."""
        if not text:
            return []
        if (not text.isascii() and _ODD.search(text)) or "\x1c" in text or "\x1d" in text or "\x1e" in text or "\x1f" in text:
            return [text]
        return text.split() if self.suffix else _PIECE.findall(text)

    def learn(self, pieces: set[str]) -> None:
        new = pieces - self.known.keys()
        if len(self.known) + len(new) > self.pieces:  # pieces in use move on to the new table
            self.older, self.known, new = self.known, {}, pieces
        known, older = self.known, self.older
        if seen := new & older.keys():
            known.update({p: older[p] for p in seen})
            new = new - seen
        if not new:
            return
        words = _PLAIN.findall("\x00" + "\x00".join(new) + "\x00")
        if words:
            blob = "\x00".join(words) + "\x00"
            if self.suffix:
                blob = blob.lower()
                for mark in ".,;:!?\x00":
                    blob = blob.replace(mark, _END + mark)
            ids = np.array(self.merge.encode_ordinary(blob), dtype=np.int64)
            ends = np.flatnonzero(ids == self.gap)
            raw = (ids - 2).astype(self.dtype).tobytes()
            w, at = self.width, 0
            for p, end in zip(words, (ends * w).tolist(), strict=True):
                known[p] = raw[at:end]
                at = end + w
        rest = list(new.difference(words))
        for at in range(0, len(rest), 20_000):
            some = rest[at : at + 20_000]
            for p, e in zip(some, self.tokenizer.encode_batch_fast(some, add_special_tokens=False), strict=True):
                known[p] = array(self.code, e.ids).tobytes()

    def encode(self, text: str | None) -> bytes:
        return self.encode_batch([text])[0]

    def _plain_bytes(self, text: str) -> bytes:
        odd = (not text.isascii() and _ODD.search(text)) or any(c in text for c in "\x1c\x1d\x1e\x1f") or any(t in text for t in self.special)
        return self.plain(text) if odd else array(self.code, self.whole.encode_ordinary(text)).tobytes()

    def encode_batch(self, texts: list[str | None]) -> list[bytes]:
        if not self.suffix:
            return [self._plain_bytes(t or "") for t in texts]
        out, at = [], 0
        while at < len(texts):
            some, size = [], 0
            while at < len(texts) and (not some or size < 100_000):
                some.append(self.split(texts[at] or ""))
                size += len(some[-1])
                at += 1
            self.learn(set().union(*some))
            out += [b"".join(map(self.known.__getitem__, pieces)) for pieces in some]
        return out

    def tokens(self, ids: bytes) -> list[str]:
        return [self.token[i] for i in np.frombuffer(ids, self.dtype).tolist()]


_ENCODERS: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    """The worker's encoder for a file; Python workers are reused, so its table serves later tasks too."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def token_path(name: str) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def wide(ids: bytes, width: int) -> np.ndarray:
    """Stored ids as little-endian unsigned 32-bit integers."""
    return np.frombuffer(ids, dtype="<u2" if width == 2 else "<u4").astype("<u4")
