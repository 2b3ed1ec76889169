"""Token ids by the ``tokenizers`` library, with the ids of repeated words kept.

Both vocabularies divide a text into pieces before any merge, so a piece's ids
do not depend on what stands around it.  A text of plain Latin letters, digits,
ASCII signs and white space is divided here as the vocabulary's own pattern
divides it; any other text is divided at white space only, and a text with a
special token's name or a character that Python and the library class
differently goes to the library whole.  The library encodes each different
piece once for each process (at most ``KEEP`` pieces are held; the rest are
encoded again), and a text's ids are those of its pieces.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa

KEEP = 300_000
#: Characters of the texts that are divided together.
GROUP = 4 << 20

_L = "A-Za-zÀ-ÖØ-öø-ÿ"
_PLAIN = re.compile(rf"[^\t\n\r\x20-\x7e{_L}]")
_ODD = re.compile("[\x1c-\x1f\x85᠎​-‍⁠﻿]")
_SPACED = re.compile(r"\s+(?!\S)| ?\S+|\s+")
_SPACED_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[0-9]+| ?[^\s{_L}0-9]+|\s+(?!\S)|\s+")
_WORD_PLAIN = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_L}]+|[0-9]|[^\s{_L}0-9]+")
#: Bytes of a plain text's UTF-8: of its letters beyond ASCII the first is always C3, so the second alone tells them apart.
_PLAIN_BYTES = re.sub(_PLAIN, "", "".join(map(chr, range(128)))).encode() + bytes({b for c in range(128, 256) if not _PLAIN.match(chr(c)) for b in chr(c).encode()})
_SMALL = bytes(b + 32 if 65 <= b <= 90 or 0x80 <= b <= 0x9E else b for b in range(256))
#: 0 white space, 1 of a letter, 2 a digit, 3 a sign.
_KINDS = bytes(0 if b in b"\0\t\n\r " else 2 if 48 <= b <= 57 else 1 if b >= 128 or chr(b).isalpha() else 3 for b in range(256))


def _byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable bytes stand for themselves, the others follow from U+0100."""
    own = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in own]
    return {b: chr(b) for b in own} | {b: chr(256 + i) for i, b in enumerate(rest)}


_LETTERS = _byte_letters()


def default_path(name: str) -> str:
    """Where the installed vocabulary ``name`` lies."""
    import public_tokenizers

    return public_tokenizers.path(name)


class WordEncoder:
    """Little-endian unsigned 32-bit ids of texts.

    ``spaced``: a piece takes the space before it along (byte-level
    vocabularies); otherwise texts are lower-cased and white space only divides.
    """

    def __init__(self, path: str, spaced: bool):
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.model = self.library.model
        self.spaced = spaced
        self.names = [t.content for t in self.library.get_added_tokens_decoder().values()]
        self.other = _Held(lambda piece: self._library_ids([piece])[0])
        self.plain = _Held(self._piece_ids)
        if hasattr(self.model, "_resize_cache"):
            self.model._resize_cache(0)

    def _piece_ids(self, piece: str) -> bytes:
        """A piece that is divided no further goes to the library's merges directly."""
        letters = piece if piece.isascii() and piece.isprintable() and " " not in piece else "".join(map(_LETTERS.__getitem__, piece.encode()))
        return b"".join([t.id.to_bytes(4, "little") for t in self.model.tokenize(letters)])

    def whole(self, text: str) -> bytes:
        """A text's ids by one call of the library."""
        return np.array(self.library.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        if "<|" in text and any(n in text for n in self.names) or _ODD.search(text):
            return self.whole(text)
        if _PLAIN.search(text):
            pieces = _SPACED.findall(text) if self.spaced else text.split()
            return b"".join(map(self.other.__getitem__, pieces))
        pieces = _SPACED_PLAIN.findall(text) if self.spaced else _WORD_PLAIN.findall(text.lower())
        return b"".join(map(self.plain.__getitem__, pieces))

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """The ids of each text, as ``encode`` gives them; where white space only divides, plain texts are divided together."""
        if self.spaced:
            return [self.encode(t) for t in texts]
        out, group, size = [], [], 0
        for text in texts:
            data = text.encode("utf-8", "surrogatepass") if len(text) <= GROUP and "<|" not in text else None
            if data is None or data.translate(None, _PLAIN_BYTES):
                out.append(self.encode(text))
                continue
            group.append(len(out))
            out.append(data)
            size += len(text)
            if size >= GROUP:
                self._fill(out, group)
                group, size = [], 0
        self._fill(out, group)
        return out

    def _fill(self, out: list, group: list[int]) -> None:
        if group:
            for i, ids in zip(group, self._divided([out[i] for i in group]), strict=True):
                out[i] = ids

    def _divided(self, texts: list[bytes]) -> list[bytes]:
        """The ids of plain texts (their UTF-8): pieces as ``_WORD_PLAIN`` finds them, each different one looked up once."""
        small = (b"\0".join(texts) + b"\0\0\0").translate(_SMALL)
        data, kinds = np.frombuffer(small, np.uint8), np.frombuffer(small.translate(_KINDS), np.uint8)
        solid = kinds != 0
        starts = np.empty(len(data), bool)
        starts[0] = True
        np.not_equal(kinds[1:], kinds[:-1], out=starts[1:])
        starts |= kinds == 2
        starts &= solid
        # A contraction: a sign's run that begins with an apostrophe before certain letters.
        q = np.flatnonzero((data == 39) & starts)
        a, b = data[q + 1], data[q + 2]
        two = (a == 115) | (a == 116) | (a == 109) | (a == 100)  # 's 't 'm 'd
        three = ((a == 114) | (a == 118)) & (b == 101) | (a == 108) & (b == 108)  # 're 've 'll
        starts[q[two | three] + 1] = False
        after = np.concatenate([q[two] + 2, q[three] + 3])
        starts[after] |= kinds[after] == 1
        body, first = data[solid], np.flatnonzero(starts[solid])
        offsets = np.append(first, len(body)).astype(np.int32)
        pieces = pa.StringArray.from_buffers(len(first), pa.py_buffer(offsets), pa.py_buffer(body)).dictionary_encode()
        held = list(map(self.plain.__getitem__, _strings(pieces.dictionary)))
        flat = np.frombuffer(b"".join(held), "<u4")
        size = np.fromiter(map(len, held), np.int64, len(held)) >> 2
        k = pieces.indices.to_numpy()
        n = np.take(size, k)
        ends = np.cumsum(n)
        at = np.repeat(np.take(np.cumsum(size) - size, k) - (ends - n), n)
        at += np.arange(len(at))
        ids = np.take(flat, at).tobytes()
        before = np.searchsorted(np.flatnonzero(starts), np.flatnonzero(data == 0)[: len(texts)])
        cuts = np.append(0, 4 * np.append(0, ends)[before]).tolist()
        return [ids[lo:hi] for lo, hi in zip(cuts, cuts[1:], strict=False)]

    def _library_ids(self, words: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.library.encode_batch_fast(words, add_special_tokens=False)]


def _strings(pieces: pa.StringArray) -> list[str]:
    """Pieces, none of which has a space, as Python strings: cut from one, not made one by one."""
    if not len(pieces):
        return []
    ends = np.frombuffer(pieces.buffers()[1], np.int32, len(pieces) + 1)
    body = np.frombuffer(pieces.buffers()[2], np.uint8, int(ends[-1]))
    return np.insert(body, ends[1:-1], 32).tobytes().decode().split(" ")


class _Held(dict):
    """Ids by piece; at most ``KEEP`` pieces stay."""

    def __init__(self, ids):
        super().__init__()
        self.ids = ids

    def __missing__(self, piece: str) -> bytes:
        got = self.ids(piece)
        if len(self) < KEEP:
            self[piece] = got
        return got


_encoders: dict[tuple[str, bool], WordEncoder] = {}


def encoder(path: str, spaced: bool) -> WordEncoder:
    """This process's encoder for a vocabulary file."""
    key = (path, spaced)
    if key not in _encoders:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        _encoders[key] = WordEncoder(path, spaced)
    return _encoders[key]
