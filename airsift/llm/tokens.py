"""Token ids by the tokenizers library, as packed bytes.

A byte-level vocabulary splits text into words, numbers, signs and white space before it looks
for tokens. Texts of common characters are split here in the same way, others before every
single blank that stands between two characters that are not white space. The ids of a piece
are looked up if it was seen before, else the library encodes it, many pieces at once; the
result is that of encoding the whole text. Other vocabularies, and texts that hold the literal
of an added token where such literals count, are encoded whole.
"""

from __future__ import annotations

import os
import re
import sys
import types
from itertools import compress, count
from operator import not_

import numpy as np

END_ID = 0
_CACHED_CHARS = 40
_GENERATION = 450_000
_JOINED = 1000
_WHITE = re.compile(r"\s").search
# Characters whose classes the split needs and no version of Unicode changes.
_BLANKS = " \t-\r"
_LETTERS = "A-Za-z\xc0-\xd6\xd8-\xf6\xf8-\u024f\u0391-\u03a1\u03a3-\u03c9\u0400-\u0481\u048a-\u052f"
_SIGNS = "!-/:-@\\[-`{-~\xa1-\xa9\xab-\xb1\xb4\xb6-\xb8\xbb\xbf\xd7\xf7\u2010-\u2027\u2030-\u205e"
_COMMON = re.compile(f"[{_BLANKS}0-9{_LETTERS}{_SIGNS}]*").fullmatch
_SPLIT = re.compile(
    f" ?[{_LETTERS}]+|'(?:s|t|re|ve|m|ll|d)| ?[{_SIGNS}]+| ?[0-9]+"
    f"|[{_BLANKS}]+(?![^{_BLANKS}])|[{_BLANKS}]+"
).findall


class _Pieces(dict):
    """Ids by piece. A piece that is not there reads as no ids and is noted in `new`. When a
    generation of `size` is full, only the pieces that are used again outlive the next."""

    def __init__(self, size: int):
        super().__init__()
        self.size = size
        self.older: dict[str, bytes] = {}
        self.new: set[str] = set()

    def __missing__(self, piece: str) -> bytes:
        if ids := self.older.get(piece):
            self[piece] = ids
            return ids
        self.new.add(piece)
        return b""

    def age(self) -> None:
        if len(self) > self.size:
            self.older = dict(self)
            self.clear()


def worker_encoder(path: str, added_tokens: bool = False, pieces: int | None = None) -> Encoder:
    """The encoder of this Python worker with the pieces it has seen: workers run many tasks,
    one after another."""
    name = "_airsift_token_encoders"
    held = sys.modules.setdefault(name, types.ModuleType(name)).__dict__
    key = (path, added_tokens, pieces)
    if key not in held:
        held[key] = Encoder(path, added_tokens, pieces)
    return held[key]


class Encoder:
    """Encodes whole texts. Ids are little-endian, of 2 bytes if the vocabulary allows.

    `added_tokens`: the literal of a special added token is that token, as the library has it
    by default; else it is text like any other. `pieces`: the size of a generation of pieces
    seen, of which two are held, of some 100 to 200 bytes a piece; fewer cost time, no result.
    """

    def __init__(self, path: str, added_tokens: bool = False, pieces: int | None = None):
        import json

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = not added_tokens
        if hasattr(self.tokenizer.model, "_resize_cache"):
            self.tokenizer.model._resize_cache(0)  # pieces are cached here already
        size = self.tokenizer.get_vocab_size()
        self.id_bytes = 2 if size <= 1 << 16 else 4
        self.kind = np.dtype(f"<u{self.id_bytes}")
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        split = spec.get("pre_tokenizer") or {}
        self.by_piece = (
            spec.get("normalizer") is None
            and split.get("type") == "ByteLevel"
            and not split.get("add_prefix_space")
            and split.get("use_regex", True)
        )
        # Special ones are cut out of a text only on demand, others always.
        literals = [
            t["content"]
            for t in spec.get("added_tokens") or ()
            if t["content"] and (added_tokens or not t.get("special"))
        ]
        self.literal = re.compile("|".join(map(re.escape, literals))).search if literals else None
        blank = "Ġ"  # how byte-level vocabularies write a blank
        names = [self.tokenizer.id_to_token(i) or "" for i in range(size)]
        self.after_blank = np.array([t.startswith(blank) for t in names])
        self.line_end = np.array([t == "Ċ" for t in names])
        self.cache = _Pieces(pieces or _GENERATION)
        self.end = np.array([END_ID], self.kind).tobytes()

    def _ids(self, texts: list[str]) -> list[np.ndarray]:
        found = self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)
        return [np.array(x.ids, self.kind) for x in found]

    def _whole(self, text: str) -> bytes:
        return self._ids([text])[0].tobytes()

    def _cut(self, words: list[str], mark: str, begins: np.ndarray, skip: int) -> list[bytes]:
        """Ids of every word after `mark`, without the first `skip`: many words at once, cut
        at the ids that begin one. No word has white space."""
        out: list[bytes] = []
        joined = [
            mark + mark.join(words[i : i + _JOINED]) for i in range(0, len(words), _JOINED)
        ]
        for ids in self._ids(joined):
            data, size = ids.tobytes(), self.id_bytes
            cuts = (np.flatnonzero(begins[ids]) * size).tolist()
            ends = [*cuts[1:], len(data)]
            out += [data[a + skip * size : b] for a, b in zip(cuts, ends, strict=True)]
        if len(out) != len(words):  # a mark inside a word's tokens: never with this split
            out = [self._whole(mark + w if not skip else w) for w in words]
        return out

    def _learn(self, pieces: set[str]) -> dict[str, bytes]:
        """Ids of pieces that are new."""
        after_blank = [p for p in pieces if p[0] == " " and not _WHITE(p, 1) and len(p) > 1]
        bare = [p for p in pieces if not _WHITE(p)]
        ids = self._cut([p[1:] for p in after_blank], " ", self.after_blank, 0)
        found = dict(zip(after_blank, ids, strict=True))
        found.update(zip(bare, self._cut(bare, "\n", self.line_end, 1), strict=True))
        if odd := [p for p in pieces if p not in found]:
            found.update(zip(odd, [x.tobytes() for x in self._ids(odd)], strict=True))
        return found

    def encode(self, texts: list[str]) -> list[bytes]:
        """Per text its ids and the end id."""
        if not self.by_piece:
            return [x.tobytes() + self.end for x in self._ids(texts)]
        cache, end = self.cache, self.end
        cache.age()
        cache.new.clear()
        get = cache.__getitem__
        out: list[bytes] = []
        waiting: list[tuple[int, list[bytes], list[int], list[str]]] = []
        for text in texts:
            if self.literal and self.literal(text):
                out.append(self._whole(text) + end)
                continue
            pieces = _SPLIT(text) if _COMMON(text) else _before_blanks(text)
            found = list(map(get, pieces))
            if all(found):
                out.append(b"".join(found) + end)
                continue
            gaps = list(compress(count(), map(not_, found)))
            waiting.append((len(out), found, gaps, [pieces[i] for i in gaps]))
            out.append(b"")
        if waiting:
            learned = self._learn(cache.new)
            for at, found, gaps, pieces in waiting:
                for i, piece in zip(gaps, pieces, strict=True):
                    found[i] = learned[piece]
                out[at] = b"".join(found) + end
            cache.update(x for x in learned.items() if len(x[0]) <= _CACHED_CHARS)
        return out


def _before_blanks(text: str) -> list[str]:
    """A text cut before every single blank between characters that are not white space."""
    parts = text.split(" ")
    if "" in parts or list(map(str.strip, parts)) != parts:
        parts = _joined_at_white_space(parts)
    return [p for p in (parts[0], *[" " + p for p in parts[1:]]) if p]


def _joined_at_white_space(parts: list[str]) -> list[str]:
    """Parts put together again wherever white space is beside the blank between them."""
    joined = [[parts[0]]]
    for before, part in zip(parts, parts[1:], strict=False):
        if before and part and not before[-1].isspace() and not part[0].isspace():
            joined.append([part])
        else:
            joined[-1].append(part)
    return [" ".join(p) for p in joined]


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")
