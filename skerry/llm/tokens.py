"""Token ids with the tokenizers library, each distinct piece of text encoded once.

A byte-level BPE never merges across the pieces that its pattern cuts, so the ids of a
text are the ids of its pieces one after another. Pieces are cut here with a compiled
pattern, and only pieces that a worker has not met are given to the library.
"""

from __future__ import annotations

import json
import os
import re
import unicodedata

import numpy as np
import regex

#: Pattern of the public byte-level vocabularies (a fixed value).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

#: Texts whose characters all come before this one are cut with the faster ``re``.
_NEAR = 0x250

#: Pieces that a worker remembers before it starts anew; bounds its memory, not the result.
MEMO = 400_000


def default_tokenizer() -> str:
    """Path of the 50k byte-level vocabulary; every operator takes another as a parameter."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def read_tokenizer(path: str) -> str:
    """The tokenizer file's content (about 1.5 MB), which the driver sends with the tasks."""
    with open(path, encoding="utf-8") as f:
        return f.read()


def _ranges(kind: str) -> str:
    """Character-class ranges of the near code points in a Unicode category."""
    points = [c for c in range(_NEAR) if unicodedata.category(chr(c))[0] == kind]
    out, first = [], None
    for c, after in zip(points, points[1:] + [None], strict=True):
        first = c if first is None else first
        if after != c + 1:
            out.append(f"\\u{first:04x}-\\u{c:04x}")
            first = None
    return "".join(out)


def _near_pattern() -> re.Pattern:
    space, letters, digits = r" \t-\r\x85\xa0", _ranges("L"), _ranges("N")
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+")


def _byte_letters() -> dict[int, str]:
    """The letter by which a byte-level vocabulary writes each byte."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in shown]
    return {b: chr(b) for b in shown} | {b: chr(256 + i) for i, b in enumerate(hidden)}


def _is_plain(content: str) -> bool:
    """Whether a piece's ids are those that the model alone gives to its bytes' letters."""
    made = json.loads(content)
    first = made.get("pre_tokenizer") or {}
    return made.get("normalizer") is None and first.get("type") == "ByteLevel" and not first.get("add_prefix_space") and all(t["special"] for t in made.get("added_tokens") or [])


class Cutter:
    """Cuts a text into the pattern's pieces; the pieces joined are the text."""

    def __init__(self) -> None:
        self.near, self.any = _near_pattern(), regex.compile(PATTERN)
        self.far = re.compile(f"[^\\x00-\\u{_NEAR - 1:04x}]")

    def __call__(self, text: str) -> list[str]:
        return (self.any if self.far.search(text) else self.near).findall(text)


class Encoder:
    """Ids of texts as little-endian unsigned 32-bit bytes, as the tokenizers library gives them.

    Special tokens are not added, and their strings in a text are ordinary text.
    """

    def __init__(self, content: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark owns the cores
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_str(content)
        self.library.encode_special_tokens = True
        self.library.no_padding()
        self.library.no_truncation()
        self.cut, self.memo = Cutter(), {}
        self.model, self.letters = self.library.model if _is_plain(content) else None, _byte_letters()

    def _learn(self, pieces: list[str]) -> None:
        if self.model is not None:  # half the time of the way through the library's normalizer, cutter and offsets
            for at in range(0, len(pieces), 20_000):
                part, flat, ends = pieces[at : at + 20_000], [], []
                for piece in part:
                    flat += [t.id for t in self.model.tokenize(piece.encode().decode("latin-1").translate(self.letters))]
                    ends.append(4 * len(flat))
                raw = np.array(flat, dtype="<u4").tobytes()
                self.memo.update((piece, raw[a:b]) for piece, a, b in zip(part, [0, *ends], ends))
            return
        for at in range(0, len(pieces), 20_000):
            part = pieces[at : at + 20_000]
            got = self.library.encode(part, is_pretokenized=True, add_special_tokens=False)
            ids = np.asarray(got.ids, dtype="<u4")
            owner = np.asarray(got.word_ids, dtype=np.int64)
            ends = np.searchsorted(owner, np.arange(len(part)), side="right") * 4
            raw, first = ids.tobytes(), 0
            for piece, end in zip(part, ends.tolist(), strict=True):
                self.memo[piece] = raw[first:end]
                first = end

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """One entry for each text; null and empty texts have no ids."""
        cut = [self.cut(t) if t else [] for t in texts]
        memo = self.memo
        new = set().union(*cut).difference(memo)
        if new:
            if len(memo) + len(new) > MEMO:
                memo.clear()
                new = set().union(*cut)
            self._learn(list(new))
        return [b"".join(map(memo.__getitem__, pieces)) for pieces in cut]


_ENCODERS: dict[int, Encoder] = {}


def encoder(content: str) -> Encoder:
    """The worker's encoder for this tokenizer; its memo lives as long as the worker."""
    key = hash(content)
    if key not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[key] = Encoder(content)
    return _ENCODERS[key]


def slices(batch, chars: int = 2_000_000, column: str = "text"):
    """Parts of an Arrow batch of about ``chars`` characters at most, so that memory stays bounded."""
    import pyarrow.compute as pc

    if not batch.num_rows:
        return
    size = np.asarray(pc.fill_null(pc.binary_length(batch.column(column)), 0), dtype=np.int64)
    part = np.cumsum(size) // chars
    cuts = [0, *(np.flatnonzero(np.diff(part)) + 1).tolist(), batch.num_rows]
    for a, b in zip(cuts, cuts[1:]):
        yield batch.slice(a, b - a)
