"""Token ids of whole texts by a public tokenizer, at the speed that a word cache gives.

The tokenizers library encodes each pre-token (word, number, run of signs or of white space) by itself, so a text's ids
are its pre-tokens' ids in order. Common pre-tokens come from a bounded cache of library results; the library encodes
the others, many in one call, or its model by itself where nothing but bytes come before it. Texts with characters for which Python and the library might split differently, for
instance beyond the Latin letters, go to the library whole, and so do texts that hold one of the vocabulary's added tokens.
"""

from __future__ import annotations

import json
import re
import struct
from collections.abc import Iterable, Iterator

import numpy as np
from tokenizers import Tokenizer
from tokenizers.models import BPE

#: Letters and numbers among the characters that Encoder splits itself.
LETTER, NUMBER = "A-Za-zªµºÀ-ÖØ-öø-ɏ", "0-9²³¹¼-¾"
ENDINGS = "'s|'t|'re|'ve|'m|'ll|'d"
#: How vocabulary files say that they split text, and the same for Encoder's characters.
BYTES = {"type": "ByteLevel", "add_prefix_space": False, "use_regex": True}
WORDS = {"type": "Split", "pattern": {"Regex": ENDINGS + r"|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}
LOWERED = ["NFC", "Replace", "Lowercase"]
BYTE_PIECES = rf"{ENDINGS}| ?[{LETTER}]+| ?[{NUMBER}]+| ?[^\t\n\r {LETTER}{NUMBER}]+|[\t\n\r ]+(?![^\t\n\r ])|[\t\n\r ]+"
WORD_PIECES = rf"{ENDINGS}|[{LETTER}]+|[{NUMBER}]|[^\t\n\r {LETTER}{NUMBER}]+"
#: Fixed value: the character that stands for each byte in byte-level vocabularies: itself if it is printed, or one from 256 on.
PRINTED = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
BYTE_SIGNS = {b: 256 + k for k, b in enumerate(b for b in range(256) if b not in PRINTED)}
#: A character outside this class sends its text to the library whole.
UNSURE = re.compile("[^\t\n\r\x20-\x7e\xa1-\xac\xae-įı-ňŊ-ɏ]")
#: Pre-tokens in the cache at most, and their characters together; beyond, the cache starts anew.
CACHED, CACHED_CHARS = 600_000, 7_000_000
#: Characters of texts that are looked up together.
GROUP = 1 << 21


def pieces_of(tokenizer: Tokenizer) -> tuple[str | None, bool]:
    """The pattern of the pieces that a tokenizer splits text into, and whether it lowers letters first.

    Told from what it says of its normalizer and pre-tokenizer, which is small beside its vocabulary; None where that is
    neither of the known two.
    """
    said = lambda part: json.loads(part.__getstate__()) if part is not None else {}
    normalizer, splitter = said(tokenizer.normalizer), said(tokenizer.pre_tokenizer)
    same = lambda want, got: all(got.get(k) == v for k, v in want.items())
    if not normalizer and same(BYTES, splitter):
        return BYTE_PIECES, False
    steps, kinds = splitter.get("pretokenizers", []), [n["type"] for n in normalizer.get("normalizers", [])]
    if kinds == LOWERED and len(steps) == 2 and same(WORDS, steps[0]) and same(BYTES | {"use_regex": False}, steps[1]):
        return WORD_PIECES, True
    return None, False


class Encoder:
    """Encodes texts with the tokenizer in a file, with the ids that the library gives.

    The library finds the vocabulary's added tokens, such as an end mark, in a text; with `plain`, they are ordinary text.
    """

    def __init__(self, path: str, plain: bool = False):
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = plain
        self.known: dict[str, bytes] = {}
        self.chars = 0
        pattern, self.lower = pieces_of(self.tokenizer)
        self.split = re.compile(pattern).findall if pattern else None
        model = self.tokenizer.model
        self.model = model if pattern == BYTE_PIECES and isinstance(model, BPE) and not model.dropout else None
        added = [] if plain else [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.added = re.compile("|".join(map(re.escape, added)), re.IGNORECASE).search if added else lambda text: None

    def whole(self, text: str) -> bytes:
        """The ids of a text as little-endian unsigned 32-bit integers, by the library alone."""
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def learn(self, pieces: list[str]) -> dict[str, bytes]:
        """The ids of new pre-tokens. Those without white space inside are encoded in one call, a line each; a byte-level
        vocabulary's model takes a pre-token's bytes as they are, which spares the library the search for places."""
        plain = [p for p in pieces if p.strip() and p.lstrip(" ") == p.strip()]
        found = {p: self.whole(p) for p in pieces if not (p.strip() and p.lstrip(" ") == p.strip())}
        if self.model:
            ids = lambda p: [t.id for t in self.model.tokenize(p.encode().decode("latin-1").translate(BYTE_SIGNS))]
            return found | {p: struct.pack(f"<{len(x)}I", *x) for p, x in zip(plain, map(ids, plain), strict=True)}
        if plain:
            lines = self.tokenizer.encode("\n".join(plain), add_special_tokens=False)
            ids, word = np.array(lines.ids, "<u4"), np.array(lines.word_ids)
            step = 1 if self.lower else 2  # where white space isn't dropped, the line ends are words too
            cut = np.searchsorted(word, np.arange(len(plain) * step + 1)) * 4
            raw = ids.tobytes()
            if word[-1] == len(plain) * step - step:
                found |= {p: raw[cut[step * k] : cut[step * k + 1]] for k, p in enumerate(plain)}
            else:  # a piece that the library splits once more by itself
                found |= {p: self.whole(p) for p in plain}
        return found

    def many(self, texts: Iterable[str | None], end: int) -> Iterator[bytes]:
        """The ids of each text, with the id `end` after them; null counts as empty."""
        last, group, size = np.array([end], "<u4").tobytes(), [], 0
        for text in texts:
            group.append(text or "")
            size += len(group[-1])
            if size > GROUP:
                yield from self._group(group, last)
                group, size = [], 0
        yield from self._group(group, last)

    def _group(self, texts: list[str], last: bytes) -> Iterator[bytes]:
        if len(self.known) > CACHED or self.chars > CACHED_CHARS:
            self.known, self.chars = {}, 0
        split = [None if self.split is None or UNSURE.search(t) or self.added(t) else self.split(t.lower() if self.lower else t) for t in texts]
        known = self.known
        new = set().union(*(pieces for pieces in split if pieces)).difference(known)
        known.update(self.learn(list(new)))
        self.chars += sum(map(len, new))
        for text, pieces in zip(texts, split, strict=True):
            yield (self.whole(text) if pieces is None else b"".join(map(known.__getitem__, pieces))) + last


_encoders: dict[tuple[str, bool], Encoder] = {}


def encoder(path: str, plain: bool = False) -> Encoder:
    """One encoder for each file and Python worker; workers serve many tasks."""
    if (path, plain) not in _encoders:
        _encoders[path, plain] = Encoder(path, plain)
    return _encoders[path, plain]
