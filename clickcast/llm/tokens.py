"""Subword ids of whole texts from a public tokenizer file.

The tokenizer drops white space and never joins pieces across it, so a text's ids are the ids of its
pieces (runs of letters, single digits, runs of other characters) in a row. Pieces recur, so a worker
keeps their ids; unseen ones are encoded many at a time. Texts with characters beyond Latin letters
and ASCII go through the whole tokenizer.
"""

from __future__ import annotations

import json
import os
import re
from functools import cached_property

import numpy as np

CACHE_PIECES, CACHE_WORDS = 250_000, 200_000
#: The alphabet on which lower-casing and composing are plain: no other normal form exists for it.
PLAIN = re.compile(r"[\x20\x09-\x0D!-~À-ÖØ-öø-įı-ſ]*")
#: Fixed value: the pieces of a word, as the tokenizer file cuts them, on that alphabet.
PIECE = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ſ]+|[0-9]|[!-/:-@\[-`{-~]+")
PIECE_OR_LINE = re.compile(PIECE.pattern + r"|\n")
LINE = {"\n": b"\xff\xff"}  # a line end between words becomes id 65535


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class PieceEncoder:
    """Texts or words -> uint16 ids (as bytes), as ``encode(text, add_special_tokens=False)`` gives them."""

    def __init__(self, path: str):
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.path = path
        self.special = [t["content"] for t in spec["added_tokens"]]
        vocab = spec["model"]["vocab"]
        if max(vocab.values()) >= 0xFFFF or spec["model"].get("end_of_word_suffix") != "</w>":
            raise ValueError("needs a vocabulary below 65535 ids with word-end pieces")
        self.ends = np.zeros(1 << 16, bool)
        self.ends[[i for t, i in vocab.items() if t.endswith("</w>")]] = True
        spec["normalizer"], spec["added_tokens"] = None, []
        spec["pre_tokenizer"] = {"type": "Sequence", "pretokenizers": [
            {"type": "Split", "pattern": {"String": "\n"}, "behavior": "Removed", "invert": False},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]}
        self.pieces = Tokenizer.from_str(json.dumps(spec))
        self.known: dict[str, bytes] = dict(LINE)
        self.words: dict[str, bytes] = {}

    def forget(self) -> None:
        """Give the caches' memory back, for other work of the same worker."""
        self.known, self.words = dict(LINE), {}

    @cached_property
    def whole(self):
        """The tokenizer as it is; most workers meet no text that needs it."""
        from tokenizers import Tokenizer

        return Tokenizer.from_file(self.path)

    def _learn_pieces(self, new: list[str]) -> None:
        for at in range(0, len(new), 1 << 15):
            part = new[at:at + (1 << 15)]
            lines = ["\n".join(part[k:k + 512]) for k in range(0, len(part), 512)]
            for k, e in enumerate(self.pieces.encode_batch_fast(lines, add_special_tokens=False)):
                ids = np.array(e.ids, np.uint16)
                cuts = np.flatnonzero(self.ends[ids]) + 1  # each piece ends in one word-end id
                raw, own = ids.tobytes(), part[k * 512:(k + 1) * 512]
                if len(cuts) != len(own):
                    raise ValueError("a piece without a word end")
                bounds = [0, *(2 * cuts).tolist()]
                self.known.update((p, raw[a:b]) for p, a, b in zip(own, bounds, bounds[1:]))

    def _look_up(self, pieces: set[str]) -> None:
        new = pieces.difference(self.known)
        if len(new) + len(self.known) > CACHE_PIECES:  # this call's pieces stay
            self.known = dict(LINE) | {p: self.known[p] for p in pieces - new}
        self._learn_pieces(list(new))

    def plain(self, text: str) -> bool:
        return PLAIN.fullmatch(text) is not None and not ("<" in text and any(s in text for s in self.special))

    def encode_words(self, words: list[str]) -> list[bytes]:
        """The ids of single words (without blanks), in order. Words of the calls before are kept, up to
        a number at which those of this call alone stay."""
        new = [w for w in words if w not in self.words]
        self.words.update(zip(new, self._encode_words(new)))
        out = [self.words[w] for w in words]
        if len(self.words) > CACHE_WORDS:
            self.words = dict(zip(words, out))
        return out

    def _encode_words(self, words: list[str]) -> list[bytes]:
        out: list[bytes] = []
        for at in range(0, len(words), 1 << 16):
            part = words[at:at + (1 << 16)]
            line, odd = "\n".join(part), {}
            if not self.plain(line):
                odd = {k: t for k, t in enumerate(part) if not self.plain(t)}
                line = "\n".join("" if k in odd else t for k, t in enumerate(part))
            pieces = PIECE_OR_LINE.findall(line.lower())
            self._look_up(set(pieces))
            ids = b"".join(map(self.known.__getitem__, pieces))
            lines = np.frombuffer(ids, np.uint16)
            ends = (2 * np.flatnonzero(lines == 0xFFFF)).tolist()
            found = [ids[a:b] for a, b in zip([0, *(e + 2 for e in ends)], [*ends, len(ids)])]
            for k, e in zip(odd, self.whole.encode_batch_fast(list(odd.values()), add_special_tokens=False) if odd else ()):
                found[k] = np.array(e.ids, np.uint16).tobytes()
            out += found
        return out

    def spelled(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The number of ids of each of many words (without blanks), and these ids, end to end. Only
        pieces are kept from call to call: of a large text's distinct words most are new, of its pieces not."""
        flat = np.concatenate([np.empty(0, np.uint16), *(self._lines(words[at:at + (1 << 16)]) for at in range(0, len(words), 1 << 16))])
        line = flat == 0xFFFF
        return np.diff(np.flatnonzero(line), prepend=-1) - 1, flat[~line]

    def _lines(self, part: list[str]) -> np.ndarray:
        """The ids of each word, and behind them 65535."""
        line, odd = "\n".join(part) + "\n", {}
        if not self.plain(line):
            odd = {k: t for k, t in enumerate(part) if not self.plain(t)}
            line = "\n".join("" if k in odd else t for k, t in enumerate(part)) + "\n"
        pieces = PIECE_OR_LINE.findall(line.lower())
        self._look_up(set(pieces))
        lines = np.frombuffer(b"".join(map(self.known.__getitem__, pieces)), np.uint16)
        if odd:
            found = [e.ids for e in self.whole.encode_batch_fast(list(odd.values()), add_special_tokens=False)]
            ends = np.flatnonzero(lines == 0xFFFF)[list(odd)]
            lines = np.insert(lines, np.repeat(ends, [len(x) for x in found]), np.array([i for x in found for i in x], np.uint16))
        return lines


_encoders: dict[str, PieceEncoder] = {}


def encoder(path: str) -> PieceEncoder:
    """The worker's encoder of this file: later tasks of the same worker find its words known."""
    if path not in _encoders:
        _encoders[path] = PieceEncoder(path)
    return _encoders[path]


def gathered(word_ids: list[bytes], codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of coded words laid end to end: (ids, ids per word, ids per text)."""
    lengths = np.fromiter((len(x) // 2 for x in word_ids), np.int64, len(word_ids))
    return spread(lengths, np.frombuffer(b"".join(word_ids), np.uint16), codes, sizes)


def spread(lengths: np.ndarray, flat: np.ndarray, codes: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same from the number of ids of each word and these ids, end to end."""
    first = np.cumsum(lengths) - lengths
    per_word = lengths[codes]
    upto = np.cumsum(per_word)
    ids = flat[np.arange(upto[-1] if len(upto) else 0) + np.repeat(first[codes] - upto + per_word, per_word)]
    ends = np.concatenate(([0], upto))[np.cumsum(sizes)]
    return ids, per_word, np.diff(ends, prepend=0)
