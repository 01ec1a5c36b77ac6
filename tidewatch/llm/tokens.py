"""Exact ids of the word-BPE tokenizer at the speed of a word table.

The tokenizer lower-cases, cuts a text into words and encodes every word by itself; no word spans
white space. So a text of the plain alphabet (Latin letters, general punctuation, currency signs)
is split at white space, and each distinct piece is cut and encoded once; two bounded tables hold
the ids of the pieces and words seen. Fresh words are merged by the file's own merge ranks, with
the word's end as a byte of its own that merges first. Any other text, and any text that spells a
special token, goes through the tokenizer itself: a special token in a text gets its id, as the file defines it.
"""

from __future__ import annotations

import re
import unicodedata
from array import array

import numpy as np

#: Words kept in a worker's table before it starts anew.
TABLE_WORDS = 150_000


def _class(*kinds: str) -> str:
    points = [c for c in (*range(0x250), *range(0x2000, 0x2070), *range(0x20A0, 0x20C0)) if unicodedata.category(chr(c))[0] in kinds]
    spans, out = [], []
    for c in points:
        if spans and spans[-1][1] == c - 1:
            spans[-1][1] = c
        else:
            spans.append([c, c])
    for a, b in spans:
        out.append(re.escape(chr(a)) + ("-" + re.escape(chr(b)) if b > a else ""))
    return "".join(out)


_LETTER, _NUMBER = _class("L"), _class("N")
_WORD = re.compile(rf"'s|'t|'re|'ve|'m|'ll|'d|[{_LETTER}]+|[{_NUMBER}]|[^\s{_LETTER}{_NUMBER}]+")
_STRANGE = re.compile("[^\t\n\r\x20-\x7e\xa0-˿‐-‧‰-⁞₠-₿]|[İɐ-˿]|<\\|")


#: Control characters, on which notions of white space differ, and no-break space's neighbours.
_CONTROLS = bytes(c for c in (*range(0x20), *range(0x7F, 0xA0)) if c not in (9, 10, 13))


def _is_plain(text: str) -> bool:
    try:
        raw = text.encode("latin-1")
    except UnicodeEncodeError:
        return not _STRANGE.search(text)
    return len(raw.translate(None, _CONTROLS)) == len(raw) and b"<|" not in raw


def _byte_of_letter() -> dict[str, int]:
    """The byte-level alphabet: printable bytes stand for themselves, the others for U+0100 and up, in order."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [c for c in range(256) if c not in shown]
    return {chr(c): c for c in shown} | {chr(0x100 + i): c for i, c in enumerate(hidden)}


class WordBpe:
    """ids(text) as bytes: little-endian unsigned 32-bit ids, as the tokenizer file gives them."""

    END = "\x01"

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as file:
            model = json.load(file)["model"]
        letters, vocabulary = _byte_of_letter(), model["vocab"]

        def raw(token: str) -> bytes:
            body, end = (token[:-4], b"\x01") if token.endswith("</w>") else (token, b"")
            return bytes(letters[c] for c in body) + end

        singles = [c for c in letters]
        order = singles + [c + "</w>" for c in singles]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        order += [a + b for a, b in merges]
        ranks: dict[bytes, int] = {}
        ids = []
        for token in order:
            if raw(token) not in ranks:
                ranks[raw(token)] = len(ids)
                ids.append(vocabulary[token])
        self.id_of = np.array(ids, np.uint32)
        self.ends = np.zeros(len(ids), bool)
        for token, rank in ranks.items():
            self.ends[rank] = token.endswith(b"\x01") and token != b"\x01"
        self.merger = tiktoken.Encoding("word", pat_str="[^\x01]+\x01", mergeable_ranks=ranks, special_tokens={})
        self.pieces: dict[str, bytes] = {}
        self.words: dict[str, bytes] = {}

    def _learn(self, pieces: list[str]) -> None:
        """Put the ids of new pieces into the table."""
        cut = [_WORD.findall(p) for p in pieces]
        known = self.words
        fresh = list({w for words in cut for w in words if w not in known})
        if fresh:
            ranks = np.asarray(self.merger.encode_to_numpy(self.END.join(fresh) + self.END, disallowed_special=()))
            ends = (np.flatnonzero(self.ends[ranks]) + 1) * 4
            if len(ends) != len(fresh):
                raise ValueError("the merge table does not end every word")
            ids, at = self.id_of[ranks].astype("<u4").tobytes(), 0
            for word, end in zip(fresh, ends.tolist(), strict=True):
                known[word] = ids[at:end]
                at = end
        for piece, words in zip(pieces, cut, strict=True):
            self.pieces[piece] = known[words[0]] if len(words) == 1 else b"".join([known[w] for w in words])

    def exact(self, text: str) -> bytes:
        """By the tokenizer itself."""
        return array("I", self.tokenizer.encode(text, add_special_tokens=False).ids).tobytes()

    def ids(self, texts: list[str]) -> list[bytes]:
        if len(self.pieces) > TABLE_WORDS:
            self.pieces.clear()
        if len(self.words) > TABLE_WORDS:
            self.words.clear()
        table, out = self.pieces, []
        for text in texts:
            if not _is_plain(text):
                out.append(self.exact(text))
                continue
            if not unicodedata.is_normalized("NFC", text):
                text = unicodedata.normalize("NFC", text)
            pieces = text.lower().split()
            try:
                out.append(b"".join([table[p] for p in pieces]))
            except KeyError:
                self._learn([p for p in set(pieces) if p not in table])
                out.append(b"".join([table[p] for p in pieces]))
        return out
