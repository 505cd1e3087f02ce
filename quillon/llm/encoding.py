"""Batch text-to-id encoding with the ``tokenizers`` library, memoised by word.

Byte-pair merges never cross a pre-token, so the ids of a text are the ids of
its pre-tokens one after the other. Natural text repeats its words, so a worker
asks the library's model once for each distinct pre-token and keeps the answer
in a bounded table. Splitting is done here only for the two published patterns below
and only for texts whose characters have had one fixed class in every Unicode
version and that hold no added token's string; any other file or text goes to the
library whole. The ids are those of ``Tokenizer.from_file(path).encode(text,
add_special_tokens=False)`` in every case.
"""

from __future__ import annotations

import json
import re
import unicodedata

import numpy as np
from tokenizers import Tokenizer

# The published pre-token patterns of the byte-level and the
# word-end BPE files, and the character classes they use, within Latin text.
BYTE_LEVEL_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?{L}+| ?{N}+| ?[^{s}{l}{n}]+|[{s}]+(?![^{s}])|[{s}]+"
WORD_END_PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|{L}+|{N}|[^{s}{l}{n}]+"
WORD_END_SOURCE = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
LETTERS = "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f"
NUMBERS = "0-9\u00b2\u00b3\u00b9\u00bc-\u00be"
SPACES = "\t\n\r \u00a0"
#: Characters with a settled class: printable ASCII, tab, line ends, Latin-1, Latin
#: Extended and common marks.
SETTLED = "\t\n\r\x20-\x7e\u00a0-\u024f\u2010-\u2027\u20ac"

CHUNK_CHARS = 1 << 20


def byte_letters() -> dict[int, str]:
    """The byte-level alphabet: printable Latin-1 bytes stand for themselves, the
    others for the characters from U+0100 on, in order."""
    plain = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = [b for b in range(256) if b not in plain]
    return {b: chr(b) for b in plain} | {b: chr(0x100 + k) for k, b in enumerate(rest)}


BYTE_LETTERS = byte_letters()


def _outside() -> re.Pattern:
    """Finds a character without a settled class, or whose lower case has none."""
    settled = re.compile(f"[{SETTLED}]")
    leaving = [c for c in map(chr, range(0x2028)) if settled.match(c) and not settled.fullmatch(c.lower())]
    return re.compile(f"[^{SETTLED}]|[{''.join(leaving)}]")


OUTSIDE = _outside()


def _fill(pattern: str) -> re.Pattern:
    return re.compile(
        pattern.replace("{L}", f"[{LETTERS}]")
        .replace("{N}", f"[{NUMBERS}]")
        .replace("{s}", SPACES)
        .replace("{l}", LETTERS)
        .replace("{n}", NUMBERS)
    )


class _Memo(dict):
    """Pre-token to row of the id table; a new one gets the next row."""

    def __init__(self) -> None:
        self.new: list[str] = []

    def __missing__(self, word: str) -> int:
        self[word] = row = len(self)
        self.new.append(word)
        return row


class WordEncoder:
    """Ids of whole texts. ``max_words`` bounds the memo's memory (about 80 MB)."""

    def __init__(self, path: str, max_words: int = 300_000) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.max_words = max_words
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        self.pattern, self.fold = self._splitter(spec)
        added = [t["content"] for t in spec.get("added_tokens") or []]
        self.added = [a.lower() for a in added] if self.fold else added
        self._clear()

    @staticmethod
    def _splitter(spec: dict) -> tuple[re.Pattern | None, bool]:
        pre, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
        if spec.get("post_processor") or spec["model"].get("type") != "BPE":
            return None, False
        if norm is None and pre.get("type") == "ByteLevel" and pre.get("use_regex") and not pre.get("add_prefix_space"):
            return _fill(BYTE_LEVEL_PATTERN), False
        steps = [(n["type"], n.get("pattern"), n.get("content")) for n in (norm or {}).get("normalizers", [])]
        parts = pre.get("pretokenizers", [])
        if (
            steps == [("NFC", None, None), ("Replace", {"Regex": r"\s+"}, " "), ("Lowercase", None, None)]
            and [p["type"] for p in parts] == ["Split", "ByteLevel"]
            and parts[0]["pattern"] == {"Regex": WORD_END_SOURCE}
            and parts[0]["behavior"] == "Removed"
            and parts[0]["invert"]
            and not parts[1]["use_regex"]
        ):
            return _fill(WORD_END_PATTERN), True
        return None, False

    def _clear(self) -> None:
        self.memo = _Memo()
        self.starts = np.zeros(1, np.int64)
        self.flat = np.zeros(0, np.uint32)

    def _learn(self) -> None:
        """Ask the library for the ids of the pre-tokens met for the first time."""
        words = self.memo.new
        if not words:
            return
        self.memo.new = []
        model, flat, counts = self.tokenizer.model, [], []
        for word in words:
            ids = [t.id for t in model.tokenize(word.encode("utf-8").decode("latin-1").translate(BYTE_LETTERS))]
            flat += ids
            counts.append(len(ids))
        self.flat = np.concatenate([self.flat, np.array(flat, np.uint32)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(counts)])

    def _whole(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, np.uint32)

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """(all ids one after the other, number of ids of each text); null is empty."""
        ids, counts, at = [np.zeros(0, np.uint32)], [np.zeros(0, np.int64)], 0
        while at < len(texts):
            end, chars = at, 0
            while end < len(texts) and (end == at or chars + len(texts[end] or "") <= CHUNK_CHARS):
                chars += len(texts[end] or "")
                end += 1
            flat, count = self._chunk([t or "" for t in texts[at:end]])
            ids.append(flat)
            counts.append(count)
            at = end
        return np.concatenate(ids), np.concatenate(counts)

    def _chunk(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if len(self.memo) > self.max_words:
            self._clear()
        rows: list[np.ndarray | None] = []
        for text in texts:
            if self.pattern is None or OUTSIDE.search(text):
                rows.append(None)
                continue
            if self.fold:
                text = unicodedata.normalize("NFC", text).lower()
            if any(a in text for a in self.added):
                rows.append(None)
                continue
            words = self.pattern.findall(text)
            rows.append(np.fromiter(map(self.memo.__getitem__, words), np.int64, len(words)))
        self._learn()
        parts, counts = [np.zeros(0, np.uint32)], np.zeros(len(texts), np.int64)
        lengths = np.diff(self.starts)
        for i, (text, row) in enumerate(zip(texts, rows, strict=True)):
            if row is None:
                own = self._whole(text)
            else:
                n = lengths[row]
                ends = np.cumsum(n)
                total = int(ends[-1]) if len(ends) else 0
                own = self.flat[np.arange(total) + np.repeat(self.starts[row] - (ends - n), n)]
            parts.append(own)
            counts[i] = len(own)
        return np.concatenate(parts), counts


_ENCODERS: dict[str, WordEncoder] = {}


def encoder(path: str) -> WordEncoder:
    """The worker's encoder for a file; Spark reuses workers, so it stays warm."""
    if path not in _ENCODERS:
        _ENCODERS.clear()
        _ENCODERS[path] = WordEncoder(path)
    return _ENCODERS[path]
