"""Exact encoding by words for tokenizers whose pre-tokenizer drops white space: equal words are encoded once a worker.

Such a tokenizer never lets a token cross white space, so that the ids of a text are those of its words in order. The library
encodes the distinct words, many at a time with a special token between them, at whose id the result is cut again. Whether a
tokenizer is of this kind is checked when it is loaded; texts of other tokenizers go to the library whole.

If it also marks the last token of a word, takes letters and the marks behind them apart and ASCII letters of both cases alike (all
checked when it is loaded), words of letters are encoded in lower case with single blanks between them and cut behind the last tokens
of words; where their number is not the number of words, these words are encoded in the first way.
"""

from __future__ import annotations

import json
import os
import re
import string
import unicodedata

import numpy as np

os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")

#: What str.split() splits at besides the ASCII blanks.
_OTHER_SPACE = re.compile("[\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]")
_BLANKS = re.compile("[ \t\n\x0b\x0c\r]+")
#: Words in each of the two generations that a worker remembers, and words that the library gets in one text.
REMEMBER = 500_000
JOINED = 500


class WordEncoder:
    _loaded: dict[str, WordEncoder] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.vocab = self.tok.get_vocab_size()
        self.type = np.dtype("<u2") if self.vocab <= 1 << 16 else np.dtype("<u4")
        spec = json.loads(self.tok.to_str())
        self.joins_with_space = spec.get("decoder") is None
        special = [t for t in spec["added_tokens"] if t["special"] and not (t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"])]
        self.sep, self.sep_id = (special[-1]["content"], special[-1]["id"]) if special and len(special) == len(spec["added_tokens"]) else (None, None)
        self.safe = self.sep is not None and not re.search(r"\s", "".join(t["content"] for t in special)) and self._drops_blanks(spec)
        suffix = spec["model"].get("end_of_word_suffix") if self.safe else None
        self.is_last = np.zeros(self.vocab, bool)
        if suffix:
            self.is_last[[i for token, i in self.tok.get_vocab().items() if token.endswith(suffix)]] = True
        self.apart = bool(suffix) and not spec["model"].get("continuing_subword_prefix") and self._takes_marks_apart()
        self.stays: dict[str, bool] = {}
        self.known: dict[str, bytes] = {}
        self.older: dict[str, bytes] = {}

    @classmethod
    def at(cls, path: str) -> WordEncoder:
        if path not in cls._loaded:
            cls._loaded[path] = cls(path)
        return cls._loaded[path]

    def _drops_blanks(self, spec: dict) -> bool:
        pre = spec.get("pre_tokenizer") or {}
        first = (pre.get("pretokenizers") or [pre])[0]
        if not (first.get("type") == "Split" and first.get("behavior") == "Removed" and first.get("invert")):
            return False
        ids = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        words = ["ab", "'s", "x1,", "...", "\u00e9t\u00e9", "\u0301a", self.sep]
        return all(ids(f"{a}{b}{c}") == ids(a) + ids(c) for a in words for c in words for b in " \t\n\x0b\x0c\r")

    def _takes_marks_apart(self) -> bool:
        """Letters, then marks, give the ids of the letters, then those of the marks; ASCII letters give the same in both cases."""
        ids = lambda s: self.tok.encode(s, add_special_tokens=False).ids
        marks = [*string.punctuation, *(a + b for a in string.punctuation for b in string.punctuation)]
        if any(ids(f"ab{m}") != ids("ab") + ids(m) or ids(f"\u00e9{m}") != ids("\u00e9") + ids(m) for m in marks):
            return False
        return all(ids(w.upper()) == ids(w) == ids(w.capitalize()) for w in (*string.ascii_lowercase, string.ascii_lowercase, "the", "words"))

    def split(self, text: str) -> list[str]:
        if not self.safe:
            return [text] if text else []
        if _OTHER_SPACE.search(text):
            return [w for w in _BLANKS.split(text) if w]
        return text.split()

    def encode_many(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each text."""
        if not self.safe:
            return [np.array(e.ids, self.type).tobytes() for e in self.tok.encode_batch_fast(texts, add_special_tokens=False)]
        out: list[bytes | None] = [None] * len(texts)
        plain = [i for i, t in enumerate(texts) if self.sep not in t]
        groups = [plain[i : i + JOINED] for i in range(0, len(plain), JOINED)]
        between = f" {self.sep} "
        for group, e in zip(groups, self.tok.encode_batch_fast([between.join(texts[i] for i in g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            cuts = np.flatnonzero(ids == self.sep_id)
            if len(cuts) != len(group) - 1:
                raise ValueError("the tokenizer does not keep its special token apart")
            data, wide = ids.astype(self.type).tobytes(), self.type.itemsize
            starts, ends = [0, *((cuts + 1) * wide).tolist()], [*(cuts * wide).tolist(), len(data)]
            for i, a, b in zip(group, starts, ends):
                out[i] = data[a:b]
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([texts[i] for i in rest], add_special_tokens=False)):
            out[i] = np.array(e.ids, self.type).tobytes()
        return out

    def _letters(self, words: list[str]) -> list[bytes]:
        """Ids of each word of letters only."""
        groups = [words[i : i + JOINED] for i in range(0, len(words), JOINED)]
        out: list[bytes] = []
        for group, e in zip(groups, self.tok.encode_batch_fast([" ".join(g) for g in groups], add_special_tokens=False)):
            ids = np.array(e.ids, np.uint32)
            ends = np.flatnonzero(self.is_last[ids]) + 1
            if len(ends) != len(group) or (len(ids) and ends[-1] != len(ids)):  # each word has one last token at least, so equal numbers mean one each
                out += self.encode_many(group)
                continue
            data, bounds = ids.astype(self.type).tobytes(), (ends * self.type.itemsize).tolist()
            out += [data[a:b] for a, b in zip([0, *bounds], bounds)]
        return out

    def _stays_letter(self, char: str) -> bool:
        """Whether a letter ends in a letter when it is normalised; marks behind it would join a mark."""
        if char not in self.stays:
            self.stays[char] = unicodedata.normalize("NFC", unicodedata.normalize("NFC", char).lower())[-1].isalpha()
        return self.stays[char]

    def learn(self, words: set[str]) -> None:
        """After this, known has these words. What it had before moves to the older generation when it grows too large, and comes back when met again."""
        if len(self.known) > REMEMBER:
            self.known, self.older = {}, self.known
        new = words.difference(self.known) if self.known else words
        if self.older:
            older = self.older
            again = new.intersection(older)
            self.known.update((w, older[w]) for w in again)
            new = new.difference(again)
        letters = [w for w in new if w.isalpha()] if self.apart else []
        rest = list(new.difference(letters)) if letters else list(new)
        self.known.update(zip(letters, self._letters(letters)))
        self.known.update(zip(rest, self.encode_many(rest)))

    def codes(self, words: set[str]) -> dict[str, bytes]:
        """Ids of each word. What is remembered are letters in lower case and the marks behind them, where the tokenizer takes them apart."""
        if not self.apart:
            self.learn(words)
            return self.known
        marks, stems, tails = string.punctuation, [], []
        for w in words:
            stem = w if w.isalpha() else w.rstrip(marks)
            apart = stem.isalpha() and (stem is w or stem[-1].isascii() or self._stays_letter(stem[-1]))
            stems.append((stem.lower() if stem.isascii() else stem) if apart else w)
            tails.append(w[len(stem) :] if apart else "")
        self.learn({*stems, *tails} - {""})
        known = self.known
        known[""] = b""
        code = known.__getitem__
        return dict(zip(words, map(bytes.__add__, map(code, stems), map(code, tails))))

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian ids of each whole text, through the words known; what is held is bounded by groups of a few MB."""
        out, group, size = [], [], 0
        for t in texts:
            group.append(self.split(t))
            size += len(t)
            if size >= 4 << 20:
                out += self._group(group)
                group, size = [], 0
        return out + self._group(group)

    def _group(self, group: list[list[str]]) -> list[bytes]:
        words: set[str] = set()
        for g in group:
            words.update(g)
        get = self.codes(words).__getitem__
        return [b"".join(map(get, g)) for g in group]

    def ids(self, data: bytes) -> np.ndarray:
        return np.frombuffer(data, self.type)
