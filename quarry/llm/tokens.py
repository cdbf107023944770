"""Word-wise encoding with the tokenizers library, for vocabularies that never merge across white space."""

from __future__ import annotations

import os
import re
from array import array
from collections.abc import Iterable

import numpy as np

from .common import claim

#: Distinct words that a Python worker remembers before it starts anew; it bounds memory, not results.
REMEMBERED = 1_500_000

#: Words of letters that the library encodes in one text.
RUN = 256

#: Letters, then ASCII marks other than the apostrophe, to the end.
_MARKED = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]+)").fullmatch

_encoders: dict[str, WordEncoder] = {}


class WordEncoder:
    """Encodes each distinct word once while it is remembered, and texts by looking words up.

    Right for tokenizers whose normaliser and pre-tokenizer treat ASCII white space as a border
        that leaves nothing behind and ignore the case of A to Z, as that of ``word_bpe_49k.json`` does. Special strings hold no
    white space and begin with a mark, so the library finds them within words. Where marks follow
    letters, the library itself is asked whether they are a pre-token of their own.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(tokenizer_path(path))
        self.vocabulary = self.tokenizer.get_vocab_size(with_added_tokens=True)
        self.dtype = np.dtype("<u2" if self.vocabulary <= 1 << 16 else "<u4")
        self.code = "H" if self.dtype.itemsize == 2 else "I"
        suffix = getattr(self.tokenizer.model, "end_of_word_suffix", None)
        # Whether an id closes a word; without such a sign nothing does, and each word is encoded by itself.
        self.closing = np.zeros(self.vocabulary, bool)
        if suffix:
            self.closing[[i for p, i in self.tokenizer.get_vocab(with_added_tokens=True).items() if p.endswith(suffix)]] = True
        self.known: dict[bytes, bytes] = {}
        self.parts: dict[str, bytes] = {}
        self.borders: dict[str, bool] = {}

    def encode(self, texts: Iterable[bytes | None]) -> list[np.ndarray]:
        """The ids of each text (UTF-8; None is empty)."""
        split = [(t or b"").split() for t in texts]
        words = set().union(*split)
        if len(self.known) + len(words) > REMEMBERED:
            self.known.clear()
            self.parts.clear()
        self._learn([w for w in words if w not in self.known])
        look = self.known.__getitem__
        return [np.frombuffer(b"".join(map(look, words)), self.dtype) for words in split]

    def _ends(self, head: str) -> bool:
        """Whether marks after ``head`` are a pre-token of their own, which its last normalised character decides."""
        last = self.tokenizer.normalizer.normalize_str(head)[-1:] if self.tokenizer.normalizer else head[-1:]
        if last not in self.borders:
            cut = self.tokenizer.pre_tokenizer.pre_tokenize_str(f"{last}].") if last else []
            self.borders[last] = bool(cut) and cut[0][1] == (0, len(last))
        return self.borders[last]

    def _learn(self, words: list[bytes]) -> None:
        """Remember words; the marks after a word's letters are pre-tokens of their own, so both are looked up apart."""
        cut = []
        for w in words:
            if w.isalpha():
                cut.append((w, w.decode().lower(), ""))
                continue
            text = w.decode()
            m = _MARKED(text)
            head, tail = m.groups() if m else (text, "")
            if head.isascii():
                head = head.lower()
            elif tail and not self._ends(head):
                head, tail = text, ""
            cut.append((w, head, tail))
        parts = self.parts
        fresh = list({p for _, *both in cut for p in both if p not in parts})
        letters = [p for p in fresh if p.isalpha()]
        others = [p for p in fresh if not p.isalpha()]
        runs = [letters[at : at + RUN] for at in range(0, len(letters), RUN)]
        for start in range(0, len(runs), 100):
            some = runs[start : start + 100]
            for run, e in zip(some, self.tokenizer.encode_batch_fast([" ".join(run) for run in some], add_special_tokens=False), strict=True):
                ids = np.array(e.ids, self.dtype)
                ends = np.flatnonzero(self.closing[ids]) + 1
                # Letters are one pre-token each; where the library sees it otherwise, each is encoded by itself.
                if len(ends) != len(run):
                    others += run
                    continue
                data, size, begin = ids.tobytes(), self.dtype.itemsize, 0
                for p, end in zip(run, ends.tolist(), strict=True):
                    parts[p] = data[begin * size : end * size]
                    begin = end
        for start in range(0, len(others), 10_000):
            part = others[start : start + 10_000]
            done = self.tokenizer.encode_batch_fast(part, add_special_tokens=False)
            parts.update((p, array(self.code, e.ids).tobytes()) for p, e in zip(part, done, strict=True))
        self.known.update((w, parts[head] + parts[tail]) for w, head, tail in cut)


def tokenizer_path(name: str) -> str:
    """The place of a vocabulary file: a bare name is one of the public tokenizers, on whichever machine this runs."""
    if os.sep in name:
        return name
    import public_tokenizers

    return public_tokenizers.path(name)


def word_encoder(path: str) -> WordEncoder:
    """The worker's encoder for this file; workers are reused, and so is what they remember."""
    claim("words", _encoders.clear)
    if path not in _encoders:
        _encoders[path] = WordEncoder(path)
    return _encoders[path]
