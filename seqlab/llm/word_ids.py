"""Token ids of texts by a public tokenizer whose vocabulary drops white space, one distinct word at a time."""

from __future__ import annotations

import os
import re

import numpy as np

END = 2
CLOSING = "</w>"  # ends the last token of a word
CACHE_WORDS = 200_000
CACHE_RUNS = 200_000
# Words of these characters alone (no apostrophe) are cut by the tokenizer into runs of letters, single digits and
# runs of other signs, each encoded on its own in lower case.
_PLAIN = re.compile(r"[!-&(-~À-ÖØ-öø-ÿ]*")
_RUNS = re.compile(r"[a-zß-öø-ÿ]+|[0-9]|[^a-z0-9ß-öø-ÿ]+")


def byte_signs(text: str) -> str:
    """Each UTF-8 byte of runs (and spaces between them) as the sign that byte-level vocabularies write it with.

    Letters of runs are ASCII or ß to ÿ. Of their bytes, three have no printable sign of their own.
    """
    if text.isascii():
        return text
    return text.encode().decode("latin-1").replace("\x9f", "\u0141").replace("\xa0", "\u0142").replace("\xad", "\u0143")


class Recent:
    """A cache of two generations: when one is full the older is dropped, and what is asked for again moves up."""

    def __init__(self, most: int):
        self.most, self.now, self.older = most, {}, {}

    def lacking(self, keys: set) -> list:
        """Move known keys to the present generation; the others are left to ``add``."""
        if len(self.now) >= self.most:
            self.now, self.older = {}, self.now
        lacking = []
        for k in keys.difference(self.now):
            got = self.older.get(k)
            if got is None:
                lacking.append(k)
            else:
                self.now[k] = got
        return lacking


class WordIds:
    """Ids of ``tokenizer.encode(text, add_special_tokens=False)`` from caches of words and of runs in words.

    White space separates words for good in this tokenizer (it is removed, and no rule joins what it
    separates), so a text's ids are those of its words in order. Runs of plain words need none of its
    normalising and splitting: new ones are encoded together, a space between them.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = None
        self.plain.pre_tokenizer = pre_tokenizers.CharDelimiterSplit(" ")
        self.closing = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.closing[[i for token, i in self.tokenizer.get_vocab().items() if token.endswith(CLOSING)]] = True
        self.kind = np.uint16 if self.tokenizer.get_vocab_size() <= 1 << 16 else np.uint32
        self.bound()

    def bound(self, words: int = CACHE_WORDS, runs: int = CACHE_RUNS) -> None:
        """Empty the caches; each generation of them takes so many entries from now on."""
        self.words, self.runs = Recent(words), Recent(runs)

    def _learn_runs(self, runs: set[str]) -> None:
        new, width = self.runs.lacking(runs), np.dtype(self.kind).itemsize
        for at in range(0, len(new), 4096):
            part = new[at: at + 4096]
            text = byte_signs(" ".join(part))
            # the form without offsets and word numbers: a run ends with the one of its tokens that closes a word
            ids = np.array(self.plain.encode_batch_fast([text], add_special_tokens=False)[0].ids, self.kind)
            ends = np.flatnonzero(self.closing[ids]) + 1
            if len(ends) != len(part):  # a vocabulary without a closing token for each byte
                ends = np.searchsorted(np.array(self.plain.encode(text, add_special_tokens=False).word_ids), np.arange(1, len(part) + 1))
            cuts, data = [0, *(ends * width).tolist()], ids.tobytes()
            for run, a, b in zip(part, cuts[:-1], cuts[1:]):
                self.runs.now[run] = data[a:b]

    def _learn(self, words: set[bytes]) -> None:
        new, cut = self.words.lacking(words), {}
        letters = [w for w in new if w.isalpha()]  # ASCII letters alone: one run
        lower = [w.decode() for w in map(bytes.lower, letters)]
        runs = set(lower)
        for word in new:
            if word.isalpha():
                continue
            last = word[-1]
            if 33 <= last <= 126 and last != 39 and word[:-1].isalpha():  # a run and one sign or digit, the common case
                cut[word] = own = (word[:-1].lower().decode(), chr(last))
                runs.update(own)
                continue
            text = word.decode()
            if "<|" in text or not _PLAIN.fullmatch(text):  # may hold an added token, or need the tokenizer's own rules
                self.words.now[word] = np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, self.kind).tobytes()
            else:
                cut[word] = own = _RUNS.findall(text.lower())
                runs.update(own)
        self._learn_runs(runs)
        of = self.runs.now
        self.words.now.update(zip(letters, map(of.__getitem__, lower)))
        for word, own in cut.items():
            self.words.now[word] = b"".join([of[r] for r in own])

    def packed(self, texts: list[str | None]) -> list[bytes]:
        """Ids of each text, packed; null is an empty text."""
        # bytes are split at ASCII white space only
        words = [(t or "").encode("utf-8", "replace").split() for t in texts]
        self._learn(set().union(*words))
        of = self.words.now.__getitem__
        return [b"".join(map(of, w)) for w in words]


_LOADED: dict[str, WordIds] = {}


def loaded(path: str) -> WordIds:
    """One tokenizer per Python worker."""
    if path not in _LOADED:
        _LOADED[path] = WordIds(path)
    return _LOADED[path]
