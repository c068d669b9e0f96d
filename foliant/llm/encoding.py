"""Token ids of whole texts with a word-level byte-pair tokenizer file, exact and much faster than text by text.

The tokenizer drops white space, so ids never reach over it: a text's ids are its words' ids in order. Nor do they reach from letters to
what is no letter, so texts of few kinds of characters are cut there too. Each worker keeps the ids of the words it has met; new words are
cut, many at a time, into the tokenizer's own pre-tokens, which repeat more often.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import regex

#: Words of one generation, and pre-tokens, that a worker keeps; those not met in two generations are forgotten, which changes no result.
KEPT = 200_000
#: The same beside other operators in one job, whose heaps are full by then.
KEPT_BESIDE_OTHERS = 60_000
#: New words, or pre-tokens, that are handled as one text.
RUN = 200
#: Stands for the line end between words; no id has this value.
LINE = b"\xff\xff\xff\xff"
#: Words of these characters only are cut here; all others go to the tokenizer whole. They are their own NFC form.
_PLAIN = regex.compile("[\x21-\x7eÀ-ɏ]+")
#: Bytes of the texts that are cut at the edges of letters: white space, ASCII without the apostrophe (some of its pre-tokens take letters along), and À-ÿ.
_SIMPLE = bytes({*b" \t\n\r\x0b\x0c", *range(0x21, 0x7f), 0xc3, *range(0x80, 0xc0)} - {0x27})
#: What is no letter among them, and the begin of a mark.
_UNLIKE = re.compile(rb"\xc3[\x97\xb7]|<\|")
_RUNS = re.compile(rb"[a-z\x80-\xff]+|[^a-z\x80-\xff\s]+")
_LETTERS = re.compile(rb"(?:[a-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])+").fullmatch
#: The pre-tokens for which cutting at the edges of letters was thought through; with others, texts are cut at white space only.
_KNOWN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"


class WordEncoder:
    """ids(texts): for each text the ids as little-endian unsigned 32-bit integers; null counts as empty."""

    def __init__(self, path: str, kept: int = KEPT):
        self.kept = kept
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        import json

        with open(path) as f:
            spec = json.load(f)
        pattern = next(x["pattern"]["Regex"] for x in spec["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split")
        # White space is in no pre-token, so a line end between words comes out on its own.
        self.split = regex.compile(pattern + r"|\n")
        self.by_letters = pattern == _KNOWN
        self.mark = regex.compile("|".join(regex.escape(x["content"]) for x in spec["added_tokens"]) or r"(?!)")
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith(spec["model"]["end_of_word_suffix"])]] = True
        self.words: dict[bytes, bytes] = {}
        self.pieces: dict[str, bytes] = {"\n": LINE}
        self.old_words: dict[bytes, bytes] = {}

    def _whole(self, texts: list[str]) -> list[bytes]:
        return [np.array(e.ids, "<u4").tobytes() for e in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def _encoded(self, new: list) -> Iterator[tuple]:
        """Each pre-token, text or bytes, with its ids. Many go to the tokenizer as one text; the end-of-word tokens tell them apart again."""
        for start in range(0, len(new), 100 * RUN):
            runs = [new[i:i + RUN] for i in range(start, min(start + 100 * RUN, len(new)), RUN)]
            texts = [" ".join(r) if isinstance(r[0], str) else b" ".join(r).decode() for r in runs]
            for run, text, ids in zip(runs, texts, self._whole(texts)):
                ends = ((np.flatnonzero(self.ends[np.frombuffer(ids, "<u4")]) + 1) * 4).tolist()
                if len(ends) == len(run) and ends[-1] == len(ids):
                    yield from zip(run, (ids[a:b] for a, b in zip([0, *ends], ends)))
                else:
                    yield from zip(run, self._whole(text.split(" ")))

    def _plain(self, words: list[bytes]) -> bool:
        text = b"".join(words).decode()
        return _PLAIN.fullmatch(text) is not None and not self.mark.search(text)

    def _learn(self, new: list[bytes]) -> None:
        """Plain words are cut into pre-tokens, run by run; all others go to the tokenizer one by one."""
        old = self.old_words
        self.words.update((w, old[w]) for w in new if w in old)
        new = [w for w in new if w not in old]
        runs, odd = [], []
        for start in range(0, len(new), RUN):
            run = new[start:start + RUN]
            if not self._plain(run):
                plain = [self._plain([w]) for w in run]
                odd += [w for w, p in zip(run, plain) if not p]
                run = [w for w, p in zip(run, plain) if p]
            if run:
                runs.append((run, self.split.findall(b"\n".join(run).decode().lower())))
        pieces = self.pieces
        pieces.update(self._encoded(list(set(chain.from_iterable(parts for _, parts in runs)).difference(pieces))))
        for run, parts in runs:
            ids = b"".join(map(pieces.__getitem__, parts))
            lines = (np.flatnonzero(np.frombuffer(ids, "<u4") == 0xFFFFFFFF) * 4).tolist()
            self.words.update(zip(run, (ids[a:b] for a, b in zip([0, *(x + 4 for x in lines)], [*lines, len(ids)]))))
        self.words.update(zip(odd, self._whole([w.decode() for w in odd])))

    def _turn(self) -> None:
        """Begin a generation of words; what it meets again comes over from the one before. Pre-tokens start anew."""
        if len(self.words) > self.kept:
            self.old_words, self.words = self.words, {}
        if len(self.pieces) > self.kept:
            self.pieces = {"\n": LINE}

    def _cut(self, text: bytes) -> list[bytes]:
        """Runs of letters, ASCII ones in lower case, and of other characters; of other texts than the simple ones the words."""
        if self.by_letters and not text.translate(None, _SIMPLE) and not _UNLIKE.search(text):
            return _RUNS.findall(text.lower())
        return text.split()

    def _learn_letters(self, new: list[bytes]) -> None:
        """Runs of letters are pre-tokens as they are."""
        old = self.old_words
        self.words.update((w, old[w]) for w in new if w in old)
        self.words.update(self._encoded([w for w in new if w not in old]))

    def ids(self, texts: list[bytes | None]) -> list[bytes]:
        self._turn()
        split = [self._cut(t or b"") for t in texts]
        words = self.words
        new = set(chain.from_iterable(split)).difference(words)
        if new:
            letters = {w for w in new if _LETTERS(w)}
            self._learn_letters(list(letters))
            self._learn(list(new - letters))
        return [b"".join(map(words.__getitem__, parts)) for parts in split]


@lru_cache(maxsize=2)
def encoder(path: str, kept: int = KEPT) -> WordEncoder:
    """One per worker process and file."""
    return WordEncoder(path, kept)
