"""Subword ids of a public tokenizer, memoised word by word inside a task.

The tokenizer (``word_bpe_49k.json``) normalises character by character, treats
white space as a gap and merges within letter runs only, so the ids of a text are
the ids of its white-space words in order.  A task keeps the words it has met in
two generations of bounded size; results don't depend on what is kept.

Words of printable ASCII and Latin-1 letters are cut into runs here and only
unknown runs go to the tokenizer's merges, many per call.  Any other word takes the
tokenizer's whole path (NFC, white space, lower case, cutting).
"""

from __future__ import annotations

import os
import re

import numpy as np

from ratewise.llm.common import words as split

KEPT_WORDS = 400_000
KEPT_RUNS = 150_000
LONG_WORD = 128  # bytes; longer words are not kept

# The tokenizer's own cutting pattern, for lower-case ASCII and Latin-1 letters.
RUNS = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^a-zß-öø-ÿ0-9]+")
PLAIN = re.compile(r"[\x21-\x7eÀ-ÿ]*\Z")

_ENCODERS: dict[str, Encoder] = {}


def default_path() -> str:
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


class Encoder:
    def __init__(self, path: str) -> None:
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole = Tokenizer.from_file(path)
        self.whole.encode_special_tokens = True
        self.merges = Tokenizer.from_file(path)
        self.merges.encode_special_tokens = True
        self.merges.normalizer = normalizers.Sequence([])
        self.merges.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        # Strings of special tokens are found in the raw text, before anything is lower-cased.
        added = {t.content.encode(): i for i, t in self.whole.get_added_tokens_decoder().items()}
        self.special = {t: np.array([i], "<u4").tobytes() for t, i in added.items()}
        self.cuts = re.compile(b"(" + b"|".join(re.escape(t) for t in sorted(added, key=len, reverse=True)) + b")") if added else None
        # The vocabulary marks the last token of a run.
        self.last = np.zeros(self.whole.get_vocab_size(), bool)
        self.last[[i for t, i in self.whole.get_vocab().items() if t.endswith("</w>")]] = True
        # Young and old generation of each memo.
        self.words: dict[bytes, bytes] = {}
        self.old_words: dict[bytes, bytes] = {}
        self.runs: dict[str, bytes] = {}
        self.old_runs: dict[str, bytes] = {}

    def _merge(self, runs: list[str]) -> None:
        """Ids of unknown runs into the memo: one call, cut apart again after each last token."""
        got = np.array(self.merges.encode_batch_fast([" ".join(runs)], add_special_tokens=False)[0].ids, np.uint32)
        ids, ends = got.tobytes(), ((np.flatnonzero(self.last[got]) + 1) * 4).tolist()
        if len(self.runs) >= KEPT_RUNS:
            self.old_runs, self.runs = self.runs, {}
        memo, last = self.runs, 0
        for run, end in zip(runs, ends, strict=True):
            memo[run] = ids[last:end]
            last = end

    def _learn(self, missing: set[bytes]) -> None:
        """Ids of ``missing`` words into the memo."""
        memo, old, runs, old_runs = self.words, self.old_words, self.runs, self.old_runs
        cut: list[tuple[bytes, list[str]]] = []
        fresh: set[str] = set()
        for w in missing:
            ids = old.get(w)
            if ids is not None:
                memo[w] = ids
                continue
            text = w.decode("utf-8", "replace")
            if PLAIN.match(text):
                own = RUNS.findall(text.lower())
                cut.append((w, own))
                for r in own:
                    if r not in runs:
                        if r in old_runs:
                            runs[r] = old_runs[r]
                        else:
                            fresh.add(r)
            else:
                memo[w] = np.array(self.whole.encode(text, add_special_tokens=False).ids, np.uint32).tobytes()
        if fresh:
            self._merge(list(fresh))
        runs, old_runs = self.runs, self.old_runs
        for w, own in cut:
            memo[w] = b"".join([runs[r] if r in runs else old_runs[r] for r in own])
        for r in fresh:
            if len(r) > LONG_WORD:
                runs.pop(r, None)

    def encode_each(self, words: list[bytes]) -> list[bytes]:
        """Ids of each of many distinct words, without keeping them."""
        kept, self.words = self.words, {}
        self._learn(set(words))
        found, self.words = self.words, kept
        return [found[w] for w in words]

    def encode(self, words: list[bytes]) -> bytes:
        """Little-endian unsigned 32-bit ids of a text given as its words."""
        missing = set(words).difference(self.words)
        if missing:
            if len(self.words) + len(missing) > KEPT_WORDS and self.words:
                self.old_words, self.words = self.words, {}
                missing = set(words)
            self._learn(missing)
        out = b"".join(map(self.words.__getitem__, words))
        for w in missing:
            if len(w) > LONG_WORD:
                del self.words[w]
        return out


    def encode_text(self, data: bytes | None) -> bytes:
        """Ids of a whole text as the tokenizer itself gives them (special-token strings
        included, start and end tokens not added)."""
        if not data:
            return b""
        if self.cuts is None or b"<|" not in data and not self.cuts.search(data):
            return self.encode(split(data))
        return b"".join(self.special.get(part) or self.encode(split(part)) for part in self.cuts.split(data))


def encoder(path: str) -> Encoder:
    """One encoder for each Python worker and file."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]
