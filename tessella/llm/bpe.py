"""Byte-level and word-end BPE vocabularies of the tokenizers library, with a bounded cache of what words encode to.

Cutting a text at a space is safe only where neither library state nor the pre-tokenizer can reach across it; see
SAFE_SPACE and the two users of this module.
"""

from __future__ import annotations

import os
import re
import unicodedata
from collections.abc import Callable, Iterable
from functools import lru_cache

import numpy as np

CACHE_ENTRIES = 250_000
#: A single space between two characters that are surely not white space for any of the libraries.
SAFE_SPACE = r"(?<=[!-~¡-ᙿ]) (?=[!-~¡-ᙿ])"


@lru_cache(4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # one thread a task: Spark deals out the cores
    from tokenizers import Tokenizer

    made = Tokenizer.from_file(path)
    made.no_truncation()
    made.no_padding()
    return made


def vocabulary(name: str) -> str:
    """The place of a public vocabulary file; the same on every machine that has the package."""
    import public_tokenizers

    return public_tokenizers.path(name)


def shown_bytes() -> dict[str, int]:
    """The byte of each character of byte-level vocabularies: the printable ones stand for themselves, the others for the
    characters from 256 on."""
    shown = [b for b in range(256) if chr(b).isprintable() and b not in (32, 0xAD)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}


@lru_cache(4)
def byte_level_ranks(path: str):
    """(an encoder by ranks that gives the file's ids, the strings of its special tokens); no encoder if the file is not
    plain byte-level BPE whose merges are numbered in the order in which they are made."""
    import json

    import public_tokenizers
    import tiktoken

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    specials = [t["content"] for t in spec.get("added_tokens", ())]
    pre, model = spec.get("pre_tokenizer") or {}, spec["model"]
    plain = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and spec.get("normalizer") is None
    if not plain or model.get("type", "BPE") != "BPE" or model.get("end_of_word_suffix") or model.get("continuing_subword_prefix") or model.get("dropout"):
        return None, specials
    byte_of = shown_bytes()
    merges = ["".join(m) if isinstance(m, list) else m.replace(" ", "") for m in model["merges"]]
    order = [model["vocab"][m] for m in merges]
    if order != sorted(order):
        return None, specials
    ranks = {bytes(byte_of[c] for c in token): i for token, i in model["vocab"].items() if token not in specials}
    return tiktoken.Encoding("file", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}), specials


class WordEnds:
    """An encoder by ranks of a word-end BPE file, for text whose normal form and words are certain.

    A word's end is a space behind it: a byte that no word holds. A byte and that space merge before all else, as the file's
    first symbols are bytes with the suffix. The ids are the library's if every entry of the vocabulary, encoded by itself, is
    one token, so that no other pair of tokens than the file's merge ever makes it (the tests ask the library)."""

    #: In these characters the normal form is the text itself but for lower case and white space, character by character.
    TEXT = re.compile(r"[\t\n\r -~¡-įı-ſ]*")
    #: Merging a word by ranks takes the square of its length.
    LONGEST = 256

    def __init__(self, vocab: dict[str, int], specials: list[str], pattern: str):
        import tiktoken

        byte_of, self.specials = shown_bytes(), specials
        ranks = {}
        for token, i in vocab.items():
            if token not in specials:
                ended = token.endswith("</w>") and len(token) > 4
                ranks[bytes(byte_of[c] for c in (token[:-4] if ended else token)) + b" " * ended] = i
        n = max(vocab.values()) + 1
        self.ends, self.lengths = np.zeros(n + 1, bool), np.zeros(n + 1, np.int64)
        for token, i in ranks.items():
            self.ends[i], self.lengths[i] = token.endswith(b" "), len(token)
        chars = [c for c in map(chr, range(33, 0x180)) if self.TEXT.fullmatch(c)]
        kind = lambda k: "".join(re.escape(c) for c in chars if unicodedata.category(c)[0] == k)
        self.words = re.compile(pattern.replace(r"\p{L}", kind("L")).replace(r"\p{N}", kind("N")))
        self.encoding = tiktoken.Encoding("file", pat_str=r"[^ ]+ ", mergeable_ranks=ranks | {b" ": n}, special_tokens={})

    def takes(self, text: str) -> bool:
        return self.TEXT.fullmatch(text) is not None and not any(s in text for s in self.specials)

    def _ids(self, words: list[str]) -> np.ndarray:
        return np.array(self.encoding.encode_ordinary(" ".join(words) + " ") if words else [], np.int64)

    def counts(self, texts: list[str]) -> list[int] | None:
        """Tokens of each text; None if a word is too long. takes() must hold for all."""
        split = [self.words.findall(t.lower()) for t in texts]
        flat = [w for words in split for w in words]
        if max(map(len, flat), default=0) > self.LONGEST:
            return None
        after = np.concatenate([[0], np.flatnonzero(self.ends[self._ids(flat)]) + 1])
        return np.diff(after[np.concatenate([[0], np.cumsum([len(words) for words in split])])]).tolist()

    def encode(self, text: str) -> tuple[list[int], list[int]] | None:
        """ids and the character at which each begins; None if a word is too long. takes() must hold."""
        found = list(self.words.finditer(text.lower()))
        words = [m.group() for m in found]
        if max(map(len, words), default=0) > self.LONGEST:
            return None
        if not words:
            return [], []
        ids = self._ids(words)
        data = np.frombuffer((" ".join(words) + " ").encode(), np.uint8)
        character = np.cumsum((data & 0xC0) != 0x80) - 1
        lengths, ends = self.lengths[ids], self.ends[ids]
        word = np.cumsum(ends) - ends
        joined = np.cumsum([0] + [len(w) + 1 for w in words[:-1]])
        places = character[np.cumsum(lengths) - lengths] + (np.array([m.start() for m in found]) - joined)[word]
        return ids.tolist(), places.tolist()


@lru_cache(4)
def word_ends(path: str) -> WordEnds | None:
    """None if the file is not word-end BPE of the known normal form and words, with merges numbered as they are made."""
    import json

    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    model, vocab = spec["model"], spec["model"]["vocab"]
    normal = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
    split, level = (spec.get("pre_tokenizer") or {}).get("pretokenizers", [{}, {}])[:2]
    pattern = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
    known = (
        (spec.get("normalizer") or {}).get("normalizers") == normal
        and split == {"type": "Split", "pattern": {"Regex": pattern}, "behavior": "Removed", "invert": True}
        and (level.get("type"), level.get("add_prefix_space"), level.get("use_regex")) == ("ByteLevel", False, False)
        and model.get("type", "BPE") == "BPE"
        and model.get("end_of_word_suffix") == "</w>"
        and not any(model.get(k) for k in ("dropout", "continuing_subword_prefix", "ignore_merges", "byte_fallback"))
        and all(not (t["normalized"] or t["single_word"] or t["lstrip"] or t["rstrip"]) for t in spec.get("added_tokens", ()))
    )
    if not known:
        return None
    order = [vocab["".join(m) if isinstance(m, list) else m.replace(" ", "")] for m in model["merges"]]
    first = [vocab.get(c + end, -1) for end in ("", "</w>") for c in shown_bytes()]
    if order != sorted(order) or min(first) < 0 or max(first) > order[0]:
        return None
    return WordEnds(vocab, [t["content"] for t in spec.get("added_tokens", ())], pattern)


class WordCache:
    """What encoded words give, in two generations: words that are met again move to the young one, and when that is
    full the old one is dropped. So a worker's memory is bounded and common words stay."""

    def __init__(self, entries: int = CACHE_ENTRIES):
        self.young: dict = {}
        self.old: dict = {}
        self.entries = entries

    def known(self, words: Iterable[str], encode: Callable[[list[str]], Iterable]) -> dict:
        """A dict that holds all of words; encode gets the ones that are new."""
        if len(self.young) > self.entries:
            self.old, self.young = self.young, {}
        young, old, new = self.young, self.old, []
        for w in words:
            if w not in young:
                if w in old:
                    young[w] = old[w]
                else:
                    new.append(w)
        if new:
            young.update(zip(new, encode(new)))
        return young
