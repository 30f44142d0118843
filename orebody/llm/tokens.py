"""Token ids of whole texts by a public byte-level BPE file of the tokenizers library.

The ids are those of that library. Two libraries here hold the same algorithm; the second (tiktoken, over the ranks
read from the same file) is several times faster, and is used for texts whose characters have the same class in every
Unicode version. The first encodes the others, and all texts if the two differ on a probe when loading.
"""

from __future__ import annotations

import os
from functools import lru_cache

import numpy as np
import regex

#: The pre-token pattern of the byte-level pre-tokenizer (fixed value).
PRE = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
SPLIT = regex.compile(PRE)
#: Characters outside those whose class is the same in every Unicode version and regex engine.
UNSURE = regex.compile(r"[^\x00-\x1b\x20-\x84\x86-ɏ‐-‧€]")
PROBE = "It's 12 o'clock,  we'll\n\n see\tCAFÉ naïve ñandú straße… '''quoted'' 3.14% <|endoftext|> a_b   \n"


def vocabulary_path(name: str = "byte_bpe_50k.json") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def byte_of_letter() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for: printable bytes are themselves, others follow from 256 on."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in shown]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(rest)}


class Bpe:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        self.special = {t.content: i for i, t in self.library.get_added_tokens_decoder().items()}
        self.cut = regex.compile("|".join(regex.escape(x) for x in sorted(self.special, key=len, reverse=True))) if self.special else None
        letters = byte_of_letter()
        ranks = {bytes(letters[c] for c in word): i for word, i in self.library.get_vocab(with_added_tokens=False).items() if word not in self.special}
        self.quick = tiktoken.Encoding("quick", pat_str=PRE, mergeable_ranks=ranks, special_tokens=self.special)
        self.agree = self.quick.encode(PROBE, allowed_special="all") == self.slow(PROBE)

    def slow(self, text: str) -> list[int]:
        return self.library.encode(text, add_special_tokens=False).ids

    def ids(self, text: str) -> np.ndarray:
        """Ids of the whole text, as unsigned 32-bit numbers; special strings in it are read as the library does by default."""
        if self.agree and not UNSURE.search(text):
            return np.asarray(self.quick.encode_to_numpy(text, allowed_special="all"), np.uint32)
        return np.array(self.slow(text), np.uint32)

    def plain(self, text: str) -> list[str]:
        if UNSURE.search(text):
            return [text[a:b] for _, (a, b) in self.library.pre_tokenizer.pre_tokenize_str(text)]
        return SPLIT.findall(text)

    def split(self, text: str) -> list[str]:
        """Pre-tokens and special strings, of which each is encoded by itself; joined they are the text."""
        if self.cut is None or not self.cut.search(text):
            return self.plain(text)
        out, at = [], 0
        for m in self.cut.finditer(text):
            out += self.plain(text[at : m.start()])
            out.append(m[0])
            at = m.end()
        return out + self.plain(text[at:])


@lru_cache(4)
def bpe(path: str) -> Bpe:
    return Bpe(path)
