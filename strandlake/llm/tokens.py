"""Token ids of whole texts with a tokenizer file, words cached.

The tokenizer splits a text into words on its own and encodes each without its neighbours, so a word's ids can be kept.
Texts of plain Latin-1 letters, digits, marks and spaces are split here with the same rule; all others go through the
tokenizer as they are.
"""

from __future__ import annotations

import os
import re

import numpy as np

#: Fixed rule of the tokenizer file on lowered Latin-1 bytes: contractions, letters, single numbers, other marks.
_SPLIT = re.compile(rb"'s|'t|'re|'ve|'m|'ll|'d|[a-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff]+|[0-9\xb2\xb3\xb9\xbc-\xbe]|[^\x20\t\n\ra-z\xaa\xb5\xba\xdf-\xf6\xf8-\xff0-9\xb2\xb3\xb9\xbc-\xbe]+")
#: Control characters and wide spaces, and the opening of a special token, are left to the tokenizer.
_ODD = re.compile(rb"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\xa0]|<\|")
#: Words that a worker keeps. Others are encoded again; the ids don't change.
CACHED = 800_000


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class WordEncoder:
    """Ids of texts as little-endian unsigned 32-bit bytes."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # The same model for words that are split and lowered already.
        self.plain = Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, number in self.tokenizer.get_vocab().items():
            self.ends[number] = token.endswith("</w>")
        self.words: dict[bytes, bytes] = {}

    def _encode(self, text: str) -> np.ndarray:
        return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, dtype="<u4")

    def _learn(self, words: list[bytes]) -> dict[bytes, bytes]:
        joined = b" ".join(words).decode("latin-1")
        ids = np.array(self.plain.encode_batch_fast([joined], add_special_tokens=False)[0].ids, dtype="<u4")
        cuts = np.flatnonzero(self.ends[ids]) + 1
        if len(cuts) == len(words):
            raw, new, at = ids.tobytes(), {}, 0
            for word, cut in zip(words, (cuts * 4).tolist()):
                new[word] = raw[at:cut]
                at = cut
        else:
            new = {w: self._encode(w.decode("latin-1")).tobytes() for w in words}
        room = CACHED - len(self.words)
        self.words.update(new if len(new) <= room else dict(list(new.items())[: max(room, 0)]))
        return new

    def encode_batch(self, texts: list[str]) -> list[bytes]:
        split, missing = [], set()
        words = self.words
        for text in texts:
            try:
                raw = text.encode("latin-1")
            except UnicodeEncodeError:
                split.append(None)
                continue
            if _ODD.search(raw):
                split.append(None)
                continue
            own = _SPLIT.findall(text.lower().encode("latin-1"))
            split.append(own)
            missing |= set(own).difference(words)
        if missing:
            new = self._learn(list(missing))
            get = words.get if len(words) < CACHED else lambda w: words.get(w) or new[w]
        else:
            get = words.get
        return [
            self._encode(text).tobytes() if own is None else b"".join(map(get, own))
            for text, own in zip(texts, split)
        ]
