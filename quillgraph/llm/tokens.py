"""Token ids of many texts by a public tokenizer, with a bounded memory of words."""

from __future__ import annotations

import os
import re

import numpy as np

#: Words remembered in one Python worker, and the longest of them. Plain words are learnt JOINED at a time.
MEMORY_WORDS, MEMORY_CHARS, JOINED, BATCH = 900_000, 48, 200, 50
#: Words of Latin-1 letters, digits and most ASCII marks, and their parts as the pre-tokenizer cuts them.
_LETTERS, _MARKS = r"A-Za-z\xC0-\xD6\xD8-\xF6\xF8-\xFF", r"!-&(-/:;=-@\[-`{-~"
_PLAIN = re.compile(f"[{_LETTERS}0-9{_MARKS}]+")
_PARTS = re.compile(f"[{_LETTERS}]+|[0-9]|[{_MARKS}]+")
_encoders: dict[tuple[str, int], WordEncoder] = {}


class WordEncoder:
    """Encodes texts word by word and remembers words. Spaces and newlines part words.

    The tokenizer must never let a token reach over white space (its pre-tokenizer drops it), must not tell capitals from small
    letters, and must mark the last token of each of its parts with an ending of its own; `check` verifies this. Then the ids of a
    text are those of its words in turn, and many plain words can be encoded as one text and parted again by counting endings. All
    other white space stays inside the pieces given to the tokenizer. A batch of plain words whose endings don't add up is encoded
    word by word.
    """

    def __init__(self, path: str, end_id: int):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        # the same model without normalizer and pre-tokenizer, for plain ASCII words that are cut here
        self.bare = Tokenizer.from_file(path)
        self.bare.normalizer, self.bare.pre_tokenizer = None, pre_tokenizers.WhitespaceSplit()
        self.end = np.uint32(end_id).tobytes()
        self.memory: dict[str, bytes] = {"": b""}
        self.ends = np.zeros(self.tokenizer.get_vocab_size() + 1, dtype=bool)
        for token, i in self.tokenizer.get_vocab().items():
            self.ends[i] = token.endswith("</w>")
        self.check()

    def check(self) -> None:
        whole = lambda t: self.tokenizer.encode(t, add_special_tokens=False).ids
        if whole("one two\nthree  FOUR's 5") != [i for w in ("one", "two", "three", "four's", "5") for i in whole(w)]:
            raise ValueError("this tokenizer can't be applied word by word in small letters")
        if self.bare.encode("one ,-( two 3 4", add_special_tokens=False).ids != whole("one,-(TWO 34"):
            raise ValueError("this tokenizer's model can't be given words that are cut already")
        if self.ends[whole("one,two 34")].sum() != 5:
            raise ValueError("this tokenizer doesn't mark the ends of words")

    def _single(self, words: list[str]) -> dict[str, bytes]:
        ids = self.tokenizer.encode_batch_fast(words, add_special_tokens=False)
        return {w: np.asarray(e.ids, dtype="<u4").tobytes() for w, e in zip(words, ids, strict=True)}

    def _learn(self, words: list[str]) -> dict[str, bytes]:
        ascii_, latin, other = [], [], []
        for w in words:
            (other if not _PLAIN.fullmatch(w) else ascii_ if w.isascii() else latin).append(w)
        out = self._single(other) if other else {}
        out |= self._joined(self.tokenizer, latin, latin, [len(_PARTS.findall(w)) for w in latin])
        cut = [w if w.isalpha() else f"{w[:-1]} {w[-1]}" if w[:-1].isalpha() else " ".join(_PARTS.findall(w)) for w in map(str.lower, ascii_)]
        return out | self._joined(self.bare, ascii_, cut, [c.count(" ") + 1 for c in cut])

    def _joined(self, tokenizer, words: list[str], texts: list[str], parts: list[int]) -> dict[str, bytes]:
        """Encodes JOINED texts at a time; parts: the number of parts of each, which part the ids again."""
        out = {}
        for first in range(0, len(words), BATCH * JOINED):  # an encoding is large: few at a time
            starts = range(first, min(first + BATCH * JOINED, len(words)), JOINED)
            for i, e in zip(starts, tokenizer.encode_batch_fast([" ".join(texts[i : i + JOINED]) for i in starts], add_special_tokens=False), strict=True):
                chunk, ids = words[i : i + JOINED], np.asarray(e.ids, dtype="<u4")
                ends, last = np.flatnonzero(self.ends[ids]), np.cumsum(parts[i : i + JOINED])
                if len(ends) != last[-1] or ends[-1] != len(ids) - 1:
                    out |= self._single(chunk)
                    continue
                data, at = ids.tobytes(), 0
                for w, to in zip(chunk, ((ends[last - 1] + 1) * 4).tolist(), strict=True):
                    out[w] = data[at:to]
                    at = to
        return out

    @staticmethod
    def _clean(text: str | None) -> str:
        """Small letters where that is sure to be what the tokenizer does: in Latin-1 texts. Newlines become spaces."""
        text = text or ""
        if not text.isascii():
            try:
                text.encode("latin-1")
            except UnicodeEncodeError:
                return text.replace("\n", " ")
        return (text if "<|" in text else text.lower()).replace("\n", " ")

    def _known(self, words: list[str]) -> list[bytes]:
        """The ids of distinct words, learning those that are new."""
        found = list(map(self.memory.get, words))
        gaps = [i for i, f in enumerate(found) if f is None]
        if gaps:
            learnt = self._learn([words[i] for i in gaps])
            for i in gaps:
                found[i] = learnt[words[i]]
            short = {w: b for w, b in learnt.items() if len(w) <= MEMORY_CHARS}
            if len(self.memory) + len(short) > MEMORY_WORDS:
                self.memory = {"": b""}
            self.memory.update(short)
        return found

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text, the end id last. A null text is empty.

        Arrow parts the texts and numbers their distinct words; only those are looked up.
        """
        import pyarrow as pa
        import pyarrow.compute as pc

        if not texts:
            return []
        parts = pc.split_pattern(pa.array([self._clean(t) for t in texts], pa.string()), " ")
        distinct = parts.flatten().dictionary_encode()
        numbers, found = distinct.indices.to_numpy(), self._known(distinct.dictionary.to_pylist())
        sizes = np.fromiter(map(len, found), dtype=np.int64, count=len(found)) // 4
        first, flat = np.cumsum(sizes) - sizes, np.frombuffer(b"".join(found), dtype="<u4")
        n = sizes[numbers]
        ends = np.cumsum(n)
        ids = flat[np.repeat(first[numbers] - (ends - n), n) + np.arange(int(n.sum()))]
        bounds = (np.r_[0, ends][parts.offsets.to_numpy()] * 4).tolist()
        data = ids.tobytes()
        return [data[a:b] + self.end for a, b in zip(bounds, bounds[1:], strict=False)]


def encoder(path: str, end_id: int) -> WordEncoder:
    """One encoder for each Python worker, kept between tasks."""
    if (path, end_id) not in _encoders:
        _encoders[path, end_id] = WordEncoder(path, end_id)
    return _encoders[path, end_id]


def groups(texts: list, chars: int = 5_000_000):
    """Ranges of positions whose texts hold about so many characters."""
    at = size = 0
    for i, t in enumerate(texts):
        size += len(t or "")
        if size >= chars:
            yield at, i + 1
            at, size = i + 1, 0
    if at < len(texts):
        yield at, len(texts)
