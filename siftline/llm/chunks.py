"""Distinct-chunk tables: each distinct piece of text is tokenised once per task and its ids are joined back by position."""

from __future__ import annotations

import base64
import re
from array import array
from functools import lru_cache

import numpy as np

#: Entries of one generation of a worker's table; the last two are kept, so the memory is bounded and frequent chunks stay.
TABLE_ENTRIES = 150_000
#: Longer chunks are segmented where they stand instead of being kept.
KEPT_CHARS = 64


class ChunkTable(dict):
    """Chunk to value; a missing one is taken from the previous generation or computed, and kept if it is short."""

    def __init__(self, value):
        super().__init__()
        self.value = value
        self.previous: dict = {}

    def __missing__(self, chunk):
        found = self.previous.pop(chunk, None)
        if found is None:
            found = self.value(chunk)
        if len(chunk) <= KEPT_CHARS:
            self.keep(chunk, found)
        return found

    def keep(self, chunk, found) -> None:
        if len(self) >= TABLE_ENTRIES:
            self.previous = dict(self)
            self.clear()
        self[chunk] = found


class BytePairs:
    """Byte-level BPE ids as little-endian unsigned 32-bit numbers.

    A single space between two characters that are not white space begins a new
    pre-token, so a text is cut there and each distinct piece is looked up.
    Texts with characters outside Latin, or with the string of an added token,
    go to the tokenizer whole, which gives such a string the token's own id.
    """

    #: Texts of these characters only, whose classes are the same in every engine; others are left to the tokenizer itself.
    _OTHER = re.compile(r"[^\n\x20-\x7eÀ-ÖØ-öø-ƿǄ-ɏ]")
    #: The pre-tokens of such texts: contractions, letters, digits, other signs, white space.
    _PARTS = re.compile(r"'(?:s|t|re|ve|m|ll|d)| ?[^\W\d_]+| ?[0-9]+| ?(?:[^\w\s]|_)+|\s+(?!\S)|\s+")

    def __init__(self, json_path: str, ranks_path: str, pattern: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(json_path)
        self.added = [token.content for token in self.tokenizer.get_added_tokens_decoder().values()]
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, lines)}
        merges = tiktoken.Encoding("byte-level", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})._core_bpe
        self.parts = ChunkTable(lambda part: array("I", merges.encode_single_piece(part.encode())).tobytes())
        self.first = ChunkTable(self._ids)
        self.later = ChunkTable(self._word)

    def _ids(self, text: str) -> bytes:
        return b"".join(map(self.parts.__getitem__, self._PARTS.findall(text)))

    def _word(self, word: str) -> bytes:
        """Ids of a word and the space before it; most are letters with at most a stop or comma behind."""
        if word.isalpha():
            return self.parts[" " + word]
        if word[-1:] in (".", ",") and word[:-1].isalpha():
            return self.parts[" " + word[:-1]] + self.parts[word[-1]]
        return self._ids(" " + word)

    def encode(self, text: str) -> bytes:
        if self._OTHER.search(text) or any(token in text for token in self.added):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        if "  " in text or " \n" in text or "\n " in text:
            return self._ids(text)
        words = text.split(" ")
        head = self.first[words[0]] if words[0] else b""
        return head + b"".join(map(self.later.__getitem__, words[1:]))


@lru_cache(2)
def byte_pairs(json_path: str, ranks_path: str, pattern: str) -> BytePairs:
    """One per worker process, shared by its tasks."""
    return BytePairs(json_path, ranks_path, pattern)


class Pieces:
    """SentencePiece ids and their decoded text, by chunk.

    No piece of the model has a white space marker after another character
    (checked here), so no merge crosses from one marked word to the next and
    each can be segmented alone.  A chunk is a run of markers and the
    characters up to the next one.
    """

    _MARK = "▁"
    _CHUNK = re.compile("▁+[^▁]*")

    def __init__(self, model_path: str):
        import sentencepiece

        self.model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        crossing = re.compile(f"[^{self._MARK}]{self._MARK}")
        self.separable = not any(crossing.search(self.model.id_to_piece(i)) for i in range(self.model.get_piece_size()))
        # A text starts with one marker of its own and keeps its white space.
        self.separable = self.separable and self.model.encode("  a", out_type=str) == self.model.encode(f"{self._MARK} a", out_type=str)
        self.lone = self.model.encode("a ")[1:]  # a marker that no character follows
        self.words = ChunkTable(self._word)
        self.runs = ChunkTable(self._run)

    def _run(self, chunk: str) -> tuple[str, str]:
        """Decimal ids and decoded text of a chunk that begins with a marker; the text keeps its first space."""
        ids = self.model.encode(chunk[1:]) if len(chunk) > 1 else self.lone
        return ",".join(map(str, ids)), " " + self.model.decode(ids) if len(chunk) > 1 else " "

    def _word(self, word: str) -> tuple[str, str]:
        return self._run(self._MARK + word)

    def learn(self, texts: list[str]) -> None:
        """Segments the new words of some texts in one call each way; the model does the same for a list as for its items."""
        if self.separable:
            seen, known, before = set(), self.words, self.words.previous
            for text in texts:
                seen.update(text.split(" "))
            new = [x for x in seen if x and len(x) <= KEPT_CHARS and self._MARK not in x and x not in known and x not in before]
            ids = self.model.encode(new, num_threads=1)
            for word, own, decoded in zip(new, ids, self.model.decode(ids, num_threads=1)):
                self.words.keep(word, (",".join(map(str, own)), " " + decoded))

    def encode(self, text: str) -> tuple[int, str, str]:
        """Number of ids, ids in decimal joined by commas, decoded text."""
        if not text:
            return 0, "", ""
        if not self.separable:
            ids = self.model.encode(text)
            return len(ids), ",".join(map(str, ids)), self.model.decode(ids)
        marked = text.replace(self._MARK, " ") if self._MARK in text else text
        if "  " in marked or marked[0] == " " or marked[-1] == " ":
            found = list(map(self.runs.__getitem__, self._CHUNK.findall(self._MARK + marked.replace(" ", self._MARK))))
        else:
            found = list(map(self.words.__getitem__, marked.split(" ")))
        ids = ",".join([x[0] for x in found])
        return ids.count(",") + 1, ids, "".join([x[1] for x in found])[1:]


@lru_cache(2)
def pieces(model_path: str) -> Pieces:
    """One per worker process, shared by its tasks."""
    return Pieces(model_path)
