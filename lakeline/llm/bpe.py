"""Byte-level BPE by walking the words of a batch as a trie, and decoding.

The vocabulary file belongs to the tokenizers library and is a parameter. Of its
settings these are supported: a byte-level pre-tokenizer without prefix space,
merges whose rank rises with the id of their token, and added tokens that are cut
out of the text first.
"""

from __future__ import annotations

import gc
import json
from array import array
from collections.abc import Iterable, Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Fixed value: how byte-level BPE cuts a text into words.
WORDS = (
    r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
)
#: A blank inside white space that goes on: a border that a cut at blanks would move.
SPLIT_BLANKS = r"\s (?!\S)"
#: Pieces whose ids a task remembers; later ones are encoded batch by batch.
REMEMBERED = 400_000
#: Characters of text that are encoded together, so that a batch's trie stays small.
BATCH_CHARS = 4_000_000
#: Letters of a piece that is remembered.
LONGEST_KNOWN = 64


def default_vocabulary() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def byte_letters() -> dict[str, int]:
    """Which byte each letter of the vocabulary file stands for.

    Printable bytes stand for themselves, the others for the letters from 256 on.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    letters = {chr(b): b for b in plain}
    rest = (b for b in range(256) if b not in set(plain))
    return letters | {chr(256 + i): b for i, b in enumerate(rest)}


#: Last bytes of a prefix by which the tokens that may end it are found.
TAIL = 4


class Vocabulary:
    """Tokens, merges, and which two tokens may stand side by side."""

    def __init__(self, source: str) -> None:
        """``source`` is the text of the vocabulary file."""
        spec = json.loads(source)
        letters = byte_letters()
        names = spec["model"]["vocab"]
        self.ids = {bytes(letters[c] for c in name): i for name, i in names.items()}
        self.special = {t["content"]: t["id"] for t in spec.get("added_tokens", [])}
        size = 1 + max([*self.ids.values(), *self.special.values()])
        self.bytes = [b""] * size
        for token, i in self.ids.items():
            self.bytes[i] = token
        for text, i in self.special.items():
            self.bytes[i] = text.encode()
        self.merged: dict[tuple[int, int], int] = {}
        self.parts: list[tuple[int, int] | None] = [None] * size
        for merge in spec["model"]["merges"]:
            left, right = merge if isinstance(merge, list) else merge.split(" ")
            pair = names[left], names[right]
            self.merged[pair] = names[left + right]
            self.parts[names[left + right]] = pair
        self.words = regex.compile(WORDS)
        # Lengths of the tokens with the same last bytes, the longest first.
        lengths: dict[bytes, set[int]] = {}
        for token in self.ids:
            lengths.setdefault(token[-TAIL:], set()).add(len(token))
        short = {n for tail, n in ((t, len(t)) for t in self.ids) if n < TAIL}
        self.lengths = {
            tail: tuple(sorted(found | short, reverse=True))
            for tail, found in lengths.items()
            if len(tail) == TAIL
        }
        self.short = tuple(sorted(short, reverse=True))
        self.cut = None
        if self.special:
            longest_first = sorted(self.special, key=len, reverse=True)
            self.cut = regex.compile("(" + "|".join(map(regex.escape, longest_first)) + ")")
        self._beside: dict[int, bool] = {}

    def beside(self, left: int, right: int) -> bool:
        """Whether BPE leaves these two tokens apart when their texts meet.

        Undoes merges on either side of the border, the latest first, and asks at
        each step whether an earlier merge would have crossed it.
        """
        key = left << 32 | right
        known = self._beside.get(key)
        if known is None:
            if len(self._beside) > 1_000_000:
                self._beside.clear()
            known = self._beside[key] = self._stay_apart(left, right)
        return known

    def _stay_apart(self, left: int, right: int) -> bool:
        # A merge across the border counts only if it comes before the merge that
        # made what stands there now; on the left it must also come no later.
        limit = len(self.bytes)
        while True:
            crossing = self.merged.get((left, right))
            if crossing is not None and crossing < limit:
                return False
            a, b = self.parts[left], self.parts[right]
            if a is None and b is None:
                return True
            if b is None or (a is not None and left > right):
                limit, left = left, a[1]
            else:
                limit, right = right + 1, b[0]

    def encode_words(self, words: Iterable[str]) -> Iterator[tuple[str, list[int]]]:
        """Each word with its ids, walking the words as a trie depth first.

        In sorted order each word shares the path of its predecessor as far as their
        common prefix. A node's state is the last token of its prefix's encoding: the
        longest token that ends the prefix and may stand beside the state of the node
        where it begins. Shared prefixes are so encoded once.
        """
        ids, beside, lengths, short = self.ids, self.beside, self.lengths, self.short
        last: list[int] = []  # last[i]: state of the prefix of i + 1 bytes
        before = b""
        for name in sorted(words):  # UTF-8 keeps the order
            word = name.encode()
            shared, stop = 0, min(len(before), len(word))
            while shared < stop and before[shared] == word[shared]:
                shared += 1
            del last[shared:]
            for end in range(shared + 1, len(word) + 1):
                for length in lengths.get(word[end - TAIL : end], short) if end >= TAIL else short:
                    start = end - length
                    if start < 0:
                        continue
                    token = ids.get(word[start:end])
                    if token is not None and (not start or beside(last[start - 1], token)):
                        last.append(token)
                        break
                else:
                    raise ValueError(f"no token ends {word[:end]!r}")
            tokens, end = [], len(word)
            while end:
                token = last[end - 1]
                tokens.append(token)
                end -= len(self.bytes[token])
            tokens.reverse()
            yield name, tokens
            before = word


class Encoder:
    """Encodes texts in batches, remembering a bounded number of pieces.

    A piece is a blank and what follows it up to the next one, which begins a word
    in all texts but the few with a blank inside a run of white space.
    """

    def __init__(self, vocabulary: Vocabulary) -> None:
        self.vocabulary = vocabulary
        self._known = {t: array("i", [i]).tobytes() for t, i in vocabulary.special.items()}
        self._split_blanks = regex.compile(SPLIT_BLANKS)

    def __call__(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of each text as int32."""
        done: list[np.ndarray] = []
        start = size = 0
        for i, text in enumerate(texts):
            size += len(text)
            if size >= BATCH_CHARS:
                done += self._batch(texts[start : i + 1])
                start, size = i + 1, 0
        return done + self._batch(texts[start:])

    def _pieces(self, text: str) -> list[str]:
        """Pieces of a text that is cut alike at blanks and into words; else its words."""
        if "\0" in text or self._split_blanks.search(text):
            return self.vocabulary.words.findall(text)
        return text.replace(" ", "\0 ").split("\0")

    def _cut(self, text: str) -> list[str]:
        voc = self.vocabulary
        if voc.cut is None or not any(s in text for s in voc.special):
            return self._pieces(text)
        found: list[str] = []
        for i, part in enumerate(voc.cut.split(text)):
            found += [part] if i % 2 else self._pieces(part)
        return found

    def _batch(self, texts: list[str]) -> list[np.ndarray]:
        # Millions of small objects without cycles: looking for cycles would take half the time.
        was_on = gc.isenabled()
        gc.disable()
        try:
            return self._encode(texts)
        finally:
            if was_on:
                gc.enable()

    def _encode(self, texts: list[str]) -> list[np.ndarray]:
        known, words_of = self._known, self.vocabulary.words.findall
        cut = [self._cut(text) for text in texts]
        new = set().union(*cut).difference(known)
        words = {piece: words_of(piece) for piece in new}
        unknown = set(chain.from_iterable(words.values())).difference(known)
        ids = _Either(known)
        for word, tokens in self.vocabulary.encode_words(unknown):
            ids[word] = array("i", tokens).tobytes()
        more = {p: b"".join([ids[w] for w in ws]) for p, ws in words.items() if len(ws) != 1}
        ids.update(more)
        find = ids.__getitem__ if new else known.__getitem__
        done = [np.frombuffer(b"".join(map(find, pieces)), np.int32) for pieces in cut]
        for piece in chain(unknown, more):
            if len(known) >= REMEMBERED:
                break
            if len(piece) <= LONGEST_KNOWN:
                known[piece] = ids[piece]
        return done


class _Either(dict):
    """A dictionary that asks another one for what it lacks."""

    def __init__(self, more: dict[str, bytes]) -> None:
        super().__init__()
        self._more = more

    def __missing__(self, piece: str) -> bytes:
        found = self[piece] = self._more[piece]
        return found


class Decoder:
    """Texts of ids; bytes that are not valid UTF-8 become U+FFFD."""

    def __init__(self, vocabulary: Vocabulary) -> None:
        self._bytes = np.array(vocabulary.bytes, object)

    def __call__(self, ids: np.ndarray) -> str:
        known = ids[(ids >= 0) & (ids < len(self._bytes))]
        return b"".join(self._bytes[known].tolist()).decode("utf-8", "replace")


def encode(
    docs: DataFrame,
    id_col: str = "doc_id",
    text_col: str = "text",
    vocabulary: str | None = None,
) -> DataFrame:
    """``doc_id, ids``: the ids of each whole text, as the tokenizers library encodes it.

    Null and empty texts have no ids. Rows without id and repeated rows are encoded
    like any other. ``vocabulary`` is the file's path on the driver; its content
    goes to the tasks with the code. No row is shuffled. Words are looked up among
    a bounded number of known ones, and the rest of a batch is encoded as a trie; a
    word of any length takes time in proportion to its length.
    """
    source = read_vocabulary(vocabulary)

    def encoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = Encoder(Vocabulary(source.value))
        for batch in batches:
            for part in _parts(batch):
                texts = [t or "" for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), _lists(encoder(texts))], ["doc_id", "ids"]
                )

    source = docs.sparkSession.sparkContext.broadcast(source)
    narrow = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return narrow.mapInArrow(encoded, "doc_id long, ids array<int>")


def decode(rows: DataFrame, ids_col: str = "ids", vocabulary: str | None = None) -> DataFrame:
    """The rows with a further column ``decoded``: the text of their ids, special tokens included.

    Null ids give a null text, no ids an empty one; ids the vocabulary lacks are
    passed over.
    """
    source = rows.sparkSession.sparkContext.broadcast(read_vocabulary(vocabulary))
    kind = rows.withColumn("decoded", F.lit("")).schema
    place = rows.columns.index(ids_col)

    def decoded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        text_of = Decoder(Vocabulary(source.value))
        for batch in batches:
            ids = batch.column(place)
            texts = [
                None if x is None else text_of(np.asarray(x.values.to_numpy(zero_copy_only=False)))
                for x in (i if i.is_valid else None for i in ids)
            ]
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(texts, pa.string())], kind.names
            )

    return rows.mapInArrow(decoded, kind)


def read_vocabulary(vocabulary: str | None) -> str:
    with open(vocabulary or default_vocabulary(), encoding="utf-8") as file:
        return file.read()


def _parts(batch: pa.RecordBatch, rows: int = 512) -> Iterator[pa.RecordBatch]:
    """Slices of few rows, since a row's ids may be many."""
    for start in range(0, batch.num_rows, rows):
        yield batch.slice(start, rows)


def _lists(ids: list[np.ndarray]) -> pa.ListArray:
    offsets = np.concatenate([[0], np.cumsum([len(i) for i in ids])]).astype(np.int32)
    flat = np.concatenate(ids) if ids else np.empty(0, np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat.astype(np.int32)))
