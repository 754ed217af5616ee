"""Best-fit packing of documents into fixed-length token sequences by sum of squares.

1. :func:`pieces` tokenises each whole text, adds the end id, and cuts only
   documents longer than a sequence; the first piece takes the remainder, so all
   later pieces are full.
2. :func:`pack` deals the pieces into groups of bounded size.  In a group each
   piece goes where the sum over residual gaps of (number of open sequences with
   that gap) squared becomes smallest; a tie goes to the smallest gap.  Pieces
   are offered longest first.  Groups are independent tasks of at most about
   ``GROUP`` pieces, whatever the input, so no task holds the whole table.

Defined results: a null text is empty and gives one piece of just the end id;
repeated rows and null ids give their own pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larder.llm.common import arrow_batches, staged, text_of

SEQUENCE = 2048
END = 0
#: Pieces in a group, about; a group is one task's work.
GROUP = 40_000
#: Words whose ids a Python worker remembers in each of two generations, and the longest of them: some 60 MB in all.
REMEMBERED, LONGEST = 200_000, 48

PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"

# A blank after white space, or at either end, belongs to a longer run.
_RUN = re.compile(r"\s |^ | $")


class WordIds(dict):
    """Ids of whole texts, word by word, for the vocabulary file of ``tokenizers``.

    Byte-level BPE never merges across the single blank before a word, so in a
    text without runs of blanks each word has its own ids, whatever stands
    around it.  They are remembered (in two generations, so the memory is
    bounded) and new words are merged by tiktoken from the same file's
    vocabulary, which gives the ids of ``tokenizers`` in a fraction of its time.
    Texts with runs of blanks or special tokens' names go to ``tokenizers`` whole.
    """

    def __init__(self, tokenizer_path: str):
        import tiktoken
        from tokenizers import Tokenizer

        super().__init__()
        whole = Tokenizer.from_file(tokenizer_path)
        self.special = [t.content for t in whole.get_added_tokens_decoder().values()]
        self.whole = whole.encode
        byte = byte_letters()
        ranks = {bytes(byte[c] for c in token): i for token, i in whole.get_vocab(with_added_tokens=False).items() if token not in self.special}
        import public_tokenizers

        self.words = tiktoken.Encoding("words", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.old: dict[str, bytes] = {}

    def __missing__(self, word: str) -> bytes:
        if (ids := self.old.get(word)) is None:
            blank = " " + word
            ids = self.words._core_bpe.encode_single_piece(blank.encode()) if word.isalpha() else self.words.encode_ordinary(blank)
            ids = array("I", ids).tobytes()
        if len(word) > LONGEST:
            return ids
        if len(self) >= REMEMBERED:
            self.old = dict(self)
            self.clear()
        self[word] = ids
        return ids

    def ids(self, text: str) -> bytes:
        """Little-endian 32-bit ids of one text."""
        if _RUN.search(text) or any(s in text for s in self.special):
            return array("I", self.whole(text, add_special_tokens=False).ids).tobytes()
        first, _, rest = text.partition(" ")
        head = array("I", self.words.encode_ordinary(first)).tobytes()
        return head + b"".join(map(self.__getitem__, rest.split(" "))) if rest else head


def byte_letters() -> dict[str, int]:
    """The byte that each letter of a byte-level vocabulary stands for.

    Printable bytes stand for themselves; the others take the letters from 256 on.
    """
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


_WORKER: dict[str, WordIds] = {}


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def pieces(docs: DataFrame, tokenizer_path: str | None = None, length: int = SEQUENCE) -> DataFrame:
    """doc_id, piece, start, length and checksum of each piece; all ids are read."""
    path = tokenizer_path or default_tokenizer()

    def cut(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        encoder = _WORKER[path] if path in _WORKER else _WORKER.setdefault(path, WordIds(path))
        end = np.asarray([END], dtype="<u4").tobytes()
        for frame in frames:
            for lo in range(0, len(frame), 200):
                part = frame.iloc[lo : lo + 200]
                rows = []
                for doc, text in zip(part["doc_id"], part["text"], strict=True):
                    ids = encoder.ids(text) + end
                    n = len(ids) // 4
                    at, to, k = 0, n % length or min(n, length), 0
                    while at < n:
                        rows.append((doc, k, at, to - at, zlib.crc32(ids[4 * at : 4 * to])))
                        at, to, k = to, to + length, k + 1
                out = pd.DataFrame(rows, columns=["doc_id", "piece", "start", "length", "ids_crc32"])
                yield out.astype({"doc_id": "Int64"})

    return arrow_batches(docs.select(docs["doc_id"].cast("long").alias("doc_id"), text_of(docs).alias("text"))).mapInPandas(cut, PIECES)


def sum_of_squares(lengths: Iterable[int], length: int = SEQUENCE) -> tuple[list[int], list[int]]:
    """The sequence and the offset of each piece, in the order given."""
    count = np.zeros(length + 1, dtype=np.int64)  # open sequences for each gap
    opened: dict[int, list[int]] = defaultdict(list)
    sequence, offset, n = [], [], 0
    for a in lengths:
        # what the sum of squares gains where a gap g becomes g - a; a filled sequence leaves the sum
        gain = count[: length - a + 1] - count[a:]
        gain = 2 * gain + 2
        gain[0] = 1 - 2 * count[a]
        gain[count[a:] == 0] = np.iinfo(np.int64).max
        gain[length - a] = 2 * count[length - a] + 1 if a < length else 0  # a new sequence
        g = a + int(gain.argmin())
        if g == length:
            at, n = n, n + 1
        else:
            at = opened[g].pop()
            count[g] -= 1
        if g > a:
            opened[g - a].append(at)
            count[g - a] += 1
        sequence.append(at)
        offset.append(length - g)
    return sequence, offset


def pack(parts: DataFrame, length: int = SEQUENCE, group: int = GROUP) -> DataFrame:
    """Adds sequence_id and offset to staged pieces."""
    groups = max(1, -(-parts.count() // group))

    def place(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["length", "doc_id", "piece"], ascending=[False, True, True], kind="stable")
        sequence, offset = sum_of_squares(frame["length"].tolist(), length)
        base = int(frame["g"].iloc[0]) << 40
        return frame.assign(sequence_id=np.asarray(sequence, dtype=np.int64) + base, offset=offset).drop(columns="g")

    dealt = parts.withColumn("g", F.pmod(F.monotonically_increasing_id(), F.lit(groups)))
    return dealt.groupBy("g").applyInPandas(place, PIECES + ", sequence_id long, offset long")


def packed(docs: DataFrame, tokenizer_path: str | None = None) -> DataFrame:
    return pack(staged(pieces(docs, tokenizer_path), "pieces"))
