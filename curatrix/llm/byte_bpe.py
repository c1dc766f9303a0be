"""Byte-level BPE encoding and decoding by backtracking over longest matches.

The bytes of a piece become Latin-1 characters, so that one pyahocorasick automaton over the vocabulary reports, for each
position, the longest token that starts there. The encoder takes longest matches from left to right and steps back to a
shorter token where two neighbours are not compatible, that is, where merging their joined bytes by rank would not give just
these two. Compatibility is memoised by pair; every position is given up once at most, so the time is linear in the piece.
A sequence whose neighbours are all compatible is the only one that the merges can give, hence the ids are exact.

Null and empty texts give an empty id list and empty bytes. Texts that are not valid in the pattern's sense do not exist: the
pattern matches every character. Each input row gives one output row, repeated rows and null ids included; an empty table
gives an empty table. Columns other than the chosen id columns are not carried, so clashing names can't arise.
"""

from __future__ import annotations

import base64
import hashlib
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from curatrix.llm._frames import map_slices, read, with_text

#: Pieces (in each of two generations) and pairs that a worker remembers. Forgetting costs time but changes no id.
PIECE_MEMO = 1 << 18
PAIR_MEMO = 1 << 20


class Codec:
    """Encoder and decoder for one rank file (lines of base64 token and rank) and one splitting pattern."""

    def __init__(self, rank_file: bytes, pattern: str):
        import ahocorasick
        import regex

        pairs = [(base64.b64decode(t), int(r)) for t, r in (line.split() for line in rank_file.splitlines() if line.strip())]
        self.rank = dict(pairs)
        self.token = {r: t for t, r in pairs}
        self.sizes = {r: len(t) for t, r in pairs}
        if missing := [b for b in range(256) if bytes([b]) not in self.rank]:
            raise ValueError(f"the vocabulary lacks {len(missing)} single bytes")
        self.split = regex.compile(pattern).findall
        self.automaton = ahocorasick.Automaton()
        for t, r in pairs:
            self.automaton.add_word(t.decode("latin-1"), r)
        self.automaton.make_automaton()
        self.pieces: dict[str, tuple[int, ...]] = {}
        self.older: dict[str, tuple[int, ...]] = {}
        self.pairs: dict[tuple[int, int], bool] = {}
        self.shorter: dict[int, int] = {}
        #: For each token: the left and the right one of the two that merge into it (itself for single bytes).
        halves = {r: self._parts(r) for r in self.token}
        self.begins, self.ends = ({r: h[i] for r, h in halves.items()} for i in (0, 1))
        self.reach = max(self.sizes.values())

    def merged(self, piece: bytes) -> list[int]:
        """The definition: merge the neighbours of lowest rank, leftmost first, until none is in the vocabulary."""
        parts = [piece[i : i + 1] for i in range(len(piece))]
        while len(parts) > 1:
            ranks = [self.rank.get(a + b, -1) for a, b in zip(parts, parts[1:])]
            best = min((r for r in ranks if r >= 0), default=None)
            if best is None:
                break
            i = ranks.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
        return [self.rank[p] for p in parts]

    def _parts(self, token: int) -> tuple[int, int]:
        """The two tokens whose merge makes this one, or twice itself for those that no merge makes."""
        t = self.token[token]
        pieces = [t[i : i + 1] for i in range(len(t))]
        while len(pieces) > 2:
            ranks = [self.rank.get(a + b, token) for a, b in zip(pieces, pieces[1:])]
            i = min(range(len(ranks)), key=ranks.__getitem__)
            if ranks[i] >= token:
                break
            pieces[i : i + 2] = [pieces[i] + pieces[i + 1]]
        return (self.rank[pieces[0]], self.rank[pieces[1]]) if len(pieces) == 2 else (token, token)

    def compatible(self, left: int, right: int) -> bool:
        """Whether the two tokens stay as they are side by side; a left of -1 asks whether the right one stays whole.

        They don't if, at some moment of the merges that build them, the parts that touch make a token of lower rank than the
        merge that comes next on either side. So the later of the two merges is undone again and again.
        """
        known = self.pairs.get((left, right))
        if known is None:
            if len(self.pairs) >= PAIR_MEMO:
                self.pairs.clear()
            known = self.pairs[left, right] = self._whole(right) if left < 0 else self._whole(left) and self._whole(right) and self._apart(left, right)
        return known

    def _whole(self, token: int) -> bool:
        return self.sizes[token] == 1 or self.ends[token] != token

    def _apart(self, left: int, right: int) -> bool:
        rank, token, ends, begins = self.rank, self.token, self.ends, self.begins
        limit = len(rank) + 1
        while True:
            joined = rank.get(token[left] + token[right])
            if joined is not None and joined < limit:
                return False
            end, begin = ends[left], begins[right]
            # of equal ranks the left one merges first: a merge on the left is over at its rank, one on the right just after
            if begin == right:
                if end == left:
                    return True
                limit, left = left, end
            elif end != left and left > right:
                limit, left = left, end
            else:
                limit, right = right + 1, begin

    def next_shorter(self, token: int) -> int:
        """The longest token that is a proper prefix, or -1."""
        found = self.shorter.get(token)
        if found is None:
            t = self.token[token]
            found = next((self.rank[t[:n]] for n in range(len(t) - 1, 0, -1) if t[:n] in self.rank), -1)
            self.shorter[token] = found
        return found

    def encode_piece(self, piece: bytes) -> list[int]:
        rank, pairs, shorter, sizes, path, reach = self.rank, self.pairs, self.shorter, self.sizes, self.automaton.longest_prefix, self.reach
        whole = rank.get(piece)
        if whole is not None:
            return [whole]
        text, size = piece.decode("latin-1"), len(piece)
        given_up: set[int] = set()
        taken: list[int] = []
        at, last, token = 0, -1, None
        while at < size:
            if token is None:
                # the longest token here: the trie tells how far any token's path goes on, the last token on it is the match
                n = path(text[at : at + reach]) if at else path(text)
                token = rank.get(piece[at : at + n])
                while token is None:
                    n -= 1
                    token = rank.get(piece[at : at + n])
            while token >= 0:
                fits = pairs.get((last, token))
                if fits is None:
                    fits = self.compatible(last, token)
                if fits and at + sizes[token] not in given_up:
                    break
                token = shorter[token] if token in shorter else self.next_shorter(token)
            if token >= 0:
                taken.append(token)
                at += sizes[token]
                last, token = token, None
            else:
                given_up.add(at)
                last = taken.pop()
                at -= sizes[last]
                token = self.next_shorter(last)
                last = taken[-1] if taken else -1
        return taken

    def encode(self, text: str) -> list[int]:
        if len(self.pieces) >= PIECE_MEMO:
            self.older, self.pieces = self.pieces, {}
        memo, older = self.pieces, self.older
        parts = self.split(text)
        known = list(map(memo.get, parts))
        i = 0
        for _ in range(known.count(None)):
            i = known.index(None, i)
            part = parts[i]
            found = memo.get(part) or older.get(part) or tuple(self.encode_piece(part.encode()))
            if len(part) <= 64:
                memo[part] = found
            known[i] = found
        return list(chain.from_iterable(known))

    def decode(self, ids: Sequence[int]) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_CODECS: dict[tuple[str, str], Codec] = {}


def codec(rank_file: bytes, pattern: str) -> Codec:
    """One codec a worker process for each rank file and pattern."""
    key = hashlib.sha256(rank_file).hexdigest(), pattern
    if key not in _CODECS:
        _CODECS[key] = Codec(rank_file, pattern)
    return _CODECS[key]


def bpe_round_trip(df: DataFrame, rank_path: str, pattern: str, text_col: str = "text", keep: Sequence[str] = ("doc_id",)) -> DataFrame:
    """``keep`` columns, ``ids`` array<int> and ``decoded`` binary (from these ids alone) of every whole text.

    The rank file (under 1 MB for 50,000 tokens) is read on the driver, whose path is a parameter, and broadcast.
    """
    with open(rank_path, "rb") as f:
        ranks = df.sparkSession.sparkContext.broadcast(f.read())
    narrow, name = with_text(df, keep, text_col)
    schema = T.StructType([*(narrow.schema[c] for c in keep), T.StructField("ids", T.ArrayType(T.IntegerType(), False)), T.StructField("decoded", T.BinaryType())])

    def work(part: pa.RecordBatch) -> pa.RecordBatch:
        c = codec(ranks.value, pattern)
        encoded = [c.encode(t or "") for t in part.column(name).to_pylist()]
        offsets = np.cumsum([0, *map(len, encoded)], dtype=np.int32)
        flat = np.fromiter(chain.from_iterable(encoded), np.int32, int(offsets[-1]))
        decoded = pa.array([c.decode(x) for x in encoded], pa.binary())
        kept = [part.column(i) for i in range(len(keep))]
        return pa.RecordBatch.from_arrays([*kept, pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat)), decoded], [*keep, "ids", "decoded"])

    return map_slices(narrow, name, work, schema)


def op8_byte_bpe(spark, sf_dir: str) -> DataFrame:
    """The registered query: digests of the ids and of the decoded bytes of all documents."""
    import public_tokenizers

    coded = bpe_round_trip(read(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN)
    return coded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
