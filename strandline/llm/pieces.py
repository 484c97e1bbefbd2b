"""Encoding and decoding with a SentencePiece vocabulary, by forward scores shared along a trie of words.

Spaces become marks and a mark is put in front, as the vocabulary's own encoder does; no piece crosses the place
before a run of marks, so a text is a list of marked words. The distinct marked words of a slice are sorted,
which lines them up as a trie's depth-first order: from one word to the next only the characters behind their common
prefix are new, and everything the forward pass knows about that prefix is reused. Ids are then put back by position.

The public vocabulary is of the BPE kind, whose encoder merges pairs by rank. The highest sum of piece scores is not its
segmentation, so the forward pass keeps for each prefix what decides it there: the last piece of the prefix's own
segmentation. Exactly one piece that ends at a position is compatible with the last piece before it, in the sense that
no merge across their border would have come first; `compatible` undoes merges step by step to see that. So the pass is
a Viterbi pass whose score of a step is 0 or minus infinity, and it gives the encoder's ids; tests compare them.

Everything is a map over slices of texts, without shuffle. Characters that the vocabulary lacks become byte pieces.

Defined cases: null and empty texts give no ids and decode to the empty text; repeated rows are encoded alike; an empty
table gives an empty result; extra columns are ignored. A literal mark sign is read as a space, as the encoder does.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .words import gather, slices, strings

MARK = "▁"


class Vocabulary:
    """Pieces, merge order and ids of a model file; None for the public one."""

    def __init__(self, path: str | None = None):
        import sentencepiece

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("piece_bpe_32k.model")
        sp = sentencepiece.SentencePieceProcessor(model_file=path)
        n = sp.get_piece_size()
        self.ids: dict[str, int] = {}
        self.rank: dict[str, float] = {}
        self.bytes = [b""] * n
        self.byte_ids = [0] * 256
        for i in range(n):
            piece = sp.id_to_piece(i)
            if sp.is_byte(i):
                self.byte_ids[int(piece[3:5], 16)] = i
                self.bytes[i] = bytes([int(piece[3:5], 16)])
            elif not sp.is_control(i) and not sp.is_unknown(i):
                self.ids[piece], self.rank[piece] = i, -sp.get_score(i)
                self.bytes[i] = piece.replace(MARK, " ").encode()
        self.longest = max(map(len, self.rank))
        self.halves: dict[str, tuple[str, str]] = {}
        self.known: dict[tuple[str, str], bool] = {}

    def __getstate__(self):
        return self.__dict__ | {"known": {}}

    def split(self, piece: str) -> tuple[str, str]:
        """The two symbols whose merge made a piece."""
        if piece not in self.halves:
            symbols = list(piece)
            while len(symbols) > 2:
                ranks = [self.rank.get(a + b, np.inf) for a, b in zip(symbols, symbols[1:])]
                i = min(range(len(ranks)), key=ranks.__getitem__)
                if ranks[i] == np.inf:
                    break
                symbols[i:i + 2] = [symbols[i] + symbols[i + 1]]
            self.halves[piece] = tuple(symbols) if len(symbols) == 2 else ()
        return self.halves[piece]

    def compatible(self, left: str, right: str) -> bool:
        """Whether merging by rank leaves the border between two pieces alone."""
        key = (left, right)
        if key not in self.known:
            self.known[key] = self._compatible(left, right)
        return self.known[key]

    def _compatible(self, left: str, right: str) -> bool:
        limit, from_right = np.inf, False
        while True:
            r = self.rank.get(left + right)
            if r is not None and (r < limit or r == limit and from_right):
                return False
            made_left = self.rank.get(left, -1) if len(left) > 1 else -1
            made_right = self.rank.get(right, -1) if len(right) > 1 else -1
            if made_left < 0 and made_right < 0:
                return True
            if made_left > made_right:
                left, limit, from_right = self.split(left)[1], made_left, False
            else:
                right, limit, from_right = self.split(right)[0], made_right, True

    def encode_sorted(self, marked: list[str]) -> list[list[int]]:
        """Ids of each word; the words are sorted, so neighbours share prefixes."""
        rank, ids, longest, compatible = self.rank, self.ids, self.longest, self.compatible
        made = {p for p in rank if len(p) > 1}
        out, before = [], ""
        last: list[str] = [""]  # of the current word's prefixes, the last piece
        reach = {}
        for word in marked:
            n = min(len(word), len(before))
            d = 0
            while d < n and word[d] == before[d]:
                d += 1
            del last[d + 1:]
            for end in range(d + 1, len(word) + 1):
                piece = word[end - 1:end]
                for k in range(max(0, end - longest), end - 1):
                    p = word[k:end]
                    if p in made:
                        if p not in reach:
                            reach[p] = bool(self.split(p))
                        if reach[p] and (k == 0 or compatible(last[k], p)):
                            piece = p
                            break
                last.append(piece)
            before, end, found = word, len(word), []
            while end:
                piece = last[end]
                i = ids.get(piece)
                found += [i] if i is not None else [self.byte_ids[b] for b in reversed(piece.encode())]
                end -= len(piece)
            out.append(found[::-1])
        return out

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts, and where each text's ids begin."""
        texts = pc.replace_substring(pc.fill_null(texts, "").cast(pa.large_string()), MARK, " ")
        n = len(texts)
        if not n:
            return np.zeros(0, np.int32), np.zeros(1, np.int64)
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        flat = parts.flatten().dictionary_encode()
        codes, vocabulary = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        # every part brings one mark; parts without characters lend theirs to the next part of the text
        full = pc.greater(pc.binary_length(vocabulary), 0).to_numpy(zero_copy_only=False)[codes]
        closes = full.copy()
        closes[offsets[1:] - 1] = True
        head = np.concatenate(([0], np.flatnonzero(closes)[:-1] + 1))
        stop = np.flatnonzero(closes)
        marks = stop - head + 1
        empty = pc.equal(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
        text_of = np.searchsorted(offsets, head, side="right") - 1
        marks[empty[text_of]] = 0
        shape, entry = np.unique(np.column_stack([codes[stop], marks]), axis=0, return_inverse=True) if (marks != 1).any() else (None, None)
        if shape is None:
            used = np.zeros(len(vocabulary), bool)
            used[codes[stop]] = True
            wanted = np.flatnonzero(used)
            slot = np.zeros(len(vocabulary), np.int64)
            slot[wanted] = np.arange(len(wanted))
            entry = slot[codes[stop]]
            distinct = [MARK + w for w in vocabulary.take(pa.array(wanted)).to_pylist()]
        else:
            entry = entry.ravel()
            distinct = [MARK * int(m) + w for m, w in zip(shape[:, 1], vocabulary.take(pa.array(shape[:, 0])).to_pylist())]
        order = sorted(range(len(distinct)), key=distinct.__getitem__)
        lists: list[list[int]] = [[]] * len(distinct)
        for i, found in zip(order, self.encode_sorted([distinct[i] for i in order])):
            lists[i] = found
        starts = np.concatenate(([0], np.cumsum([len(x) for x in lists]))).astype(np.int64)
        out, at = gather(np.array([i for x in lists for i in x], np.int32), starts, entry)
        return out, at[np.searchsorted(head, offsets)]

    def decode(self, ids: np.ndarray, starts: np.ndarray) -> pa.Array:
        """Texts of ids; the mark in front is taken off again."""
        table = np.frombuffer(b"".join(self.bytes), np.uint8)
        at = np.concatenate(([0], np.cumsum([len(b) for b in self.bytes]))).astype(np.int64)
        data, begin = gather(table, at, ids)
        begin = begin[starts]
        keep = np.ones(len(data), bool)
        first = begin[:-1][begin[1:] > begin[:-1]]
        keep[first[data[first] == 32]] = False
        kept = np.concatenate(([0], np.cumsum(keep)))
        return strings(data[keep], kept[begin])


def encode(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str | None = None) -> DataFrame:
    """doc_id, ids array<int>."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches):
        v = shared.value
        for batch in slices(batches):
            ids, starts = v.encode(batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.ListArray.from_arrays(pa.array(starts, pa.int32()), pa.array(ids))], ["doc_id", "ids"])

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text")).mapInArrow(run, "doc_id long, ids array<int>")


def decode(rows: DataFrame, ids: str = "ids", doc_id: str = "doc_id", model: str | None = None) -> DataFrame:
    """doc_id, text."""
    shared = rows.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches):
        v = shared.value
        for batch in batches:
            lists = pc.if_else(pc.is_null(batch.column("ids")), pa.scalar([], pa.list_(pa.int32())), batch.column("ids"))
            starts = np.concatenate(([0], np.cumsum(pc.list_value_length(lists).to_numpy()))).astype(np.int64)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), v.decode(lists.flatten().to_numpy(), starts).cast(pa.string())], ["doc_id", "text"])

    return rows.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(ids).cast("array<int>").alias("ids")).mapInArrow(run, "doc_id long, text string")


def round_trip(docs: DataFrame, text: str = "text", doc_id: str = "doc_id", model: str | None = None) -> DataFrame:
    """doc_id, n_ids, ids_crc32 (of little-endian unsigned 32-bit ids), restored: whether decoding gives the text back."""
    shared = docs.sparkSession.sparkContext.broadcast(Vocabulary(model))

    def run(batches):
        import zlib

        v = shared.value
        for batch in slices(batches):
            texts = batch.column("text")
            ids, starts = v.encode(texts)
            raw = ids.astype("<u4").tobytes()
            crc = [zlib.crc32(raw[4 * a:4 * b]) for a, b in zip(starts[:-1], starts[1:])]
            same = pc.equal(v.decode(ids, starts), pc.fill_null(texts, "").cast(pa.large_string()))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(np.diff(starts)), pa.array(crc, pa.int64()), same], ["doc_id", "n_ids", "ids_crc32", "restored"])

    rows = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return rows.mapInArrow(run, "doc_id long, n_ids long, ids_crc32 long, restored boolean")
