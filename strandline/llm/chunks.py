"""Token ids of whole texts by a byte-level BPE, computed once per distinct word of a slice.

A byte-level BPE of this family never lets a token cross the place before a single space that stands between
two words. So a text is cut there, each distinct " word" is encoded once per slice, and ids are put back by
array lookups. Where a word starts or ends with anything but a letter, digit or printable ASCII sign, or where
spaces repeat, the words around are left together and encoded as they stand. A test compares whole texts.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from .words import gather

PLAIN = r"(?s)^[!-~\p{L}\p{N}](.*[!-~\p{L}\p{N}])?$"
JOIN = 2000  # words handed to the tokenizer at a time


class Chunks:
    """Encoder of one task. path: a tokenizer file; None for the public byte-level one."""

    def __init__(self, path: str | None = None):
        import os

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        from tokenizers import Tokenizer

        if path is None:
            import public_tokenizers

            path = public_tokenizers.path("byte_bpe_50k.json")
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.encode_special_tokens = True
        size = self.tokenizer.get_vocab_size()
        self.spaced = np.array([(self.tokenizer.id_to_token(i) or "").startswith("Ġ") for i in range(size)])

    def plain(self, texts: list[str]) -> list[list[int]]:
        return [x.ids for x in self.tokenizer.encode_batch_fast(texts, add_special_tokens=False)]

    def joined(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids and lengths of " word" for plain words, many in one call; a new word begins at each id with a leading space."""
        parts = self.plain([" " + " ".join(texts[i:i + JOIN]) for i in range(0, len(texts), JOIN)])
        ids = np.concatenate([np.array(p, np.uint32) for p in parts]) if parts else np.zeros(0, np.uint32)
        begin = np.flatnonzero(self.spaced[ids])
        if len(begin) != len(texts):  # a vocabulary that doesn't mark spaces so
            lists = self.plain([" " + t for t in texts])
            return np.array([i for x in lists for i in x], np.uint32), np.array([len(x) for x in lists])
        return ids, np.diff(np.append(begin, len(ids)))

    def encode(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids of the texts (null as empty), and where each text's ids begin."""
        texts = pc.fill_null(texts, "").cast(pa.large_string())
        if not len(texts):
            return np.zeros(0, np.uint32), np.zeros(1, np.int64)
        parts = pc.split_pattern(texts, " ")
        offsets = parts.offsets.to_numpy() - parts.offsets[0].as_py()
        flat = parts.flatten().dictionary_encode()
        codes, vocabulary = flat.indices.to_numpy(zero_copy_only=False), flat.dictionary
        clean = pc.match_substring_regex(vocabulary, PLAIN).to_numpy(zero_copy_only=False)
        first = np.zeros(len(codes), bool)
        first[offsets[:-1]] = True
        ok = clean[codes]
        cut = first.copy()
        cut[1:] |= ok[1:] & ok[:-1]
        begin = np.flatnonzero(cut)
        size = np.diff(np.append(begin, len(codes)))
        alone = (size == 1) & ok[begin] & ~first[begin]
        # distinct plain words
        used = np.zeros(len(vocabulary), bool)
        used[codes[begin[alone]]] = True
        wanted = np.flatnonzero(used)
        ids, length = self.joined(vocabulary.take(pa.array(wanted)).to_pylist())
        slot = np.zeros(len(vocabulary), np.int64)
        slot[wanted] = np.arange(len(wanted))
        entry = np.empty(len(begin), np.int64)
        entry[alone] = slot[codes[begin[alone]]]
        # everything else as it stands
        known: dict[str, int] = {}
        rest = np.flatnonzero(~alone)
        if len(rest):
            single = rest[size[rest] == 1]
            word = vocabulary.take(pa.array(codes[begin[single]])).to_pylist()
            lead = first[begin[single]]
            for i, w, f in zip(single.tolist(), word, lead.tolist()):
                entry[i] = known.setdefault(w if f else " " + w, len(known))
            for i in rest[size[rest] > 1].tolist():
                a = begin[i]
                w = " ".join(vocabulary.take(pa.array(codes[a:a + size[i]])).to_pylist())
                entry[i] = known.setdefault(w if first[a] else " " + w, len(known))
            entry[rest] += len(wanted)
            lists = self.plain(list(known))
            ids = np.concatenate([ids, np.array([i for x in lists for i in x], np.uint32)])
            length = np.concatenate([length, np.array([len(x) for x in lists], np.int64)])
        starts = np.concatenate(([0], np.cumsum(length))).astype(np.int64)
        out, at = gather(ids, starts, entry)
        bounds = np.searchsorted(begin, offsets)  # a text's first chunk
        return out, at[bounds]
