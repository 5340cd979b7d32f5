"""Token counts by rank-synchronous merging of ragged arrays.

Texts are cut at ASCII white space, which no pre-token of the vocabulary spans; each task counts every distinct piece
once while its bounded memory of pieces holds it. New pieces are pre-tokenized by the vocabulary's own normalizer and
splitter, and their symbols are held in one flat array with sequence numbers. In every round each sequence finds its
lowest-rank pair and merges all its occurrences at once (left to right where they overlap); a sequence without a
mergeable pair is finished and its surviving symbols are counted. Everything works inside the partitions of the scan:
no shuffle, memory bounded by a slice of text and the memory of pieces.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from polisframe.llm._shared import byte_alphabet, text_column, text_slices

#: Pieces whose counts a worker remembers; beyond it the memory starts anew (counts stay the same).
REMEMBERED = 400_000


#: Pieces of ASCII and Latin letters only, on whose classes all Unicode versions agree.
_COMMON = re.compile("[!-~\u00a1-\u00ac\u00ae-\u024f]+")


class MergeTable:
    """Symbols and merge ranks of a byte-level BPE vocabulary with an end-of-word mark."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, self.vocab = spec["model"], spec["model"]["vocab"]
        self.end = model.get("end_of_word_suffix") or ""
        self.width = np.int64(max(self.vocab.values()) + 1)
        merges = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        keys = np.array([self.vocab[a] * int(self.width) + self.vocab[b] for a, b in merges], np.int64)
        made = np.array([self.vocab[a + b] for a, b in merges], np.int64)
        order = np.argsort(keys, kind="stable")
        self.keys, self.rank, self.made = keys[order], order.astype(np.int64), made
        self.tokenizer = Tokenizer.from_file(path)
        stand_in = byte_alphabet()
        self.byte_of = {c: b for b, c in enumerate(stand_in)}
        self.inner = np.array([self.vocab[c] for c in stand_in], np.int64)
        self.final = np.array([self.vocab[c + self.end] for c in stand_in], np.int64)
        split = next(p for p in spec["pre_tokenizer"]["pretokenizers"] if p["type"] == "Split")
        self.pattern = regex.compile(split["pattern"]["Regex"])
        added = [t["content"] for t in spec["added_tokens"]]
        self.added = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None

    def pretokens(self, pieces: list[str]) -> tuple[np.ndarray, list[str], np.ndarray]:
        """(piece number of each pre-token, pre-tokens, added tokens of each piece) for pieces without ASCII space."""
        extra = np.zeros(len(pieces), np.int64)
        plain, owner, odd, odd_owner = [], [], [], []
        for i, piece in enumerate(pieces):
            if "<" in piece and self.added is not None:
                parts = self.added.split(piece)
                extra[i] = len(parts) // 2
                odd += [p for p in parts[::2] if p]
                odd_owner += [i] * sum(map(bool, parts[::2]))
            elif _COMMON.fullmatch(piece):
                plain.append(piece)
                owner.append(i)
            else:
                odd.append(piece)
                odd_owner.append(i)
        normal = self.tokenizer.normalizer.normalize_str
        # pieces of Latin letters and without white space can be normalized in one go: each gives one part again
        each = [self.pattern.findall(x) for x in normal(" ".join(plain)).split(" ")] if plain else []
        split = self.tokenizer.pre_tokenizer.pre_tokenize_str
        unmap = self.byte_of.__getitem__
        strange = [[bytes(map(unmap, t)) for t, _ in split(normal(x))] for x in odd]
        owners = np.repeat(np.array(owner + odd_owner, np.int64), [len(x) for x in each] + [len(x) for x in strange])
        return owners, [t.encode() for x in each for t in x] + [t for x in strange for t in x], extra

    def survivors(self, pretokens: list[bytes]) -> np.ndarray:
        """Symbols left of each pre-token after all merges."""
        sizes = np.array([len(x) for x in pretokens], np.int64)
        raw = np.frombuffer(b"".join(pretokens), np.uint8)
        sym = self.inner[raw]
        last = np.cumsum(sizes) - 1
        sym[last] = self.final[raw[last]]
        seq = np.repeat(np.arange(len(sizes)), sizes)
        left = sizes.copy()
        left = sizes.copy()
        none = np.int64(len(self.keys))
        while len(sym) > 1:
            pair = sym[:-1] * self.width + sym[1:]
            at = np.minimum(np.searchsorted(self.keys, pair), len(self.keys) - 1)
            rank = np.where((self.keys[at] == pair) & (seq[:-1] == seq[1:]), self.rank[at], none)
            rank = np.append(rank, none)
            first = np.flatnonzero(np.append(True, seq[1:] != seq[:-1]))
            lowest = np.minimum.reduceat(rank, first)
            lengths = np.diff(np.append(first, len(sym)))
            left[seq[first]] = lengths
            best = np.repeat(lowest, lengths)
            hit = (rank == best) & (best < none)
            # of overlapping occurrences every second one merges, from the left
            index = np.arange(len(hit))
            run = index - np.maximum.accumulate(np.where(hit, 0, index + 1))
            hit &= run % 2 == 0
            sym[hit] = self.made[rank[hit]]
            keep = np.append(True, ~hit[:-1]) & (best < none)
            sym, seq = sym[keep], seq[keep]
        left[seq] = 1 if len(sym) == 1 else left[seq]
        return left

    def counts(self, pieces: list[str]) -> np.ndarray:
        owner, pretokens, total = self.pretokens(pieces)
        if pretokens:
            distinct = {t: i for i, t in enumerate(dict.fromkeys(pretokens))}
            left = self.survivors(list(distinct))
            np.add.at(total, owner, left[[distinct[t] for t in pretokens]])
        return total


_WORKER: dict[str, tuple[MergeTable, dict[bytes, int]]] = {}


def _counted(batches: Iterator[pa.RecordBatch], path: str, limit: int) -> Iterator[pa.RecordBatch]:
    if path not in _WORKER:
        _WORKER[path] = (MergeTable(path), {})
    table, known = _WORKER[path]
    for batch in text_slices(batches):
        raw = [t.encode() for t in batch.column("text").to_pylist()]
        split = [t.split() for t in raw]
        new = list({p for pieces in split for p in pieces if p not in known})
        if len(known) + len(new) > REMEMBERED:
            known.clear()
            new = list({p for pieces in split for p in pieces})
        for i in range(0, len(new), 50_000):
            part = new[i:i + 50_000]
            known.update(zip(part, table.counts([p.decode() for p in part]).tolist(), strict=True))
        n = [sum(map(known.__getitem__, pieces)) for pieces in split]
        yield pa.RecordBatch.from_pydict({
            "doc_id": batch.column("doc_id"),
            "n_bytes": pa.array([len(t) for t in raw], pa.int64()),
            "n_tokens": pa.array(n, pa.int64()),
            "over_limit": pa.array([x > limit for x in n], pa.bool_()),
        })


def count_tokens(docs: DataFrame, vocabulary: str, limit: int = 2048) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit) for every row of ``docs`` (doc_id, text).

    ``vocabulary``: path of a tokenizers JSON file that every executor has. A null or empty text has 0 bytes and 0
    tokens; a null id stays null; repeated rows are counted each; other columns are ignored; no rows give no rows.
    """
    wanted = docs.select(F.col("doc_id").cast("bigint").alias("doc_id"), text_column().alias("text"))
    return wanted.mapInArrow(lambda batches: _counted(batches, vocabulary, limit),
                             "doc_id bigint, n_bytes bigint, n_tokens bigint, over_limit boolean")
