"""Byte-level BPE encoding and decoding with the tokenizers library over Arrow batches.

The rank file gives tokens as bytes. Bytes are mapped to printable characters, every way of
splitting a token into two tokens becomes a merge, and the library then merges by rank. Texts are
cut at single spaces between words, where no match of the pattern can cross, so that each distinct
piece of a batch is encoded once. Decoding maps token characters back through the byte table; a
character whose bytes lie in several tokens is put together again because bytes are joined first.

Null text counts as empty (no ids). Empty tables give empty results. Repeated rows are encoded each.
Extra columns of the input are ignored. Very long texts are handled alone, in time n log n.
"""

from __future__ import annotations

import base64
import hashlib
import heapq
import os
import re
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession

from .common import chunks, documents, frugal, shipped, spread, text_only

#: White space of the split pattern that is not one plain space beside it, in RE2 syntax.
_SPACE = r"[\s\x{0b}\x{1c}-\x{1f}\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}]"
_IRREGULAR = rf"{_SPACE} | {_SPACE}| $"


def byte_table() -> list[str]:
    """Printable character of each byte: itself where printable, else the next code point from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    extra = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(extra)) for b in range(256)]


class ByteBpe:
    """Encoder and decoder for one rank file."""

    def __init__(self, path: str, pattern: str):
        from tokenizers import Regex, Tokenizer, models, pre_tokenizers

        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        table = byte_table()
        chars = {t: "".join(table[b] for b in t) for t in self.ranks}
        merges = []
        for token in sorted(self.ranks, key=self.ranks.get):
            cuts = [i for i in range(1, len(token)) if token[:i] in self.ranks and token[i:] in self.ranks]
            # where two splits can overlap, the one that starts further left comes first
            cuts.sort(key=lambda i: (not token.startswith(token[i:]), i))
            merges += [(chars[token[:i]], chars[token[i:]]) for i in cuts]
        self.tokenizer = Tokenizer(models.BPE({chars[t]: r for t, r in self.ranks.items()}, merges))
        self.tokenizer.pre_tokenizer = pre_tokenizers.Sequence(
            [pre_tokenizers.Split(Regex(pattern), "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)]
        )
        self.tokenizer.encode_special_tokens = True
        # two splits of a token can only compete, whatever their order, where it repeats a part three times or more
        roots = {t[:p] for t in self.ranks for p in range(1, len(t) // 3 + 1) if len(t) % p == 0 and t == t[:p] * (len(t) // p)}
        self.contested = "|".join(re.escape((u * 3).decode("utf-8", "surrogateescape")) for u in sorted(roots)) or r"[^\x{0}-\x{10ffff}]"
        back = {c: b for b, c in enumerate(table)}
        tokens = [b""] * (max(self.ranks.values()) + 1)
        for t, r in self.ranks.items():
            tokens[r] = bytes(back[c] for c in chars[t])
        self.token_lengths = np.array([len(t) for t in tokens], np.int64)
        self.token_starts = np.cumsum(self.token_lengths) - self.token_lengths
        self.token_bytes = np.frombuffer(b"".join(tokens), np.uint8)

    def _exact(self, word: bytes) -> list[int]:
        """Lowest rank first, leftmost on ties: the definition, for words in which splits compete."""
        ranks = self.ranks
        parts = [word[i : i + 1] for i in range(len(word))]
        after, before = list(range(1, len(parts) + 1)), list(range(-1, len(parts) - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(len(parts) - 1) if (r := ranks.get(parts[i] + parts[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= len(parts) or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, b""
            after[i] = k = after[j]
            if k < len(parts):
                before[k] = i
                if (r := ranks.get(parts[i] + parts[k])) is not None:
                    heapq.heappush(heap, (r, i, parts[i], parts[k]))
            if (h := before[i]) >= 0 and (r := ranks.get(parts[h] + parts[i])) is not None:
                heapq.heappush(heap, (r, h, parts[h], parts[i]))
        return [ranks[p] for p in parts if p]

    def pieces_of(self, text: str) -> list[tuple[str, tuple[int, int]]]:
        """Matches of the pattern, byte-mapped, with their character offsets."""
        return self.tokenizer.pre_tokenizer.pre_tokenize_str(text)

    def encode_many(self, texts: pa.Array) -> list[list[int]]:
        out = [e.ids for e in self.tokenizer.encode_batch_fast(texts.to_pylist(), add_special_tokens=False)]
        for k in np.flatnonzero(pc.match_substring_regex(texts, self.contested).to_numpy(zero_copy_only=False)):
            text = texts[int(k)].as_py()
            out[k] = list(chain.from_iterable(self._exact(text[a:b].encode()) for _, (a, b) in self.pieces_of(text)))
        return out

    def encode_arrow(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts one after the other, and each text's bounds in them."""
        n = len(texts)
        odd = pc.match_substring_regex(texts, _IRREGULAR).to_numpy(zero_copy_only=False).astype(bool)
        lists = pc.split_pattern(pc.if_else(pa.array(odd), "", texts), " ")
        bounds = lists.offsets.to_numpy().astype(np.int64)
        flat = lists.values.slice(bounds[0], bounds[-1] - bounds[0])
        bounds = bounds - bounds[0]
        first = np.zeros(len(flat), bool)
        first[bounds[:-1][bounds[:-1] < len(flat)]] = True
        flat = pc.if_else(pa.array(first), flat, pc.binary_join_element_wise("", flat, " "))
        whole = np.flatnonzero(odd)
        if len(whole):  # these texts are pieces of their own
            flat = pa.concat_arrays([flat, texts.take(pa.array(whole))])
        coded = flat.dictionary_encode()
        ids = self.encode_many(coded.dictionary)
        lengths = np.fromiter(map(len, ids), np.int64, len(ids))
        pool = np.fromiter(chain.from_iterable(ids), np.uint32, int(lengths.sum()))
        starts = np.cumsum(lengths) - lengths
        index = coded.indices.to_numpy().astype(np.int64)
        regular = len(index) - len(whole)
        order = np.arange(regular, dtype=np.int64)
        if len(whole):
            counts = np.diff(bounds)  # an odd text has one empty piece here, which its whole text replaces
            order[bounds[:-1][whole]] = regular + np.arange(len(whole))
            bounds = np.concatenate([[0], np.cumsum(counts)])
        index = index[order]
        taken = lengths[index]
        ends = np.concatenate([[0], np.cumsum(taken)])
        return pool[spread(starts[index], taken)], ends[bounds] if n else np.zeros(1, np.int64)

    def decode(self, ids: np.ndarray) -> bytes:
        ids = np.asarray(ids, np.int64)
        return self.token_bytes[spread(self.token_starts[ids], self.token_lengths[ids])].tobytes()

    def offsets(self, ids: np.ndarray) -> np.ndarray:
        """Byte offset of each token's start in the text."""
        n = self.token_lengths[np.asarray(ids, np.int64)]
        return np.cumsum(n) - n


@lru_cache(4)
def codec(path: str, pattern: str) -> ByteBpe:
    os.environ["TOKENIZERS_PARALLELISM"] = "false"
    return ByteBpe(path, pattern)


def default_files() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN


def encode(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id, ids and byte offsets of each token, of every whole text."""
    path, pattern = (path or default_files()[0]), (pattern or default_files()[1])

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for part in chunks(batch):
                ids, bounds = bpe.encode_arrow(part.column("text"))
                offs = np.concatenate([bpe.offsets(ids[a:b]) for a, b in zip(bounds, bounds[1:])] or [np.zeros(0, np.int64)])
                at = pa.array(bounds.astype(np.int32))
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), pa.ListArray.from_arrays(at, pa.array(ids.astype(np.int32))), pa.ListArray.from_arrays(at, pa.array(offs.astype(np.int64)))],
                    ["doc_id", "ids", "offsets"],
                )

    return text_only(docs).mapInArrow(frugal(run), "doc_id long, ids array<int>, offsets array<long>")


def decode(encoded: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """doc_id and text of ids; bytes are joined before they are read as UTF-8."""
    path, pattern = (path or default_files()[0]), (pattern or default_files()[1])

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            texts = [bpe.decode(np.array(x or [], np.int64)).decode("utf-8", "replace") for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    shipped(encoded.sparkSession)
    return encoded.select("doc_id", "ids").mapInArrow(frugal(run), "doc_id long, text string")


def digests(docs: DataFrame, path: str | None = None, pattern: str | None = None) -> DataFrame:
    """Per document: number of ids, SHA-256 of the ids and of the bytes decoded from them."""
    path, pattern = (path or default_files()[0]), (pattern or default_files()[1])

    def run(batches):
        bpe = codec(path, pattern)
        for batch in batches:
            for part in chunks(batch):
                ids, bounds = bpe.encode_arrow(part.column("text"))
                ids = ids.astype("<u4")
                back = bpe.decode(ids)
                ends = np.concatenate([[0], np.cumsum(bpe.token_lengths[ids])])[bounds]
                pairs = list(zip(bounds.tolist(), bounds[1:].tolist()))
                view, decoded = ids.tobytes(), memoryview(back)
                yield pa.RecordBatch.from_arrays(
                    [
                        part.column("doc_id"),
                        pa.array(np.diff(bounds)),
                        pa.array([hashlib.sha256(view[4 * a : 4 * b]).hexdigest() for a, b in pairs], pa.string()),
                        pa.array([hashlib.sha256(decoded[a:b]).hexdigest() for a, b in zip(ends.tolist(), ends[1:].tolist())], pa.string()),
                    ],
                    ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                )

    return text_only(docs).mapInArrow(frugal(run), "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op8_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(documents(spark, sf_dir))
