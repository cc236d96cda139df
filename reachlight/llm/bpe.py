"""BPE encoding and decoding with a segment tree over adjacent pair ranks.

Null text counts as empty (no tokens, hash of the empty string); repeated rows give repeated results; an empty table
gives an empty table. Long pieces cost O(n log n). Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import json
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import texts

PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\p{White_Space}\p{L}\p{N}]+|\p{White_Space}+(?!\P{White_Space})|\p{White_Space}+"
#: Bytes of encoded pieces that a worker keeps; when full, the memory starts anew. Results do not depend on it.
MEMO_BYTES, ENTRY_BYTES = 200_000_000, 200
#: Rows and tokens of one output batch, so that a worker holds few documents at a time.
BATCH_ROWS, BATCH_TOKENS = 200, 500_000
NONE = 1 << 62


class PairTree:
    """Minimum tree over (rank, position): the root is the leftmost merge of the lowest rank."""

    def __init__(self, keys: list[int]):
        self.size = 1 << max(0, (len(keys) - 1).bit_length())
        self.node = node = [NONE] * self.size + keys + [NONE] * (self.size - len(keys))
        for i in range(self.size - 1, 0, -1):
            a, b = node[2 * i], node[2 * i + 1]
            node[i] = a if a < b else b

    def root(self) -> int:
        return self.node[1]

    def put(self, i: int, key: int) -> None:
        node, i = self.node, i + self.size
        node[i] = key
        while i > 1:
            least, other = node[i], node[i ^ 1]
            if other < least:
                least = other
            i >>= 1
            if node[i] == least:
                return
            node[i] = least


class Bpe(dict):
    """Piece -> its ids as little-endian 32-bit integers."""

    def __init__(self, path: str):
        super().__init__()
        self.held = 0
        spec = json.load(open(path, encoding="utf-8"))
        vocab = spec["model"]["vocab"]
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        back = {c: b for b, c in chars.items()}
        self.byte_id = [vocab[chars[b]] for b in range(256)]
        self.token = {i: bytes(back[c] for c in s) for s, i in vocab.items()}
        self.rank = {(vocab[a], vocab[b]): (k << 32, vocab[a + b]) for k, (a, b) in enumerate(m if isinstance(m, list) else m.split(" ") for m in spec["model"]["merges"])}
        self.special = {x["content"]: x["id"] for x in spec.get("added_tokens", ())}
        self.token |= {i: s.encode() for s, i in self.special.items()}
        self.cut = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")") if self.special else None
        self.pieces = regex.compile(PATTERN).findall

    def __missing__(self, piece: str) -> bytes:
        out = np.array(self.merged([self.byte_id[b] for b in piece.encode("utf-8", "replace")]), "<u4").tobytes()
        if len(piece) < 200:
            self.held += ENTRY_BYTES + 2 * len(piece) + len(out)
            if self.held > MEMO_BYTES:
                self.clear()
                self.held = 0
            self[piece] = out
        return out

    def merged(self, sym: list[int]) -> list[int]:
        """Merges until no adjacent pair has a rank."""
        n, rank = len(sym), self.rank
        if n < 2:
            return sym
        no = (NONE, 0)
        tree = PairTree([rank[p][0] | i if (p := (sym[i], sym[i + 1])) in rank else NONE for i in range(n - 1)])
        after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
        while (top := tree.root()) < NONE:
            i = top & 0xFFFFFFFF
            j = after[i]
            sym[i], alive[j], after[i] = rank[sym[i], sym[j]][1], False, after[j]
            if j < n - 1:
                tree.put(j, NONE)
            if (k := after[i]) < n:
                before[k] = i
                key = rank.get((sym[i], sym[k]), no)[0]
                tree.put(i, key | i if key < NONE else NONE)
            else:
                tree.put(i, NONE)
            if (h := before[i]) >= 0:
                key = rank.get((sym[h], sym[i]), no)[0]
                tree.put(h, key | h if key < NONE else NONE)
        return [s for s, a in zip(sym, alive) if a]

    def encode(self, text: str) -> bytes:
        if self.cut is None or not any(s in text for s in self.special):
            return b"".join(map(self.__getitem__, self.pieces(text)))
        return b"".join(self.special[p].to_bytes(4, "little") if p in self.special else b"".join(map(self.__getitem__, self.pieces(p))) for p in self.cut.split(text))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.token.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


@lru_cache(2)
def load(path: str) -> Bpe:
    return Bpe(path)


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_decode(docs: DataFrame, path: str | None = None, with_ids: bool = False, with_text: bool = False) -> DataFrame:
    """One row per document: n_tokens, ids_sha256, decoded_sha256; on demand also token_ids and decoded."""
    path = str(path or default_path())
    extra = ", token_ids array<int>" * with_ids + ", decoded string" * with_text

    def batch_of(rows: list[tuple]) -> pa.RecordBatch:
        doc, n, ids, sha, back, text = zip(*rows)
        cols = {"doc_id": pa.array(doc, pa.int64()), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(sha, pa.string()), "decoded_sha256": pa.array(back, pa.string())}
        if with_ids:
            ends = np.concatenate([[0], np.cumsum(n)]).astype(np.int32)
            cols["token_ids"] = pa.ListArray.from_arrays(pa.array(ends), pa.array(np.frombuffer(b"".join(ids), "<i4")))
        if with_text:
            cols["decoded"] = pa.array(text, pa.string())
        return pa.RecordBatch.from_arrays(list(cols.values()), names=list(cols))

    def run(batches):
        bpe = load(path)
        for batch in batches:
            rows, held = [], 0
            for i, t in zip(batch.column("doc_id"), batch.column("text")):
                ids = bpe.encode(t.as_py())
                back = bpe.decode(ids)
                rows.append((i.as_py(), len(ids) // 4, ids if with_ids else b"", hashlib.sha256(ids).hexdigest(), hashlib.sha256(back.encode()).hexdigest(), back if with_text else None))
                held += len(ids) // 4
                if len(rows) >= BATCH_ROWS or held >= BATCH_TOKENS:
                    yield batch_of(rows)
                    rows, held = [], 0
            if rows:
                yield batch_of(rows)

    return texts(docs).mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + extra)
