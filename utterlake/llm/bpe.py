"""Encoding of texts with a byte-level BPE vocabulary.

Pre-tokens of a batch of texts are encoded together. Every adjacent pair with a merge
sits in the bucket of its merge rank, as a position in a doubly linked list of symbols; a
hierarchical bitmap over the ranks yields the next one by find-first-set; entries whose
pair has changed meanwhile are skipped. A pair that holds a new symbol always has a later
rank than the merge that made the symbol, so each rank comes up once and its whole bucket
is merged at once, over all pre-tokens of the batch. The work is linear in the bytes
however long a pre-token is.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
# Fixed value: the published pre-token pattern of this vocabulary.
PRE_TOKEN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Bytes of pre-tokens encoded together; one longer pre-token is encoded by itself.
BATCH_BYTES = 4_000_000
MAX_RANKS = 1 << 16


def byte_alphabet() -> list[str]:
    """The printable character by which byte-level vocabularies write each byte."""
    keep = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in set(keep) else chr(next(spare)) for b in range(256)]


class RankBitmap:
    """Set of ranks below 64**3 whose least member is found by find-first-set on three levels."""

    def __init__(self) -> None:
        self.top, self.mid, self.low = 0, [0] * 64, [0] * 4096

    def add(self, r: int) -> None:
        self.low[r >> 6] |= 1 << (r & 63)
        self.mid[r >> 12] |= 1 << (r >> 6 & 63)
        self.top |= 1 << (r >> 12)

    def pop(self) -> int:
        """The least rank, taken out; -1 if there is none."""
        if not self.top:
            return -1
        a = (self.top & -self.top).bit_length() - 1
        b = a << 6 | (self.mid[a] & -self.mid[a]).bit_length() - 1
        r = b << 6 | (self.low[b] & -self.low[b]).bit_length() - 1
        self.low[b] &= self.low[b] - 1
        if not self.low[b]:
            self.mid[a] &= self.mid[a] - 1
            if not self.mid[a]:
                self.top &= self.top - 1
        return r


class Merges:
    """The merges of a vocabulary: pairs by rank, ids of the results, ids of the bytes."""

    def __init__(self, left: np.ndarray, right: np.ndarray, result: np.ndarray, byte_ids: np.ndarray) -> None:
        if len(left) > MAX_RANKS:
            raise ValueError(f"{len(left)} merges; at most {MAX_RANKS} are supported")
        self.left, self.right, self.result, self.byte_ids = left, right, result, byte_ids
        self.span = int(max(left.max(initial=0), right.max(initial=0), result.max(initial=0), byte_ids.max())) + 2
        keys = left.astype(np.int64) * self.span + right
        self.order = np.argsort(keys).astype(np.int32)
        self.keys = keys[self.order]
        made = dict(zip(result.tolist(), range(len(result))))
        if any(made.get(x, -1) >= i for i, ab in enumerate(zip(left.tolist(), right.tolist())) for x in ab):
            raise ValueError("a merge uses a symbol that a later merge makes")
        self.of_bytes = self.ranks(np.repeat(byte_ids, 256), np.tile(byte_ids, 256)).reshape(256, 256)

    @classmethod
    def read(cls, path: str) -> "Merges":
        with open(path, encoding="utf-8") as f:
            model = json.load(f)["model"]
        vocab = model["vocab"]
        pairs = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        ids = lambda words: np.array([vocab[w] for w in words], np.int32)
        return cls(ids(a for a, _ in pairs), ids(b for _, b in pairs), ids(a + b for a, b in pairs), ids(byte_alphabet()))

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The rank of each pair, -1 where the pair has no merge."""
        if not len(self.keys):
            return np.full(len(a), -1, np.int32)
        key = a.astype(np.int64) * self.span + b
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.order[at], -1)


def _grouped(ranks: np.ndarray, positions: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    order = np.argsort(ranks.astype(np.uint16), kind="stable")
    ranks, positions = ranks[order], positions[order]
    cuts = np.flatnonzero(ranks[1:] != ranks[:-1]) + 1
    edges = [0, *cuts.tolist(), len(ranks)]
    for i, j in zip(edges[:-1], edges[1:]):
        if j > i:
            yield int(ranks[i]), positions[i:j]


def encode_pieces(pieces: list[bytes], m: Merges) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all pieces one after another, number of ids of each piece); pieces aren't empty."""
    raw = np.frombuffer(b"".join(pieces), np.uint8)
    n = len(raw)
    if not n:
        return np.empty(0, np.int32), np.zeros(len(pieces), np.int64)
    ends = np.cumsum(np.fromiter(map(len, pieces), np.int64, len(pieces)))
    symbol = np.append(m.byte_ids[raw], np.int32(-1)).astype(np.int32)
    after = np.arange(1, n + 2, dtype=np.int32)  # place n stands for the end of a piece
    after[ends - 1] = n
    before = np.arange(-1, n, dtype=np.int32)
    before[0] = n
    before[ends[:-1]] = n
    first = m.of_bytes[raw[:-1], raw[1:]]
    open_ = (first >= 0) & (after[: n - 1] != n)
    buckets: dict[int, list[np.ndarray]] = {}
    queue = RankBitmap()
    at = np.flatnonzero(open_).astype(np.int32)
    for r, where in _grouped(first[at], at):
        buckets[r] = [where]
        queue.add(r)
    while (r := queue.pop()) >= 0:
        found = buckets.pop(r)
        at = found[0] if len(found) == 1 else np.concatenate(found)
        a, b, new = int(m.left[r]), int(m.right[r]), m.result[r]
        at = at[symbol[at] == a]
        at = at[symbol[after[at]] == b]  # the rest are stale
        if not len(at):
            continue
        if a == b:  # of a run of equal symbols the first, third, ... pair merges
            at = np.sort(at)
            chained = np.zeros(len(at), bool)
            chained[1:] = after[at[:-1]] == at[1:]
            index = np.arange(len(at))
            begun = np.maximum.accumulate(np.where(chained, 0, index))
            at = at[(index - begun) % 2 == 0]
        gone = after[at]
        beyond = after[gone]
        symbol[at] = new
        symbol[gone] = -1
        after[at] = beyond
        before[beyond] = at
        prior = before[at]
        prior = prior[(prior != n) & (symbol[prior] != new)]  # new before new comes as its right pair
        at = at[beyond != n]
        at = np.concatenate((prior, at))
        ranks = m.ranks(symbol[at], symbol[after[at]])
        ok = ranks >= 0
        if ok.any():
            for k, where in _grouped(ranks[ok], at[ok]):
                if k in buckets:
                    buckets[k].append(where)
                else:
                    buckets[k] = [where]
                    queue.add(k)
    alive = symbol[:n] >= 0
    upto = np.cumsum(alive)[ends - 1]
    return symbol[:n][alive], np.diff(upto, prepend=0)


def encode_texts(texts: list[str | None], m: Merges, batch_bytes: int = BATCH_BYTES) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, ids) of a list array: the ids of each text; none for an empty or null text."""
    number: dict[str, int] = {}
    of_text: list[int] = []
    counts = np.zeros(len(texts), np.int64)
    find = regex.compile(PRE_TOKEN).findall
    for i, t in enumerate(texts):
        if t:
            found = [number.setdefault(x, len(number)) for x in find(t)]
            of_text += found
            counts[i] = len(found)
    ids, lengths, part, size = [], [], [], 0
    for x in number:
        b = x.encode("utf-8", "surrogatepass")
        if part and size + len(b) > batch_bytes:
            out = encode_pieces(part, m)
            ids.append(out[0])
            lengths.append(out[1])
            part, size = [], 0
        part.append(b)
        size += len(b)
    out = encode_pieces(part, m)
    ids = np.concatenate([*ids, out[0]])
    lengths = np.concatenate([*lengths, out[1]])
    starts = np.cumsum(lengths) - lengths
    seq = np.asarray(of_text, np.int64)
    lens = lengths[seq]
    ends = np.cumsum(lens)
    values = ids[np.repeat(starts[seq] - (ends - lens), lens) + np.arange(ends[-1] if len(ends) else 0)]
    tokens = np.concatenate(([0], ends))[np.concatenate(([0], np.cumsum(counts)))]
    return tokens, values


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", vocabulary: str = DEFAULT_VOCABULARY, out_col: str = "ids") -> DataFrame:
    """(id, ids array<int>) of every row: ``text`` encoded without special tokens.

    Null and empty texts get an empty list. Strings of special tokens in a text are
    ordinary text. Repeated rows come out as often as they came in. The merges (a bounded
    table of at most 65,536 rows) are read on the driver and sent to each task.
    """
    spark = df.sparkSession
    m = Merges.read(vocabulary)
    shared = spark.sparkContext.broadcast((m.left, m.right, m.result, m.byte_ids))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Merges(*shared.value)
        for b in batches:
            offsets, values = encode_texts(b.column(1).to_pylist(), own)
            ids = pa.LargeListArray.from_arrays(pa.array(offsets, pa.int64()), pa.array(values, pa.int32())).cast(pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([b.column(0), ids], [id_col, out_col])

    return df.select(F.col(id_col), F.col(text_col)).mapInArrow(run, f"`{id_col}` {df.schema[id_col].dataType.simpleString()}, `{out_col}` array<int>")
