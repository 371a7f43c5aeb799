"""Byte-level BPE by monoid tree reduction.

A piece (one match of the splitting pattern) is encoded by halves. Two neighbouring encodings are joined by encoding
anew a window of tokens on both sides of the seam; the window grows until the token left of it and the token right of
it are each *settled* against the window's edge. Two tokens are settled if their joint bytes encode to just these two.
A token sequence is the encoding of its bytes exactly if all its neighbours are settled, so nothing outside the window
can change and the join is exact. Joining is associative with the empty encoding as its unit. Pieces never merge
across their borders, so above the pieces the join is concatenation. Decoding concatenates token bytes up the tree.

Defined cases: a null text counts as empty and has no tokens; repeated rows are encoded each; an empty table gives an
empty table; all input columns are kept, and input columns named like an output are replaced. A text is held whole by
one worker; texts are taken in slices of about 1 MB or one text.
"""

from __future__ import annotations

import base64
import heapq
import re
import uuid
from array import array
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ._spark import by_size, ship

LEAF = 24  # bytes up to which a piece is merged directly
KEPT_PIECES, KEPT_PAIRS, KEPT_BYTES = 300_000, 200_000, 256  # entries of a worker's caches, which start anew when full, and bytes of a piece that is kept
NEVER = 1 << 60


def load_ranks(path: str) -> dict[bytes, int]:
    """Ranks from a file of base64 token and rank a line."""
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}


#: Below U+0250 without the few characters that classes treat specially, letters, digits and blanks are these; the
#: standard library's engine then splits as the pattern's Unicode classes do, twice as fast.
NARROW = re.compile("[\\x00-\\xb1\\xb4-\\xb8\\xba\\xbb\\xbf-\u024f]*")
NARROW_CLASSES = {"\\p{L}": "A-Za-z\u00aa\u00b5\u00ba\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u024f", "\\p{N}": "0-9", "\\s": "\\t-\\r \\x85\u00a0"}


def narrow_pattern(pattern: str) -> re.Pattern | None:
    """The pattern for texts that NARROW matches, or None if it uses other classes."""
    out, inside, at = "", False, 0
    while at < len(pattern):
        name = next((n for n in (*NARROW_CLASSES, "\\S", "\\p", "\\P", "\\w", "\\d") if pattern.startswith(n, at)), pattern[at])
        if name in NARROW_CLASSES:
            out += NARROW_CLASSES[name] if inside else f"[{NARROW_CLASSES[name]}]"
        elif name == "\\S" and not inside:
            out += f"[^{NARROW_CLASSES['\\s']}]"
        elif len(name) > 1:
            return None
        else:
            inside = inside and name != "]" or name == "["
            out += name
        at += len(name)
    return re.compile(out)


class Pieces(dict):
    """piece -> ids, filled as pieces are met."""

    def __init__(self, encode):
        super().__init__()
        self.encode = encode

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.encode(piece)
        if len(piece) <= KEPT_BYTES:
            if len(self) >= KEPT_PIECES:
                self.clear()
            self[piece] = ids
        return ids


class Codec:
    """Encoder and decoder of one rank table."""

    def __init__(self, ranks: dict[bytes, int], pattern: str):
        import regex

        self.ranks, self.wide, self.narrow = ranks, regex.compile(pattern), narrow_pattern(pattern)
        self.token = [b""] * (max(ranks.values(), default=-1) + 1)
        for t, r in ranks.items():
            self.token[r] = t
        self.pieces = Pieces(self.piece)
        self.pairs: dict[tuple[int, int], bool] = {}

    def merged(self, data: bytes) -> list[int]:
        """The lowest-rank pair is merged first, the leftmost of equals, until no pair is in the table."""
        return self._merged_short(data) if len(data) <= 4 * LEAF else self._merged_long(data)

    def _merged_short(self, data: bytes) -> list[int]:
        get, parts = self.ranks.get, [data[i : i + 1] for i in range(len(data))]
        costs = [get(data[i : i + 2], NEVER) for i in range(len(data) - 1)]
        while costs:
            best = min(costs)
            if best == NEVER:
                break
            i = costs.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del costs[i]
            if i < len(costs):
                costs[i] = get(parts[i] + parts[i + 1], NEVER)
            if i:
                costs[i - 1] = get(parts[i - 1] + parts[i], NEVER)
        return [self.ranks[p] for p in parts]

    def _merged_long(self, data: bytes) -> list[int]:
        """The same over a linked list with a heap: n log n, for windows that repeated letters make long."""
        n, get = len(data), self.ranks.get
        parts: list[bytes | None] = [data[i : i + 1] for i in range(n)]
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, 2) for i in range(n - 1) if (r := get(data[i : i + 2])) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, size = heapq.heappop(heap)
            if parts[i] is None or (j := after[i]) >= n or len(parts[i]) + len(parts[j]) != size:
                continue
            parts[i] += parts[j]
            parts[j] = None
            after[i] = after[j]
            if after[i] < n:
                before[after[i]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := get(both := parts[k] + parts[after[k]])) is not None:
                    heapq.heappush(heap, (r, k, len(both)))
        return [self.ranks[p] for p in parts if p is not None]

    def settled(self, left: int, right: int) -> bool:
        if (known := self.pairs.get((left, right))) is None:
            if len(self.pairs) >= KEPT_PAIRS:
                self.pairs.clear()
            known = self.pairs[left, right] = self.merged(self.token[left] + self.token[right]) == [left, right]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        """The encoding of the bytes of both."""
        if not left or not right:
            return left or right
        i = j = 1
        while True:
            window = self.merged(b"".join(self.token[t] for t in chain(left[-i:], right[:j])))
            left_ok = i == len(left) or self.settled(left[-i - 1], window[0])
            right_ok = j == len(right) or self.settled(window[-1], right[j])
            if left_ok and right_ok:
                return left[:-i] + window + right[j:]
            i, j = i if left_ok else min(2 * i, len(left)), j if right_ok else min(2 * j, len(right))

    def tree(self, data: bytes) -> list[int]:
        if len(data) <= LEAF:
            return self.merged(data)
        half = len(data) // 2
        return self.join(self.tree(data[:half]), self.tree(data[half:]))

    def piece(self, text: str) -> tuple[int, ...]:
        data = text.encode()
        whole = self.ranks.get(data)
        return tuple(self.tree(data)) if whole is None else (whole,)

    def split(self, text: str) -> list[str]:
        return (self.narrow if self.narrow and NARROW.fullmatch(text) else self.wide).findall(text)

    def encode(self, text: str) -> array:
        return array("i", chain.from_iterable(map(self.pieces.__getitem__, self.split(text))))

    def decode(self, ids) -> bytes:
        return b"".join(map(self.token.__getitem__, ids))


_codecs: dict[str, Codec] = {}  # of this worker process: caches live on between tasks


def _codec(shared, pattern: str, key: str) -> Codec:
    if key not in _codecs:
        _codecs.clear()
        _codecs[key] = Codec(shared.value, pattern)
    return _codecs[key]


def round_trip(df: DataFrame, ranks: dict[bytes, int], pattern: str, text: str = "text", ids: str = "ids", decoded: str | None = "decoded") -> DataFrame:
    """df with the token ids of `text` (array of int) and, unless `decoded` is None, the bytes that these ids decode
    to. Narrow: no shuffle; the rank table (under 1 MB for 50,000 tokens) is broadcast."""
    spark = df.sparkSession
    ship(spark)
    shared, key = spark.sparkContext.broadcast(ranks), uuid.uuid4().hex
    kept = [c for c in df.columns if c not in (ids, decoded)]
    added = [T.StructField(ids, T.ArrayType(T.IntegerType(), False))] + ([T.StructField(decoded, T.BinaryType())] if decoded else [])
    schema = T.StructType([df.schema[c] for c in kept] + added)

    def run(batches):
        codec = _codec(shared, pattern, key)
        for b in by_size(batches, kept.index(text), rows=256):
            all_ids, ends, back = array("i"), [0], []
            for t in b.column(kept.index(text)).to_pylist():
                own = codec.encode(t or "")
                all_ids.extend(own)
                ends.append(len(all_ids))
                if decoded:
                    back.append(codec.decode(own))
            arrays = [pa.ListArray.from_arrays(pa.array(np.array(ends, dtype=np.int32)), pa.array(np.frombuffer(all_ids, dtype=np.int32) if all_ids else np.zeros(0, np.int32)))]
            arrays += [pa.array(back, pa.binary())] if decoded else []
            yield pa.RecordBatch.from_arrays([*b.columns, *arrays], names=[*kept, *[f.name for f in added]])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def decode(df: DataFrame, ranks: dict[bytes, int], ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the bytes that the ids decode to; null ids decode to no bytes."""
    spark = df.sparkSession
    ship(spark)
    shared, key = spark.sparkContext.broadcast(ranks), uuid.uuid4().hex
    kept = [c for c in df.columns if c != decoded]
    schema = T.StructType([*[df.schema[c] for c in kept], T.StructField(decoded, T.BinaryType())])

    def run(batches):
        codec = _codec(shared, ".+", key)
        for b in (x.slice(at, 64) for x in batches for at in range(0, x.num_rows, 64)):
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([codec.decode(x or ()) for x in b.column(kept.index(ids)).to_pylist()], pa.binary())], names=[*kept, decoded])

    return df.select(*[F.col(f"`{c}`") for c in kept]).mapInArrow(run, schema)


def tokenizer(name: str = "byte_bpe_multi_50k.tiktoken") -> tuple[dict[bytes, int], str]:
    """Ranks and pattern of a public rank file."""
    import public_tokenizers

    return load_ranks(public_tokenizers.path(name)), public_tokenizers.PATTERN


def digests(spark: SparkSession, df: DataFrame) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of documents."""
    done = round_trip(df.select("doc_id", "text"), *tokenizer())
    return done.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )
