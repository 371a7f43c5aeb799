"""Text functions as columns: stripping, lower-casing, tokens, 64-bit fingerprints."""

from __future__ import annotations

import unicodedata

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_ACCENTED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
_PLAIN = "".join(unicodedata.normalize("NFD", c)[0] for c in _ACCENTED)


#: Unicode white space, with the separators U+001C to U+001F.
BLANKS = "\t\n\v\f\r\x1c\x1d\x1e\x1f \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without Unicode white space at both ends."""
    return F.btrim(c, F.lit(BLANKS))


def ascii_lower(c: Column) -> Column:
    """A-Z lower-cased, all else unchanged."""
    return F.translate(c, UPPER, LOWER)


def folded(c: Column) -> Column:
    """Lower case without accents of Latin-1 letters and without combining marks, trimmed; stays in the JVM."""
    return strip(F.lower(F.translate(F.regexp_replace(c, "[̀-ͯ]", ""), _ACCENTED, _PLAIN)))


def fold(text: str) -> str:
    """The same for a driver-side string, by full decomposition."""
    return "".join(c for c in unicodedata.normalize("NFD", text) if not "̀" <= c <= "ͯ").lower().strip()


@arrow_udf(T.StringType())
def folded_any(c: pa.Array) -> pa.Array:
    """fold() of every script, in Arrow batches."""
    return pa.array([None if x is None else fold(x) for x in c.to_pylist()], pa.string())


def word_tokens(c: Column) -> Column:
    """Runs of ASCII letters and digits and all non-ASCII characters, ASCII lower-cased."""
    return F.regexp_extract_all(ascii_lower(c), F.lit(r"([A-Za-z0-9\x{80}-\x{10FFFF}]+)"), F.lit(1))


FNV_BASIS, FNV_PRIME = 0xCBF29CE484222325, 0x100000001B3  # fixed values of FNV-1a 64


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """64-bit fingerprints: every token votes +1 or -1 on each bit of its FNV-1a hash; a bit is set if its sum is above
    0. Bytes of all tokens of the batch are hashed in parallel, position by position."""
    import re

    split = re.compile(rb"[0-9a-z\x80-\xff]+").findall
    found = [split((t or "").encode("utf-8", "replace").translate(_LOWER_BYTES)) for t in texts]
    own = np.repeat(np.arange(len(found)), [len(f) for f in found])
    words, where = {}, np.empty(len(own), dtype=np.int64)
    for i, w in enumerate(w for f in found for w in f):
        where[i] = words.setdefault(w, len(words))
    sizes = np.array([len(w) for w in words], dtype=np.int64)
    data, start = np.frombuffer(b"".join(words), dtype=np.uint8).astype(np.uint64), np.cumsum(sizes) - sizes
    h = np.full(len(sizes), FNV_BASIS, dtype=np.uint64)
    with np.errstate(over="ignore"):
        for at in range(int(sizes.max(initial=0))):
            live = sizes > at
            h[live] = (h[live] ^ data[start[live] + at]) * np.uint64(FNV_PRIME)
    bits = ((h[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1)).astype(np.int8) * np.int8(2) - np.int8(1)
    votes = np.zeros((len(found), 64), dtype=np.int64)
    filled = [len(f) > 0 for f in found]
    if len(own):
        first = np.flatnonzero(np.diff(own, prepend=-1))
        votes[filled] = np.add.reduceat(bits[where].astype(np.int64), first, axis=0)
    return ((votes > 0).astype(np.uint64) << np.arange(64, dtype=np.uint64)).sum(axis=1, dtype=np.uint64).view(np.int64)


_LOWER_BYTES = bytes(range(256)).lower()


@arrow_udf(T.LongType())
def simhash64(c: pa.Array) -> pa.Array:
    """Fingerprint of a text as a signed long; texts without tokens give 0."""
    return pa.array(fingerprints(c.to_pylist()), pa.int64())


def _fnv_sql(token: Column) -> Column:
    """FNV-1a 64 of a token in built-in functions: by halves of 32 bits, so that no product leaves a long."""
    low, small = F.lit((1 << 32) - 1), FNV_PRIME & 0xFFFFFFFF
    # Latin-1 makes a character of each byte
    data = F.transform(F.split(F.decode(F.encode(token, "UTF-8"), "ISO-8859-1"), ""), lambda b: F.ascii(b).cast("long"))

    def step(h: Column, byte: Column) -> Column:
        lo = h.bitwiseXOR(byte).bitwiseAND(low)
        hi = F.shiftrightunsigned(h, 32) * small + lo * (FNV_PRIME >> 32) + F.shiftright(lo * small, 32)
        return F.shiftleft(hi, 32).bitwiseOR((lo * small).bitwiseAND(low))

    return F.aggregate(data, F.lit(FNV_BASIS - (1 << 64)).cast("long"), step)


def _majority_sql(hashes: Column) -> Column:
    """The bits that more than half of the hashes have. Bits a lane's width apart are counted at once, each in its lane
    of one long, from a start at which a majority sets the lane's last bit but one; the widest lanes hold more hashes
    than a text has room for."""
    n = F.size(hashes)

    def counted(lane: int) -> Column:
        ones = F.lit(sum(1 << i for i in range(0, 64, lane))).cast("long")
        start = (F.lit((1 << lane - 2) - 1) - F.shiftright(n, 1)).cast("long") * ones

        def bits(acc: Column, at: Column) -> Column:
            votes = F.aggregate(hashes, start, lambda v, h: v + F.call_function("shiftrightunsigned", h, at).bitwiseAND(ones))
            return acc.bitwiseOR(F.call_function("shiftleft", F.shiftrightunsigned(votes, lane - 2).bitwiseAND(ones), at))

        return F.aggregate(F.sequence(F.lit(0), F.lit(lane - 1)), F.lit(0).cast("long"), bits)

    return F.when(n < 1 << 6, counted(8)).when(n < 1 << 14, counted(16)).otherwise(counted(32))


def simhash64_sql(c: Column) -> Column:
    """simhash64 in built-in functions alone: the second kernel, for sessions without Python workers and for comparison.
    The hashes are bound to a variable, else they would be made anew for every bit."""
    hashes = F.transform(word_tokens(F.coalesce(c, F.lit(""))), _fnv_sql)
    return F.get(F.transform(F.array(hashes), _majority_sql), F.lit(0))


def fingerprint(c: Column, kernel: str = "arrow") -> Column:
    """simhash64 by the kernel asked for: arrow or sql."""
    if kernel not in ("arrow", "sql"):
        raise ValueError(f"no such kernel: {kernel!r}")
    return simhash64(F.coalesce(c, F.lit(""))) if kernel == "arrow" else simhash64_sql(c)


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b)).cast("int")
