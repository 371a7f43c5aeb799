"""Near-duplicates by improved consistent weighted sampling over TF-IDF shingles, banded, verified by weighted Jaccard.

1. Shingles of five words. Their document frequencies over all documents are counted in a sketch of two rows of 2^17
   buckets (a fixed size): a shingle's frequency is the lesser of its two buckets' counts, each less its row's median,
   which is what rare shingles together put into a bucket. So frequencies far above the spread of these loads come out
   right, and those below it count as one document. weight = tf * idf, idf = 1 + tempering * ln(1 + N/df) / ln(1 + N).
   Tempering bounds how far the commonness of a large group of copies can break the group itself: what a third of all
   documents share keeps at least 1 / (1 + tempering) of the weight of an edit.
2. Improved CWS draws 30 samples a document, 10 bands of 3.
3. Documents with the same word sequence collapse to one representative (they need no pairs). Under each key all
   members are linked to the key's least id only, so a key of m members gives m - 1 pairs, never m * m.
4. Each pair is verified on the whole texts. A leader's text is sent once for each 256 of its members; a hot leader so
   spreads over tasks.
5. Verified pairs and copies make connected components; the least id names the class. A leader may refuse a member that
   others of its key would accept. So the members of all keys that still span components go through an exact join,
   whatever the size of the key, after those have left whom the triangle inequality bars from any link across:
   shingles in one order for all texts (the rarest first), of two texts at the threshold t or above the rarest common
   shingle lies within the first (1 - t) / (1 + t) of the lighter one's weight and the first 1 - t of the heavier one's,
   and what follows it in either weighs t / (1 + t) of both weights at least. All pairs across components that meet this
   are verified, in rounds between which those that others have tied meanwhile leave; a round takes a set number of
   partners of each text, by hash, and a set multiple of it the next. So of the pairs that share a key none is lost;
   nothing is capped.

Draws are random by nature: a pair at similarity s shares a band with 1 - (1 - s^3)^10, 0.9993 at 0.8.

Defined cases: null texts count as empty; texts without words are copies of one another; null ids form no pairs and
have their copies' class; rows that repeat an id are one document, linked if any of its texts is; an empty table gives
an empty result; other columns are not read. Texts and words may be of any length: workers hold one slice of about 1 MB
or one text.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._spark import by_size, cut, fits, gathered, partition_sum, remove, sent, ship
from ._words import mixed, shingles
from .components import components

BUCKETS = 1 << 17  # of each of the two rows of the sketch
BANDS, ROWS = 10, 3
SLOTS = 1 << 20
PARTNERS, GROWTH = 64, 64  # partners of a text in the first round over candidates, about; each later round takes so many times as many
BEFORE = 8  # shingles of a front that each one of it remembers
BLOCK = 2048  # shingles sampled at once: what stays in the processor's cache
SEED = 20240229
_tables: dict[int, tuple[np.ndarray, ...]] = {}


def _draws(bits: int = 12) -> tuple[np.ndarray, ...]:
    """Tables of the sampler's variates: 1/r and r of r ~ Gamma(2, 1), ln c of c ~ Gamma(2, 1), beta ~ U(0, 1). A shingle
    takes its row of each by other bits of its hash."""
    if bits not in _tables:
        rng, shape = np.random.default_rng(SEED), (1 << bits, BANDS * ROWS)
        r = rng.gamma(2, 1, shape).astype(np.float32)
        _tables[bits] = (1 / r, r, np.log(rng.gamma(2, 1, shape)).astype(np.float32), rng.random(shape, dtype=np.float32))
    return _tables[bits]


def samples(h: np.ndarray, weight: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Samples of each document with shingles, as the bits of the least ln a: shingle and t decide them."""
    inverse, r, ln_c, beta = _draws()
    mask = np.uint64((1 << 12) - 1)
    counts = counts[counts > 0]
    doc = np.repeat(np.arange(len(counts)), counts)
    out = np.full((len(counts), BANDS * ROWS), np.inf, np.float32)
    ln_w = np.log(weight).astype(np.float32)[:, None]
    for at in range(0, len(h), BLOCK):
        s = slice(at, at + BLOCK)
        i, j, k = (((h[s] >> np.uint64(x)) & mask).astype(np.int64) for x in (3, 15, 27))
        b, t = beta[j], inverse[i]
        t *= ln_w[s]
        t += b
        np.floor(t, out=t)
        t -= b
        t += 1
        t *= r[i]
        ln_a = np.subtract(ln_c[k], t)
        first = np.flatnonzero(np.diff(doc[s], prepend=-1))
        own = doc[s][first]
        out[own] = np.minimum(out[own], np.minimum.reduceat(ln_a, first, axis=0))
    return out.view(np.uint32)


def keys(sample: np.ndarray) -> np.ndarray:
    """Band keys, as int64."""
    s = sample.astype(np.uint64).reshape(len(sample), BANDS, ROWS)
    with np.errstate(over="ignore"):
        band = np.arange(BANDS, dtype=np.uint64)[None, :].repeat(len(s), 0)
        for x in range(ROWS):
            band = mixed(band * np.uint64(0x9E3779B97F4A7C15) + s[:, :, x] + np.uint64(1))
    return band.view(np.int64)


def _buckets(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of 57-bit hashes the buckets in both rows."""
    return (h & np.uint64(BUCKETS - 1)).astype(np.int64), (h >> np.uint64(40)).astype(np.int64)


def idf_table(df: DataFrame, text: str, tempering: float, k: int) -> np.ndarray:
    """idf by row and bucket, from the document frequencies over all of df; a shingle's is the greater of its two."""

    def count(batches):
        total = np.zeros(2 * BUCKETS + 1)
        for b in by_size(batches, 0):
            h, _, counts, _ = shingles([t or "" for t in b.column(0).to_pylist()], k)
            for row, at in enumerate(_buckets(h)):
                total[row * BUCKETS : (row + 1) * BUCKETS] += np.bincount(at, minlength=BUCKETS)
            total[-1] += len(counts)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], names=["sum"])

    total = partition_sum(df.select(text).mapInArrow(count, "sum binary"), 2 * BUCKETS + 1)
    rows, n = total[:-1].reshape(2, BUCKETS), max(total[-1], 1.0)
    df_of = np.maximum(rows - np.median(rows, axis=1, keepdims=True), 1)
    return (1 + tempering * np.log1p(n / df_of) / np.log1p(n)).astype(np.float32)


def weights(idf: np.ndarray, h: np.ndarray, times: np.ndarray) -> np.ndarray:
    """tf * idf of shingles."""
    a, b = _buckets(h)
    return times * np.maximum(idf[0][a], idf[1][b])


def signatures(df: DataFrame, idf: np.ndarray, id_col: str, text: str, k: int) -> DataFrame:
    """(id, digest, keys) of each row; texts without words have no keys."""
    shared = df.sparkSession.sparkContext.broadcast(idf)

    def run(batches):
        table = shared.value
        for b in by_size(batches, 1):
            h, times, counts, digests = shingles([t or "" for t in b.column(1).to_pylist()], k)
            own = keys(samples(h, weights(table, h, times), counts))
            ends = np.append(0, np.cumsum((counts > 0) * own.shape[1])).astype(np.int32)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(digests, pa.binary()), pa.ListArray.from_arrays(pa.array(ends), pa.array(own.ravel()))], names=["id", "digest", "keys"])

    return df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text")).mapInArrow(run, "id long, digest binary, keys array<long>")


def weighted_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Of two sorted hash arrays with weights: sum of the lesser over sum of the greater weights."""
    if not len(a[0]) or not len(b[0]):
        return float(len(a[0]) == len(b[0]))
    at = np.minimum(np.searchsorted(a[0], b[0]), len(a[0]) - 1)
    same = a[0][at] == b[0]
    common = np.minimum(a[1][at[same]], b[1][same]).sum(dtype=np.float64)
    return float(common / (a[1].sum(dtype=np.float64) + b[1].sum(dtype=np.float64) - common))


def _slot(id_col: str):
    return F.pmod(F.xxhash64(id_col), F.lit(SLOTS))


def _texts(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """docs joined with wanted on the id. Texts of ids that it doesn't name mostly stay where they are: a broadcast set
    of at most 2^20 hash slots."""
    slots = wanted.select(_slot("id").alias("slot")).distinct()
    return docs.withColumn("slot", _slot("id")).join(F.broadcast(slots), "slot", "left_semi").drop("slot").join(wanted.hint("merge"), "id")


def verified(docs: DataFrame, pairs: DataFrame, idf: np.ndarray, threshold: float, k: int) -> DataFrame:
    """pairs (leader, member; a table of `cut`, deleted afterwards) with their similarity, of docs (id, text)."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    hot = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n")).filter("n >= 256")
    n = F.coalesce("n", F.lit(0))
    dealt = pairs.join(sent(hot, fits(pairs, 256)), "leader", "left").select("leader", "member", F.pmod(F.xxhash64("member"), F.floor(n / 256) + 1).alias("salt"))
    wanted = dealt.select(F.col("member").alias("id"), "leader", "salt", F.lit(1).alias("kind")).unionByName(dealt.select(F.col("leader").alias("id"), "leader", "salt", F.lit(0).alias("kind")).distinct())
    wanted = cut(wanted, fits(pairs))
    rows = _texts(docs, wanted).repartition("leader", "salt")
    rows = (gathered(rows, 4) if fits(wanted) else rows).sortWithinPartitions("leader", "salt", "kind", "id")

    def made(out):
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.float64()), strict=True)], names=["leader", "member", "similarity"])

    def run(batches):
        table, now, lead, last = shared.value, None, [], None  # last: a pair that may go on, of an id that repeats
        for b in by_size(batches, "text"):
            h, times, counts, _ = shingles([t or "" for t in b.column("text").to_pylist()], k)
            w = weights(table, h, times)
            ends = np.cumsum(counts)
            out = []
            for i, (leader, salt, kind, member) in enumerate(zip(*(b.column(c).to_pylist() for c in ("leader", "salt", "kind", "id")), strict=True)):
                own = h[ends[i] - counts[i] : ends[i]], w[ends[i] - counts[i] : ends[i]]
                if (leader, salt) != now:
                    now, lead = (leader, salt), []
                if kind == 0:
                    lead.append(own)
                else:
                    similarity = max((weighted_jaccard(x, own) for x in lead), default=0.0)
                    if last and last[:2] == (leader, member):
                        similarity = max(similarity, last[2])
                    elif last:
                        out.append(last)
                    last = (leader, member, similarity)
            if out:
                yield made(out)
        if last:
            yield made([last])

    out = cut(rows.select("leader", "salt", "kind", "id", "text").mapInArrow(run, "leader long, member long, similarity double").withColumn("linked", F.col("similarity") >= threshold))
    remove(wanted)
    remove(pairs)
    return out


def _spanning(met: DataFrame, done: DataFrame, roots: DataFrame, reach: float) -> DataFrame:
    """(id, root) of the members that may have links across components under one of their keys. met: (key, leader, id).
    The distance d of each member to its key's leader is known, and weighted Jaccard distance is a metric: a member of
    the leader's component whose d is below that of all strangers by more than reach links to none of them, and leaves."""
    near = done.select("leader", F.col("member").alias("id"), (1 - F.col("similarity")).alias("d"))
    few = fits(roots)
    home = roots.select(F.col("id").alias("leader"), F.col("root").alias("home"))
    rooted = met.join(sent(near, fits(done)), ["leader", "id"], "left").join(sent(roots, few), "id", "left").join(sent(home, few), "leader", "left")
    rooted = rooted.select("key", "id", F.coalesce("root", "id").alias("root"), F.coalesce("home", "leader").alias("home"), F.coalesce("d", F.lit(0.0)).alias("d"))
    edges = rooted.filter("root <> home").groupBy("key").agg(F.min("d").alias("edge"))
    open_ = rooted.join(edges, "key").filter((F.col("root") != F.col("home")) | (F.col("d") >= F.col("edge") - reach - 1e-6)).select("key", "id", "root")
    several = open_.groupBy("key").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).filter("lo <> hi").select("key")
    return open_.join(several, "key", "left_semi").select("id", "root").distinct()


def prefixes(docs: DataFrame, wanted: DataFrame, idf: np.ndarray, threshold: float, k: int) -> DataFrame:
    """(id, root, total, shingle, rest, short, before) of the texts of wanted (id, root): the shingles in whose front a
    common one of any pair at the threshold lies. total: the text's weight; rest: what the shingle and those after it
    weigh; short: it also lies within the front that a lighter text of a pair needs; before: the BEFORE shingles before
    it, so that a pair is mostly met at its first common shingle alone."""
    shared = docs.sparkSession.sparkContext.broadcast(idf)
    long, short = 1 - threshold + 1e-6, (1 - threshold) / (1 + threshold) + 1e-6

    def run(batches):
        table = shared.value
        for b in by_size(batches, "text"):
            h, times, counts, _ = shingles([t or "" for t in b.column("text").to_pylist()], k)
            rarity = weights(table, h, np.ones(len(h)))
            order = np.lexsort((h, -rarity, np.repeat(np.arange(len(counts)), counts)))
            w, h, out = (times * rarity)[order].astype(np.float64), h[order].view(np.int64), []
            ends = np.cumsum(counts)
            for i, (id_, root) in enumerate(zip(b.column("id").to_pylist(), b.column("root").to_pylist(), strict=True)):
                own = w[ends[i] - counts[i] : ends[i]]
                before = np.cumsum(own) - own
                total = own.sum()
                n = int(np.searchsorted(before, long * total, "right"))
                out.append((np.full(n, id_), np.full(n, root), np.full(n, total), h[ends[i] - counts[i] :][:n], total - before[:n], before[:n] <= short * total, np.minimum(np.arange(n), BEFORE)))
            columns = [np.concatenate(c) for c in zip(*out, strict=True)]
            shingle, sizes = columns[3], columns.pop()
            to = np.cumsum(sizes)
            place = np.repeat(np.arange(len(sizes)) - sizes, sizes) + np.arange(int(sizes.sum())) - np.repeat(to - sizes, sizes)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, to).astype(np.int32)), pa.array(shingle[place]))
            yield pa.RecordBatch.from_arrays([*map(pa.array, columns), lists], names=["id", "root", "total", "shingle", "rest", "short", "before"])

    rows = _texts(docs, wanted).select("id", "root", "text")
    return (gathered(rows, 4) if fits(wanted) else rows).mapInArrow(run, "id long, root long, total double, shingle long, rest double, short boolean, before array<long>")


def _candidates(fronts: DataFrame, threshold: float) -> DataFrame:
    """(leader, member) of all pairs across components that may reach the threshold, of `prefixes`; the leader is the
    lighter one. A shingle before which both have a common one isn't their first, so it is passed over."""
    names = ("id", "root", "total", "rest", "before")
    a = fronts.filter("short").select("shingle", *[F.col(c).alias(f"a_{c}") for c in names])
    b = fronts.select("shingle", *[F.col(c).alias(f"b_{c}") for c in names])
    lighter = (F.col("a_total") < F.col("b_total")) | ((F.col("a_total") == F.col("b_total")) & (F.col("a_id") < F.col("b_id")))
    both = F.col("a_total") + F.col("b_total")
    reaches = F.least("a_rest", "b_rest") >= both * F.lit(threshold / (1 + threshold) - 1e-6)
    pairs = a.join(b.hint("merge"), (a["shingle"] == b["shingle"]) & (F.col("a_root") != F.col("b_root")) & lighter & reaches & ~F.arrays_overlap("a_before", "b_before"))
    return pairs.select(F.col("a_id").alias("leader"), F.col("b_id").alias("member")).distinct()


def _turns(pairs: DataFrame) -> DataFrame:
    """pairs (leader, member) with a turn, uniform by hash below the number of the leader's pairs."""
    sizes = pairs.groupBy("leader").agg(F.count(F.lit(1)).alias("n"))
    uniform = F.shiftrightunsigned(F.xxhash64("member", "leader"), 11) / float(1 << 53)
    return pairs.join(sizes, "leader").select("leader", "member", (uniform * F.col("n")).alias("turn"))


def _apart(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """pairs (leader, member, turn) that lie in different components."""
    ends = [sent(roots.select(F.col("id").alias(end), F.col("root").alias(at)), fits(roots)) for end, at in (("leader", "a"), ("member", "b"))]
    return pairs.join(ends[0], "leader", "left").join(ends[1], "member", "left").filter(F.coalesce("a", "leader") != F.coalesce("b", "member")).select("leader", "member", "turn")


def _new(pairs: DataFrame, done: DataFrame) -> DataFrame:
    """pairs (leader, member) that aren't verified yet, each once."""
    ordered = [F.least("leader", "member").alias("a"), F.greatest("leader", "member").alias("b")]
    return pairs.select("leader", "member", *ordered).dropDuplicates(["a", "b"]).join(done.select(*ordered), ["a", "b"], "left_anti").select("leader", "member")


def _roots(links: DataFrame, few: bool = False) -> DataFrame:
    return components(links.select(F.col("leader").alias("a"), F.col("member").alias("b")), few=few)


def _joined(roots: DataFrame, links: DataFrame, few: bool = False) -> DataFrame:
    """roots with links added: only the components that these tie are computed anew. few: roots and the ends of links
    may be broadcast."""
    named = links.select(F.col("leader").alias("id")).unionByName(links.select(F.col("member").alias("id"))).distinct()
    held = roots.unionByName(named.join(sent(roots, few), "id", "left_anti").select("id", F.col("id").alias("root")))
    ends = [sent(held.select(F.col("id").alias(end), F.col("root").alias(at)), few) for end, at in (("leader", "a"), ("member", "b"))]
    tied = components(links.join(ends[0], "leader").join(ends[1], "member").select("a", "b"), few=few)
    out = cut(held.join(sent(tied.select(F.col("id").alias("root"), F.col("root").alias("new")), fits(tied)), "root", "left").select("id", F.coalesce("new", "root").alias("root")), few)
    remove(tied)
    return out


def near_duplicates(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, k: int = 5, tempering: float = 0.25) -> DataFrame:
    """One row for each row of df: id, class_id (the least id of its class), n_links (verified links to other texts that
    were found for its word sequence's representative), kept (id = class_id)."""
    ship(df.sparkSession)
    idf = idf_table(df, text, tempering, k)
    signed = cut(signatures(df, idf, id_col, text, k))
    reps = cut(signed.filter("id is not null").groupBy("digest").agg(F.min("id").alias("id"), F.first("keys").alias("keys")))
    docs = df.select(F.col(id_col).cast("long").alias("id"), F.col(text).alias("text"))
    members = reps.select("id", F.explode("keys").alias("key"))
    leaders = members.groupBy("key").agg(F.min("id").alias("leader"), F.max("id").alias("last")).filter("last > leader").drop("last")
    met = cut(members.join(leaders, "key").select("key", "leader", "id"))
    done = verified(docs, cut(met.filter("id > leader").select("leader", F.col("id").alias("member")).distinct()), idf, threshold, k)
    roots = _roots(done.filter("linked"), fits(done))
    tables = [done]
    wanted = cut(_spanning(met, done, roots, 1 - threshold))
    remove(met)
    fronts = cut(prefixes(docs, wanted, idf, threshold, k))
    open_ = cut(_turns(_new(_candidates(fronts, threshold), done)))
    remove(wanted)
    remove(fronts)
    partners = PARTNERS
    while not open_.isEmpty():
        new = verified(docs, cut(open_.filter(F.col("turn") < partners).select("leader", "member"), fits(open_)), idf, threshold, k)
        tables.append(new)
        done = done.unionByName(new)
        last, roots = roots, _joined(roots, new.filter("linked"), fits(roots) and fits(new))
        remove(last)
        last, open_ = open_, cut(_apart(open_.filter(F.col("turn") >= partners), roots), fits(open_))
        remove(last)
        partners *= GROWTH
    remove(open_)
    links = done.filter("linked")
    degree = links.select(F.col("leader").alias("id")).unionByName(links.select(F.col("member").alias("id"))).groupBy("id").agg(F.count(F.lit(1)).alias("n_links"))
    classes = cut(reps.select("digest", "id").join(sent(roots, fits(roots)), "id", "left").join(degree, "id", "left").select("digest", F.coalesce("root", "id").alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links")))
    for used in (*tables, roots, reps):
        remove(used)
    return signed.select("id", "digest").join(classes, "digest", "left").select(F.col("id").alias(id_col), "class_id", "n_links", F.coalesce(F.col("id") == F.col("class_id"), F.lit(False)).alias("kept"))


def distinct_documents(df: DataFrame, id_col: str = "doc_id", text: str = "text", threshold: float = 0.8, k: int = 5) -> DataFrame:
    """df with one document of each class, the smallest id; columns unchanged. Only dropped ids are joined back, and
    rows with null ids stay."""
    name = "_dropped"
    while name in df.columns:
        name += "_"
    dropped = near_duplicates(df, id_col, text, threshold, k).filter(F.col(id_col).isNotNull() & ~F.col("kept")).select(F.col(id_col).alias(name)).distinct()
    return df.join(dropped, F.col(id_col) == F.col(name), "left_anti")
