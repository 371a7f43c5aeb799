"""URL filter, DataFrame functions only: host and path rules, and gradient-boosted trees for what no rule decides.

Rules (host, path, verdict) fit a host and its subdomains where the path begins with theirs; the longest wins. URLs
that a rule decides are the labelled ones: boosted trees of depth 2 learn from all of them, on lexical features
(length, depth, digit ratio, entropy, parameter counts and more) and the last host label's statistics. Labels of both
kinds weigh the same in total, whichever the rules give more of, since the verdict is for the URLs that they are silent
on. Features are cut into at most 16 bins by approximate quantiles over all rows; labelled rows are
pre-aggregated to their distinct bin vectors; each tree level is one aggregation of gradients by (node, feature, bin), a
histogram of fixed size, and the trees become one expression.

Suffix statistics cover every last label, in 4,096 hash buckets (a table of fixed size); labels that share a bucket share
its rate.

Defined cases: a null url or one without :// has an empty host and path, and is judged like any other; repeated rows
are judged each; without labels the verdict is allow, with labels of one kind it is that kind; an empty table gives an
empty result; other columns are not read.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._spark import cut

#: (host, path, verdict); fixed values of the contract
RULES = (
    ("com", "/en/", "block"),
    ("example.com", "/en/7", "allow"),
    ("net", "/de/", "allow"),
    ("example.net", "/de/8", "block"),
    ("org", "/es/", "block"),
)
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BINS, SUFFIXES = 16, 4096
FEATURES = ("url_length", "host_length", "path_length", "depth", "labels", "digit_ratio", "entropy", "parameters", "query_length", "punctuation", "secure", "fragment", "suffix_rate", "suffix_seen")


def with_parts(df: DataFrame, url: str = "url") -> DataFrame:
    """df with host and path."""
    at = F.instr(F.col(url), "://")
    rest = F.when(at > 0, F.substring(F.col(url), at + 3, F.length(url)))
    host = F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)
    path = F.regexp_extract(F.substring(rest, F.length(F.regexp_extract(rest, r"^[^/?#]*", 0)) + 1, F.length(rest)), r"^[^?#]*", 0)
    return df.withColumns({"host": F.coalesce(host, F.lit("")), "path": F.coalesce(path, F.lit(""))})


def rule_columns(rules=RULES) -> tuple[Column, Column]:
    """(rule, its verdict) of host and path; null where none fits."""
    ordered = sorted(rules, key=lambda r: (-len(r[0] + r[1]), r[0] + r[1]))

    def chain(value):
        fits = [((F.col("host") == h) | F.endswith(F.col("host"), F.lit(f".{h}"))) & F.startswith(F.col("path"), F.lit(p)) for h, p, _ in ordered]
        return reduce(lambda done, x: done.when(x[0], F.lit(value(x[1]))), list(zip(fits, ordered, strict=True))[1:], F.when(fits[0], F.lit(value(ordered[0])))) if ordered else F.lit(None).cast("string")

    return chain(lambda r: r[0] + r[1]), chain(lambda r: r[2])


def _entropy(text: Column) -> Column:
    """Bits a character."""
    n = F.length(text).cast("double")
    shares = F.transform(F.array_distinct(F.split(text, "")), lambda c: (n - F.length(F.replace(text, c, F.lit("")))) / n)
    return F.when(n > 0, F.aggregate(F.filter(shares, lambda p: p > 0), F.lit(0.0), lambda a, p: a - p * F.log2(p))).otherwise(0.0)


def lexical(df: DataFrame, url: str = "url") -> DataFrame:
    """df (with host and path) with the numeric features but the suffix's, and the bucket of its last host label."""
    u = F.coalesce(F.col(url), F.lit(""))
    n = F.length(u).cast("double")

    def without(c: Column, chars: str) -> Column:
        return (F.length(c) - F.length(F.translate(c, chars, ""))).cast("double")

    query = F.regexp_extract(u, r"\?([^#]*)", 1)
    return df.withColumns(
        {
            "url_length": n,
            "host_length": F.length("host").cast("double"),
            "path_length": F.length("path").cast("double"),
            "depth": without(F.col("path"), "/"),
            "labels": without(F.col("host"), ".") + 1,
            "digit_ratio": F.when(n > 0, without(u, "0123456789") / n).otherwise(0.0),
            "entropy": _entropy(u),
            "parameters": F.when(F.length(query) > 0, without(query, "&") + 1).otherwise(0.0),
            "query_length": F.length(query).cast("double"),
            "punctuation": without(u, "-_.~%+=&"),
            "secure": F.startswith(F.lower(u), F.lit("https:")).cast("double"),
            "fragment": F.contains(u, F.lit("#")).cast("double"),
            "suffix": F.pmod(F.xxhash64(F.substring_index(F.substring_index("host", ":", 1), ".", -1)), F.lit(SUFFIXES)),
        }
    )


def suffix_statistics(labelled: DataFrame) -> tuple[DataFrame, float]:
    """(suffix, suffix_rate, suffix_seen) from rows (suffix, y), and the overall rate, to which rates are drawn by ten
    rows."""
    by = labelled.groupBy("suffix").agg(F.sum("y").alias("good"), F.count(F.lit(1)).alias("n"))
    overall = by.agg((F.sum("good") / F.sum("n")).alias("rate")).first()[0] or 0.0
    return by.select("suffix", ((F.col("good") + 10 * overall) / (F.col("n") + 10)).alias("suffix_rate"), F.log1p("n").alias("suffix_seen")), overall


def _binned(cuts: dict[str, list[float]]) -> dict[str, Column]:
    """Number of cut points below each feature."""
    return {f"b{i}": (reduce(lambda a, c: a + (F.col(name) > c).cast("int"), cuts[name], F.lit(0))) for i, name in enumerate(FEATURES)}


def _leaf(tree, bins) -> Column:
    """tree: a value, or (feature, bin, left, right); rows with bin <= the tree's go left."""
    if not isinstance(tree, tuple):
        return F.lit(float(tree))
    i, b, left, right = tree
    return F.when(F.col(bins[i]) <= b, _leaf(left, bins)).otherwise(_leaf(right, bins))


def _best(hist: dict, reg: float):
    """Of {(feature, bin): (g, h)} of one node the best split, and the node's value without one."""
    by: dict[int, dict[int, tuple[float, float]]] = {}
    for (i, b), gh in hist.items():
        by.setdefault(i, {})[b] = gh
    found, some = (0.0, None), next(iter(by.values()), {})
    g, h = sum(x[0] for x in some.values()), sum(x[1] for x in some.values())
    for i in sorted(by):
        gl = hl = 0.0
        for b in sorted(by[i])[:-1]:
            gl, hl = gl + by[i][b][0], hl + by[i][b][1]
            if min(hl, h - hl) < 1e-3:
                continue
            gain = gl * gl / (hl + reg) + (g - gl) ** 2 / (h - hl + reg) - g * g / (h + reg)
            if gain > found[0] + 1e-9:
                found = (gain, (i, b, gl / (hl + reg), (g - gl) / (h - hl + reg)))
    return found[1], g / (h + reg)


def boost(train: DataFrame, trees: int, rate: float, reg: float, base: float) -> list:
    """Trees of depth 2 from rows (b0.., y, n): distinct bin vectors with block counts y of n."""
    names = [f"b{i}" for i in range(len(FEATURES))]
    made: list = []

    def histogram(node: Column) -> dict:
        margin = reduce(lambda a, t: a + _leaf(t, names), made, F.lit(base))
        p = 1 / (1 + F.exp(-margin))
        rows = train.select(node.alias("node"), (F.col("y") - F.col("n") * p).alias("g"), (F.col("n") * p * (1 - p)).alias("h"), F.posexplode(F.array(*names)).alias("feature", "bin"))
        out: dict = {}
        for r in rows.groupBy("node", "feature", "bin").agg(F.sum("g").alias("g"), F.sum("h").alias("h")).collect():
            out.setdefault(r["node"], {})[r["feature"], r["bin"]] = (r["g"], r["h"])
        return out

    for _ in range(trees):
        split, value = _best(histogram(F.lit(0)).get(0, {}), reg)
        if split is None:
            made.append(rate * value)
            break
        i, b, *_ = split
        sides = histogram(F.when(F.col(names[i]) <= b, F.lit(0)).otherwise(F.lit(1)))
        kids = []
        for side in (0, 1):
            s, v = _best(sides.get(side, {}), reg)
            kids.append(rate * v if s is None else (s[0], s[1], rate * s[2], rate * s[3]))
        made.append((i, b, *kids))
    return made


def judge(df: DataFrame, rules=RULES, id_col: str = "page_id", url: str = "url", trees: int = 8, rate: float = 0.5, reg: float = 1.0, learn: Column | None = None) -> DataFrame:
    """id, host, path, rule, verdict, score (the method's probability of block, for every row). learn: condition on `_id`
    that admits a URL's label to learning; all by default."""
    rule, verdict = rule_columns(rules)
    rows = lexical(with_parts(df.select(F.col(id_col).alias("_id"), F.col(url).alias("_url")), "_url"), "_url").withColumns({"rule": rule, "given": verdict})
    admitted = F.col("given").isNotNull() & (F.coalesce(learn, F.lit(False)) if learn is not None else F.lit(True))
    labelled = rows.filter(admitted).withColumn("y", (F.col("given") == "block").cast("double"))
    stats, overall = suffix_statistics(labelled)
    stats = cut(stats)
    full = rows.join(F.broadcast(stats), "suffix", "left").fillna({"suffix_rate": overall, "suffix_seen": 0.0})
    points = full.agg(*[F.percentile_approx(c, F.array(*[F.lit(i / BINS) for i in range(1, BINS)]), F.lit(1000)).alias(c) for c in FEATURES]).first()
    cuts = {c: sorted(set(points[c] or [])) for c in FEATURES}
    binned = full.withColumns(_binned(cuts))
    names = [f"b{i}" for i in range(len(FEATURES))]
    train = cut(binned.filter(admitted).groupBy(*names).agg(F.sum((F.col("given") == "block").cast("double")).alias("y"), F.count(F.lit(1)).cast("double").alias("n")))
    y, n = train.agg(F.coalesce(F.sum("y"), F.lit(0.0)), F.coalesce(F.sum("n"), F.lit(0.0))).first()
    if y in (0.0, n):
        margin = F.lit(20.0 if n and y else -20.0)
    else:
        blocks, allows = n / (2 * y), n / (2 * (n - y))
        weighed = train.select(*names, (F.col("y") * blocks).alias("y"), (F.col("y") * blocks + (F.col("n") - F.col("y")) * allows).alias("n"))
        margin = reduce(lambda a, t: a + _leaf(t, names), boost(weighed, trees, rate, reg, 0.0), F.lit(0.0))
    score = 1 / (1 + F.exp(-margin))
    return binned.select(F.col("_id").alias(id_col), "host", "path", "rule", F.coalesce("given", F.when(score > 0.5, "block").otherwise("allow")).alias("verdict"), score.alias("score"))
