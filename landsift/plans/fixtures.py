"""Listings derived from the order tables, as DataFrames and as the same SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TYPE_CASE = "case {k} % 4 when 0 then 'casa' when 1 then 'departamento' when 2 then 'terreno' else 'local' end"

LISTINGS_SQL = f"""listings as (
    select 'L' || lpad(cast(o_orderkey as varchar), 9, '0') as id, o_orderpriority as title, o_orderpriority || ' ' || c_mktsegment as description,
        cast(floor(o_totalprice) as bigint) as price_mxn, cast(20 + (o_orderkey * 7) % 180 as bigint) as m2, cast(o_orderkey % 6 as bigint) as bedrooms,
        {TYPE_CASE.format(k="o_orderkey")} as type, c_mktsegment as colonia, n_name as municipio, r_name as estado,
        cast(19.0 as double) + cast(o_custkey % 1000 as double) / 1000 as lat, cast(-99.0 as double) - cast(o_custkey % 777 as double) / 1000 as lng,
        strftime(o_orderdate, '%Y-%m-%d') as listed_date, o_orderstatus as source,
        case when o_orderkey % 17 = 3 then 'L000000000' end as dup_of
    from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
)"""

RELISTED_SQL = f"""numbers as (select greatest(1, count(*) // 3) as m from orders), relisted as (
    select 'R' || lpad(cast(o.o_orderkey as varchar), 9, '0') as id, b.o_orderpriority || ' ' || b.o_orderstatus || ' unit ' || cast(b.o_orderkey as varchar) as description,
        cast(19.0 as double) + cast(b.o_custkey % 1000 as double) / 1000 + cast(0.0004 as double) * cast(o.o_orderkey // m as double) as lat,
        cast(-99.0 as double) - cast(b.o_custkey % 777 as double) / 1000 as lng,
        cast(20 + (b.o_orderkey * 7) % 180 + (o.o_orderkey // m) % 3 as bigint) as m2,
        {TYPE_CASE.format(k="b.o_orderkey")} as type, b.o_orderstatus as municipio, strftime(o.o_orderdate, '%Y-%m-%d') as listed_date
    from orders o cross join numbers join orders b on b.o_orderkey = o.o_orderkey % m
)"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _type(key: str):
    return F.expr(TYPE_CASE.format(k=key))


def listings(spark: SparkSession, sf_dir: str) -> DataFrame:
    o, c, n, r = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation", "region"))
    rows = o.join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    key = F.col("o_orderkey")
    return rows.select(
        F.concat(F.lit("L"), F.lpad(key.cast("string"), 9, "0")).alias("id"),
        F.col("o_orderpriority").alias("title"),
        F.concat_ws(" ", "o_orderpriority", "c_mktsegment").alias("description"),
        F.floor("o_totalprice").cast("long").alias("price_mxn"),
        (20 + (key * 7) % 180).cast("long").alias("m2"),
        (key % 6).cast("long").alias("bedrooms"),
        _type("o_orderkey").alias("type"),
        F.col("c_mktsegment").alias("colonia"),
        F.col("n_name").alias("municipio"),
        F.col("r_name").alias("estado"),
        (F.lit(19.0) + (F.col("o_custkey") % 1000).cast("double") / 1000).alias("lat"),
        (F.lit(-99.0) - (F.col("o_custkey") % 777).cast("double") / 1000).alias("lng"),
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("listed_date"),
        F.col("o_orderstatus").alias("source"),
        F.when(key % 17 == 3, F.lit("L000000000")).alias("dup_of"),
    )


def relisted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each base order three times, moved a little."""
    orders = table(spark, sf_dir, "orders")
    m = max(1, orders.count() // 3)
    o, b = orders.alias("o"), orders.alias("b")
    step = F.floor(F.col("o.o_orderkey") / m)
    return o.join(b, F.col("b.o_orderkey") == F.col("o.o_orderkey") % m).select(
        F.concat(F.lit("R"), F.lpad(F.col("o.o_orderkey").cast("string"), 9, "0")).alias("id"),
        F.concat(F.col("b.o_orderpriority"), F.lit(" "), F.col("b.o_orderstatus"), F.lit(" unit "), F.col("b.o_orderkey").cast("string")).alias("description"),
        (F.lit(19.0) + (F.col("b.o_custkey") % 1000).cast("double") / 1000 + F.lit(0.0004) * step.cast("double")).alias("lat"),
        (F.lit(-99.0) - (F.col("b.o_custkey") % 777).cast("double") / 1000).alias("lng"),
        (20 + (F.col("b.o_orderkey") * 7) % 180 + step % 3).cast("long").alias("m2"),
        _type("b.o_orderkey").alias("type"),
        F.col("b.o_orderstatus").alias("municipio"),
        F.date_format("o.o_orderdate", "yyyy-MM-dd").alias("listed_date"),
    )


RAW_SQL = """raw as (
    select 'P' || cast(l_orderkey as varchar) as id, ' ' || l_returnflag || ' ' as title, l_linestatus as description,
        case l_partkey % 7 when 0 then 'N/D' when 1 then ' $' || cast(cast(floor(l_extendedprice) as bigint) as varchar) || ' ' when 2 then '' else cast(cast(floor(l_extendedprice) as bigint) as varchar) || '.5' end as price_mxn,
        case l_suppkey % 9 when 0 then '-1' when 1 then 'x' else cast(1 + l_partkey % 300 as varchar) end as m2,
        case l_partkey % 5 when 0 then '' when 1 then '-2' else '3' end as bedrooms,
        case l_suppkey % 6 when 0 then 'CASA' when 1 then ' Terreno ' when 2 then 'oficina' else 'local' end as type,
        case l_partkey % 11 when 0 then ' ' else 'C' end as colonia, 'M' as municipio, 'E' as estado,
        case l_partkey % 13 when 0 then '200' when 1 then '1e1d' else '19.5' end as lat, '-99.25' as lng,
        case l_partkey % 8 when 0 then '2024-02-30' when 1 then '05/01/2024' else strftime(l_shipdate, '%Y-%m-%d') end as listed_date,
        l_returnflag as source,
        cast(l_orderkey as varchar) || '-' || lpad(cast(l_linenumber as varchar), 2, '0') || '-' || lpad(cast(l_partkey as varchar), 9, '0') || '-' || lpad(cast(l_suppkey as varchar), 9, '0') || '-' || cast(l_quantity as varchar) as place
    from lineitem
)"""


def raw(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Messy strings with faults of every kind, from line items; `place` orders the rows of an id."""
    sql = RAW_SQL.removeprefix("raw as (").rstrip().removesuffix(")").replace("strftime(l_shipdate, '%Y-%m-%d')", "date_format(l_shipdate, 'yyyy-MM-dd')").replace(" as varchar)", " as string)")
    return spark.sql(sql.replace("from lineitem", "from {lineitem}"), lineitem=table(spark, sf_dir, "lineitem"))


#: Inline polygons (ordinal, ageb_id, ring of lat lng): squares that overlap and share edges, a triangle, a slanted
#: ring, a degenerate one; our own fixture.
RINGS = (
    (0, "A1", ((19.0, -99.2), (19.0, -99.0), (19.2, -99.0), (19.2, -99.2))),
    (1, "A2", ((19.1, -99.3), (19.1, -99.1), (19.4, -99.1), (19.4, -99.3))),
    (2, "A3", ((19.4, -99.6), (19.4, -99.3), (19.7, -99.3))),
    (3, "A4", ((19.5, -99.75), (19.9, -99.5), (19.95, -99.7), (19.7, -99.77))),
    (4, "A5", ((19.0, -99.5), (19.5, -99.5))),
    (5, "A6", ((19.6, -99.3), (19.6, -99.0), (19.999, -99.0), (19.8, -99.15), (19.999, -99.3))),
)


def polygons(spark: SparkSession, towns: DataFrame | None = None) -> DataFrame:
    from ..sources.readers import boxed

    rings = F.array(*[F.struct(F.lit(o).cast("long").alias("ordinal"), F.lit(i).alias("ageb_id"), F.array(*[F.struct(F.lit(a).alias("lat"), F.lit(b).alias("lng")) for a, b in r]).alias("ring")) for o, i, r in RINGS])
    rows = spark.range(1).select(F.inline(rings))
    return boxed(rows)


EDGES_SQL = "edges(ordinal, ageb_id, alat, alng, blat, blng) as (values " + ", ".join(f"({o}, '{i}', cast({a[0]!r} as double), cast({a[1]!r} as double), cast({b[0]!r} as double), cast({b[1]!r} as double))" for o, i, r in RINGS if len(r) > 2 for a, b in zip(r, r[1:] + r[:1], strict=True)) + ")"


def diamonds(spark: SparkSession) -> DataFrame:
    """2,000 diamonds, 40 by 50, that overlap their neighbours: rings of four vertices around y, x."""
    from ..sources.readers import boxed

    y, x = (F.lit(19.0) + (F.col("id") % 40).cast("double") / 40), (F.lit(-99.8) + F.floor(F.col("id") / 40).cast("double") / 62.5)
    corner = lambda dy, dx: F.struct((y + dy).alias("lat"), (x + dx).alias("lng"))
    ring = F.array(corner(0.02, 0.0), corner(0.0, 0.0125), corner(-0.02, 0.0), corner(0.0, -0.0125))
    return boxed(spark.range(2000).select(F.col("id").alias("ordinal"), F.concat(F.lit("R"), F.col("id").cast("string")).alias("ageb_id"), ring.alias("ring")))


DIAMONDS_SQL = """centres as (select r as ordinal, cast(19.0 as double) + cast(r % 40 as double) / 40 as y, cast(-99.8 as double) + cast(r // 40 as double) / 62.5 as x from (select unnest(range(2000)) as r)),
    corners as (select ordinal, y, x, unnest([{'a': y + 0.02::double, 'b': x + 0.0::double, 'c': y + 0.0::double, 'd': x + 0.0125::double}, {'a': y + 0.0::double, 'b': x + 0.0125::double, 'c': y + -0.02::double, 'd': x + 0.0::double},
        {'a': y + -0.02::double, 'b': x + 0.0::double, 'c': y + 0.0::double, 'd': x + -0.0125::double}, {'a': y + 0.0::double, 'b': x + -0.0125::double, 'c': y + 0.02::double, 'd': x + 0.0::double}]) as e from centres)""".replace("corners as (", "listed as (", 1) + """,
    corners as (select ordinal, y, x, e.a as alat, e.b as alng, e.c as blat, e.d as blng from listed)"""
