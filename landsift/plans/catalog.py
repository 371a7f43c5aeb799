"""Registered queries over the order tables and documents, each with its SQL twin."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import geo, text
from ..operators import clean, dedupe, enrich, explore, stats
from ..schema import PRICE_LADDER, QUERY_COLUMNS
from ..sources import generate, readers, writers
from ..sources.store import cut, scratch, ship
from . import fixtures, quickfilter

_QUERIES: dict = {}
_SQL: dict[str, str] = {}
COLS = "id, title, description, price_mxn, m2, bedrooms, type, colonia, municipio, estado, lat, lng, listed_date, source"
LOWER_COLONIA = "translate(colonia, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"


def register(sql: str | None = None):
    def keep(f):
        _QUERIES[f.__name__] = f
        if sql:
            _SQL[f.__name__] = sql
        return f

    return keep


def queries() -> dict:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_SQL)


def _filtered(name: str, expr: str, where: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return explore.query(fixtures.listings(spark, sf_dir), expr, 0)

    run.__name__ = name
    register(f"with {fixtures.LISTINGS_SQL} select {COLS} from listings where {where}")(run)


_filtered("q_filter_and_or", "price<150000 and colonia:build or type=terreno", f"(price_mxn < 150000 and contains({LOWER_COLONIA}, 'build')) or type = 'terreno'")
_filtered("q_filter_parens", "price<150000 and (colonia:build or type=terreno)", f"price_mxn < 150000 and (contains({LOWER_COLONIA}, 'build') or type = 'terreno')")
_filtered("q_filter_contains", 'colonia:"UILD" and municipio:tion_1', "contains(lower(colonia), 'uild') and contains(lower(municipio), 'tion_1')")
_filtered("q_filter_escape", 'municipio:"%" or municipio:"N_2"', "contains(lower(municipio), 'n_2')")
_filtered("q_filter_dates", 'listed>="1996-01-01" and listed<"1997-01-01" and bedrooms>=3', "listed_date >= '1996-01-01' and listed_date < '1997-01-01' and bedrooms >= 3")
_filtered("q_filter_numbers", 'm2="1e2" or price>=400000 and bedrooms="0x5"', "m2 = 100 or (price_mxn >= 400000 and bedrooms = 5)")


@register(f"with {fixtures.LISTINGS_SQL} select id, price_mxn, listed_date from listings where m2 >= 80 order by listed_date desc, id limit 20")
def q_query_topk(spark, sf_dir):
    return explore.query(fixtures.listings(spark, sf_dir), "m2>=80", None, "id, price_mxn, id, listed_date")


@register(f"with {fixtures.LISTINGS_SQL} select id, title, price_mxn, m2, bedrooms, type, colonia, municipio, estado, lat, lng, listed_date from listings where dup_of is null order by listed_date desc, id limit 5000")
def q_web_slice(spark, sf_dir):
    return explore.web_slice(fixtures.listings(spark, sf_dir))


@register(f"with {fixtures.LISTINGS_SQL} select count(*) as count, min(price_mxn) as price_min, round(avg(price_mxn), 4) as price_avg, max(price_mxn) as price_max, round(avg(m2), 4) as m2_avg, round(avg(cast(price_mxn as double) / nullif(m2, 0)), 4) as price_per_m2_avg from listings where type <> 'local' and type >= 'casa'")
def q_stats_overall(spark, sf_dir):
    out = stats.overall(fixtures.listings(spark, sf_dir).filter("type <> 'local'"), "type>=casa")
    return out.select("count", "price_min", F.round("price_avg", 4).alias("price_avg"), "price_max", F.round("m2_avg", 4).alias("m2_avg"), F.round("price_per_m2_avg", 4).alias("price_per_m2_avg"))


@register(f"""with {fixtures.LISTINGS_SQL} select municipio as "group", count(*) as count, round(avg(price_mxn), 4) as price_avg, round(avg(cast(price_mxn as double) / nullif(m2, 0)), 4) as price_per_m2_avg from listings where bedrooms > 1 group by municipio order by count(*) desc, municipio limit 15""")
def q_stats_by(spark, sf_dir):
    out = stats.by_field(fixtures.listings(spark, sf_dir), "Municipio", "bedrooms>1")
    return out.select("group", "count", F.round("price_avg", 4).alias("price_avg"), F.round("price_per_m2_avg", 4).alias("price_per_m2_avg"))


@register(f"with {fixtures.LISTINGS_SQL} select colonia, municipio, count(*) as count, round(median(cast(price_mxn as double) / m2) filter (where m2 > 0), 2) as median_price_per_m2 from listings where dup_of is null group by colonia, municipio")
def q_colonia_median(spark, sf_dir):
    return stats.colonia_medians(fixtures.listings(spark, sf_dir))


_LADDER = ", ".join(f"({i}, {b})" for i, b in enumerate((*PRICE_LADDER, "null")))


@register(f"""with {fixtures.LISTINGS_SQL}, ladder(bucket, bucket_max) as (values {_LADDER}), steps as (select bucket, cast(bucket_max as bigint) as bucket_max, coalesce(lag(bucket_max) over (order by bucket), 0) as low from ladder)
    select cast(bucket as integer) as bucket, bucket_max, count(price_mxn) as count from steps left join (select price_mxn from listings where dup_of is null) on price_mxn > low and (bucket_max is null or price_mxn <= bucket_max) group by bucket, bucket_max""")
def q_hist_fixed(spark, sf_dir):
    return stats.price_ladder(fixtures.listings(spark, sf_dir))


@register(f"""with {fixtures.LISTINGS_SQL}, ends as (select min(price_mxn)::double as lo, max(price_mxn)::double as hi from listings), bins as (select unnest(range(10)) as bin),
    hit as (select least(9, floor((price_mxn - lo) / ((hi - lo) / 10))) as bin, count(*) as n from listings cross join ends group by 1)
    select cast(b.bin as integer) as bin, round(lo + b.bin * ((hi - lo) / 10), 4) as low, round(case when b.bin = 9 then hi else lo + (b.bin + 1) * ((hi - lo) / 10) end, 4) as high, coalesce(n, 0) as count from bins b cross join ends left join hit on hit.bin = b.bin""")
def q_hist_equal(spark, sf_dir):
    return stats.equal_width(fixtures.listings(spark, sf_dir)).withColumns({"low": F.round("low", 4), "high": F.round("high", 4)})


@register(f"""with {fixtures.LISTINGS_SQL}, named as (select id, m2, price_mxn, municipio, colonia || ' ' || cast(bedrooms as varchar) || ' ' || left(title, 1) as colonia from listings where m2 > 0),
    towns as (select colonia, municipio, count(*) as n, min(id) as first from named group by colonia, municipio),
    mode as (select colonia, municipio, row_number() over (partition by colonia order by n desc, first) as rn, min(first) over (partition by colonia) as seen from towns)
    select l.colonia, m.municipio, count(*) as count, round(median(cast(price_mxn as double) / m2), 4) as median_price_per_m2 from named l join mode m on m.colonia = l.colonia and rn = 1
    group by l.colonia, m.municipio, seen order by median(cast(price_mxn as double) / m2) desc, seen limit 20""")
def q_colonia_ranking(spark, sf_dir):
    """The 20 dearest of 150 neighbourhoods."""
    rows = fixtures.listings(spark, sf_dir).withColumn("colonia", F.concat_ws(" ", "colonia", F.col("bedrooms").cast("string"), F.substring("title", 1, 1)))
    return stats.colonia_ranking(rows).withColumn("median_price_per_m2", F.round("median_price_per_m2", 4))


_JUDGED = f"""{fixtures.RAW_SQL}, typed as (
    select *, case l when 'x' then null else l end as _, try_cast(replace(replace(trim(price_mxn), '$', ''), ',', '') as double) as p, try_cast(m2 as double) as a,
        case when trim(bedrooms) = '' then 0 else try_cast(bedrooms as double) end as b, lower(trim(type)) as t,
        case when regexp_full_match(lat, '[+-]?[0-9.]+') then try_cast(lat as double) end as y, try_cast(lng as double) as x from (select *, '' as l from raw)
), judged as (
    select *, case when trim(id) = '' then 'missing_id' when p is null or round_even(p, 0) <= 0 then 'bad_price' when a is null or a <= 0 then 'bad_m2' when b is null or b < 0 then 'bad_bedrooms'
        when t not in ('casa', 'departamento', 'terreno', 'local') then 'bad_type' when trim(colonia) = '' then 'missing_location'
        when y is null or x is null or not (y between 14 and 33 and x between -118.5 and -86) then 'bad_coords'
        when try_strptime(listed_date, '%Y-%m-%d') is null then 'bad_date' end as reason from typed
), placed as (select *, row_number() over (partition by id, reason is null order by place) as rn from judged),
final as (select *, case when reason is null and rn > 1 then 'duplicate_id' else reason end as verdict from placed)"""


def _judged(spark, sf_dir):
    return clean.first_of_id(clean.cleaned(fixtures.raw(spark, sf_dir)), "place")


@register(f"with {_JUDGED} select coalesce(verdict, 'kept') as reason, count(*) as n from final group by 1")
def q_clean_reasons(spark, sf_dir):
    return clean.drop_statistics(_judged(spark, sf_dir))


@register(f"with {_JUDGED} select id, trim(title) as title, cast(round_even(p, 0) as bigint) as price_mxn, cast(a as bigint) as m2, cast(b as bigint) as bedrooms, t as type, y as lat, x as lng, listed_date from final where verdict is null")
def q_clean_rows(spark, sf_dir):
    return clean.kept(_judged(spark, sf_dir)).select("id", "title", "price_mxn", "m2", "bedrooms", "type", "lat", "lng", "listed_date")


def _hashes_sql(source: str, key: str, column: str) -> str:
    """Fingerprints of source.column by key, as CTE `hashed(key, simhash)`."""
    return f"""tokens as (select {key} as k, unnest(regexp_extract_all(translate(coalesce({column}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-z0-9\\x{{80}}-\\x{{10FFFF}}]+')) as token from {source}),
    words as (select token, hex(encode(token)) as h from (select distinct token from tokens)),
    fnv as (select token, list_reduce(list_prepend(14695981039346656037::uhugeint, list_transform(range(length(h) // 2), lambda i: ('0x' || substr(h, i * 2 + 1, 2))::uhugeint)), lambda a, x: (xor(a, x) * 1099511628211::uhugeint) % 18446744073709551616::uhugeint) as f from words),
    votes as (select k, bit, sum(case when (f // (1::uhugeint << bit)) % 2 = 1 then n else -n end) as v from (select k, f, count(*) as n from tokens join fnv using (token) group by k, f) cross join (select unnest(range(64))::uhugeint as bit) group by k, bit),
    sums as (select k, sum(case when v > 0 then cast(1::uhugeint << bit as hugeint) else 0::hugeint end) as u from votes group by k),
    hashed as (select s.{key} as k, cast(case when coalesce(u, 0) >= 9223372036854775808 then coalesce(u, 0) - 18446744073709551616 else coalesce(u, 0) end as bigint) as simhash from {source} s left join sums on sums.k = s.{key})"""


@register(f"with {_hashes_sql('documents', 'doc_id', 'text')} select k as doc_id, simhash from hashed")
def q_simhash_docs(spark, sf_dir):
    ship(spark)
    return fixtures.table(spark, sf_dir, "documents").select("doc_id", text.simhash64("text").alias("simhash"))


@register("select user_id, event_id, bit_count(xor(user_id, event_id)) as bits from events")
def q_hamming(spark, sf_dir):
    return fixtures.table(spark, sf_dir, "events").select("user_id", "event_id", text.hamming(F.col("user_id"), F.col("event_id")).cast("tinyint").alias("bits"))


_NEAR = f"""{fixtures.RELISTED_SQL}, {_hashes_sql("relisted", "id", "description")},
    cells as (select r.*, simhash, lat % 0.01 as m1, case when lng % 0.01 < 0 then (lng % 0.01 + 0.01) % 0.01 else lng % 0.01 end as m2_ from relisted r join hashed on k = id),
    divided as (select *, (lat - m1) / 0.01 as d1, (lng - m2_) / 0.01 as d2 from cells),
    placed as (select *, cast(floor(d1) + (case when d1 - floor(d1) > 0.5 then 1 else 0 end) as bigint) as x, cast(floor(d2) + (case when d2 - floor(d2) > 0.5 then 1 else 0 end) as bigint) as y from divided),
    offs as (select unnest(range(9)) as o), around as (select p.*, o, x + o // 3 - 1 as nx, y + o % 3 - 1 as ny from placed p cross join offs),
    pairs as (select a.id, b.id as parent, row_number() over (partition by a.id order by o, b.listed_date, b.id) as rn from around a join placed b
        on a.type = b.type and a.municipio = b.municipio and a.nx = b.x and a.ny = b.y and (b.listed_date, b.id) < (a.listed_date, a.id) and abs(a.m2 - b.m2) <= 2 and bit_count(xor(a.simhash, b.simhash)) <= 12
        and 2 * 6371000.0 * atan2(sqrt(pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)), sqrt(1 - (pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2)))) <= 120),
    parent as (select id, parent from pairs where rn = 1),
    walk as (select id, parent as tip from parent union all select w.id, p.parent from walk w join parent p on p.id = w.tip)"""


@register(f"with recursive {_NEAR} select r.id, w.tip as dup_of from relisted r left join (select * from walk where tip not in (select id from parent)) w using (id)")
def q_near_dups(spark, sf_dir):
    return dedupe.with_duplicates(fixtures.relisted(spark, sf_dir)).select("id", "dup_of")


@register(f"with recursive {_NEAR} select count(*) as n, (select count(*) from parent) as duplicates, round((select count(*) from parent) / count(*), 6) as rate from relisted")
def q_dup_rate(spark, sf_dir):
    return dedupe.duplicate_rate(dedupe.with_duplicates(fixtures.relisted(spark, sf_dir))).withColumn("rate", F.round("rate", 6))


_ASSIGN = f"""{fixtures.LISTINGS_SQL}, {fixtures.EDGES_SQL}, points as (select distinct lat, lng from listings),
    tested as (select lat, lng, ordinal, ageb_id,
        bool_or((blng - alng) * (lat - alat) - (blat - alat) * (lng - alng) = 0 and lat between least(alat, blat) and greatest(alat, blat) and lng between least(alng, blng) and greatest(alng, blng)) as edge,
        sum(case when (alat > lat) <> (blat > lat) then case when lng < (blng - alng) * (lat - alat) / (blat - alat) + alng then 1 else 0 end else 0 end) as n
        from points cross join edges group by lat, lng, ordinal, ageb_id),
    found as (select lat, lng, arg_min(ageb_id, ordinal) as ageb_id from tested where edge or n % 2 = 1 group by lat, lng)"""


@register(f"with {_ASSIGN} select id, ageb_id from listings left join found using (lat, lng)")
def q_pip_assign(spark, sf_dir):
    return enrich.batch_assign(fixtures.listings(spark, sf_dir), fixtures.polygons(spark))


def _grades(spark):
    rows = [F.struct(F.lit(i).alias("ageb_id"), F.lit(g).alias("grade"), F.lit(v).alias("index_value")) for i, g, v in (("A1", "Bajo", 10.5), ("A2", "Alto", 70.25), ("A4", "Medio", 40.0))]
    return spark.range(1).select(F.inline(F.array(*rows)))


def _towns(spark, sf_dir):
    """Every polygon for every second nation, so that the town decides too."""
    towns = fixtures.table(spark, sf_dir, "nation").filter("n_nationkey % 2 = 0").select(F.col("n_name").alias("municipio"))
    return fixtures.polygons(spark).join(F.broadcast(towns), F.lit(True))


@register(f"""with {_ASSIGN}, grades(ageb_id, grade, index_value) as (values ('A1', 'Bajo', 10.5::double), ('A2', 'Alto', 70.25::double), ('A4', 'Medio', 40.0::double)),
    own as (select id, f.ageb_id from listings l join found f using (lat, lng) join nation on n_name = municipio where n_nationkey % 2 = 0 and estado = 'ASIA')
    select l.id, o.ageb_id, grade as marginacion_grade, index_value as marginacion_index from listings l left join own o using (id) left join grades g on g.ageb_id = o.ageb_id""")
def q_enrich(spark, sf_dir):
    return enrich.enriched(fixtures.listings(spark, sf_dir), _towns(spark, sf_dir), _grades(spark), "ASIA").select("id", "ageb_id", "marginacion_grade", "marginacion_index")


@register(f"with {_ASSIGN} select count(*) as total, count(ageb_id) as assigned, round(count(ageb_id) / count(*), 6) as rate from listings l left join found using (lat, lng) where estado = 'ASIA'")
def q_coverage(spark, sf_dir):
    rows = fixtures.listings(spark, sf_dir)
    return enrich.coverage(rows.join(enrich.batch_assign(rows, fixtures.polygons(spark)), "id"), "ASIA").withColumn("rate", F.round("rate", 6))


_POINT = "select {k} as {n}, cast({k} % 85 as double) + 0.25 as lat, cast({k} * 7 % 180 as double) - 0.5 as lng from {t}"


@register(f"""with a as ({_POINT.format(k="n_nationkey", n="i", t="nation")}), b as ({_POINT.format(k="s_suppkey", n="j", t="supplier")})
    select i, j, round(2 * 6371000.0 * atan2(sqrt(h), sqrt(1 - h)), 3) as meters from (select i, j, pow(sin((radians(b.lat) - radians(a.lat)) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lng - a.lng) / 2), 2) as h from a cross join b)""")
def q_haversine_pairs(spark, sf_dir):
    a, b = (spark.sql(_POINT.format(k=k, n=n, t="{t}"), t=fixtures.table(spark, sf_dir, t)) for k, n, t in (("n_nationkey", "i", "nation"), ("s_suppkey", "j", "supplier")))
    return enrich.distances(F.broadcast(a), b).withColumn("meters", F.round("meters", 3))


@register(f"with {fixtures.LISTINGS_SQL} select id from listings where price_mxn < 200000 and contains(cast(m2 as varchar), '9') and contains(strip_accents(lower(municipio)), 'nation_1') and (contains(lower(title), 'urg') or contains(lower(colonia), 'urg') or contains(lower(municipio), 'urg') or contains(lower(estado), 'urg') or contains(lower(type), 'urg'))")
def q_quickfilter(spark, sf_dir):
    return quickfilter.quick_filter(fixtures.listings(spark, sf_dir), "price<200000 m2:9 municipio=NÁTION_1 urg").select("id")


@register(f"""with {fixtures.LISTINGS_SQL}, slice as (select * from listings where dup_of is null order by listed_date desc, id limit 5000), ranked as (select id, row_number() over (order by listed_date desc, id) - 1 as pos, count(*) over () as n from slice)
    select id from ranked where n <= 400 or pos in (select cast(floor(i * (select max(n) from ranked) / 400.0) as bigint) from (select unnest(range(400)) as i))""")
def q_stride(spark, sf_dir):
    rows = explore.web_slice(fixtures.listings(spark, sf_dir))
    return explore.strided(rows, [F.desc("listed_date"), F.asc("id")]).select("id")


@register(f"with {fixtures.LISTINGS_SQL} select id, municipio, cast(row_number() over (order by municipio, id) as integer) as place from listings where lat is not null and not (lat = 0 and lng = 0)")
def q_sort_locale(spark, sf_dir):
    """The place of each row in the sorted output, as it is written."""
    return _placed(explore.sort_listings(explore.plottable(fixtures.listings(spark, sf_dir)), "municipio").select("id", "municipio"))


def _placed(rows: DataFrame) -> DataFrame:
    """rows with their place in the order that they have: partitions of a sorted table follow one another, and ids rise
    within each, so the place is the number of rows in earlier partitions and of earlier rows in one's own."""
    held = cut(rows.withColumns({"_p": F.spark_partition_id(), "_i": F.monotonically_increasing_id()}))
    before = {r["_p"]: r["n"] for r in held.groupBy("_p").agg(F.count(F.lit(1)).alias("n")).collect()}  # a row a partition
    starts = [(p, sum(n for q, n in before.items() if q < p)) for p in before]
    offset = rows.sparkSession.createDataFrame(starts, "_p int, _start long")
    return held.join(F.broadcast(offset), "_p").select(*rows.columns, (F.col("_start") + F.col("_i").bitwiseAND(F.lit((1 << 33) - 1)) + 1).cast("int").alias("place"))


@register(f"with {fixtures.LISTINGS_SQL}, top as (select * from listings order by price_mxn desc, id limit 300) select title, price_mxn, m2, bedrooms, type, colonia, municipio, listed_date from top")
def q_table_columns(spark, sf_dir):
    return explore.table_rows(fixtures.listings(spark, sf_dir), "price_mxn", "desc")


@register(f"with {fixtures.LISTINGS_SQL} select id, {', '.join(f'cast(floor(({c} - {m}) / 0.01) + (case when ({c} - {m}) / 0.01 - floor(({c} - {m}) / 0.01) > 0.5 then 1 else 0 end) as bigint) as {c}_cell' for c, m in (('lat', '(lat % 0.01)'), ('lng', '(case when lng % 0.01 < 0 then (lng % 0.01 + 0.01) % 0.01 else lng % 0.01 end)')))} from listings")
def q_grid_cells(spark, sf_dir):
    return fixtures.listings(spark, sf_dir).select("id", *[geo.floor_div(F.col(c), 0.01).alias(f"{c}_cell") for c in ("lat", "lng")])


@register("""with towns as (select n_name as municipio, avg(s_acctbal) as mean, count(*) as people from supplier join nation on s_nationkey = n_nationkey group by n_name), ends as (select min(mean) as lo, max(mean) as hi from towns)
    select municipio, people as weight, round(9000 + pow((mean - lo) / (hi - lo), 1.5) * 46000, 4) as price_base from towns cross join ends where municipio <> 'NATION_3'""")
def q_context(spark, sf_dir):
    nation = fixtures.table(spark, sf_dir, "nation")
    own = fixtures.table(spark, sf_dir, "supplier").join(nation, F.col("s_nationkey") == F.col("n_nationkey")).select(F.col("n_name").alias("municipio"), F.col("s_acctbal").alias("index_normalized"), F.lit(1).cast("long").alias("population"))
    return generate.municipality_context(own, nation.filter("n_name <> 'NATION_3'").select(F.col("n_name").alias("municipio"))).withColumn("price_base", F.round("price_base", 4))


@register(f"with {fixtures.RAW_SQL} select source, count(*) as n from raw group by source")
def q_union_sources(spark, sf_dir):
    rows = fixtures.raw(spark, sf_dir)
    parts = [rows.filter(F.col("source") == s) for s in ("A", "N", "R")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2]).groupBy("source").agg(F.count(F.lit(1)).alias("n"))


def _uniform(salt: str) -> str:
    return f"(('0x' || substr(md5(cast(n as varchar) || ':{salt}'), 1, 13))::bigint / 4503599627370496.0)"


@register(f"""with numbers as (select unnest(range((select count(*) from orders))) as n), drawn as (select {_uniform("dup")} as dup, {_uniform("broken")} as broken, cast(floor({_uniform("fault")} * 5) as integer) as fault from numbers),
    reasons as (select 'kept' as reason from drawn union all select 'kept' from drawn where dup < 0.03
        union all select case fault when 1 then 'bad_m2' when 2 then 'bad_type' when 3 then 'missing_location' else 'bad_price' end from drawn where broken < 0.01)
    select reason, count(*) as n from reasons group by reason""")
def q_generated(spark, sf_dir):
    """Drop reasons of generated listings, as many as there are orders."""
    raw = generate.generate(spark, fixtures.table(spark, sf_dir, "orders").count())
    return clean.drop_statistics(clean.first_of_id(clean.cleaned(raw), "id"))


_MESSY = """messy as (select 'S' || cast(s_suppkey as varchar) as id, 'Señal "' || cast(s_suppkey as varchar) || '", día ' || cast(s_nationkey as varchar) as title,
    case when s_suppkey % 3 = 0 then 'línea uno' || chr(10) || 'línea, dos' else ' ñandú ' end as description, cast(s_nationkey * 1000 + 5 as varchar) as price_mxn, '80' as m2, '' as bedrooms, 'Casa' as type,
    'Peñón' as colonia, 'Mérida' as municipio, 'Yucatán' as estado, '20.5' as lat, '-89.5' as lng, '2024-05-06' as listed_date,
    case s_suppkey % 3 when 0 then 'a' when 1 then 'b' else 'c' end as source from supplier)"""


@register(f"with {_MESSY} select id, title, description, price_mxn, m2, bedrooms, type, colonia, municipio, estado, lat, lng, listed_date, source from messy")
def q_roundtrip_csv(spark, sf_dir):
    """Raw listings written as CSV files, those of one source in Latin-1, and read again by their bytes' encoding."""
    sql = _MESSY.removeprefix("messy as (").removesuffix(")").replace(" as varchar)", " as string)").replace("from supplier", "from {supplier}")
    folder = f"{scratch(spark)}/roundtrip-{uuid.uuid4().hex}"
    writers.write_raw(spark.sql(sql, supplier=fixtures.table(spark, sf_dir, "supplier")), folder, ("b",))
    return readers.raw_listings(spark, folder).select(*[F.coalesce(c, F.lit("")).alias(c) for c in QUERY_COLUMNS])


@register(f"with {fixtures.LISTINGS_SQL} select {COLS}, dup_of, cast(null as varchar) as ageb_id, cast(null as varchar) as marginacion_grade, cast(null as double) as marginacion_index from listings")
def q_roundtrip_table(spark, sf_dir):
    """The stored table, written, replaced by itself and read."""
    path = f"{scratch(spark)}/stored-{uuid.uuid4().hex}"
    writers.store(fixtures.listings(spark, sf_dir), path)
    writers.replace(readers.stored(spark, path), path)
    return readers.stored(spark, path)


@register(f"with {fixtures.LISTINGS_SQL} select id, title, price_mxn, m2, bedrooms, type, colonia, municipio, estado, lat, lng, listed_date from listings where dup_of is null order by listed_date desc, id limit 5000")
def q_roundtrip_json(spark, sf_dir):
    """The explorer's slice as a JSON array, written and read."""
    folder = f"{scratch(spark)}/slice-{uuid.uuid4().hex}"
    text_ = writers.slice_text(explore.web_slice(fixtures.listings(spark, sf_dir)))  # 5,000 rows by its definition
    spark.createDataFrame([(text_,)], "value string").coalesce(1).write.text(folder)
    return readers.slice_json(spark, folder)


_RING_GEOJSON = """shapes as (select n_nationkey as k, cast(n_nationkey % 5 as double) / 4 as lat, cast(n_nationkey as double) / 8 - 99 as lng, n_name as town from nation)"""


@register(f"with {_RING_GEOJSON} select cast(row_number() over (order by k) - 1 as bigint) as ordinal, 'P' || cast(k as varchar) as ageb_id, town as municipio, lat as min_lat, lng as min_lng, lat + 0.5 as max_lat, lng + 0.25 as max_lng from shapes")
def q_source_geojson(spark, sf_dir):
    """A FeatureCollection of a square a nation, read with places and boxes."""
    folder = f"{scratch(spark)}/shapes-{uuid.uuid4().hex}"
    sql = _RING_GEOJSON.removeprefix("shapes as (").removesuffix(")").replace("from nation", "from {nation}")
    rows = spark.sql(sql, nation=fixtures.table(spark, sf_dir, "nation"))
    corner = lambda dy, dx: F.array(F.col("lng") + dx, F.col("lat") + dy)
    feature = F.struct("k", F.struct(F.concat(F.lit("P"), F.col("k").cast("string")).alias("CVEGEO"), F.col("town").alias("NOM_MUN")).alias("properties"), F.struct(F.lit("Polygon").alias("type"), F.array(F.array(corner(0, 0), corner(0.5, 0), corner(0.5, 0.25), corner(0, 0.25))).alias("coordinates")).alias("geometry"))
    whole = rows.agg(F.sort_array(F.collect_list(feature)).alias("features")).select(F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("value"))
    whole.coalesce(1).write.text(folder)
    return readers.polygons(spark, folder).drop("ring")


@register(f"with {_hashes_sql('customer', 'c_custkey', 'c_name')} select k as c_custkey, simhash as arrow, simhash as sql, 0 as bits from hashed")
def q_simhash_kernels(spark, sf_dir):
    """Both fingerprint kernels over the same texts, dealt out first: a file of one row group is read by one task."""
    ship(spark)
    both = fixtures.table(spark, sf_dir, "customer").select("c_custkey", "c_name").hint("repartition").select("c_custkey", text.fingerprint(F.col("c_name")).alias("arrow"), text.fingerprint(F.col("c_name"), "sql").alias("sql"))
    return both.withColumn("bits", text.hamming(F.col("arrow"), F.col("sql")))


@register(f"""with {fixtures.LISTINGS_SQL}, {fixtures.DIAMONDS_SQL}, points as (select distinct lat, lng from listings),
    near as (select * from points join corners on lat between y - 0.03 and y + 0.03 and lng between x - 0.02 and x + 0.02),
    tested as (select lat, lng, ordinal, bool_or((blng - alng) * (lat - alat) - (blat - alat) * (lng - alng) = 0 and lat between least(alat, blat) and greatest(alat, blat) and lng between least(alng, blng) and greatest(alng, blng)) as edge,
        sum(case when (alat > lat) <> (blat > lat) then case when lng < (blng - alng) * (lat - alat) / (blat - alat) + alng then 1 else 0 end else 0 end) as n from near group by lat, lng, ordinal),
    found as (select lat, lng, min(ordinal) as ordinal from tested where edge or n % 2 = 1 group by lat, lng)
    select id, 'R' || cast(ordinal as varchar) as ageb_id from listings left join found using (lat, lng)""")
def q_pip_many(spark, sf_dir):
    """All listings against 2,000 rings."""
    return enrich.batch_assign(fixtures.listings(spark, sf_dir), fixtures.diamonds(spark))
