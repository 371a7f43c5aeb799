import json
import random
import time

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from landsift.functions import geo, text
from landsift.operators import clean, dedupe, enrich, explore, stats
from landsift.plans import catalog, cli, fixtures, pipeline, quickfilter
from landsift.schema import LISTING, QUERY_COLUMNS
from landsift.sources import generate, readers, writers
from landsift.streaming import gate

VALID = dict(id="A1", title=" Casa ", description="x", price_mxn="3500000", m2="80", bedrooms="2", type="casa", colonia="Roma", municipio="Centro", estado="Ciudad de México", lat="19.4", lng="-99.1", listed_date="2024-05-01", source="s")


def raw(spark, rows):
    return spark.createDataFrame([tuple((VALID | r).get(c) for c in QUERY_COLUMNS) for r in rows], ", ".join(f"{c} string" for c in QUERY_COLUMNS))


@pytest.mark.parametrize("override, reason", [({}, None), ({"price_mxn": "$3,500,000"}, None), ({"price_mxn": "N/D"}, "bad_price"), ({"price_mxn": None}, "bad_price"), ({"price_mxn": "inf"}, "bad_price"), ({"price_mxn": "1d"}, "bad_price"), ({"price_mxn": "-5"}, "bad_price"), ({"m2": "0"}, "bad_m2"), ({"bedrooms": ""}, None), ({"bedrooms": "-1"}, "bad_bedrooms"), ({"type": " CASA "}, None), ({"type": "oficina"}, "bad_type"), ({"colonia": "  "}, "missing_location"), ({"lat": "200"}, "bad_coords"), ({"lat": "nan"}, "bad_coords"), ({"listed_date": "05/01/2024"}, "bad_date"), ({"listed_date": "20240501"}, "bad_date"), ({"id": " "}, "missing_id"), ({"id": "", "m2": "x"}, "missing_id")])
def test_reasons(spark, override, reason):
    assert clean.cleaned(raw(spark, [override])).first()["reason"] == reason


def test_typed_values(spark):
    got = [r["price_mxn"] for r in clean.cleaned(raw(spark, [{"price_mxn": p} for p in ("2.5", "3.5", "999999.6", "1_000", " $1,5 ")])).collect()]
    assert got == [2, 4, 1000000, 1000, 15]
    assert clean.cleaned(raw(spark, [{}])).first()["title"] == "Casa"


def test_first_of_id(spark):
    rows = clean.cleaned(raw(spark, [{"title": str(i)} for i in range(3)]).withColumn("place", F.col("title")))
    out = clean.first_of_id(rows, "place").orderBy("place").collect()
    assert [r["reason"] for r in out] == [None, "duplicate_id", "duplicate_id"]


def test_files(spark, tmp_path):
    head = ",".join(QUERY_COLUMNS)
    line = ",".join(VALID[c].strip() for c in QUERY_COLUMNS)
    (tmp_path / "listings_b.csv").write_bytes(f"{head}\n{line.replace('Roma', 'Peñón')}\n".encode("latin-1"))
    (tmp_path / "listings_a.csv").write_bytes(f"﻿{head}\n{line}\n".encode())
    (tmp_path / "readme.txt").write_text("no")
    out = clean.first_of_id(clean.cleaned(readers.raw_listings(spark, str(tmp_path))), "_file", "_pos").collect()
    assert {(r["colonia"], r["reason"]) for r in out} == {("Roma", None), ("Peñón", "duplicate_id")}
    (tmp_path / "empty").mkdir()
    assert readers.raw_listings(spark, str(tmp_path / "empty")).count() == 0


def near(spark, *rows):
    base = dict(description="casa amplia y luminosa cerca del parque con jardín", lat=19.4, lng=-99.1, m2=80, type="casa", municipio="Centro")
    names = ["id", "description", "lat", "lng", "m2", "type", "municipio", "listed_date"]
    df = spark.createDataFrame([tuple((base | r)[n] for n in names) for r in rows], "id string, description string, lat double, lng double, m2 long, type string, municipio string, listed_date string")
    return {r["id"]: r["dup_of"] for r in dedupe.with_duplicates(df).collect()}


def test_duplicates(spark):
    a, b = dict(id="a", listed_date="2024-01-01"), dict(id="b", listed_date="2024-02-01", lat=19.40006)
    assert near(spark, a, b) == {"a": None, "b": "a"}
    assert near(spark, a, b | dict(lat=19.45)) == {"a": None, "b": None}
    assert near(spark, a, b | dict(type="local")) == {"a": None, "b": None}
    assert near(spark, a, b | dict(description="terreno plano sin servicios junto al río")) == {"a": None, "b": None}
    assert near(spark, a, b, dict(id="c", listed_date="2024-03-01", lat=19.4012), dict(id="d", listed_date="2024-03-02", lat=19.4006)) == {"a": None, "b": "a", "c": None, "d": "a"}
    chain = near(spark, a, dict(id="b", listed_date="2024-02-01", lat=19.401), dict(id="c", listed_date="2024-03-01", lat=19.402))
    assert chain == {"a": None, "b": "a", "c": "a"}
    assert near(spark, dict(id="y", listed_date="2024-01-01", description=None), dict(id="x", listed_date="2024-01-01", description="")) == {"x": None, "y": "x"}


def test_generated_duplicates_are_found(spark):
    base = generate.primaries(spark, 1500)
    dups = generate.duplicates(base, 0.2)
    got = dedupe.with_duplicates(base.drop("n").unionByName(dups.drop("n", "of")))
    both = got.join(dups.select("id", "of"), "id", "left").select("dup_of", "of").collect()
    hit = sum(r["of"] is not None and r["dup_of"] == r["of"] for r in both)
    assert hit / sum(r["of"] is not None for r in both) > 0.8
    assert sum(r["of"] is None and r["dup_of"] is not None for r in both) < 0.02 * len(both)


def py_inside(lat, lng, ring):
    n, inside = len(ring), False
    if n < 3:
        return False
    for i in range(n):
        (ay, ax), (by, bx) = ring[i], ring[(i + 1) % n]
        if (bx - ax) * (lat - ay) - (by - ay) * (lng - ax) == 0 and min(ay, by) <= lat <= max(ay, by) and min(ax, bx) <= lng <= max(ax, bx):
            return True
        if (ay > lat) != (by > lat) and lng < (bx - ax) * (lat - ay) / (by - ay) + ax:
            inside = not inside
    return inside


def test_polygons_agree_with_plain_code(spark):
    rng = random.Random(20260710)
    rings = [[(rng.uniform(19, 20), rng.uniform(-100, -99)) for _ in range(rng.randint(0, 9))] for _ in range(40)]
    rings += [[(19.0, -99.0)] * 4, [(19.0, -99.0), (19.5, -99.5), (20.0, -100.0)], [(19.0, -99.0), (19.0, -99.5), (19.5, -99.5), (19.0, -99.0)]]
    points = [(rng.uniform(19, 20), rng.uniform(-100, -99)) for _ in range(20)] + [p for r in rings for p in r[:2]] + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for r in rings if len(r) > 2 for a, b in [r[:2]]]
    rows = [(y, x, [{"lat": float(a), "lng": float(b)} for a, b in r]) for r in rings for y, x in points]
    df = spark.createDataFrame(rows, "lat double, lng double, ring array<struct<lat:double,lng:double>>")
    got = df.select(geo.point_in_polygon(F.col("lat"), F.col("lng"), F.col("ring")).alias("x")).collect()
    want = [py_inside(y, x, [(p["lat"], p["lng"]) for p in r]) for y, x, r in rows]
    assert [r["x"] for r in got] == want and any(want)
    ps = spark.createDataFrame([(i, f"P{i}", r) for i, r in enumerate([x[2] for x in rows[:: len(points)]])], "ordinal long, ageb_id string, ring array<struct<lat:double,lng:double>>")
    out = {r["id"]: r["ageb_id"] for r in enrich.batch_assign(spark.createDataFrame([(str(i), *p) for i, p in enumerate(points)], "id string, lat double, lng double"), readers.boxed(ps)).collect()}
    for i, (y, x) in enumerate(points):
        assert out[str(i)] == next((f"P{k}" for k, r in enumerate(rings) if py_inside(y, x, r)), None)


def py_simhash(t):
    weights, word = [0] * 64, bytearray()
    for b in (t or "").encode() + b" ":
        if chr(b).isalnum() and b < 128 or b >= 128:
            word.append(b + 32 if 65 <= b <= 90 else b)
        elif word:
            h = 0xCBF29CE484222325
            for c in word:
                h = (h ^ c) * 0x100000001B3 % 2**64
            weights = [w + (1 if h >> i & 1 else -1) for i, w in enumerate(weights)]
            word = bytearray()
    v = sum(1 << i for i, w in enumerate(weights) if w > 0)
    return v - 2**64 if v >= 2**63 else v


def test_fingerprints_and_cells(spark):
    texts = ["", None, "Casa Ñandú 3 recámaras", "a a b", "...", "ÁLVARO\tObregón,\n99"]
    assert text.fingerprints(texts).tolist() == [py_simhash(t) for t in texts]
    values = [i / 1000 for i in range(-2500, 2500)] + [random.Random(1).uniform(-100, 100) for _ in range(500)]
    got = spark.createDataFrame([(v,) for v in values], "v double").select(geo.floor_div(F.col("v"), 0.01).alias("c")).collect()
    assert [r["c"] for r in got] == [int(v // 0.01) for v in values]
    assert spark.range(1).select(text.hamming(F.lit(0).cast("long"), F.lit(-1).cast("long"))).first()[0] == 64


def listing(spark, rows):
    base = dict(id="", title="t", description="d", price_mxn=100, m2=10, bedrooms=1, type="casa", colonia="Roma", municipio="Centro", estado="E", lat=19.0, lng=-99.0, listed_date="2024-01-01", source="s", dup_of=None, ageb_id=None, marginacion_grade=None, marginacion_index=None)
    return spark.createDataFrame([tuple((base | dict(id=str(i)) | r).values()) for i, r in enumerate(rows)], LISTING)


def test_statistics(spark):
    df = listing(spark, [dict(price_mxn=400_000), dict(price_mxn=900_000), dict(price_mxn=50_000_000, m2=0), dict(price_mxn=1, dup_of="0"), dict(colonia="Z", m2=0)])
    doc = pipeline.summary(df)
    assert doc["total_listings"] == 4 and doc["by_colonia"] == [{"colonia": "Roma", "municipio": "Centro", "count": 3, "median_price_per_m2": 65000.0}]
    assert [b["count"] for b in doc["histogram"]] == [2, 1, 0, 0, 0, 0, 0, 0, 0, 0, 1] and doc["histogram"][-1]["bucket_max_mxn"] is None
    empty = df.filter("false")
    assert stats.overall(empty).first()["count"] == 0 and stats.equal_width(empty).count() == 0 and stats.equal_width(df, 0).count() == 0
    assert [r["count"] for r in stats.equal_width(listing(spark, [{}, {}])).collect()] == [2]
    assert sum(r["count"] for r in stats.equal_width(df).collect()) == 5
    assert stats.by_field(df, "TYPE", limit=0).count() == 0 and stats.by_field(df, "type", limit=-1).count() == 1
    with pytest.raises(ValueError):
        stats.by_field(df, "lat")
    top = stats.colonia_ranking(listing(spark, [dict(municipio="B"), dict(municipio="A"), dict(colonia="X", price_mxn=999)])).collect()
    assert [(r["colonia"], r["municipio"], r["count"]) for r in top] == [("X", "Centro", 1), ("Roma", "B", 2)]


def test_explorer(spark):
    df = listing(spark, [dict(colonia="Cuauhtémoc", price_mxn=10, listed_date="2024-02-01"), dict(price_mxn=25), dict(dup_of="0"), dict(lat=0.0, lng=0.0)])
    ids = lambda d: [r["id"] for r in d.collect()]
    assert ids(quickfilter.quick_filter(df, "CUAUHTEMOC")) == ["0"] and ids(quickfilter.quick_filter(df, "price<20 cuauh type=cas")) == ["0"]
    assert ids(quickfilter.quick_filter(df, "price:5 ")) == ["1"] and ids(quickfilter.quick_filter(df, "price<abc")) == [] and len(ids(quickfilter.quick_filter(df, ""))) == 4
    assert ids(quickfilter.quick_filter(df, "cuauhtémoc", text.folded_any)) == ["0"]
    assert ids(explore.web_slice(df, 2)) == ["0", "1"] and ids(explore.plottable(df)) == ["0", "1", "2"]
    many = spark.range(1000).select(F.col("id"))
    assert sorted(r["id"] for r in explore.strided(many, ["id"], 400).collect()) == [i * 1000 // 400 for i in range(400)]
    assert explore.query(df, "price>=25", 0, "id,price_mxn,id").columns == ["id", "price_mxn"]
    with pytest.raises(ValueError):
        explore.resolve_columns("id,dup_of")
    assert [r["municipio"] for r in explore.sort_listings(listing(spark, [dict(municipio=m) for m in ("Zeta", "casa", "Álamo", "Nápoles", "Del Carmen")]), "municipio").collect()] == ["Álamo", "casa", "Del Carmen", "Nápoles", "Zeta"]


def test_pipeline_and_cli(spark, tmp_path):
    raw_dir, table = tmp_path / "raw", str(tmp_path / "t.parquet")
    raw_dir.mkdir()
    rows = [VALID | {"id": "A"}, VALID | {"id": "B", "listed_date": "2024-06-01", "lat": "19.40005"}, VALID | {"id": "C", "type": "oficina"}, VALID | {"id": "D", "colonia": 'La "Villa", N', "lat": "19.9"}]
    (raw_dir / "listings_x.csv").write_text(writers.csv_text(rows, list(QUERY_COLUMNS)), encoding="utf-8")
    assert pipeline.build(spark, str(raw_dir), table) == {"read": 4, "rows": 3, "dropped": 1, "drop_reasons": {"bad_type": 1}, "duplicates": 1}
    square = [[-99.2, 19.3], [-99.0, 19.3], [-99.0, 19.5], [-99.2, 19.5]]
    (tmp_path / "p.json").write_text(json.dumps({"features": [{"properties": {"CVEGEO": "9", "NOM_MUN": "Centro"}, "geometry": {"coordinates": [square]}}]}))
    (tmp_path / "m.csv").write_text("ageb_id,grade,index_value\n9,Alto,1\n9,Bajo,2.5\n")
    with pytest.warns(UserWarning):
        assert pipeline.locate(spark, table, str(tmp_path / "p.json"), str(tmp_path / "m.csv")) == {"total": 3, "assigned": 2, "rate": 2 / 3}
    assert pipeline.relabel(spark, table)["duplicates"] == 1
    got = {r["id"]: (r["ageb_id"], r["marginacion_grade"], r["marginacion_index"], r["dup_of"]) for r in spark.read.parquet(table).collect()}
    assert got == {"A": ("9", "Bajo", 2.5, None), "B": ("9", "Bajo", 2.5, "A"), "D": (None, None, None, None)}
    assert pipeline.export_slice(spark, table, str(tmp_path / "s.json")) == 2 and readers.slice_json(spark, str(tmp_path / "s.json")).count() == 2
    (tmp_path / "bad.json").write_text("{}")
    with pytest.raises(ValueError):
        readers.slice_json(spark, str(tmp_path / "bad.json"))

    said: list[str] = []
    run = lambda *a: (said.clear(), cli.main([*a, "--db", table], spark, said.append, said.append))[1]
    assert run("query", "colonia:roma", "--columns", "id,m2", "--limit=1") == 0 and said == ["id  m2\n--  --\nB   80", "(1 row; --limit cut the list at 1)"]
    assert run("stats", "--by", "type") == 0 and said[0] == "listings: 3" and "by type" in said[4]
    assert run("export", "id=" + "x") == 1 and said[0].endswith("(position 0)")
    assert run("export", "price>0", "--out", str(tmp_path / "o.csv"), "--columns", "colonia") == 0 and (tmp_path / "o.csv").read_text() == 'colonia\nRoma\nRoma\n"La ""Villa"", N"\n'
    assert run("nope") == 1 and run("query", "--limit", "x") == 1 and cli.main([], spark, said.append) == 1 and cli.main(["-h"], spark, said.append) == 0
    assert cli.main(["query", "--db", str(tmp_path / "none")], spark, said.append, said.append) == 1 and "not found" in said[-1]


def test_distances_and_context(spark):
    p = spark.createDataFrame([(0, 0.0, 0.0), (1, 19.4, -99.1)], "i int, lat double, lng double")
    got = {(r["i"], r["j"]): r["meters"] for r in enrich.distances(p, p.withColumnRenamed("i", "j")).collect()}
    assert got[0, 0] == 0 and got[1, 1] == 0 and abs(got[0, 1] - got[1, 0]) < 1e-6
    a = spark.createDataFrame([("A", 1.0, 5), ("A", 3.0, 5), ("B", 10.0, None), ("C", 4.0, 1)], "municipio string, index_normalized double, population long")
    out = {r["municipio"]: (r["weight"], r["price_base"]) for r in generate.municipality_context(a, spark.createDataFrame([("A",), ("B",)], "municipio string")).collect()}
    assert out == {"A": (10, 9000.0), "B": (1, 55000.0)}


def test_streaming_parts(spark, tmp_path):
    raw(spark, [{}, {"m2": "x"}]).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(spark.read.parquet(str(tmp_path / "in")).schema).parquet(str(tmp_path / "in"))
    q = gate.filtered(gate.validated(stream).filter("reason is null"), "m2>=80").writeStream.format("memory").queryName("gate").start()
    q.processAllAvailable()
    q.stop()
    assert spark.table("gate").count() == 1


def test_points_are_drawn_inside_polygons(spark):
    rings = fixtures.polygons(spark).withColumn("municipio", F.lit("Centro"))
    inside = {r["ageb_id"]: [(p["lat"], p["lng"]) for p in r["ring"]] for r in rings.collect() if len(r["ring"]) > 2}
    rows = spark.range(300).select(F.col("id").alias("n"), F.when(F.col("id") % 3 == 0, "Zapopan").otherwise("Centro").alias("municipio"), F.lit(1.0).alias("lat"), F.lit(2.0).alias("lng"))
    got = generate.points_in(rows, rings).collect()
    assert len(got) == 300
    for r in got:
        if r["municipio"] == "Zapopan":
            assert (r["lat"], r["lng"]) == (1.0, 2.0)
        else:
            assert any(py_inside(r["lat"], r["lng"], ring) for ring in inside.values())
    thin = spark.createDataFrame([(0, "Centro", [(0.0, 0.0), (1.0, 0.0), (2.0, 0.0)], 0.0, 0.0, 2.0, 0.0)], "ordinal long, municipio string, ring array<struct<lat:double,lng:double>>, min_lat double, min_lng double, max_lat double, max_lng double")
    assert {(r["lat"], r["lng"]) for r in generate.points_in(rows.filter("municipio = 'Centro'"), thin).collect()} == {(1.0, 0.0)}


def test_generated_rows_follow_their_context(spark):
    context = spark.createDataFrame([("Centro", 3, 20000.0), ("Mérida", 1, 90000.0), ("Elsewhere", 9, 1.0)], "municipio string, weight long, price_base double")
    got = generate.primaries(spark, 2000, context).groupBy("municipio").agg(F.count("*").alias("n"), F.avg(F.when(F.col("type") == "casa", F.col("price_mxn") / F.col("m2"))).alias("p")).collect()
    by = {r["municipio"]: r for r in got}
    assert set(by) == {"Centro", "Mérida"} and 2.4 < by["Centro"]["n"] / by["Mérida"]["n"] < 3.7 and by["Mérida"]["p"] > 3 * by["Centro"]["p"]


def test_streamed_rows_get_the_first_polygon(spark, tmp_path):
    rings = fixtures.polygons(spark).withColumn("municipio", F.lit("Centro"))
    points = [("a", "Centro", 19.15, -99.15), ("b", "Centro", 19.3, -99.2), ("c", "Centro", 0.0, 0.0), ("d", "Else", 19.15, -99.15), ("e", "Centro", None, None)]
    rows = spark.createDataFrame(points, "id string, municipio string, lat double, lng double")
    rows.write.parquet(str(tmp_path / "in"))
    stream = gate.located(spark.readStream.schema(rows.schema).parquet(str(tmp_path / "in")), rings)
    query = stream.writeStream.format("memory").queryName("located").trigger(availableNow=True).start()
    query.awaitTermination(60)
    assert {r["id"]: r["ageb_id"] for r in spark.table("located").collect()} == {"a": "A1", "b": "A2", "c": None, "d": None, "e": None}


def test_batch_stages_from_the_command_line(spark, tmp_path):
    said: list[str] = []
    run = lambda *a: (said.clear(), pipeline.main([*map(str, a)], spark, said.append))[1]
    assert run() == 1 and run("build", "x") == 1 and run("nothing") == 1
    assert run("generate", tmp_path / "raw", 400) == 0 and json.loads(said[0])["files"] >= 4
    assert run("build", tmp_path / "raw", tmp_path / "table") == 0
    done = json.loads(said[0])
    assert done["rows"] + done["dropped"] == done["read"] and done["rows"] >= 400 and done["duplicates"] > 0
    assert run("relabel", tmp_path / "table") == 0 and json.loads(said[0])["duplicates"] == done["duplicates"]
    assert run("summary", tmp_path / "table", tmp_path / "s.json") == 0 and run("slice", tmp_path / "table", tmp_path / "t.json", 7) == 0 and json.loads(said[0]) == {"rows": 7}


def test_kernels_agree(spark):
    rows = spark.createDataFrame([("Hola, año 2024",), ("",), (None,), ("a a b",), ("日本 x-y_z",), ("W" * 300,)], "t string")
    assert all(r["a"] == r["b"] for r in rows.select(text.fingerprint(F.col("t")).alias("a"), text.fingerprint(F.col("t"), "sql").alias("b")).collect())
    with pytest.raises(ValueError):
        text.fingerprint(F.col("t"), "other")


def test_kernels_agree_at_lane_bounds(spark):
    word, texts = random.Random(5).random, ["Ñ ñ 日本𝒳 a\U0010ffffb \x7f\x80", "é" * 3000]
    for n in (1, 2, 62, 63, 64, 65, 127, 128, 16383, 16384, 16385):
        texts += [" ".join(f"w{word()}" for _ in range(n)), "same " * n, "one " * (n // 2) + "two " * (n - n // 2)]
    got = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", text.fingerprint(F.col("t")).alias("a"), text.fingerprint(F.col("t"), "sql").alias("b")).collect()
    assert [(r["a"], r["b"]) for r in sorted(got, key=lambda r: r["i"])] == [(py_simhash(t),) * 2 for t in texts]


def test_sql_kernel_hashes_once(spark):
    rows = spark.range(20000).select(F.format_string("Customer#%09d", "id").alias("t")).localCheckpoint()

    def seconds(column):
        began = time.perf_counter()
        rows.select(column).write.format("noop").mode("overwrite").save()
        return time.perf_counter() - began

    hashes = F.transform(text.word_tokens(F.col("t")), text._fnv_sql)
    alone = min(seconds(hashes) for _ in range(4))
    assert min(seconds(text.fingerprint(F.col("t"), "sql")) for _ in range(3)) < 10 * alone  # 64 times if made for each bit


def test_kernels_query_deals_out_one_row_group(spark, tmp_path):
    n, named = 40_000, random.Random(7).randbytes  # names that don't shrink, or a task's least megabyte holds all
    pq.write_table(pa.table({"c_custkey": range(n), "c_name": [named(40).hex() for _ in range(n)]}), tmp_path / "customer.parquet")
    got = catalog.queries()["q_simhash_kernels"](spark, str(tmp_path))
    parts = got.groupBy(F.spark_partition_id().alias("p")).agg(F.count("*").alias("n"), F.max("arrow")).collect()
    assert len(parts) > 1 and sum(r["n"] for r in parts) == n
