"""Columns, types and fixed values of the listings tables, declared once."""

from pyspark.sql import types as T

_STRING, _LONG, _DOUBLE = T.StringType(), T.LongType(), T.DoubleType()

#: The 18 columns of a stored listing.
LISTING = T.StructType(
    [
        T.StructField("id", _STRING, False),
        T.StructField("title", _STRING),
        T.StructField("description", _STRING),
        T.StructField("price_mxn", _LONG),
        T.StructField("m2", _LONG),
        T.StructField("bedrooms", _LONG),
        T.StructField("type", _STRING),
        T.StructField("colonia", _STRING),
        T.StructField("municipio", _STRING),
        T.StructField("estado", _STRING),
        T.StructField("lat", _DOUBLE),
        T.StructField("lng", _DOUBLE),
        T.StructField("listed_date", _STRING),
        T.StructField("source", _STRING),
        T.StructField("dup_of", _STRING),
        T.StructField("ageb_id", _STRING),
        T.StructField("marginacion_grade", _STRING),
        T.StructField("marginacion_index", _DOUBLE),
    ]
)
QUERY_COLUMNS = tuple(LISTING.names[:14])
ENRICHED = tuple(LISTING.names[15:])
RAW = T.StructType([T.StructField(n, _STRING) for n in QUERY_COLUMNS])
#: The 12 columns of the explorer's slice.
SLICE_COLUMNS = ("id", "title", "price_mxn", "m2", "bedrooms", "type", "colonia", "municipio", "estado", "lat", "lng", "listed_date")
#: The 8 columns of the explorer's table.
TABLE_COLUMNS = ("title", "price_mxn", "m2", "bedrooms", "type", "colonia", "municipio", "listed_date")
#: Filter field -> column.
FIELDS = {"price": "price_mxn", "m2": "m2", "bedrooms": "bedrooms", "type": "type", "colonia": "colonia", "municipio": "municipio", "listed": "listed_date"}
NUMERIC = frozenset({"price", "m2", "bedrooms"})
#: Types, bounds of coordinates, duplicate thresholds (bits, metres, m2) and grid, the state that is enriched
#: and the share of its rows that should get a polygon.
TYPES = ("casa", "departamento", "terreno", "local")
LAT, LNG = (14.0, 33.0), (-118.5, -86.0)
#: Upper bounds of the price ladder; the last bucket is open.
PRICE_LADDER = (500_000, 1_000_000, 1_500_000, 2_000_000, 3_000_000, 4_000_000, 5_000_000, 7_500_000, 10_000_000, 15_000_000)
HAMMING_MOST, METRES_MOST, M2_MOST, CELL_DEGREES = 12, 120.0, 2, 0.01
ENRICHED_ESTADO = "Ciudad de México"
COVERAGE_TARGET = 0.95
POLYGON = T.StructType(
    [
        T.StructField("ordinal", _LONG),
        T.StructField("ageb_id", _STRING),
        T.StructField("municipio", _STRING),
        T.StructField("ring", T.ArrayType(T.StructType([T.StructField("lat", _DOUBLE), T.StructField("lng", _DOUBLE)]))),
        T.StructField("min_lat", _DOUBLE),
        T.StructField("min_lng", _DOUBLE),
        T.StructField("max_lat", _DOUBLE),
        T.StructField("max_lng", _DOUBLE),
    ]
)
