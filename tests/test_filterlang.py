import pytest

from landsift.plans.filterlang import EvalError, LexError, ParseError, compile_filter, to_number, tokenize

LIKE = "LOWER(colonia) LIKE ? ESCAPE '\\'"


@pytest.mark.parametrize(
    "expr, sql, params",
    [
        ("price<2500000", "price_mxn < ?", [2500000]),
        ("type=terreno", "type = ?", ["terreno"]),
        ('colonia:"Santa Fe"', LIKE, ["%santa fe%"]),
        ('colonia:"5%_\\\\"', LIKE, ["%5\\%\\_\\\\%"]),
        ("price<1 and colonia:roma or type=local", f"(price_mxn < ? AND {LIKE}) OR type = ?", [1, "%roma%", "local"]),
        ("price<1 and (colonia:roma or type=local)", f"price_mxn < ? AND ({LIKE} OR type = ?)", [1, "%roma%", "local"]),
        ("price<1 and price<2 and price<3", "(price_mxn < ? AND price_mxn < ?) AND price_mxn < ?", [1, 2, 3]),
        ("MUNICIPIO=Coyoacán AND bedrooms>=3", "municipio = ? AND bedrooms >= ?", ["Coyoacán", 3]),
        ('listed>="2024-01-01"', "listed_date >= ?", ["2024-01-01"]),
        ('price>="1e6"', "price_mxn >= ?", [1000000]),
    ],
)
def test_sql(expr, sql, params):
    assert compile_filter(expr) == (sql, params)


@pytest.mark.parametrize(
    "expr, kind, position",
    [
        ("price<1 & m2>2", LexError, 8),
        ('colonia:"abc', LexError, 8),
        ('colonia:"a\\n"', LexError, 10),
        ("lat>1", ParseError, 0),
        ("price 3", ParseError, 6),
        ("price<and", ParseError, 6),
        ("(price<1", ParseError, 8),
        ("price<1 m2>2", ParseError, 8),
        ("", ParseError, 0),
        ("price:1", EvalError, 0),
        ("m2>1 and price<abc", EvalError, 9),
        ('price<" "', EvalError, 0),
    ],
)
def test_errors(expr, kind, position):
    with pytest.raises(kind) as e:
        compile_filter(expr)
    assert e.value.position == position


def test_numbers():
    assert [to_number(x) for x in ("", " 5 ", "0x10", "1e3", ".5", "1_0", "abc", "-0b1")] == [0, 5, 16, 1000, 0.5, None, None, None]
    assert [t.value for t in tokenize("m2>=-3.50 x")] == ["m2", ">=", "-3.50", "x", ""]
