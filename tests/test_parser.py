from decimal import Decimal

import pytest

from tidemark.errors import QueryError, TidemarkError
from tidemark.plans import ast
from tidemark.plans.parser import parse


def test_precedence():
    q = parse("SELECT * FROM t WHERE a = 1 OR b = 2 AND (c = 3 OR d = 4)")
    c = ast.Compare
    assert q.where == ast.Or(c("a", "=", 1), ast.And(c("b", "=", 2), ast.Or(c("c", "=", 3), c("d", "=", 4))))


def test_clauses_and_labels():
    q = parse("select city as c, COUNT(*), sum(x) FROM t where x <> -5 group by city having count(*) > 1 before 7 order by c desc, count limit 3")
    assert [i.name for i in q.items] == ["c", "count", "sum(x)"]
    assert (q.before, q.limit, q.order_by) == (7, 3, (ast.OrderKey("c", True), ast.OrderKey("count")))


def test_contextual_words():
    assert parse("SELECT distinct FROM t").items[0].expr == "distinct"
    assert not parse("SELECT distinct, a FROM t").distinct
    assert parse("SELECT DISTINCT distinct FROM t").distinct
    assert parse("SELECT count FROM t").items[0].expr == "count"


def test_literals():
    assert parse("INSERT INTO t VALUES ('it''s', -1.23456789, null, 9223372036854775807)").values == ("it's", Decimal("-1.234567"), None, 2**63 - 1)
    assert parse("INSERT INTO t VALUES (-0.0000019)").values == (Decimal("-0.000001"),)


def test_parameters():
    assert parse("SELECT a FROM t WHERE a = ? AND b = '?'", ["x'); DROP TABLE u; --"]).where.left.value == "x'); DROP TABLE u; --"
    for bad in (([],), ([1, 2],), ([b"x"],)):
        with pytest.raises(QueryError):
            parse("SELECT a FROM t WHERE a = ?", *bad)


def test_place_of_an_error():
    with pytest.raises(QueryError) as e:
        parse("SELECT a\nFROM t WHERE a ~ 1")
    assert "(line 2, column 16)" in str(e.value) and str(e.value).endswith(" " * 17 + "^")


@pytest.mark.parametrize("sql", [
    "", "SELECT", "SELECT 1 + 1", "SELECT a AS from FROM t", "SELECT SUM(*) FROM t", "SELECT a FROM t WHERE a NOT = 1", "SELECT a FROM t WHERE a IN ()", "SELECT a FROM t LIMIT -1",
    "SELECT a FROM t BEFORE x", "SELECT a FROM t LIMIT 1 BEFORE 2", "INSERT INTO t VALUES (99999999999999999999)", "CREATE TABLE t ()", "DELETE FROM t", "UPDATE t SET a = 1", "SELECT a FROM t extra", "SELECT 'a", "(" * 5000, "SELECT a FROM t WHERE " + "(" * 3000,
])
def test_errors(sql):
    with pytest.raises(QueryError):
        parse(sql)


def test_garbage_raises_our_error_only():
    import random

    r = random.Random(3)
    words = "SELECT FROM WHERE a b * ( ) , = < ? 'x' 1 2.5 AND OR NOT IN BETWEEN LIKE GROUP BY HAVING ORDER LIMIT BEFORE count ; é \x00 -".split(" ")
    for _ in range(3000):
        try:
            parse(" ".join(r.choice(words) for _ in range(r.randint(0, 14))))
        except TidemarkError:
            pass
