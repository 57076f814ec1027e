"""Random statements over rows of all kinds against a small evaluator in plain Python."""

import random
from decimal import Decimal as D
from functools import cmp_to_key

from tidemark.database import Database
from tidemark.functions.predicates import RANK, kind_of
from tidemark.plans import ast

POOL = [None, None, 0, 1, 2, -3, D("1.000000"), D("1.500000"), D("-3.250000"), "", "a", "ab", "b%", b"", b"\x01"]


def rank(v):
    return RANK.get(kind_of(v), 0)


def order(a, b, strict):
    if not strict and kind_of(a) in ("i", "d") and kind_of(b) in ("i", "d"):
        return (a > b) - (a < b)
    if rank(a) != rank(b):
        return (rank(a) > rank(b)) - (rank(a) < rank(b))
    return 0 if a is None else (a > b) - (a < b)


def like(text, pattern):
    if not pattern:
        return not text
    if pattern[0] == "%":
        return any(like(text[i:], pattern[1:]) for i in range(len(text) + 1))
    return bool(text) and pattern[0] in ("_", text[0]) and like(text[1:], pattern[1:])


def holds(p, row):
    match p:
        case ast.And(a, b):
            return holds(a, row) and holds(b, row)
        case ast.Or(a, b):
            return holds(a, row) or holds(b, row)
        case ast.IsNull(c, n):
            return (row[c] is None) != n
        case ast.InList(c, vs, n):
            v = row[c]
            hit = any(x is not None and order(v, x, False) == 0 for x in vs)
            return v is not None and (hit if not n else not hit and None not in vs)
        case ast.Between(c, lo, hi, n):
            v = row[c]
            return v is not None and ((order(v, lo, False) >= 0 and order(v, hi, False) <= 0) != n)
        case ast.Compare(c, op, x):
            v = row[c]
            if op in ("like", "not_like"):
                return isinstance(v, str) and isinstance(x, str) and like(v, x) == (op == "like")
            if op in ("=", "!="):
                return (order(v, x, False) == 0) == (op == "=")
            k = order(v, x, False)
            return v is not None and x is not None and {"<": k < 0, "<=": k <= 0, ">": k > 0, ">=": k >= 0}[op]
    raise AssertionError


def predicate(r, depth=2):
    c, v = r.choice("abc"), lambda: r.choice([x for x in POOL if not isinstance(x, bytes)])
    k = r.randrange(8 if depth else 6)
    if k < 3:
        return ast.Compare(c, r.choice(["=", "!=", "<", "<=", ">", ">=", "like", "not_like"]), v())
    if k == 3:
        return ast.InList(c, tuple(v() for _ in range(r.randint(1, 3))), r.random() < 0.5)
    if k == 4:
        return ast.Between(c, v(), v(), r.random() < 0.5)
    if k == 5:
        return ast.IsNull(c, r.random() < 0.5)
    return (ast.And, ast.Or)[k - 6](predicate(r, depth - 1), predicate(r, depth - 1))


def test_random_statements(spark):
    r = random.Random(11)
    rows = [{c: r.choice(POOL[: 6 if c == "a" else len(POOL)]) for c in "abc"} for _ in range(60)]
    db = Database.memory(spark)
    db.create_table("t", list("abc"))
    for x in rows:
        db.insert("t", tuple(x.values()))
    typed = lambda x: tuple((kind_of(v), v) for v in x)
    for _ in range(40):
        p = predicate(r)
        keys = [(c, r.random() < 0.5) for c in r.sample("abc", 2)]
        limit = r.choice([None, 7])
        q = ast.Select("t", where=p, order_by=tuple(ast.OrderKey(c, d) for c, d in keys), limit=limit)

        def by(x, y, keys=keys):
            for c, d in keys:
                if k := order(x[c], y[c], True):
                    return -k if d else k
            return 0

        expected = sorted((x for x in rows if holds(p, x)), key=cmp_to_key(by))
        expected = expected[:limit] if limit is not None else expected
        assert [typed(x) for x in db.execute(q).rows()] == [typed(x.values()) for x in expected], q
