"""The pipeline over a small corpus with planted cases, against plain code for every stage."""

import random
from collections import Counter

import plain
import pytest

import corpus_pipeline
from tidemark.llm import registry, sharding

BAD = ["zwirfel", "grompax", "blughkin"]
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def corpus():
    r = random.Random(12)
    words = ["".join(r.choices("aeioutrnsl", k=r.randint(3, 9))) for _ in range(400)]
    text = lambda n: " ".join(r.choices(words, k=n))
    rows, labels = [], []
    for i in range(400):
        w, toxic = text(r.randint(20, 90)).split(), i % 5 == 0
        for _ in range(3 * toxic):
            w.insert(r.randrange(len(w)), r.choice(BAD) + r.choice(["", "s", "ed", "."]))
        rows.append((i, " ".join(w), f"s{i % 3}"))
        labels.append((i, i % 2, int(toxic)))
    item, other = text(30), text(13)
    rows += [(1000 + i, rows[7][1] + (" x" if i % 2 else ""), f"s{i % 4}") for i in range(6)]  # copies, exact and near
    rows += [(1100, f"{text(600)} {' '.join(item.split()[5:18])} {text(700)}", "s1"), (1101, other, "s2"), (1102, f"{text(40)} {' '.join(item.split()[:12])} {text(400)}", None)]
    rows += [(1200, "", "s0"), (1201, None, "s1"), (1202, f"{text(3000)}", "s9")]
    return rows, labels, [item, other]


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("corpus")
    rows, labels, items = corpus()
    spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], SCHEMA).write.parquet(f"{top}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{top}/labels.parquet")
    spark.createDataFrame([(str(i), t) for i, t in enumerate(items)], "item_id string, text string").write.parquet(f"{top}/benchmark.parquet")
    return str(top)


def test_run_against_plain_code(spark, folder):
    rows, _, items = corpus()
    rows = [r for r in rows if not any(b in (r[1] or "") for b in BAD)]
    rows = plain.clean(plain.one_of_each_group(rows), items)
    tree = sharding.topology()
    want = Counter()
    for i, n in plain.mix(rows, 1024).items():
        want[*rows[i], plain.shard(rows[i][0], tree)] += n
    got = corpus_pipeline.run(spark, folder)
    assert got.columns == ["doc_id", "text", "lang", "source", "n_chars", "shard"]
    assert Counter((r["doc_id"], r["text"], r["source"], r["shard"]) for r in got.collect()) == +want
    assert {1100, 1101}.isdisjoint(r["doc_id"] for r in got.collect()) and len({r[0] for r in want} & {7, 1000, 1002, 1004}) == 1


def test_stages_take_what_the_one_before_kept(spark, folder):
    """Every stage on the rows of its predecessor; columns named like the operators' own pass through."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").selectExpr("*", "1 AS score", "2 AS n_words", "'x' AS `__s`", "3 AS many", "4 AS finish", "5 AS key")
    seen = [docs.count()]
    for _, stage in corpus_pipeline.STAGES:
        before, docs = docs.columns, stage(spark, docs, folder)
        assert docs.columns[: len(before)] == before
        seen.append(docs.count())
    assert seen[0] > seen[1] > seen[2] > seen[3] and seen[4] == seen[5]
    assert [n for n, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "mixing", "sharding"]


def test_empty(spark, folder):
    docs = spark.createDataFrame([], SCHEMA)
    for _, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, folder)
        assert docs.count() == 0


def test_registry():
    assert sorted(int(q[2:].split("_")[0]) for q in registry.QUERIES) == list(range(1, 11)) and set(registry.ORACLES) <= set(registry.QUERIES)


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
@pytest.mark.parametrize("planted", [False, True])
def test_sql(spark, folder, name, planted):
    """The SQL of a query, on a test table and on the planted corpus with its nulls."""
    import duckdb

    d = folder if planted else "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "benchmark"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{d}/{t}.parquet{'/*.parquet' if planted else ''}'")
    cur = con.execute(registry.ORACLES[name])
    names = [c[0] for c in cur.description]
    df = registry.QUERIES[name](spark, d)
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(str, (tuple(r[c] for c in names) for r in df.collect()))) == Counter(map(str, cur.fetchall()))
