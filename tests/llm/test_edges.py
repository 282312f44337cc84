"""Edge cases that the larger tests do not hold: identifiers by whole name, empty tables, repeats and missing ids; SQL of all operators."""

import duckdb
import pytest

from bidlake.llm import chat_trees, license_scan, quality_rules, secret_scan
from bidlake.llm import queries as q

SCHEMA = "doc_id long, text string, n_words int, id string"


def docs(spark, rows):
    return spark.createDataFrame([(i, t, 1, "x") for i, t in rows], SCHEMA).repartition(2)


@pytest.mark.parametrize("identifier, family", [
    ("MIT", "mit"), ("MIT-0", "mit"), ("MITNFA", "mitnfa"), ("BSDX", "bsdx"), ("BSD-3-Clause", "bsd"), ("BSD-3-Clause-Clear", "bsd"), ("GPL-2.0-only", "gpl"), ("GPL-3.0-or-later", "gpl"), ("GPL-2.0+", "gpl"),
    ("LGPL-2.1", "lgpl"), ("AGPL-3.0", "agpl"), ("Apache-2.0", "apache"), ("CC-BY-SA-4.0", "cc-by-sa"), ("CC-BY-4.0", "cc-by"), ("CC0-1.0", "cc0"), ("ISC", "isc"), ("ISCX", "iscx"), ("Unlicense", "unlicense"), ("Custom-1.0", "custom-1.0"),
])
def test_families(identifier, family):
    assert license_scan.family(identifier) == family


def test_own_notices(spark):
    rows = docs(spark, [(1, "Under the House Licence, and MIT license."), (2, "all rights reserved")])
    got = {r.doc_id: (r.labels, r.base_labels) for r in license_scan.scan_licenses(rows, notices={"house licence": "house"}).collect()}
    assert got == {1: ("house,mit", "mit"), 2: ("", "")}


def test_repeats_missing_ids_and_empty_tables(spark):
    rows = [(1, "password = abcdef123 and more"), (1, "password = abcdef123 and more"), (None, "token: zzzzzz9"), (2, None), (3, "")]
    scan = lambda d: secret_scan.scan_secrets(d, q.vocabulary(q.RANKS))
    for operator in (scan, quality_rules.quality_digest, license_scan.scan_licenses):
        got = operator(docs(spark, rows)).collect()
        same = [tuple(r) for r in got if r.doc_id == 1]
        assert len(got) == 5 and len(same) == 2 and same[0] == same[1] and sum(r.doc_id is None for r in got) == 1
        assert operator(spark.createDataFrame([], SCHEMA)).count() == 0
    assert sorted((r.doc_id or 0, r.n_assign) for r in scan(docs(spark, rows)).collect()) == [(0, 1), (1, 1), (1, 1), (2, 0), (3, 0)]


def test_conversations_empty_and_long(spark):
    schema = "conv_id long, turn long, role string, text string"
    assert chat_trees.digest_conversations(spark.createDataFrame([], schema)).count() == 0
    long = "### word </turn> \\ " * 20_000
    r = chat_trees.digest_conversations(spark.createDataFrame([(1, 0, "user", "hi"), (1, 1, "assistant", long)], schema)).first()
    assert r.n_turns == 2 and r.loss_chars == len(long)


@pytest.mark.parametrize("name", [n for n in sorted(q.SQL) if not n.startswith("op2_")])
def test_sql(spark, small, name):
    con = duckdb.connect()
    for t in ("documents", "benchmark", "pages", "conversations", "embeddings"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{small}/{t}.parquet'")
    df = q.queries()[name](spark, small)
    cursor = con.execute(q.SQL[name])
    names = [d[0] for d in cursor.description]
    assert sorted(names) == sorted(df.columns)
    assert sorted((tuple(r[c] for c in names) for r in df.collect()), key=str) == sorted(cursor.fetchall(), key=str)
