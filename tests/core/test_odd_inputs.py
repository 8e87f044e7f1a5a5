"""Queries against their SQL on tables that the supplied ones don't look like."""

import duckdb
import pytest
from pyspark.sql import functions as F

from skarn.plans import registry


def both(spark, folder, name):
    """Rows of a query and of its SQL over the tables in ``folder``, as dicts sorted by their text."""
    con = duckdb.connect()
    for path in folder.glob("*.parquet"):
        con.execute(f"CREATE VIEW {path.stem} AS SELECT * FROM '{path}{'/*.parquet' if path.is_dir() else ''}'")
    got = [r.asDict() for r in registry.queries()[name](spark, str(folder)).collect()]
    rows = con.execute(registry.oracle_sql()[name])
    columns = [c[0] for c in con.description]
    want = [dict(zip(columns, r, strict=True)) for r in rows.fetchall()]
    return tuple(sorted(t, key=lambda r: repr(sorted(r.items()))) for t in (got, want))


@pytest.fixture(scope="module")
def odd_docs(spark, sf, tmp_path_factory):
    """The smallest documents, texts without a letter a-z, and one text under two times."""
    folder = tmp_path_factory.mktemp("odd")
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    texts = {900: "éé", 901: "ÉÈ.", 902: "42", 903: "[2024-01-01T00:00:00]\nwe met", 904: "[2024-02-02T00:00:00]\nwe met"}
    more = spark.createDataFrame([(k, t, "fr", "src0", len(t)) for k, t in texts.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.unionByName(more.select(*(F.col(c).cast(t) for c, t in docs.dtypes))).coalesce(1).write.parquet(f"{folder}/documents.parquet")
    return folder


@pytest.mark.parametrize("name", ["f05_formations", "f01_filing"])
def test_passages_without_words(spark, odd_docs, name):
    got, want = both(spark, odd_docs, name)
    assert got == want and 900 in {r["representative"] for r in got}


@pytest.mark.parametrize("parts", [1, 7, 16])
def test_centroids_do_not_depend_on_layout(spark, sf01, tmp_path, parts):
    """Of sf0.01, a mean lies on a tie of the sixth place; SQL adds rows in order."""
    rows = spark.read.parquet(f"{sf01}/embeddings.parquet")
    rows.repartition(parts, F.xxhash64("vec_id")).write.parquet(f"{tmp_path}/moved/embeddings.parquet")
    rows.coalesce(1).write.parquet(f"{tmp_path}/whole/embeddings.parquet")
    got = registry.queries()["f05_cognitive"](spark, f"{tmp_path}/moved").collect()
    _, want = both(spark, tmp_path / "whole", "f05_cognitive")
    assert sorted((r.asDict() for r in got), key=lambda r: r["address"]) == sorted(want, key=lambda r: r["address"])


@pytest.mark.parametrize("name", ["t03_pair_counts", "t04_pmi", "t13_retained_pairs"])
def test_pairs_are_made_once_by_compiled_rows(spark, sf, name):
    """No function is called token by token, and the mass of all pairs doesn't count them by terms again."""
    plan = registry.queries()[name](spark, sf)._jdf.queryExecution().optimizedPlan().toString()
    assert "zip_with" not in plan and plan.count("explode(slice(") == 1
