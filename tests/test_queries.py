"""Queries against their DuckDB SQL on the smallest tables."""

from __future__ import annotations

import math

import pytest

duckdb = pytest.importorskip("duckdb")

from trellisgraph.plans import registry  # noqa: E402

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()
# One or two of each family; the driver compares them all.
NAMES = ["j02_neighbors", "j04_trails", "a04_statistics", "k02_upsert_edges", "r03_inverse", "g02_consistency", "m03_components", "x04_compare", "c03_token_estimate", "c18_citation_verdicts", "f01_bm25", "v03_cosine_top_k", "f08_match_score", "f12_fuzzy_duplicates", "p01_mapped_rows", "p01_mapped_in_sql", "k15_prompt_rows", "s30_exported_samples", "o08_token_budget", "n07_sessions"]


def plain(df):
    df = df[sorted(df.columns)]
    show = lambda v: "null" if v is None or isinstance(v, float) and math.isnan(v) else repr(round(v, 9) + 0.0) if isinstance(v, float) else str(v)
    return list(df.columns), sorted(tuple(map(show, r)) for r in df.itertuples(index=False, name=None))


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return c


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, sf_dir, con, name):
    got = registry.queries()[name](spark, sf_dir).toPandas()
    assert plain(got) == plain(con.execute(registry.oracles()[name]).fetchdf())


def test_registry():
    assert set(registry.oracles()) <= set(registry.queries())
