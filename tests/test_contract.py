"""Driver contract: registry shape and a fast oracle comparison at sf0.001."""

import math

import duckdb
import pytest

import __spark_entry__ as E
from tidemark.sources.tables import TABLES

SF = "/root/testdata/sf0.001"
FAST = ["h01_max_year", "h02_date_detection", "h07_vocab", "h10_stratified_folds", "r04_roc_curve", "p02_perturb_audio",
        "l07_media_refs", "e04_embed_modality", "s14b_streaming_scores", "d06_attach_stats", "p04_sample_frames",
        "r12_metrics_by_dataset", "n09_neighbors", "z04_norm_std", "s08_month_split", "h31_trigger_rate"]


def test_registry_keys():
    q, s = E.queries(), E.oracle_sql()
    assert set(s) <= set(q)
    assert len(q) >= 60


def _norm(v):
    if isinstance(v, float):
        return None if math.isnan(v) else round(v, 6)
    return v


@pytest.mark.parametrize("name", FAST)
def test_oracle_small(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{SF}/{t}.parquet')")
    sp = E.queries()[name](spark, SF).toPandas()
    ora = con.execute(E.oracle_sql()[name]).df()
    assert sorted(sp.columns) == sorted(ora.columns)
    cols = sorted(sp.columns)
    a = sorted((tuple(_norm(x) for x in r) for r in sp[cols].itertuples(index=False)), key=repr)
    b = sorted((tuple(_norm(x) for x in r) for r in ora[cols].itertuples(index=False)), key=repr)
    assert a == b
