"""Rollups from state against a full run over all uploads."""

import random

from pyspark.sql import functions as F

from tierwatch import constants as C
from tierwatch.operators import rollups, scoring
from tierwatch.scenario import Scenario
from tierwatch.streaming import rollup_state

AS_OF = "2025-06-30"
SCENARIOS = [Scenario(), Scenario(weighting="financial_heavy", min_risk_threshold=0.35, max_risk_threshold=0.8, regions=("EMEA", "APAC")),
             Scenario(weighting="financial_heavy", regions=())]


def _rows(rng, upload, top, n=120):
    return [(f"{upload}-{i}", "S", rng.choice([0.0, 0.4, 0.7, rng.random(), 1.0]), 0.0, 0.0, rng.choice(C.REGIONS), rng.randint(1, 4),
             rng.choice([0.0, rng.random() * top, top]), rng.choice([None, "2025-01-01", "2023-09-01"])) for i in range(n)]


def _plain(df):
    return [tuple(round(v, 9) if isinstance(v, float) else v for v in r) for r in df.collect()]


def test_each_added_upload_gives_the_full_run(spark, suppliers, tmp_path):
    rng = random.Random(5)
    uploads = [suppliers(_rows(rng, name, top)).withColumn("upload", F.lit(name))
               for name, top in (("a", 0.0), ("b", 5e4), ("c", 8e8))]          # no spend at all, then twice a new maximum
    for s, scenario in enumerate(SCENARIOS):
        path, seen = str(tmp_path / f"state{s}"), None
        for upload in uploads:
            seen = upload if seen is None else seen.unionByName(upload)
            rollup_state.add(upload, "upload", scenario, AS_OF, path)
            full = scoring.score(seen, scenario, AS_OF)
            got = rollup_state.load(spark, path, scenario, AS_OF)
            assert _plain(rollup_state.kpis(got)) == _plain(rollups.kpis(full))
        assert _plain(rollup_state.region_rollup(got)) == _plain(rollups.region_rollup(full))
        assert sorted(_plain(rollup_state.band_counts(got).select("band", "n"))) == sorted(_plain(rollups.band_counts(full).select("band", "n")))
    rollup_state.add(uploads[1], "upload", scenario, AS_OF, path)              # once more: nothing counts twice
    assert _plain(rollup_state.kpis(rollup_state.load(spark, path, scenario, AS_OF))) == _plain(rollups.kpis(full))
    alone = scoring.score(uploads[1], scenario, AS_OF)
    assert _plain(rollup_state.kpis(rollup_state.load(spark, path, scenario, AS_OF, ["b"]))) == _plain(rollups.kpis(alone))
