import hashlib
import json

import pytest
from pyspark.sql import functions as F

from loomline.operators import chain

#: scenario: rejected under B0, the adaptive policy at a MEDIUM reference, B1
GOLDEN = {
    "PA-01": (False, False, False), "PA-02": (True, True, True), "PA-03": (True, True, True), "PA-04": (False, False, True), "PA-05": (False, True, True),
    "PA-06": (False, False, True), "PA-07": (False, False, False), "PA-08": (False, True, True), "PA-09": (False, True, True),
}


@pytest.fixture(scope="module")
def chains(spark):
    rows = [(str(5101 + i), "2016-04-01T21:05:00Z", "2016-04-03T00:00:00Z", "2016-04-05T00:00:00Z", "ab" * 32, "F", "0.50") for i in range(3)]
    df = spark.createDataFrame(rows, "order_id string, created string, shipped string, delivered string, lines_digest string, delivery_status string, risk_score string")
    return chain.build_chains(df).withColumn("expected_id", F.col("order_id"))


def test_block_hash_is_that_of_canonical_json(chains):
    block = chains.first().chain[4].asDict(recursive=True)
    r = block.pop("ai_risk_reference")
    own = block.pop("block_hash")
    provenance = r.pop("provenance")
    r["risk_score"] = float(r["risk_score"])
    ref = {**r, **{p: provenance for p in chain.PROVENANCE}}
    body = json.dumps({**block, "payload_ref": None, "schema_version": "1.1", "ai_risk_reference": ref}, sort_keys=True, separators=(",", ":"))
    assert hashlib.sha256(body.replace('"risk_score":0.5', '"risk_score":0.50').encode()).hexdigest() == own


def test_intact_heads_pass(chains):
    row = chain.verdicts(chain.with_checks(chains)).first()
    assert all(row[c] for c in chain.CHECKS) and row.level == "MEDIUM" and row.accepted_B0 and row.accepted_P and row.accepted_B1


@pytest.mark.parametrize("scenario", chain.SCENARIOS)
def test_golden_matrix(chains, scenario):
    rows = chain.detect(chain.verdicts(chain.with_checks(chain.tamper(chains, scenario)))).collect()
    for r in rows:
        assert (not r.accepted_B0, not r.accepted_P, not r.accepted_B1) == GOLDEN[scenario]
        assert r.detected  # the harness has off-chain evidence too


def test_fault_stays_with_its_order(chains):
    one = chain.tamper(chains.filter("order_id = '5102'"), "PA-05").drop("declared", "scenario")
    rows = chain.verdicts(chain.with_checks(chains.filter("order_id <> '5102'").unionByName(one))).collect()
    assert {r.expected_id: r.accepted_B1 for r in rows} == {"5101": True, "5102": False, "5103": True}


def test_missing_reference_is_medium(spark):
    rows = [("7", "2016-04-01T21:05:00Z", "2016-04-03T00:00:00Z", "2016-04-05T00:00:00Z", "ab" * 32, "F", None)]
    df = spark.createDataFrame(rows, "order_id string, created string, shipped string, delivered string, lines_digest string, delivery_status string, risk_score string")
    built = chain.build_chains(df).withColumn("expected_id", F.col("order_id"))
    row = chain.with_checks(built).first()
    assert len(row.chain) == 4 and row.level == "MEDIUM" and row.c8
