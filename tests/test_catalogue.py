"""The catalogue query has something to find for every rule, and small inputs can be dealt to more tasks."""

from scanloom.plans import queries
from scanloom.plans.jobs import scan_texts
from scanloom.rules import builtin_rules, secret_rules
from scanloom.sources import derived


def test_every_live_rule_fires(spark, sf):
    found = {r.rule_id for r in queries.catalogue_findings(spark, sf).select("rule_id").distinct().collect()}
    assert found == {r.id for r in builtin_rules() if r.single}
    secrets = {r.rule_id for r in queries.catalogue_secrets(spark, sf).select("rule_id").distinct().collect()}
    assert secrets == {r.id for r in secret_rules()}


def test_a_pack_on_storage_replaces_a_rule(spark, sf):
    rows = queries.custom_pack_findings(spark, sf).filter(f"rule_id = '{derived.REPLACED_RULE}'").collect()
    assert rows and {r.rule_name for r in rows} == {"Brand#1"} and {r.line_number for r in rows} == {3}


def test_dealing_changes_tasks_and_not_results(spark, sf):
    texts = derived.text_rows(spark, sf)
    plain, spread = scan_texts(texts, ["id"]), scan_texts(texts, ["id"], partitions=6)
    assert spread.rdd.getNumPartitions() == 6
    assert sorted(map(str, plain.collect())) == sorted(map(str, spread.collect()))
    alone = queries.scan_pages(spark, sf)
    spark.conf.set("spark.scanloom.partitions", "5")
    try:
        dealt = queries.scan_pages(spark, sf)
        assert dealt.rdd.getNumPartitions() == 5
        assert sorted(map(str, dealt.collect())) == sorted(map(str, alone.collect()))
    finally:
        spark.conf.unset("spark.scanloom.partitions")
