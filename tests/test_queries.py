import pytest
from compare import same

from lading.plans.queries import FLAGSHIP, ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_against_sql(spark, name):
    same(QUERIES[name](spark, FOLDER), ORACLES[name], FOLDER)


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES)))
def test_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_flagship():
    assert FLAGSHIP in QUERIES


def test_whole_texts_without_prefixes(spark):
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    assert QUERIES["e20_collision_key"](spark, FOLDER).filter("length(key) > 40").count() > 0
    assert QUERIES["e27_escaped_names"](spark, FOLDER).filter("length(shown) > 400").count() > 0
    probed = sum(r["count"] for r in QUERIES["d03_content_probes"](spark, FOLDER).collect())
    assert probed == 2 * docs.filter("text is not null").count()


def test_archives_cut_at_a_members_end_and_in_its_padding(spark, tmp_path):
    """A tar's halves: of archive 0 whole blocks of two members, of 1 all data but not all
    of the last block of its second member, of 2 part of a member's data."""
    sizes = {0: 100, 1: 100, 200: 100, 201: 100, 202: 600, 400: 100, 401: 3000, 402: 700}
    docs = spark.createDataFrame([(k, "x" * n, "en", "s", n) for k, n in sizes.items()], "doc_id long, text string, lang string, source string, n_chars long")
    docs.coalesce(1).write.parquet(f"{tmp_path}/documents.parquet")
    assert same(QUERIES["a06_members_report"](spark, str(tmp_path)), ORACLES["a06_members_report"], str(tmp_path)) == 3


@pytest.mark.parametrize("setting", [None, "false"])
@pytest.mark.parametrize("name", ["a01_open_archive", "a16_closed_archives", "b03_volumes_in_place", "b15_directory_members", "g06_symlink_writes", "g11_metadata_applied", "j12_pushed_names"])
def test_against_sql_in_sessions_that_keep_filters_from_python_sources(spark, name, setting):
    key = "spark.sql.python.filterPushdown.enabled"
    before = spark.conf.get(key)
    try:
        spark.conf.unset(key) if setting is None else spark.conf.set(key, setting)
        same(QUERIES[name](spark, FOLDER), ORACLES[name], FOLDER)
        assert spark.conf.get(key) == (setting or "true")
    finally:
        spark.conf.set(key, before)
