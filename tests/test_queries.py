"""Every query of the library against its SQL in DuckDB, over the smallest tables, and the driver's contract."""

import sys
from pathlib import Path

import pytest

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import __spark_entry__ as entry  # noqa: E402
import parity  # noqa: E402
from stratacube.plans import registry  # noqa: E402

SF, LARGER = "/root/testdata/sf0.001", "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def con():
    return parity.duck(SF)


@pytest.mark.parametrize("name", sorted(registry.ORACLE))
def test_query_equals_sql(spark, con, name):
    said = parity.compare(spark, con, SF, registry.QUERIES[name], registry.ORACLE[name])
    if said == "no rows":  # the tables are too small for this one: the next larger ones decide
        said = parity.compare(spark, parity.duck(LARGER), LARGER, registry.QUERIES[name], registry.ORACLE[name])
    assert said == ""


def test_contract(spark):
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).count() > 0


def test_nothing_needs_the_text_operators():
    root = Path(entry.__file__).parent
    for p in [*(root / "stratacube").rglob("*.py"), *(root / "tests").glob("*.py"), root / "parity.py"]:
        if "llm" not in p.relative_to(root).parts and p.name != "test_queries.py":
            assert "stratacube.llm" not in p.read_text() and "corpus_pipeline" not in p.read_text(), p


def with_table(tmp_path, name: str, sql: str) -> str:
    """The smallest tables with one of them in another form."""
    for p in Path(SF).iterdir():
        (tmp_path / p.name).symlink_to(p)
    (tmp_path / f"{name}.parquet").unlink()
    parity.duck(SF).execute(f"COPY ({sql}) TO '{tmp_path}/{name}.parquet' (FORMAT parquet)")
    return str(tmp_path)


def test_store_planes_with_many_observations(spark, tmp_path):
    """Pixels with 300 and more observations, which don't fit a byte."""
    d = with_table(tmp_path, "lineitem", "SELECT * FROM lineitem UNION ALL SELECT l.* FROM (SELECT * FROM lineitem ORDER BY ALL LIMIT 3) l, range(0, 300)")
    con = parity.duck(d)
    assert con.execute(f"SELECT max(coverage) FROM ({registry.ORACLE['store_planes']})").fetchone()[0] > 255
    assert parity.compare(spark, con, d, registry.QUERIES["store_planes"], registry.ORACLE["store_planes"]) == ""


def test_file_stem_at_midnight(spark, tmp_path):
    """Even and odd events, null ids and times, in the second of midnight and beside it."""
    ids = "SELECT * FROM (VALUES (0), (1), (2), (3), (NULL)) i(event_id), (VALUES ('2024-01-11 00:00:00'), ('2024-01-11 00:00:00.636583'), ('2024-01-11 00:00:01'), ('2024-01-10 23:59:59.9'), ('2024-01-11 12:00:00'), (NULL)) v(ts)"
    d = with_table(tmp_path, "events", f"SELECT event_id::BIGINT AS event_id, ts::TIMESTAMP AS ts, 1::BIGINT AS user_id, 'view' AS event_type, 1.0::DOUBLE AS value, '{{}}' AS props FROM ({ids})")
    con = parity.duck(d)
    assert 0 < con.execute(f"SELECT count(*) FROM ({registry.ORACLE['file_stem']})").fetchone()[0] < con.execute("SELECT count(*) FROM events").fetchone()[0]
    assert parity.compare(spark, con, d, registry.QUERIES["file_stem"], registry.ORACLE["file_stem"]) == ""
