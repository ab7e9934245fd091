"""Landing files into silver, live rows into the observations, and the command line for both."""

from __future__ import annotations

import uuid

import pytest

from stopwise import __main__ as cli
from stopwise.plans import tables
from stopwise.session import scratch_dir


@pytest.fixture
def here(spark, monkeypatch):
    monkeypatch.setattr(cli, "build_session", lambda *_: spark)


def test_landing_files_reach_silver_once(spark, here, tmp_path):
    folder = tmp_path / "raw" / "arrivals"
    folder.mkdir(parents=True)
    db = f"transit_{uuid.uuid4().hex}"
    args = ["silver", "--input", str(tmp_path / "raw"), "--warehouse", str(tmp_path / "w"), "--transit_db", db,
            "--checkpoint", str(tmp_path / "c"), "--once"]
    for k in (1, 2):
        cell = f"[{{'line': '7', 'stop': '9', 'bus': {k}, 'estimateArrive': 60, 'isHead': None}}]"
        (folder / f"{k}.csv").write_text(f'timestamp,Arrive,StopInfo,stopId,line\n2024-01-0{k} 10:00:00,"{cell}",,9,7\n')
        for _ in range(2):
            cli.main(args)
        rows = spark.table(tables.arrivals_predictions(str(tmp_path / "w"), db).name)
        assert sorted(r.bus for r in rows.collect()) == list(range(1, k + 1))


def test_live_rows_are_folded(spark, here, tmp_path):
    live, weather = (f"{n}_{uuid.uuid4().hex}" for n in ("live", "weather"))
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text('{"last_updated_epoch": 1759655700, "last_updated": "2025-10-05 09:15", "temp_c": 20.5}\n')
    where = ["--warehouse", str(tmp_path / "w")]
    cli.main(["live", "--input", str(tmp_path / "in"), *where, "--db", live, "--checkpoint", str(tmp_path / "c"), "--once"])
    for _ in range(2):
        cli.main(["fold", *where, "--live_db", live, "--db", weather])
    assert [r.temp_c for r in spark.table(f"{weather}.meteorology_current").collect()] == [20.5]


def test_scratch_needs_a_shared_folder_on_a_cluster(spark, monkeypatch):
    class Session:
        conf = type("Conf", (), {"get": staticmethod(lambda *_: None)})
        sparkContext = type("Context", (), {"master": "yarn"})

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        scratch_dir(Session, "x")
