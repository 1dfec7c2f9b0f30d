import os
from concurrent.futures import ThreadPoolExecutor
from dataclasses import replace

import pytest

from checks.registry import comparable
from tradeweave.plans import pipeline
from tradeweave.plans.study import Study
from tradeweave.sources import sinks
from tradeweave.sources.tables import TradeTables
from tests.conftest import SMALL


def rows(df):
    return sorted(map(repr, comparable(df.select(*sorted(df.columns))).collect()))


def test_full_run_over_shared_facts_equals_single_queries(spark, study, tmp_path):
    """Every dataset, each computed from the shared grains and from the rows."""
    before = set(os.listdir(sinks.shared_dir(spark).removeprefix("file:")))
    paths = pipeline.run(study, str(tmp_path / "out"))
    assert set(paths) == set(pipeline.DATASETS)
    with ThreadPoolExecutor(8) as pool:  # most datasets are small: several at once
        same = pool.map(lambda name: rows(spark.read.parquet(paths[name])) == rows(pipeline.DATASETS[name](study)), paths)
        assert [name for name, equal in zip(paths, same, strict=True) if not equal] == []
    assert set(os.listdir(sinks.shared_dir(spark).removeprefix("file:"))) <= before


def test_csv_run(spark, study, tmp_path):
    paths = pipeline.run(study, str(tmp_path / "out"), ["fig_1a"], csv=True)
    assert spark.read.option("header", True).csv(paths["fig_1a"]).count() == pipeline.DATASETS["fig_1a"](study).count()


NAMES = ["fig_1a", "supply", "dom_source_ts", "prod", "trade_fm", "global_pop"]


def files(folder):
    return {os.path.join(at, f): os.stat(os.path.join(at, f)).st_mtime_ns for at, _, fs in os.walk(folder) for f in fs if f.endswith(".parquet")}


def counted(monkeypatch, fail=None):
    """Datasets that are computed, in order; the named one fails."""
    done = []

    def wrap(name, dataset):
        def run(s):
            if name == fail:
                raise RuntimeError(f"{name} was cut off")
            done.append(name)
            return dataset(s)

        return run

    for name in NAMES:
        monkeypatch.setitem(pipeline.DATASETS, name, wrap(name, pipeline.DATASETS[name]))
    return done


def test_a_run_that_was_cut_off_goes_on_where_it_was(spark, study, tmp_path, monkeypatch):
    out = str(tmp_path / "out")
    with monkeypatch.context() as m:
        first = counted(m, fail=NAMES[3])
        with pytest.raises(RuntimeError):
            pipeline.run(study, out, NAMES, at_once=1)
    half = files(out)
    assert NAMES[3] not in first and first[:3] == NAMES[:3]
    with monkeypatch.context() as m:
        second = counted(m)
        paths = pipeline.run(study, out, NAMES, at_once=1)
    assert sorted(first + second) == sorted(NAMES) and NAMES[3] in second
    assert half.items() <= files(out).items()  # what was finished was not touched
    for name in NAMES:
        assert rows(spark.read.parquet(paths[name])) == rows(pipeline.DATASETS[name](study))
    with monkeypatch.context() as m:
        third = counted(m)
        pipeline.run(study, out, NAMES)
    assert third == []


def test_a_killed_process_leaves_shared_tables_to_go_on_from(spark, study, tmp_path, monkeypatch):
    """As when a process is killed: nothing is tidied up after the failure."""
    out, written = str(tmp_path / "out"), []
    keep = sinks.SharedTables.keep

    def counting(self, df, name, partition_by=()):
        if not sinks.exists(spark, f"{self.folder}/{name}/_SUCCESS"):
            written.append(name)
        return keep(self, df, name, partition_by)

    monkeypatch.setattr(sinks.SharedTables, "keep", counting)
    with monkeypatch.context() as m:
        m.setattr(sinks.SharedTables, "drop", lambda self: None)
        counted(m, fail=NAMES[2])
        with pytest.raises(RuntimeError):
            pipeline.run(study, out, NAMES, at_once=1)
    shared = list(written)
    assert {"trade", "production", "consumption", "edges", "supply"} == set(shared)
    pipeline.run(study, out, NAMES, at_once=1)
    assert written == shared  # none was computed again
    # with another setting nothing of it is used
    pipeline.run(replace(study, concentration_percent=50), out, NAMES[:1])
    assert len(written) == 2 * len(shared)


def test_only_years_that_changed_are_replaced(spark, tmp_path):
    root, out = str(tmp_path / "tables"), str(tmp_path / "out")
    from checks import fixtures

    sinks.write_tables(fixtures.study(spark, SMALL).tables, root)
    s = Study(TradeTables.from_parquet(spark, root))
    pipeline.run(s, out, ["prod"])
    before = files(f"{out}/prod")
    table = spark.read.parquet(f"{root}/production")
    changed = table.where("not (year = 2001 and iso3c = 'N03') and year <> 2004").collect()
    sinks.write_parquet(spark.createDataFrame(changed, table.schema), f"{root}/production")
    s = Study(TradeTables.from_parquet(spark, root))
    pipeline.run(s, out, ["prod"])
    after = files(f"{out}/prod")
    differ = {f.split("year=")[1][:4] for f, _ in before.items() ^ after.items()}
    assert differ == {"2001", "2004"} and not any("year=2004" in f for f in after)
    assert rows(spark.read.parquet(f"{out}/prod")) == rows(pipeline.DATASETS["prod"](s))


def test_without_files_to_tell_inputs_by_a_run_starts_over(make_study, tmp_path, monkeypatch):
    s = make_study()
    with monkeypatch.context() as m:
        done = counted(m)
        for _ in range(2):
            pipeline.run(s, str(tmp_path / "a"), ["fig_1a"])
        for _ in range(2):
            pipeline.run(s, str(tmp_path / "b"), ["fig_1a"], inputs="release 7")
    assert done == ["fig_1a"] * 3
