"""Committed builds: steps equal one build, also with late rows; whoever stops leaves no trace."""

import tempfile

import pytest

from voltaspan.operators import versions

ARGS = ("cell", "file", "program", "us", "seq", "current", 3.0)
COLUMNS = "cell long, file string, program long, us long, seq long, current double"


def recordings():
    rows, seq = [], 0
    for cell in (1, 2):
        for k, (program, begin) in enumerate(((7, 0), (3, 1000), (9, 2000), (5, 500))):  # the last file lies between the others
            for i in range(6):
                seq += 1
                rows.append((cell, f"c{cell}={k}", program, (begin + 10 * i) * 1_000_000, seq, 1.0 + i * (k + cell)))
    return rows


def told(store):
    table = {(r.cell, r.us): round(r.ah, 9) for r in store.table("rows").collect()}
    return table, {(r.cell, r.program): r.bm for r in store.table("programs").collect()}, {r.name for r in store.table("files").collect()}


@pytest.fixture
def folder():
    return f"file://{tempfile.mkdtemp(prefix='spark-')}/store"


def test_steps_equal_one_build(spark, folder):
    rows = recordings()
    frame = lambda keep: spark.createDataFrame([r for r in rows if keep(r)], COLUMNS)
    one = versions.Store(spark, folder + "-one")
    assert versions.update(one, frame(lambda r: True), *ARGS).number == 1
    steps = versions.Store(spark, folder)
    assert steps.current() is None
    for number, files in enumerate(("0", "01", "012", "0123"), 1):  # the last step brings late rows
        keep = lambda r: r[1][-1] in files and (number > 2 or r[0] == 1)  # noqa: B023, E731
        assert versions.update(steps, frame(keep), *ARGS).number == number
    assert told(steps) == told(one)
    assert told(one)[1] == {(c, p): b for c in (1, 2) for p, b in ((3, 0), (5, 1), (7, 2), (9, 3))}
    assert versions.update(steps, frame(lambda r: True), *ARGS) is None and steps.current().number == 4
    assert steps.cleared() > 0 and told(steps) == told(one)


def test_running_files_wait(spark, folder):
    rows = [(1, "a=unfinished", 1, 0, 1, 1.0), (1, None, 1, 5, 2, 1.0)]
    store = versions.Store(spark, folder)
    assert versions.update(store, spark.createDataFrame(rows, COLUMNS), *ARGS) is None and store.current() is None


@pytest.mark.parametrize("stop", (1, 3))
def test_stopped_between_writes(spark, folder, monkeypatch, stop):
    rows = recordings()
    store = versions.Store(spark, folder)
    versions.update(store, spark.createDataFrame(rows[:12], COLUMNS), *ARGS)
    before, writes = told(store), []
    write, publish = versions.Store.write, versions.Store.publish

    def counted(what):
        def run(*args):
            if len(writes) == stop:
                raise KeyboardInterrupt
            writes.append(what)
            return what(*args)

        return run

    with monkeypatch.context() as m:
        m.setattr(versions.Store, "write", counted(write))
        m.setattr(versions.Store, "publish", counted(publish))
        with pytest.raises(KeyboardInterrupt):
            versions.update(store, spark.createDataFrame(rows, COLUMNS), *ARGS)
    assert store.current().number == 1 and told(store) == before
    assert versions.update(store, spark.createDataFrame(rows, COLUMNS), *ARGS).number == 2


def test_two_builders_do_not_overwrite(spark, folder):
    store = versions.Store(spark, folder)
    first = versions.update(store, spark.createDataFrame(recordings()[:6], COLUMNS), *ARGS)
    with pytest.raises(versions.Conflict):
        store.commit({"rows": store.table("rows")}, None)
    assert store.current() == first


def test_a_step_with_late_rows_builds_once(spark, folder, monkeypatch):
    rows, builds = recordings(), []
    store, one = versions.Store(spark, folder), versions.Store(spark, folder + "-one")
    versions.update(store, spark.createDataFrame([r for r in rows if r[1] in ("c1=0", "c1=1", "c1=2", "c2=0")], COLUMNS), *ARGS)
    built = versions.build.built
    monkeypatch.setattr(versions.build, "built", lambda *a: builds.append(0) or built(*a))
    versions.update(store, spark.createDataFrame(rows, COLUMNS), *ARGS)  # late in cell 1, not in cell 2
    assert len(builds) == 1
    versions.update(one, spark.createDataFrame(rows, COLUMNS), *ARGS)
    assert told(store) == told(one)
