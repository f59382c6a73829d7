"""A folder of spectra: both formats, broken files, names; each file is in one table or the other."""

import pathlib
import tempfile

import pandas as pd
import pytest

from voltaspan.sources import spectra

HEAD = "Zeit,ActFreq,Zreal1,Zimg1,Betrag,Phase,U1"
UNITS = "-,Hz,Ohm,Ohm,Ohm,deg,V"
ROWS = ["2024-01-02 03:04:05,0,0,0,0,0,3.6", "2024-01-02 03:04:06,10,1.0,-0.5,1.1,-1,3.61", "2024-01-02 03:04:07,10,1.25,-0.5,1.2,-1,3.62", "2024-01-02 03:04:08,0.5,2.0,0.1,2.0,2,3.63"]


@pytest.fixture(scope="module")
def folder():
    at = pathlib.Path(tempfile.mkdtemp(prefix="spark-"))
    cell = at / "cellA"
    cell.mkdir()
    name = lambda k, end: cell / f"proj=cell{k}=2024-01-02_030405=prog=EIS{k:05d}.{end}"
    name(1, "csv").write_text("\n".join([HEAD, UNITS, *ROWS]))
    frame = pd.DataFrame([r.split(",") for r in ROWS], columns=HEAD.split(","))
    frame.iloc[:, 1:] = frame.iloc[:, 1:].astype(float)
    frame.to_parquet(name(2, "parquet"))
    (cell / "INS7.dat").write_bytes(name(2, "parquet").read_bytes())  # told by its bytes, not its ending
    name(3, "csv").write_text("\n".join([HEAD.replace("Betrag", "B"), UNITS, *ROWS]))
    name(4, "csv").write_text("\n".join([HEAD, UNITS, ROWS[0]]))
    name(5, "csv").write_bytes(b"PAR1 and then nothing")
    name(6, "csv").write_bytes(b"")
    (cell / "proj=cell1=2024-01-02_030405=TS00001.csv").write_text("a,b")
    (cell / "EIS00009=x.csv").write_text("\n".join(["ActFreq,Zreal1,Zimg1,Betrag", "Hz,Ohm,Ohm,Ohm", "5,1,2,x", "6,1,2,3"]))
    return f"file://{at}"


def test_read(spark, folder):
    found, reasons = spectra.read(spark, folder)
    rows = {}
    for r in found.collect():
        rows.setdefault(r.eis_number, []).append(r)
    assert rows.keys() == {"EIS00001", "EIS00002", "INS7", "EIS00009"}
    for number in ("EIS00001", "EIS00002", "INS7"):
        got = sorted(rows[number], key=lambda r: r.frequency)
        assert [(r.frequency, r.z_real, r.z_imag, r.u) for r in got] == [(0.5, 2.0, 0.1, 3.63), (10.0, 1.25, -0.5, 3.62)]
        assert got[1].time.second == 7
    assert rows["EIS00001"][0].cell == "cell1" and rows["INS7"][0].cell == "cellA" and str(rows["EIS00001"][0].test_date)[:10] == "2024-01-02"
    (only,) = rows["EIS00009"]
    assert (only.frequency, only.u, only.time, only.test_date) == (6.0, None, None, None)
    why = {r.path.split("=")[-1].split("/")[-1]: r.reason for r in reasons.collect()}
    assert why.pop("EIS00005.csv").startswith("unreadable")
    assert why == {"EIS00003.csv": "no column Betrag", "EIS00004.csv": "no settled point", "TS00001.csv": "no measurement's name"}
    m = {r.eis_number: (r.n_points, r.mean_u) for r in spectra.metas(found).collect()}
    assert m["EIS00001"] == (2, pytest.approx(3.625)) and m["EIS00009"] == (1, None)
