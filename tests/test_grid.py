import datetime as dt
import os
import tempfile

import pytest

from vigil.operators import grid as G
from vigil.sources.grid import read_text_grid, select_inputs


def write_sheet(folder, name, lines):
    with open(os.path.join(folder, name), "w", encoding="utf-8") as f:
        f.write("\n".join(lines) + "\n")


def test_text_grid_end_to_end(spark):
    folder = tempfile.mkdtemp(prefix="vigil-grid-")
    write_sheet(folder, "ER_2019.csv", [
        "Reporte;;;", ";;;", "FECHA;43466;2019-01-02;43468", "Total demanda;10;11;-",
        "Neumonía (J12–J18);1;2,5;3", "Otra cosa;9;9;9", "Neumonía (J12–J18);7;7;7"])
    write_sheet(folder, "ER_2020.csv", [
        "FECHA;43468;43469", "TOTAL DEMANDA;20;21", "Influenza (J09-J11);4;5"])
    write_sheet(folder, "bad.csv", ["TOTAL DEMANDA;1;2"])  # anchor in the first row: rejected
    cells = read_text_grid(spark, folder)
    anc = {r.source_file: (r.anchor_row, r.header_row) for r in G.anchors(cells).collect()}
    assert anc == {"ER_2019.csv": (3, 2), "ER_2020.csv": (1, 0), "bad.csv": (0, None)}
    out = G.er_consolidated(spark, cells).orderBy("FECHA").collect()
    assert list(out[0].asDict()) == ["FECHA", "TOTAL_DEMANDA", "NEUMONIA", "INFLUENZA", "source_file",
                                     "source_year"]
    got = [(r.FECHA, r.TOTAL_DEMANDA, r.NEUMONIA, r.INFLUENZA, r.source_file, r.source_year) for r in out]
    assert got == [
        (dt.date(2019, 1, 1), 10.0, 1.0, None, "ER_2019.csv", "2019"),
        (dt.date(2019, 1, 2), 11.0, 2.5, None, "ER_2019.csv", "2019"),
        (dt.date(2019, 1, 3), None, 3.0, None, "ER_2019.csv", "2019"),  # smallest file wins
        (dt.date(2019, 1, 4), 21.0, None, 5.0, "ER_2020.csv", "2020"),
    ]
    excl = G.er_consolidated(spark, cells, start="2019-01-02", end="2019-01-03").collect()
    assert sorted(r.FECHA.day for r in excl) == [1, 4]


def test_select_inputs():
    names = ["b_2020.xlsx", "~$lock.xlsx", "All_ER_Dataset.xlsx", "a_2019.XLSX", "notes.txt"]
    assert select_inputs(names) == ["a_2019.XLSX", "b_2020.xlsx"]


def test_empty_first_column_and_rejected_files(spark):
    folder = tempfile.mkdtemp(prefix="vigil-grid-")
    write_sheet(folder, "ER_2019.csv", [";;;", ";FECHA;43466;43467", ";;;", ";Total demanda;10;11", ";Influenza (J09-J11);1;2"])
    write_sheet(folder, "none.csv", ["FECHA;43466", "Influenza;3"])
    write_sheet(folder, "top.csv", ["TOTAL DEMANDA;1;2"])
    cells = read_text_grid(spark, folder)
    out = G.er_consolidated(spark, cells).orderBy("FECHA").collect()
    assert [(r.FECHA, r.TOTAL_DEMANDA, r.INFLUENZA) for r in out] == [(dt.date(2019, 1, 1), 10.0, 1.0), (dt.date(2019, 1, 2), 11.0, 2.0)]
    assert sorted(tuple(r) for r in G.rejected_files(cells).collect()) == [
        ("none.csv", "no anchor row"), ("top.csv", "no row above the anchor")]
    with pytest.raises(ValueError, match="2 file"):
        G.er_consolidated(spark, cells, strict=True)
    rows = {(r.source_file, r.row_idx): (r.row_pos, r.label) for r in G.label_rows(cells).collect()}
    assert rows[("ER_2019.csv", 3)] == (1, "Total demanda")
    bad = G.er_consolidated(spark, cells.where("source_file = 'none.csv'"))
    assert bad.columns == ["FECHA", "source_file", "source_year"] and bad.count() == 0
