"""Raw export ingest (A1-A6) and the refresh job (A16) on a hand-written CP1252 file."""

import json
import os
from decimal import Decimal
from glob import glob

import pytest

from fundlens.plans import refresh as R
from fundlens.plans.params import Params
from fundlens.sources import register_csv as RC

HEADER = [h for h, _ in RC.REGISTER_COLUMNS]


def cell(v):
    return "" if v is None else f'="{v}"'


def row(fkz, ministry="BMWE", state="Hessen", country="Deutschland", start="01.08.2020", end="31.07.2022",
        amount="1.234,56", joint="", title="Entwicklung neuer Batterien für Fahrzeuge", profile="P1", ftype="Direkt",
        extra_dup="dup", raw_amount=False):
    vals = {
        "FKZ": cell(fkz), "Ressort": cell(ministry), "Referat": cell("R1"), "PT": cell("PT-DLR"),
        "Arb.-Einh.": cell("A"), "Zuwendungsempfänger": cell("Straße – 5 € GmbH"), "Gemeindekennziffer": cell("01234"),
        "Stadt/Gemeinde": cell("Ort"), "Ort": cell("Kassel"), "Bundesland": cell(state), "Staat": cell(country),
        "Ausführende Stelle": cell("Inst"), "Thema": cell(title), "Leistungsplansystematik": cell("GA1"),
        "Klartext Leistungsplansystematik": cell("Text"), "Laufzeit von": start, "Laufzeit bis": end,
        "Fördersumme in EUR": amount if raw_amount else cell(amount), "Förderprofil": cell(profile),
        "Verbundprojekt": cell(joint) if joint is not None else "", "Förderart": cell(ftype)}
    # file layout: the 21 columns, then a repeated "FKZ" column and an unnamed trailing column
    return ";".join([vals[h] for h in HEADER] + [cell(extra_dup), ""])


@pytest.fixture()
def export(scratch):
    header = ";".join([f'="{h}"' for h in HEADER] + ['="FKZ"', ""])
    lines = [header,
             row("01A", amount="241.967,00"),
             row("01B", state="", country="", amount="abc", joint="VP1", start="31.02.2020"),
             row("01C", country="Frankreich", amount="1.727.667.356,00", raw_amount=True, joint=None),
             row("01D", ministry="BMV", start="1.8.2019", end="01.01.2019", joint="nan"),
             row("01E") + ";x;y;z",  # too many cells -> rejects
             ]
    path = os.path.join(scratch, "export.csv")
    with open(path, "wb") as f:
        f.write(("\r\n".join(lines) + "\r\n").encode("cp1252"))
    return path


def test_header_and_layout(spark, export):
    raw = RC.validate_header(spark, export)
    lay = RC.layout(raw)
    assert lay.positions["fkz"] == 0 and lay.n_fields == len(HEADER) + 2


def test_header_missing_column(spark, scratch):
    p = os.path.join(scratch, "bad.csv")
    with open(p, "wb") as f:
        f.write('="FKZ";="Ressort"\r\n="1";="2"\r\n'.encode("cp1252"))
    with pytest.raises(RC.IngestError):
        RC.validate_header(spark, p)


def test_ingest_values(spark, export):
    projects, rejects = RC.ingest(spark, export)
    rows = {r.fkz: r for r in projects.collect()}
    assert set(rows) == {"01A", "01B", "01C", "01D"}
    assert len(rejects.collect()) == 1  # (a bare count() would read only the corrupt column)
    a, b, c, d = rows["01A"], rows["01B"], rows["01C"], rows["01D"]
    assert a.amount == Decimal("241967.00") and a.recipient == "Straße – 5 € GmbH"
    assert b.amount == Decimal("0.00") and b.start_date is None and b.state == "" and b.is_joint
    assert c.amount == Decimal("1727667356.00") and c.is_joint  # empty cell -> NULL -> joint
    assert d.duration_months == 0.0 and d.start_year == 2019 and not d.is_joint
    assert a.row_id < b.row_id < c.row_id < d.row_id


def test_refresh_job(spark, export, scratch):
    prm = Params(current_year=2021, yoy_from=2019, train_from=2019, outlier_years=(), horizon=2)
    r = R.refresh(spark, export, os.path.join(scratch, "out"), prm)
    out = r["out"]
    assert not R.artifacts_missing(r["artifacts"])
    doc = json.loads(open(glob(f"{out}/docs/ministry_funding/*.json")[0], encoding="utf-8").read())
    assert doc["total_projects"] == 4
    codes = [m["code"] for m in doc["ministries"]]
    assert codes[0] == "BMWE" and doc["ministries"][0]["name"].startswith("Bundesministerium für Wirtschaft")
    geo = json.loads(open(glob(f"{out}/docs/geographic_distribution/*.json")[0], encoding="utf-8").read())
    assert geo["international"]["total_projects"] == 2  # blank country counts as international
    assert [c["name"] for c in geo["international"]["countries"]] == ["Frankreich"]
    checks = [json.loads(line) for f in glob(f"{out}/reports/validation_report/*.json") for line in open(f)]
    assert {c["name"] for c in checks} >= {"ministry_projects", "joint_projects"}
    manifest = json.loads(open(glob(f"{out}/manifest/*.json")[0]).read())
    assert manifest["run_id"] == r["run_id"] and "docs/summary_stats" in manifest["artifacts"]


def test_drop_folder_stream(spark, export, scratch):
    import shutil
    from fundlens.streaming import drop_folder
    drop = os.path.join(scratch, "drop")
    os.makedirs(drop)
    shutil.copy(export, os.path.join(drop, "export-1.csv"))
    prm = Params(current_year=2021, yoy_from=2019, train_from=2019, outlier_years=(), horizon=2)
    q = drop_folder.start(spark, drop, export, os.path.join(scratch, "stream-out"), prm, name=os.path.basename(scratch))
    q.awaitTermination(600)
    assert q.exception() is None
    docs = glob(os.path.join(scratch, "stream-out", "epoch=*", "docs", "summary_stats", "*.json"))
    assert len(docs) == 1
    assert json.loads(open(docs[0], encoding="utf-8").read())["total_projects"] == 4


def test_stream_rejects_another_layout_and_resumes(spark, export, scratch, monkeypatch):
    import shutil
    from fundlens.streaming import drop_folder
    monkeypatch.setattr(R, "analyse_and_publish", lambda *a: [f"docs/{d}" for d in R.dims.EXPECTED_ARTIFACTS])
    drop, out = os.path.join(scratch, "drop in"), os.path.join(scratch, "out")
    os.makedirs(drop)
    shutil.copy(export, os.path.join(drop, "export-1.csv"))

    def run():
        q = drop_folder.start(spark, drop, export, out, checkpoint=os.path.join(scratch, "progress"))
        q.awaitTermination(300)

    run()
    run()                                       # nothing new: the first export is not run again
    assert sorted(os.listdir(out)) == ["epoch=0"]
    lines = open(export, "rb").read().split(b"\r\n")
    head = lines[0].replace(b"Ressort", b"X").replace(b'"PT"', b'"Ressort"').replace(b"X", b"PT")
    with open(os.path.join(drop, "export-2.csv"), "wb") as f:
        f.write(b"\r\n".join([head, *lines[1:]]))
    with pytest.raises(Exception, match="another column layout"):
        run()
    assert not os.path.exists(os.path.join(out, "epoch=1"))


def test_published_checks_on_driver_tables(spark, scratch):
    from conftest import SF_SMALL
    from fundlens.plans.params import DRIVER_PARAMS
    from fundlens.plans.registry import driver_population
    r = R.refresh_tables(spark, SF_SMALL, os.path.join(scratch, "t"), DRIVER_PARAMS,
                         driver_population(spark, SF_SMALL), write_docs=False)
    rows = [json.loads(line) for f in glob(f"{r['out']}/reports/validation_analysis/*.json") for line in open(f)]
    by = {c["name"]: c for c in rows}
    for name in ["summary_projects", "summary_funding", "ministry_groups", "unique_recipients",
                 "keyword_trends_structure", "recipients_top5", "states_top5", "decade_shares_sum_100",
                 "per_capita_formula"]:
        assert by[name]["passed"], name
    assert not by["states_with_population"]["passed"]  # the driver tables have 9 named states, not 16


def test_small_export_warns(spark, export):
    with pytest.warns(UserWarning):
        RC.validate_header(spark, export)
