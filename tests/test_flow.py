"""The whole flow on a small bank file set, and its second, resumed run."""

import itertools

import pytest

from segmentry.operators.segmentation import SweepOptions
from segmentry.plans import flow
from segmentry.plans.bank import BANK
from segmentry.spec import ShareRule
from tests.test_features import DEFAULTS

OPTIONS = SweepOptions(ks=(2, 3, 4), rule=ShareRule(0.05, 0.8))


def bank_files(folder):
    """60 customers in three kinds, two transactions each, in two files."""
    kinds = [
        {"ing_mes": "900", "ocup": "pensionado", "mun_res": "cali", "genero_cli": "m"},
        {"ing_mes": "5000", "ocup": "ganadero", "mun_res": "medellin", "genero_cli": "f"},
        {"ing_mes": "None", "ocup": "otra", "mun_res": " None ", "genero_cli": "m"},
    ]
    lines = []
    for i, t in itertools.product(range(60), range(2)):
        row = {**DEFAULTS, **kinds[i % 3], "cli": str(i), "trn_monto": str(10 * (i % 3) + t)}
        lines.append(",".join(row[c] for c in BANK.columns))
    header = ",".join(BANK.columns)
    for n in range(2):
        (folder / f"part{n}.csv").write_text("\n".join([header, *lines[n::2]]) + "\n", encoding="utf-8")


@pytest.fixture(scope="module")
def folders(tmp_path_factory):
    source, output = tmp_path_factory.mktemp("source"), tmp_path_factory.mktemp("output")
    bank_files(source)
    return str(source), str(output)


@pytest.fixture(scope="module")
def result(spark, folders):
    return flow.run_segmentation(spark, *folders, BANK, OPTIONS, sample_rows=25)


def test_flow_separates_the_kinds_of_customers(result):
    assert result.cleaned.count() == 120
    kinds = {}
    for row in result.first_predictions.select("cli", "prediction").collect():
        kinds.setdefault(int(row["cli"]) % 3, set()).add(row["prediction"])
    assert all(len(v) == 1 for v in kinds.values())
    assert result.predictions.count() == 60
    assert len(result.top_features) == 7
    assert result.sample.count() == 25 and "features" not in result.sample.columns
    assert sum(r["share"] for r in result.shares.collect()) == pytest.approx(1.0)
    assert set(result.profile.columns) == {"prediction", *[f"median_{f}" for f in result.top_features]}
    assert len(result.model.clusterCenters()[0]) == 7
    assert [r["k"] for r in result.sweep.orderBy("k").collect()] == [2, 3, 4]


def test_the_report_has_all_sections(result):
    assert set(result.report) == {
        "missing_counts", "numeric_summary", "category_frequency", "numeric_moments", "risk_patterns",
        "entity_behavior", "correlation_matrix", "entity_conflicts",
    }
    counts = {r["column"]: r["missing"] for r in result.report["missing_counts"].collect()}
    assert counts["ing_mes"] == 40 and counts["mun_res"] == 40 and counts["cli"] == 0
    assert result.report["entity_behavior"].count() == 60


def test_a_second_run_reads_what_is_stored(spark, folders, result, monkeypatch):
    def fail(*args, **kwargs):
        raise AssertionError("computed again")

    for step in ("scan_csv", "fit_labels", "build_features", "segment", "rank_features"):
        monkeypatch.setattr(flow, step, fail)
    monkeypatch.setattr(flow, "report_sections", lambda *_: dict.fromkeys(result.report, fail))
    again = flow.run_segmentation(spark, *folders, BANK, OPTIONS, sample_rows=25)
    assert again.top_features == result.top_features
    assert again.sample.collect() == result.sample.collect()


def rebuilt(monkeypatch, spark, folders, spec=BANK, options=OPTIONS, sample_rows=25):
    """Names of the steps that a run computes again."""
    steps = []
    for step in ("clean_columns", "fit_labels", "build_features", "segment", "rank_features", "profile_sample"):
        plain = getattr(flow, step)
        monkeypatch.setattr(flow, step, lambda *a, _plain=plain, _name=step, **k: steps.append(_name) or _plain(*a, **k))
    flow.run_segmentation(spark, *folders, spec, options, sample_rows=sample_rows)
    monkeypatch.undo()
    return steps


def test_a_changed_run_computes_the_steps_it_affects(spark, folders, result, monkeypatch):
    assert rebuilt(monkeypatch, spark, folders) == []
    assert rebuilt(monkeypatch, spark, folders, sample_rows=10) == ["profile_sample"]
    other = SweepOptions(ks=(2, 3), rule=OPTIONS.rule)
    assert rebuilt(monkeypatch, spark, folders, options=other) == ["segment", "rank_features", "segment", "profile_sample"]
    changed = rebuilt(monkeypatch, spark, folders, spec=BANK.with_(rare_share=0.01))
    assert changed[:3] == ["clean_columns", "fit_labels", "build_features"] and "segment" in changed
    with open(f"{folders[0]}/part1.csv", "a", encoding="utf-8") as file:
        file.write(",".join({**DEFAULTS, "cli": "99"}[c] for c in BANK.columns) + "\n")
    assert "clean_columns" in rebuilt(monkeypatch, spark, folders, spec=BANK.with_(rare_share=0.01))
