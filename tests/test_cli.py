"""The command line."""

from taleforge import cli


def test_doctor_and_list(capsys):
    assert cli.main(["doctor"]) == 0
    assert {c.status for c in cli.doctor()} <= {"ok", "warn"}
    assert cli.main(["list"]) == 0
    assert "best_clip: A8." in capsys.readouterr().out


def test_run(spark, tmp_path, capsys):
    assert cli.main(["run", "none", "x"]) == 2
    assert cli.main(["run", "dry_run", "/root/testdata/sf0.001", "--out", str(tmp_path / "o")]) == 0
    assert spark.read.parquet(str(tmp_path / "o")).count() == 1
