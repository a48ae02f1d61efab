import json

import pytest

from tessel import cli
from tessel.plans import golden
from tessel.session import scratch_folder, session


@pytest.fixture()
def files(tmp_path):
    legit, fraud = (golden.GOLDEN[x] for x in ("legit", "fraud"))
    rows = [{"vector": [x + i / 10000 for x in v], "label": label} for i in range(10) for (_, v), label in ((legit, "legit"), (fraud, "fraud"))]
    (tmp_path / "references.json").write_text(json.dumps(rows))
    entries = [{"request": legit[0], "expected_approved": True}, {"request": fraud[0], "expected_approved": False}] * 3
    (tmp_path / "tests.json").write_text(json.dumps({"entries": entries}))
    return tmp_path


def test_options():
    assert cli.options(["build", "a", "--k", "7", "b", "--seed"]) == (["build", "a", "b"], {"k": "7", "seed": ""})
    assert cli.number("x", 3) == 3 and cli.number(None, 4) == 4 and cli.number("5", 1) == 5


def test_usage(capsys):
    assert cli.main([]) == 2 and cli.main(["build", "only-one"]) == 2
    assert "selftest" in capsys.readouterr().out


def test_selftest(spark, capsys):
    assert cli.main(["selftest"]) == 0
    assert "passed" in capsys.readouterr().out


def test_build_validate_and_diag(spark, files, capsys):
    index = str(files / "index")
    assert cli.main(["build", str(files / "references.json"), index, "--k", "2", "--iters", "3"]) == 0
    assert cli.main(["validate", str(files / "tests.json"), "--index", index, "--nprobe", "1,2", "--adaptive", "1,2,9", "--limit", "4"]) == 0
    assert cli.main(["diag", str(files / "references.json"), index, str(files / "tests.json"), "--nprobe", "1"]) == 0
    out = capsys.readouterr().out
    assert "3000.0" in out and "exact_float" in out and "ivf_i16" in out


def test_session_keeps_the_settings(spark):
    assert session().conf.get("spark.sql.session.timeZone") == "UTC"


def test_scratch_folders_are_apart(spark):
    assert scratch_folder(spark) != scratch_folder(spark)
