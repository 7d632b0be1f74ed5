import json

import pytest

from logquarry.__main__ import main
from logquarry.engine import LogEngine


def test_commands(spark, tmp_path, capsys):
    LogEngine(spark, str(tmp_path)).ingest_lines('{"message":"disk full","ts":"2024-01-15T00:00:01"}\nother')
    run = lambda *a: (main(["--data", str(tmp_path), *a]), capsys.readouterr().out)[1]
    assert run("query", "DISK", "--to", "2024-01-16") == "[2024-01-15T00:00:01.000Z] http: disk full\nfound 1 results\n"
    assert json.loads(run("logql", '{} |= "disk"'))["data"]["result"][0]["values"][0][1] == "disk full"
    assert run("labels") == '{"status":"success","data":["source"]}\n'
    assert "logquarry_log_entries_total 2\n" in run("metrics")
    assert run("version").startswith("logquarry ")
    with pytest.raises(SystemExit):
        main(["nonsense"])
