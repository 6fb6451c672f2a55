"""The command line's exit status and output."""

import json

from profusion import cli
from tests import fixtures


def test_success_and_failure(spark, tmp_path):
    folder, out, config = tmp_path / "in", tmp_path / "out" / "o.json", tmp_path / "c.json"
    folder.mkdir()
    fixtures.write(folder)
    config.write_text(json.dumps({"include_provenance": False, "include_confidence": False, "on_missing": "omit", "fields": [{"path": "name", "from": "full_name"}, {"path": "phone", "from": "phones[0]"}]}))
    assert cli.main(["--inputs", str(folder), "--config", str(config), "--output", str(out)]) == 0
    rows = json.loads(out.read_text())
    assert rows[0] == {"name": "Mira Okafor", "phone": "+13125550147"} and rows[3] == {"name": "Raj Verma"}
    assert cli.main(["--inputs", str(tmp_path / "none")]) == 1
