from pathlib import Path

import pytest

from twinsift import cli
from twinsift.plans import fixtures

SF = "/root/testdata/sf0.001"


@pytest.mark.skipif(not Path(SF).exists(), reason="no test tables")
def test_preview_and_auto(spark, tmp_path, capsys):
    groups, members, files = fixtures.groups_doc(spark, SF)
    for name, df in (("groups", groups), ("members", members), ("files", files), ("sources", fixtures.sources(spark, SF))):
        df.write.parquet(str(tmp_path / "t" / name))
    assert cli.main(["preview", "--tables", str(tmp_path / "t")], spark) == 0
    assert "TOTAL" in capsys.readouterr().out
    status = cli.main(["auto", "--tables", str(tmp_path / "t"), "--out", str(tmp_path / "o"), "--yes"], spark)
    plan = spark.read.parquet(str(tmp_path / "o" / "plan"))
    kept = spark.read.parquet(str(tmp_path / "o" / "members")).filter("is_keeper")
    assert plan.count() > 0 and plan.join(kept, "file_id", "left_semi").count() == 0
    assert status == (2 if plan.filter("outcome = 'missing'").count() else 0)
