from __future__ import annotations

from lotledger.schemas import LOT_FIELDS, shaped
from lotledger.sources.tables import LotTable, path_exists


def test_a_repeated_tag_does_not_roll_back(spark, tmp_path):
    table = LotTable(spark, str(tmp_path / "lots"), str(tmp_path / "staging"), 4)

    def lots(*rows):
        return shaped(spark.createDataFrame(rows, "id string, source string, sold_price int"), LOT_FIELDS)

    table.merge(lots(("x", "a", 100), ("y", "a", 5)), "b1")
    table.merge(lots(("x", "a", 200)), "b2")
    table.merge(lots(("x", "a", 100)), "b1")
    assert sorted((r.id, r.sold_price) for r in table.read().collect()) == [("x", 200), ("y", 5)]
    assert table.resume("b1") and table.resume("b2") and not table.resume("b3")
    assert not path_exists(spark, str(tmp_path / "staging" / "b2" / "content"))
