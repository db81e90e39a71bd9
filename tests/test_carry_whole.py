"""The post-image of a replaced row: the whole events table, all its columns."""

from collections import Counter

from strataview.queries import _stored
from strataview.sources.catalog import ParquetCatalog

SF = "/root/testdata/sf0.001"


def test_every_row_and_column_is_carried_across(spark):
    before = ParquetCatalog(spark, SF).table("events")
    store = _stored(spark, SF, "events", before)
    v = store.version("events")
    row = store.table("events", v).where("event_id = 7").first().asDict()
    store.replace_row("events", "event_id", 7, {**row, "value": 0.25}, v)
    after = store.table("events")
    assert "ts" in after.columns and after.columns == before.columns
    want = [{**r.asDict(), **({"value": 0.25} if r.event_id == 7 else {})} for r in before.collect()]
    assert Counter(tuple(r) for r in after.collect()) == Counter(tuple(r.values()) for r in want)
