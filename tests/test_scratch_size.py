"""What repair keeps on disk."""

from vellum.queries import outputs
from vellum.sources import shared

DIR = "/root/testdata/sf0.001"


def test_repair_keeps_each_text_once(spark, monkeypatch):
    """Prepared blocks hold no second copy of texts, readings or layouts that are the text's own; pairs are asked once for a document."""
    kept, plain = {}, shared.Scratch.table

    def table(self, df, name):
        kept[name] = plain(self, df, name)
        return kept[name]

    monkeypatch.setattr(shared.Scratch, "table", table)
    outputs.e1_enriched(spark, DIR)
    assert not {"layout", "_laid", "_normal", "_filled", "_text", "_reading"} & set(kept["prepared-blocks"].columns)
    assert kept["regions"].where("layout = reading").isEmpty() and kept["regions"].where("layout IS NOT NULL").count() > 0
    assert set(kept["good"].columns) == {"doc_id", "left", "whole"} and kept["good"].count() == kept["good"].distinct().count()
