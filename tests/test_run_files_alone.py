"""A conversion that is asked for files alone writes no rendered blocks, and gives the same files."""

from vellum.plans import convert
from vellum.queries import outputs
from vellum.sources import shared

DIR = "/root/testdata/sf0.001"


def test_files_alone_are_those_of_a_whole_run(spark, monkeypatch):
    """Neither rendered blocks nor a copy of the repaired ones are stored where no table or figure is added to them; the metadata is, once."""
    named, plain, run = [], shared.Scratch.table, convert.run
    monkeypatch.setattr(shared.Scratch, "table", lambda self, df, name: named.append(name) or plain(self, df, name))
    alone = outputs.e10_enriched(spark, DIR)
    stored = list(named)
    monkeypatch.setattr(convert, "run", lambda *a, **k: run(*a, **{**k, "keep": True}))
    whole = outputs.e10_enriched(spark, DIR)
    assert not {"rendered", "rendering", "documents"} & set(stored) and "described" in stored and {"rendered", "documents"} <= set(named)
    assert alone.count() == whole.count() > 0 and alone.exceptAll(whole).isEmpty()
